import re
from collections import defaultdict

import pytest

from pathloom.llm import mixture


def _brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("which", ["prose", "odd"])
def test_targets_and_words(which, request):
    df = request.getfixturevalue(which)
    rows = mixture.mix(df).collect()
    docs = df.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(d.doc_id), size(d.text)) for d in docs)
    sizes, taken = defaultdict(int), defaultdict(int)
    for d in docs:
        sizes[d.source] += size(d.text)
    want = _brute_targets(sizes)
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.01, abs=5)
    assert sorted(map(str, mixture.mix(df).collect())) == sorted(map(str, rows))


def test_small_sources_meet_their_targets(spark, monkeypatch):
    """Blocks above one word, sources below one block and sources whose last block is short."""
    monkeypatch.setattr(mixture, "SLOTS", 16)
    sizes = {"a": 300, "b": 1000, "c": 1500, "d": 6007, "e": 1, "f": 70_001, "g": 90_000, "h": 40_123}
    rows = []
    for s, n in sizes.items():
        while n:
            size = min(n, 7 + 13 * (len(rows) % 11))
            rows.append((len(rows), "w " * size, s))
            n -= size
    taken, total = defaultdict(int), 1.5 * sum(sizes.values())
    for r in mixture.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect():
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert total // 16 > 4096
    for s, t in _brute_targets(sizes).items():
        assert taken[s] == pytest.approx(t, rel=0.006, abs=5), s


def test_schedule_is_ranked_and_even(spark):
    sources = spark.createDataFrame([(0, 50.0), (1, 30.0), (2, 0.0), (3, 20.0)], "id int, target double")
    rows = sorted(map(tuple, mixture.schedule(sources, 20_000, spark).collect()))
    assert [r[0] for r in rows] == list(range(20_000))
    at = defaultdict(int)
    for k, (slot, source, rank) in enumerate(rows):
        assert rank == at[source] and slot == k
        at[source] += 1
        if k % 1000 == 999:
            assert all(abs(at[s] - (k + 1) * share) < 4 for s, share in ((0, 0.5), (1, 0.3), (3, 0.2)))


def test_empty(nothing):
    assert mixture.mix(nothing).count() == 0
    assert {r.taken for r in mixture.mix(nothing.union(nothing.sparkSession.createDataFrame([(1, None, None, "a")], nothing.schema))).collect()} == {0}


def test_clashing_columns(prose):
    wide = prose.selectExpr("*", *(f"'x' AS {c}" for c in ("id", "h", "bucket", "unit", "block", "taken", "size", "key", "target", "slot")))
    assert sorted(map(str, mixture.mix(wide).collect())) == sorted(map(str, mixture.mix(prose).collect()))
