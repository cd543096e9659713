from collections import defaultdict

import numpy as np
import pytest

from pathloom.llm import ngram_join


def _sets(rows):
    out = []
    for _, text in rows:
        w = (text or "").lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def _brute(rows):
    sets, n = _sets(rows), len(rows)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for k in range(n):
        if rows[k][0] is not None:
            least[find(k)].append(rows[k][0])
    return sorted(str((rows[k][0], min(least[find(k)], default=None), links[k])) for k in range(n))


@pytest.mark.parametrize("block", [256, 16])
def test_groups(prose, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = [(r.doc_id, r.text) for r in prose.collect()]
    got = sorted(str(tuple(r)) for r in ngram_join.groups(prose).collect())
    want = _brute(rows)
    assert sum(not x.endswith(" 0)") for x in want) > 100
    assert got == want


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(str(tuple(r)) for r in ngram_join.groups(odd).collect()) == _brute(rows)
    assert ngram_join.groups(nothing).count() == 0 and ngram_join.one_of_each(nothing).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "None", "600", "5000"])


def test_one_row_of_each_group(spark):
    """Ids with several texts, rows that repeat id and text, and columns with the names that the join uses."""
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    df = spark.createDataFrame([(5, a, 1), (7, a, 2), (3, b, 3), (5, b, 4)], "doc_id bigint, text string, kept_key int")
    assert sorted(map(tuple, ngram_join.one_of_each(df).collect())) == [(3, b, 3), (5, a, 1)]
    names = ["kept_hash", "kept_n", "KEY", "h", "class", "label", "links"]
    rows = [(1, a, *range(k, k + 7)) for k in range(40)] + [(2, b, *range(7)), (9, None, *range(7)), (9, None, *range(7)), (None, a, *range(7))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names))
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "9", "9"]
    assert sorted(map(str, got.collect())) == sorted(map(str, ngram_join.one_of_each(df.repartition(7)).collect()))


def test_signatures_alone_prune(spark, prose, monkeypatch):
    """Blocks bounded by shingles give the same groups, and shingles are only fetched where a candidate is left."""
    want = sorted(map(str, ngram_join.groups(prose).collect()))
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    assert sorted(map(str, ngram_join.groups(prose).collect())) == want
    rng = np.random.default_rng(1)
    signatures = rng.integers(0, 1 << 30, (40, ngram_join.HASHES), dtype=np.uint32)
    signatures[20:] = np.where(rng.random((20, ngram_join.HASHES)) < 0.9, signatures[:20], signatures[20:])
    first, second = ngram_join.candidates(signatures, np.arange(40) // 20, False, 0)
    assert sorted(zip(first.tolist(), second.tolist(), strict=True)) == [(k, k + 20) for k in range(20)]
    assert len(ngram_join.candidates(signatures, np.arange(40) // 20, False, 26)[0]) == 0


def test_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(3)
    for similarity in (0.8, 0.85, 0.95):
        a = rng.integers(0, 1 << 30, (3000, ngram_join.HASHES), dtype=np.uint32)
        b = np.where(rng.random(a.shape) < similarity, a, a + 1)
        assert len(ngram_join.survivors(a, b)) == 3000
    b = np.where(rng.random(a.shape) < 0.3, a, a + 1)
    assert len(ngram_join.survivors(a, b)) == 0


def test_verification_by_matrices_is_exact():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.choice(6000, rng.integers(1, 4000)).astype(np.uint64)) for _ in range(6)]
    sets += [np.sort(np.delete(s, rng.integers(0, len(s), max(0, len(s) // 8)))) for s in sets for _ in range(5)]
    first, second = np.triu_indices(len(sets), 1)
    got = set(zip(*(x.tolist() for x in ngram_join.linked_pairs(sets, first, second)), strict=True))
    want = {(i, j) for i, j in zip(first.tolist(), second.tolist(), strict=True) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9}
    assert got == want and want


def test_components(spark):
    edges = spark.createDataFrame([(bytearray([a]), bytearray([a + 1])) for a in [*range(1, 30), *range(40, 45)]], "a binary, b binary")
    got = {r.node[0]: r.label[0] for r in ngram_join.components(edges).collect()}
    assert got == {k: 1 for k in range(1, 31)} | {k: 40 for k in range(40, 46)}
    assert ngram_join.components(edges.where("false")).count() == 0
