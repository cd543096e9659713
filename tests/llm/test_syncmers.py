import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from pathloom.llm import syncmers


def _brute(spark, text):
    units = re.findall(r"[^ \t\n\x0b\f\r]{1,12}", text)
    if not units:
        return []
    if len(units) < 4:
        return [(0, None)]
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(units, units[1:], strict=False))], "k int, a string, b string")
    s = [r.h for r in pairs.select("k", F.xxhash64("a", "b").alias("h")).orderBy("k").collect()]
    return [k for k in range(len(units) - 3) if min(s[k : k + 3]) in (s[k], s[k + 2])] or [(0, None)]


def test_anchors_are_closed_syncmers(spark, prose):
    for r in prose.limit(3).collect():
        text = r.text + " averyveryverylongwordwithoutanyspaces"
        got = spark.createDataFrame([(text,)], "text string").select(syncmers.positions_and_anchors(F.col("text")).alias("a")).first().a
        want = _brute(spark, text)
        assert [x["at"] for x in got] == ([0] if want and want[0] == (0, None) else want)


def test_every_text_with_a_unit_has_an_anchor(spark):
    rows = spark.createDataFrame([(f"w{k} x{k} y{k} z{k}",) for k in range(40)] + [("a",), ("",), (None,)], "text string").select(F.size(syncmers.anchors(F.col("text"))).alias("n"))
    assert [r.n for r in rows.collect()] == [1] * 41 + [0, 0]


def test_anchors_need_no_context(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = spark.createDataFrame([("x y z " + passage + " w",), (passage,)], "text string").select(syncmers.anchors(F.col("text")).alias("a")).collect()
    assert set(rows[1].a) <= set(rows[0].a) and len(rows[1].a) >= 4


def test_unspaced_passages_and_short_texts(spark):
    rng = random.Random(3)
    han, base64 = ("".join(chr(rng.randint(a, b)) for _ in range(2000)) for a, b in ((0x4E00, 0x9FA5), (0x41, 0x5A)))
    lines = "\n".join(han[k : k + 40] for k in range(0, 400, 40)) + "\n"
    pairs = [(han, "x" + han), (base64, "x" + base64), ("some words before it " + base64 + " end", "these words and others before it xy" + base64), (lines, "\u4f60" + lines.replace("\n", " "))]
    rows = spark.createDataFrame(pairs, "a string, b string").select(syncmers.likeness(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))).alias("like")).collect()
    assert all(r.like > 0.9 for r in rows), rows
    short = [(9, han[:30]), (7, "an extraordinarily longwinded"), (5, base64[:45]), (3, "unrelated text that has several words"), (2, "\u4f60\u597d")]
    got = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(short, "doc_id bigint, text string")).collect()}
    assert all(0.3 < got[k].near_edited < 1 and got[k].near_next < 0.1 for k in (9, 7, 5)) and got[2].n_anchors == 1


def _check(df):
    docs = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda x: (x[0] is None, -(x[0] or 0)))
    rows = syncmers.fingerprints(df).collect()
    want = []
    for k, (key, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        moved = len(text) // 3
        want.append((key, len(text), hashlib.sha256((text[: len(text) - moved] + after[:moved]).encode()).hexdigest()))
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in rows))) == sorted(map(str, want))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    return rows, dict(docs)


def test_fingerprints(prose, monkeypatch):
    rows, text = _check(prose)
    by = {}
    for r in rows:
        by.setdefault(text[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) >= 0.97 * len(by)  # a word outside all anchors may differ
    large = [r for r in rows if r.n_anchors > 30]
    assert all(0.25 < r.near_edited for r in large) and sum(r.near_edited for r in large) / len(large) > 0.4
    # neighbours across buckets and groups of buckets
    monkeypatch.setattr(syncmers, "BUCKET", 7)
    monkeypatch.setattr(syncmers, "GROUP", 3)
    again, _ = _check(prose)
    assert sorted(map(str, again)) == sorted(map(str, rows))


def _xx(*values):
    """Spark's xxhash64 of strings or longs."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little"), seed=seed)
    return seed


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _anchors(units):
    """{anchor: first position} by the definition."""
    if len(units) < 4:
        return {_xx(*units) >> 1: 0} if units else {}
    s, out = [_signed(_xx(a, b)) for a, b in zip(units, units[1:], strict=False)], {}
    for k in range(len(units) - 3):
        if min(s[k : k + 3]) in (s[k], s[k + 2]):
            out.setdefault(_xx(s[k], s[k + 2]) >> 1, k)
    return out or {_xx(*units) >> 1: 0}


def _fingerprint(text):
    runs, characters = text.split(), re.findall(r"\S", text)
    units = characters if len(runs) < 4 else [u for r in runs for u in (re.findall(r"\S{1,12}", r) if len(r) <= 48 else r)]
    words, fine = {} if len(runs) < 4 else _anchors(units), _anchors(characters) if len(runs) < 16 else {}
    out = [f"{_xx(*units) :016x}", str(len(words) or len(fine))]
    for found in (words, fine):
        least = sorted(found)[:64]
        out += ["-".join(f"{x:016x}" for x in least), "-".join(str(found[x]) for x in least)]
    return ".".join(out)


def _near(x, y):
    """The likeness of two fingerprints, from their texts alone."""
    parts = [[dict(zip([int(h, 16) for h in p[k].split("-") if h], [int(n) for n in p[k + 1].split("-") if n], strict=True)) for k in (2, 4)] for p in (x.split("."), y.split("."))]
    for k in (1, 0):
        a, b = parts[0][k], parts[1][k]
        if a and b:
            most = min([max(s) for s in (a, b) if len(s) == 64], default=1 << 64)
            offsets = sorted(a[h] - b[h] for h in a.keys() & b.keys() if h <= most)
            slack = max(64, max(*a.values(), *b.values()) // 8)
            return sum(abs(o - offsets[len(offsets) // 2]) <= slack for o in offsets) / len([h for h in a.keys() | b.keys() if h <= most])
    return float(not any(parts[0]) and not any(parts[1]))


def test_fingerprints_and_likeness_by_brute_force(spark, prose):
    rng = random.Random(8)
    long = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(1500)) for _ in range(2)]
    moved = " ".join(long[0].split()[700:] + long[0].split()[:700])
    extra = [(-1, long[0]), (-2, long[0].replace("w1", "v1")), (-3, moved), (-4, long[1]), (-5, ""), (-6, " "), (-7, "a b"), (-8, "one two three four five " * 3), (-9, "x" * 200 + " y z w")]
    docs = sorted([(r.doc_id, r.text) for r in prose.collect()] + extra, reverse=True)
    got = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for k, (key, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r, own = got[key], _fingerprint(text)
        assert (r.fingerprint, r.edited_fingerprint) == (own, _fingerprint(edited)), key
        assert r.near_edited == pytest.approx(_near(own, _fingerprint(edited))) and r.near_next == pytest.approx(_near(own, _fingerprint(after))), key
    assert got[-1].near_next > 0.05 and got[-3].near_next < 0.05


def test_hot_ids_and_clashing_columns(spark, monkeypatch):
    """Ids that many rows repeat, with other and with equal texts, null ids, and ids that aren't numbers."""
    monkeypatch.setattr(syncmers, "HOT", 8)
    monkeypatch.setattr(syncmers, "HOT_PARTS", 10)
    rows = [(k % 7 if k % 3 else None, f"word{k % 50} of some text that is number {k % 50} here", k) for k in range(300)] + [(5, "copy " * 20, k) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, bucket int").withColumn("at", F.lit("x")).withColumn("sketch", F.lit(1))
    got = syncmers.fingerprints(df).collect()
    assert sorted(str((r.doc_id, r.n_chars)) for r in got) == sorted(str((k, len(t))) for k, t, _ in rows)
    follows = syncmers.with_next(df, "doc_id", "text").collect()
    assert sorted(r.next_text for r in follows) == sorted(t for _, t, _ in rows)  # everyone is someone's next, once
    ids = {}
    for k, t, _ in rows:
        ids.setdefault(t, set()).add(k)
    order = [6, 5, 4, 3, 2, 1, 0, None]
    for r in follows:
        assert ids[r.next_text] & {r.key, order[(order.index(r.key) + 1) % 8]}
    named = df.selectExpr("concat('id-', doc_id) AS doc_id", "text")
    assert sorted(str(r.doc_id) for r in syncmers.fingerprints(named).collect()) == sorted(str(None if k is None else f"id-{k}") for k, _, _ in rows)


def test_odd_rows(odd, nothing, spark):
    distinct = odd.dropDuplicates(["doc_id"])
    _check(distinct)
    assert syncmers.fingerprints(odd).count() == odd.count()
    assert syncmers.fingerprints(nothing).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")
    _check(one)
    assert {r.near_next for r in syncmers.fingerprints(one).collect()} == {1.0}


def test_it_is_native(prose):
    plan = syncmers.fingerprints(prose)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
