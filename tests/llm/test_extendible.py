import hashlib

import pytest

from pathloom.llm import extendible


def _brute(rows, limit):
    h = {k: f"{int(hashlib.md5(('' if k is None else str(k)).encode()).hexdigest()[:15], 16):060b}" for k, _ in rows}
    out, todo = {}, [""]
    while todo:
        prefix = todo.pop()
        own = [(k, n) for k, n in rows if h[k].startswith(prefix)]
        if sum(n for _, n in own) > limit and len({h[k] for k, _ in own}) > 1:
            todo += [prefix + "0", prefix + "1"]
        else:
            out |= {k: (prefix, sum(n for _, n in own), len(own)) for k, _ in own}
    return out


@pytest.mark.parametrize(("which", "limit"), [("prose", 3000), ("prose", 700), ("prose", 10), ("odd", 100), ("odd", 1 << 30)])
def test_shards(which, limit, request, monkeypatch):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, len((r.text or "").encode())) for r in df.collect()]
    want = _brute(rows, limit)
    monkeypatch.setattr(extendible, "SPARE_BITS", 0)
    monkeypatch.setattr(extendible, "ROUND_BITS", 3)
    got = extendible.assign(df, limit).collect()
    assert sorted(str((r.doc_id, r.bytes)) for r in got) == sorted(map(str, rows))
    for r in got:
        assert (r.shard, r.shard_bytes, r.shard_rows) == want[r.doc_id] and r.depth == len(r.shard) and r.fits == (r.shard_bytes <= limit)


def test_empty_and_native(nothing, prose):
    assert extendible.assign(nothing, 10).count() == 0
    plan = extendible.assign(prose, 1000)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_columns_and_long_texts(prose, spark):
    wide = prose.selectExpr("*", *(f"'x' AS {c}" for c in ("h", "bytes", "cell", "shard", "depth", "key", "fits", "level", "prefix")))
    assert sorted(map(str, extendible.assign(wide, 700).collect())) == sorted(map(str, extendible.assign(prose, 700).collect()))
    long = spark.createDataFrame([(1, "x" * 3_000_000), (2, ""), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: (r.bytes, r.fits) for r in extendible.assign(long, 1000).collect()}
    assert got[1] == (3_000_000, False) and got[2][0] == got[3][0] == 0
