import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathloom.llm import byte_bpe, orc_tokens


def _le(ids):
    return np.array(ids, "<u4").tobytes()


def test_byte_bpe_is_the_librarys_own(odd, prose):
    plain = byte_bpe.Codec().encoding
    rows = odd.select("doc_id", "text").union(prose.select("doc_id", "text"))
    want = sorted((str(r.doc_id), len(i := plain.encode_ordinary(r.text or "")), hashlib.sha256(_le(i)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows.collect())
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(rows).collect())
    assert got == want


def test_pieces_are_cut_where_ids_do_not_change():
    c = byte_bpe.Codec()
    text = "it's  'twas\n\n we'll 123abc —  dash\t\ttab 'sx don't\r\n " * 300
    assert "".join(byte_bpe.pieces(text, 50)) == text and len(list(byte_bpe.pieces(text, 50))) > 100
    assert [i for p in byte_bpe.pieces(text, 50) for i in c.encoding.encode_ordinary(p)] == c.encoding.encode_ordinary(text)
    assert list(byte_bpe.pieces("", 5)) == [""]


def test_encode_then_decode_keeps_other_columns(odd):
    rows = byte_bpe.decode(byte_bpe.encode(odd.withColumnRenamed("lang", "ids"))).collect()
    assert len(rows) == odd.count() and set(rows[0].asDict()) == {"doc_id", "text", "source", "ids", "data"}
    assert all(bytes(r.data) == (r.text or "").encode() for r in rows)


def test_ids_may_decode_to_broken_utf8():
    c = byte_bpe.Codec()
    ids = c.encode("\U0001f600")
    assert len(ids) > 1 and c.decode(ids[:1]) == "\U0001f600".encode()[: len(c.decode(ids[:1]))]


def test_empty_tables(nothing, spark):
    assert byte_bpe.digests(nothing).count() == 0
    assert orc_tokens.encode_table(nothing).count() == 0


def test_orc_catalogue(odd, prose):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = odd.select("doc_id", "text").union(prose.select("doc_id", "text"))
    ordered = sorted(rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    want, start = [], 0
    for r in ordered:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(_le(ids))))
        start += len(ids)
    got = sorted((tuple(r) for r in orc_tokens.encode_table(rows).collect()), key=lambda r: r[1])
    ids_of = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[3]))
    assert [r[1] for r in ids_of(got)] and sorted(r[2:] for r in got) == sorted(r[2:] for r in want)
    assert got == want


def test_orc_files_are_read_by_metadata(spark, prose, tmp_path):
    path = str(tmp_path / "ids")
    orc_tokens.write(prose, path)
    found = orc_tokens.lookup(spark, path, [3, 30])
    assert {r.key for r in found.collect()} == {3, 30}
    assert "PushedFilters: [In(key" in found._jdf.queryExecution().toString()


def _rows_read(df):
    """Rows that the scan of an executed plan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value()


def test_row_groups_and_absent_ids_are_skipped(spark, tmp_path):
    """One file of 5,000 even ids: a lookup reads one row group, and none where the Bloom filter knows the id to be absent."""
    path = str(tmp_path / "ids")
    orc_tokens.write(spark.range(5000).selectExpr("id * 2 AS doc_id", "concat('text number ', id) AS text").repartition(1), path)
    assert spark.read.orc(path).select(F.input_file_name()).distinct().count() == 1
    assert _rows_read(orc_tokens.read(spark, path)) == 5000
    found = orc_tokens.lookup(spark, path, [4444])
    assert _rows_read(found) <= orc_tokens.ROW_INDEX_STRIDE and [r.key for r in found.collect()] == [4444]
    absent = [_rows_read(orc_tokens.lookup(spark, path, [k])) for k in (1, 1999, 4001, 5555, 8887)]
    assert absent.count(0) >= 4  # a Bloom filter is wrong once in a hundred times


def test_files_and_ids_of_any_kind(spark):
    """A session that limits rows a file changes nothing; ids may be text; clashing columns are left out."""
    df = spark.range(20).selectExpr("id AS doc_id", "repeat('word ', int(id)) AS text", "'x' AS key", "1 AS before", "2 AS ids", "3 AS file")
    plain = sorted(map(tuple, orc_tokens.encode_table(df).collect()))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        assert sorted(map(tuple, orc_tokens.encode_table(df).collect())) == plain
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    starts = [r[1] for r in plain]
    assert starts == [sum(r[2] for r in plain[:k]) for k in range(20)]
    named = orc_tokens.encode_table(df.selectExpr("concat('id-', 10 + doc_id) AS doc_id", "text")).collect()
    assert sorted((r[1:] for r in named)) == sorted(r[1:] for r in plain) and {r.doc_id for r in named} == {f"id-{10 + k}" for k in range(20)}


@pytest.mark.parametrize("text", ["", " ", "\n", "a b²³", "it's 'll we'LL -- '' 's's", "你好 <|endoftext|> a", "a <|endoftext|> b", "\x1c \x85x", "héllo wörld don't  stop\n\n foo123 bar_baz 'sabc \r\n\t x"])
def test_words_encode_as_whole_texts_do(text):
    e = orc_tokens.encoder()
    assert e.encode(text) == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert e.encode(text * 3) == e.tokenizer.encode(text * 3, add_special_tokens=False).ids
