"""The registered query of each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import byte_bpe, extendible, langid, licenses, main_text, mixture, mpegts, ngram_join, orc_tokens, syncmers
from pathloom.llm.shared import table

#: The byte limit of a shard in the query; the operator takes it as a parameter.
SHARD_BYTES = 1 << 20


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a transport stream, parsed again from its bytes."""
    return mpegts.features(mpegts.store(_texts(spark, sf_dir)))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document, and the number of documents that it is linked to."""
    return ngram_join.groups(_texts(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or inherited.

    The table has no paths. A document's path is its source, its language and its id; a text of at most 40 words that speaks of
    a licence is a licence file, of its language's directory if its id is odd and of its source's if it is even.
    """
    documents = table(spark, sf_dir, "documents")
    short = F.coalesce(~F.col("text").rlike(r"\S" + r"(?:\s++\S++)" * 39 + r"\s++\S") & F.col("text").rlike(r"(?i)licen[cs]e|rights reserved|public domain"), F.lit(False))
    up, number = F.when(F.col("doc_id") % 2 != 0, F.col("lang")), F.col("doc_id").cast("string")
    path = F.when(short, F.concat_ws("/", "source", up, F.concat(F.lit("LICENSE-"), number))).otherwise(F.concat_ws("/", "source", "lang", number))
    return licenses.scan(documents.select("doc_id", "text", path.alias("path")))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixture.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op5_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids in ORC files, catalogued from the files."""
    return orc_tokens.encode_table(_texts(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the rows that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents.where(langid.is_training_row()).select("doc_id", "text", "lang"))
    found = langid.predict(documents.select("doc_id", "text"), model, drop=("text",))
    return found.select("doc_id", (~langid.is_training_row()).alias("held_out"), "lang_pred", "score", "rejected")


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form."""
    return syncmers.fingerprints(_texts(spark, sf_dir))


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return extendible.assign(_texts(spark, sf_dir), SHARD_BYTES)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return byte_bpe.digests(_texts(spark, sf_dir))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mpegts": op1_mpegts,
    "op2_ngram_join": op2_ngram_join,
    "op3_license_scan": op3_license_scan,
    "op4_mix_sources": op4_mix_sources,
    "op5_orc_tokens": op5_orc_tokens,
    "op6_language_id": op6_language_id,
    "op7_syncmers": op7_syncmers,
    "op8_extendible_shards": op8_extendible_shards,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_main_text": op10_main_text,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY ALL
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS class_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS links FROM documents d
""",
    "op4_mix_sources": f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents
), named AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS id, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), caps AS (
  SELECT *, [5.0, 2.0, 1.0][id % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM named
), levels AS (
  SELECT *, cap / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps
), targets AS (
  SELECT source, id, source_size, least(cap, weight * (SELECT arg_min(level, (ratio, id)) FROM levels WHERE level <= ratio)) AS target FROM levels
), whole AS (
  SELECT total, greatest(1, least({mixture.MOST_WORDS}, floor(total / {mixture.SLOTS})))::BIGINT AS block FROM (SELECT round(sum(target), 3) AS total FROM targets)
), spans AS (
  SELECT id, coalesce(lag(high) OVER (ORDER BY id), 0) AS low, high FROM (
    SELECT id, CASE WHEN id = max(id) OVER () THEN 2.0 ELSE sum(target) OVER (ORDER BY id) / sum(target) OVER () END AS high FROM targets WHERE target > 0)
), slots AS (
  SELECT slot, (slot % {mixture.POINTS} * {mixture.GOLDEN} % {mixture.POINTS}) / {mixture.POINTS}.0::DOUBLE AS point FROM (SELECT unnest(range(0, CAST(ceil(total / block) AS BIGINT))) AS slot FROM whole)
), ranked AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY slot) - 1 AS rank FROM slots ASOF JOIN spans ON point >= low
), taken AS (
  SELECT id, rank % blocks AS block, count(*) AS passes FROM ranked JOIN (SELECT id, greatest(1, ceil(source_size / (SELECT block FROM whole)))::BIGINT AS blocks FROM targets) USING (id)
  WHERE rank < {mixture.PASSES} * blocks GROUP BY ALL
), lined AS (
  SELECT doc_id, s.source, size, id, source_size, target, sum(size) OVER (PARTITION BY id ORDER BY h % (CAST(floor(sqrt((SELECT count(*) FROM sized))) AS BIGINT) + 1), h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS past
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), pieces AS (
  SELECT *, past - size AS start, unnest(range((past - size) // (SELECT block FROM whole), (past - 1) // (SELECT block FROM whole) + 1)) AS block FROM lined WHERE size > 0
), got AS (
  SELECT doc_id, sum((least(past, (p.block + 1) * w.block) - greatest(start, p.block * w.block)) * passes)::BIGINT AS taken FROM pieces p CROSS JOIN whole w JOIN taken t ON t.id = p.id AND t.block = p.block GROUP BY ALL
)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0) AS taken FROM lined LEFT JOIN got USING (doc_id)
""",
    "op8_extendible_shards": f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents
), over AS (
  SELECT lv, h >> (60 - lv) AS prefix FROM d, (SELECT unnest(range(0, 60)) AS lv)
  GROUP BY ALL HAVING sum(bytes) > {SHARD_BYTES} AND min(h) <> max(h)
), depths AS (
  SELECT d.doc_id, d.h, any_value(d.bytes) AS bytes, count(o.lv)::INTEGER AS depth FROM d LEFT JOIN over o ON d.h >> (60 - o.lv) = o.prefix GROUP BY d.doc_id, d.h
), named AS (
  SELECT doc_id, bytes, depth, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(h), 60, '0'), 60)[1:depth] END AS shard FROM depths
)
SELECT doc_id, bytes, shard, depth, (sum(bytes) OVER (PARTITION BY shard))::BIGINT AS shard_bytes, count(*) OVER (PARTITION BY shard) AS shard_rows,
  sum(bytes) OVER (PARTITION BY shard) <= {SHARD_BYTES} AS fits
FROM named
""",
}
