"""Document fingerprints: closed syncmers over words, or characters where there are no words.

Units are runs of visible characters, cut to 12 where they are longer. Cuts depend on where a run starts, so single
characters are the units of scripts that are written without spaces, of runs of more than LONG characters, and of
texts of fewer than k runs; texts of fewer than SHORT runs have anchors of characters too. A k-mer of units is an anchor when the
least of its inner s-mers, by hash, lies at one of its edges. The choice looks at the k-mer alone, so texts that share
a passage share its anchors whatever stands around it, and their positions match up to an offset.

A fingerprint is a text of six parts: a hash of all units, the number of distinct anchors, the least SKETCH of those of words (all of
them where there are no more) in hex, the first position of each, and the same for those of characters. Two fingerprints
are compared by these alone: an anchor of both counts if its offset is near the median offset, out of the anchors that either
would show.

Defined cases: a null text is an empty one, without anchors; a text of fewer than k characters, or
with none chosen, has one anchor, its whole; two texts without anchors are alike (1.0), one without and one with aren't (0.0); texts of any length are
read whole. In descending order of ids null comes last, as does an id that is no whole number; rows of one id stand by the hash of
their texts; the only document is its own next. An empty table gives no rows; columns but the id and the text are left out, so
none can clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.shared import let

K, S = 4, 2
#: Thai, Lao, Burmese and Khmer; Han, kana and their marks, also beyond the basic plane.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u30FF\u3400-\u9FFF\uF900-\uFAFF\uFF01-\uFF9F\x{20000}-\x{3FFFF}"
UNIT = rf"[{UNSPACED}]|[^\s{UNSPACED}]{{1,12}}"
#: A run of so many characters has K units of 12; one that starts elsewhere in it shares none of them.
LONG = 48
LONG_RUN = rf"(?<!\S)\S{{{LONG + 1}}}"
#: K runs.
WORDS = r"\S" + r"\s++\S++" * (K - 2) + r"\s++\S"
#: Texts of fewer runs have anchors of characters as well.
SHORT = 16
SHORT_RUNS = r"\S" + r"(?:\s++\S++)" * (SHORT - 2) + r"\s++\S"
#: Anchors that a fingerprint holds, and how far an anchor's offset may be from the median one: so many units, or this
#: part of the longer text.
SKETCH, SLACK, SLACK_SHARE = 64, 64, 8
#: Ids to a bucket of neighbours, and buckets to a group of them.
BUCKET, GROUP = 32, 2048
LAST = -(1 << 62)
#: Rows from which a bucket is split, if they are over this part of all rows too (so at most so many buckets are).
HOT, HOT_PARTS = 4096, 1000
PLACE = ["bucket", "hot_id", "part", "copy", "salt"]


def few_words(text: Column) -> Column:
    """Whether a text has fewer than K runs, so that its units are characters."""
    return ~F.coalesce(text, F.lit("")).rlike(WORDS)


def units(text: Column, characters: Column) -> Column:
    """The units of a text, ``array<string>``; single characters where ``characters`` holds."""
    text = F.coalesce(text, F.lit(""))
    all_of = lambda t, pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    by_run = F.flatten(F.transform(all_of(text, r"\S+"), lambda r: F.when(F.length(r) > LONG, all_of(r, r"\S")).otherwise(all_of(r, UNIT))))
    return F.when(characters, all_of(text, r"\S")).when(text.rlike(LONG_RUN), by_run).otherwise(all_of(text, UNIT))


def positions_and_anchors(text: Column) -> Column:
    """The anchors of a text with their positions in units, ``array<struct<at, anchor>>``."""
    return let(units(text, few_words(text)), lambda u: let(_smers(u), lambda s: _chosen(u, s, lambda i, a: F.struct(i.alias("at"), a.alias("anchor")))))


def anchors(text: Column, characters: Column | None = None) -> Column:
    """The anchors of a text in their order, ``array<bigint>``."""
    return let(units(text, few_words(text) if characters is None else characters), lambda u: let(_smers(u), lambda s: _chosen(u, s, lambda i, a: a)))


def _smers(units: Column) -> Column:
    """The hash of each two units in a row."""
    return F.when(F.size(units) >= K, F.transform(F.sequence(F.lit(0), F.size(units) - S), lambda i: F.xxhash64(F.get(units, i), F.get(units, i + 1)))).otherwise(F.array().cast("array<bigint>"))


def _chosen(units: Column, smers: Column, make) -> Column:
    at = F.filter(F.sequence(F.lit(0), F.size(units) - K), lambda i: F.least(F.get(smers, i), F.get(smers, i + 2)) <= F.get(smers, i + 1))
    many = F.transform(at, lambda i: make(i, F.shiftrightunsigned(F.xxhash64(F.get(smers, i), F.get(smers, i + 2)), 1)))
    one = F.transform(F.array(F.lit(0)), lambda i: make(i, F.shiftrightunsigned(F.xxhash64(units), 1)))
    return F.when(F.size(units) >= K, let(many, lambda m: F.when(F.size(m) > 0, m).otherwise(one))).when(F.size(units) > 0, one).otherwise(F.slice(one, 1, 0))


def _placed(units: Column) -> Column:
    return let(_smers(units), lambda s: _chosen(units, s, lambda i, a: F.struct(i.alias("at"), a.alias("anchor"))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two whole lists of anchors as sets."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def sketch(text: Column) -> Column:
    """``struct<head, n, anchors, at, fine, fine_at>``, the parts of a text's fingerprint."""
    few, short = few_words(text), ~F.coalesce(text, F.lit("")).rlike(SHORT_RUNS)
    none = F.array().cast("array<struct<at:int,anchor:bigint>>")
    by_words = let(units(text, few), lambda u: F.struct(F.xxhash64(u).alias("head"), F.when(few, none).otherwise(_placed(u)).alias("found")))
    by_characters = F.when(short, let(units(text, F.lit(True)), _placed)).otherwise(none)

    def least(found: Column) -> Column:
        place = lambda x: F.get(found["at"], F.array_position(found["anchor"], x).cast("int") - 1)
        distinct = F.sort_array(F.array_distinct(found["anchor"]))
        return let(distinct, lambda d: let(F.slice(d, 1, SKETCH), lambda xs: F.struct(F.size(d).alias("n"), xs.alias("anchors"), F.transform(xs, place).alias("at"))))

    def parts(r: Column, words: Column, fine: Column) -> Column:
        n = F.when(words["n"] > 0, words["n"]).otherwise(fine["n"])
        return F.struct(r["head"].alias("head"), n.alias("n"), words["anchors"].alias("anchors"), words["at"].alias("at"), fine["anchors"].alias("fine"), fine["at"].alias("fine_at"))

    return let(by_words, lambda r: let(let(r["found"], least), lambda words: let(let(by_characters, least), lambda fine: parts(r, words, fine))))


def written_out(sketch: Column) -> Column:
    """The text of a sketch."""
    number = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    anchors, at = (lambda name: F.array_join(F.transform(sketch[name], number), "-")), (lambda name: F.array_join(sketch[name].cast("array<string>"), "-"))
    return F.concat_ws(".", number(sketch["head"]), sketch["n"].cast("string"), anchors("anchors"), at("at"), anchors("fine"), at("fine_at"))


def near(a: Column, b: Column) -> Column:
    """How alike two sketches are, 0 to 1: of the anchors that both show or would show, those at matching places in both. Short
    texts are compared by characters, any other two by words; two without anchors are alike."""
    shows = lambda name: (F.size(a[name]) > 0) & (F.size(b[name]) > 0)
    nothing = lambda x: (F.size(x["anchors"]) == 0) & (F.size(x["fine"]) == 0)
    fine, words = _near(a["fine"], a["fine_at"], b["fine"], b["fine_at"]), _near(a["anchors"], a["at"], b["anchors"], b["at"])
    return F.when(shows("fine"), fine).when(shows("anchors"), words).when(nothing(a) & nothing(b), 1.0).otherwise(0.0)


def _near(a: Column, a_at: Column, b: Column, b_at: Column) -> Column:
    full = lambda xs: F.when(F.size(xs) >= SKETCH, F.element_at(xs, -1))
    shown = lambda xs, most: F.filter(xs, lambda x: most.isNull() | (x <= most))
    place = lambda x, xs, at: F.get(at, F.array_position(xs, x).cast("int") - 1)
    slack = F.greatest(F.lit(SLACK), F.floor(F.greatest(F.array_max(a_at), F.array_max(b_at)) / SLACK_SHARE).cast("int"))

    def of(most: Column) -> Column:
        either = F.size(shown(F.array_union(a, b), most))
        offsets = F.transform(shown(F.array_intersect(a, b), most), lambda x: place(x, a, a_at) - place(x, b, b_at))
        median = lambda o: F.get(F.sort_array(o), F.floor(F.size(o) / 2).cast("int"))
        aligned = let(offsets, lambda o: let(median(o), lambda m: F.size(F.filter(o, lambda x: F.abs(x - m) <= slack))))
        return aligned / either

    return let(F.least(full(a), full(b)), of)


def _places(rows: DataFrame) -> DataFrame:
    """``rows`` (at, h and more) with PLACE, the columns of the part of the order that a row stands in.

    A place is a bucket of ids. A hot bucket (of an id that many rows repeat, or of null) is split by id and leading bits of
    the texts' hashes, and rows of one text and id, which may stand in any order, by their numbers. Hot ones of either kind
    are known to the driver: at most HOT_PARTS each, as each holds more than that part of the rows.
    """
    rows = rows.withColumn("bucket", F.coalesce(F.expr(f"at div {BUCKET}"), F.lit(LAST)))
    counts = rows.groupBy("bucket").count()
    most = max(HOT, (counts.agg(F.sum("count")).first()[0] or 0) // HOT_PARTS)
    hot = [(r["bucket"], math.ceil(math.log2(r["count"] / most)) + 3) for r in counts.where(F.col("count") > most).collect()]
    nothing = {"hot_id": F.lit(0).cast("bigint"), "part": F.lit(0).cast("bigint"), "copy": F.lit(0).cast("bigint"), "salt": F.lit(0).cast("bigint")}
    if not hot:
        return rows.withColumns(nothing)
    spark = rows.sparkSession
    rows = rows.join(F.broadcast(spark.createDataFrame(hot, "bucket bigint, bits int")), "bucket", "left")
    rows = rows.withColumns({"hot_id": F.when(F.col("bits").isNull(), 0).otherwise(F.coalesce("at", F.lit(LAST))), "part": F.when(F.col("bits").isNull(), 0).otherwise(F.expr("shiftright(h, 64 - bits)"))})
    same = rows.where("bits is not null").groupBy("hot_id", "h").count().where(F.col("count") > most).collect()
    if not same:
        return rows.withColumns({k: nothing[k] for k in ("copy", "salt")})
    copies = spark.createDataFrame([(r["hot_id"], r["h"], r["count"] // most + 1) for r in same], "hot_id bigint, h bigint, salts bigint")
    rows = rows.withColumn("number", F.monotonically_increasing_id()).join(F.broadcast(copies), ["hot_id", "h"], "left")
    one = F.col("salts").isNull()
    return rows.withColumns({"copy": F.when(one, 0).otherwise(F.col("h")), "salt": F.when(one, 0).otherwise(1 + F.pmod("number", "salts"))})


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text, sketch, next_text, next_sketch``: each row and the next one by descending key.

    Neighbours meet in places. The last row of a place takes the first row of the next place there is, found
    among the places of a group of buckets and, from one group to the next, among the groups; the very last takes the first.
    """
    whole = dict(df.select(key).dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"at": F.col("key").cast("bigint") if whole else F.col("key").cast("string").try_cast("bigint"), "h": F.xxhash64("text")})
    rows = _places(rows).select("key", "text", "at", "h", *PLACE)
    grp = F.expr(f"bucket div {GROUP}").alias("grp")
    places = rows.select(*PLACE).distinct().select(*PLACE, grp)
    down, place = [F.desc(c) for c in PLACE], F.struct(*PLACE)
    groups = places.groupBy("grp").agg(F.max(place).alias("first"))
    downward = Window.orderBy(F.desc("grp"))
    groups = groups.select("grp", F.coalesce(F.lead("first").over(downward), F.first("first").over(downward)).alias("after"))
    places = places.withColumn("following", F.lead(place).over(Window.partitionBy("grp").orderBy(*down)))
    follows = places.join(groups, "grp").select(*PLACE, F.coalesce("following", "after").alias("following"))

    # inner rows and tails need the same columns, so that one exchange serves both
    near_by = Window.partitionBy(*PLACE).orderBy(F.desc_nulls_last("at"), F.desc("h"), F.desc("key"))
    lined = rows.withColumn("sketch", sketch(F.col("text")))
    lined = lined.withColumns({"next_text": F.lead("text").over(near_by), "next_sketch": F.lead("sketch").over(near_by)})
    columns = ["key", "text", "sketch", "next_text", "next_sketch"]
    inner = lined.where("next_text is not null").select(columns)
    heads = rows.withColumn("n", F.row_number().over(near_by)).where("n = 1")  # only the first row of a place and task is moved
    heads = heads.select(place.alias("following"), F.col("text").alias("next_text"), sketch(F.col("text")).alias("next_sketch"))
    tails = lined.where("next_text is null").select("key", "text", "sketch", *PLACE).join(follows, PLACE).join(heads, "following")
    return inner.union(tails.select(columns))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, and of it with its last third replaced by the next document's beginning."""
    rows = with_next(df, key, text).withColumn("n_chars", F.length("text").cast("bigint"))
    moved = F.expr("int(n_chars div 3)")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - moved), F.left("next_text", moved))
    rows = rows.select("key", "n_chars", edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_sketch": sketch(F.col("edited"))})
    return rows.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", written_out(F.col("sketch")).alias("fingerprint"), written_out(F.col("edited_sketch")).alias("edited_fingerprint"),
        near(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), near(F.col("sketch"), F.col("next_sketch")).alias("near_next"), F.col("sketch.n").alias("n_anchors"),
    )
