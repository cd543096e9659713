"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the schedule gets point frac(k times the golden ratio); the cumulative weights of the sources map it
to a source. The slots of a source are ranked. A source's documents, shuffled by a hash, lie end to end on a line of
words that is cut into blocks of equal size; slot of rank r takes block r, and past the end starts the next pass.
A source whose size or target is small has smaller blocks and as many more slots, so that every source ends within
a few thousandths, or a few words, of its target.

Nothing is ordered or ranked in one task: ranks and places come from counts of small chunks plus ranks within
the chunk, and points meet sources by an equi-join on cells of the unit interval.

Defined cases: a null text has size 0; texts of any length are counted whole, and the mix may take part of one; documents of size 0
are never taken; a null source is a source, the last; rows that repeat a key are documents of their own; of equal hashes the
least key, then the smaller document, comes first; an empty table gives no rows; columns but the key, the text and the source
are left out, so none can clash.

What is ordered over all sources (their caps, spans and numbers) is one row a source, in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.extendible import key_hash
from pathloom.llm.shared import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: No document is taken more often.
PASSES = 2
#: The golden ratio in 30 bits: multiples of this odd number run through all points before one repeats.
GOLDEN, POINTS = 663608941, 1 << 30
CELLS = 1024
CHUNK_BITS = 12
#: A block has as many words as give about so many slots, but no more than MOST_WORDS.
SLOTS, MOST_WORDS = 1 << 18, 4096
#: Blocks that the size and the target of a source have at least, or else its blocks are single words.
LEAST_BLOCKS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """``source, id, source_size, target`` of ``source, source_size``.

    Sources by code point, null last, weigh ``weights`` in turn. Filling by weight up to the caps: the level is that
    of the first source, by cap per weight, at which the rest of the total needs no more than its cap.
    """
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "id")
    ranked = sources.withColumn("id", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("id") % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(passes))).withColumn("ratio", F.col("cap") / F.col("weight"))
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "id", "level"))).over(all_rows)["level"]
    return levels.select("source", "id", "source_size", F.least(F.col("cap"), F.coalesce(found, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def units(sources: DataFrame, block: int) -> DataFrame:
    """``sources`` with ``unit``, the words of a source's blocks, and ``need``, its slots times ``block``."""
    own = F.floor(F.least(F.col("source_size").cast("double"), F.col("target")) / LEAST_BLOCKS)
    return sources.withColumn("unit", F.greatest(F.lit(1), F.least(F.lit(block), own)).cast("bigint")).withColumn("need", F.col("target") * (F.lit(float(block)) / F.col("unit")))


def schedule(sources: DataFrame, slots: int, spark, cells: int = CELLS) -> DataFrame:
    """``slot, id, rank`` of a low-discrepancy schedule; ``sources`` has ``id, target``."""
    whole = F.sum("target").over(Window.partitionBy())
    upto = F.sum("target").over(Window.orderBy("id"))
    spans = sources.where("target > 0").select("id", ((upto - F.col("target")) / whole).alias("low"), (upto / whole).alias("high"))
    spans = spans.withColumn("high", F.when(F.col("id") == F.max("id").over(Window.partitionBy()), F.lit(2.0)).otherwise(F.col("high")))
    spans = spans.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("id")), F.lit(0.0)))
    last = F.lit(cells - 1)
    parts = spans.withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("low") * cells), last), F.least(F.floor(F.col("high") * cells), last))))
    point = (F.col("slot") % POINTS * GOLDEN % POINTS) / F.lit(float(POINTS))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * cells))
    placed = points.join(parts, (points.cell == parts.cell) & (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    placed = placed.select("slot", "id", F.shiftright("slot", CHUNK_BITS).alias("chunk"))
    before = placed.groupBy("id", "chunk").agg(F.count("*").alias("n"))
    before = before.select("id", "chunk", (F.sum("n").over(Window.partitionBy("id").orderBy("chunk")) - F.col("n")).alias("before"))
    within = placed.withColumn("within", F.row_number().over(Window.partitionBy("id", "chunk").orderBy("slot")) - 1)
    return within.join(before, ["id", "chunk"]).select("slot", "id", (F.col("before") + F.col("within")).alias("rank"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``key, source, size, source_size, target, taken`` for every row."""
    spark = df.sparkSession
    sized = written(df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), words(text).alias("size")), "mix-sizes")
    sources = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share), "mix-sources")
    rows, total = sized.count(), sources.agg(F.sum("target")).first()[0] or 0.0
    block = max(1, min(MOST_WORDS, int(round(total, 3) // SLOTS)))
    sources = units(sources, block)
    need, n_sources = sources.agg(F.sum("need"), F.count("*")).first()
    slots = math.ceil(round(need or 0.0, 3) / block)

    blocks = F.greatest(F.ceil(F.col("source_size") / F.col("unit")), F.lit(1))
    needs = sources.select("id", F.col("need").alias("target"))
    taken = schedule(needs, slots, spark, max(CELLS, n_sources)).join(sources.select("id", blocks.alias("blocks")), "id")
    taken = taken.where(F.col("rank") < PASSES * F.col("blocks")).groupBy("id", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("passes"))

    buckets = math.isqrt(rows) + 1
    named = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    named = named.select("key", "d.source", "size", "id", "source_size", "target", "unit", key_hash("key").alias("h"))
    named = named.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    at = Window.partitionBy("id", "bucket").orderBy("h", "key", "size")
    bases = named.groupBy("id", "bucket").agg(F.sum("size").alias("n"))
    bases = bases.select("id", "bucket", (F.sum("n").over(Window.partitionBy("id").orderBy("bucket")) - F.col("n")).alias("base"))
    lined = named.withColumn("place", F.row_number().over(at)).withColumn("end", F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    lined = lined.join(bases, ["id", "bucket"]).withColumn("end", F.col("base") + F.col("end")).withColumn("start", F.col("end") - F.col("size"))
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / F.col("unit")), F.floor((F.col("end") - 1) / F.col("unit"))))
    pieces = lined.select("*", F.explode_outer(spans).alias("block"))
    inside = F.least(F.col("end"), (F.col("block") + 1) * F.col("unit")) - F.greatest(F.col("start"), F.col("block") * F.col("unit"))
    met = pieces.withColumn("inside", inside).join(taken, ["id", "block"], "left")
    whole = met.groupBy("id", "bucket", "place").agg(
        *(F.first(c).alias(c) for c in ("key", "source", "size", "source_size", "target")), F.sum(F.coalesce(F.col("inside") * F.col("passes"), F.lit(0))).alias("taken")
    )
    return whole.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"))
