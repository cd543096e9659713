"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Texts of one set are one class, so copies are never paired. Classes that
share a band of MinHash values are candidates. Candidates are compared incrementally, some MinHash values at a
time, and dropped once the posterior probability (uniform prior) that their similarity reaches the threshold
falls below the tolerance; the rest is verified exactly on the shingle sets.

A bucket of candidates is cut into tiles of two blocks each, of a bounded number of members and shingles. First a task compares
the signatures of a tile and tells which members have a candidate left; then the shingle sets of these alone meet in the tile
and give a row per class: its number of links there and the least class that the tile's links reach from it. So no pairs are
written, whatever the size of a group, yet every pair is compared, in the first band that it shares. Buckets with
the same members count once, for the first of their bands. Groups are the connected components of the links.

Defined cases: null, empty and white texts have no shingles, are never linked and are groups of their own; a text of
fewer than five words is one shingle, so only equal ones link; words are runs of visible characters in lower
case; texts of any length are read whole; rows that repeat an id are documents of their own with one group, and of rows
that a group keeps alike (same id, same text) the one of the least hash stays; an empty table gives no rows; extra columns
may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.shared import dropped, fresh, map_text, written

WORDS, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 shares no band with probability 3e-5, one of 0.85 with 2e-7.
BANDS, BAND_ROWS = 26, 5
HASHES = BANDS * BAND_ROWS
#: MinHash values to a step of the comparison, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 26, 1e-7
#: Members of a block, and their shingles, on average; a tile has two. Pairs of a tile that are compared at a time.
BLOCK, BLOCK_SHINGLES, PAIRS = 1024, 1 << 20, 1 << 17
#: Shingles that are hashed at a time.
SHINGLES = 4096

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADDENDS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh64_intdigest(" ".join(tokens), seed=len(tokens))], np.uint64)
    hashes: dict[str, int] = {}
    h = np.array([hashes[t] if t in hashes else hashes.setdefault(t, xxhash.xxh64_intdigest(t)) for t in tokens], np.uint64)
    m = len(h) - words + 1
    out = np.zeros(m, np.uint64)
    for k in range(words):
        out = (out ^ h[k : k + m]) * _MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def minhash(found: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of shingles."""
    best = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(found), SHINGLES):
        part = (found[None, at : at + SHINGLES] * _FACTORS[:, None] + _ADDENDS[:, None]) >> _SHIFT
        best = np.minimum(best, part.min(1).astype(np.uint32))
    return best


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[tuple[int, int], ...]:
    """(n, m) by steps: of n compared values at least m must match, or the posterior that the similarity reaches
    the threshold is below the tolerance. With a uniform prior it is Beta(m + 1, n - m + 1): its upper tail at t
    is the probability of at most m successes among n + 1 of probability t."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append((n, m))
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of signatures (row by row) pass every step."""
    left, matches, before = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in least_matches(threshold):
        matches = matches + (a[left, before:n] == b[left, before:n]).sum(1)
        keep = matches >= m
        left, matches, before = left[keep], matches[keep], n
    return left


def linked_pairs(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (places in ``sets``) whose sets have at least the similarity ``threshold``, exactly."""
    if len(first) <= 64:
        good = [k for k, (i, j) in enumerate(zip(first.tolist(), second.tolist(), strict=True)) if _alike(sets[i], sets[j], threshold)]
        return first[good], second[good]
    # many pairs: common elements by products of 0/1 matrices over slices of the elements
    used = np.unique(np.concatenate([first, second]))
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    elements, where = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
    sizes = np.array([len(sets[k]) for k in used])
    owner = np.repeat(np.arange(len(used)), sizes)
    common = np.zeros((len(used), len(used)), np.float32)
    shared = np.bincount(where, minlength=len(elements)) > 1
    column = np.cumsum(shared) - 1
    owner, where = owner[shared[where]], column[where[shared[where]]]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    for at in range(0, int(shared.sum()), SHINGLES):
        low, high = np.searchsorted(where, [at, at + SHINGLES])
        slab = np.zeros((len(used), SHINGLES), np.float32)
        slab[owner[low:high], where[low:high] - at] = 1
        common += slab @ slab.T
    i, j = place[first], place[second]
    both = common[i, j].astype(np.int64)
    good = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
    return first[good], second[good]


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


def candidates(signatures: np.ndarray, blocks: np.ndarray, same: bool, band: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a tile's members (places) that pass every step. Within one block all pairs count, else those across; a
    pair that shares an earlier band than ``band`` is left to it."""
    left, right = (np.arange(len(signatures)),) * 2 if same else (np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks != blocks.min()))
    early = signatures.reshape(len(signatures), BANDS, BAND_ROWS)[:, :band]
    out = []
    rows = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), rows):
        first, second = np.repeat(left[at : at + rows], len(right)), np.tile(right, len(left[at : at + rows]))
        if same:
            first, second = first[first < second], second[first < second]
        kept = survivors(signatures[first], signatures[second], threshold)
        first, second = first[kept], second[kept]
        if band and len(first):
            own = ~(early[first] == early[second]).all(2).any(1)
            first, second = first[own], second[own]
        out.append((first, second))
    return np.concatenate([f for f, _ in out]), np.concatenate([x for _, x in out])


def _roots(n: int, first: np.ndarray, second: np.ndarray) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(first.tolist(), second.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _name(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``key, h, class, size, signature`` for each row: a hash of its text, a digest of its set of shingles (null: no shingles),
    their number and its MinHash values."""

    def fn(texts: list[str]) -> list[list]:
        out: list[list] = [[], [], []]
        for t in texts:
            found = shingles(t, words)
            for target, value in zip(out, (_name(found), len(found), minhash(found).tobytes() if len(found) else None), strict=True):
                target.append(value)
        return out

    rows = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return map_text(rows, "text", {"class": "binary", "size": "int", "signature": "binary"}, fn, drop=("text",))


def buckets(members: DataFrame) -> DataFrame:
    """``class, band, value, low, high, block``: members of the buckets of candidates, once for each tile that they are in."""
    hashes = F.array(*(F.xxhash64(F.lit(k), F.substring("signature", 4 * BAND_ROWS * k + 1, 4 * BAND_ROWS)) for k in range(BANDS)))
    banded = members.select("class", "size", F.posexplode(hashes).alias("band", "value"))
    h = F.xxhash64("class")
    found = banded.groupBy("band", "value").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s"), F.sum("size").alias("size")).where("n > 1")
    # buckets with the same members: the first band compares them
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.ceil(F.col("size") / BLOCK_SHINGLES), "n")).cast("int").alias("blocks")
    firsts = found.groupBy("n", "x", "s", "size").agg(F.min(F.struct("band", "value")).alias("b")).select("b.band", "b.value", blocks)
    placed = banded.join(firsts, ["band", "value"]).withColumn("block", F.pmod(F.xxhash64("class", "band"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("class", "band", "value", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block")


TILE = ("band", "value", "low", "high")


def _by_tile(df: DataFrame, columns: tuple[str, ...], work, schema: str) -> DataFrame:
    """What ``work`` makes of each tile: of its key and the lists of its columns, sorted by class."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*TILE, "class", "block", *columns)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, found in groupby(rows(batches), key=lambda r: r[:4]):
            members = list(found)
            blocks = np.array([r[5] for r in members])
            if len(members) < 2 or (at[2] != at[3] and blocks.min() == blocks.max()):
                continue
            if made := work(at, [r[4] for r in members], blocks, *([r[6 + k] for r in members] for k in range(len(columns)))):
                yield made

    return df.repartition(*TILE).sortWithinPartitions(*TILE, "class").select(*TILE, "class", "block", *columns).mapInArrow(run, schema)


def _signatures(column: list) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), HASHES)


def pruned(placed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``placed`` (buckets with ``signature`` as bytes) whose class has a candidate left in the tile, without the signature."""

    def work(at: tuple, names: list, blocks: np.ndarray, signatures: list) -> pa.RecordBatch | None:
        first, second = candidates(_signatures(signatures), blocks, at[2] == at[3], at[0], threshold)
        left = np.union1d(first, second).tolist()
        if not left:
            return None
        columns = [pa.array([at[k]] * len(left), kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in left], pa.binary()), *columns, pa.array(blocks[left], pa.int32())], ["class", *TILE, "block"])

    return _by_tile(placed, ("signature",), work, "class binary, band int, value bigint, low int, high int, block int")


def links(tiled: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``class, root, links`` of each tile's linked classes (rows with ``signature, weight, shingles``): the least class that the
    tile's links reach from it, and the number of documents in the classes linked to it there."""

    def work(at: tuple, names: list, blocks: np.ndarray, signatures: list, weights: list, found: list) -> pa.RecordBatch | None:
        first, second = candidates(_signatures(signatures), blocks, at[2] == at[3], at[0], threshold)
        first, second = linked_pairs([np.frombuffer(x, "<u8") for x in found], first, second, threshold)
        if not len(first):
            return None
        weight = np.array(weights)
        total = np.bincount(first, weight[second], len(names)) + np.bincount(second, weight[first], len(names))
        roots, linked = _roots(len(names), first, second), np.flatnonzero(total).tolist()
        columns = [pa.array([names[k] for k in linked], pa.binary()), pa.array([names[roots[k]] for k in linked], pa.binary()), pa.array(total[linked].astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["class", "root", "links"])

    return _by_tile(tiled, ("signature", "weight", "shingles"), work, "class binary, root binary, links bigint")


def _linked(df: DataFrame, members: DataFrame, key: str, text: str, threshold: float, words: int) -> DataFrame:
    """The links of all tiles: candidates by signatures, then exactly by the shingles of those that are left."""
    left = written(pruned(buckets(members).join(members.select("class", "signature"), "class"), threshold), "join-candidates")
    wanted = left.select("class").distinct().join(members.select("class", F.col("key").alias("least"), F.col("h").alias("least_h")), "class")
    # a class's shingles: of the text of its least id
    texts = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    texts = texts.join(wanted, F.col("key").eqNullSafe(F.col("least")) & (F.col("h") == F.col("least_h"))).select("class", "text")
    sets = map_text(texts, "text", {"shingles": "binary"}, lambda ts: [[shingles(t, words).astype("<u8").tobytes() for t in ts]], drop=("text",)).dropDuplicates(["class"])
    tiled = left.join(members.select("class", "weight", "signature"), "class").join(sets, "class")
    return links(tiled, threshold)


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of the nodes of ``a, b`` rows: the least node of each one's connected component.

    Labels fall to the least among neighbours and then to their label's label, until none changes. A round's labels are
    a written table; the one before it is removed.
    """
    both = written(edges.union(edges.select("b", "a")).distinct(), "join-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "join-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        fallen = written(lower.join(up, "label").select("node", "was", F.least("label", "up").alias("label")), "join-labels")
        dropped(labels)
        labels = fallen.select("node", "label")
        if fallen.where("label <> was").isEmpty():
            dropped(both)
            return labels


def _groups(df: DataFrame, key: str, text: str, threshold: float, words: int) -> tuple[DataFrame, DataFrame]:
    """(``key, h, class`` of each row, ``class, label, least, links`` of each class with shingles); ``least`` is the key and hash of the
    group's first row."""
    known = written(classes(df, key, text, words), "join-known")
    first = F.min(F.struct(F.col("key").isNull(), "key", "h"))  # null ids last
    members = known.where("class is not null").groupBy("class").agg(first.alias("first"), F.count("*").alias("weight"), F.first("size").alias("size"), F.first("signature").alias("signature"))
    members = written(members.select("class", "first", "first.key", "first.h", "weight", "size", "signature"), "join-classes")
    linked = written(_linked(df, members, key, text, threshold, words), "join-links")
    labels = components(linked.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("class").agg(F.sum("links").alias("links"))
    named = members.select("class", "first", "weight").join(labels.withColumnRenamed("node", "class"), "class", "left").join(counts, "class", "left")
    named = named.select("class", "first", F.coalesce("label", "class").alias("label"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    named = written(named, "join-groups")
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    return known.select("key", "h", "class"), named.join(least, "label").select("class", "label", "least", "links")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """``key, class_id, links`` for each row: the least key of its group, and the number of other documents of at
    least the similarity ``threshold`` (equal ones included)."""
    known, named = _groups(df, key, text, threshold, words)
    met = known.where("class is not null").join(named, "class").select("key", F.col("least.key").alias("class_id"), "links")
    alone = known.where("class is null").select("key", F.col("key").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    return met.union(alone).select(F.col("key").alias(key), "class_id", "links")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` without near copies: of each group one row stays, one of the least key (of its texts that of the least hash,
    of rows that repeat both that of the least hash of all columns); rows without shingles stay."""
    known, named = _groups(df, key, text, threshold, WORDS)
    leasts = named.select(F.col("least.key").alias("key"), F.col("least.h").alias("h")).distinct()
    same = known.groupBy("key", "h").agg(F.count("*").alias("n"), F.bool_or(F.col("class").isNull()).alias("bare"))
    kept = leasts.join(same.where("not bare"), leasts.key.eqNullSafe(same.key) & (leasts.h == same.h), "inner").select(leasts.key, leasts.h, "n")
    kept = kept.union(same.where("bare").select("key", "h", F.lit(1).cast("bigint")))
    at, hashed, n = (fresh(df, name) for name in ("kept_key", "kept_hash", "kept_n"))
    kept = written(kept.toDF(at, hashed, n), "join-kept")
    met = df.join(kept, F.col(key).eqNullSafe(F.col(at)) & (F.xxhash64(F.col(text)) == F.col(hashed)))
    out = met.where(F.col(n) == 1).select(df.columns)
    if kept.where(F.col(n) > 1).isEmpty():
        return out
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    again = met.where(F.col(n) > 1).groupBy(at, hashed).agg(F.min_by(row, F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in df.columns))).alias("row"))
    return out.union(again.select("row.*"))
