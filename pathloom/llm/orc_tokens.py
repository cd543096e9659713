"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Each file holds a range of document ids in ascending order, with the place of each document's first id
within the file. Readers take stripes in parallel; min/max row indexes and Bloom filters skip stripes and
row groups when documents are looked up.

Defined cases: a null or empty text has only the end id; null ids come first; ids may be of any type that sorts; rows of one id stand in the
order of their texts; long texts are encoded whole; an empty table gives no rows; columns but the id and the text are left
out, so none can clash. The string of a special token in a text becomes its id, as the library's plain call has it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathloom.llm.shared import new_path, steps, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
#: Bytes of text that are encoded at a time.
STEP_BYTES = 6 << 20
BLOOM_FPP = 0.01
#: Words whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 700_000
#: Characters whose class (letter, digit, space, other) any two Unicode tables agree on. A text of these only
#: is split here as the vocabulary's own pre-splitter does; any other goes to the library whole.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(r"[\t\n\r -~¡-±´-¸º»¿-ɏ]*")
WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
_tokenizers: dict[str, Encoder] = {}


class Encoder:
    """The tokenizers library's model with a bounded memory of words already encoded."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # words come here once
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        self.byte_names = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # a word's number
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)  # of the words, in their order

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the number of each text's."""
        words: list[str] = []
        owner_words = np.zeros(len(texts), np.int64)
        whole: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            if PLAIN.fullmatch(t) and not any(a in t for a in self.added):
                found = WORDS.findall(t)
                owner_words[k] = len(found)
                words += found
            else:
                whole[k] = self.tokenizer.encode(t, add_special_tokens=False).ids
        coded = pa.array(words, pa.string()).dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        flat, sizes = self.ids, self.sizes
        firsts, counts = (np.cumsum(sizes) - sizes)[number], sizes[number]
        ends = np.cumsum(counts)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - (ends - counts), counts)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(owner_words)])]
        lengths = np.diff(bounds)
        if whole:
            parts = [np.array(whole[k], np.int32) if k in whole else ids[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
            return np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, lengths

    def _numbers(self, unique: list[str]) -> np.ndarray:
        """The numbers of the words; those not yet known are encoded."""
        if len(self.known) + len(unique) > REMEMBERED and self.known:
            self._forget()
        found, n = list(map(self.known.get, unique)), len(self.known)
        places = [k for k, x in enumerate(found) if x is None]
        new = [unique[k] for k in places]
        tokenize, names = self.model.tokenize, self.byte_names
        ids, sizes = [], []  # flat: a list kept for each word would keep the garbage collector busy
        for w in new:
            found_ids = tokenize(w.encode().decode("latin-1").translate(names))
            sizes.append(len(found_ids))
            ids += [x.id for x in found_ids]
        self.known.update(zip(new, range(n, n + len(new)), strict=True))
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64)])
        self.ids = np.concatenate([self.ids, np.array(ids, np.int32)])
        for k, number in zip(places, range(n, n + len(new)), strict=True):
            found[k] = number
        return np.array(found, np.int64)


def encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of this worker, loaded once."""
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def write(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Writes ``key, ids, before`` to ORC files, ascending by key; ``before`` counts the file's earlier ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, enc = 0, encoder(vocabulary)
        for piece, texts in steps(batches, text, STEP_BYTES):
            ids, lengths = enc.encode_many(texts)
            ends = np.cumsum(lengths + 1)
            flat = pa.array(np.insert(ids, np.cumsum(lengths), end_id).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat)
            ends += before
            starts = pa.array(np.concatenate([[before], ends[:-1]]), pa.int64())
            before = int(ends[-1])
            yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index(key)), lists, starts], ["key", "ids", "before"])

    kind = dict(df.select(key).dtypes)[key]
    ranged = df.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    key, text = "key", "text"
    (
        ranged.mapInArrow(run, f"key {kind}, ids array<int>, before bigint")
        .write.option("maxRecordsPerFile", 0)  # ``before`` counts from the start of a partition, so each is one file
        .option("compression", "zstd").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.create.index", "true").option("orc.bloom.filter.columns", "key").option("orc.bloom.filter.fpp", BLOOM_FPP)
        .orc(path)
    )


def read(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """The rows of written files, and the file of each; ``kind`` is the type of the ids."""
    return spark.read.schema(f"key {kind}, ids array<int>, before bigint").orc(path).withColumn("file", F.col("_metadata.file_name"))


def lookup(spark: SparkSession, path: str, keys: list, kind: str = "bigint") -> DataFrame:
    """The ids of some documents; stripes and row groups without them are skipped by their metadata."""
    return read(spark, path, kind).where(F.col("key").isin(list(keys))).select("key", "ids")


def summed(df: DataFrame) -> DataFrame:
    """Replaces ``ids`` by their number and the unsigned crc32 of them as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            data = lists.flatten().to_numpy().astype("<u4").tobytes()
            sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
            ends = np.cumsum(sizes) * 4
            crcs = [zlib.crc32(data[b - 4 * n : b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("file"), batch.column("before"), pa.array(sizes), pa.array(crcs, pa.int64())], ["key", "file", "before", "n_tokens", "ids_crc32"])

    kind = dict(df.select("key").dtypes)["key"]
    return df.select("key", "file", "before", "ids").mapInArrow(run, f"key {kind}, file string, before bigint, n_tokens bigint, ids_crc32 bigint")


def catalogue(spark: SparkSession, path: str, kind: str = "bigint", key: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of written files; start counts the ids of all documents before.

    Starts are a document's place in its file plus the ids in earlier files: a running sum, in one task, over one row a
    file, of which there are as many as partitions.
    """
    rows = written(summed(read(spark, path, kind)), "orc-catalogue")
    files = rows.groupBy("file").agg(F.min("key").alias("least"), F.sum("n_tokens").alias("n"))
    files = files.select("file", (F.sum("n").over(Window.orderBy(F.col("least").asc_nulls_first(), "file")) - F.col("n")).alias("offset"))
    return rows.join(files, "file").select(F.col("key").alias(key), (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encode_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the table's ids to the shared folder and returns the catalogue read back from the files."""
    spark = df.sparkSession
    path = new_path(spark, "orc-tokens")
    write(df, path, key, text)
    return catalogue(spark, path, dict(df.select(key).dtypes)[key], key)
