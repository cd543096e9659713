"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its character n-grams within words (with the spaces around them),
hashed into a fixed number of rows. After training, embedding times output weights is one table of class
scores a row, so a prediction is a mean of table rows. A temperature fitted on rows kept aside calibrates the
probabilities; a text is rejected when it has no letter, when the best language is less likely right than
``reject_below`` and fewer of its n-grams are known than of nearly all rows kept aside, or when far fewer are known than of any
of these, however sure the model is.

Defined cases: null, empty or letterless text is ``und`` with score 0 and rejected; long texts are read
whole, in training too; ties go to the first language by name; with no labelled row every text is ``und``; rows that repeat a
text are learned once and predicted each; an empty table gives no rows; extra columns pass, those named like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.shared import map_text

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
DIMENSION = 16
EPOCHS = 6
RATE = 0.5
#: The training sample: so many distinct labelled texts at most, the same number of each language as far as it has them, of
#: each those of the least hashes. Of labels, the most frequent ones, no more than rows of the sample.
SAMPLE_ROWS = 4000
CALIBRATION_SHARE = 0.2
REJECT_BELOW = 0.5
#: A text is foreign if the share of its n-grams that training has not seen is so many times that of the rows kept aside (at
#: their hundredth), beyond what chance gives a text of few n-grams.
FOREIGN_TIMES, FOREIGN_LEAST = 6.0, 0.1
SEED = 7
UNKNOWN = "und"
#: Characters that a prediction holds at a time.
GROUP_CHARS = 500_000
#: Characters that an n-gram reaches beyond its first.
REACH = max(ORDERS) - 1


def subwords(texts: list[str], buckets: int = BUCKETS, own: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of all n-grams of the texts (each with a space before and after it), and the text of each row. Of a text
    with ``own``, which is part of a longer one, n-grams that start past its own characters are left to the next part."""
    if own is None:
        texts = [f" {t.lower()} " for t in texts]
        own = [len(t) for t in texts]
    codes = np.frombuffer("".join(texts).replace("\x00", " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters(codes)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    codes = np.where(letters, codes, 32).astype(np.uint64)
    bounds = np.cumsum(lengths)
    # parts of longer texts: what starts in the characters that the next part has too isn't theirs, nor what crosses their end
    parts = [(int(b - n + o), int(b)) for b, n, o in zip(bounds, lengths, own, strict=True) if o < n]
    rows, owners = [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        # the inner characters are letters, the first and last may be the spaces around a word
        inside = np.ones(m, bool)
        for begin, end in parts:
            inside[begin:end] = False
        for k in range(1, n - 1):
            inside &= letters[k : k + m]
        inside &= letters[:m] | letters[n - 1 :]
        at = np.flatnonzero(inside)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        rows.append((h >> np.uint64(20)) & np.uint64(buckets - 1))
        owners.append(owner[at])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows).astype(np.int64), np.concatenate(owners)


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters, by Unicode."""
    if not len(codes):
        return np.zeros(0, bool)
    top = int(codes.max()) + 1
    if top <= 0x3000:
        if "low" not in _tables:
            _tables["low"] = np.array([chr(c).isalpha() for c in range(0x3000)])
        return _tables["low"][codes]
    values, inverse = np.unique(codes, return_inverse=True)
    return np.array([chr(c).isalpha() for c in values.tolist()])[inverse]


_tables: dict[str, np.ndarray] = {}


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _groups(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str], list[int]]]:
    """(places, texts, own characters of each) in groups of about GROUP_CHARS. A longer text is cut anywhere, and its parts
    have the REACH characters that follow them too, so each of its n-grams is in one part."""
    group: list[tuple[int, str, int]] = []
    held = 0

    def made() -> tuple[np.ndarray, list[str], list[int]]:
        return np.array([k for k, _, _ in group]), [t for _, t, _ in group], [n for _, _, n in group]

    for k, t in enumerate(texts):
        padded = f" {t.lower()} "
        for at in range(0, len(padded), GROUP_CHARS):
            piece, own = padded[at : at + GROUP_CHARS + REACH], min(GROUP_CHARS, len(padded) - at)
            if group and held + own > GROUP_CHARS:
                yield made()
                group, held = [], 0
            group.append((k, piece, own))
            held += own
    if group:
        yield made()


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a whole text's n-grams, ascending, and how often it has each; at most BUCKETS, however long it is."""
    counts = np.zeros(BUCKETS, np.int64)
    for _, parts, own in _groups([text]):
        counts += np.bincount(subwords(parts, BUCKETS, own)[0], minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # rows x languages, float32
    bias: np.ndarray
    temperature: float
    seen: np.ndarray  # rows that training texts have
    usual: float = 0.0  # share of its rows seen that all but a hundredth of the rows kept aside reach

    def foreign(self, known: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Texts of which far more is unknown than of what was kept aside, by more than three deviations of chance."""
        unusual = max(FOREIGN_LEAST, FOREIGN_TIMES * (1 - self.usual))
        return (1 - known) > unusual + 3 * np.sqrt(unusual / np.maximum(n, 1))

    def logits(self, texts: list[str]) -> np.ndarray:
        return self._read(texts)[0]

    def _read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the languages, the share of each text's rows that training has seen, and the number of its rows."""
        sums, n, known = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts))
        for at, parts, own in _groups(texts):
            rows, owners = subwords(parts, BUCKETS, own)
            np.add.at(n, at, np.bincount(owners, minlength=len(parts)))
            np.add.at(known, at, np.bincount(owners, self.seen[rows], len(parts)))
            for c in range(len(self.languages)):
                np.add.at(sums[:, c], at, np.bincount(owners, self.table[:, c][rows], len(parts)))
        return self._scored(sums, known, n)

    def _counted(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of texts whose n-grams are counted."""
        sums = np.array([c @ self.table[r] if len(r) else np.zeros(len(self.languages)) for r, c in rows])
        return self._scored(sums, np.array([c @ self.seen[r] for r, c in rows], float), np.array([c.sum() for _, c in rows], float))

    def _scored(self, sums: np.ndarray, known: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return sums / np.maximum(n, 1)[:, None] + self.bias, known / np.maximum(n, 1), n

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return _softmax(self.logits(texts) / self.temperature)

    def judge(self, texts: list[str], reject_below: float = REJECT_BELOW) -> tuple[list[str], list[float], list[bool]]:
        """Language, probability, and whether a text is rejected: it has no letter, no language is likely enough
        and too few of its n-grams are known, or it is foreign. A text that mixes learned languages is unsure but known, and stays."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        logits, known, n = self._read(texts)
        p, foreign = _softmax(logits / self.temperature), self.foreign(known, n).tolist()
        best = p.argmax(1)
        lettered = [has_letter(t) for t in texts]
        score = [float(p[k, b]) if x else 0.0 for k, (b, x) in enumerate(zip(best, lettered, strict=True))]
        pred = [self.languages[b] if x else UNKNOWN for b, x in zip(best, lettered, strict=True)]
        return pred, score, [not x or f or (y < reject_below and z < self.usual) for x, y, z, f in zip(lettered, score, known.tolist(), foreign, strict=True)]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[str, str]]) -> Model:
    """A model of (text, language) rows; the same rows in the same order give the same model."""
    return train_counted([(*counted(t), lang) for t, lang in rows])


def train_counted(rows: list[tuple[np.ndarray, np.ndarray, str]]) -> Model:
    """The same of rows of n-grams, counts and language."""
    languages = sorted({lang for _, _, lang in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, np.zeros(BUCKETS, bool))
    rng = np.random.default_rng(SEED)
    y = np.array([languages.index(lang) for _, _, lang in rows])
    aside = rng.random(len(rows)) < CALIBRATION_SHARE if len(rows) >= 50 else np.zeros(len(rows), bool)
    embed = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION))
    seen = np.zeros(BUCKETS, bool)
    out, bias = np.zeros((DIMENSION, len(languages))), np.zeros(len(languages))
    fit = [k for k in np.flatnonzero(~aside) if len(rows[k][0])]
    for k in fit:
        seen[rows[k][0]] = True
    total, step = EPOCHS * max(1, len(fit)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(fit):
            rate = RATE * (1 - step / total)
            step += 1
            at, counts, _ = rows[k]
            weights = counts / counts.sum()
            hidden = weights @ embed[at]
            p = _softmax((hidden @ out + bias)[None])[0]
            p[y[k]] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * p * 0.1
            embed[at] -= rate * len(at) ** 0.5 * weights[:, None] * back
    embed[~seen] = 0  # n-grams that no labelled text has say nothing
    model = Model(languages, (embed @ out).astype(np.float32), bias, 1.0, seen, 0.5)
    if aside.any():
        kept = np.flatnonzero(aside)
        logits, known, _ = model._counted([rows[k][:2] for k in kept])
        model.usual = float(np.quantile(known, 0.01))
        model.temperature = min((1.25**k for k in range(16)), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(kept)), y[kept]] + 1e-12).mean())
    return model


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trains on a bounded sample of labelled rows, ``sample_rows`` distinct whole texts at most.

    Each language has the same share of the sample, and what one leaves goes to the others; of a language the texts of least
    hashes count. Tasks pass on only texts whose hash is likely among these, and send their counted n-grams to the driver.
    """
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(text), F.lit(SEED)).alias("h"))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows).collect()
    quota, left = {}, sample_rows
    for k, r in enumerate(reversed(sizes)):  # the small ones first
        quota[r["lang"]] = max(1, min(left // (len(sizes) - k), math.ceil(1.5 * r["n"])))
        left -= min(quota[r["lang"]], r["n"])
    spark = df.sparkSession
    # of each language the hashes (of a million steps) below which its share of the sample is, with room for chance
    steps = [(r["lang"], quota[r["lang"]], math.ceil(min(1.0, (2 * quota[r["lang"]] + 20) / r["n"]) * (1 << 20))) for r in sizes]
    shares = spark.createDataFrame(steps, "lang string, quota int, most bigint")
    likely = labelled.join(F.broadcast(shares), "lang").where(F.shiftrightunsigned("h", 44) < F.col("most"))  # sample_rows rows at most
    likely = likely.dropDuplicates(["lang", "h"])
    ranked = likely.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where("rank <= quota")

    def fn(texts: list[str]) -> list[list]:
        found = [counted(t) for t in texts]
        return [[at.astype("<u4").tobytes() for at, _ in found], [np.minimum(c, (1 << 32) - 1).astype("<u4").tobytes() for _, c in found]]

    made = map_text(ranked.select("text", "lang", "h"), "text", {"at": "binary", "counts": "binary"}, fn, drop=("text",))
    rows = sorted(made.collect(), key=lambda r: (r["h"], r["lang"]))  # sample_rows rows of BUCKETS numbers at most
    return train_counted([(np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.int64), r["lang"]) for r in rows])


def predict(df: DataFrame, model: Model, text: str = "text", reject_below: float = REJECT_BELOW, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``lang_pred, score, rejected``; the columns in ``drop`` don't come back."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages floats: a fixed size

    def fn(texts: list[str]) -> list[list]:
        return list(shared.value.judge(texts, reject_below))

    return map_text(df, text, {"lang_pred": "string", "score": "double", "rejected": "boolean"}, fn, drop)


def is_training_row(key: str = "doc_id"):
    """Rows that may be learned from: crc32 of the key as text, modulo 4, isn't 2."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 != 2
