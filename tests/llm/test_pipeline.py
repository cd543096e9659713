"""The pipeline against brute-force versions of its stages."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_mixture import _brute_targets
from test_ngram_join import _brute

import corpus_pipeline
from pathloom.llm import byte_bpe, langid, queries
from pathloom.llm.shared import written


@pytest.fixture(scope="module")
def docs(spark, odd, prose):
    both = odd.union(prose.selectExpr("doc_id + 10000", "text", "lang", "source"))
    return written(both.selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars"), "test-documents")


def test_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "mix", "encode"]
    stage = dict(corpus_pipeline.STAGES)
    rows = docs.collect()

    model = langid.fit(docs.where(langid.is_training_row()))
    spoken = stage["language"](spark, docs, "")
    _, _, rejected = model.judge([r.text or "" for r in rows])
    assert sorted(map(str, spoken.collect())) == sorted(str(r) for r, no in zip(rows, rejected, strict=True) if not no)
    assert {r.doc_id for r in rows} - {r.doc_id for r in spoken.collect()} >= {3, 4, 5, 6}

    spoken = written(spoken, "test-spoken")
    pairs = [(r.doc_id, r.text) for r in spoken.collect()]
    groups = Counter(re.match(r"\((\w+), (\w+), ", x).groups() for x in _brute(pairs))
    single = stage["near_copies"](spark, spoken, "")
    assert single.columns == docs.columns
    assert sorted(str(r.doc_id) for r in single.collect()) == sorted(a for a, b in groups if a == b)

    single = written(single, "test-single")
    mixed = stage["mix"](spark, single, "")
    assert mixed.columns == docs.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, times = defaultdict(int), defaultdict(int), Counter()
    for r in single.collect():
        sizes[r.source] += size(r.text)
    for r in mixed.collect():
        taken[r.source] += size(r.text)
        times[r.doc_id] += 1
    assert max(times.values()) <= 2
    most = max(size(r.text) for r in single.collect())
    for source, target in _brute_targets(sizes).items():
        assert abs(taken[source] - target) <= most

    mixed = written(mixed, "test-mixed")
    plain = byte_bpe.Codec().encoding
    want = sorted((str(r.doc_id), hashlib.sha256(np.array(plain.encode_ordinary(r.text), "<u4").tobytes()).hexdigest()) for r in mixed.collect())
    assert sorted((str(r.doc_id), r.ids_sha256) for r in stage["encode"](spark, mixed, "").collect()) == want


def test_stages_with_clashing_columns_and_repeated_ids(spark, docs):
    """Extra columns named like what the stages use pass unchanged, ids with two texts are two documents, and empty tables stay empty."""
    names = ["times", "pass", "kept_key", "rejected", "score", "lang_pred", "h", "size", "taken", "taken_row", "turn", "class", "key"]
    wide = docs.selectExpr("*", *(f"'{n}' AS {n}" for n in names))
    twice = wide.where("doc_id = 10000").selectExpr("doc_id", "concat('another text of the same id, with enough words in it to count, ', doc_id) AS text", "lang", "source", "n_chars", *names)
    wide, stage = written(wide.union(twice), "test-wide"), dict(corpus_pipeline.STAGES)
    for name in ("language", "near_copies", "mix"):
        out = written(stage[name](spark, wide, ""), "test-stage")
        assert out.columns == wide.columns and out.count() > 0, name
        assert all(r[n] == n for r in out.collect() for n in names), name
        if name != "mix":
            assert out.where("doc_id = 10000").select("text").distinct().count() == out.where("doc_id = 10000").count()
        wide = out
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(stage["encode"](spark, wide, "").columns)
    empty = docs.where("false")
    for name, fn in corpus_pipeline.STAGES:
        assert fn(spark, empty, "").count() == 0, name


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_return_every_row(name, spark):
    source = "pages" if "main_text" in name else "documents"
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    key = "page_id" if source == "pages" else "doc_id"
    want = sorted(r[0] for r in spark.read.parquet(f"/root/testdata/sf0.001/{source}.parquet").select(key).collect())
    assert sorted(r[0] for r in rows.select(key).collect()) == want
