"""Every operator and stage on empty tables, nulls in any column, empty and long texts, repeated rows and clashing column names."""

import functools

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from topicloom.llm import annscan, backoff, bpe, hostrules, jaccard, langid, mixing, phrases, queries, rulefit, runs, secrets, urlmarkov, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["cid", "size", "score", "words", "doc", "row_id", "chunk", "train", "list", "found", "component", "host", "copies", "of", "rest"]
LONG = " ".join(f"word{i % 977} lot{i % 31}." for i in range(40_000))
ROWS = [
    (1, "A first text of some length, with words enough for all rules to hold.", "en", "a", 70), (2, None, None, None, None), (None, "no id here but words", "en", "a", 20),
    (3, "", "en", "b", 0), (4, " \n\t ", "en", "b", 4), (5, LONG, "en", "a", len(LONG)), (1, "A first text of some length, with words enough for all rules to hold.", "en", "a", 70),
    (6, "A first text of some length, with words enough for all rules to hold.", None, "c", 70), (7, "one", "en", None, 3), (None, None, None, None, None),
    (8, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and 4851968107414326 ', "en", "c", 70), (9, "é\u00a0ü \U0001f600 it's 12", "de", "c", 12),
]
RANKS = functools.cache(lambda: bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)] + [(None, 1, None), (3, None, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


#: operator over documents, rows it gives for ROWS
OVER_DOCS = {
    "mixing": (lambda s, d: mixing.taken_words(mixing.mix(d, shards=4)), 12),
    "mixture": (lambda s, d: mixing.mixture(d, shards=4, chars_col="n_chars"), None),
    "jaccard": (lambda s, d: jaccard.join(d), 12),
    "one_of_each": (lambda s, d: jaccard.one_of_each(d), 10),
    "bpe": (lambda s, d: bpe.tokenize(d, RANKS(), public_tokenizers.PATTERN), 12),
    "backoff": (lambda s, d: backoff.score(d), 12),
    "rulefit": (lambda s, d: rulefit.score(d, rulefit.fit(d, labels(s))), 12),
    "rulefit without labels": (lambda s, d: rulefit.score(d, rulefit.fit(d, no_labels(s))), 12),
    "accepted": (lambda s, d: rulefit.accepted(d, rulefit.fit(d, no_labels(s))), 12),
    "hostrules": (lambda s, d: hostrules.judge(d), 12),
    "secrets": (lambda s, d: secrets.scan(d), 2),
    "runs": (lambda s, d: runs.detect(d), 12),
    "planted runs": (lambda s, d: runs.digests(runs.detect(queries.planted(d))), 12),
    "language": (lambda s, d: langid.predict(d, langid.fit(d, RANKS())), 12),
    "language without labels": (lambda s, d: langid.predict(d, langid.fit(d.where("lang is null"), RANKS())), 12),
    "phrases": (lambda s, d: phrases.mine(d, least=2), None),
    "redacted": (lambda s, d: secrets.redacted(d, chars_col="n_chars"), 12),
}


@pytest.mark.parametrize("name", OVER_DOCS)
def test_documents(spark, name):
    run, rows = OVER_DOCS[name]
    docs = spark.createDataFrame(ROWS, DOCS)
    got = run(spark, docs).collect()
    assert rows is None or len(got) == rows
    clashing = run(spark, docs.select("*", *[F.lit("x").alias(c) for c in CLASHES])).collect()
    assert sorted(str(r[:3]) for r in clashing) == sorted(str(r[:3]) for r in got)
    assert run(spark, spark.createDataFrame([], DOCS)).collect() == []


def test_all_null(spark):
    docs = spark.createDataFrame([(None,) * 5] * 3, DOCS)
    for name, (run, _) in OVER_DOCS.items():
        got = run(spark, docs).collect()
        assert len(got) == {"secrets": 0, "mixture": 0, "phrases": 0}.get(name, 3), name


def test_pages(spark):
    rules = [("allow", "org/"), ("block", "com/")]
    schema = "page_id long, url string, html string"
    rows = [(1, "http://a.org/x", "<p>" + "x" * 120), (2, None, None), (None, "http://b.com/y?z", "<p>" + "x" * 120), (3, "", ""), (3, "", ""), (4, "no host \r\n", "<p>" + "x" * 120),
            (1, "http://a.org/x", "<p>" + "x" * 120)]
    pages = spark.createDataFrame(rows, schema)
    clash = pages.select("*", *[F.lit(1).alias(c) for c in ("host", "rule", "score", "digest", "row_id", "value", "n")])
    for t in (pages, clash):
        assert len(urlmarkov.judge(t, rules).collect()) == 7
        got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(t).collect())
        assert got == [("1", 123, "response", None), ("1", 123, "revisit", 1), ("2", 0, "response", None), ("3", 0, "response", None), ("3", 0, "response", None),
                       ("4", 123, "revisit", 1), ("None", 123, "revisit", 1)]
    none = spark.createDataFrame([], schema)
    assert urlmarkov.judge(none, rules).collect() == [] and warc.round_trip(none).collect() == []


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1),
            (7, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (8, [2.0, 0.5], None), (9, [2.0, 0.5], None), (9, [2.0, 0.5], None)]
    table = spark.createDataFrame(rows, schema)
    want = [(0, 1, 8, 2.0), (0, 2, 9, 2.0), (0, 3, 9, 2.0), (0, 4, 20, 1.0), (20, 1, 8, 2.0), (20, 2, 9, 2.0), (20, 3, 9, 2.0), (20, 4, 0, 1.0)]
    for t in (table, table.select("*", F.lit(1).alias("list"), F.lit(1).alias("score"), F.lit(1).alias("vector"))):
        assert sorted(tuple(r) for r in annscan.search(t).collect()) == want
    assert annscan.search(spark.createDataFrame([], schema)).collect() == []


def test_pipeline_stages(spark, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ROWS, [], [(None,) * 5] * 2):
        docs = spark.createDataFrame(rows, DOCS)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.dtypes == docs.dtypes
            docs = spark.createDataFrame(out.collect(), DOCS)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids", "n_bytes"]
