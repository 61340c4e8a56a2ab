"""The pipeline against plain versions of its stages, and stages on empty and odd tables."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from inkloom.llm import language, lines, packing
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    trees = language.train(docs.where(~language.held_out()))
    trees.index()
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    scores = language.score_texts(trees, pa.array([r[2] for r in rows])).to_pylist()
    lettered = lambda t: any(c.isalpha() for c in t or "")
    rows = [r for r, s in zip(rows, scores) if lettered(r[2]) and s["score"] >= pipeline.LEAST_SCORE]
    texts = brute.without_boilerplate(rows, lines.RATIO, lines.LEAST_PAGES)
    classes = brute.near_classes(texts)
    texts = {d: t for d, t in texts.items() if classes[d] == d}
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute.contamination(texts, items)
    texts = {d: t for d, t in texts.items() if not (hits[d][1] and 20 * hits[d][1] >= hits[d][0])}
    got = pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    counted = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    counts = {r[0]: r[1] for r in counted.select("doc_id", packing.token_count(F.col("text"))).collect()}
    assert {r.doc_id: r.n_tokens for r in got} == counts


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, class_id long, h long"
    rows = [(1, None, "en", None, 0), (2, "", None, "a", 0), (3, "the one text of all", "en", "a", 3), (3, "the one text of all", "en", "a", 3), (4, "The one text of all!", None, "b", 3), (None, "a text", "en", "a", 1)]
    odd = spark.createDataFrame([(*r, 0.5, 7, 9) for r in rows], schema)
    for name, stage in pipeline.STAGES:
        for docs in (odd, odd.where("false")):
            out = stage(spark, docs, DATA)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= docs.count()
    kept = pipeline.near_dedup_stage(spark, odd, DATA).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "None"]
    assert {r.score for r in pipeline.line_stage(spark, odd, DATA).collect()} == {0.5}
