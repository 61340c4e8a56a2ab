"""The training-data pipeline over ``documents``: five stages, each written as Parquet and reread by the next.

1. language ID: documents whose text has no letter, or no language that the model prefers, go;
2. line dedup: boilerplate lines of a source go;
3. MinHash near-dedup: the smallest doc_id of every class of near copies stays;
4. benchmark decontamination: contaminated documents go;
5. packing: every document that is left gets its length bucket and batch.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of
``documents``.  ORACLE_SQL is None: trained code lengths and dart hashing have no SQL
form, so the pipeline is tested against plain Python versions of its stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import decontaminate, language, lines, minhash, packing
from inkloom.scale import table
from inkloom.session import scratch_path

#: A document stays when its best language has at least this share of the posterior.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language; the trees are trained on the labelled rows of this stage's input."""
    trees = language.train(docs.where(~language.held_out() & F.col("doc_id").isNotNull()))
    scored = language.identify(docs.select("*", F.col("text").alias("_judged")), trees, "_judged")
    kept = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return scored.where(kept).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every text by its lines that are not boilerplate of its source."""
    kept = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = lines.drop_boilerplate(docs.select("text", "source", *[F.col(c).alias(f"_in_{c}") for c in kept]), host="source")
    out = {c: F.col(f"_in_{c}").alias(c) for c in kept}
    out |= {"text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}
    return found.select(*[out[c] for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that represent their class; of rows that are equal in all columns one stays."""
    classes = minhash.near_duplicates(docs.select("doc_id", "text"))
    copies = classes.where(F.col("class_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns).distinct()


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents."""
    judged = decontaminate.decontaminate(
        docs.select("text", *[F.col(c).alias(f"_in_{c}") for c in docs.columns]), table(spark, sf_dir, "benchmark")
    )
    return judged.where(~F.col("contaminated")).select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document its bucket, batch and place."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of ``documents``; every stage is written to the shared folder first."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
