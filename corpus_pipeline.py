"""Training-corpus pipeline: quality classifier, line dedup, n-gram Jaccard
join, benchmark decontamination, best-fit packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the next stage's documents.

All stages decide row by row: null and repeated ids, and extra columns, pass
through with their row, an empty table gives an empty one, and whole texts are
read however long.  Reserved column names: those beginning with _q_ and _ld_,
_row, _group and _keep_<number>."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.llm.common import stage, table
from colsense.llm.decontam import contamination, judged
from colsense.llm.linededup import drop_recurring_lines
from colsense.llm.ngram_join import jaccard_components
from colsense.llm.packing import pack_documents
from colsense.llm.quality import score, trained_on


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more.  Null and empty texts are
    scored like others (their features are zeros); equal texts have equal scores;
    without a positive label every score is 0.5 and all rows stay."""
    model = trained_on(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, docs.columns, ("_q_score", "_q_good")).where("_q_good = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines; n_chars follows the text.  A null
    text stays null, an empty one empty, and a text that loses all its lines
    becomes empty, its row stays.  Rows equal in id and text share their lines' fate."""
    out = drop_recurring_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("_ld_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).drop("_ld_dropped")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id (null
    ids last, equal ones by hash of the text); of rows equal in both, one.  Texts
    without words (null, empty, blank) are linked with nothing and stay, once for
    each id."""
    rows = docs.select("*", F.xxhash64("doc_id", "text").alias("_row"))
    groups = jaccard_components(rows, "_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))["_row"]
    keep = rows.select("_row", "doc_id").distinct().join(groups, "_row").groupBy("_group").agg(first.alias("_row")).select("_row")
    return rows.join(keep, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't contaminated by the benchmark.  A text without words isn't;
    an empty benchmark, and null items, contaminate nothing."""
    keep = {f"_keep_{i}": c for i, c in enumerate(docs.columns) if c != "text"}
    names = {c: name for name, c in keep.items()}
    found = judged(contamination(docs, table(spark, sf_dir, "benchmark"), keep=keep))
    return found.where("not contaminated").select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences (columns
    of the packing, not of documents).  A null or empty text is one end id; ties
    in length are numbered by id, so repeated rows lie in separate places."""
    return pack_documents(docs).drop("ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", best_fit_packing),
]

#: Classifier and tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, f in STAGES:
        docs = stage(f(spark, docs, sf_dir))
    return docs
