"""The corpus pipeline: quality rules, exact dedup, near-dedup, packing, each over all that is left.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and
columns of any other name; what it does with them is stated there. All but the last return the rows they
keep with all their columns as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, scratch, table
from tidemark.llm.exact_dedup import find_copies, normalized
from tidemark.llm.near_dedup import near_classes
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import judge


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores ahead of it as long as ``docs`` has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _others(docs: DataFrame) -> Column:
    """All but id and text as JSON: of rows that repeat these two, the one where it is greatest stays, in every run."""
    return F.to_json(F.struct(F.lit(1).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; the labels calibrate the cutoffs.

    A null or empty text has no words and goes. A null language is a stratum of its own. Rows are judged
    one by one, so repeated rows stay or go together and a null id does no harm; labels go by id.
    Without labels the base rules alone decide; an empty table stays empty."""
    row = unused(docs, "_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    labels = rows.select(row, "doc_id").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col(row).alias("doc_id"), "quality")
    kept = judge(rows, labels, id_col=row).where("kept").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, then the
    one with the smallest id, a null id last. Null and blank texts are equal to each other. Of rows that
    repeat its id, the longest stays, and of those that repeat its text too, the same in every run. An empty table
    stays empty."""
    kept = find_copies(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    digest = unused(docs, "_digest")
    rows = docs.withColumn(digest, F.sha2(normalized(F.col("text")), 256))
    own = (rows[digest] == kept["_sha"]) & rows.doc_id.eqNullSafe(kept["_id"])
    best = F.max_by(F.struct(*docs.columns), F.struct(F.coalesce(F.char_length("text"), F.lit(0)), "text", _others(docs)))
    return rows.join(kept, own, "left_semi").groupBy(digest).agg(best.alias("best")).select("best.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies; rows with a null id and texts
    without words all stay, but rows that repeat an id and text are one. Other texts of a repeated id
    are documents of their own. An empty table stays empty."""
    digest, row = unused(docs, "_digest"), unused(docs, "_row")
    rows = docs.withColumn(digest, F.sha2("text", 256))
    # Numbers in the order of (id, text), so that classes keep the smallest id.
    keys = rows.where("doc_id is not null").select("doc_id", digest).distinct().orderBy("doc_id", digest)
    keys = materialize(keys.withColumn(row, F.monotonically_increasing_id()), "keys")
    same = rows.doc_id.eqNullSafe(keys.doc_id) & rows[digest].eqNullSafe(keys[digest])
    rows = materialize(rows.join(keys, same, "left").select(*(rows[c] for c in docs.columns), keys[row]), "rows")
    discard(keys)
    kept = near_classes(rows, id_col=row).where("doc_id = class_id").select(F.col("doc_id").alias(row))
    named = rows.join(kept, row, "left_semi").groupBy(row).agg(F.max_by(F.struct(*docs.columns), _others(docs)).alias("best")).select("best.*")
    return named.unionByName(rows.where(F.col(row).isNull()).select(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents that are left, one row per piece. A null or empty text is a piece that
    holds the end id alone; longer texts than a sequence are cut; nothing is dropped."""
    return pack_documents(docs)


#: (name, function) in order; each takes (spark, docs, sf_dir).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: SQL has no tokenizer and no consistent weighted sampling: the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
