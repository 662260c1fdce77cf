"""The corpus pipeline's stages: documents in, packed sequences out.

Quality rules drop failing and depleted documents and take lines that repeat across a host's documents out of the rest;
near duplicates (five-word shingles, similarity 0.8) keep the document with the smallest id of each group; personal
data is masked; documents are repeated or dropped by rates that bring the domains to their target weights, and those that are
labelled toxic, or toxic by the fitted model with a chance of a quarter or more, are dropped (toxic ones that the model takes for others stay; README); what remains is packed into sequences of 2048 tokens. Between stages the documents are written as Parquet and read again.

Edge cases: null texts are empty, and empty documents fail the quality rules; rows that repeat an id and a text are one group
of near duplicates, of which one row stays; so are null ids, and an id with several texts is in the groups of each; extra columns travel along untouched, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vellum.llm.common import fresh, materialize, table, tidy
from vellum.llm.jaccard import SHINGLE, jaccard_components, set_id, shingle_sets
from vellum.llm.mixing import TARGETS, mixed_documents
from vellum.llm.packing import pack, token_pieces
from vellum.llm.pii import mask_pii
from vellum.llm.quality import quality


def with_text(docs: DataFrame, text: F.Column) -> DataFrame:
    """docs with another text, and n_chars counted anew where there is such a column."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    q = fresh(docs, "quality")
    made = quality(docs)
    return with_text(made.where(F.col(q)["kept"]), F.col(q)["clean"]).drop(q)


@F.arrow_udf(LongType())
def set_of(text: pa.Array) -> pa.Array:
    return pa.array([set_id(x) for x in shingle_sets(text.to_pylist(), SHINGLE)], pa.int64())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = materialize(jaccard_components(docs), "pipeline-groups")
    # One row of each component: the smallest id, nulls last; documents without shingles are alone.
    each = found.groupBy("label", F.when(F.col("label").isNull(), F.col("doc_id")).alias("alone"))
    stay = each.agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "set_id")).alias("s")).select("s.doc_id", "s.set_id")
    unclear = materialize(found.groupBy("doc_id").agg(F.count("*").alias("rows")).where("doc_id is null or rows > 1").select("doc_id"), "pipeline-unclear")
    i, s = fresh(docs, "id"), fresh(docs, "set")
    stay = stay.select(F.col("doc_id").alias(i), F.col("set_id").alias(s))
    if unclear.isEmpty():
        return docs.join(stay, F.col("doc_id") == F.col(i), "left_semi")
    # Ids that are null or repeat don't tell which row it is: there the set does, too.
    unclear = unclear.select(F.col("doc_id").alias(i))
    same = F.col("doc_id").eqNullSafe(F.col(i))
    clear = docs.join(unclear, same, "left_anti").join(stay, F.col("doc_id") == F.col(i), "left_semi")
    other = docs.join(unclear, same, "left_semi").withColumn(s, set_of(F.col("text")))
    pairs = stay.withColumnRenamed(s, f"{s}_")
    other = other.join(pairs, same & (F.col(s) == F.col(f"{s}_")), "left_semi").dropDuplicates(["doc_id", s]).drop(s)
    return clear.unionByName(other)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = mask_pii(docs)
    return with_text(masked, F.col("text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, table(spark, sf_dir, "labels"), targets={**TARGETS, "toxic": 0.0})


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(materialize(token_pieces(docs), "pipeline-pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixing),
    ("best_fit_packing", packing),
]

#: SQL has neither the tokenizer nor the rates' fit; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
            tidy(spark)
    return docs
