"""The queries of this subpackage: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import materialize, materialize_arrow, small_batches, table


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.licences import licences

    return licences(table(spark, sf_dir, "documents")).drop("spans")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents")).drop("found")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.mixing import DOMAINS, mix

    rows = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_tokens", *(F.element_at("posterior", i + 1).alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate", "copies")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).drop("set_id", "label")


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.quality import quality

    q = quality(table(spark, sf_dir, "documents"))
    return q.select("doc_id", *(F.col("quality")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept")))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.huffman_ids import read_ids, write_ids
    from vellum.llm.tokens import encoder, id_type, vocabulary_path

    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    path = vocabulary_path()
    kind = id_type(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [ids.astype(kind).tobytes() + bytes(int(kind[-1])) for ids in encoder(path).encode_batch([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["key", "ids"])

    ids = materialize_arrow(docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text")), encode, "key long, ids binary", "ids")
    written, _ = write_ids(ids, kind)
    return read_ids(written).select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.html_template import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.winnowing import compare_with_next

    return compare_with_next(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.packing import pack, token_pieces

    return pack(materialize(token_pieces(table(spark, sf_dir, "documents")), "pieces"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.warc import index_captures, write_archives

    found = index_captures(write_archives(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "history")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register() -> None:
    from vellum.llm import oracle

    for name, f in list(globals().items()):
        if name.startswith("op") and callable(f):
            QUERIES[name] = f
    QUERIES["pipeline"] = pipeline
    ORACLE_SQL.update(oracle.SQL)


_register()
