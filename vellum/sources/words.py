"""Words with page geometry. A PDF reader would give such rows; here they are laid out from the documents' lines.

A line of text is wrapped to visual lines of ``WRAP`` words; ``PER_PAGE`` visual lines make a page of 612 x 792 points, top-left
origin. Every third document has two columns: its odd visual lines stand 300 points further right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRAP, PER_PAGE, WIDTH, HEIGHT = 6, 40, 612.0, 792.0


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, vline, k, text, x0, top, x1, bottom, conf. All from each document's own row: no shuffle."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    parts = lambda line: F.filter(F.split(line, " "), lambda w: w != "")
    rows = lambda line: F.transform(F.sequence(F.lit(0), F.floor((F.size(line) + WRAP - 1) / WRAP).cast("int") - 1), lambda i: F.slice(line, i * WRAP + 1, WRAP))
    lines = F.flatten(F.transform(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), parts), lambda p: F.size(p) > 0), rows))
    flat = docs.select("doc_id", F.posexplode(lines).alias("vline", "ws")).select("doc_id", "vline", F.posexplode("ws").alias("k", "text"))
    shift = F.when((F.col("doc_id") % 3 == 0) & (F.col("vline") % 2 == 1), 300.0).otherwise(0.0)
    x0 = 30.0 + F.col("k") * 40 + shift
    top = 72.0 + 14 * F.floor(F.col("vline") % PER_PAGE / F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1)) + (F.col("k") % 3) * 0.25
    return flat.select("doc_id", (F.floor(F.col("vline") / PER_PAGE) + 1).cast("int").alias("page"), "vline", "k", "text", x0.alias("x0"), top.alias("top"), (x0 + F.least(F.length("text") * 5, F.lit(38))).alias("x1"), (top + 10).alias("bottom"), (100 - (F.length("text") * 7 + F.col("k")) % 45).cast("double").alias("conf"))


def visual_lines(text: str | None) -> list[list[str]]:
    """The words of each visual line of a text."""
    lines = ([w for w in line.split(" ") if w] for line in (text or "").split("\n"))
    return [ws[i : i + WRAP] for ws in lines for i in range(0, len(ws), WRAP)]


def page_texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id, page, text: the pages of ``words`` with their words in order, joined by spaces, and more columns of their documents. All from each document's own row: no shuffle."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, *own in ([c.slice(i, 100) for c in batch.columns] for i in range(0, batch.num_rows, 100)):
                rows, pages, found = [], [], []
                for i, text in enumerate(texts.to_pylist()):
                    lines = visual_lines(text)
                    for j in range(0, len(lines), PER_PAGE):
                        rows.append(i)
                        pages.append(j // PER_PAGE + 1)
                        found.append(" ".join(w for line in lines[j : j + PER_PAGE] for w in line))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(at), pa.array(pages, pa.int32()), pa.array(found, pa.string()), *(c.take(at) for c in own)], names=["doc_id", "page", "text", *more])

    types = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", *more)}
    return docs.mapInArrow(run, f"doc_id {types['doc_id']}, page int, text string" + "".join(f", {c} {types[c]}" for c in more))


#: Words after which pages are handed on.
WORDS_AT_ONCE = 20_000


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, ws: ``words`` as a row per page, with its words in order as structs. All from each document's own row: no shuffle."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def laid_out(ids: pa.Array, lines: list[list[str]], row: list[int], number: list[int]) -> pa.RecordBatch:
        """Of visual lines, each with the row of its document in ids and its number there."""
        size = np.array([len(x) for x in lines], np.int64)
        first = np.cumsum(size) - size
        k = (np.arange(int(size.sum())) - np.repeat(first, size)).astype(np.int32)
        of_line, vline = np.array(row, np.int64), np.array(number, np.int32)
        two = (pc.fill_null(ids, 1).to_numpy(zero_copy_only=False) % 3 == 0)[of_line]
        text = pa.array([w for x in lines for w in x], pa.string())
        x0 = 30.0 + k * 40 + np.repeat(np.where(two & (vline % 2 == 1), 300.0, 0.0), size)
        top = np.repeat(72.0 + 14 * (vline % PER_PAGE // np.where(two, 2, 1)), size) + k % 3 * 0.25
        x1 = x0 + np.minimum(pc.utf8_length(text).to_numpy().astype(np.int64) * 5, 38)
        begin = np.flatnonzero(vline % PER_PAGE == 0)
        ws = pa.StructArray.from_arrays([pa.array(top), pa.array(np.repeat(vline, size)), pa.array(k), text, pa.array(x0), pa.array(x1), pa.array(top + 10)], ["top", "vline", "k", "text", "x0", "x1", "bottom"])
        offsets = pa.array(np.append(first[begin], len(k)), pa.int32())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(of_line[begin])), pa.array(vline[begin] // PER_PAGE + 1), pa.ListArray.from_arrays(offsets, ws)], names=["doc_id", "page", "ws"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, row, number, held = [], [], [], 0
            for i in range(batch.num_rows):
                found = visual_lines(batch.column(1)[i].as_py())
                for low in range(0, len(found), PER_PAGE):
                    here = found[low : low + PER_PAGE]
                    lines += here
                    row += [i] * len(here)
                    number += range(low, low + len(here))
                    held += sum(map(len, here))
                    if held >= WORDS_AT_ONCE:
                        yield laid_out(batch.column(0), lines, row, number)
                        lines, row, number, held = [], [], [], 0
            if lines:
                yield laid_out(batch.column(0), lines, row, number)

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, page int, ws array<struct<top: double, vline: int, k: int, text: string, x0: double, x1: double, bottom: double>>")


def text_layer(rows: DataFrame) -> DataFrame:
    """words with what a text layer would hold of them: ``native`` (whether it has the word) and ``shown`` (as which text).

    Every seventh document is a scan whose text layer is lost but for one word in nine; that of every eleventh is in the wrong encoding.
    """
    lost = (F.col("doc_id") % 7 == 0) & ((F.col("vline") + F.col("k")) % 9 != 0)
    return rows.withColumn("native", ~lost).withColumn("shown", F.when(F.col("doc_id") % 11 == 0, F.replace("text", F.lit("é"), F.lit("Ã©"))).otherwise(F.col("text")))


#: The same rows in DuckDB, as common table expressions that queries begin with.
SQL = """
lines_ AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS l FROM documents),
parts_ AS (SELECT doc_id, l, list_filter(string_split(line, ' '), lambda w: w <> '') AS ws FROM lines_),
cut_ AS (SELECT doc_id, l, ws, unnest(range(0, (len(ws) + 5) // 6)) AS c FROM parts_ WHERE len(ws) > 0),
visual_ AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l, c) - 1 AS INTEGER) AS vline, ws[c * 6 + 1 : c * 6 + 6] AS ws FROM cut_),
each_ AS (SELECT doc_id, vline, unnest(ws) AS text, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS k FROM visual_),
placed_ AS (SELECT *, 30.0::DOUBLE + k * 40 + CASE WHEN doc_id % 3 = 0 AND vline % 2 = 1 THEN 300.0 ELSE 0.0 END AS x0,
  72.0::DOUBLE + 14 * ((vline % 40) // CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END) + (k % 3) * 0.25 AS top FROM each_),
words AS (SELECT doc_id, CAST(vline // 40 + 1 AS INTEGER) AS page, vline, k, text, x0, top, x0 + least(length(text) * 5, 38) AS x1, top + 10 AS bottom,
  CAST(100 - (length(text) * 7 + k) % 45 AS DOUBLE) AS conf FROM placed_)
"""
