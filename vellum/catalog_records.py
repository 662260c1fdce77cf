"""Queries of records, answers, boxes and alignments, with their DuckDB SQL. Importing this adds them to the catalog.

Numbers that may be absent (no candidate, no region) are -1 in these queries, and null in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.catalog import PAGE, _read, query
from vellum.catalog_delivery import CAND, _segments
from vellum.operators import alignment, records
from vellum.sources import words as source

WIDTH, HEIGHT = 612.0, 792.0


@query("""WITH l AS (SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id) AS last, CASE WHEN event_id % 97 = 5 THEN '{bad' WHEN event_id % 89 = 3 THEN '' ELSE props END AS line FROM events),
t AS (SELECT user_id, event_id, CASE WHEN event_id = last AND user_id % 3 = 0 THEN line[:5] ELSE line END AS line FROM l),
m AS (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last FROM t WHERE coalesce(line, '') <> '')
SELECT user_id, event_id, CASE WHEN json_valid(line) THEN 'record' WHEN event_id = last THEN 'torn' ELSE 'corrupt' END AS status FROM m""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max("event_id").alias("last"))
    line = F.when(F.col("event_id") % 97 == 5, "{bad").when(F.col("event_id") % 89 == 3, "").otherwise(F.col("props"))
    torn = F.when((F.col("event_id") == F.col("last")) & (F.col("user_id") % 3 == 0), F.substring(line, 1, 5)).otherwise(line)
    return records.log_lines(events.join(last, "user_id").select("user_id", "event_id", torn.alias("line")), "user_id", "event_id", "line").select("user_id", "event_id", "status")


@query("""WITH b AS (SELECT doc_id, 'doc' || doc_id || CASE doc_id % 3 WHEN 1 THEN '__p2_5-7' WHEN 2 THEN '__p10-12' ELSE '' END AS base FROM documents)
SELECT doc_id, base, base || '.md' AS markdown, 'intermediates/' || base || '.' || substr(sha256('doc' || doc_id), 1, 16) || '.unverified.md' AS unverified FROM b""")
def artifact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    token = F.when(F.col("doc_id") % 3 == 1, "2_5-7").when(F.col("doc_id") % 3 == 2, "10-12")
    run = F.substring(F.sha2(stem, 256), 1, 16)
    return _read(spark, sf_dir, "documents").select("doc_id", *(records.artifact_name(stem, token, run, k).alias(k) for k in ("base", "markdown", "unverified")))


ANSWERS = r"""WITH c AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1:3] AS cands FROM documents),
a AS (SELECT doc_id, cands, CASE doc_id % 6 WHEN 0 THEN '{"selected_index": 1}' WHEN 1 THEN CAST(json_object('selected', cands[-1]) AS VARCHAR) WHEN 2 THEN 'the first' WHEN 3 THEN '{"selected_index": true}' WHEN 4 THEN '{"selected_index": 9, "selected": "no such line"}' ELSE '{"selected_index": 0, "selected": "no such line"}' END AS answer FROM c),
j AS (SELECT doc_id, cands, CASE WHEN json_valid(answer) THEN CAST(answer AS JSON) END AS j FROM a),
n AS (SELECT doc_id, cands, CASE WHEN json_type(j, '$.selected_index') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(j, '$.selected_index') AS BIGINT) END AS i, CASE WHEN json_type(j, '$.selected') = 'VARCHAR' THEN json_extract_string(j, '$.selected') END AS v FROM j),
k AS (SELECT doc_id, cands, CASE WHEN i >= 0 AND i < len(cands) THEN i WHEN list_position(cands, v) >= 1 THEN CAST(list_position(cands, v) - 1 AS BIGINT) END AS chosen FROM n)
"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, 3)
    made = _read(spark, sf_dir, "documents").select("doc_id", cands.alias("cands"))
    of = lambda n: F.col("doc_id") % 6 == n
    answer = F.when(of(0), '{"selected_index": 1}').when(of(1), F.to_json(F.struct(F.element_at("cands", -1).alias("selected")))).when(of(2), "the first").when(of(3), '{"selected_index": true}').when(of(4), '{"selected_index": 9, "selected": "no such line"}').otherwise('{"selected_index": 0, "selected": "no such line"}')
    return made.withColumn("chosen", records.chosen_index(answer, F.col("cands")))


@query(ANSWERS + "SELECT doc_id, coalesce(chosen, -1) AS chosen, CASE WHEN chosen IS NOT NULL THEN cands[chosen + 1] END AS value FROM k")
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("doc_id", F.coalesce("chosen", F.lit(-1)).alias("chosen"), F.get("cands", F.col("chosen").cast("int")).alias("value"))


@query(ANSWERS + "SELECT doc_id FROM k WHERE doc_id % 4 <> 0 AND NOT coalesce(list_contains(cands, CASE WHEN chosen IS NOT NULL THEN cands[chosen + 1] END), false)")
def decision_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("doc_id") % 4 == 0, "human").otherwise("deterministic")
    made = _answers(spark, sf_dir)
    return made.where(records.breaks_invariant(method, F.get("cands", F.col("chosen").cast("int")), F.col("cands"))).select("doc_id")


@query("SELECT doc_id, page, vline, k, x0 AS crop_left, 792 - bottom AS crop_bottom, 612 - x1 AS crop_right, top AS crop_top, 72 + x0 / 2 AS page_x0, 100 + top / 2 AS page_top, 72 + x1 / 2 AS page_x1, 100 + bottom / 2 AS page_bottom FROM words", with_words=True)
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = records.crop_margins({c: F.col(c) for c in ("x0", "top", "x1", "bottom")}, WIDTH, HEIGHT)
    origin = {"x0": 72.0, "top": 100.0, "x1": 72.0, "bottom": 100.0}
    return source.words(spark, sf_dir).select(*PAGE, "vline", "k", *(cut[c].alias(f"crop_{c}") for c in ("left", "bottom", "right", "top")), *(records.on_page(F.col(c), F.lit(o), 2.0).alias(f"page_{c}") for c, o in origin.items()))


@query(CAND.rstrip().rstrip(",") + """, regions AS (SELECT DISTINCT doc_id, page, unnest([{'region_no': 0, 'x0': 72.3, 'top': 141.7, 'x1': 600.0, 'bottom': 194.0}, {'region_no': 1, 'x0': 60.0, 'top': 156.0, 'x1': 612.0, 'bottom': 500.0}]) AS r FROM native_)
SELECT n.doc_id, n.page, n.id, coalesce(min(r.region_no), -1) AS region_no FROM native_ n LEFT JOIN regions g ON n.doc_id = g.doc_id AND n.page = g.page AND n.x0 >= r.x0::DOUBLE - 0.5 AND n.x1 <= r.x1::DOUBLE + 0.5 AND n.top >= r.top::DOUBLE - 0.5 AND n.bottom <= r.bottom::DOUBLE + 0.5 GROUP BY ALL""")
def table_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    native, _, _ = _segments(spark, sf_dir)
    two = F.array(*(F.struct(F.lit(i).alias("region_no"), *(F.lit(v).alias(c) for c, v in zip(("x0", "top", "x1", "bottom"), box, strict=True))) for i, box in enumerate([(72.3, 141.7, 600.0, 194.0), (60.0, 156.0, 612.0, 500.0)])))
    regions = native.select(*PAGE).distinct().select(*PAGE, F.inline(two))
    return records.table_hints(native, regions, PAGE).select(*PAGE, "id", F.coalesce("region_no", F.lit(-1)).alias("region_no"))


@query("SELECT doc_id, doc_id % 9 + 1 AS level, CASE WHEN doc_id % 9 < 6 THEN repeat('#', CAST(doc_id % 9 + 1 AS INTEGER)) || ' ' ELSE '[L' || (doc_id % 9 + 1) || '] ' END || string_split(coalesce(text, ''), chr(10))[1] AS heading FROM documents")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.col("doc_id") % 9 + 1
    return _read(spark, sf_dir, "documents").select("doc_id", level.alias("level"), records.heading(level, F.split(F.coalesce("text", F.lit("")), "\n")[0]).alias("heading"))


@query("""WITH r AS (SELECT n_regionkey, list({'k': n_nationkey, 'n': n_name} ORDER BY n_nationkey) AS rows FROM nation GROUP BY 1)
SELECT n_regionkey, CASE WHEN n_regionkey % 2 = 0 THEN '<table>' || chr(10) || '<tr><td colspan="2">Nations &amp; keys</td></tr>' || chr(10) || array_to_string(list_transform(rows, lambda x: '<tr><td>' || x.n || '</td><td>' || x.k || '</td></tr>'), chr(10)) || chr(10) || '</table>'
ELSE '| Nation\\|s | Key |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(list_transform(rows, lambda x: '| ' || x.n || ' | ' || x.k || ' |'), chr(10)) END AS markdown FROM r""".replace("\\\\|", "\\|"))
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda text, span=1: F.struct(text.alias("text"), F.lit(span).alias("span"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(cell(x["n_name"]), cell(x["n_nationkey"].cast("string"))))
    made = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(body.alias("body"))
    head = F.when(F.col("n_regionkey") % 2 == 0, F.array(cell(F.lit("Nations & keys"), 2))).otherwise(F.array(cell(F.lit("Nation|s")), cell(F.lit("Key"))))
    return made.select("n_regionkey", records.table_text(F.concat(F.array(head), F.col("body"))).alias("markdown"))


@query()
def word_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    native, _, ocr = _segments(spark, sf_dir)
    pairs = native.select(*PAGE, "id", F.col("text").alias("r")).join(ocr.select(*PAGE, "id", F.replace("text", F.lit("a "), F.lit("a")).alias("f")), [*PAGE, "id"])
    return alignment.word_rates(pairs, [*PAGE, "id"], "r", "f")


@query()
def fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    native, _, ocr = _segments(spark, sf_dir)
    return alignment.matched_lines(ocr.select(*PAGE, "id", "text"), native.select(*PAGE, F.col("id").alias("ref_id"), F.col("text").alias("ref_text")), PAGE).select(*PAGE, "id", "ref_id", "ratio")
