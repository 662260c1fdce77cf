"""Queries of reconciliation, metric roll-ups and delivery, with their DuckDB SQL. Importing this adds them to the catalog.

The tables have no rival extractions, so those are derived: every line of a document is a native segment, the layout path's has its
white space collapsed, and the OCR's has some letters misread; boxes are a point or two apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.catalog import PAGE, RECALL, _read, query
from vellum.operators import delivery, identity, metrics, reconcile, validate
from vellum.sources import words as source

CAND = r"""WITH lines_ AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS id, unnest(string_split(text, chr(10))) AS text FROM documents),
native_ AS (SELECT doc_id, CAST(id // 40 + 1 AS INTEGER) AS page, id, text, 72::DOUBLE AS x0, 72::DOUBLE + 14 * (id % 40) AS top, 72::DOUBLE + 5 * least(length(text), 90) AS x1, 82::DOUBLE + 14 * (id % 40) AS bottom FROM lines_ WHERE trim(text) <> ''),
layout_ AS (SELECT doc_id, page, id, regexp_replace(text, '[ \t\n\r]+', ' ', 'g') AS text, x0 + 1 AS x0, top + 1 AS top, x1 + 1 AS x1, bottom + 1 AS bottom FROM native_),
ocr_ AS (SELECT doc_id, page, id, CASE (doc_id + id) % 7 WHEN 0 THEN replace(text, 'l', '1') WHEN 1 THEN replace(text, 'e', 'E') WHEN 2 THEN replace(text, 'rn', 'm') ELSE text END AS text, x0 AS x0, top + 2 AS top, x1, bottom + 2 AS bottom FROM native_),
"""


def _best(name: str, other: str) -> str:
    wide, high = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0)", "greatest(least(a.bottom, b.bottom) - greatest(a.top, b.top), 0)"
    inner, area = f"({wide} * {high})", "(a.x1 - a.x0) * (a.bottom - a.top) + (b.x1 - b.x0) * (b.bottom - b.top)"
    return f"""{name} AS (SELECT * FROM (SELECT doc_id, page, id, other_id, iou, other_text, row_number() OVER (PARTITION BY doc_id, page, id ORDER BY iou DESC, len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) DESC, other_id) AS r FROM (
  SELECT a.doc_id, a.page, a.id, b.id AS other_id, {inner} / ({area} - {inner}) AS iou, b.text AS other_text, string_split(lower(a.text), ' ') AS ta, string_split(lower(b.text), ' ') AS tb FROM native_ a JOIN {other} b ON a.doc_id = b.doc_id AND a.page = b.page) WHERE iou >= 0.5) WHERE r = 1)"""


ALIGNED = CAND + _best("al_", "layout_") + "," + _best("ao_", "ocr_") + """, aligned AS (SELECT n.doc_id, n.page, n.id, n.x0, n.top, n.x1, n.bottom, n.text AS native, l.other_id AS layout_id, l.iou AS iou_layout, l.other_text AS layout, o.other_id AS ocr_id, o.iou AS iou_ocr, o.other_text AS ocr
  FROM native_ n LEFT JOIN al_ l USING (doc_id, page, id) LEFT JOIN ao_ o USING (doc_id, page, id))"""
_CMP = lambda c: rf"trim(regexp_replace(translate({c}, '“”‘’', '""'''''), '[ \t\n\r]+', ' ', 'g'))"
DECIDED = ALIGNED + f""", keyed_ AS (SELECT *, {_CMP('native')} AS n, {_CMP('layout')} AS a, {_CMP('ocr')} AS o FROM aligned),
there_ AS (SELECT *, list_filter([n, a, o], lambda v: v IS NOT NULL) AS there, string_split(n, ' ') AS wn, string_split(coalesce(o, n), ' ') AS wo FROM keyed_),
sure_ AS (SELECT doc_id, page, id, native, len(list_distinct(list_transform(there, lambda v: lower(replace(v, ' ', ''))))) <= 1 AS settled,
  0.5::DOUBLE * greatest((n = n)::INT + coalesce((n = a)::INT, 0) + coalesce((n = o)::INT, 0), coalesce((a = o)::INT + 1, 0)) / len(there) + 0.2::DOUBLE + 0.2::DOUBLE * coalesce((100 - length(ocr) % 45) / 100, 1.0::DOUBLE)
  + CASE WHEN len(list_filter(list_concat(list_filter(list_distinct(wo), lambda w: NOT list_contains(wn, w)), list_filter(list_distinct(wn), lambda w: NOT list_contains(wo, w))), lambda w: regexp_matches(w, '[0-9]'))) > 0 THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS confidence FROM there_),
decided AS (SELECT doc_id, page, id, round(confidence, 6) AS confidence, CASE WHEN settled THEN 'deterministic' ELSE 'review' END AS method, CASE WHEN settled THEN native END AS value, CASE WHEN NOT settled THEN CASE WHEN confidence >= 0.75 THEN 'no_llm' ELSE 'below_threshold' END END AS reason FROM sure_)"""


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).where(F.trim("text") != "")
    i = F.col("i").cast("long")
    top = 72.0 + 14 * (i % 40)
    native = lines.select("doc_id", (F.floor(i / 40) + 1).cast("int").alias("page"), i.alias("id"), "text", F.lit(72.0).alias("x0"), top.alias("top"), (72.0 + 5 * F.least(F.length("text"), F.lit(90))).alias("x1"), (top + 10).alias("bottom"))
    layout = native.withColumn("text", F.regexp_replace("text", "[ \\t\\n\\r]+", " "))
    for c in ("x0", "top", "x1", "bottom"):
        layout = layout.withColumn(c, F.col(c) + 1)
    fault = (F.col("doc_id") + F.col("id")) % 7
    misread = lambda a, b: F.replace("text", F.lit(a), F.lit(b))
    ocr = native.withColumn("text", F.when(fault == 0, misread("l", "1")).when(fault == 1, misread("e", "E")).when(fault == 2, misread("rn", "m")).otherwise(F.col("text")))
    return native, layout, ocr.withColumn("top", F.col("top") + 2).withColumn("bottom", F.col("bottom") + 2)


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    native, layout, ocr = _segments(spark, sf_dir)
    out = native.select(*PAGE, "id", "x0", "top", "x1", "bottom", F.col("text").alias("native"))
    for name, other in (("layout", layout), ("ocr", ocr)):
        best = reconcile.align(native, other, PAGE).select(*PAGE, "id", F.col("other_id").alias(f"{name}_id"), F.col("iou").alias(f"iou_{name}"), F.col("other_text").alias(name))
        out = out.join(best, [*PAGE, "id"], "left")
    return out


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir).select(*PAGE, "id", F.round("confidence", 6).alias("confidence"), "method", "value", "reason")


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.literal_decision(_aligned(spark, sf_dir).withColumn("ocr_conf", 100 - F.length("ocr") % 45))


@query(ALIGNED + " SELECT doc_id, page, id, layout_id, round(iou_layout, 6) AS iou_layout, ocr_id, round(iou_ocr, 6) AS iou_ocr, sha1(concat_ws(',', doc_id || '/' || page, 'layout:' || layout_id, 'native:' || id, 'ocr:' || ocr_id)) AS group_id FROM aligned")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda n, c: F.concat(F.lit(n), F.col(c).cast("string"))
    members = F.concat_ws(",", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page").cast("string")), named("layout:", "layout_id"), named("native:", "id"), named("ocr:", "ocr_id"))
    return _aligned(spark, sf_dir).select(*PAGE, "id", "layout_id", F.round("iou_layout", 6).alias("iou_layout"), "ocr_id", F.round("iou_ocr", 6).alias("iou_ocr"), F.sha1(members.cast("binary")).alias("group_id"))


@query(DECIDED + " SELECT * FROM decided")
def literal_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)


@query(DECIDED + " SELECT doc_id, count(*) FILTER (method = 'deterministic') AS literal_deterministic, count(*) FILTER (reason = 'no_llm') AS no_llm, count(*) FILTER (reason = 'below_threshold') AS below_threshold, count(*) FILTER (method = 'review') AS unresolved FROM decided GROUP BY doc_id")
def reconciliation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return _decided(spark, sf_dir).groupBy("doc_id").agg(is_("method", "deterministic").alias("literal_deterministic"), is_("reason", "no_llm").alias("no_llm"), is_("reason", "below_threshold").alias("below_threshold"), is_("method", "review").alias("unresolved"))


_REGION = """'{"candidates":' || to_json(list_sort(list_filter([native, layout, ocr], lambda v: v IS NOT NULL))) || ',"page":' || page || ',"regions":[[' || round(x0, 3) || ',' || round(top, 3) || ',' || round(x1, 3) || ',' || round(bottom, 3) || ']]}'"""


@query(DECIDED + f""" SELECT doc_id, page, id, reason, 'open' AS status, sha256(concat_ws(chr(10), sha256(doc_id || ''), 'literal_content', {_REGION}, '{{"reconcile_confidence_threshold":0.75}}')) AS applicability_key FROM decided JOIN aligned USING (doc_id, page, id) WHERE method = 'review'""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir).where("method = 'review'")
    place = identity.region(F.col("page"), F.array(F.array("x0", "top", "x1", "bottom")), F.array_compact(F.array("native", "layout", "ocr")))
    config = identity.json_object({"reconcile_confidence_threshold": F.lit("0.75")})
    key = identity.applicability_key(F.sha2(F.col("doc_id").cast("string"), 256), F.lit("literal_content"), place, config)
    return rows.select(*PAGE, "id", "reason", F.lit("open").alias("status"), key.alias("applicability_key"))


ORDERS = """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS r FROM conversations),
p AS (SELECT a.conv_id, sum(sign(CAST(b.r AS BIGINT) - CAST(a.r AS BIGINT))) AS s FROM t a JOIN t b ON a.conv_id = b.conv_id AND (a.turn < b.turn OR a.turn = b.turn AND a.r < b.r) GROUP BY ALL),
k AS (SELECT conv_id, CASE WHEN n < 2 THEN 1.0::DOUBLE ELSE coalesce(s, 0) / (n * (n - 1) / 2) END AS tau FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id) LEFT JOIN p USING (conv_id))
"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: turns by length, and the turns' numbers in the geometric order as ranks by length."""
    by = F.array_sort(F.collect_list(F.struct(F.length("text").alias("l"), "turn")))
    return _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(by, lambda x: x["turn"]).alias("by_length"), F.array_sort(F.collect_list("turn")).alias("geometry"))


@query(ORDERS + "SELECT conv_id, CASE WHEN tau = 1 THEN 'deterministic' WHEN (1 - tau) / 2 > 0.2::DOUBLE THEN 'conflict' ELSE 'geometry' END AS decision FROM k")
def order_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _read(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "row_number() over (partition by conv_id order by length(text), turn) as r")
    orders = ranked.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "r"))), lambda x: x["r"]).alias("order"))
    return orders.select("conv_id", reconcile.order_decision(validate.kendall_tau(F.col("order"))).alias("decision"))


@query("""WITH o AS (SELECT conv_id, list(turn ORDER BY length(text), turn) AS a, list(turn ORDER BY turn) AS g FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 4 <> 0 OR list_reverse(a) = a OR list_reverse(a) = g THEN 'accept' ELSE 'reject' END AS verdict FROM o""")
def guard_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = F.when(F.col("conv_id") % 4 == 0, F.reverse("by_length")).otherwise(F.col("by_length"))
    return _turns(spark, sf_dir).select("conv_id", reconcile.guard_order(picked, F.array("by_length"), F.col("geometry")).alias("verdict"))


@query("""WITH s AS (SELECT doc_id, doc_id % 9 + 1 AS p FROM documents), r AS (SELECT doc_id, p AS lo, p AS hi FROM s UNION ALL SELECT doc_id, p + 2, p + 2 + doc_id % 4 FROM s UNION ALL SELECT doc_id, p + 3 + doc_id % 5, p + 3 + doc_id % 5 FROM s),
w AS (SELECT *, max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM w),
m AS (SELECT doc_id, island, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY ALL),
b AS (SELECT doc_id, arg_min(lo || '-' || least(reach, hi), (lo, hi)) AS twice FROM i WHERE lo <= reach GROUP BY doc_id)
SELECT doc_id, CASE WHEN max(twice) IS NULL THEN string_agg(CASE WHEN lo = hi THEN lo || '' ELSE lo || '-' || hi END, '_' ORDER BY lo) END AS token, max(twice) AS twice FROM m LEFT JOIN b USING (doc_id) GROUP BY doc_id""")
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = _read(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id % 9 + 1 as p").selectExpr("doc_id", "concat(p, ',', p + 2, '-', p + 2 + doc_id % 4, ',', p + 3 + doc_id % 5) as spec")
    return reconcile.page_selection(specs, "doc_id", "spec")


@query("""+ g AS (SELECT DISTINCT doc_id, page FROM words), c AS (SELECT doc_id, coalesce(string_agg(page, ',' ORDER BY page) FILTER ((doc_id + page) % 5 = 0), '') AS missing FROM g GROUP BY doc_id)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN missing = '' THEN 'ok' ELSE 'partial' END WHEN 1 THEN 'partial' ELSE 'failed' END AS status, missing FROM c""", with_words=True)
def candidate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = source.words(spark, sf_dir).select(*PAGE).distinct().withColumn("covered", (F.col("doc_id") + F.col("page")) % 5 != 0)
    outcome = F.element_at(F.array(*map(F.lit, ("success", "partial_success", "failure"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return reconcile.coverage_status(pages.withColumn("outcome", outcome), "doc_id", "outcome")


@query("SELECT doc_id, page, vline, k, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN vline % 5 <> 4 THEN vline * 3 % 4 END NULLS LAST, vline, k) - 1 AS order_pos FROM words", with_words=True)
def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = source.words(spark, sf_dir).select(*PAGE, "vline", "k").withColumn("cluster", F.when(F.col("vline") % 5 != 4, F.col("vline") * 3 % 4))
    return reconcile.cluster_order(cells, PAGE, "cluster", ["vline", "k"]).drop("cluster")


@query("SELECT doc_id, page, vline, k, round(CASE WHEN vline % 2 = 0 THEN greatest(0, conf - 60) ELSE least(100, conf / 50 * 100) END, 6) AS confidence FROM words", with_words=True)
def ocr_confidence_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("vline") % 2 == 0
    made = reconcile.confidence(F.when(even, F.col("conf") - 60).otherwise(F.col("conf") / 50), F.when(even, "tesseract").otherwise("rapidocr"))
    return source.words(spark, sf_dir).select(*PAGE, "vline", "k", F.round(made, 6).alias("confidence"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' WHEN 'fr' THEN 'fra' WHEN 'pt' THEN 'por' WHEN 'it' THEN 'ita' ELSE lang END || CASE WHEN doc_id % 4 = 0 THEN '+xx' ELSE '' END AS codes, ['heading', 'heading', 'list_item', 'table', 'caption', 'other', 'other', NULL][doc_id % 8 + 1] AS hint FROM documents")
def engine_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("doc_id") % 4 == 0, F.array("lang", F.concat(F.upper("lang"), F.lit(" ")), F.lit("xx"))).otherwise(F.array("lang", F.upper("lang")))
    label = F.element_at(F.array(*map(F.lit, (*reconcile.HINTS, "text"))), (F.col("doc_id") % 8 + 1).cast("int"))
    return _read(spark, sf_dir, "documents").select("doc_id", reconcile.engine_languages(asked).alias("codes"), reconcile.hint_of(label).alias("hint"))


LONG = """WITH e AS (SELECT doc_id, lang, text, engine, CAST((n_chars + doc_id) % 31 AS DOUBLE) / 300 * f AS m FROM documents, (VALUES ('A', 1), ('B', 3)) v(engine, f)),
long_ AS (SELECT doc_id, lang, engine, 'cer' AS metric, m AS value FROM e UNION ALL SELECT doc_id, lang, engine, 'numeric_token_exact_match', CASE WHEN regexp_matches(text, '[0-9]') THEN 1 - m / 4 END FROM e
 UNION ALL SELECT doc_id, lang, engine, 'diacritic_accuracy', CASE WHEN regexp_matches(text, '[áéíóúñäöüàèç]') THEN 1 - m / 2 END FROM e UNION ALL SELECT doc_id, lang, engine, 'reading_order_kendall_tau', 1 - m FROM e
 UNION ALL SELECT doc_id, lang, engine, 'insertion_rate', m / 2 FROM e UNION ALL SELECT doc_id, lang, engine, 'deletion_rate', m / 3 FROM e UNION ALL SELECT doc_id, lang, engine, 'language_detection_accuracy', CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END FROM e),
w_ AS (SELECT * FROM (VALUES ('cer', 0.3::DOUBLE, 1), ('numeric_token_exact_match', 0.15, 0), ('diacritic_accuracy', 0.15, 0), ('table_cell_cer', 0.1, 1), ('reading_order_kendall_tau', 0.1, 2), ('insertion_rate', 0.05, 1), ('deletion_rate', 0.05, 1), ('language_detection_accuracy', 0.1, 0)) w(metric, w, kind)),
"""
_GOOD = "sum(w * CASE kind WHEN 1 THEN 1 - greatest(0, least(1, value)) WHEN 2 THEN (greatest(-1, least(1, value)) + 1) / 2 ELSE greatest(0, least(1, value)) END) / sum(w)"
FLOORS = LONG + f"""means_ AS (SELECT engine, lang, metric, round(avg(value), 9) AS value FROM long_ GROUP BY ALL),
totals_ AS (SELECT engine, lang, {_GOOD} AS total FROM means_ JOIN w_ USING (metric) WHERE value IS NOT NULL GROUP BY ALL),
wide_ AS (SELECT engine, lang, max(value) FILTER (metric = 'cer') AS cer, max(value) FILTER (metric = 'diacritic_accuracy') AS d, max(value) FILTER (metric = 'numeric_token_exact_match') AS n FROM means_ GROUP BY ALL),
floor_ AS (SELECT engine, lang, total, d >= 0.9::DOUBLE AS diacritic_ok, n >= 0.95::DOUBLE AS numeric_ok, total >= 0.8::DOUBLE AND cer <= 0.2::DOUBLE AND coalesce(d >= 0.9::DOUBLE, true) AND coalesce(n >= 0.95::DOUBLE, true) AS passed FROM totals_ JOIN wide_ USING (engine, lang))
"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars", F.explode(F.create_map(F.lit("A"), F.lit(1), F.lit("B"), F.lit(3))).alias("engine", "f"))
    m = ((F.col("n_chars") + F.col("doc_id")) % 31).cast("double") / 300 * F.col("f")
    has = lambda p: F.regexp_like("text", F.lit(p))
    values = {"cer": m, "numeric_token_exact_match": F.when(has("[0-9]"), 1 - m / 4), "diacritic_accuracy": F.when(has("[áéíóúñäöüàèç]"), 1 - m / 2), "reading_order_kendall_tau": 1 - m, "insertion_rate": m / 2, "deletion_rate": m / 3, "language_detection_accuracy": F.when(F.col("doc_id") % 10 == 0, 0.0).otherwise(1.0)}
    return docs.select("doc_id", "lang", "engine", F.explode(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))).alias("metric", "value"))


def _floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.floors(metrics.language_means(_long(spark, sf_dir), ["engine", "lang"]), ["engine", "lang"])


@query(LONG.rstrip().rstrip(",") + f" SELECT doc_id, engine, round({_GOOD}, 6) AS total FROM long_ JOIN w_ USING (metric) WHERE value IS NOT NULL GROUP BY ALL")
def weighted_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weighted_total(_long(spark, sf_dir), ["doc_id", "engine"]).withColumn("total", F.round("total", 6))


@query(FLOORS + "SELECT engine, lang, round(total, 6) AS total, diacritic_ok, numeric_ok, passed, NOT passed AS regression FROM floor_")
def language_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _floors(spark, sf_dir).withColumn("total", F.round("total", 6))


@query(FLOORS + "SELECT engine, round(avg(total), 6) AS total FROM floor_ GROUP BY engine HAVING bool_and(passed) ORDER BY round(avg(total), 9) DESC, engine LIMIT 1")
def engine_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_engine(_floors(spark, sf_dir)).select("engine", F.round("total", 6).alias("total"))


@query("WITH pairs AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), ''), lambda c: strip_accents(c) <> c) AS rs, list_filter(string_split(replace(coalesce(text, ''), 'é', 'e'), ''), lambda c: strip_accents(c) <> c) AS hs FROM documents)" + RECALL)
def diacritic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    take = lambda t: F.regexp_extract_all(t, F.lit(metrics.ACCENTED), F.lit(1))
    return validate.multiset_recall(_read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", take(F.col("text")), take(F.replace("text", F.lit("é"), F.lit("e")))).withColumn("recall", F.round("recall", 6))


@query("""WITH c AS (SELECT o_custkey, o_orderstatus || o_orderpriority AS r, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
h AS (SELECT *, CASE WHEN o_custkey % 3 = 0 AND i = n THEN '' ELSE replace(r, 'URGENT', 'URG') END AS h FROM c)
SELECT o_custkey, round(avg(CASE WHEN length(r) > 0 THEN levenshtein(r, h) / length(r) WHEN length(h) = 0 THEN 0 ELSE 1 END), 6) AS cell_cer FROM h GROUP BY o_custkey""")
def table_cell_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat("o_orderstatus", "o_orderpriority").alias("c")))), lambda x: x["c"])
    ref = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(cells.alias("r"))
    seen = F.transform(F.when(F.col("o_custkey") % 3 == 0, F.slice("r", F.lit(1), F.size("r") - 1)).otherwise(F.col("r")), lambda c: F.replace(c, F.lit("URGENT"), F.lit("URG")))
    return ref.select("o_custkey", F.round(metrics.cell_error_rate(F.col("r"), seen), 6).alias("cell_cer"))


VOTES = "(VALUES " + ", ".join(f"('{w}', '{code}')" for code, ws in metrics.STOP_WORDS.items() for w in ws.split()) + ") s(w, code)"
DETECTED = rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '(\p{{L}}+)', 1)) AS w FROM documents), c AS (SELECT doc_id, code, count(*) AS n FROM t JOIN {VOTES} USING (w) GROUP BY ALL),
d AS (SELECT doc_id, lang, coalesce(code, 'und') AS detected FROM documents LEFT JOIN (SELECT doc_id, code FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) AS r FROM c) WHERE r = 1) USING (doc_id))
"""


@query(DETECTED + "SELECT doc_id, detected FROM d")
def language_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.detected_language(_read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "detected")


@query(DETECTED + "SELECT lang, count(*) AS docs, count(*) FILTER (lang = detected) AS correct, round(avg((lang = detected)::INT), 6) AS accuracy FROM d GROUP BY lang")
def lang_detect_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.detected_language(_read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id", "text")
    hit = F.col("lang") == F.col("detected")
    return found.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(hit).alias("correct"), F.round(F.avg(hit.cast("int")), 6).alias("accuracy"))


@query("""WITH r AS (SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 + 1 AS page FROM orders), p AS (SELECT o_custkey, page, CASE WHEN (o_custkey + page // 3) % 2 = 0 THEN 'order|status' ELSE 'order|status|total' END AS header, count(*) AS n FROM r GROUP BY ALL),
t AS (SELECT *, sum(CASE WHEN before_page = page - 1 AND before_ = header THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY page ROWS UNBOUNDED PRECEDING) - 1 AS table_no FROM (SELECT *, lag(page) OVER w AS before_page, lag(header) OVER w AS before_ FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY page)))
SELECT o_custkey, CAST(table_no AS INTEGER) AS table_no, min(page) AS first_page, max(page) AS last_page, min(header) AS header, CAST(sum(n) AS BIGINT) AS body_rows, count(*) - 1 AS headers_dropped FROM t GROUP BY o_custkey, table_no""")
def table_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").selectExpr("o_custkey", "cast((row_number() over (partition by o_custkey order by o_orderkey) - 1) div 4 + 1 as bigint) as page")
    parts = rows.groupBy("o_custkey", "page").agg(F.count("*").alias("rows")).withColumn("header", F.expr("if((o_custkey + page div 3) % 2 = 0, 'order|status', 'order|status|total')"))
    return delivery.stitched_tables(parts, "o_custkey")


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS t FROM documents),
m AS (SELECT doc_id, string_agg(CASE WHEN regexp_matches(t, '^[0-9]+[.)] ') THEN t WHEN regexp_matches(t, '^[-*] ') THEN '- ' || substr(t, 3) WHEN i = 0 THEN '# ' || t ELSE regexp_replace(t, '^([#>*+_`-]|[0-9]+\.)', '\\\1') END, chr(10) || chr(10) ORDER BY i) AS markdown FROM l GROUP BY doc_id)
SELECT doc_id, length(markdown) AS n_chars, sha256(markdown) AS markdown_sha256 FROM m""")
def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "text"))
    made = delivery.markdown(blocks.withColumn("kind", delivery.block_kind(F.col("text"), F.col("block"))), "doc_id")
    return made.select("doc_id", F.length("markdown").cast("long").alias("n_chars"), F.sha2("markdown", 256).alias("markdown_sha256"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS t, CASE WHEN doc_id % 13 = 0 THEN replace(text, 'tion', 'ti0n') ELSE text END AS d FROM documents)
SELECT doc_id, count(*) AS spans, count(*) FILTER (string_split(d, chr(10))[i] <> t) AS differing, true AS in_order FROM l GROUP BY doc_id""")
def verify_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").where("text is not null")
    blocks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "text"))
    text = F.when(F.col("doc_id") % 13 == 0, F.replace("text", F.lit("tion"), F.lit("ti0n"))).otherwise(F.col("text"))
    return delivery.verified(validate.spans(blocks, "doc_id", "block", "text"), docs.select("doc_id", F.replace(text, F.lit("\n"), F.lit("\n\n")).alias("delivered")), "doc_id")


@query(r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '(R\$|US\$|€|£|\d+x\b|\d[\d.,]*%?)', 1) AS rs, regexp_extract_all(replace(text, '7', '1'), '(R\$|US\$|€|£|\d+x\b|\d[\d.,]*%?)', 1) AS hs FROM documents),
c AS (SELECT doc_id, token, sum(r)::BIGINT AS in_source, sum(h)::BIGINT AS in_delivered FROM (SELECT doc_id, unnest(rs) AS token, 1 AS r, 0 AS h FROM p UNION ALL SELECT doc_id, unnest(hs), 0, 1 FROM p) GROUP BY ALL)
SELECT *, CASE WHEN in_delivered > in_source THEN 'not_in_source' ELSE 'missing' END AS defect, CASE WHEN in_delivered > in_source THEN 'reconcile' ELSE 'rerender' END AS route FROM c WHERE in_source <> in_delivered""")
def numeric_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    take = lambda t: F.regexp_extract_all(t, F.lit(validate.NUMBER), F.lit(1))
    return delivery.token_defects(_read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", take(F.col("text")), take(F.replace("text", F.lit("7"), F.lit("1"))))


@query("""WITH f AS (SELECT user_id, bool_or(event_id % 97 = 0) AS o, bool_or(event_id % 41 = 0) AS x, bool_or(event_id % 5 = 0) AS same, bool_or(event_id % 2 = 0) AS d, bool_or(event_id % 3 = 0) AS p, bool_or(event_id % 7 = 0) AS a FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN o THEN 'unresolved' WHEN x THEN 'delivery_blocked_verification_failed' WHEN same AND (NOT d OR p) THEN 'delivered' WHEN a THEN 'authorized' ELSE 'resolved_unauthorized' END AS state, NOT o AND a AND NOT x AND (NOT d OR p) AS may_publish FROM f""")
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda n: F.bool_or(F.col("event_id") % n == 0)
    facts = _read(spark, sf_dir, "events").groupBy("user_id").agg(some(97).alias("o"), some(41).alias("x"), some(5).alias("same"), some(2).alias("d"), some(3).alias("p"), some(7).alias("a"))
    o, x, same, d, p, a = (F.col(c) for c in ("o", "x", "same", "d", "p", "a"))
    return facts.select("user_id", delivery.run_state(o, x, same, d, p, a).alias("state"), delivery.may_publish(o, a, ~x, d, p).alias("may_publish"))
