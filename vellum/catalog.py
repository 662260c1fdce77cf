"""The queries of the engine over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import layout, reliability, review, validate
from vellum.sources import words as source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PAGE = ["doc_id", "page"]


def query(sql: str | None = None, *, with_words: bool = False):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {source.SQL.strip()}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}" if with_words else sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BANDED = """+
sorted_ AS (SELECT *, bottom - top AS h, row_number() OVER (PARTITION BY doc_id, page ORDER BY top, vline, k) AS r FROM words),
fold_ AS (
  SELECT doc_id, page, r, vline, k, 0 AS band, top AS s, 1 AS n, h AS m FROM sorted_ WHERE r = 1
  UNION ALL
  SELECT w.doc_id, w.page, w.r, w.vline, w.k,
    CASE WHEN abs(w.top - f.s / f.n) <= greatest(1.0, 0.6 * greatest(f.m, w.h)) THEN f.band ELSE f.band + 1 END,
    CASE WHEN abs(w.top - f.s / f.n) <= greatest(1.0, 0.6 * greatest(f.m, w.h)) THEN f.s + w.top ELSE w.top END,
    CASE WHEN abs(w.top - f.s / f.n) <= greatest(1.0, 0.6 * greatest(f.m, w.h)) THEN f.n + 1 ELSE 1 END,
    CASE WHEN abs(w.top - f.s / f.n) <= greatest(1.0, 0.6 * greatest(f.m, w.h)) THEN greatest(f.m, w.h) ELSE w.h END
  FROM fold_ f JOIN sorted_ w ON w.doc_id = f.doc_id AND w.page = f.page AND w.r = f.r + 1
),
banded AS (SELECT w.*, f.band FROM words w JOIN fold_ f USING (doc_id, page, vline, k))
"""
ISLANDS = """,
marked_ AS (SELECT doc_id, page, x0, x1, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT doc_id, page, x0, x1 FROM words)),
numbered_ AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR x0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS island FROM marked_),
islands AS (SELECT doc_id, page, island, min(x0) AS x0, max(x1) AS x1 FROM numbered_ GROUP BY ALL)
"""
COLUMNS = BANDED + ISLANDS + """,
gaps_ AS (SELECT doc_id, page, x1 AS a, lead(x0) OVER (PARTITION BY doc_id, page ORDER BY island) AS b FROM islands),
total_ AS (SELECT doc_id, page, count(DISTINCT band) AS lines FROM banded GROUP BY ALL),
support_ AS (SELECT g.doc_id, g.page, g.a, g.b, count(DISTINCT CASE WHEN w.x0 < g.a THEN w.band END) AS l, count(DISTINCT CASE WHEN w.x0 >= g.b THEN w.band END) AS r
  FROM gaps_ g JOIN banded w USING (doc_id, page) WHERE g.b - g.a >= 0.02 * 612 GROUP BY ALL),
edges_ AS (SELECT doc_id, page, unnest([0.0::DOUBLE, 612.0::DOUBLE]) AS edge FROM total_ UNION ALL
  SELECT doc_id, page, (a + b) / 2 FROM support_ JOIN total_ USING (doc_id, page) WHERE l >= greatest(3.0, 0.15 * lines) AND r >= greatest(3.0, 0.15 * lines)),
columns_ AS (SELECT * FROM (SELECT doc_id, page, CAST(row_number() OVER w - 1 AS INTEGER) AS col, edge AS low, lead(edge) OVER w AS high FROM edges_ WINDOW w AS (PARTITION BY doc_id, page ORDER BY edge)) WHERE high IS NOT NULL)
"""


@query("SELECT doc_id, page, vline, k, text, x0, top, x1, bottom, conf FROM words", with_words=True)
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.words(spark, sf_dir)


@query(BANDED + "SELECT doc_id, page, vline, k, band FROM banded", with_words=True)
def line_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_bands(source.words(spark, sf_dir)).select(*PAGE, "vline", "k", "band")


@query("+" + ISLANDS.strip().lstrip(",") + "SELECT * FROM islands", with_words=True)
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merged_intervals(source.words(spark, sf_dir))


@query(COLUMNS + "SELECT * FROM columns_", with_words=True)
def column_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_ranges(source.words(spark, sf_dir), source.WIDTH)


@query(COLUMNS + """, last_ AS (SELECT doc_id, page, max(col) AS last FROM columns_ GROUP BY ALL),
placed2_ AS (SELECT w.*, coalesce(c.col, l.last) AS col FROM banded w JOIN last_ l USING (doc_id, page) LEFT JOIN columns_ c ON c.doc_id = w.doc_id AND c.page = w.page AND (w.x0 + w.x1) / 2 >= c.low AND (w.x0 + w.x1) / 2 < c.high),
seg_ AS (SELECT doc_id, page, col, band, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom, string_agg(text, ' ' ORDER BY x0, vline, k) AS text FROM placed2_ GROUP BY ALL)
SELECT *, substr(sha1(page || ':[' || CAST(round_even(x0, 0) AS BIGINT) || ', ' || CAST(round_even(top, 0) AS BIGINT) || ', ' || CAST(round_even(x1, 0) AS BIGINT) || ', ' || CAST(round_even(bottom, 0) AS BIGINT) || ']:' || sha1(text)), 1, 12) AS segment_id,
  CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY col, top, band) - 1 AS INTEGER) AS order_pos FROM seg_""", with_words=True)
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_segments(source.pages(spark, sf_dir), source.WIDTH)


EVIDENCE = """+
ev_ AS (SELECT doc_id, page, CAST(floor((top + bottom) / 2 / 66.0) AS INTEGER) AS band, (doc_id % 7 = 0 AND (vline + k) % 9 <> 0) AS scan,
  CASE WHEN doc_id % 11 = 0 THEN replace(text, 'é', 'Ã©') ELSE text END AS shown, text, (x1 - x0) * (bottom - top) AS area FROM words),
evidence AS (SELECT doc_id, page, band, CAST(sum(CASE WHEN NOT scan THEN length(text) ELSE 0 END) AS BIGINT) AS chars, sum(CASE WHEN NOT scan THEN area ELSE 0 END) / (612.0 * 66.0) AS native_ratio,
  CAST(sum(CASE WHEN NOT scan THEN len(regexp_extract_all(shown, '[ÂÃ][\\x{80}-\\x{BF}]')) ELSE 0 END) AS BIGINT) AS gibberish, sum(area) / (612.0 * 66.0) AS ink FROM ev_ WHERE band BETWEEN 0 AND 11 GROUP BY ALL),
classed AS (SELECT *, CASE WHEN chars > 0 AND gibberish > 0 THEN 'needs_ocr' WHEN chars > 0 AND ink >= 0.02 AND native_ratio < 0.015 THEN 'needs_ocr' WHEN chars > 0 THEN 'native_ok' WHEN ink < 0.02 THEN 'blank' ELSE 'needs_ocr' END AS kind,
  CASE WHEN chars > 0 THEN CASE WHEN gibberish > 0 THEN 'encoding_gibberish' WHEN ink >= 0.02 AND native_ratio < 0.015 THEN 'insufficient_native_coverage' END WHEN ink >= 0.02 THEN 'no_native_text' END AS reason FROM evidence),
classes AS (SELECT *, CASE WHEN bad = 0 THEN 'native_text_sufficient' WHEN bad / greatest(inked, 1) >= 0.85 THEN 'ocr_required' ELSE 'hybrid_native_and_ocr' END AS page_class
  FROM (SELECT doc_id, page, count(*) FILTER (kind = 'needs_ocr') AS bad, count(*) FILTER (kind <> 'blank') AS inked FROM classed GROUP BY ALL))
"""


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.band_class(reliability.band_evidence(source.text_layer(source.words(spark, sf_dir)), source.WIDTH, source.HEIGHT))


@query(EVIDENCE + "SELECT doc_id, page, band, chars, round(native_ratio, 6) AS native_ratio, gibberish, round(ink, 6) AS ink, kind, reason FROM classed", with_words=True)
def band_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classed(spark, sf_dir).withColumn("native_ratio", F.round("native_ratio", 6)).withColumn("ink", F.round("ink", 6))


@query(EVIDENCE + "SELECT doc_id, page, bad, inked, page_class FROM classes", with_words=True)
def page_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.page_class(_classed(spark, sf_dir))


@query(EVIDENCE + """SELECT doc_id, page, -1 AS band, 0.0::DOUBLE AS top, 792.0::DOUBLE AS bottom, 'whole_page_native_text_unreliable' AS reason FROM classes WHERE page_class = 'ocr_required'
UNION ALL SELECT c.doc_id, c.page, band, band * 66.0::DOUBLE, (band + 1) * 66.0::DOUBLE, reason FROM classed c SEMI JOIN (SELECT * FROM classes WHERE page_class = 'hybrid_native_and_ocr') p ON p.doc_id = c.doc_id AND p.page = c.page WHERE kind = 'needs_ocr'""", with_words=True)
def ocr_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed = _classed(spark, sf_dir)
    return reliability.ocr_regions(classed, reliability.page_class(classed), source.HEIGHT)


OCR = """+
ocr_ AS (SELECT doc_id, page, CAST(vline // 10 AS INTEGER) AS block, CAST(vline // 5 AS INTEGER) AS par, vline AS line, string_agg(text, ' ' ORDER BY k, text) AS text, min(greatest(conf, 0.0)) AS confidence,
  min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM words WHERE trim(text) <> '' GROUP BY ALL)
"""


@query(OCR + "SELECT * FROM ocr_", with_words=True)
def ocr_line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.ocr_lines(source.words(spark, sf_dir))


@query(OCR + "SELECT doc_id, page, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (confidence < 70) AS low_confidence, count(*) AS lines FROM ocr_ GROUP BY ALL", with_words=True)
def region_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.region_records(reliability.ocr_lines(source.words(spark, sf_dir))).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("""+ lines2_ AS (SELECT doc_id, page, vline, min(top) AS top, string_agg(text, ' ' ORDER BY k, text) AS text FROM words GROUP BY ALL)
SELECT doc_id, CAST(round_even(top, 0) AS INTEGER) AS y, lower(text) AS text, count(DISTINCT page) AS pages FROM lines2_ GROUP BY ALL HAVING count(DISTINCT page) >= 3""", with_words=True)
def header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_edges(source.words(spark, sf_dir))


LOG = """WITH log AS (SELECT user_id AS key, event_id - (event_id % 37 = 0)::INT AS seq, sha256(user_id || ':' || event_id) AS resolution_id, CAST(value AS VARCHAR) AS value_,
  lag(sha256(user_id || ':' || event_id)) OVER (PARTITION BY user_id ORDER BY event_id) AS before_, event_id FROM events),
faulty AS (SELECT key, seq, resolution_id, event_type AS value, CASE WHEN l.event_id % 53 = 0 THEN NULL WHEN l.event_id % 59 = 0 THEN 'x' ELSE before_ END AS supersedes FROM log l JOIN events e ON e.event_id = l.event_id),
chained AS (SELECT f.*, CASE WHEN count(*) OVER (PARTITION BY seq) > 1 THEN 'duplicate_sequence'
  WHEN lag(resolution_id) OVER w IS NULL AND supersedes IS NOT NULL THEN 'first_supersedes' WHEN lag(resolution_id) OVER w IS NOT NULL AND supersedes IS NULL THEN 'missing_supersedes'
  WHEN lag(resolution_id) OVER w <> supersedes THEN 'not_the_one_before' END AS violation FROM faulty f WINDOW w AS (PARTITION BY key ORDER BY seq, resolution_id))
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a review log: event ids count, users are keys; some numbers repeat and some links are broken."""
    events = _read(spark, sf_dir, "events")
    own = F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string")), 256)
    before = F.lag(own).over(Window.partitionBy("user_id").orderBy("event_id"))
    return events.select(F.col("user_id").alias("key"), (F.col("event_id") - F.when(F.col("event_id") % 37 == 0, 1).otherwise(0)).alias("seq"), own.alias("resolution_id"), F.col("event_type").alias("value"), F.when(F.col("event_id") % 53 == 0, None).when(F.col("event_id") % 59 == 0, "x").otherwise(before).alias("supersedes"))


@query(LOG + "SELECT key, seq, resolution_id, violation FROM chained WHERE violation IS NOT NULL")
def resolution_chain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.chain(_log(spark, sf_dir)).where("violation is not null").select("key", "seq", "resolution_id", "violation")


@query(LOG + "SELECT key, count(*) AS records, arg_max(resolution_id, (seq, resolution_id)) AS resolution_id, arg_max(value, (seq, resolution_id)) AS value, arg_min(violation, (seq, resolution_id)) FILTER (violation IS NOT NULL) AS failed FROM chained GROUP BY key")
def resolution_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.current(review.chain(_log(spark, sf_dir)))


@query("SELECT o_custkey AS key, sha256(string_agg(o_orderkey || '=' || o_orderstatus, chr(10) ORDER BY o_orderkey || '=' || o_orderstatus)) AS digest FROM orders GROUP BY o_custkey")
def resolution_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(review.set_digest(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).alias("digest"))


@query("SELECT doc_id, substr(sha256('1.0' || chr(10) || source || chr(10) || lang || chr(10) || n_chars || chr(10) || doc_id), 1, 16) AS run_id FROM documents")
def run_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", review.run_id(F.lit("1.0"), "source", "lang", F.col("n_chars").cast("string"), F.col("doc_id").cast("string")).alias("run_id"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(a, 'e', 'E') ELSE a END AS selected, CASE WHEN doc_id % 5 = 0 AND replace(a, 'e', 'E') <> a AND replace(a, 'e', 'E') <> b THEN 'reject' ELSE 'accept' END AS verdict
FROM (SELECT doc_id, text AS a, regexp_replace(text, '[ \\n]+', ' ', 'g') AS b FROM documents)""")
def guard_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a")).withColumn("b", F.regexp_replace("a", "[ \\n]+", " "))
    picked = F.when(F.col("doc_id") % 5 == 0, F.replace("a", F.lit("e"), F.lit("E"))).otherwise(F.col("a"))
    return docs.select("doc_id", picked.alias("selected"), review.guard_literal(picked, F.array("a", "b")).alias("verdict"))


#: DuckDB measures distances in bytes: letters of more than one become control characters there, which the texts don't hold.
_LETTERS = "èéêÈÉÊçÇíÍñÑóÓöÖüÜäÄßáàâîôûúÁ"
_ONE_BYTE = "translate({}, '" + _LETTERS + "', " + " || ".join(f"chr({c})" for c in [*range(1, 10), *range(11, 32)][: len(_LETTERS)]) + ")"


@query("+ p AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY vline, k) AS r FROM words GROUP BY ALL), q AS (SELECT doc_id, page, " + _ONE_BYTE.format("r") + " AS r, " + _ONE_BYTE.format("replace(replace(r, 'e', ''), 'th', 't h')") + """ AS h FROM p)
SELECT doc_id, page, round(CASE WHEN length(r) > 0 THEN levenshtein(r, h) / length(r) WHEN length(h) = 0 THEN 0.0 ELSE 1.0 END, 6) AS cer FROM q""", with_words=True)
def cer(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    pages = source.page_texts(spark, sf_dir, *more).withColumnRenamed("text", "r")
    damaged = F.replace(F.replace("r", F.lit("e"), F.lit("")), F.lit("th"), F.lit("t h"))
    return pages.select(*PAGE, F.round(validate.character_error_rate(F.col("r"), damaged), 6).alias("cer"), *more)


RECALL = """, n AS (SELECT doc_id, t, sum(r) AS r, sum(h) AS h FROM (SELECT doc_id, unnest(rs) AS t, 1 AS r, 0 AS h FROM pairs UNION ALL SELECT doc_id, unnest(hs), 0, 1 FROM pairs) GROUP BY ALL),
m AS (SELECT doc_id, sum(r) AS tokens, sum(least(r, h)) AS matched FROM n GROUP BY ALL)
SELECT p.doc_id, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, CAST(coalesce(matched, 0) AS BIGINT) AS matched, round(CASE WHEN coalesce(tokens, 0) = 0 THEN 1.0 ELSE matched / tokens END, 6) AS recall FROM pairs p LEFT JOIN m USING (doc_id)"""


@query("WITH pairs AS (SELECT doc_id, regexp_extract_all(text, '(R\\$|US\\$|€|£|\\d+x\\b|\\d[\\d.,]*%?)', 1) AS rs, regexp_extract_all(replace(text, '7', '1'), '(R\\$|US\\$|€|£|\\d+x\\b|\\d[\\d.,]*%?)', 1) AS hs FROM documents)" + RECALL)
def numeric_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    take = lambda t: F.regexp_extract_all(t, F.lit(validate.NUMBER), F.lit(1))
    return validate.multiset_recall(docs.select("doc_id", "text"), "doc_id", take(F.col("text")), take(F.replace("text", F.lit("7"), F.lit("1")))).withColumn("recall", F.round("recall", 6))


@query("WITH pairs AS (SELECT doc_id, regexp_extract_all(text, '([\\p{L}\\p{N}]+(?:[.,][\\p{L}\\p{N}]+)*|R\\$|US\\$|%)', 1) AS rs, regexp_extract_all(replace(text, 'tion', ''), '([\\p{L}\\p{N}]+(?:[.,][\\p{L}\\p{N}]+)*|R\\$|US\\$|%)', 1) AS hs FROM documents)" + RECALL)
def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    take = lambda t: F.regexp_extract_all(t, F.lit(validate.TOKEN), F.lit(1))
    return validate.multiset_recall(docs.select("doc_id", "text"), "doc_id", take(F.col("text")), take(F.replace("text", F.lit("tion"), F.lit("")))).withColumn("recall", F.round("recall", 6))


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS r FROM conversations),
p AS (SELECT a.conv_id, sign(CAST(b.r AS BIGINT) - CAST(a.r AS BIGINT)) AS s FROM t a JOIN t b ON a.conv_id = b.conv_id AND (a.turn < b.turn OR a.turn = b.turn AND a.r < b.r))
SELECT c.conv_id, round(CASE WHEN n < 2 THEN 1.0 ELSE coalesce(s, 0) / (n * (n - 1) / 2) END, 6) AS tau FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id) c LEFT JOIN (SELECT conv_id, sum(s) AS s FROM p GROUP BY conv_id) USING (conv_id)""")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.length("text"), "turn")).alias("r"))
    orders = ranked.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "r"))), lambda x: x["r"]).alias("order"))
    return orders.select("conv_id", F.round(validate.kendall_tau(F.col("order")), 6).alias("tau"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(t, '(\\p{L})-\\n(\\p{Ll})', '\\1\\2', 'g'), '\\n', ' ', 'g') AS reflowed FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, 'tion', 'ti-' || chr(10) || 'on') ELSE text END AS t FROM documents)""")
def reflow_dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("tion"), F.lit("ti-\non"))).otherwise(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", validate.reflow(F.split(text, "\n")).alias("reflowed"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS block, CAST(coalesce(sum(length(line) + 2) OVER w, 0) AS BIGINT) AS "start", CAST(coalesce(sum(length(line) + 2) OVER w, 0) + length(line) AS BIGINT) AS "end" FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def render_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    return validate.spans(blocks, "doc_id", "block", "line").select("doc_id", "block", "start", "end")
