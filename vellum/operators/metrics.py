"""Roll-ups of engine metrics: weighted totals, floors per language, the choice of an engine, language detection."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the metrics; those that are error rates; the floors.
WEIGHTS = {"cer": 0.30, "numeric_token_exact_match": 0.15, "diacritic_accuracy": 0.15, "table_cell_cer": 0.10, "reading_order_kendall_tau": 0.10, "insertion_rate": 0.05, "deletion_rate": 0.05, "language_detection_accuracy": 0.10}
ERRORS = ("cer", "table_cell_cer", "insertion_rate", "deletion_rate")
LEAST_TOTAL, MOST_CER, LEAST_DIACRITIC, LEAST_NUMERIC = 0.80, 0.20, 0.90, 0.95
#: Frequent words by language, our own choice for detection.
STOP_WORDS = {"en": "the and of to is that with for was are this", "de": "der die und das ist nicht ein eine mit von auf", "es": "el los las una que por con para del como", "fr": "le les des une est dans pour que avec sur", "pt": "os uma um que com para do da em mais", "it": "il di che una per con del sono gli della"}


def _accented() -> str:
    """A class of the letters of the Latin blocks that decompose into a letter and marks, as ranges."""
    marked = [c for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if any(map(unicodedata.combining, unicodedata.normalize("NFD", chr(c))))]
    firsts = [c for c in marked if c - 1 not in marked]
    lasts = [c for c in marked if c + 1 not in marked]
    return "([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(firsts, lasts, strict=True)) + "])"


ACCENTED = _accented()


def goodness(metric: Column, value: Column) -> Column:
    """A metric as 0 (bad) to 1 (good)."""
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return F.when(metric.isin(*ERRORS), 1.0 - unit).when(metric == "reading_order_kendall_tau", (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)) + 1) / 2).otherwise(unit)


def weight(metric: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))[metric]


def weighted_total(long: DataFrame, keys: list[str]) -> DataFrame:
    """long(keys, metric, value): the weighted mean of goodness; metrics that are absent don't count."""
    known = long.where(F.col("value").isNotNull()).withColumn("w", weight(F.col("metric"))).where("w is not null")
    return known.groupBy(*keys).agg((F.sum(F.col("w") * goodness(F.col("metric"), F.col("value"))) / F.sum("w")).alias("total"))


def language_means(long: DataFrame, keys: list[str]) -> DataFrame:
    """Means per metric, to nine digits, so that sums in another order are the same."""
    return long.groupBy(*keys, "metric").agg(F.round(F.avg("value"), 9).alias("value"))


def floors(means: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a language clears every floor that applies; the others count as passed, and have no verdict."""
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    wide = means.groupBy(*keys).agg(of("cer").alias("cer"), of("diacritic_accuracy").alias("diacritic"), of("numeric_token_exact_match").alias("numeric"))
    made = wide.join(weighted_total(means, keys), keys).withColumn("diacritic_ok", F.col("diacritic") >= LEAST_DIACRITIC).withColumn("numeric_ok", F.col("numeric") >= LEAST_NUMERIC)
    passed = (F.col("total") >= LEAST_TOTAL) & (F.col("cer") <= MOST_CER) & F.coalesce("diacritic_ok", F.lit(True)) & F.coalesce("numeric_ok", F.lit(True))
    return made.select(*keys, "total", "diacritic_ok", "numeric_ok", passed.alias("passed"), (~passed).alias("regression"))


def best_engine(judged: DataFrame) -> DataFrame:
    """The engine with the best mean total among those that clear the floor in every language; ties: the smaller name."""
    engines = judged.groupBy("engine").agg(F.round(F.avg("total"), 9).alias("total"), F.bool_and("passed").alias("ok")).where("ok")
    return engines.agg(F.max(F.col("total")).alias("total"), F.min_by("engine", F.struct(-F.col("total"), F.col("engine"))).alias("engine")).where("engine is not null")


def cell_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Mean error rate of cells paired by place, absent ones empty; 0 for two empty tables."""
    pairs = F.zip_with(F.coalesce(reference, F.array()), F.coalesce(hypothesis, F.array()), lambda r, h: F.struct(F.coalesce(r, F.lit("")).alias("r"), F.coalesce(h, F.lit("")).alias("h")))
    rate = lambda p: F.when(F.length(p["r"]) > 0, F.levenshtein(p["r"], p["h"]) / F.length(p["r"])).when(F.length(p["h"]) == 0, 0.0).otherwise(1.0)
    return F.when(F.size(pairs) == 0, 0.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda a, p: a + rate(p)) / F.size(pairs))


def detected_language(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document the language with most frequent words found (ties: the smaller code), ``und`` without any.

    The lookup is a constant map inside the expression: no join, and one row a document and language after the map side.
    """
    by_word: dict[str, list[str]] = {}
    for code, words in STOP_WORDS.items():
        for word in words.split():
            by_word.setdefault(word, []).append(code)
    lookup = F.create_map(*(x for word, codes in by_word.items() for x in (F.lit(word), F.array(*map(F.lit, codes)))))
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(\\p{L}+)"), F.lit(1))
    votes = docs.select(key, F.explode(tokens).alias("w")).select(key, F.explode(lookup[F.col("w")]).alias("code"))
    counts = votes.groupBy(key, "code").agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.min_by("code", F.struct(-F.col("n"), F.col("code"))).alias("detected"))
    return docs.join(best, key, "left").withColumn("detected", F.coalesce("detected", F.lit("und")))


#: The languages that detection may name.
SUPPORTED = ("pt", "en", "es", "fr", "it", "de")


def language_result(override: Column, detected: Column) -> Column:
    """struct(languages, language_source, primary): an override (codes with commas; blank ones don't count) wins over what was detected; ``und`` is no language."""
    codes = F.filter(F.transform(F.split(F.lower(F.coalesce(override, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != "")
    given = F.size(codes) > 0
    languages = F.when(given, codes).when(F.coalesce(detected, F.lit("und")) != "und", F.array(detected)).otherwise(F.array().cast("array<string>"))
    return F.struct(languages.alias("languages"), F.when(given, "override").otherwise("auto").alias("language_source"), F.coalesce(F.get(languages, 0), F.lit("und")).alias("primary"))


def unsupported(languages: Column) -> Column:
    """Codes that an engine of the supported set must reject."""
    return F.array_except(languages, F.array(*map(F.lit, SUPPORTED)))
