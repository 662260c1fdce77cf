"""Quality rules on documents, and the frequency of lines across a host's documents, in DataFrame functions only.

Per document: words, symbols, repeated lines and repeated word windows. Across documents: lines are normalised (lower case,
white space as one space) and hashed; for each host (the source) the distinct documents that hold a line are counted. Documents with
the same text are one document here, so that exact copies, which near-duplicate removal handles, don't make a page's own lines look like boilerplate.
A line in more than ``MOST_DOCS`` documents of its host is above the limit, however large the host. It is removed from
every document; a document that keeps less than ``least_left`` of its words is depleted and rejected.

Counts are partial aggregates of (host, line), so neither a host nor a line with a third of all rows is a hot key. A document's lines above the limit
come back to it by its host and text's hash, at most as many as it has lines; no list of all of a host's lines is made; Spark splits
skewed partitions of copies.

Edge cases: null texts have no words; a null host is the empty host; documents without words fail; repeated rows count once
(equal texts); lines without a word are never removed; a host with at most ``MOST_DOCS`` documents has no line above the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import discard, fresh, materialize, quoted, text_of

#: Fewest words, and the largest share of words in repeated windows (percent).
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Distinct documents of a host that a line may be in, and the share of words that must be left.
MOST_DOCS, LEAST_LEFT = 10, 0.5

SPACES = " \t\n\x0b\f\r"
_SPLIT, _INK = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]"


def words_of(text: Column) -> Column:
    """Words: runs of anything but the six ASCII white-space characters."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT))


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.btrim(F.lower(line), F.lit(SPACES)), _SPLIT, " ")


def bound(value: Column, f) -> Column:  # noqa: ANN001
    """f(value), with value computed once though f may use it in a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur more than once. Equal windows are neighbours in order of (hash, place)."""

    def covered(at: Column) -> Column:
        # at: ascending first words of repeated windows; each covers up to its successor, three words at most.
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")), lambda a, i: F.struct((a["n"] + 3 - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + 3).alias("end")), lambda a: a["n"])

    def among(windows: Column) -> Column:
        rows = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(r: Column) -> Column:
            same = F.filter(r, lambda x, k: (F.get(r, k - 1)["h"] == x["h"]) | (F.get(r, k + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered(bound(rows, again)))

    windows = bound(words, lambda w: F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    return bound(windows, among)


def line_limits(docs: DataFrame, *, text: str = "text", host: str = "source", most_docs: int = MOST_DOCS) -> DataFrame:
    """(host, content, lines array<bigint>): for each distinct document, by its text's hash, the hashes of its lines above the limit, if it has any. A written table."""
    rows = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_of(text).alias("text"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(_INK)), lambda x: F.xxhash64(normalised(x))))
    # Distinct (host, content) first: of copies, one is exploded. Only hashes are dealt out.
    rows = materialize(rows.select("host", F.xxhash64("text").alias("content"), lines.alias("lines")).groupBy("host", "content").agg(F.first("lines").alias("lines")), "line-hashes")
    each = rows.select("host", "content", F.explode("lines").alias("line"))
    frequent = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > most_docs).select("host", "line")
    above = each.join(frequent, ["host", "line"], "left_semi").groupBy("host", "content").agg(F.collect_list("line").alias("lines"))
    found = materialize(above, "line-limits")
    discard(rows)
    return found


def quality(docs: DataFrame, *, text: str = "text", host: str = "source", most_docs: int = MOST_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """docs with a column ``quality``: struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left (words left), kept, and clean (the text without lines above the limit)."""
    limits = line_limits(docs, text=text, host=host, most_docs=most_docs)
    h, c, l = fresh(docs, "host_"), fresh(docs, "content_"), fresh(docs, "lines_")
    keyed = docs.withColumn(h, F.coalesce(F.col(host).cast("string"), F.lit(""))).withColumn(c, F.xxhash64(text_of(text)))
    # Both sides grow with the data: dealt by the key at every size, and not sorted.
    found = keyed.join(limits.select(F.col("host").alias(h), F.col("content").alias(c), F.col("lines").alias(l)).hint("shuffle_hash"), [h, c], "left").select(*(F.col(quoted(x)) for x in docs.columns), F.col(l))
    t = text_of(text)
    frequent = F.coalesce(F.col(l), F.array().cast("array<bigint>"))
    lines = F.split(t, "\n")
    inked = F.filter(lines, lambda x: x.rlike(_INK))
    stays = lambda x: ~F.array_contains(frequent, F.xxhash64(normalised(x))) | ~x.rlike(_INK)
    clean = F.when(F.size(frequent) == 0, t).otherwise(F.array_join(F.filter(lines, stays), "\n"))

    def count_words(x: Column) -> Column:
        return F.size(words_of(x)).cast("long")

    def of(words: Column) -> Column:
        n = F.size(words).cast("long")
        return bound(repeated_words(words).cast("long"), lambda again: F.struct(n.alias("n_words"), again.alias("n_repeat_words"), ((n < LEAST_WORDS) | (100 * again > MOST_REPEATED * n)).alias("base_failed")))

    q = fresh(docs, "quality")
    made = found.withColumn(q, F.struct(bound(words_of(t), of).alias("base"), bound(clean, lambda c: F.struct(c.alias("clean"), count_words(c).alias("n_left"))).alias("left")))
    base, left = F.col(q)["base"], F.col(q)["left"]
    depleted = left["n_left"] < least_left * base["n_words"]
    return made.withColumn(q, F.struct(
        base["n_words"].alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        bound(inked, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        base["n_repeat_words"].alias("n_repeat_words"), base["base_failed"].alias("base_failed"),
        left["n_left"].alias("n_left"), (~base["base_failed"] & ~depleted).alias("kept"), left["clean"].alias("clean"),
    )).drop(l)
