"""HTML extraction by equivalence-class template deduction.

Tokens are tags (with class and id), the words of the whole page, and its blocks of text as wholes (so that a notice whose words also
stand elsewhere is one token). Over the distinct pages of a host, each token has an
occurrence vector; tokens with the same vector form an equivalence class. A vector is held as its number of pages and an exclusive or of
hashes of (page, count), so it is an aggregate of groups of a host's pages, which keep only common tokens: neither a large host nor a
common token is a hot key. Classes in at least half of a host's pages are valid where their tokens keep one order on the page at hand; valid classes
nest by their extent into the page's template. What stands between template tokens are slots, and the text is theirs, on every page:
blocks that are template tokens, or whose words are a run of one class, are none, and ``RUN`` or more successive words of a class end a slot within a block.
Elements are a check on top: slots in page furniture are left out, and those outside an article element too,
unless the article elements hold less than ``TEASER`` of the slots' text. Furniture has an element's name or, outside articles, any part of a
class or id; inside articles only a whole class that is such a word counts, and none on headings, paragraphs and other text blocks.

Edge cases: null html is empty and gives an empty text; null urls share the empty host; a host with fewer than
``WORD_PAGES`` distinct pages has no template; a page that would be all template keeps its text; broken markup is read as browsers do as far as blocks are concerned (unclosed elements end with their parent,
stray end tags are ignored, scripts and styles end at their own end tag only); repeated pages count once and are extracted each.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import arrow_schema, materialize, small_batches

#: Share of a host's distinct pages that a class of the template is in, and distinct pages before words count as template text.
SUPPORT, WORD_PAGES = 0.5, 5
#: Tokens of a class and successive words before words within a block count as template; share of the slots' text below which articles are teasers.
RUN, TEASER = 3, 0.5
#: Distinct pages of a large host that are counted together, at least.
GROUP = 400

#: Elements that are page furniture or no text; the words by which classes and ids name furniture.
FURNITURE = frozenset("nav header footer aside form script style head title noscript template iframe svg button select option textarea input object canvas audio video menu dialog math".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice notices alert gdpr sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus reply replies share sharing social related recommended newsletter subscribe signup login popup modal overlay widget pagination pager toolbar skip".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ARTICLE = frozenset(("article", "main"))
#: Blocks that hold an article's own text.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CUT = re.compile(r"[\s_-]+")


def parse(source: str) -> Iterator[tuple[str, str, str]]:
    """("open" | "close" | "text", name or text, class and id) in page order; the insides of raw elements are skipped."""
    at, n = 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            yield "text", source[at:], ""
            return
        if m.start() > at:
            yield "text", source[at : m.start()], ""
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            yield "close", name, ""
            continue
        inside = m[3] or m[6] or ""
        named = " ".join(v for x in _NAMED.finditer(inside) for v in x.groups()[1:] if v) if "=" in inside else ""
        yield "open", name, named.lower()
        if inside.rstrip().endswith("/") and name not in INLINE and name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else n
            yield "close", name, ""


def is_furniture(name: str, named: str, inside: bool = False) -> bool:
    """named: class, id and role; inside: within an article element."""
    if name in ARTICLE:
        return not {"comment", "comments", "reply"}.isdisjoint(_CUT.split(named))
    if name in FURNITURE and not (inside and name in ("header", "head", "title")):
        return True
    if not named or name in ("html", "body") or inside and name in TEXT:
        return False
    return not NAMES.isdisjoint(named.split() if inside else _CUT.split(named))


def block_token(text: str) -> str:
    return f"\N{PILCROW SIGN}{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"


def blocks(source: str) -> tuple[list[tuple[list[str], int, bool, bool]], list[str]]:
    """Blocks as (words, place of the first among the tokens, whether in furniture, whether in an article), and the page's tokens in order: a block's own is before its words."""
    stack: list[tuple[str, bool, bool]] = []  # element, whether furniture holds, whether in an article
    out: list[tuple[list[str], int, bool, bool]] = []
    tokens: list[str] = []
    parts: list[str] = []
    state = (False, False)

    def flush() -> None:
        if parts:
            words = html.unescape("".join(parts)).split()
            parts.clear()
            if words:
                tokens.append(block_token(" ".join(words)))
                out.append((words, len(tokens), *state))
                tokens.extend(words)

    for kind, name, named in parse(source):
        if kind == "text":
            parts.append(name)
            continue
        token = f"<{name} {named}>" if kind == "open" else f"</{name}>"
        if name in VOID:
            if name == "br" or name not in INLINE:
                parts.append(" ") if parts and name in ("br", "img", "input", "wbr") else flush()
            tokens.append(token)
            continue
        if name in INLINE and not (kind == "open" and is_furniture(name, named, state[1])) and not any(s[0] == name for s in stack[-1:]):
            tokens.append(token)
            continue
        flush()
        tokens.append(token)
        if kind == "open":
            stack.append((name, *state))
            state = (state[0] or is_furniture(name, named, state[1]), state[1] or name in ARTICLE)
        elif any(s[0] == name for s in stack):
            while True:
                top, *before = stack.pop()
                state = (before[0], before[1])
                if top == name:
                    break
        # </p> and the like without an open element are ignored
        if kind == "open" and name in ("p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"):
            same = {"td": "td th", "th": "td th", "dt": "dt dd", "dd": "dt dd"}.get(name, name).split()
            if len(stack) > 1 and stack[-2][0] in same:  # it ends the one before
                closed = stack.pop(-2)
                stack[-1] = (name, *closed[1:])
                state = (closed[1] or is_furniture(name, named, closed[2]), closed[2])
    flush()
    return out, tokens


def template_of(rows: list[tuple[str, str, float]]) -> list[list[str]]:
    """Classes of (vector, token, mean place): their tokens in order of mean place, the largest class first."""
    found: dict[str, list[tuple[float, str]]] = {}
    for vector, token, place in rows:
        found.setdefault(vector, []).append((place, token))
    return sorted(([t for _, t in sorted(c)] for c in found.values()), key=lambda c: (-len(c), c))


def fitted(tokens: list[str], classes: list[list[str]]) -> list[tuple[int, int, list[str]]]:
    """The classes that are valid on a page (every token equally often, in one order each time) with their extents, nested: none crosses another."""
    places: dict[str, list[int]] = {}
    wanted = {t for c in classes for t in c}
    for i, t in enumerate(tokens):
        if t in wanted:
            places.setdefault(t, []).append(i)
    kept: list[tuple[int, int, list[str]]] = []
    for c in classes:
        rows = [places.get(t) for t in c]
        if not all(rows) or len({len(r) for r in rows}) > 1:
            continue
        order = sorted(range(len(c)), key=lambda i: rows[i][0])
        times = len(rows[0])
        flat = [rows[i][k] for k in range(times) for i in order]
        if any(b <= a for a, b in zip(flat, flat[1:])):  # noqa: B905
            continue
        low, high = flat[0], flat[-1]
        if all(high < a or low > b or a <= low and high <= b or low <= a and b <= high for a, b, _ in kept):
            kept.append((low, high, c))
    return kept


def slot_words(words: list[str], own: str, fixed: dict[str, list[str]]) -> list[str]:
    """A block's words that are in slots of the template. fixed: the valid class of each template token; own: the block's token."""
    if own in fixed or words[0] in fixed and all(fixed.get(w) is fixed[words[0]] for w in words):
        return []
    out: list[str] = []
    at = 0
    while at < len(words):
        c, end = fixed.get(words[at]), at + 1
        while c and end < len(words) and fixed.get(words[end]) is c:
            end += 1
        if not c or len(c) < RUN or end - at < RUN:
            out += words[at:end]
        at = end
    return out


def extract(source: str, classes: list[list[str]], distinct: int) -> str:
    """The text of the template's slots that are no furniture; only of those in articles, if these aren't teasers."""
    found, tokens = blocks(source)
    found = [b for b in found if not b[2]]
    slots = [(" ".join(words), inside) for words, _, _, inside in found]
    if distinct >= WORD_PAGES:
        fixed = {t: c for *_, c in fitted(tokens, classes) for t in c}
        kept = [(" ".join(slot_words(words, tokens[at - 1], fixed)), inside) for words, at, _, inside in found]
        slots = [x for x in kept if x[0]] or slots
    size = sum(len(text) for text, _ in slots)
    if sum(len(text) for text, inside in slots if inside) >= TEASER * size:
        slots = [x for x in slots if x[1]]
    return "\n\n".join(text for text, _ in slots)


def host_of(url: str) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url)
    return m[1].lower() if m else ""


def tallied(pages: list[tuple[int, list[str]]], share: float) -> Iterator[tuple[str, int, int, float]]:
    """(token, pages, vector, sum of first places) of the tokens in at least that share of the pages (content hash, tokens)."""
    counts = [Counter(tokens) for _, tokens in pages]
    seen = Counter(t for c in counts for t in c)
    often = {t: [0, 0.0] for t, n in seen.items() if n >= share * len(pages)}
    for (content, tokens), c in zip(pages, counts, strict=True):
        first: dict[str, int] = {}
        for i, t in enumerate(tokens):
            if t in often:
                first.setdefault(t, i)
        marks: dict[int, int] = {}
        for t, i in first.items():
            n = c[t]
            if n not in marks:
                marks[n] = int.from_bytes(hashlib.blake2b(f"{content} {n}".encode(), digest_size=8).digest(), "little", signed=True)
            often[t][0] ^= marks[n]
            often[t][1] += i / len(tokens)
    for t, (vector, place) in often.items():
        yield t, seen[t], vector, place


def templates(pages: DataFrame) -> DataFrame:
    """(host, distinct, tokens json) for pages(host, html), of hosts with enough distinct pages: a written table.

    Pages of a host are counted in groups of ``GROUP`` at least, dealt by content: a group leaves out rare tokens before the shuffle. In a host of
    one group that is exact; in a random group a token of half of the host's pages is in less than a quarter with a chance below 1e-15.
    """
    spark = pages.sparkSession
    dealt_schema = arrow_schema(spark, "host string, content long, html string")
    schema_ddl = "host string, token string, pages long, vector long, place double"
    schema = arrow_schema(spark, schema_ddl)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # of a task: of a page with many copies, one a task is dealt out
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            mask = [k not in seen and not seen.add(k) for k in keys]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(mask, pa.bool_())).columns, schema=dealt_schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[str, int, int] | None = None
        group: dict[int, list[str]] = {}

        def made() -> pa.RecordBatch:
            rows = [(key[0], *x) for x in tallied(list(group.items()), SUPPORT if key[1] == 1 else SUPPORT / 2)] if key else []
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for host, groups, part, content, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, groups, part) != key:
                    yield made()
                    key, group = (host, groups, part), {}
                if content not in group:
                    group[content] = blocks(source)[1]
        yield made()

    rows = pages.select("host", F.xxhash64("html").alias("content"), "html")
    sizes = rows.groupBy("host", "content").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("distinct")).where(F.col("distinct") >= WORD_PAGES)
    sizes = materialize(sizes, "html-hosts")
    # Large hosts are at most pages / (2 GROUP).
    large = sizes.where(F.col("distinct") >= 2 * GROUP).select("host", F.floor(F.col("distinct") / GROUP).cast("long").alias("groups"))
    dealt = rows.mapInArrow(once, "host string, content long, html string").join(F.broadcast(large), "host", "left")
    dealt = dealt.withColumn("groups", F.coalesce("groups", F.lit(1).cast("long"))).select("host", "groups", F.pmod(F.xxhash64("content"), "groups").alias("part"), "content", "html")
    each = dealt.repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(count, schema_ddl)
    vectors = each.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), (F.sum("place") / F.sum("pages")).alias("place"))
    good = vectors.join(sizes, "host").where(F.col("pages") >= SUPPORT * F.col("distinct"))
    # At most (tokens of a page, on average) / SUPPORT tokens a host.
    found = good.groupBy("host").agg(F.first("distinct").alias("distinct"), F.to_json(F.collect_list(F.struct(F.concat_ws(":", "pages", "vector").alias("v"), F.col("token").alias("t"), F.col("place").alias("p")))).alias("tokens"))
    return materialize(found, "html-templates")


def main_text(pages: DataFrame, *, source: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    small_batches(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("html"))
    found = templates(rows)
    kind = rows.schema["page_id"].dataType.simpleString()
    ddl = f"page_id {kind}, url string, text string, n_chars long"
    schema = arrow_schema(spark, ddl)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[list[str]]] = {}
        for batch in batches:
            texts = []
            for body, h, distinct, tokens in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                if h not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[h] = template_of([(x["v"], x["t"], x["p"]) for x in json.loads(tokens or "[]")])
                texts.append(extract(body, known[h], distinct or 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return rows.join(found, "host", "left").select("page_id", "url", "html", "host", "distinct", "tokens").mapInArrow(make, ddl)
