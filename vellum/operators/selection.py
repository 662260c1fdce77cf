"""Page selections such as ``2,5-7,10-12``: parsed, rejected or resolved to pages, row by row without a shuffle.

A null or blank selection is the whole document. The fault is the first that holds: by part, in order (``empty``, ``non_numeric``, ``not_one_based``,
``reversed``), else ``overlap``, with the pages that appear twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGES = "array<struct<lo:int,hi:int>>"


def _part(part: Column) -> Column:
    token = F.trim(part)
    numbers = F.regexp_extract_all(token, F.lit("([0-9]+)"), F.lit(1))
    lo, hi = F.get(numbers, 0).cast("int"), F.coalesce(F.get(numbers, 1), F.get(numbers, 0)).cast("int")
    fault = F.when(token == "", "empty").when(~F.regexp_like(token, F.lit("^[0-9]{1,9}( *- *[0-9]{1,9})?$")), "non_numeric").when((lo < 1) | (hi < 1), "not_one_based").when(lo > hi, "reversed")
    return F.struct(F.when(fault.isNull(), lo).alias("lo"), F.when(fault.isNull(), hi).alias("hi"), fault.alias("fault"))


def parsed(spec: Column) -> Column:
    """struct(fault, twice, ranges): ranges in order, adjacent ones merged; empty for the whole document and for faulty selections."""
    whole = F.trim(F.coalesce(spec, F.lit(""))) == ""
    parts = F.when(~whole, F.transform(F.split(spec, ","), _part)).otherwise(F.array().cast("array<struct<lo:int,hi:int,fault:string>>"))

    def merge(a: Column, r: Column) -> Column:
        last = F.get(a["ranges"], F.size(a["ranges"]) - 1)
        head = F.slice(a["ranges"], F.lit(1), F.size(a["ranges"]) - 1)
        made = lambda ranges, twice: F.struct(ranges.alias("ranges"), twice.cast("string").alias("twice"))
        both = F.concat_ws("-", r["lo"].cast("string"), F.least(last["hi"], r["hi"]).cast("string"))
        return F.when(a["twice"].isNotNull(), a).when(r["lo"] <= last["hi"], made(a["ranges"], both)).when(r["lo"] == last["hi"] + 1, made(F.concat(head, F.array(F.struct(last["lo"].alias("lo"), r["hi"].alias("hi")))), F.lit(None))).otherwise(made(F.concat(a["ranges"], F.array(F.struct(r["lo"].alias("lo"), r["hi"].alias("hi")))), F.lit(None)))

    def of(found: Column) -> Column:
        fault = F.get(F.filter(found, lambda p: p["fault"].isNotNull()), 0)["fault"]
        none = F.array().cast(_RANGES)
        merged = F.aggregate(F.array_sort(F.transform(F.filter(found, lambda p: p["fault"].isNull()), lambda p: F.struct(p["lo"].alias("lo"), p["hi"].alias("hi")))), F.struct(none.alias("ranges"), F.lit(None).cast("string").alias("twice")), merge)
        return F.element_at(F.transform(F.array(merged), lambda m: F.struct(F.coalesce(fault, F.when(m["twice"].isNotNull(), "overlap")).alias("fault"), F.when(fault.isNull(), m["twice"]).alias("twice"), F.when(fault.isNull() & m["twice"].isNull(), m["ranges"]).otherwise(none).alias("ranges"))), 1)

    return F.element_at(F.transform(F.array(parts), of), 1)


def token(ranges: Column) -> Column:
    """The normal form: ``all``, or ranges joined by ``_``."""
    one = lambda r: F.when(r["lo"] == r["hi"], r["lo"].cast("string")).otherwise(F.concat_ws("-", r["lo"].cast("string"), r["hi"].cast("string")))
    return F.when(F.size(ranges) == 0, "all").otherwise(F.array_join(F.transform(ranges, one), "_"))


def from_token(text: Column) -> Column:
    """Ranges of a normal form, which is trusted; of ``all``: none."""
    edge = lambda p, i: F.split(p, "-")[i].cast("int")
    one = lambda p: F.struct(edge(p, 0).alias("lo"), F.coalesce(F.get(F.split(p, "-"), 1).cast("int"), edge(p, 0)).alias("hi"))
    return F.when(text == "all", F.array().cast(_RANGES)).otherwise(F.transform(F.split(text, "_"), one))


def beyond(ranges: Column, page_count: Column) -> Column:
    """The first selected page range's end beyond the document, else null."""
    return F.get(F.filter(ranges, lambda r: r["hi"] > page_count), 0)["hi"]


def pages(ranges: Column, page_count: Column) -> Column:
    """All selected pages that there are, in order."""
    each = F.flatten(F.transform(ranges, lambda r: F.sequence(r["lo"], r["hi"])))
    some = F.filter(each, lambda p: p <= page_count)
    return F.when(F.size(ranges) > 0, some).when(page_count > 0, F.sequence(F.lit(1), page_count.cast("int"))).otherwise(F.array().cast("array<int>"))


def cover(of: Column, page_count: Column) -> Column:
    """The shortest run of pages with all of them: struct(first, last); the whole document where none is asked for."""
    return F.struct(F.coalesce(F.array_min(of), F.lit(1)).alias("first"), F.coalesce(F.array_max(of), page_count.cast("int")).alias("last"))
