"""Identities: canonical JSON and the digests taken over it.

Canonical JSON has its keys in order, no white space, and text as it is. Keys are known when a plan is made, so an object is one concatenation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(value: Column) -> Column:
    """A string as JSON; null where it is null."""
    listed = F.to_json(F.array(value))
    return F.when(value.isNull(), "null").otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))


def json_number(value: Column, digits: int = 3) -> Column:
    """A finite double rounded to digits, always with a decimal point."""
    return F.round(value, digits).cast("string")


def json_list(items: Column) -> Column:
    """An array of JSON texts as one."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def json_object(members: dict[str, Column]) -> Column:
    """Member values are JSON texts."""
    parts = [F.concat(F.lit(f'"{name}":'), members[name]) for name in sorted(members)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def run_id(source_sha256: Column, selection: Column, version: Column, config: Column, resolutions: Column) -> Column:
    """16 digits of source, selection, tool version, canonical configuration and the digest of the decisions that apply."""
    return F.substring(F.sha2(F.concat_ws("\n", source_sha256, selection, version, config, resolutions), 256), 1, 16)


def region(page: Column, boxes: Column, candidates: Column) -> Column:
    """Page, boxes (array<array<double>>) and the set of candidate values, whatever their order, as JSON."""
    numbers = F.transform(boxes, lambda b: json_list(F.transform(b, lambda x: json_number(x))))
    return json_object({"page": page.cast("string"), "regions": json_list(numbers), "candidates": F.to_json(F.array_sort(candidates))})


def applicability_key(source_sha256: Column, kind: Column, region_json: Column, config: Column) -> Column:
    """What a decision was taken on: it no longer applies when the source, the kind of conflict, its place, its candidates or the configuration differ."""
    return F.sha2(F.concat_ws("\n", source_sha256, kind, region_json, config), 256)


def literal_choice(mode: Column, value: Column) -> Column:
    return json_object({"mode": json_text(mode), "value": json_text(value)})


def order_choice(ids: Column) -> Column:
    return json_object({"order": F.to_json(ids)})


def resolution_id(key: Column, sequence: Column, choice: Column) -> Column:
    """Bound to the decision's content: the choice (JSON), without who made it."""
    return F.substring(F.sha2(json_object({"applicability_key": json_text(key), "sequence_index": sequence.cast("string"), "selected": choice}), 256), 1, 16)
