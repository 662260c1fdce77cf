"""Small files that one driver writes: whole or not at all, never over other content, and logs that survive a torn last line.

Large tables go through ``df.write``; what is here is a document's records, its Markdown, and append-only logs of people's decisions.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import records
from vellum.settings import NameTaken


def put(path: str | os.PathLike, data: bytes) -> Path:
    """Replace a file in one step: readers see the old or the new content, also if the writer dies."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.parent / f".{target.name}.{os.getpid()}.part"
    with part.open("wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    part.replace(target)
    return target


def put_new(path: str | os.PathLike, data: bytes) -> Path:
    """The same for a name that must not hold anything else. Equal content is left alone."""
    target = Path(path)
    if not target.exists():
        return put(target, data)
    if target.read_bytes() != data:
        raise NameTaken(f"{target} holds something else")
    return target


def publish(staged: str | os.PathLike, target: str | os.PathLike) -> Path:
    """Move a verified file to its final name, unless that holds something else."""
    data = Path(staged).read_bytes()
    put_new(target, data)
    Path(staged).unlink()
    return Path(target)


def markdown_bytes(text: str) -> bytes:
    """UTF-8 with line feeds only; nothing else is changed."""
    return re.sub("\r\n?", "\n", text).encode()


def line_of(record: Mapping[str, Any]) -> str:
    return json.dumps(record, ensure_ascii=False, sort_keys=True)


def log_records(path: str | os.PathLike) -> list[dict]:
    """Records of a log; a missing one has none. Its last line may be torn, any other must parse."""
    target = Path(path)
    lines = [x for x in target.read_text(encoding="utf-8").split("\n") if x] if target.exists() else []
    out = []
    for i, line in enumerate(lines, 1):
        try:
            out.append(json.loads(line))
        except ValueError:
            if i < len(lines):
                raise
    return out


def append(path: str | os.PathLike, new: Iterable[Mapping[str, Any]]) -> Path:
    """Add records to a log. One writer at a time; a torn last line goes."""
    return put(path, "".join(line_of(r) + "\n" for r in [*log_records(path), *new]).encode())


def write_record(stem: str | os.PathLike, record: Mapping[str, Any], markdown: str | None = None) -> list[Path]:
    """``<stem>.json``, and ``<stem>.md`` for records that people read. Dots in the stem stay."""
    out = [put_new(f"{os.fspath(stem)}.json", (json.dumps(record, ensure_ascii=False, indent=2) + "\n").encode())]
    return out + ([put_new(f"{os.fspath(stem)}.md", markdown_bytes(markdown))] if markdown is not None else [])


def scan_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of many logs: path, line_no, line, status (record, torn, corrupt). A log is read whole, as its end decides; logs are dealt out."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return records.log_lines(whole, "path", "line_no", "line")
