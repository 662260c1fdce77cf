"""WARC archives of pages, and an index of captures by an external merge.

``write_archives`` decides which of the records with equal payloads is the response, writes ``*.warc.gz`` (a gzip member
per record) and returns what it wrote. ``read_archives`` parses them back. ``index_captures`` makes the capture index:
each file's captures form a locally sorted run; loser trees merge at most ``FAN_IN`` runs at a time by (URL key, timestamp,
page id). Every pass cuts the keys of each group of runs into ranges that are merged side by side, so a pass has about as many tasks
as there are ``RANGE_ROWS`` captures, however few its groups; the merged run is the list of its ranges' files. The whole key cuts the ranges, so one URL
with a third of all captures is merged by many tasks. Every file of a run and archive lies in the shared folder under a name of its
own; only those that a written row names count, so lost or repeated tasks leave no trace in the result.

Edge cases: null html is an empty payload; a null url is the empty URL key; null page ids sort first and are kept; repeated
rows of the largest page id are all responses, as are all rows of a payload whose page ids are all null; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import arrow_schema, make_dir, materialize, open_fs, scratch, small_batches

#: Bytes of an archive before the next is begun; runs merged at once; captures in a block of a run; keys a run offers for the ranges.
ARCHIVE_BYTES, FAN_IN, BLOCK_ROWS, OFFERED, RANGE_ROWS = 16 << 20, 64, 2048, 32, 50_000
#: The first capture's time where the pages have no date column: page ids count seconds from here.
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)

RANGE = "g long, i int, low string, high string, runs array<array<struct<path:string,first:string>>>"
CAPTURE = "url_key string, timestamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RUN = "files array<struct<path:string,first:string>>, n long, offered array<string>"


def url_key(url: str) -> str:
    """Host labels reversed, then path and query, in lower case: pages of a site and its subdomains sort together."""
    parts = urlsplit(re.sub(r"\s", "", url))
    host = (parts.netloc.rpartition("@")[2].partition(":")[0]).lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + ("?" + parts.query.lower() if parts.query else "")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def responses(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(digest, response page, records, copies) of each payload that more than one record has. Partial sums go first, so a payload with a third of all records is no hot key."""
    return pages.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("records")).where("records > 1")


def write_archives(pages: DataFrame, *, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None, out_dir: str | None = None) -> DataFrame:
    """Rows (path, n): the archives of pages(page_id, url, html). Equal payloads of least_bytes or more: the largest page id responds."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = out_dir or scratch(spark, "warc")
    make_dir(folder)
    when = F.col(date).cast("timestamp") if date else F.lit(None).cast("timestamp")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), when.alias("date"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    hashed = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html"))
    # Only payloads with copies are joined. Their rows are salted by page, and each response is repeated for the salts
    # that its number of records calls for, so no task gets more than about COPIES rows of one payload.
    copies = 2000
    found = responses(hashed, least_bytes).withColumn("salts", F.ceil(F.col("records") / copies)).select("digest", "response", "salts")
    found = materialize(found, "warc-copies")
    hot = found.where("salts > 1")  # at most rows / copies payloads
    salted = hashed.select("page_id", "digest").join(hot.select("digest", "salts"), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.coalesce("salts", F.lit(1)))).drop("salts")
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    revisit = salted.join(spread, ["digest", "salt"]).select("page_id", "digest", "response").distinct()
    joined = hashed.join(revisit.withColumnRenamed("page_id", "id_").withColumnRenamed("digest", "digest_"), F.col("page_id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_")), "left").select("page_id", "url", "date", "html", "response")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        run, seq, out, name, n, at = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}", 0, None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n": pa.array([n], pa.int64())})

        for batch in batches:
            for page, url, date, html, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n, at = f"pages-{run}-{seq:04d}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                revisits = response is not None and page != response
                data = gzip.compress(record(page, url, date, html.encode(), response if revisits else None), 5, mtime=0)
                out.write(data)
                n, at = n + 1, at + len(data)
                if at >= archive_bytes:
                    yield done()
                    out, seq = None, seq + 1
        if out is not None:
            yield done()

    return materialize(joined.mapInArrow(write, "path string, n long"), "warc-written")


def record(page: int | None, url: str, date: datetime | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record of an identical payload, whose block ends with the HTTP head."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    when = (date.replace(tzinfo=timezone.utc) if date else EPOCH + timedelta(seconds=page or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Target-URI: {re.sub(r'[\x00-\x1f\x7f]', '', url)}", f"WARC-Date: {when}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record; digests are verified."""
    top, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = top.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError("a block does not match its digest")
    head, _, payload = block.partition(b"\r\n\r\n")
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha1:{sha1_base32(payload)}":
        raise ValueError("a payload does not match its digest")
    return headers, head, payload


def members(uri: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of each gzip member of a file, a member at a time."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        at, left = 0, b""
        while left or (left := f.read(1 << 20)):
            inflate, parts, used = zlib.decompressobj(31), [], 0
            while True:
                parts.append(inflate.decompress(left))
                used += len(left) - len(inflate.unused_data)
                left = inflate.unused_data
                if inflate.eof:
                    break
                if not (left := f.read(1 << 20)):
                    raise ValueError(f"{uri} ends inside a record")
            yield at, used, b"".join(parts)
            at += used


def page_of(urn: str) -> int | None:
    n = urn.strip("<>").removeprefix("urn:page:")
    return int(n) if n else None


def capture(data: bytes, file: str, offset: int, length: int) -> tuple:
    headers, head, payload = parse_record(data)
    size = len(payload) if headers["WARC-Type"] == "response" else int(re.search(rb"Content-Length: (\d+)", head)[1])
    url = headers["WARC-Target-URI"]
    return (url_key(url), re.sub(r"\D", "", headers["WARC-Date"]), page_of(headers["WARC-Record-ID"]), url, size, headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"], page_of(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None, file, offset, length)


def read_archives(written: DataFrame) -> DataFrame:
    """Rows of CAPTURE and the payload (null for revisits) of every record, archive by archive."""
    schema = arrow_schema(written.sparkSession, f"{CAPTURE}, payload binary")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for offset, length, data in members(path):
                    row = capture(data, path, offset, length)
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*row, parse_record(data)[2] if row[6] == "response" else None), schema, strict=True)], schema=schema)

    return spread(written, "path").mapInArrow(parse, f"{CAPTURE}, payload binary")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """A written table's rows of files, a task for each, or for a few."""
    return df.select(*columns).repartition(max(1, df.count()), *columns)


class LoserTree:
    """k-way merge: the inner nodes keep the losers of their matches, so each row costs log2(k) comparisons."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.size = 1 << max(0, (k - 1).bit_length())
        self.heads += [None] * (self.size - k)
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x[0], a) <= (y[0], b)

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.size) >> 1
            while node:
                if self.before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node >>= 1
            self.winner = at


def sort_key(row: tuple) -> tuple:
    return (row[0], row[1], -1 << 63 if row[2] is None else row[2])


def write_run(uri: str, rows: Iterator[tuple], schema: pa.Schema, block_rows: int = BLOCK_ROWS) -> tuple[int, list[tuple]]:
    """A sorted run in blocks; its rows, and each block's first key."""
    fs, path = open_fs(uri)
    n, firsts, held = 0, [], []
    with fs.open_output_stream(path) as f, ipc.new_file(f, schema, options=ipc.IpcWriteOptions(compression="zstd")) as out:

        def flush() -> None:
            firsts.append(sort_key(held[0]))
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*held, strict=True), schema, strict=True)], schema=schema))
            held.clear()

        for row in rows:
            held.append(row)
            n += 1
            if len(held) == block_rows:
                flush()
        if held:
            flush()
    return n, firsts


def inside(files: list[dict], low: tuple | None, high: tuple | None) -> list[dict]:
    """Those of a run's files that may hold keys from low, before high."""
    firsts = [tuple(json.loads(f["first"])) for f in files]
    return [f for i, f in enumerate(files) if (high is None or firsts[i] < high) and (low is None or i + 1 == len(files) or firsts[i + 1] >= low)]


def read_files(files: list[dict], low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """(key, row) of a run of several files from low, before high."""
    for f in inside(files, low, high):
        yield from read_run(f["path"], low, high)


def read_run(uri: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """(key, row) of a run from low, before high; blocks outside aren't decoded beyond the one where the search ends."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        blocks = ipc.open_file(f)
        first = lambda i: sort_key(tuple(blocks.get_batch(i).column(c)[0].as_py() for c in range(3)))
        a, b = 0, blocks.num_record_batches
        while low is not None and a < b:  # the first block that begins at low or later
            m = (a + b) // 2
            a, b = (m + 1, b) if first(m) < low else (a, m)
        for i in range(max(0, a - 1), blocks.num_record_batches):
            for row in zip(*(c.to_pylist() for c in blocks.get_batch(i).columns), strict=True):
                key = sort_key(row)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield key, row


def some_of(keys: list[str], most: int) -> list[str]:
    return [keys[i] for i in np.unique(np.linspace(0, len(keys) - 1, min(most, len(keys))).astype(int))] if keys else []


def cuts_of(keys: list[str], n: int, range_rows: int) -> list[tuple]:
    """Keys that cut n rows into ranges of about ``range_rows``, from a sample of them."""
    ordered = sorted(tuple(json.loads(k)) for k in keys)
    ranges = max(1, min(len(ordered), n // range_rows))
    return sorted({ordered[len(ordered) * i // ranges] for i in range(1, ranges)})


def index_captures(written: DataFrame, *, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """CAPTURE and history (a capture's place among those of its URL key), globally ordered by (url_key, timestamp, page_id): ranges ascend with range_id."""
    spark: SparkSession = written.sparkSession
    small_batches(spark)
    folder, schema, run_schema = scratch(spark, "warc-runs"), arrow_schema(spark, CAPTURE), arrow_schema(spark, RUN)
    range_schema = arrow_schema(spark, RANGE)
    make_dir(folder)

    def file_row(rows: Iterator[tuple]) -> dict | None:
        path = f"{folder}/run-{uuid.uuid4().hex}.arrow"
        n, firsts = write_run(path, rows, schema, block_rows)
        keys = [json.dumps(k) for k in firsts]
        return {"files": [{"path": path, "first": keys[0]}], "n": n, "offered": some_of(keys, OFFERED)} if n else None

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                made = file_row(iter(sorted((capture(data, path, offset, length) for offset, length, data in members(path)), key=sort_key)))
                if made:
                    yield pa.RecordBatch.from_pylist([made], run_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, files, n, offered in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cuts = [json.dumps(c) for c in cuts_of([k for o in offered for k in o], n, range_rows)]
                for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
                    within = [inside(f, low and tuple(json.loads(low)), high and tuple(json.loads(high))) for f in files]
                    yield pa.RecordBatch.from_pylist([{"g": g, "i": i, "low": low, "high": high, "runs": [f for f in within if f]}], range_schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                low, high = (tuple(json.loads(x)) if x else None for x in (r["low"], r["high"]))
                made = file_row(row for _, row in LoserTree([read_files(f, low, high) for f in r["runs"]]))
                if made:
                    yield pa.RecordBatch.from_pylist([{"g": r["g"], "i": r["i"], **made}], merged_schema)

    merged_ddl = f"g long, i int, {RUN}"
    merged_schema = arrow_schema(spark, merged_ddl)
    runs = materialize(spread(written, "path").mapInArrow(local, RUN), "warc-run-list")
    while (k := runs.count()) > fan_in:
        # About fan_in / 2 runs a group: lists of their files, which grow with the merged captures, a name for RANGE_ROWS of them.
        group = F.pmod(F.xxhash64(F.col("files")[0]["path"]), F.lit(-(-k // (fan_in // 2))))
        groups = runs.groupBy(group.alias("g")).agg(F.collect_list("files").alias("files"), F.sum("n").alias("n"), F.collect_list("offered").alias("offered"))
        ranges = materialize(groups.mapInArrow(cut, RANGE), "warc-ranges")
        merged = materialize(spread(ranges, "g", "i", "low", "high", "runs").mapInArrow(merge, merged_ddl), "warc-merged")
        each = merged.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "files", "offered"))).alias("parts"), F.sum("n").alias("n"))
        keep = F.flatten(F.transform("parts", lambda p: p["offered"]))
        every = F.greatest(F.lit(1), F.floor(F.size(keep) / (OFFERED * 16)).cast("int"))
        runs = materialize(each.select(F.flatten(F.transform("parts", lambda p: p["files"])).alias("files"), "n", F.filter(keep, lambda _, i: i % every == 0).alias("offered")), "warc-run-list")
    final = runs.select("n", "offered").collect()  # at most fan_in rows of some hundred keys
    cuts = cuts_of([k for r in final for k in r.offered], sum(r.n for r in final), range_rows)
    bounds = list(zip([None, *cuts], [*cuts, None], strict=True))
    paths = [[f.asDict() for f in r.files] for r in runs.select("files").collect()]  # a name for RANGE_ROWS captures
    out_schema = arrow_schema(spark, f"range_id int, {CAPTURE}, history long")

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                low, high = bounds[i]
                n = 0
                if high is not None:
                    start = (high[0], "", -1 << 63)
                    start = start if low is None else max(start, low)
                    n = sum(1 for p in paths for _ in read_files(p, start, high))
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "n": pa.array([n], pa.int64())})

    def merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                low, high = bounds[i]
                before = carried[i]
                url, held = None if low is None else low[0], []
                for _, row in LoserTree([read_files(p, low, high) for p in paths]):
                    before = before if row[0] == url else 0
                    url = row[0]
                    held.append((i, *row, before))
                    before += 1
                    if len(held) == BLOCK_ROWS:
                        yield _batch(held, out_schema)
                        held = []
                if held:
                    yield _batch(held, out_schema)

    # Captures of a range's first URL key in the ranges before it: a range's rows of the next one's first key, carried on.
    at = spark.range(0, len(bounds), 1, len(bounds)).select(F.col("id").cast("int"))
    carried = [0] * len(bounds)
    if cuts:
        tail = {r.i: r.n for r in at.mapInArrow(tails, "i int, n long").collect()}  # a number a range
        for i in range(1, len(bounds)):
            same = i > 1 and bounds[i - 1][0][0] == bounds[i][0][0]
            carried[i] = tail[i - 1] + (carried[i - 1] if same else 0)
    return at.mapInArrow(merge_range, f"range_id int, {CAPTURE}, history long") if paths else at.limit(0).mapInArrow(merge_range, f"range_id int, {CAPTURE}, history long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
