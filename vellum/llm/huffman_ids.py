"""Token-id files: canonical length-limited Huffman codes of ids from global counts.

``write_ids`` takes documents of ids and writes ``*.vhid`` files in ascending key order; ``read_ids`` reads them back.
Every file is self-contained. Its ids are cut into blocks of at most ``BLOCK_IDS`` ids that never span documents; a
checkpoint holds each block's first bit, so blocks decode independently (here: all blocks of a file in step, by one table).

Layout: magic ``VHID0001``; uint32 length of a JSON header; header; zlib of the code lengths by id (uint8); per document
key (int64), 1 if the key isn't null (uint8), ids (int64); per block first bit (int64) and ids (uint16); bits, highest first.

Edge cases: null keys sort first; equal keys are kept as separate documents, ordered by their ids' bytes; documents without
ids take no bits; an empty input gives no files and no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import arrow_schema, make_dir, materialize, open_fs, range_cuts, scratch, small_batches

MAGIC = b"VHID0001"
#: Ids of a block, longest code in bits (a power of two of table entries), ids of a range of keys, on average, and bytes after which a range's next file begins.
BLOCK_IDS, MAX_BITS, RANGE_IDS, FILE_BYTES = 512, 18, 2_000_000, 32 << 20
#: Ids that a task decodes, on average, file by file.
TASK_IDS = 16_000_000

WRITTEN = "bucket int, seq int, path string, n_docs long, n_ids long, n_bytes long"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where the count is 0."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(ids) <= 1:
        out[ids] = 1
        return out
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids need codes of more than {limit} bits")
    order = ids[np.argsort(counts[ids], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, merged = [], weights
    leaf = np.ones(len(weights), bool)
    for _ in range(limit):
        levels.append(leaf)
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        merged, leaf = both[at], at < len(weights)
    take = 2 * len(weights) - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        out[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, int(lengths[ids[0]]) if len(ids) else 0
    for i in ids.tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i], last, code = code, n, code + 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For every ``limit`` bits: the id whose code they begin with, and its length."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    spans = (1 << (limit - lengths[ids].astype(np.int64))).astype(np.int64)
    symbols, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    used = int(spans.sum())
    symbols[:used], bits[:used] = np.repeat(ids, spans), np.repeat(lengths[ids], spans)
    return symbols, bits


def encode_docs(docs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """Each document's bits from a byte's start, and the bits of each of its blocks."""
    sizes = np.array([len(d) for d in docs], np.int64)
    if not sizes.sum():
        return [(b"", np.zeros(0, np.uint16)) for _ in docs]
    # Three ids are placed at once; one more symbol, without bits, fills a document's last three.
    none = len(lengths)
    fill = [np.full(n, none, np.uint32) for n in range(3)]
    ids = np.concatenate([x for d in docs for x in (d, fill[-len(d) % 3])])
    first = np.concatenate([[0], np.cumsum((sizes + 2) // 3)])
    bits, code = np.append(lengths, np.uint8(0))[ids], np.append(codes, np.uint64(0))[ids]
    size = bits[0::3] + bits[1::3] + bits[2::3]
    code = (code[0::3] << bits[1::3] | code[1::3]) << bits[2::3] | code[2::3]
    run = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    total = run[first[1:]] - run[first[:-1]]
    n_bytes = (total + 7) // 8
    byte_at = np.concatenate([[0], np.cumsum(n_bytes)])
    pos = run[:-1] + np.repeat(byte_at[:-1] * 8 - run[first[:-1]], np.diff(first))
    words = np.zeros(int(byte_at[-1]) // 8 + 2, np.uint64)
    word = pos >> 6
    shift = 64 - (pos & 63) - size
    cross = shift < 0
    for value, at in ((np.where(cross, code >> np.maximum(-shift, 0).astype(np.uint64), code << np.maximum(shift, 0).astype(np.uint64)), word), (code[cross] << (64 + shift[cross]).astype(np.uint64), word[cross] + 1)):
        if len(at):
            starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
            words[at[starts]] |= np.bitwise_or.reduceat(value, starts)
    data = words.byteswap().tobytes()
    n_blocks = (sizes + BLOCK_IDS - 1) // BLOCK_IDS
    ends = np.cumsum(n_blocks)
    edges = np.repeat(3 * first[:-1], n_blocks) + BLOCK_IDS * (np.arange(int(ends[-1])) - np.repeat(ends - n_blocks, n_blocks))
    blocks = np.add.reduceat(bits, edges, dtype=np.uint16)
    return [(data[a:b], blocks[c - n : c]) for a, b, c, n in zip(byte_at[:-1].tolist(), byte_at[1:].tolist(), ends.tolist(), n_blocks.tolist(), strict=True)]


def file_bytes(lengths: np.ndarray, docs: list[tuple[int | None, int, bytes, np.ndarray]]) -> bytes:
    """A file of (key, ids, bits, bits of its blocks)."""
    keys = np.array([k or 0 for k, *_ in docs], np.int64)
    has = np.array([k is not None for k, *_ in docs], np.uint8)
    n_ids = np.array([n for _, n, *_ in docs], np.int64)
    starts, block_ids, at = [], [], 0
    for _, n, data, blocks in docs:
        starts.append(at * 8 + np.concatenate([[0], np.cumsum(blocks.astype(np.int64))[:-1]]) if len(blocks) else np.zeros(0, np.int64))
        block_ids.append(np.minimum(BLOCK_IDS, n - np.arange(0, n, BLOCK_IDS)).astype(np.uint16))
        at += len(data)
    table = zlib.compress(lengths.tobytes(), 6)
    sections = [table, keys.tobytes(), has.tobytes(), n_ids.tobytes(), np.concatenate(starts).astype(np.int64).tobytes(), np.concatenate(block_ids).astype(np.uint16).tobytes(), b"".join(d for *_, d, _ in docs) + bytes(8)]
    header = json.dumps({"docs": len(docs), "max_bits": MAX_BITS, "sections": [len(x) for x in sections]}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(sections)


def parse_file(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Keys and ids of a file's documents."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    (n,) = struct.unpack_from("<I", data, 8)
    header = json.loads(data[12 : 12 + n])
    at, parts = 12 + n, []
    for size in header["sections"]:
        parts.append(data[at : at + size])
        at += size
    lengths = np.frombuffer(zlib.decompress(parts[0]), np.uint8)
    keys, has, n_ids = (np.frombuffer(p, t) for p, t in zip(parts[1:4], (np.int64, np.uint8, np.int64), strict=True))
    starts, block_ids, bits = np.frombuffer(parts[4], np.int64), np.frombuffer(parts[5], np.uint16).astype(np.int64), np.frombuffer(parts[6], np.uint8)
    limit = header["max_bits"]
    symbols, taken = decode_table(lengths, limit)
    out = np.zeros(int(n_ids.sum()), np.uint32)
    if len(starts):
        long_first = np.argsort(-block_ids, kind="stable")
        to = (np.cumsum(block_ids) - block_ids)[long_first]
        pos, sizes = starts[long_first].copy(), block_ids[long_first]
        # The four bytes from each byte on, so that a step looks up one number a block.
        wide = np.zeros(len(bits), np.uint32)
        for i in range(4):
            wide[: len(bits) - i] |= bits[i:].astype(np.uint32) << np.uint32(24 - 8 * i)
        for step in range(int(sizes[0])):
            k = int(np.searchsorted(-sizes, -step, side="left"))  # blocks longer than step
            p = pos[:k]
            peek = (wide[p >> 3] >> (32 - limit - (p & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)
            out[to[:k] + step] = symbols[peek]
            pos[:k] += taken[peek]
    cuts = np.cumsum(n_ids)[:-1] if len(n_ids) else n_ids
    return [int(k) if h else None for k, h in zip(keys, has, strict=True)], np.split(out, cuts) if len(n_ids) else []


def id_counts(ids: DataFrame, kind: str) -> np.ndarray:
    """How often each id is in the binary column ids; at most one row per id of the vocabulary reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(x for x in batch.column(0).to_pylist() if x), kind))
            if len(got) > len(total):
                total, got = got, total
            total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_ids(ids: DataFrame, kind: str = "<u2", *, out_dir: str | None = None) -> tuple[DataFrame, str]:
    """Write (key long, ids binary of ``kind``, n_ids int) as files; returns what was written (``WRITTEN``) and the folder.

    ids must be cheap to read twice (a written table). Only files named in the returned rows count: a task that was
    lost or repeated leaves files that no row names.
    """
    spark = ids.sparkSession
    small_batches(spark)
    folder = out_dir or scratch(spark, "vhid")
    make_dir(folder)
    counts = id_counts(ids, kind)
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    ranges = int(max(1, counts.sum() // RANGE_IDS))
    least = np.iinfo(np.int64).min
    splits = np.array([k for k, in range_cuts(ids.select(F.coalesce("key", F.lit(int(least))).alias("key")), ranges)], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            docs = [np.frombuffer(x, kind) for x in batch.column(1).to_pylist()]
            made = encode_docs(docs, lengths, codes)
            where = np.searchsorted(splits, keys.fill_null(int(least)).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), keys, pa.array([len(d) for d in docs], pa.int64()), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary())], names=["bucket", "key", "n_ids", "bits", "blocks"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        held: list[tuple] = []
        bucket, seq, size = None, 0, 0
        run = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex[:12]}"

        def flush() -> pa.RecordBatch:
            data, name = file_bytes(lengths, held), f"ids-{bucket:05d}-{seq:05d}-{run}.vhid"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(data)
            return pa.RecordBatch.from_pylist([{"bucket": bucket, "seq": seq, "path": f"{folder}/{name}", "n_docs": len(held), "n_ids": sum(x[1] for x in held), "n_bytes": len(data)}], arrow_schema_written)

        for batch in batches:
            for b, key, n, bits, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (b != bucket or size >= FILE_BYTES):
                    yield flush()
                    held.clear()
                    seq, size = (0 if b != bucket else seq + 1), 0
                if b != bucket:
                    bucket, seq = b, 0
                held.append((key, n, bits, np.frombuffer(blocks, np.uint16)))
                size += len(bits) + len(blocks) + 24
        if held:
            yield flush()

    arrow_schema_written = arrow_schema(spark, WRITTEN)
    coded = ids.select("key", "ids").mapInArrow(encode, "bucket int, key long, n_ids long, bits binary, blocks binary")
    dealt = coded.repartition(ranges, "bucket").sortWithinPartitions("bucket", F.col("key").asc_nulls_first(), "bits")
    # The few rows of all tasks share files of Spark's (see materialize_arrow). They meet by their range: a repeated task names
    # other files, and rows of both runs must not be dealt twice.
    return materialize(dealt.mapInArrow(write, WRITTEN).repartition("bucket"), "vhid-files"), folder


def read_ids(written: DataFrame) -> DataFrame:
    """Rows (key, start, n_ids, ids binary of uint32) of the files, in which start counts the ids of all documents before."""
    spark = written.sparkSession
    small_batches(spark)
    base, total, n_files = {}, 0, 0
    for r in written.groupBy("bucket").agg(F.sum("n_ids").alias("n"), F.count("*").alias("files")).orderBy("bucket").collect():  # a row a range
        base[r.bucket], total, n_files = total, total + r.n, n_files + r.files
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = written.withColumn("before", before).select("path", "bucket", "before")
    # Whoever writes the ids has a file of Spark's for each task (see materialize_arrow), so a task takes several files, neighbours
    # in order: the files of neighbouring ranges, and of a long range those of about TASK_IDS ids.
    tasks = max(1, min(n_files, max(spark.sparkContext.defaultParallelism, total // TASK_IDS)))
    files = files.repartitionByRange(tasks, (F.col("bucket") * tasks / (max(base, default=0) + 1)).cast("long"), (F.col("before") / TASK_IDS).cast("long"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, bucket, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = open_fs(path)
                with fs.open_input_file(at) as f:
                    keys, docs = parse_file(f.read())
                sizes = np.array([len(d) for d in docs], np.int64)
                starts = base[bucket] + start + np.cumsum(sizes) - sizes
                for i in range(0, len(docs), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 1000], pa.int64()), pa.array(starts[i : i + 1000]), pa.array(sizes[i : i + 1000]), pa.array([d.astype("<u4").tobytes() for d in docs[i : i + 1000]], pa.binary())], names=["key", "start", "n_ids", "ids"])

    return files.mapInArrow(decode, "key long, start long, n_ids long, ids binary")


