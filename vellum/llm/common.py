"""What the operators share: table reading, scratch tables in the shared folder, file access, columns of unknown inputs."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Texts and sets may be very long, and a batch is held several times over.
ARROW_ROWS, ARROW_BYTES = 400, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches: whole texts of unknown length travel in them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, where all run on one machine, one of our own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        set_dir = sc._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vellum-")
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/vellum-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, tag: str, *, arrow_rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage and survives lost executors.

    arrow_rows: rows of an Arrow batch meanwhile, for narrow rows.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = scratch(spark, tag), spark.conf.get(name)
    try:
        if arrow_rows:
            spark.conf.set(name, str(arrow_rows))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(name, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path_ = path
    return out


def materialize_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, tag: str) -> DataFrame:
    """df.mapInArrow(run, schema) as Parquet files that the Python workers write in the shared folder, read again.

    Rows don't pass through the executor's JVM, and it writes no files: for a file on a local disk Hadoop starts several commands
    (chmod), and while one starts, its process has the JVM's memory, so it may be counted twice. Only files that the row of a
    finished task names are read: what a lost or repeated task leaves doesn't count.
    """
    spark = df.sparkSession
    folder, fields = scratch(spark, tag), arrow_schema(spark, schema)
    make_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        made = (pa.RecordBatch.from_arrays(batch.columns, schema=fields) for batch in run(batches) if batch.num_rows)
        if (first := next(made, None)) is None:
            return
        fs, root = open_fs(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        with fs.open_output_stream(f"{root}/{name}") as f, pq.ParquetWriter(f, fields, compression="zstd", compression_level=3, use_dictionary=False, write_statistics=False) as writer:
            held, size = [], 0
            for batch in chain([first], made):
                held.append(batch)
                size += batch.nbytes
                if size >= ARROW_BYTES:
                    writer.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
            if held:
                writer.write_table(pa.Table.from_batches(held))
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

    paths = sorted(r.path for r in df.mapInArrow(write, "path string").collect())  # a row a task
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage, Python's first, as that refers to the JVM's: shuffle files, broadcast tables and generated classes go with what referred to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read again."""
    for df in tables:
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path_)
        hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def range_cuts(keys: DataFrame, ranges: int) -> list[tuple]:
    """First keys of all ranges but the lowest, as tuples in ascending order, for about equal ranges of the rows of keys.

    Spark's range partitioner finds them from a bounded sample of each partition; at most ``ranges`` rows reach the driver.
    """
    if ranges <= 1:
        return []
    names = keys.columns
    dealt = keys.repartitionByRange(ranges, *names).groupBy(F.spark_partition_id().alias("range_")).agg(F.min(F.struct(*names)).alias("low"))
    return sorted({tuple(r.low) for r in dealt.collect()})[1:]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for Python workers."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:") :]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)


def map_arrow(df: DataFrame, rows: Callable[[dict[str, list], int], dict[str, Any]], schema: str) -> DataFrame:
    """Apply a batch function (columns as Python lists -> output columns as lists) to every Arrow batch."""
    small_batches(df.sparkSession)
    out = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rows(batch.to_pydict(), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def text_of(column: str) -> F.Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
