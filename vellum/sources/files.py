"""Source documents and model artifacts as files: identity, first checks, and digests that must match.

Decoding pages needs a PDF library, which is a source of its own; what is here works on any file system Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes at a file's end in which an encrypted document names its dictionary.
TRAILER = 4096


def documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, source_sha256, n_bytes, status: ok, not_pdf or encrypted. Contents stay on the executors; empty files give no row."""
    files = spark.read.format("binaryFile").load(paths)
    text = lambda c: F.decode(c, "ISO-8859-1")
    end = F.expr(f"substring(content, greatest(length(content) - {TRAILER - 1}, 1), {TRAILER})")
    status = F.when(~F.contains(text(F.expr("substring(content, 1, 1024)")), F.lit("%PDF-")), "not_pdf").when(F.contains(text(end), F.lit("/Encrypt")), "encrypted").otherwise("ok")
    return files.select("path", F.sha2("content", 256).alias("source_sha256"), F.col("length").alias("n_bytes"), status.alias("status"))


def artifact_faults(spark: SparkSession, root: str, pinned: dict[str, str]) -> DataFrame:
    """name and fault (missing, differs) of pinned artifacts(name below root -> sha256) that aren't as they should be; no row: all are."""
    want = spark.createDataFrame(sorted(pinned.items()), "name string, want string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = files.select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("want"), "differs")
    return want.join(found, "name", "left").select("name", fault.alias("fault")).where("fault is not null")


def verify_artifacts(spark: SparkSession, root: str, pinned: dict[str, str]) -> None:
    """Raise for the first faulty artifact, by name."""
    bad = artifact_faults(spark, root, pinned).orderBy("name").first()
    if bad:
        raise ValueError(f"artifact {bad.name} {'is missing' if bad.fault == 'missing' else 'is not the pinned one'}")


def write_candidates(segments: DataFrame, path: str) -> None:
    """One JSON table, a folder for each family of techniques."""
    from vellum.operators.candidates import family

    segments.withColumn("family", family(F.col("technique"))).write.partitionBy("family").mode("errorifexists").json(path)
