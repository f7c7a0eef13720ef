"""Helpers of the training-data operators: shared storage, stored intermediate tables, connected components, memory of the
executors' Python workers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20

_kept: list = [None, None]


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a temporary one for local masters where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="usagelens-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = new_folder(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of ``stored`` frames that no frame in use reads any more."""
    for frame in frames:
        root = shared_root(frame.sparkSession).partition(":")[2].lstrip("/") or shared_root(frame.sparkSession)
        for folder in {name.rpartition("/")[0] for name in frame.inputFiles()}:
            if root not in folder:
                raise ValueError(f"{folder} is not a stored frame")
            files, path = store(folder)
            files.delete_dir(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b), both long: rows (node, root), root the smallest node.

    Alternating large-star and small-star steps: every step is a grouped minimum (partial before the shuffle) and a
    join that adaptive execution may split, so no neighbour list is ever gathered. Each round is stored. Nodes without
    an edge to another node are not listed; no edges give no rows.
    """
    def signature(frame: DataFrame):
        return frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    current = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = signature(current)
    while before[0]:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select("b", "a"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = stored(lowest.select("a", F.col("m").alias("b")).union(moved).distinct(), "stars")
        after = signature(current)
        if after == before:
            break
        before = after
    members = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.union(current.select("b", "b").distinct())


def small_batches(spark: SparkSession) -> None:
    """Rows go to and from Python workers in Arrow batches of about ``BATCH_BYTES``, unless the session has a limit of its own.

    A batch exists several times, in the JVM's direct memory and in the worker. Spark's 10,000 rows are 34 MB where texts
    have 3.4 kB; a limit in bytes holds for texts of any length. It cuts no input: there are more batches instead.
    """
    if ARROW_BYTES not in spark.conf.getAll:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def kept(owner: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker process keeps for its later tasks: one thing, of the owner that asked last.

    Spark reuses worker processes, so what one stage remembers would lie beside the memory of all later stages.
    """
    if _kept[0] != owner:
        release()
        _kept[:] = [owner, make()]
    return _kept[1]


def release() -> None:
    """Drops what this worker process keeps; for tasks that keep nothing themselves."""
    _kept[:] = [None, None]


def store(path: str):
    """The pyarrow file system and the path in it for a folder of the shared storage, local or remote."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1))


def publish(files, temporary: str, final: str) -> None:
    """Give a finished file its final name; a repeated task replaces it by an equal one."""
    from pyarrow import fs

    try:
        files.move(temporary, final)
    except OSError:
        if files.get_file_info(final).type == fs.FileType.NotFound:
            raise
        files.delete_file(final)
        files.move(temporary, final)
