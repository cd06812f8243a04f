"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session or its context.

    Where none is set, a local session (one JVM, as in tests) gets a temporary
    folder; a cluster doesn't, as its executors would not see it.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    Spark deletes a finished write's shuffle files once the driver's JVM has
    collected its plan, which on an idle driver is up to half an hour later; so
    the collection is asked for here.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def map_groups(rows: DataFrame, keys: list[str], work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``work(batch, bounds)`` over batches of whole groups by ``keys`` (bigint, no nulls); group g is rows bounds[g] to bounds[g + 1].

    For many small groups of bounded size: there is no call for each group as in
    ``applyInPandas``.  Shuffle partitions aren't coalesced, as few bytes may be much work.
    """

    def bounds_of(batch: pa.RecordBatch) -> np.ndarray:
        turns = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
        for name in keys:
            k = batch.column(name).to_numpy()
            turns |= k[1:] != k[:-1]
        return np.concatenate(([0], np.flatnonzero(turns) + 1, [batch.num_rows]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
                    whole = pa.concat_batches(held)
                    held = []
                    yield work(whole, bounds_of(whole))
                last = int(bounds_of(batch)[-2])
                if last:
                    whole = pa.concat_batches([*held, batch.slice(0, last)])
                    held = []
                    yield work(whole, bounds_of(whole))
                held.append(batch.slice(last))
        if held:
            whole = pa.concat_batches(held)
            yield work(whole, bounds_of(whole))

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def ranked(rows: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """``rows`` with their place (1, 2, ...) in ``order`` as column ``name``, from a range partition and the number of rows per task.

    Order by columns that tell rows apart, so that no range is crowded.
    """
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), label)
    task = F.shiftrightunsigned("_place", 33)
    counts = sorted(placed.groupBy(task.alias("task")).count().collect())
    before = np.concatenate(([0], np.cumsum([r["count"] for r in counts]))).tolist()
    starts = rows.sparkSession.createDataFrame([(r["task"], b) for r, b in zip(counts, before, strict=False)], "_task bigint, _before bigint")
    place = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(starts), task == F.col("_task")).select(*rows.columns, place.alias(name))
