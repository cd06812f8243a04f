"""Reading and writing of tracks, pairs, features and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MOT_BOX, RAW_FRAGMENT


def _named(df: DataFrame) -> DataFrame:
    """``_id`` as a plain string: files have it as text or as an object with ``$oid``."""
    oid = F.coalesce(F.get_json_object("_id", "$['$oid']"), F.col("_id"))
    return df.withColumn("_id", oid)


def read_fragments(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Track documents from JSON arrays (not splittable: convert once with ``write_fragments``) or JSON lines."""
    raw = spark.read.schema(RAW_FRAGMENT).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    return _named(raw.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record"))


def write_fragments(f: DataFrame, path: str, by: tuple[str, ...] = ("direction",)) -> None:
    f.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_quarantine(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, text of malformed ones) of JSON lines."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", RAW_FRAGMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r._id").isNull() | F.col("r.timestamp").isNull()
    return _named(parsed.filter(~bad).select("r.*").drop("_corrupt_record")), parsed.filter(bad).select("value")


def append_new(batch: DataFrame, existing: DataFrame, key: str = "_id") -> DataFrame:
    """Rows of ``batch`` whose key the sink does not have, one for each key. Only keys of the sink are read."""
    return batch.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def write_append(batch: DataFrame, path: str, key: str = "_id") -> None:
    spark = batch.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        batch = append_new(batch, spark.read.parquet(path), key)
    else:
        batch = batch.dropDuplicates([key])
    batch.write.mode("append").parquet(path)


def fragment_store(fragments: DataFrame, ref: str = "fragment_ref") -> DataFrame:
    return fragments.dropDuplicates([ref])


def write_pair_store(pairs: DataFrame, fragments: DataFrame, path: str) -> None:
    """Thin pair rows by split as JSON lines, and each fragment once."""
    pairs.write.mode("overwrite").partitionBy("split").json(f"{path}/pairs")
    fragment_store(fragments).write.mode("overwrite").json(f"{path}/fragments")


def resolve_pairs(pairs: DataFrame, fragments: DataFrame, split: str | None = None) -> DataFrame:
    """Pair rows of one split with both fragments' columns beside them."""
    p = pairs.filter(F.col("split") == split) if split else pairs
    side = lambda s: fragments.select(*(F.col(c).alias(f"{s}_{c}") for c in fragments.columns))
    return p.join(side("a"), "a_fragment_ref").join(side("b"), "b_fragment_ref")


def load_pairs(spark: SparkSession, path: str, split: str) -> DataFrame:
    return resolve_pairs(spark.read.json(f"{path}/pairs"), spark.read.json(f"{path}/fragments"), split)


def write_features(x: DataFrame, path: str) -> None:
    x.write.mode("overwrite").parquet(path)


METADATA_DEFAULTS = {"pair_id": "", "source_split_tag": "unknown", "scenario": "unknown", "mask_idx": -1}


def with_metadata(x: DataFrame) -> DataFrame:
    """Missing metadata columns and values get their defaults."""
    have = set(x.columns)
    return x.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in METADATA_DEFAULTS.items()})


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return with_metadata(spark.read.parquet(path))


def read_mot_csv(spark: SparkSession, path: str) -> DataFrame:
    """frame, id, left, top, width, height; further columns of a file are ignored."""
    return spark.read.schema(MOT_BOX).option("mode", "PERMISSIVE").csv(path).filter("frame is not null")


def parse_metric_reports(lines: DataFrame, value: str = "value") -> DataFrame:
    """(report, metric, number) from printed 'Name: 1.23' lines; minus signs stay. ``lines``: report, value (whole text)."""
    rows = lines.select("report", F.explode(F.split(value, "\n")).alias("line"))
    pattern = r"^\s*([A-Za-z][A-Za-z0-9_/ ]*?)\s*[:=]\s*(-?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)\s*$"
    out = rows.select("report", F.regexp_extract("line", pattern, 1).alias("metric"), F.regexp_extract("line", pattern, 2).alias("number"))
    return out.filter("metric != ''").withColumn("number", F.col("number").cast("double"))


def manifest(rows: DataFrame, kept: DataFrame, keys: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """Row counts before and after a filter."""
    before = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_before"))
    after = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_after"))
    return before.join(after, list(keys), "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))
