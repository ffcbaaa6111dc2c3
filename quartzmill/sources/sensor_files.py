"""Scans of sensor data and of the small files around them."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr

N_FEATURES = 591


def raw_schema(n_features: int = N_FEATURES) -> T.StructType:
    return T.StructType([T.StructField(f"F{i:03d}", T.StringType()) for i in range(1, n_features + 1)])


def clean_features(raw: DataFrame) -> DataFrame:
    return raw.select(*[expr.token_to_double(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def numbered(df: DataFrame) -> DataFrame:
    """A scan ``df`` of text files with ``row_id``: the position in the files, in order of their paths.

    Counts of the files' blocks give each block's first number; within a block, rows keep the scan's order.
    """
    scanned = df.withColumns({"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()})
    blocks = scanned.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    starts = blocks.select("__file", "__block", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    joined = scanned.join(starts, ["__file", "__block"]).withColumn("row_id", F.col("__at") + F.col("__shift"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], "row_id")


def read_features(spark: SparkSession, path: str, n_features: int = N_FEATURES) -> DataFrame:
    """Space-separated rows without a header; short rows are padded with nulls."""
    raw = spark.read.schema(raw_schema(n_features)).options(sep=" ", header=False).csv(path)
    rows = numbered(raw)
    return rows.select("row_id", *[expr.token_to_double(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_labels(spark: SparkSession, path: str, time_format: str = "dd/MM/yyyy HH:mm:ss") -> DataFrame:
    raw = numbered(spark.read.schema("label string, ts string").options(sep=" ", header=False).csv(path))
    return raw.select("row_id", expr.label_to_class(F.col("label").try_cast("int")).alias("y"), expr.parse_time(F.col("ts"), time_format).alias("ts"))


def read_sensors(spark: SparkSession, features: str, labels: str, n_features: int = N_FEATURES, time_format: str = "dd/MM/yyyy HH:mm:ss") -> DataFrame:
    """Features and labels paired by position."""
    return read_features(spark, features, n_features).join(read_labels(spark, labels, time_format), "row_id")


def to_long(wide: DataFrame, id_col: str = "row_id", label: str = "y", features: list[str] | None = None) -> DataFrame:
    """``(row_id, y, fidx, feature, value)``; fidx keeps the order of the columns."""
    features = features or [c for c in wide.columns if c not in (id_col, label, "ts")]
    cells = F.array(*[F.struct(F.lit(i).alias("fidx"), F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(features)])
    return wide.select(F.col(id_col).alias("row_id"), F.col(label).alias("y"), F.inline(cells))


def parse_feature_lines(lines: DataFrame, line_no: str = "line_no", value: str = "value") -> DataFrame:
    """The first ``F`` and three digits of each line, in order of lines."""
    found = F.regexp_extract(value, r"(F\d{3})", 1)
    return lines.select(line_no, found.alias("feature")).where("feature <> ''")


def small_text(path: str) -> str | None:
    """A small file of the driver's: a local path, or with a scheme any file system that Spark reaches; None if it is not there."""
    if "://" not in path:
        return Path(path).read_text(encoding="utf-8") if Path(path).is_file() else None
    spark = SparkSession.getActiveSession()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    text = small_text(path)
    if text is None:
        raise FileNotFoundError(path)
    lines = spark.createDataFrame(list(enumerate(text.splitlines())), "line_no int, value string")
    found = [r.feature for r in parse_feature_lines(lines).orderBy("line_no").collect()]
    if not found:
        raise ValueError(f"no feature names in {path}")
    return found


def read_feature_map(path: str) -> dict[str, str]:
    import yaml

    return {str(k): str(v) for k, v in (yaml.safe_load(small_text(path) or "") or {}).items()}


def read_config(path: str) -> dict:
    import yaml

    text = small_text(path)
    if text is None:
        raise FileNotFoundError(path)
    return yaml.safe_load(text)


def read_secrets(path: str, names: list[str]) -> dict[str, str | None]:
    """Values of a ``NAME=value`` file over the environment; None where absent."""
    found = dict(os.environ)
    for line in (small_text(path) or "").splitlines():
        name, eq, value = line.partition("=")
        if eq and not name.lstrip().startswith("#"):
            found[name.strip()] = value.strip().strip("\"'")
    return {n: found.get(n) for n in names}


def resolved(path: str, root: str) -> str:
    return str(p if (p := Path(path)).is_absolute() else Path(root) / p)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """``(model, metric, value)`` of a metrics file; entries that are not objects are skipped."""
    raw = spark.read.text(path, wholetext=True)
    models = F.from_json("value", "map<string, string>")
    entries = raw.select(F.explode(models).alias("model", "body")).where(F.col("body").startswith("{"))
    return entries.select("model", F.explode(F.from_json("body", "map<string, double>")).alias("metric", "value"))
