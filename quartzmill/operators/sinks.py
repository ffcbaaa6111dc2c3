"""Result files: metrics, features, model, attributions, manifest, summary and exit code."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bytes(data: bytes, path: str) -> str:
    """A small file of the driver's: a local path, or with a scheme any file system that Spark reaches."""
    if "://" in path:
        spark = SparkSession.getActiveSession()
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return path
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(data)
    return path


def write_text(text: str, path: str) -> str:
    return write_bytes(text.encode("utf-8"), path)


def write_json(record: dict, path: str) -> str:
    return write_text(json.dumps(record, indent=4, ensure_ascii=False, default=str), path)


def feature_lines(chosen: DataFrame) -> DataFrame:
    """``(pos, line)``: ``1. F026``."""
    return chosen.select("pos", F.concat_ws(". ", F.col("pos").cast("string"), "feature").alias("line"))


def write_feature_list(chosen: DataFrame, path: str) -> str:
    lines = [r.line for r in feature_lines(chosen).orderBy("pos").collect()]  # as many as features
    return write_text("\n".join(lines) + "\n", path)


def write_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def metrics_record(records: DataFrame) -> dict[str, dict[str, float | None]]:
    """``(model, metric, value)`` as a nested record."""
    out: dict[str, dict[str, float | None]] = {}
    for r in records.collect():
        out.setdefault(r.model, {})[r.metric] = r.value
    return out


def summary(record: dict[str, dict[str, float | None]]) -> list[str]:
    lines = []
    for model, metrics in record.items():
        shown = ", ".join(f"{k}={'N/A' if v is None else format(v, '.3f')}" for k, v in metrics.items())
        lines.append(f"{model}: {shown}")
    return lines


def exit_code(baseline_ok: bool | None) -> int:
    return 1 if baseline_ok is False else 0
