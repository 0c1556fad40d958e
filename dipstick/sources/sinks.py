"""Ledgers and artefacts out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Header CSV, one folder of part files; no ordering and no single-file bottleneck."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)
    return path


def write_json_object(df: DataFrame, key: str, value: str, path: str) -> str:
    """A two-column table as one JSON object; meant for small lookups such as twelve multipliers."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value))))
    df.agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.mode("overwrite").text(path)
    return path


def write_json_list(df: DataFrame, position: str, value: str, path: str) -> str:
    """A column as one ordered JSON array; meant for a feature list."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(position), F.col(value))))
    df.agg(F.to_json(ordered[value]).alias("value")).write.mode("overwrite").text(path)
    return path


def write_records(df: DataFrame, path: str) -> str:
    """Records as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path
