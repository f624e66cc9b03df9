"""Writing the report and the masked texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_json(totals: DataFrame, records: DataFrame) -> DataFrame:
    """Rows as JSON strings: one of the totals, then one for each file (non-ASCII text unescaped)."""
    head = totals.select(F.lit(0).alias("part"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows = records.select(F.lit(1).alias("part"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    return head.unionByName(rows)


def write_report(totals: DataFrame, records: DataFrame, path: str) -> None:
    """Totals and file records as JSON lines under ``path``; records stay distributed."""
    totals.coalesce(1).write.mode("overwrite").json(f"{path}/totals")
    records.write.mode("overwrite").json(f"{path}/files")


def write_masked(texts: DataFrame, path: str, dossier: str = "dossier_id", buckets: int = 64) -> None:
    """Masked texts in Parquet, in folders by hashed dossier, so that no dossier makes a folder of its own."""
    texts.withColumn("bucket", F.pmod(F.xxhash64(dossier), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)
