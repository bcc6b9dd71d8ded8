"""Register a folder of tables in the catalog and report what happened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def load_tables(spark: SparkSession, folder: str, names, prefix: str = "", reimport: bool = False) -> DataFrame:
    """External tables over the files, in name order; existing ones are skipped unless ``reimport``."""
    report = []
    for name in sorted(names):
        full = f"{prefix}{name}"
        try:
            if spark.catalog.tableExists(full):
                if not reimport:
                    report.append((name, "skipped", ""))
                    continue
                spark.sql(f"DROP TABLE {full}")
            spark.catalog.createTable(full, path=f"{folder}/{name}.parquet", source="parquet")
            report.append((name, "imported", ""))
        except Exception as exc:
            report.append((name, "failed", str(exc)))
    return spark.createDataFrame(report, "table_name string, status string, message string")
