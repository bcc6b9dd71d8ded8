"""Append what is new: as one batch, or from a stream of files that restarts where it stopped.

A store is partitioned by a hash of the id. An append reads the ids of those partitions only that its own ids fall in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierspark.operators.ranking import best_row
from dossierspark.session import durable

#: Partitions of a store; the same for its whole life.
PARTS, PART = 64, "_part"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The store with its partition column; None while it is empty."""
    try:
        return spark.read.parquet(path)
    except Exception as exc:
        if any(m in str(exc) for m in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "does not exist")):
            return None
        raise


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All rows that were appended."""
    return spark.read.parquet(path).drop(PART)


def stored_ids(stored: DataFrame, id_: str, parts) -> DataFrame:
    """Ids in some partitions of a store; files of the others are not opened."""
    return stored.filter(F.col(PART).isin(*parts)).select(PART, id_)


def incremental_append(new: DataFrame, store: str, id_: str, order) -> None:
    """Insert the rows whose id is not stored; repeated ids inside ``new`` keep their first row in ``order``."""
    spark = new.sparkSession
    part = F.pmod(F.xxhash64(F.col(id_).cast("string")), F.lit(PARTS)).cast("int")
    rows = durable(best_row(new, [id_], order).withColumn(PART, part))
    stored = _stored(spark, store)
    if stored is not None:
        hit = [r[0] for r in rows.select(PART).distinct().collect()]  # at most PARTS numbers
        rows = rows.join(stored_ids(stored, id_, hit), [PART, id_], "left_anti").select(*rows.columns)
    rows.repartition(PART).write.mode("append").partitionBy(PART).parquet(store)


def ingest_stream(spark: SparkSession, source: str, schema, store: str, checkpoint: str, id_: str, order) -> None:
    """Process all files not seen yet, then stop. A replayed batch inserts nothing twice."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: incremental_append(batch, store, id_, order))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
