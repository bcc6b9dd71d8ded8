"""Readers with declared schemas. A row that does not parse fails the job or goes to quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierspark.sources.delimited import read_delimited

__all__ = ["BAD", "fenced_json", "find_files", "flat_metadata", "json_rows", "list_lines", "read_delimited", "read_jsonl"]

BAD = "_bad_row"


def read_jsonl(spark: SparkSession, path, schema: T.StructType, mode: str = "strict"):
    """Strict: fails on a bad line. Lenient: returns ``(good, quarantine)``. Blank lines are skipped."""
    if mode == "strict":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    line = F.col("value")
    parsed = spark.read.text(path).filter(F.trim(line) != "").select(
        F.from_json(line, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
    bad = F.col(f"r.{BAD}").isNotNull()
    return parsed.filter(~bad).select(*[f"r.{n}" for n in schema.names]), parsed.filter(bad).select(f"r.{BAD}")


def json_rows(doc: Column, schema: T.StructType, list_keys) -> Column:
    """Rows of one JSON text: a list, an object that holds a list, or a plain object. Null when it is neither."""
    rows = T.ArrayType(schema)
    holder = T.StructType([T.StructField(k, rows) for k in list_keys])
    held = F.from_json(doc, holder)
    inner = F.coalesce(*[held[k] for k in list_keys])
    single = F.from_json(doc, schema)
    some = F.coalesce(*[single[f.name].cast("string") for f in schema.fields])
    return F.when(F.ltrim(doc).startswith("["), F.from_json(doc, rows)).otherwise(
        F.coalesce(inner, F.when(some.isNotNull(), F.array(single))))


def fenced_json(text: Column) -> Column:
    """The outermost JSON list or object inside free text or a code fence."""
    body = F.regexp_replace(text, r"(?s)^.*?```(?:json)?[ \t]*\n|\n```.*$", "")
    listed = F.regexp_extract(body, r"(?s)^[^{\[]*(\[.*\])", 1)
    return F.when(listed != "", listed).otherwise(F.regexp_extract(body, r"(?s)(\{.*\})", 1))


def list_lines(spark: SparkSession, path) -> DataFrame:
    """Non-blank lines that are not comments."""
    line = F.trim(F.col("value"))
    return spark.read.text(path).select(line.alias("line")).filter((line != "") & ~line.startswith("#"))


def find_files(spark: SparkSession, path: str, suffixes, skip_terms, release: str = r"release_[0-9]{4}_[0-9]{2}_[0-9]{2}") -> DataFrame:
    """Files below a folder by suffix and skip terms, with the release label of their path. Reads no content."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", "length")
    )
    low = F.lower("path")
    keep = low.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    for term in skip_terms:
        keep = keep & ~low.contains(term)
    return files.filter(keep).withColumn("release", F.regexp_extract("path", release, 0))


def flat_metadata(df: DataFrame) -> DataFrame:
    """Only scalars: null text becomes '', lists and structs become JSON text, NaN becomes null, numbers stay."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f.name), f.dataType
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            c = F.coalesce(F.to_json(c), F.lit(""))
        elif isinstance(kind, T.StringType):
            c = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\r\f\x0B]+", " "))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(kind))
        out.append(c.alias(f.name))
    return df.select(*out)
