"""Normalized texts: the same characters, and tasks of one JVM that do not slow each other down."""

import time

from pyspark.sql import functions as F

from dossierspark.functions import text as X


def test_normalizing_side_by_side_is_as_fast_as_a_plain_replacement(spark):
    # Eight tasks took over forty times as long as with the plain replacement: they slowed each other down.
    text = F.concat(F.col("id").cast("string"), F.lit(" some words of a text, and More" * 100))
    df = spark.range(0, 4800, 1, 8).select(text.alias("t")).cache()
    df.count()

    def seconds(c):
        def once():
            start = time.perf_counter()
            df.select(c.alias("x")).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

        return min(once() for _ in range(3))

    plain = seconds(F.regexp_replace("t", " ", "_"))
    for c in (X.normalize_text(F.col("t")), X.text_key(F.col("t"))):
        took = seconds(c)
        assert took < 12 * plain + 0.1, (took, plain)


def test_normalizing_keeps_the_same_characters(spark):
    odd = "".join(map(chr, range(1, 0x250))) + " Ⅷ²½ K 𝄞 a b"
    got = spark.createDataFrame([(odd,)], "t string").select(X.normalize_text(F.col("t")).alias("n"), X.text_key(F.col("t")).alias("k"),
        F.trim(F.regexp_replace(F.lower(X.one_line(F.col("t"))), r"[^a-z0-9.%$]+", " ")).alias("wn"),
        F.trim(F.regexp_replace(F.lower("t"), r"[^a-z0-9]+", " ")).alias("wk")).first()
    assert got.n == got.wn and got.k == got.wk
