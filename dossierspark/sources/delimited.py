"""Delimited files read by several tasks each, with line breaks inside quoted fields.

A line alone does not tell whether it starts inside a quoted field. Two column expressions tell how it ends: if it starts outside, and if it
starts inside. A block (one split of a file) is summed up the same way, one narrow row a block; running totals over the blocks of a
file give the state each block starts in. With it every task cuts its own block into records, without a shuffle of lines. Only pieces of
records that cross a block's edge are grouped.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossierspark.session import durable, is_at_most

BROADCAST_BLOCKS = 500_000
_BLOCK = ["_file", "_at", "_len"]


def ends_inside(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted field if it starts outside, and if it starts inside. Doubled quotes stay inside."""
    s = re.escape(sep)
    other = f"[^{s}]*+"
    body = '[^"]*+(?:""[^"]*+)*+'
    field = f'(?:"{body}"{other}|(?!"){other})'
    opened = f'(?:{field}{s})*+"{body}\\z'
    return line.rlike(f"\\A{opened}"), line.rlike(f'\\A{body}(?:\\z|"{other}{s}{opened})')


def line_states(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """State after each line of a block that starts in ``start``: the last line that settles it, turned by the lines since that swap it."""
    fixed, swap = outside == inside, outside & ~inside
    turns = np.cumsum(swap)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
    settled = np.where(last >= 0, outside[last] ^ (turns[last] & 1).astype(bool), start)
    return settled ^ (turns & 1).astype(bool)


def _by_block(batches):
    """Batches cut where the block changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column("_at").to_numpy()
        code = batch.column("_file").dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero((at[1:] != at[:-1]) | (code[1:] != code[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(at)]):
            yield tuple(batch.column(c)[int(a)].as_py() for c in _BLOCK), batch.slice(a, b - a)


def _sums(batches):
    """One row a block: end state and whether a record ends in it, for both states at its start."""
    schema = pa.schema([("_file", pa.string()), ("_at", pa.int64()), ("_len", pa.int64()), ("out", pa.bool_()), ("ins", pa.bool_()), ("cut_out", pa.bool_()), ("cut_in", pa.bool_())])
    now, state, cut = None, [False, True], [False, False]
    row = lambda: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*now, *state, *cut], schema)], schema=schema)
    for block, part in _by_block(batches):
        if block != now:
            if now:
                yield row()
            now, state, cut = block, [False, True], [False, False]
        o, i = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_o", "_i"))
        for k in (0, 1):
            after = line_states(o, i, state[k])
            state[k], cut[k] = bool(after[-1]), cut[k] or not after.all()
    if now:
        yield row()


def _starts(sums: DataFrame) -> DataFrame:
    """Per block the state at its start and the number of earlier blocks of the file in which a record ends."""
    w = Window.partitionBy("_file").orderBy("_at")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    odd = lambda c: (c % 2) == 1
    turns = F.sum(F.when(F.col("out") & ~F.col("ins"), 1).otherwise(0))
    told = sums.withColumns({"_turns": turns.over(w), "_turned": F.coalesce(turns.over(before), F.lit(0))})
    settled = F.when(F.col("out") == F.col("ins"), F.col("out") != odd(F.col("_turns")))
    told = told.withColumn("_settled", F.coalesce(F.last(settled, True).over(before), F.lit(False)))
    told = told.withColumn("_start", F.col("_settled") != odd(F.col("_turned")))
    cut = F.when(F.col("_start"), F.col("cut_in")).otherwise(F.col("cut_out"))
    return told.withColumn("_cut", cut.cast("long")).select(
        *_BLOCK, "_start", F.coalesce(F.sum("_cut").over(before), F.lit(0)).alias("_group"))


_RECORDS = "_file string, _at long, _group long, _first boolean, record string"


def _records(batches):
    """Whole records (no group), and the pieces at a block's edges with the group that they are put together by."""
    schema = pa.schema([("_file", pa.string()), ("_at", pa.int64()), ("_group", pa.int64()), ("_first", pa.bool_()), ("record", pa.string())])
    now, state, held, group, seen, head = None, False, [], 0, False, False

    def out(block, rows, piece=None):
        nonlocal seen
        first = [False] * len(rows)
        if rows and not seen:
            first[0], seen = block[1] == 0, True
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(
            [[block[0]] * len(rows), [block[1]] * len(rows), [piece] * len(rows), first, rows], schema)], schema=schema)

    for block, part in _by_block(batches):
        if block != now:
            if held:
                yield out(now, ["\n".join(held)], group)
            now, held, seen = block, [], False
            state, group = part.column("_start")[0].as_py(), part.column("_group")[0].as_py()
            if state is None:
                raise RuntimeError("the splits of the files changed between two passes; keep files and session settings as they are")
            head = state
        lines = part.column("value")
        after = line_states(*(part.column(c).to_numpy(zero_copy_only=False) for c in ("_o", "_i")), state)
        before = np.concatenate([[state], after[:-1]])
        whole = not (before.any() or after.any())
        rows = [t for t in lines.to_pylist() if t.rstrip("\r")] if whole else []
        if not whole:
            for text, was, goes in zip(lines.to_pylist(), before, after):
                if not was and not goes:
                    if text.rstrip("\r"):
                        rows.append(text)
                    continue
                held.append(text)
                if not goes:
                    if head:  # the end of a record that an earlier block began
                        yield out(now, ["\n".join(held)], group)
                    else:
                        rows.append("\n".join(held))
                    held, head = [], False
        # A piece at the end of the block belongs to the next group once a record has ended in this block.
        if not after.all() and part.column("_group")[0].as_py() == group:
            group += 1
        state = bool(after[-1])
        if rows:
            yield out(now, rows)
    if held:
        yield out(now, ["\n".join(held)], group)


def records(spark: SparkSession, path, sep: str) -> DataFrame:
    """One row a record: ``record``, and ``_first`` for the first one of a file. Blank lines between records are left out."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
        F.col("_metadata.file_block_length").alias("_len"))
    o, i = ends_inside(F.col("value"), sep)
    lines = lines.withColumns({"_o": o, "_i": i})
    sums = lines.select(*_BLOCK, "_o", "_i").mapInArrow(_sums, "_file string, _at long, _len long, out boolean, ins boolean, cut_out boolean, cut_in boolean")
    starts = durable(_starts(sums))
    placed = lines.withColumn("_line", F.monotonically_increasing_id())
    if is_at_most(starts, BROADCAST_BLOCKS):
        placed = placed.join(F.broadcast(starts), _BLOCK, "left")
    else:
        placed = placed.join(starts, _BLOCK, "left").repartition(*_BLOCK)
    found = placed.sortWithinPartitions(*_BLOCK, "_line").drop("_line").mapInArrow(_records, _RECORDS)
    cut = found.filter(F.col("_group").isNotNull()).groupBy("_file", "_group").agg(
        F.max("_first").alias("_first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "record"))), lambda p: p["record"]), "\n").alias("record"))
    return found.filter(F.col("_group").isNull()).select("record", "_first").unionByName(cut.select("record", "_first"))


def read_delimited(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    """Every column a string; an empty field stays an empty string. Each file starts with a header; the first file's names count.

    Short rows are filled with empty strings, fields beyond the header are left out. A quote that never closes takes the rest of its file.
    """
    options = {"sep": sep, "escape": '"', "emptyValue": "", "multiLine": "true"}
    # Names alone: schema inference without types looks at one record.
    names = spark.read.options(header=True, inferSchema=False, **options).csv(path).columns
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = records(spark, path, sep).filter(~F.col("_first")).select(F.from_csv(F.regexp_replace("record", r"\r\z", ""), fields, options).alias("r"))
    return rows.select(*[F.coalesce(F.col(f"r.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)])
