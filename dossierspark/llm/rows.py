"""Shared plumbing: Arrow batches past a Python function, labelled samples, checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossierspark.session import is_at_most

#: Rows up to which a side is broadcast; larger sides are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Arrow bytes that a Python function gets at once, and about what it gives back; a longer row comes alone.
CUT_BYTES = 4 << 20
#: Characters that one numpy pass handles at once.
PASS_CHARS = 2_000_000


_kept: dict = {}


def kept(key, build: Callable):
    """Tables of one operator that a worker keeps from task to task. There is one place: another operator's tables take it."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def release() -> None:
    _kept.clear()


def give_back() -> None:
    """Returns what a task has freed to the system, so that a worker that waits for its next task holds little memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def with_columns(df: DataFrame, inputs: list[str], fields: str, make: Callable[[], Callable], drop: tuple[str, ...] = (),
                 keeps: bool = False) -> DataFrame:
    """``df`` with the columns of ``fields`` that a Python function computes from Arrow columns.

    ``make()`` runs once per task and returns ``fn(*input columns) -> list of arrays``. Columns of ``df`` that
    are named like a new one (in any case) are replaced; those in ``drop`` are read but not returned. Unless ``make`` ``keeps`` tables
    in the worker, those of an earlier operator are released first.
    """
    new = StructType.fromDDL(fields)
    gone = {n.casefold() for n in [*new.names, *drop]}
    keep = [c for c in df.columns if c.casefold() not in gone]
    source = df.select(*[quoted(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], *[quoted(c).alias(f"_input_{i}") for i, c in enumerate(inputs)])
    schema = StructType([f for f in df.schema.fields if f.name in keep] + new.fields)
    names, n_keep = schema.names, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        fn = make()
        for batch in batches:
            rows = max(1, batch.num_rows * CUT_BYTES // max(batch.nbytes, CUT_BYTES))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], *fn(*part.columns[n_keep:])], names=names)
        fn = batch = part = None
        give_back()

    return source.mapInArrow(run, schema)


def passes(texts: list[str], most: int = PASS_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters; a longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def crc_rest(id_: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(id_).cast("string").cast("binary")) % F.lit(mod)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` has at most ``rows`` rows; else Spark joins it by shuffle."""
    return F.broadcast(df) if is_at_most(df, rows) else df


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_docs: int, max_chars: int) -> list[tuple[str, int]]:
    """Texts and labels to learn from: at most ``max_docs`` labelled rows, in the order of a hash of their id.

    Rows whose crc32(doc_id) mod 5 is 0 are never taken; nor are null labels, null or empty texts, or texts over
    ``max_chars``. The bound holds for learning alone. A doc_id with several rows counts once, with its smallest label and text.
    """
    rows = labels.filter((crc_rest("doc_id", 5) != 0) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("_label"))
    usable = docs.select("doc_id", "text").filter(F.length("text").between(1, max_chars))
    known = rows.join(usable.select("doc_id").distinct(), "doc_id", "left_semi")
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = usable.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    return [(r["text"], int(r["_label"])) for r in sorted(texts.collect(), key=lambda r: r["doc_id"])]
