"""Language identification by prediction by partial matching.

Every language has a byte context tree of order 0 to 3 with escape probabilities (escape method C: a context seen
n times with d different next bytes escapes with d / (n + d)). The statistics are frozen after learning, so the code
length of a next byte after a context is a constant. Every learned context of a language has its row of constants, so scoring is a table
lookup per byte. The language with the shortest exact code length of the whole text wins.

Defined results: null texts and texts without a letter are ``und`` with score 0; equal code lengths go to the first
language by name; with nothing to learn from every text is ``und``. Repeated rows score alike; other columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossierspark.llm.rows import crc_rest, passes, with_columns

ORDER = 3
LEAD = b" " * ORDER
LETTER = re.compile(r"[^\W\d_]")
#: Bytes whose code lengths are looked up at once; a few arrays of eight bytes each stand beside them.
STEP = 1 << 17

@dataclass
class Ppm:
    """Counts of byte 4-grams (context of three, next byte) per language."""
    langs: list[str]
    codes: list[np.ndarray]
    counts: list[np.ndarray]

    def tables(self) -> list[Tree]:
        """The frozen tree of every language."""
        return [_tree(codes, counts) for codes, counts in zip(self.codes, self.counts)]


@dataclass
class Tree:
    """Bits of every (context, next byte) of one language. A context a b c has the row ``rows[block[b c] + a]``: that of its longest known ending.

    Bytes never learned cost the same after a context, so they share the last column; ``column`` tells the place of each byte in a row.
    """
    block: np.ndarray
    rows: np.ndarray
    bits: np.ndarray
    column: np.ndarray
    width: int


def _tree(codes: np.ndarray, counts: np.ndarray) -> Tree:
    pairs, triples = np.unique(codes >> 8 & 0xFFFF).astype(np.int64), np.unique(codes >> 8).astype(np.int64)
    n1, n2 = 1 + 256, 1 + 256 + len(pairs)
    seen = np.unique(codes & 255).astype(np.int64)
    width = len(seen) + 1
    column = np.full(256, len(seen), np.int32)
    column[seen] = np.arange(len(seen))
    # Blocks 0 to 255 are of pairs never seen and know the last byte alone; then a block a known pair.
    block = np.tile(np.arange(256, dtype=np.int32), 256) << 8
    block[pairs] = (256 + np.arange(len(pairs), dtype=np.int32)) << 8
    rows = np.repeat(np.concatenate([np.arange(1, n1), np.arange(n1, n2)]).astype(np.int32), 256)
    at = block[triples & 0xFFFF] + (triples >> 16)
    shorter = rows[at].copy()
    rows[at] = np.arange(n2, n2 + len(triples))
    cost = np.empty((n2 + len(triples), width), np.float32)
    level = lambda order, contexts, base: _level(codes, counts, order, contexts, base, column)
    cost[0] = level(0, np.zeros(1, np.int64), np.full((1, width), 8.0))[0]
    cost[1:n1] = level(1, np.arange(256), np.repeat(cost[:1], 256, 0))
    cost[n1:n2] = level(2, pairs, cost[1 + (pairs & 255)])
    for lo in range(0, len(triples), 4096):
        cost[n2 + lo:n2 + lo + 4096] = level(3, triples[lo:lo + 4096], cost[shorter[lo:lo + 4096]])
    return Tree(block, rows, cost.ravel(), column, width)


def _level(codes: np.ndarray, counts: np.ndarray, order: int, contexts: np.ndarray, shorter: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Bits of every next byte after each of the sorted contexts: its own count, or an escape and the shorter context's bits."""
    gram, at = np.unique(codes & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
    count = np.bincount(at, counts, len(gram)) if len(gram) else np.zeros(0)
    ctx, byte = (gram >> 8).astype(np.int64), column[gram & 255]
    row = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1) if len(contexts) else np.zeros(len(ctx), np.int64)
    own = contexts[row] == ctx if len(contexts) else np.zeros(len(ctx), bool)
    row, byte, count = row[own], byte[own], count[own]
    n, d = np.bincount(row, count, len(contexts)), np.bincount(row, minlength=len(contexts))
    out = shorter.astype(np.float64)
    known = n > 0
    out[known] += -np.log2(d[known] / (n[known] + d[known]))[:, None]
    out[row, byte] = -np.log2(count / (n[row] + d[row]))
    return out


def fit(samples: list[tuple[str, str]]) -> Ppm:
    """A model from (language, text) pairs."""
    by: dict[str, list[bytes]] = {}
    for lang, text in samples:
        by.setdefault(lang, []).append(LEAD + _bytes(text))
    model = Ppm(sorted(by), [], [])
    for lang in model.langs:
        parts = []
        for raw in by[lang]:
            b = np.frombuffer(raw, np.uint8).astype(np.uint32)
            parts.append(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:])
        codes, counts = np.unique(np.concatenate(parts), return_counts=True)
        model.codes.append(codes.astype(np.uint32))
        model.counts.append(counts)
    return model


def learn(docs: DataFrame, per_lang: int = 300, max_chars: int = 20_000, mod: int = 4, left_out: int = 2) -> Ppm:
    """Learns from at most ``per_lang`` documents a language, in the order of a hash of doc_id; of a document of more than ``max_chars``
    characters from so many in its middle.

    Rows whose crc32(doc_id) mod ``mod`` is ``left_out``, null languages and texts without a letter are not learned from.
    """
    beyond = F.greatest(F.lit(0), F.length("text") - max_chars)
    window = F.when(beyond == 0, F.col("text")).otherwise(F.substr("text", F.floor(beyond / 2).cast("int") + 1, F.lit(max_chars)))
    usable = docs.filter(F.col("lang").isNotNull() & (crc_rest("doc_id", mod) != left_out)).select("doc_id", "lang", window.alias("text")).filter(
        F.col("text").rlike(r"\p{L}"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = usable.select("doc_id", "lang").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_lang).select("doc_id", "lang").distinct()
    rows = usable.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    return fit([(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"]))])


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def code_lengths(texts: list[str], trees: list[Tree]) -> np.ndarray:
    """Bits of each text under each language, texts by languages."""
    raws = [LEAD + _bytes(t) for t in texts]
    ends = np.cumsum([len(r) for r in raws])
    starts = np.concatenate([[0], ends[:-1]]) + ORDER
    b = np.frombuffer(b"".join(raws), np.uint8)
    out = np.zeros((len(texts), len(trees)))
    for s in range(ORDER, len(b), STEP):
        e = min(len(b), s + STEP)
        w = b[s - ORDER:e].astype(np.int32)
        ending = w[1:-2] << 8 | w[2:-1]
        lo, hi = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left")
        left, right = np.maximum(starts[lo:hi], s) - s, np.minimum(ends[lo:hi], e) - s
        for k, tree in enumerate(trees):
            at = tree.rows[tree.block[ending] + w[:-3]] * np.int64(tree.width) + tree.column[w[3:]]
            total = np.concatenate([[0.0], np.cumsum(tree.bits[at], dtype=np.float64)])
            out[lo:hi, k] += total[np.maximum(right, left)] - total[left]
    return out


def identify(docs: DataFrame, model: Ppm, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with lang_pred, score (the winner's posterior) and bits_per_byte under the winner."""
    def make():
        trees = model.tables()

        def fn(column):
            texts = column.to_pylist()
            n = len(texts)
            lang, score, rate = ["und"] * n, np.zeros(n), np.zeros(n)
            real = [i for i, t in enumerate(texts) if t and model.langs and LETTER.search(t)]
            for lo, hi in passes([texts[i] for i in real]):
                part = real[lo:hi]
                length = code_lengths([texts[i] for i in part], trees)
                best = length.argmin(1)
                gap = np.exp2(-np.minimum(length - length.min(1)[:, None], 1000.0))
                score[part] = 1.0 / gap.sum(1)
                rate[part] = length.min(1) / np.array([len(_bytes(texts[i])) for i in part])
                for i, k in zip(part, best):
                    lang[i] = model.langs[k]
            return [pa.array(lang, pa.string()), pa.array(score), pa.array(rate)]
        return fn

    return with_columns(docs, [text], "lang_pred string, score double, bits_per_byte double", make, drop)
