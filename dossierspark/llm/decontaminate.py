"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short, documents long, so a symmetric MinHash of both would drown the item. The search is one-sided: items are
partitioned by the size of their shingle set (a power of two is one part), and each part has one signature width
k = u - ceil(u num/den) + 1 for its largest set u: an item's signature are the k smallest hashes of its set (all if it has
fewer). A document that contains num/den of the item contains at least one of them: it misses at most n - ceil(n num/den) < k.
So no match is lost, and most documents meet no signature at all. Candidates are verified by the exact share of the item's
shingles in the whole document.

The items are a stated query set. They go past the documents in blocks of at most ``ITEMS`` items, each broadcast.

Defined results: words are runs of letters and digits in lower case; an item with fewer words than a shingle is one shingle of
its own width, and documents are cut at the widths that the items have, so it is found inside longer texts; items or documents that are null or without words match nothing; repeated rows
of an item_id are one item (its smallest text), repeated rows of a doc_id give one row; an empty benchmark matches nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierspark.llm.rows import checked_broadcast, quoted, with_columns
from dossierspark.llm.shingles import WordHashes, letter_words, runs_set, shingle_set
from dossierspark.session import durable

#: Items of one block, words of a shingle.
ITEMS, SHINGLE = 50_000, 5


def signature_width(n: int, num: int, den: int) -> int:
    top = 1 << (n - 1).bit_length()
    return min(n, top - (top * num + den - 1) // den + 1)


def _index(items: list[tuple[int, str]], num: int, den: int):
    """Sets by place, the sorted signature hashes with the items that hold them, and the widths of shingles."""
    known = WordHashes()
    texts = [(item, words) for item, text in items if (words := letter_words(text))]
    sets = [(item, shingle_set(words, known)) for item, words in texts]
    hashes = np.concatenate([*[s[:signature_width(len(s), num, den)] for _, s in sets], np.empty(0, np.int64)])
    owners = np.repeat(np.arange(len(sets)), [min(len(s), signature_width(len(s), num, den)) for _, s in sets])
    order = np.argsort(hashes, kind="stable")
    return sets, hashes[order], owners[order], sorted({min(SHINGLE, len(words)) for _, words in texts})


def contained(docs: DataFrame, benchmark: DataFrame, num: int = 4, den: int = 5, block: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared) of every document that holds at least num/den of an item's shingles."""
    clean = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))
    blocks = -(-clean.count() // block) or 1
    found = None
    for k in range(blocks):
        part = clean.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        pairs = _search(docs, _index(sorted((r["item_id"], r["text"]) for r in part), num, den), num, den)
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def _search(docs: DataFrame, index, num: int, den: int) -> DataFrame:
    sets, hashes, owners, widths = index
    found_type = pa.struct([("item_id", pa.int64()), ("item_shingles", pa.int64()), ("shared", pa.int64())])

    def make():
        known = WordHashes()
        door = np.zeros(1 << 20, bool)
        door[hashes & 0xFFFFF] = True

        def of(text):
            s = runs_set(letter_words(text), known, widths)
            near = s[door[s & 0xFFFFF]]
            lo, hi = np.searchsorted(hashes, near, "left"), np.searchsorted(hashes, near, "right")
            out = []
            for place in sorted({int(owners[j]) for a, b in zip(lo, hi) for j in range(a, b)}):
                item, own = sets[place]
                at = np.minimum(np.searchsorted(s, own), len(s) - 1)
                same = int((s[at] == own).sum())
                if den * same >= num * len(own):
                    out.append({"item_id": item, "item_shingles": len(own), "shared": same})
            return out

        return lambda column: [pa.array([of(column[i].as_py()) for i in range(len(column))], pa.list_(found_type))]

    rows = with_columns(docs.select("doc_id", "text"), ["text"],
                        "found array<struct<item_id: bigint, item_shingles: bigint, shared: bigint>>", make, ("text",))
    return rows.filter(F.col("doc_id").isNotNull()).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` without those that hold a benchmark item."""
    hit = durable(contained(docs, benchmark, num, den).select("doc_id").distinct())
    return docs.join(checked_broadcast(hit), "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])
