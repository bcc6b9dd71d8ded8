"""Text preparation over tables of documents: units, furniture, chunks, metadata, statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dossierspark.functions import rules as RU
from dossierspark.functions import text as X
from dossierspark.operators.ranking import top_n
from dossierspark.session import durable, is_at_most


def paragraph_units(df: DataFrame, id_: str, text: str, sep: str = r"\n[ \t]*\n", keep=()) -> DataFrame:
    parts = df.select(id_, *keep, F.posexplode(F.split(F.col(text), sep)).alias("position", "_raw"))
    return parts.select(id_, *keep, F.col("position").cast("long").alias("position"),
                        X.one_line(F.col("_raw")).alias("paragraph")).filter("paragraph <> ''")


def sentence_units(df: DataFrame, id_: str, text: str, keep=()) -> DataFrame:
    parts = df.select(id_, *keep, F.posexplode(X.sentences(F.col(text))).alias("position", "sentence"))
    return parts.withColumn("position", F.col("position").cast("long"))


def edge_line_counts(pages: DataFrame, group: str, lines: str, edge: int = 4, max_len: int = 160, least: int = 3,
                     share: int = 4) -> DataFrame:
    """Lines that repeat at page edges on at least max(3, pages/4) pages of their group.

    Only the edge lines leave the page row, at most ``2 * edge`` per page.
    """
    n = F.size(lines)
    ends = F.array_distinct(F.concat(
        F.slice(F.col(lines), 1, edge), F.slice(F.col(lines), F.greatest(n - edge + 1, F.lit(1)), edge)))
    edges = pages.select(group, F.explode(F.filter(ends, lambda s: F.length(s) <= max_len)).alias("line"))
    counts = edges.groupBy(group, "line").agg(F.count(F.lit(1)).alias("n_pages"))
    totals = pages.groupBy(group).agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(totals, group).filter(
        F.col("n_pages") >= F.greatest(F.lit(least).cast("long"), F.floor(F.col("pages") / share)))


def strip_furniture(pages: DataFrame, group: str, lines: str, out: str, **limits) -> DataFrame:
    """Pages without repeated edge lines and page numbers.

    A group has at most ``2 * edge * max(share, least)`` repeated lines, because each page adds at
    most ``2 * edge`` and each needs its share of the pages. So the list joins as one small array
    per group and page texts are never exploded.
    """
    repeated = edge_line_counts(pages, group, lines, **limits).groupBy(group).agg(
        F.collect_list("line").alias("_furniture"))
    joined = pages.join(repeated, group, "left")
    drop = F.coalesce(F.col("_furniture"), F.array().cast("array<string>"))
    kept = F.filter(F.col(lines), lambda s: ~F.array_contains(drop, s) & ~s.rlike(r"^[- ]*[0-9]{1,4}[- ]*$"))
    return joined.withColumn(out, kept).drop("_furniture")


_WORD = re.compile(r"[A-Za-z0-9_]+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def _count(text: str) -> int:
    return len(_WORD.findall(text))


def _split_long(text: str, maximum: int) -> list[tuple[str, int]]:
    """Pieces of whole sentences, each with at most ``maximum`` words where its sentences allow it."""
    pieces, held, words = [], [], 0
    for sentence in _SENTENCE_END.split(text):
        n = _count(sentence)
        if held and words + n > maximum:
            pieces.append((" ".join(held), words))
            held, words = [], 0
        held.append(sentence)
        words += n
    if held:
        pieces.append((" ".join(held), words))
    return [(t.strip(), n) for t, n in pieces if t.strip()]


def pack_paged(units, target: int, maximum: int, overlap: int, minimum: int) -> Iterator[tuple[str, int, int]]:
    """(text, words, first page) of chunks of consecutive (unit, page); linear in the units because each keeps its word count."""
    def sized():
        for unit, page in units:
            n = _count(unit)
            yield from [(unit, n, page)] if n <= maximum else [(t, k, page) for t, k in _split_long(unit, maximum)]

    def tail(held):
        total, start = 0, len(held)
        while start > 0 and (overlap > 0 and total < overlap):
            start -= 1
            total += held[start][1]
        return held[start:], total

    def joined(held, words):
        return "\n\n".join(t for t, _, _ in held), words, held[0][2]

    held, words = [], 0
    for text, n, page in sized():
        if held and words + n > maximum:
            if words >= minimum:
                yield joined(held, words)
            held, words = tail(held)
        held.append((text, n, page))
        words += n
        if target and words >= target:
            if words >= minimum:
                yield joined(held, words)
            held, words = tail(held)
    if held and words >= minimum:
        yield joined(held, words)


def pack_units(units, target: int, maximum: int, overlap: int, minimum: int) -> Iterator[tuple[str, int]]:
    """Chunks of consecutive units without pages."""
    return ((text, n) for text, n, _ in pack_paged(((u, 1) for u in units), target, maximum, overlap, minimum))


#: Characters and rows of chunks that a task collects before it sends them.
OUT_CHARS, OUT_ROWS = 1 << 20, 10_000


def _pieces(splitter: re.Pattern, text: str) -> Iterator[str]:
    """``splitter.split(text)`` one piece at a time, for patterns without groups."""
    start = 0
    for found in splitter.finditer(text):
        yield text[start:found.start()]
        start = found.end()
    yield text[start:]


def chunk_batches(schema: pa.Schema, sep: str, page_sep: str | None, target: int | None, maximum: int, overlap: int, minimum: int, out_chars: int = OUT_CHARS):
    """Function from Arrow batches of (id, text) to batches of chunks, each of about ``out_chars`` characters.

    Only the text at hand and the chunks of one output batch are Python objects; the other texts stay in the Arrow batch.
    """
    splitter = re.compile(sep)
    page_splitter = re.compile(page_sep) if page_sep else None

    def units(body: str):
        for number, page in enumerate(_pieces(page_splitter, body) if page_splitter else [body], 1):
            yield from ((u, number) for u in (re.sub(r"\s+", " ", p).strip() for p in _pieces(splitter, page)) if u)

    def packed(batch, rows):
        places, *others = zip(*rows)
        arrays = [pa.array(c, t) for c, t in zip(others, schema.types[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), *arrays], names=schema.names)

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for at in range(batch.num_rows):
                body = batch.column(1)[at].as_py() or ""
                for i, (chunk_text, n, page) in enumerate(pack_paged(units(body), target, maximum, overlap, minimum), 1):
                    rows.append((at, i, n, chunk_text, page)[:len(schema)])
                    held += len(chunk_text)
                    if held > out_chars or len(rows) >= OUT_ROWS:
                        yield packed(batch, rows)
                        rows, held = [], 0
            if rows:
                yield packed(batch, rows)

    return run


def chunk(df: DataFrame, id_: str, text: str, sep: str = r"\n\s*\n", target: int | None = 700, maximum: int = 900,
          overlap: int = 100, minimum: int = 120, page_sep: str | None = None) -> DataFrame:
    """Overlapping word-bounded chunks; one document in, its chunks out, no shuffle.

    With ``page_sep`` the text is cut to pages first, chunks run over their ends, and ``page`` is the number, from 1, of the page that a chunk
    starts on. A null or empty text has no chunks.
    """
    kind = df.schema[id_].dataType.simpleString()
    schema = f"`{id_}` {kind}, chunk_index long, n_words long, chunk_text string" + (", page long" if page_sep else "")
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    return df.select(id_, text).mapInArrow(chunk_batches(arrow, sep, page_sep, target, maximum, overlap, minimum), schema)


def relevant_chunks(df: DataFrame, id_: str, text: str, relevant, page_sep: str = "\f", sep: str = r"\n[ \t]*\n", maximum: int = 850) -> DataFrame:
    """(id, page, chunk_index, chunk_text): per page the paragraphs that ``relevant(paragraph)`` keeps, packed in order without overlap.

    A chunk is closed before the paragraph that would lift it above ``maximum`` words between spaces; a longer paragraph is a chunk of its
    own. Pages and chunks count from 1, of equal chunks of a page the first stays, pages without a relevant paragraph have none. All in columns,
    one row at a time.
    """
    pages = df.select(id_, F.posexplode(F.split(F.col(text), page_sep, -1)).alias("_p", "_page"))
    kept = F.filter(F.transform(F.split("_page", sep, -1), X.one_line), lambda p: (p != "") & relevant(p))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("words"))

    def add(state, paragraph):
        n = F.size(F.split(paragraph, " "))
        full = (state["words"] > 0) & (state["words"] + n > maximum)
        alone = full | (state["words"] == 0)
        return F.struct(
            F.when(full, F.array_append(state["done"], state["held"])).otherwise(state["done"]).alias("done"),
            F.when(alone, paragraph).otherwise(F.concat(state["held"], F.lit("\n\n"), paragraph)).alias("held"),
            F.when(alone, n).otherwise(state["words"] + n).alias("words"))

    packed = F.aggregate(kept, start, add, lambda s: F.when(s["words"] > 0, F.array_append(s["done"], s["held"])).otherwise(s["done"]))
    return pages.select(id_, (F.col("_p") + 1).cast("long").alias("page"), F.posexplode(F.array_distinct(packed)).alias("_i", "chunk_text")).select(
        id_, "page", (F.col("_i") + 1).cast("long").alias("chunk_index"), "chunk_text")


def useful_chunk(c: Column, wanted, skip, heading, heading_terms, window: int | None = None) -> Column:
    """Keep texts with a wanted term; reference lists only with a method term; skip generic openings."""
    text = F.lower(X.one_line(c))
    head = text if window is None else F.substring(text, 1, window)
    return RU.first_rule([
        (text == "", F.lit(False)),
        (text.rlike("^(?:" + "|".join(heading) + ")"), RU.any_substring(text, heading_terms)),
        (RU.any_substring(head, skip), F.lit(False)),
    ], RU.any_substring(text, wanted))


def mine_metadata(df: DataFrame, id_: str, text: str, bad_title, bad_author, years=r"20[0-2][0-9]|19[89][0-9]",
                  leading: int | None = None) -> DataFrame:
    """Title, authors, latest year and DOI of each document; everything stays inside its row."""
    all_lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda s: X.one_line(s)), lambda s: s != "")
    head = all_lines if leading is None else F.slice(all_lines, 1, leading)
    low = lambda s: F.lower(s)
    no_term = lambda s, terms: ~RU.any_substring(low(s), terms)
    letters = lambda s: F.length(F.regexp_replace(s, r"[^A-Za-z]", ""))
    title_line = lambda s: (
        no_term(s, bad_title) & F.length(s).between(10, 200) & ~s.contains("@") & (letters(s) * 2 >= F.length(s)))
    with_lines = df.select(id_, text, head.alias("_lines"))
    titled = with_lines.withColumn(
        "_title_at", F.aggregate(F.transform("_lines", lambda s, i: F.when(title_line(s), i)), F.lit(None).cast("int"),
                                 lambda acc, v: F.coalesce(acc, v)))
    title = F.coalesce(F.get(F.col("_lines"), F.col("_title_at")), F.lit(""))
    following = F.when(F.col("_title_at").isNotNull(), F.slice(F.col("_lines"), F.col("_title_at") + 2, 7))
    author_line = lambda s: (
        no_term(s, bad_author) & F.length(s).between(3, 180)
        & (F.regexp_count(s, F.lit(r"(?:^|[^A-Za-z0-9_])[A-Z][A-Za-z-]+")) >= 2))
    year = F.array_max(F.regexp_extract_all(F.col(text), F.lit(rf"(?:^|[^A-Za-z0-9_])({years})"), F.lit(1)))
    return titled.select(
        id_, title.alias("title"),
        F.coalesce(F.array_join(F.slice(F.filter(following, author_line), 1, 2), "; "), F.lit("")).alias("authors"),
        F.coalesce(year, F.lit("")).alias("year"),
        F.regexp_replace(F.regexp_extract(F.col(text), r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+", 0), r"\.+$", "").alias("doi"),
    )


def statistic_rows(df: DataFrame, id_: str, text: str, terms, statistic: str, labels) -> DataFrame:
    """Sentences with an exposure term and a number as evidence rows, exact repeats removed."""
    found = sentence_units(df, id_, text).filter(
        RU.any_substring(F.lower("sentence"), terms) & F.col("sentence").rlike(statistic))
    rows = found.select(
        id_, "position", "sentence", RU.first_rule(labels(F.lower("sentence")), "methodology").alias("doc_type"),
        X.parse_number(F.col("sentence")).alias("metric_value"))
    keyed = rows.withColumn("_key", F.lower("sentence"))
    return top_n(keyed, [id_, "doc_type", "_key"], [F.col("position")], 1, "_r").drop("_key", "_r")


def opening_ranks(blocks: DataFrame, query: str, rank: str, length: Column, limit: int) -> DataFrame:
    """(query, rank) of the blocks that start within the first ``limit`` characters, counted from lengths in range-sorted slices."""
    sums = blocks.groupBy(query, rank).agg(F.coalesce(F.sum(length), F.lit(0)).alias("_chars"))
    placed = durable(sums.repartitionByRange(query, rank).withColumn("_slice", F.spark_partition_id()))
    earlier = Window.partitionBy(query).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_slice", query).agg(F.sum("_chars").alias("_all"))
               .withColumn("_offset", F.coalesce(F.sum("_all").over(earlier), F.lit(0))).drop("_all"))
    before = Window.partitionBy("_slice", query).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_before", F.coalesce(F.sum("_chars").over(before), F.lit(0)))
    match = (F.col("a._slice") == F.col("b._slice")) & F.col(f"a.{query}").eqNullSafe(F.col(f"b.{query}"))
    return inside.alias("a").join(offsets.alias("b"), match).filter(F.col("_before") + F.col("_offset") < limit).select(f"a.{query}", f"a.{rank}")


def pack_context(hits: DataFrame, query: str, rank: str, block: Column, limit: int = 12000) -> DataFrame:
    """Ranked blocks joined up to a character limit, the last one cut. Blocks may be of any length, also short or empty.

    Only the blocks of ranks that start within the limit are sorted with their texts.
    """
    whole = hits.select(query, rank, block.alias("_block"))
    opening = durable(opening_ranks(whole, query, rank, F.length("_block"), limit).select(F.col(query).alias("_query"), F.col(rank).alias("_rank")))
    opening = F.broadcast(opening) if is_at_most(opening, 500_000) else opening
    blocks = whole.join(opening, F.col(query).eqNullSafe(F.col("_query")) & F.col(rank).eqNullSafe(F.col("_rank")), "left_semi")
    order = Window.partitionBy(query).orderBy(F.col(rank), F.col("_block"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    used = blocks.withColumn("_r", F.row_number().over(order)).withColumn("_used", F.coalesce(F.sum(F.length("_block")).over(before), F.lit(0).cast("long")))
    cut = used.filter(F.col("_used") < limit).withColumn(
        "_block", F.substring(F.col("_block"), F.lit(1), (F.lit(limit) - F.col("_used")).cast("int")))
    return cut.groupBy(query).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_block"))), lambda s: s["_block"]),
                     "\n\n").alias("context"),
        F.count(F.lit(1)).alias("sources"))
