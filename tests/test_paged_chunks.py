"""Chunks with pages, against loops."""

import random

import pyarrow as pa

from pyspark.sql import functions as F

from dossierspark.operators import text_jobs as TJ


def pages_of(seed, pages=6):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choices(["keep", "drop", "alpha", "beta", "gamma"], k=rng.randint(1, 12)))
    return "\f".join("\n\n".join(line() for _ in range(rng.randint(0, 9))) for _ in range(pages))


def model(text, maximum):
    out = []
    for number, page in enumerate(text.split("\f"), 1):
        chunks, held = [], []
        for p in page.split("\n\n"):
            if p and "keep" in p:
                if held and sum(len(h.split()) for h in held) + len(p.split()) > maximum:
                    chunks.append("\n\n".join(held))
                    held = []
                held.append(p)
        if held:
            chunks.append("\n\n".join(held))
        out += [(number, i, c) for i, c in enumerate(dict.fromkeys(chunks), 1)]
    return out


def test_relevant_chunks_equal_the_loop(spark):
    rows = [(i, pages_of(i)) for i in range(40)] + [(100, None), (101, ""), (102, "keep a\n\nkeep a\fkeep a"), (103, "keep " * 5000), (104, "\f\f\n \n")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {}
    for r in TJ.relevant_chunks(df, "id", "t", lambda p: p.contains("keep"), maximum=12).collect():
        got.setdefault(r.id, []).append((r.page, r.chunk_index, r.chunk_text))
    for i, text in rows:
        assert sorted(got.get(i, [])) == [(p, k, c.strip()) for p, k, c in model(text or "", 12)], i


def test_equal_chunks_of_a_page_stay_once(spark):
    df = spark.createDataFrame([(1, "keep a\n\nkeep a\n\nkeep b\fkeep a")], "id long, t string")
    got = TJ.relevant_chunks(df, "id", "t", lambda p: F.lit(True), maximum=2).orderBy("page", "chunk_index").collect()
    assert [(r.page, r.chunk_index, r.chunk_text) for r in got] == [(1, 1, "keep a"), (1, 2, "keep b"), (2, 1, "keep a")]


def test_chunks_name_the_page_they_start_on(spark):
    lines = [f"{chr(97 + i)} " * 10 for i in range(9)]
    text = "\f".join("\n\n".join(lines[i:i + 3]) for i in range(0, 9, 3))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    got = TJ.chunk(df, "id", "t", target=20, maximum=30, overlap=10, minimum=5, page_sep="\f").orderBy("chunk_index").collect()
    place = {chr(97 + i): i // 3 + 1 for i in range(9)}
    assert len(got) >= 5 and all(r.id == 1 and r.page == place[r.chunk_text[0]] for r in got)
    # Pages change nothing but the column: one text with paragraphs instead of pages has the same chunks.
    plain = TJ.chunk(df.withColumn("t", F.replace("t", F.lit("\f"), F.lit("\n\n"))), "id", "t", target=20, maximum=30, overlap=10, minimum=5)
    assert plain.columns == ["id", "chunk_index", "n_words", "chunk_text"] and [r.chunk_text for r in plain.orderBy("chunk_index").collect()] == [
        r.chunk_text for r in got]


def test_chunks_leave_the_task_in_small_batches():
    # All chunks of a batch of documents stood in Python at once.
    text = "\n\n".join(f"{i} " + "word " * 40 for i in range(200))
    out = pa.schema([("id", pa.int64()), ("chunk_index", pa.int64()), ("n_words", pa.int64()), ("chunk_text", pa.string())])
    options = dict(sep=r"\n\s*\n", page_sep=None, target=40, maximum=60, overlap=0, minimum=1)
    batch = pa.RecordBatch.from_pydict({"id": list(range(20)), "t": [text] * 20})
    small, whole = (list(TJ.chunk_batches(out, **options, out_chars=n)(iter([batch]))) for n in (20_000, 10**9))
    assert pa.Table.from_batches(small) == pa.Table.from_batches(whole) and sum(b.num_rows for b in small) == 4000
    assert max(b.num_rows for b in small) <= 101 and len(whole) == 1
