"""What the stages of the pipeline hold in a Python worker."""

import random
import tracemalloc

import pytest

pytest.importorskip("dossierspark.llm")

import public_tokenizers
import pyarrow as pa

from dossierspark.llm import bpe, language, rows

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_a_function_gets_a_few_megabytes_at_once(spark):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('ab cd ', 1500) AS text")

    def make():
        return lambda column: [pa.array([column.nbytes] * len(column))]

    got = rows.with_columns(docs, ["text"], "held long", make).selectExpr("count(*) AS n", "max(held) AS held").first()
    assert got["n"] == 3000 and got["held"] < 5_000_000


def test_what_bpe_keeps_of_a_piece_is_small():
    rng = random.Random(3)
    pieces = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöü", k=rng.randint(5, 14))) for _ in range(20_000)]
    encoder = bpe._encoder(RANKS, r"\S+|\s+")
    tracemalloc.start()
    try:
        got = encoder(pa.array([" ".join(pieces)]))
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    coder = bpe.TreeBpe(RANKS)
    assert got[0].as_py() == [i for p in " ".join(pieces).replace(" ", "| |").split("|") for i in coder.piece(p.encode())]
    assert kept / len(pieces) < 950


def test_code_lengths_of_a_long_text_hold_little_beside_it():
    model = language.fit([("en", "the dog and the house " * 50), ("fr", "le chien et la maison " * 50)])
    text = "the dog et la maison " * 100_000
    tables = model.tables()
    tracemalloc.start()
    try:
        got = language.code_lengths([text], tables)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    parts = [language.code_lengths([text[:2100]], tables), language.code_lengths([text[:4200]], tables)]
    assert abs(got[0] - parts[0][0] - (parts[1] - parts[0])[0] * (len(text) / 2100 - 1)).max() < 1
    assert most < 8 * len(text)
