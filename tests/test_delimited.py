"""Delimited files in several splits against the csv module."""

import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierspark.sources import delimited


def _inside(line, sep, start):
    """Plain state machine over the characters of a line."""
    inside, fresh, k = start, not start, 0
    while k < len(line):
        c = line[k]
        if inside:
            if c == '"':
                if line[k + 1:k + 2] == '"':
                    k += 1
                else:
                    inside = False
        elif c == sep:
            fresh = True
            k += 1
            continue
        elif c == '"' and fresh:
            inside = True
        fresh = False
        k += 1
    return inside


def test_line_ends_against_a_state_machine(spark):
    rng = random.Random(2)
    lines = ["".join(rng.choice('a",;""') for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    o, i = delimited.ends_inside(F.col("value"), ",")
    got = spark.createDataFrame([(t,) for t in lines], "value string").select("value", o.alias("o"), i.alias("i")).collect()
    for r in got:
        assert (r["o"], r["i"]) == (_inside(r["value"], ",", False), _inside(r["value"], ",", True)), r["value"]


def test_states_of_a_block_line_by_line():
    rng = np.random.default_rng(3)
    for _ in range(300):
        o, i = rng.random((2, 9)) < 0.5
        for start in (False, True):
            state, want = start, []
            for a, b in zip(o, i):
                state = b if state else a
                want.append(state)
            assert delimited.line_states(o, i, start).tolist() == want


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "96")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _cells(rng):
    body = "".join(rng.choice(["a", "ü", ",", '"', "\n", " ", "line\nbreak", ""]) for _ in range(rng.randint(0, 9)))
    return body if rng.random() < 0.9 else "\n".join(["long, \"field\""] * 30)


def test_records_of_many_splits_equal_the_csv_module(spark, tmp_path, small_splits):
    rng = random.Random(7)
    want = []
    for n, count in enumerate((120, 1, 0)):
        rows = [[f"{n}.{k}", _cells(rng), _cells(rng), rng.choice(["", "x", 'bare "quote" inside'])] for k in range(count)]
        text = io.StringIO()
        out = csv.writer(text, lineterminator="\n")
        out.writerows([["id", "first name", "b", "c"], *rows])
        (tmp_path / f"part{n}.csv").write_text(text.getvalue(), encoding="utf-8")
        want += [tuple(r) for r in csv.reader(io.StringIO(text.getvalue(), newline=""))][1:]
    got = delimited.read_delimited(spark, str(tmp_path))
    assert got.columns == ["id", "first name", "b", "c"]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_odd_files(spark, tmp_path, small_splits):
    read = lambda name, text, sep=",": (tmp_path / name).write_bytes(text.encode()) and sorted(map(tuple, delimited.read_delimited(spark, str(tmp_path / name), sep).collect()))
    assert read("blank.csv", "a,b\n\n1,2\n\n\n3,\n") == [("1", "2"), ("3", "")]
    assert read("crlf.csv", 'a,b\r\n1,"x\r\ny"\r\n2,z\r\n') == [("1", "x\r\ny"), ("2", "z")]
    assert read("short.tsv", "a\tb\n1\n2\t3\t4\n", "\t") == [("1", ""), ("2", "3")]
    assert read("open.csv", 'a,b\n1,2\n3,"never\nclosed\n') == [("1", "2"), ("3", "never\nclosed")]
    assert read("head.csv", 'a,b\n') == []


def test_changed_splits_are_refused(spark, tmp_path, small_splits):
    (tmp_path / "x.csv").write_text("a,b\n" + "1,2\n" * 200)
    rows = delimited.read_delimited(spark, str(tmp_path / "x.csv"))
    assert rows.count() == 200
    spark.conf.set("spark.sql.files.maxPartitionBytes", "192")
    with pytest.raises(Exception, match="splits of the files changed"):
        rows.filter("a = '1'").count()
