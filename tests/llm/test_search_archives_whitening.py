"""Ranked search, WARC archives and whitening against brute force, exact round trips and odd tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow.fs
import pytest

pytest.importorskip("dossierspark.llm")

from pyspark.sql import functions as F

from dossierspark.llm import ball_tree, queries, warc, whitening

SF = "/root/testdata/sf0.001"


# 11: ranked lexical search

def brute_rank(docs, items, k=50):
    """docs and items are (id, text) rows; the scores by their definition."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    rows = [(i, words(t)) for i, t in docs]
    n_docs, length = sum(bool(w) for _, w in rows), sum(len(w) for _, w in rows)
    out = {}
    for item, text in items:
        asked, scored = set(words(text)), []
        df = {t: sum(t in w for _, w in rows) for t in asked}
        for i, w in rows:
            m = 100 - 50 + (50 * len(w) * n_docs) // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in asked if t in w)
            if score > 0:
                scored.append((-score, i))
        out[item] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return {i: rows for i, rows in out.items() if rows}


def got_rank(df, query="item_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[query], r["rank"])):
        out.setdefault(r[query], []).append((r["rank"], r["doc_id"], r["score"]))
    return out


@pytest.mark.parametrize("chunk,block", [(4096, 20_000), (37, 3)])
def test_search_equals_brute_force(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(ball_tree, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    word = lambda: f"w{min(int(rng.pareto(1.0) * 3), 300)}"
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(1, 60))))) for i in range(400)]
    docs += [(400 + i, docs[i][1]) for i in range(50)]  # equal scores
    docs += [(900, None), (901, ""), (902, "!!! \x7f ???"), (903, "É été ÉTÉ W1 w1\x00w2"), (904, "w1 " * 50_000)]
    items = [(i, " ".join(word() for _ in range(8))) for i in range(7)] + [(50, None), (51, ""), (52, "nothing-like-it zzz"), (53, "été W1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert got_rank(ball_tree.rank(d, q, 10, block=block)) == brute_rank(docs, items, 10)


def test_trees_prune_and_lose_nothing():
    rng = np.random.default_rng(1)
    rows = []
    for group in range(16):
        for _ in range(64):
            at = np.unique(np.concatenate([group * 20 + rng.integers(0, 20, 12), rng.integers(0, 320, 1)]))
            rows.append((at, rng.integers(1, 1000, len(at)) * 10))
    start = np.concatenate([[0], np.cumsum([len(a) for a, _ in rows])])
    chunk = ball_tree.Chunk(np.arange(len(rows)), start, np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]))
    dense = np.zeros((len(rows), 320), np.int64)
    for i, (a, v) in enumerate(rows):
        dense[i, a] = v
    lists = [np.sort(rng.choice(20, 8, replace=False)) + 20 * g for g in range(16)]
    found, n = ball_tree.Best(16, 5), 320
    ordered, nodes = ball_tree.ball_tree(chunk, n)
    scored = ball_tree.search(ordered, nodes, ball_tree.Queries(lists, n), found, n)
    leaves = sum(v.children is None for v in nodes)
    assert scored < 0.5 * 16 * leaves
    for q, own in enumerate(lists):
        score = dense[:, own].sum(1)
        want = np.lexsort((np.arange(len(rows)), -score))[:5]
        assert found.ids[q].tolist() == want.tolist() and found.score[q].tolist() == score[want].tolist()
    for v in nodes:  # every document lies in its balls
        centre = np.zeros(n)
        centre[v.centre_terms] = v.centre
        inside = dense[ordered.ids[v.first:v.stop]]
        assert np.sqrt(((inside - centre) ** 2).sum(1)).max() <= v.radius


def test_search_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 2), (None, "a b", 3), (2, None, 4)], "doc_id long, text string, SCORE int")
    items = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (None, "a", 3)], "item_id long, text string, rank int")
    assert got_rank(ball_tree.rank(docs, items)) == brute_rank([(1, "a b"), (1, "a b"), (2, None)], [(1, "a")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("doc_id = 2"), items)):
        assert ball_tree.rank(d, i).count() == 0


# 12: WARC

def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, LENGTH int")


ODD_PAGES = [(5, "http://a/", "x" * 200, 1), (3, "http://b/ä b\r\nc", "x" * 200, 2), (9, None, "x" * 200, 3), (1, "", "x" * 99, 4), (2, "u", "x" * 99, 5),
             (7, "u", None, 6), (8, "u", "", 7), (None, "n", "x" * 200, 8), (10, "long", "é<p>" * 400_000, 9), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 20, 10)]


@pytest.mark.parametrize("archive_bytes", [1 << 30, 1])
def test_records_come_back(spark, archive_bytes):
    index = warc.write(pages_of(spark, ODD_PAGES).repartition(3), archive_bytes=archive_bytes)
    got = {r["id"]: r for r in warc.read(index).collect()}
    assert len(got) == len(ODD_PAGES) == index.count()
    for page, url, html, _ in ODD_PAGES:
        r, payload = got[page], (html or "").encode()
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha256(payload).hexdigest()
        first = 3 if html == "x" * 200 and page != 3 else None
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if first else ("response", None))
        assert r["payload"] is None if first else bytes(r["payload"]) == payload
    assert got[3]["url"] == "http://b/%C3%A4%20b%0D%0Ac".replace("%C3%A4", "ä") and got[9]["url"] is None
    assert {r["url"] for r in index.collect()} == {u for _, u, _, _ in ODD_PAGES}


def test_files_are_gzip_members_of_whole_records(spark):
    index = warc.write(pages_of(spark, ODD_PAGES)).collect()
    for name in {r["archive"] for r in index}:
        fs, place = pyarrow.fs.FileSystem.from_uri(name)
        raw, heads = fs.open_input_file(place).read(), []
        while raw:
            member = zlib.decompressobj(31)
            heads.append(member.decompress(raw) + member.flush())
            raw = member.unused_data
        assert heads[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and all(h.startswith(b"WARC/1.1\r\n") and h.endswith(b"\r\n\r\n") for h in heads)
        assert len(heads) == 1 + sum(r["archive"] == name for r in index)


def test_selected_records_are_read_in_merged_ranges():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 100, 10), ("b", 110, 10), ("b", 120, 100)]
    runs = [[o for _, o, _ in g] for g in warc.ranges(iter(rows), gap=5, span=50)]
    assert runs == [[0, 10, 25], [100], [110], [120]]


def test_a_changed_payload_is_an_error():
    raw = warc.record(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), None, "1970-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == b"hello"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"hello", b"hellO"))
    with pytest.raises(ValueError):
        warc.parse(raw[:-5])


def test_warc_of_odd_tables(spark):
    twice = pages_of(spark, [(1, "u", "y" * 100, 0), (1, "u", "y" * 100, 0), (2, "v", "y" * 100, 0)])
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, twice).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert warc.round_trip(spark, twice.limit(0)).count() == 0
    index = warc.write(twice)
    assert [r["id"] for r in warc.read(index.filter("id = 2")).collect()] == [2]


# 13: whitening

def numpy_whitening(vectors, k=4):
    x = np.floor(np.array(vectors, float) * 256)
    fit = np.unique(x, axis=0)
    c = fit - fit.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(fit))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return fit, e, u, (x - fit.mean(0)) @ u / np.sqrt(e)


def test_query_equals_dense_eigenvectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = [r["vec_id"] for r in rows]
    fit, e, u, want = numpy_whitening([r["embedding"] for r in rows])
    got = queries.reg.queries["op13_whitening"](spark, SF).collect()
    assert len(got) == 4 * len(rows)
    w = np.zeros(want.shape)
    x = np.floor(np.array([r["embedding"] for r in rows], float) * 256).astype(int)
    dev = {i: int(((len(fit) * v - fit.astype(int).sum(0)) ** 2).sum()) for i, v in zip(ids, x)}
    trace = np.trace(np.cov(fit.T, bias=True))
    for r in got:
        w[ids.index(r["vec_id"]), r["component"] - 1] = r["whitened"]
        assert r["n"] == len(fit) and r["deviation"] == dev[r["vec_id"]] and r["identity_error"] < 1e-9
        assert abs(r["explained"] - e[r["component"] - 1] / trace) < 1e-9
    signs = np.sign((w * want).sum(0))
    assert np.abs(w * signs - want).max() < 1e-7


@pytest.mark.parametrize("seed", range(6))
def test_counts_and_slices(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(2, 40))
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    e = np.sort(np.concatenate([rng.uniform(0, 1, d // 2), np.repeat(rng.uniform(1, 2), d - d // 2)]))[::-1] * 10.0 ** rng.integers(-6, 9)
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    for shift in rng.uniform(0, e[0], 20):
        assert whitening.above(v, shift) == (e > shift).sum()
    values, vectors = whitening.leading(v, 4)
    assert np.allclose(values, e[:4], rtol=1e-12, atol=1e-12 * e[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() < 1e-11 * e[0]


def test_close_and_indefinite_inertia():
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 0) and whitening.inertia(np.zeros((3, 3))) == (0, 3)
    gap = np.diag([1.0, 1.0 - 1e-9, 1.0 - 2e-9, 0.5, 0.0])
    values, _ = whitening.leading(gap, 5)
    assert np.allclose(values, [1.0, 1.0 - 1e-9, 1.0 - 2e-9, 0.5], rtol=0, atol=1e-14)


def test_whitening_of_odd_tables(spark):
    rng = np.random.default_rng(2)
    base = [[float(v) for v in rng.normal(size=3)] for _ in range(30)]
    rows = [(i, v, i) for i, v in enumerate(base)] + [(0, base[0], 99)]
    bad = [(100, None, 0), (101, [1.0, None, 2.0], 0), (102, [1.0, float("nan"), 2.0], 0), (103, [1.0, float("inf"), 2.0], 0), (104, [], 0), (105, [1.0], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, N int")
    out = whitening.whiten(df, whitening.fit(df), drop=("embedding",))
    assert sorted(out.columns) == sorted(["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    got = out.collect()
    assert len(got) == 3 * 31 and {r["n"] for r in got} == {30} and {r["vec_id"] for r in got} == set(range(30))
    _, _, _, want = numpy_whitening(np.array(base, np.float32))
    mine = np.zeros((30, 3))
    for r in got:
        mine[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(np.abs(mine) - np.abs(want)).max() < 1e-9
    for part, n in ((df.limit(0), 0), (df.filter("vec_id >= 100 and vec_id < 105"), 0), (df.filter("vec_id = 0"), 0)):
        assert whitening.whiten(part, whitening.fit(part)).count() == n


def test_deviations_beyond_a_long():
    x = np.array([[1 << 40, 0], [3, 4]])
    assert whitening.deviations(x, 5, [1, 2]) == [None, (15 - 1) ** 2 + (20 - 2) ** 2]
    assert whitening.deviations(np.array([[(1 << 31) + 1]]), 1, [5]) == [((1 << 31) + 1 - 5) ** 2]
