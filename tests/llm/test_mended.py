"""Cases that a review of the training-data operators named."""

import re

import pytest

pytest.importorskip("dossierspark.llm")

import public_tokenizers

from dossierspark.llm import bpe, fertility

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PIECES = bpe.read_ranks(public_tokenizers.path("piece_bpe_32k.model"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 4: fertility

def plain_counts(text):
    """The base counts by their definition."""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


ODD_WORDS = ["a\x1fb c", "\x1c\x1d \x1e", "x\x85y z", "　  a  b", "a\xa0b", "one two three one two three\none two\n\n one\none two", "#*$ <|>", "", " \t\r\n",
             "\x1c\n\x1c\n \n", "日本語 テスト 日本語 テスト 日本語 テスト", "é" * 50 + " " + "é" * 50]


def test_base_counts_equal_their_definition():
    vocab = fertility.Vocabularies(RANKS, public_tokenizers.PATTERN, PIECES)
    for texts in (ODD_WORDS, *[[t] for t in ODD_WORDS]):
        assert [r[:5] for r in fertility.measures(texts, vocab)] == [plain_counts(t) for t in texts]


def test_measures_do_not_depend_on_the_batch():
    """Tokens, pieces and entropy of a text are those of its words encoded one by one."""
    import collections
    import math

    vocab = fertility.Vocabularies(RANKS, public_tokenizers.PATTERN, PIECES)
    for text, row in zip(ODD_WORDS, fertility.measures(ODD_WORDS, vocab)):
        words = WORD.findall(text)
        ids = [i for w in words for i in vocab.bpe.encode_ordinary(" " + w)]
        pieces = [i for w in words for i in vocab.pieces.encode(w)]
        share = [n / len(ids) for n in collections.Counter(ids).values()]
        assert row[6] == len(ids)
        if words:
            assert row[7] == row[1] / len(ids) and row[8] == row[1] / len(pieces)
            assert row[9] == pytest.approx(sum(map(vocab.pieces.IsByte, pieces)) / len(pieces)) and row[10] == pytest.approx(-sum(p * math.log2(p) for p in share))


def test_scripts():
    assert [fertility.script_of(t) for t in ("abc", "été", "где abc", "日本語", "テストa", "한국어", "123 !?", "\U0001f389", "")] == [
        "latin", "latin", "latin", "han", "kana", "hangul", "none", "none", "none"]


# 8: every context has a row

def tree_walk(samples, text, order=3):
    """Bits of ``text`` by walking the counts from the longest context down, escape method C."""
    import collections
    import math

    counts = collections.defaultdict(collections.Counter)
    for sample in samples:
        raw = b" " * order + sample.lower().encode()
        for i in range(order, len(raw)):
            for k in range(order + 1):
                counts[raw[i - k:i]][raw[i]] += 1
    raw, bits = b" " * order + text.lower().encode(), 0.0
    for i in range(order, len(raw)):
        for k in range(order, -1, -1):
            seen = counts.get(raw[i - k:i]) if k or counts else None
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if seen[raw[i]]:
                bits -= math.log2(seen[raw[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8.0
    return bits


def test_many_contexts_equal_the_tree_walk():
    """Eight languages with over 16,000 contexts of order 3 together, many of them in one language only."""
    import random

    from dossierspark.llm import language

    rng = random.Random(3)
    letters = [[chr(start + k) for k in range(40)] for start in (0x61, 0x3B1, 0x430, 0x5D0, 0x627, 0x905, 0x3042, 0x4E00)]
    text = lambda k, n: "".join(rng.choice(letters[k]) if rng.random() > 0.15 else " " for _ in range(n))
    samples = {f"l{k}": [text(k, 5000) for _ in range(3)] for k in range(8)}
    model = language.fit([(lang, t) for lang, texts in samples.items() for t in texts])
    assert sum(len({int(c) >> 8 for c in codes}) for codes in model.codes) > 16_000
    asked = [text(k, 60) + text((k + 3) % 8, 20) for k in range(8)] + ["", "a", "\U0001f389!"]
    got = language.code_lengths(asked, model.tables())
    for i, t in enumerate(asked):
        for k, lang in enumerate(model.langs):
            assert got[i, k] == pytest.approx(tree_walk(samples[lang], t), rel=1e-5, abs=1e-4)


def test_long_documents_are_learned_from(spark):
    from dossierspark.llm import language

    docs = spark.createDataFrame([(1, "der hund und die katze " * 2000, "de"), (3, "the dog and the cat " * 10, "en")], "doc_id long, text string, lang string")
    assert language.learn(docs, mod=1, left_out=5).langs == ["de", "en"]


# 9: items of one to four words

def test_short_items_inside_long_documents(spark):
    from dossierspark.llm import decontaminate

    docs = spark.createDataFrame([(1, "so they met at Dawn, near the river", 1), (1, "unrelated words", 2), (2, "dawn", 3), (3, None, 4), (4, "near the", 5),
                                  (5, "filler " * 60_000 + "met at dawn", 6)], "doc_id long, text string, SHARED int")
    items = spark.createDataFrame([(10, "Met at dawn!"), (11, "dawn"), (12, "near the river bank"), (13, "they met at dawn near"), (14, None), (15, "--")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contained(docs, items).collect())
    assert got == [(1, 10, 1, 1), (1, 11, 1, 1), (1, 13, 1, 1), (2, 11, 1, 1), (5, 10, 1, 1), (5, 11, 1, 1)]
    assert decontaminate.contained(docs, items.filter("text is null")).count() == 0


# 10: main text

STORY = "<p>" + "A sentence of the article. " * 8 + "</p><p>" + "Another sentence of it. " * 9 + "</p>"
READ = ("A sentence of the article. " * 8).strip() + "\n\n" + ("Another sentence of it. " * 9).strip()


@pytest.mark.parametrize("name", ["post no-sidebar", "has-comments", "share-price", "layout-with-sidebar", "content social", "post"])
def test_class_names_around_the_text_do_not_remove_it(name):
    from dossierspark.llm.extract import main_text

    assert main_text(f'<article><div class="{name}">{STORY}</div></article>') == READ
    assert main_text(f'<body><div class="menu"><a href="/">Home</a></div><div class="{name}">{STORY}</div><div class="comments"><p>Nice one, I liked it.</p></div></body>') == READ


def test_headings_and_short_lines():
    from dossierspark.llm.extract import main_text

    assert main_text(f"<article><h1>My story</h1>\n\n<p>By Ann</p>{STORY}<p>End.</p></article>") == f"My story\n\nBy Ann\n\n{READ}\n\nEnd."
    assert main_text(f"<div>Menu</div><div>Accept all tracking?</div><h1>Title</h1>{STORY}<div>Copyright 2024 Example</div>") == f"Title\n\n{READ}"
    assert main_text(f'<div class="comments"><p>{"I liked it a lot. " * 60}</p></div><h1>T</h1>{STORY}') == f"T\n\n{READ}"
    assert main_text(f'<div class="related"><h1>T</h1>{STORY}</div>') == f"T\n\n{READ}"


def test_no_page_loses_its_heading():
    import html
    import re

    import pyarrow.parquet as pq

    from dossierspark.llm.extract import main_text

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist():
        m = re.search(r"(?is)<(?:article|main)\b.*?<h1[^>]*>(.*?)</h1>", page)
        if m:
            assert main_text(page).startswith(" ".join(html.unescape(re.sub("<[^>]+>", "", m[1])).split()))


# 2: repeated ids with unequal texts

def test_repeated_ids_take_the_smallest_text(spark):
    from dossierspark.llm import ngram_join

    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(1, a), (3, b), (3, a), (3, None), (4, b), (5, c), (5, None), (6, None), (6, None)]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(docs).collect()}
        assert got == {1: (3, 1), 3: (3, 1), 4: (3, 4), 5: (3, 5), 6: (0, 6)}
        kept = sorted((r["doc_id"], r["text"] or "") for r in ngram_join.keep_first(docs).collect())
        assert kept == [(1, a), (4, b), (5, c), (6, "")]


@pytest.mark.parametrize("hot", [1000, 1])
def test_hot_classes(spark, monkeypatch, hot):
    from dossierspark.llm import ngram_join

    monkeypatch.setattr(ngram_join, "HOT_CLASS", hot)
    docs = spark.createDataFrame([(i, f"copy {i % 3} of a b c d e") for i in range(60)] + [(100, "quite another text than all of these here")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_components(docs).collect()}
    assert got == {**{i: i % 3 for i in range(60)}, 100: 100}
