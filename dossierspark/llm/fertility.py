"""Quality rules by tokeniser fertility.

Two public vocabularies encode every word: a byte-level BPE (ranks file) and a piece BPE with byte fallback. Per document:
characters per token of both, the share of byte-fallback tokens, and the entropy of the byte-level token ids. A band per language
(per script where the language is null) comes from the quartiles over the distinct texts that pass the base rules, so copies count
once: from q1 - width (q3 - q1) to q3 + width (q3 - q1), at least ``SPREAD`` beyond the quartiles, also where they are equal. Entropy
grows with length, so its bands are per language and power of two of the token count. A document outside a band is rejected.

A band of fewer than ``LEAST`` texts gives way to a wider one: language, script, all; for entropy language and size, script and size,
size, and then as many sizes on either side as give ``LEAST`` texts, or all. The widest ones hold with any number of texts. A text
twice as long has the same entropy or up to one bit more, so a band goes up a bit for each size below it that it takes from, and
down for each above. A language that takes the band of its script or of all texts is held to the fertility of the others.

Base rules: at least 50 words, at most half of the words in three-word windows that occur twice or more.

Defined results: null texts have no words and fail the base rules; so do empty ones; ties with a band's edge are kept; repeated rows
get equal rows; other columns pass through.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierspark.llm.rows import checked_broadcast, kept, quoted, with_columns
from dossierspark.session import durable

SYMBOLS, WHITE = "#*$%&|<>", " \t\n\x0b\x0c\r"
LEAST = 20
#: Scripts by code point ranges, for documents without a language.
SCRIPTS = [("latin", r"[A-Za-zÀ-ɏ]"), ("greek", r"[Ͱ-Ͽ]"), ("cyrillic", r"[Ѐ-ӿ]"), ("hebrew", r"[֐-׿]"),
           ("arabic", r"[؀-ۿ]"), ("devanagari", r"[ऀ-ॿ]"), ("kana", r"[぀-ヿ]"), ("han", r"[一-鿿]"),
           ("hangul", r"[가-힯]")]
MEASURES = ("chars_per_token", "chars_per_piece", "byte_share", "entropy")
#: The least that a band goes beyond its quartiles: so much, and so large a share of the upper quartile.
SPREAD = {"chars_per_token": (0.0, 0.05), "chars_per_piece": (0.0, 0.05), "byte_share": (0.02, 0.0), "entropy": (0.0, 0.05)}
FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens long, "
          "chars_per_token double, chars_per_piece double, byte_share double, entropy double")


def _scripts() -> np.ndarray:
    """Number of the script of every code point below 2^16; ``len(SCRIPTS)`` is none of them."""
    out = np.full(1 << 16, len(SCRIPTS), np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 1 << 16)]))
    for i, (_, pattern) in enumerate(SCRIPTS):
        out[[ord(c) for c in re.findall(pattern, every)]] = i
    return out


SCRIPT_AT = _scripts()


def script_of(text: str) -> str:
    """The script with most of the text's letters, the first listed at a tie; ``none`` without any."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    counts = np.bincount(SCRIPT_AT[points[points < 1 << 16]], minlength=len(SCRIPTS))[:len(SCRIPTS)]
    return SCRIPTS[int(counts.argmax())][0] if counts.any() else "none"


class Vocabularies:
    """Both vocabularies; words are encoded on their own, each once a batch."""

    def __init__(self, rank_file: bytes, pattern: str, piece_model: bytes):
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.bpe = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.starts_word = np.zeros(max(ranks.values()) + 1, bool)
        self.starts_word[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.is_byte = np.array([self.pieces.IsByte(i) for i in range(self.pieces.GetPieceSize())])

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Byte-level ids of all words, each after a blank, and how many each word has."""
        flat = np.array(self.bpe.encode_ordinary(" " + " ".join(words)), np.int64) if words else np.empty(0, np.int64)
        first = np.flatnonzero(self.starts_word[flat])
        if len(first) == len(words):
            return flat, np.diff(np.append(first, len(flat)))
        lists = [self.bpe.encode_ordinary(" " + w) for w in words]  # words that hold other white space may share a token with the blank
        return np.array([i for t in lists for i in t], np.int64), np.fromiter(map(len, lists), np.int64, len(lists))

    def piece_counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each word, and how many of them are byte fallback."""
        pieces = self.pieces.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter((i for p in pieces for i in p), np.int64, int(sizes.sum()))
        ends = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
        stops = np.cumsum(sizes)
        return sizes, ends[stops] - ends[stops - sizes]


def repeated_words(ids: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(ids) < 3:
        return 0
    base = int(ids.max()) + 1
    if base < 2_000_000:
        window = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        window = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    _, at, count = np.unique(window, return_inverse=True, return_counts=True)
    often = count[at] > 1
    covered = np.zeros(len(ids), bool)
    covered[:-2] |= often
    covered[1:-1] |= often
    covered[2:] |= often
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return len(lines) - len(set(lines))


def measures(texts: list[str], vocab: Vocabularies) -> list[tuple]:
    """The columns of ``FIELDS`` for each text. Every distinct word of the batch is encoded once, whatever the number of texts that hold it."""
    raws = [t.encode("utf-8", "replace") for t in texts]
    place: dict[bytes, int] = {}
    ids, n_words = [], []
    for raw in raws:
        words = raw.split()  # bytes split at ASCII white space alone
        for w in words:
            if w not in place:
                place[w] = len(place)
        ids.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
        n_words.append(len(words))
    known = [w.decode("utf-8") for w in place]
    flat, sizes = vocab.tokens(known)
    pieces, fallback = vocab.piece_counts(known)
    starts = np.cumsum(sizes) - sizes
    out = []
    for text, raw, own, n in zip(texts, raws, ids, n_words):
        word_chars = len(text) - len(raw) + len(raw.translate(None, WHITE.encode()))
        symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
        if not n:
            out.append((0, word_chars, symbols, 0, 0, "none", 0, 0.0, 0.0, 0.0, 0.0))
            continue
        each = sizes[own]
        stops = np.cumsum(each)
        tokens, n_pieces = int(stops[-1]), max(1, int(pieces[own].sum()))
        counts = np.bincount(flat[np.repeat(starts[own] - stops + each, each) + np.arange(tokens)])
        p = counts[counts > 0] / tokens
        out.append((n, word_chars, symbols, repeated_lines(text), repeated_words(own), script_of(text), tokens, word_chars / tokens,
                    word_chars / n_pieces, float(fallback[own].sum()) / n_pieces, float(-(p * np.log2(p)).sum())))
    return out


def measure(docs: DataFrame, rank_file: bytes, pattern: str, piece_model: bytes, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the base counts, the script and the fertility measures."""
    def make():
        vocab = kept(("fertility", hash((rank_file, pattern, piece_model))), lambda: Vocabularies(rank_file, pattern, piece_model))

        def fn(column):
            rows = measures([t or "" for t in column.to_pylist()], vocab)
            types = [pa.int64()] * 5 + [pa.string(), pa.int64()] + [pa.float64()] * 4
            return [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        return fn

    return with_columns(docs, [text], FIELDS, make, drop, keeps=True)


def judge(docs: DataFrame, rank_file: bytes, pattern: str, piece_model: bytes, text: str = "text", lang: str = "lang", width: float = 3.0,
          drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with counts, measures, base_failed and kept (inside all bands)."""
    hashed = docs.withColumn("_lang", F.col(lang)).withColumn("_text", F.xxhash64(quoted(text)))
    inner = measure(hashed, rank_file, pattern, piece_model, text, drop)
    words, repeats = F.col("n_words"), F.col("n_repeat_words")
    rows = durable(inner.withColumn("base_failed", (words < 50) | (100 * repeats > 50 * words))
                   .withColumn("_key", F.coalesce("_lang", F.concat(F.lit("script "), "script"))).drop("_lang")
                   .withColumn("_size", F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")))
    return banded(rows, width)


def banded(rows: DataFrame, width: float) -> DataFrame:
    """Measured ``rows`` with kept; the columns _key, _size and _text (a hash of the text) go."""
    texts = durable(rows.filter(~F.col("base_failed")).select("_text", "_key", "script", "_size", *MEASURES).distinct())
    bands = durable(chosen_bands(texts))

    def inside(m: str):
        q1, q3, between = (F.col(f"_q_{m}")[k] for k in range(3))
        least, share = SPREAD[m]
        spread = F.greatest(width * between, least + share * q3)
        return F.col(m).between(q1 - spread, q3 + spread)

    fine = ~F.col("base_failed")
    for m in MEASURES:
        fine = fine & inside(m)
    return rows.join(checked_broadcast(bands), ["_key", "script", "_size"], "left").withColumn("kept", fine).select(
        *[quoted(c) for c in rows.columns if c not in ("_key", "_size", "_text")], "kept")


def chosen_bands(texts: DataFrame) -> DataFrame:
    """The quartiles, and the range between them, that hold for each _key, script and _size: of the narrowest group of at least ``LEAST`` of the distinct ``texts``."""
    once = texts.drop("_key").distinct()  # a text of several languages counts once above them
    counts = {r["_size"]: r["count"] for r in once.groupBy("_size").count().collect()}
    reach = neighbours(counts) or {0: [0]}
    near = F.create_map(*[x for size, of in reach.items() for x in (F.lit(size), F.array(*map(F.lit, of)))])
    pooled = once.withColumn("_own", F.col("_size")).withColumn("_size", F.explode(near[F.col("_own")]))
    longer = F.col("_size") - F.col("_own")
    out = texts.select("_key", "script", "_size").distinct().withColumn("_all", F.lit(0))
    levels = {MEASURES[:3]: [(texts, ["_key"]), (once, ["script"]), (once.withColumn("_all", F.lit(0)), ["_all"])],
              MEASURES[3:]: [(texts, ["_key", "_size"]), (once, ["script", "_size"]), (pooled, ["_size"])]}
    for measures, groups in levels.items():
        tags = [f"_band_{measures[0]}_{k}" for k in range(len(groups))]
        for tag, (of, keys) in zip(tags, groups):
            least = 1 if tag == tags[-1] else LEAST
            down, up = (F.least(longer, F.lit(0)), F.greatest(longer, F.lit(0))) if of is pooled else (F.lit(0), F.lit(0))
            quartile = lambda c, share: F.percentile_approx(c, share, 10000)
            low_high = [F.array(quartile(F.col(m) + down, 0.25), quartile(F.col(m) + up, 0.75), quartile(m, 0.75) - quartile(m, 0.25)).alias(m)
                        for m in measures]
            band = of.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.struct(*low_high).alias(tag)).filter(F.col("_n") >= least).drop("_n")
            out = out.join(band, keys, "left")
        held = F.coalesce(*tags)
        out = out.withColumns({f"_q_{m}": held[m] for m in measures}).drop(*tags)
    return out.drop("_all")


def neighbours(counts: dict[int, int]) -> dict[int, list[int]]:
    """For each size the sizes whose bands take its texts: its own, and those too sparse without it."""
    reach: dict[int, list[int]] = {size: [] for size in counts}
    for size in counts:
        by_distance = sorted({abs(s - size) for s in counts})
        held = next((d for d in by_distance if sum(n for s, n in counts.items() if abs(s - size) <= d) >= LEAST), by_distance[-1])
        for s in counts:
            if abs(s - size) <= held:
                reach[s].append(size)
    return reach
