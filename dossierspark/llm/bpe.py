"""Byte-level BPE encoding and decoding by tree reduction.

Encoded segments form a monoid. A segment is encoded by halves; two encoded neighbours are joined by encoding a window of
tokens around their border anew. The window grows until its outer tokens are *stable* next to the tokens outside: two
neighbouring tokens are stable if their joint bytes encode to exactly these two. A sequence whose neighbours are all stable
is the encoding of its bytes, so nothing outside the window can change. Long texts are split into pieces the same way: each
block is matched on its own, and at a border matching restarts at the last match that the border could have changed, until
a match begins where one of the right block begins. Decoding concatenates up the tree.

Defined results: a null text encodes like an empty one, to no ids; special-token strings are ordinary text; ids that are null
decode to no bytes. Texts of any length are handled whole. Other columns pass through; clashing names are replaced.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dossierspark.llm.rows import kept, with_columns

#: Cached pieces a worker; the cache is emptied beyond it.
CACHED = 250_000
#: Characters of a block of text, and ids of a leaf when decoding.
BLOCK, LEAF_IDS = 1 << 16, 1 << 13
#: Characters after a match that may decide it: a contraction looks at two letters, white space at one character.
LOOK_AHEAD = 3


def read_ranks(path: str) -> bytes:
    """The rank file as it is; it travels to the tasks, so executors need not have it."""
    with open(path, "rb") as f:
        return f.read()


class TreeBpe:
    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.vocab = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.vocab[rank] = token
        self.pairs: dict[int, tuple[int, ...]] = {}
        self.whole: dict[bytes, tuple[int, ...]] = {}
        self.reached: dict[bytes, bool] = {}

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Merges by lowest rank, leftmost first, on short windows and, with a heap, on long ones."""
        ranks = self.ranks
        if len(raw) <= 48:
            parts = [raw[i:i + 1] for i in range(len(raw))]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = ranks.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            return tuple(ranks[p] for p in parts)
        n = len(raw)
        end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(raw[i:end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (p := before[i]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return tuple(ranks[raw[i:end[i]]] for i in range(n) if alive[i])

    def changed(self, a: int, b: int) -> tuple[int, ...]:
        """What the joint bytes of two tokens encode to; empty if they are stable, as most pairs are."""
        key = a * len(self.vocab) + b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > CACHED:
                self.pairs.clear()
            got = self.merge(self.vocab[a] + self.vocab[b])
            got = self.pairs[key] = () if got == (a, b) else got
        return got

    def is_token(self, raw: bytes) -> bool:
        """Whether the bytes are one token that merging reaches."""
        if raw not in self.ranks:
            return False
        got = self.reached.get(raw)
        if got is None:
            got = self.reached[raw] = self.merge(raw) == (self.ranks[raw],)
        return got

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            lo = max(0, len(left) - i)
            inner = (self.changed(left[-1], right[0]) or (left[-1], right[0])) if i == j == 1 else self.merge(
                b"".join(map(self.vocab.__getitem__, left[lo:] + right[:j])))
            left_ok = lo == 0 or not self.changed(left[lo - 1], inner[0])
            right_ok = j >= len(right) or not self.changed(inner[-1], right[j])
            if left_ok and right_ok:
                return left[:lo] + inner + right[j:]
            i, j = i if left_ok else 2 * i, j if right_ok else 2 * j

    def segment(self, raw: bytes) -> tuple[int, ...]:
        if self.is_token(raw):
            return (self.ranks[raw],)
        if len(raw) > 12:
            return self.halves(raw)
        got = self.whole.get(raw)
        if got is None:
            if len(self.whole) > CACHED:
                self.whole.clear()
            got = self.whole[raw] = self.halves(raw)
        return got

    def halves(self, raw: bytes) -> tuple[int, ...]:
        half = len(raw) // 2
        return self.join(self.segment(raw[:half]), self.segment(raw[half:]))

    def piece(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one piece; a piece that is in the vocabulary is one token, whether or not merging reaches it."""
        rank = self.ranks.get(raw)
        return (rank,) if rank is not None else self.halves(raw)

    def decode(self, ids) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.vocab.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def split_pieces(pattern, text: str, block: int = BLOCK) -> list[str]:
    """``pattern.findall(text)``, by halves: the matches of each block, mended at the borders."""
    if len(text) <= block:
        return pattern.findall(text)

    def ends(lo: int, hi: int) -> list[int]:
        if hi - lo <= block:
            return [lo + m.end() for m in pattern.finditer(text[lo:hi])]
        mid = (lo + hi) // 2
        return mended(lo, ends(lo, mid), mid, ends(mid, hi), hi)

    def mended(lo: int, left: list[int], mid: int, right: list[int], hi: int) -> list[int]:
        kept = len(left)
        while kept and left[kept - 1] > mid - LOOK_AHEAD:
            kept -= 1
        at, k, out = left[kept - 1] if kept else lo, 0, left[:kept]
        # Where a match begins at a place where the right block has one begin, the rest is the same.
        while at < hi:
            while k < len(right) and right[k] < at:
                k += 1
            if at == mid or k < len(right) and right[k] == at:
                return out + right[0 if at == mid else k + 1:]
            m = pattern.match(text, at, min(len(text), hi))
            at = m.end()
            out.append(at)
        return out

    stops = ends(0, len(text))
    return [text[a:b] for a, b in zip([0, *stops[:-1]], stops)]


class Pieces(dict):
    """Ids of a piece as the bytes of int32 values, kept for as many pieces as the cache holds. Long pieces are not kept."""

    def __init__(self, bpe: TreeBpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        got = array("i", self.bpe.piece(piece.encode("utf-8", "replace"))).tobytes()
        if len(piece) <= 64:
            if len(self) > CACHED:
                self.clear()
            self[piece] = got
        return got


def _coder(rank_file: bytes, pattern: str):
    import regex

    def build():
        bpe = TreeBpe(rank_file)
        return bpe, regex.compile(pattern), Pieces(bpe)

    return kept(("bpe", hash((rank_file, pattern))), build)


def _encoder(rank_file: bytes, pattern: str) -> Callable:
    _, compiled, known = _coder(rank_file, pattern)

    def fn(column):
        values, offsets = bytearray(), [0]
        for i in range(len(column)):
            t = column[i].as_py()
            if t:
                values += b"".join(map(known.__getitem__, split_pieces(compiled, t)))
            offsets.append(len(values) // 4)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(values, np.int32)))
    return fn


def _decoder(rank_file: bytes, pattern: str) -> Callable:
    bpe = _coder(rank_file, pattern)[0]

    def fn(column):
        return pa.array([bpe.decode(column[i].values.to_numpy(zero_copy_only=False).tolist()) if column[i].is_valid else b""
                         for i in range(len(column))], pa.binary())
    return fn


def encode(df: DataFrame, rank_file: bytes, pattern: str, text: str = "text", ids: str = "ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the token ids of each whole text as ``array<int>``."""
    def make():
        encoder = _encoder(rank_file, pattern)
        return lambda column: [encoder(column)]

    return with_columns(df, [text], f"`{ids}` array<int>", make, drop, keeps=True)


def decode(df: DataFrame, rank_file: bytes, pattern: str, ids: str = "ids", decoded: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the bytes of each list of ids."""
    def make():
        decoder = _decoder(rank_file, pattern)
        return lambda column: [decoder(column)]

    return with_columns(df, [ids], f"`{decoded}` binary", make, drop, keeps=True)


def round_trip(df: DataFrame, rank_file: bytes, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded",
               drop: tuple[str, ...] = ()) -> DataFrame:
    """``encode`` and then ``decode`` of its ids, in one worker a task instead of two."""
    def make():
        encoder, decoder = _encoder(rank_file, pattern), _decoder(rank_file, pattern)

        def fn(column):
            coded = encoder(column)
            return [coded, decoder(coded)]
        return fn

    return with_columns(df, [text], f"`{ids}` array<int>, `{decoded}` binary", make, drop, keeps=True)
