"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

The field tags words (runs without white space) with O, EMAIL, IP, SECRET and begin/inside of CARD and PHONE. Features of a word are its
shape (character classes, runs collapsed), length class, digit count class, affix classes and a few character tests. It is trained by gradient
ascent on the small table in ``pii_examples`` and decoded by Viterbi, in numpy batches.

A word with a digit or one of ``@ = +``, a lone separator (``-``, ``/``, a bracket) and the word after a key term (``password:``, ``token``) have
features of their own; every other word is plain and has one feature. All weights are learned, a wrong tag of a plain word
at a raised cost. ``anchored`` proves from the learned weights that O is the tag of a plain word in every best path, so the chain falls apart
there and only the stretches between plain words are decoded; where weights do not prove it, every word is decoded. A text stands between O words.

Spans of the fixed patterns always stay; a span of the field is added where it touches none of them and holds what its kind demands
(a card number passes the Luhn test, an address has four parts up to 255, a phone number 9 to 15 digits).

Defined results: null texts are empty texts and have no spans; offsets are code points, end exclusive; repeated rows get equal rows; other
columns pass through.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dossierspark.llm.pii_examples import LINES
from dossierspark.llm.rows import quoted, with_columns

KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = ("O", "EMAIL", "IP", "SECRET", "B-CARD", "I-CARD", "B-PHONE", "I-PHONE")
SPECIAL = re.compile(r"[0-9@=+]")
#: A word with a special character. The test before it keeps the search linear in long words.
WORD = re.compile(r"(?<!\S)[^\s0-9@=+]*+[0-9@=+]\S*")
RUN = re.compile(r"\S+")
SEPARATOR = re.compile(r"(?<!\S)[-\u2013/().|]{1,3}(?!\S)")
KEY_TERMS = ("pass", "pwd", "secret", "token", "key", "kennwort", "clave")
#: A key term that ends its word, with or without a colon or equals sign, and the word after it.
KEYED = re.compile(r"(?<![^\W_])(?:(?P<own>pass(?:word|wd|wort|phrase)|kennwort|pwd|clave)|secret|token|(?:api|access|private)?[_-]?key)[\"']?"
                   r"(?P<sign>\s*[:=])?\s+(?P<word>\S+)", re.I)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
EDGE = "\"'`,;:!?.()[]{}<>|"


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def fixed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping per kind."""
    if not SPECIAL.search(text):
        return []
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _classes(word: str) -> str:
    return "".join("d" if "0" <= c <= "9" else "x" if c.islower() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)


def _after(word: str, cue: str) -> list[str]:
    """Features of the word after a key term; ``cue`` tells which kind of term, and whether a sign stood between them."""
    core = word.strip(EDGE)
    size = sum(len(core) >= n for n in (6, 9, 12, 16))
    turns = len(re.findall(r"[a-z](?=[A-Z])", core))
    return [f"after {cue}", f"after {cue} size {size}", f"after {cue} turns {min(turns, 2)}", f"after joined {'_' in core.strip('_')}",
            f"after vowels {sum(map(core.lower().count, 'aeiou')) * 4 // max(1, len(core))}"]


def word_features(word: str, cue: str = "") -> list[str]:
    more = _after(word, cue) if cue else []
    if not SPECIAL.search(word):
        return more or (["separator", f"separator {word}"] if SEPARATOR.fullmatch(word) else ["plain"])
    core = word.strip(EDGE)
    shape = re.sub(r"(.)\1+", r"\1", _classes(core))
    digits, letters = len(_digits(core)), sum(map(str.isalpha, core))
    size = min(len(core).bit_length(), 7)
    mixed = re.sub(r"[xXd]+", "a", shape)
    named = re.match(r"[A-Za-z_]*(?:pass|pwd|secret|token|key)[A-Za-z_]*[=:]", core, re.I) is not None
    changes = len(re.findall(r"(?<=[xX])d|d(?=[xX])|x(?=X)", shape))
    return ["bias", f"shape {shape[:24]}", f"mixed {mixed[:12]}", f"size {size}", f"digits {min(digits, 17)}", f"letters {min(letters, 6)}",
            f"share {digits * 4 // max(1, len(core))}", f"at {'@' in core[1:] and '.' in core.split('@')[-1]}", f"dots {min(core.count('.'), 4)}",
            f"named {named}", f"changes {min(changes, 4)}", f"changes {min(changes, 4)} size {size}", f"plus {core[:1] == '+'}", f"open {word[:1] == '('}",
            f"pair {digits} {letters == 0}" if digits < 20 else "many", f"quoted {word[:1] in '\"' and len(core) > 15}", f"upper {core.isupper()} size {size}",
            f"equals {'=' in core}", f"slash {'/' in core}", *more]


class Crf:
    def __init__(self, names: list[str]):
        self.place = {n: i for i, n in enumerate(names)}
        self.emit = np.zeros((len(names), len(TAGS)))
        self.step = np.zeros((len(TAGS), len(TAGS)))
        self.start = np.zeros(len(TAGS))
        self.known: dict[tuple[str, str], np.ndarray] = {}

    def scores(self, word: str, cue: str = "") -> np.ndarray:
        got = self.known.get((word, cue))
        if got is None:
            if len(self.known) > 50_000:
                self.known.clear()
            got = self.known[word, cue] = self.emit[[self.place[f] for f in word_features(word, cue) if f in self.place]].sum(0)
        return got

    def anchored(self) -> bool:
        """Whether a plain word is O in every best path: no pair of neighbours wins back what another tag loses at the word itself."""
        e = self.emit[self.place["plain"]]
        before = np.maximum((self.step - self.step[:, :1]).max(0), self.start - self.start[0])
        after = np.maximum((self.step - self.step[:1]).max(1), 0)
        return bool((e[0] - e - before - after)[1:].min() > 0)

    def decode(self, runs: list[list[tuple[str, str]]], inner: bool = True) -> list[np.ndarray]:
        """Best tags of each run of (word, cue); inner runs follow an O word and end before one."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(runs)
        order = sorted(range(len(runs)), key=lambda r: len(runs[r]))
        for lo in range(0, len(order), 4096):
            part = order[lo:lo + 4096]
            n = np.array([len(runs[r]) for r in part])
            e = np.zeros((len(part), n.max(), len(TAGS)))
            for k, r in enumerate(part):
                e[k, :n[k]] = [self.scores(*w) for w in runs[r]]
            best = e[:, 0] + (self.step[0] if inner else self.start)
            back = np.zeros(e.shape, np.int8)
            last = best.copy()
            for t in range(1, e.shape[1]):
                way = best[:, :, None] + self.step
                back[:, t] = way.argmax(1)
                best = way.max(1) + e[:, t]
                last[n == t + 1] = best[n == t + 1]
            tags = np.zeros(e.shape[:2], np.int64)
            end = (last + (self.step[:, 0] if inner else 0)).argmax(1)
            for t in range(e.shape[1] - 1, -1, -1):
                tags[:, t] = np.where(n - 1 == t, end, tags[:, t])
                if t:
                    tags[:, t - 1] = np.where(t < n, back[np.arange(len(n)), t, tags[:, t]], 0)
            for k, r in enumerate(part):
                out[r] = tags[k, :n[k]]
        return out


def _marked(line: str) -> tuple[list[tuple[str, str]], list[int]]:
    """Words with their cues, and tags, of a line of the labelled table."""
    plain, spans, at = "", [], 0
    for m in re.finditer(r"\[(email|ip|card|phone|secret) ([^\]]*)\]", line):
        plain += line[at:m.start()]
        spans.append((len(plain), len(plain) + len(m[2]), m[1]))
        plain += m[2]
        at = m.end()
    plain += line[at:]
    words, tags, cues = [], [], cues_of(plain)
    for m in re.finditer(r"\S+", plain):
        words.append((m[0], cues.get(m.start(), "")))
        tag, inside = "O", next((s for s in spans if s[0] < m.end() and m.start() < s[1]), None)
        if inside:
            tag = inside[2].upper() if inside[2] in ("email", "ip", "secret") else ("B-" if m.start() <= inside[0] else "I-") + inside[2].upper()
        tags.append(TAGS.index(tag))
    return words, tags


@lru_cache(maxsize=4)
def train(lines: tuple[str, ...] = tuple(LINES), rounds: int = 300, rate: float = 0.5, decay: float = 0.02, margin: float = 10.0) -> Crf:
    """Maximises the penalised log likelihood of the labelled lines; all lines at once, padded.

    A wrong tag of a plain word is scored ``margin`` too high while training (softmax margin), so the learned weights hold that lead.
    """
    rows = [_marked(line) for line in lines]
    names = sorted({f for words, _ in rows for w in words for f in word_features(*w)} | {"plain"})
    crf = Crf(names)
    n, width, k = len(rows), max(len(w) for w, _ in rows), len(TAGS)
    x = np.zeros((n, width, len(names)))
    y = np.zeros((n, width), int)
    mask = np.zeros((n, width), bool)
    for r, (words, tags) in enumerate(rows):
        mask[r, :len(words)], y[r, :len(tags)] = True, tags
        for t, w in enumerate(words):
            x[r, t, [crf.place[f] for f in word_features(*w)]] = 1
    free = (np.arange(len(names)) != crf.place["plain"])[:, None]  # the weights of the plain feature are not drawn to zero
    gold = np.eye(k)[y] * mask[..., None]
    cost = margin * x[:, :, crf.place["plain"], None] * (1 - gold)
    both = mask[:, 1:] & mask[:, :-1]
    gold_step = np.einsum("rti,rtj->ij", gold[:, :-1], gold[:, 1:] * both[..., None])
    grads = [np.zeros_like(p) for p in (crf.emit, crf.step, crf.start)]
    lse = lambda a, axis: a.max(axis) + np.log(np.exp(a - np.expand_dims(a.max(axis), axis)).sum(axis))
    for _ in range(rounds):
        e = x @ crf.emit + cost
        f = np.zeros((n, width, k))
        f[:, 0] = e[:, 0] + crf.start
        for t in range(1, width):
            f[:, t] = np.where(mask[:, t, None], lse(f[:, t - 1, :, None] + crf.step, 1) + e[:, t], f[:, t - 1])
        b = np.zeros((n, width, k))
        for t in range(width - 2, -1, -1):
            b[:, t] = np.where(mask[:, t + 1, None], lse(crf.step + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0.0)
        z = lse(f[:, -1], 1)
        p = np.exp(f + b - z[:, None, None]) * mask[..., None]
        pair = np.exp(f[:, :-1, :, None] + crf.step + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        now = [np.einsum("rtf,rtk->fk", x, gold - p), gold_step - pair.sum((0, 1)), (gold - p)[:, 0].sum(0)]
        for param, g, total in zip((crf.emit, crf.step, crf.start), now, grads):
            g = g - decay * param * (free if param is crf.emit else 1)
            total += g * g
            param += rate * g / np.sqrt(total + 1e-8)
    return crf


def cues_of(text: str) -> dict[int, str]:
    """Starts of the words that follow a key term, with the kind of term and whether a sign stands between."""
    low = text.lower()
    if not any(k in low for k in KEY_TERMS):
        return {}
    out, at = {}, 0
    while m := KEYED.search(text, at):
        out[m.start("word")] = f"{'pass' if m['own'] else 'key'} {'sign' if m['sign'] else 'bare'}"
        at = m.start("word")  # the word itself may be a key term
    return out


def runs_of(text: str, cues: dict[int, str], whole: bool = False) -> list[list[tuple[int, int]]]:
    """Stretches of neighbouring words that are not plain (``whole``: of all words)."""
    if whole:
        spans = [m.span() for m in RUN.finditer(text)]
    else:
        found = {m.start(): m.end() for rx in (WORD, SEPARATOR) for m in rx.finditer(text)}
        spans = sorted((found | {a: RUN.match(text, a).end() for a in cues}).items())
    out: list[list[tuple[int, int]]] = []
    for a, b in spans:
        if out and text[out[-1][-1][1]:a].isspace():
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


def field_spans(texts: list[str], crf: Crf) -> list[list[tuple[int, int, str]]]:
    """Spans of the field in each text, edge punctuation trimmed."""
    whole = not crf.anchored()
    cues = [cues_of(t) for t in texts]
    places = [(i, run) for i, t in enumerate(texts) for run in runs_of(t, cues[i], whole)]
    tagged = crf.decode([[(texts[i][a:b], cues[i].get(a, "")) for a, b in run] for i, run in places])
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for (i, run), tags in zip(places, tagged):
        open_ = None
        for (a, b), tag in zip(run, tags):
            name = TAGS[tag]
            kind = name.split("-")[-1].lower()
            if name.startswith("I-") and open_ and open_[2] == kind:
                open_ = (open_[0], b, kind)
                continue
            if open_:
                out[i].append(open_)
            open_ = None if name == "O" else (a, b, kind)
        if open_:
            out[i].append(open_)
    return [[_trimmed(t, s) for s in spans] for t, spans in zip(texts, out)]


def _trimmed(text: str, span: tuple[int, int, str]) -> tuple[int, int, str]:
    a, b, kind = span
    if kind == "secret" and (m := re.match(r"[\"'(]*[A-Za-z_]+[=:][\"']*(?=\S)", text[a:b])):
        a += m.end()
    left = EDGE.replace("(", "") if kind == "phone" else EDGE
    while a < b - 1 and text[a] in left:
        a += 1
    while b > a + 1 and text[b - 1] in EDGE:
        b -= 1
    return a, b, kind


def _holds(text: str, span: tuple[int, int, str]) -> bool:
    """The exact check behind the field: what the kind of a span demands of any number or address."""
    part, kind = text[span[0]:span[1]], span[2]
    digits = _digits(part)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "ip":
        return IP.fullmatch(part) is not None and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in part.split("."))
    return kind != "email" or "@" in part[1:-1]


def find_spans(texts: list[str], crf: Crf) -> list[tuple[list, list]]:
    """Per text the spans of the fixed patterns, and all spans."""
    out = []
    for text, more in zip(texts, field_spans(texts, crf)):
        base = fixed_spans(text)
        free = [s for s in more if _holds(text, s) and not any(s[0] < b and a < s[1] for a, b, _ in base)]
        out.append((base, sorted(base + free, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


SPAN = "array<struct<kind: string, start: int, stop: int>>"


def tag(docs: DataFrame, crf: Crf, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with base_spans (fixed patterns) and all_spans."""
    one = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def make():
        def fn(column):
            found = find_spans([column[i].as_py() or "" for i in range(len(column))], crf)
            return [pa.array([[{"kind": k, "start": a, "stop": b} for a, b, k in f[side]] for f in found], one) for side in (0, 1)]
        return fn

    return with_columns(docs, [text], f"base_spans {SPAN}, all_spans {SPAN}", make, drop)


def redact(docs: DataFrame, crf: Crf, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind, like ``[EMAIL]``; null texts stay null."""
    def make():
        def fn(column):
            texts = column.to_pylist()
            out = []
            for t, (_, spans) in zip(texts, find_spans([t or "" for t in texts], crf)):
                parts, at = [], 0
                for a, b, kind in spans:
                    if b <= at:
                        continue
                    if a >= at:
                        parts += [t[at:a], f"[{kind.upper()}]"]
                    at = b
                out.append(None if t is None else "".join(parts) + t[at:])
            return [pa.array(out, pa.string())]
        return fn

    columns = docs.columns
    return with_columns(docs, [text], "_redacted string", make, (text,)).withColumnRenamed("_redacted", text).select(*[quoted(c) for c in columns])
