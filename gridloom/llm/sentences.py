"""Sentence units of texts in many scripts, by a hidden-event n-gram language model.

Text is first cut by its layout: blank lines end blocks, and a block of lines with list markers is one unit per
item. Inside a block every place where a sentence might end (after a sentence mark and its closing quotes, or at a
blank in scripts that write neither marks nor blanks between words) is a hidden event: a boundary token stands
there or not. Between all other words the model has no boundary token, since a stretch without an end mark is one unit.

The token's odds are those of the two readings of the words around it: P(b | left) P(right | b) with the boundary
token b in between, against P(no b | left) P(right | no b, left) without. The n-grams back off from a word to its shape,
and from the left word with the class of the right one to the two apart. Block edges are boundaries that can be seen,
so how often a word stands last or first in a block, against how often it stands before or after a possible boundary,
gives the first estimate without any labels; passes of expected counts refine it. Forward-backward runs over every
block, in those passes as in decoding, as what a closing quote means depends on whether the sentence began with that
quote, that is, on the event before it.

Texts are read once: possible boundaries are kept as packed numbers, and all passes work on those. Statistics are
counted over all documents. The model is a table of fixed size (hashed words, and word shapes for rare words), so it
can be broadcast whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import cut

WORDS, SHAPES, CLASSES = 1 << 20, 1 << 14, 16
#: Sides of a place: left word, left shape, right word, right shape, left word with right class, right class.
SIDES = ("lw", "ls", "rw", "rs", "lr", "rc")
SIZES = (WORDS, SHAPES, WORDS, SHAPES, WORDS, CLASSES)
#: Seen fewer times, a word counts as its shape with so much weight.
SHRINK = 4.0
PASSES = 2
#: A word at fewer possible boundaries is rare: its shape is learnt from it.
RARE = 20
#: A word seen less often has no entry of its own.
SEEN = 4
#: Some blocks hold so many times more sentences than the mean; and what the first estimate leaves open at most.
SLACK, DOUBT = 2.5, 0.1

# fixed values: marks and brackets
MARKS = ".!?…。！？؟।॥｡։۔።။"
STRONG = "!?。！？؟।॥｡։۔።။"
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "［": "］", "【": "】", "《": "》", "〈": "〉", "‹": "›"}
CLOSERS = "”»」』)）]］】》〉›\""

_BRACKETS = frozenset("".join(PAIRS) + CLOSERS)
_TOKEN = re.compile("[" + re.escape(MARKS) + "]+|[" + re.escape("".join(PAIRS) + CLOSERS) + "]")
_SPACED = re.compile("[" + re.escape(MARKS) + "]+|[" + re.escape("".join(PAIRS) + CLOSERS) + r"]|\s+")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*|\f")
_BULLET = re.compile(r"[^\S\n]*(?:[-*•‣◦–·+]|\d{1,4}[.)]|\(\d{1,3}\))[^\S\n]+(?=\S)")
_HASH = re.compile(r"[^\S\n]*#{1,6}[^\S\n]+\S")
_UNMARKED = re.compile("[฀-໿ក-៿]")
_DENSE = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿฀-໿ក-៿]")
_LEFT = re.compile(r"[^\s" + re.escape("".join(PAIRS) + CLOSERS) + r"¿¡‘—]+$")
_RIGHT = re.compile(r"[^\s" + re.escape("".join(PAIRS) + CLOSERS) + r"]+")
_GLUED = re.compile("[" + re.escape(MARKS) + r"](?=[A-ZÀ-ÞА-ЯЁ])")
_TRIM = ".,;:!?…"


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole): stretches that no sentence crosses; whole ones are units as they are."""
    out = []
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            _block(text, at, end, out)
        at = m.end() if m else end
    return out


def _block(text: str, start: int, end: int, out: list[tuple[int, int, bool]]) -> None:
    while True:
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if start == end:
            return
        if text[start] != "#" or not _HASH.match(text, start, end):
            break
        stop = text.find("\n", start, end)
        stop = end if stop < 0 else stop
        last = stop
        while text[last - 1].isspace():
            last -= 1
        out.append((start, last, True))
        start = stop
    if not _BULLET.match(text, start, end):
        out.append((start, end, False))
        return
    heads = [start]
    at = text.find("\n", start, end)
    while at >= 0:
        if _BULLET.match(text, at + 1, end):
            heads.append(at + 1)
        at = text.find("\n", at + 1, end)
    if len(heads) == 1 and re.match(r"\d", text[start]) and "\n" not in text[start:end] and len(text) > end - start and not re.match(r"\d{1,2}[.)]", text[start:end]):
        out.append((start, end, False))  # a year at the start of a sentence
        return
    for a, b in zip(heads, [*heads[1:], end]):
        while text[a].isspace():
            a += 1
        while text[b - 1].isspace():
            b -= 1
        out.append((a, b, True))


@dataclass(slots=True)
class Site:
    end: int
    next: int
    left: tuple[str, str]
    right: tuple[str, str]
    #: keys of the left side if the sentence did not begin with the closing quote's opener
    inner: tuple[str, str] | None = None


@lru_cache(200_000)
def _shape(w: str) -> str:
    if not w:
        return "-"
    c = w[0]
    if any(ch.isdigit() for ch in w) and not any(ch.isalpha() for ch in w):
        return "0" * min(len(re.match(r"\d*", w).group()), 4) + (".0" if re.search(r"\d\D\d", w) else "")
    if len(w) == 1:
        return "A" if c.isupper() else "a" if c.islower() else "o"
    if "." in w or "_" in w or "/" in w:
        return "x.x" if c.islower() else "X.X"
    if c.isupper():
        return "X-X" if "-" in w else "XX" if w.isupper() else "Xx"
    if c.islower():
        return "xX" if any(ch.isupper() for ch in w) else "x1" if len(w) < 4 else "x"
    return "d" if _DENSE.match(w) else "o" + str(min(len(w), 4))


@lru_cache(200_000)
def _word_key(w: str) -> str:
    return _shape(w) if any(ch.isdigit() for ch in w) else w


def left_keys(text: str, start: int, mark_at: int, mark: str) -> tuple[str, str]:
    """Keys of what stands before a sentence mark: the word with it where the mark is a stop, else the mark."""
    if mark == "." and mark_at > start and text[mark_at - 1].isascii() and text[mark_at - 1].isalnum():  # the common case
        chunk = text[max(start, mark_at - 40) : mark_at]
        m = _LEFT.search(chunk.rsplit(None, 1)[-1])
        return _stop_keys(_GLUED.split(m.group())[-1], ".")
    kind = mark if len(mark) == 1 and mark != "…" else "..." if set(mark) <= {".", "…"} else mark[0] if mark[0] in STRONG else mark[-1]
    if kind not in (".", "..."):
        return f"T{kind}", f"T{kind}"
    m = _LEFT.search(text, max(start, mark_at - 40), mark_at)
    w = _GLUED.split(m.group())[-1] if m else ""
    if not w:
        return f"L{text[mark_at - 1 : mark_at]}{kind}", f"L){kind}"
    if _DENSE.match(w[-1]):
        return f"Ld{kind}", f"Ld{kind}"
    return _stop_keys(w, kind)


@lru_cache(200_000)
def _stop_keys(w: str, kind: str) -> tuple[str, str]:
    return f"L{_word_key(w)}{kind}", f"L{_shape(w)}{kind}"


@lru_cache(200_000)
def _word_keys(lead: str, w: str) -> tuple[str, str]:
    return f"R{lead}{_word_key(w)}", f"R{lead}{_shape(w)}"


def right_keys(text: str, at: int, end: int, unmarked: bool = False) -> tuple[str, str]:
    """Keys of what stands after a possible boundary: openers, then the word (its first letters in dense scripts)."""
    if not unmarked and at < end and text[at].isascii() and text[at].isalnum():  # the common case
        return _word_keys("", _RIGHT.match(text, at, min(end, at + 40)).group().rstrip(_TRIM))
    lead = "~" if unmarked else ""
    while at < end and not text[at].isalnum() and not text[at].isspace() and len(lead) < 4:
        lead += text[at]
        at += 1
    while lead.strip("~") and at < end and text[at].isspace():
        at += 1
    if at < end and _DENSE.match(text[at]):
        n = 4 if _UNMARKED.match(text[at]) else 2
        return f"R{lead}{text[at : at + n]}", f"R{lead}d"
    m = _RIGHT.match(text, at, min(end, at + 40))
    w = m.group().rstrip(_TRIM) if m else ""
    if lead.startswith(("...", "…")):
        lead = "..."
    return _word_keys(lead, w)


def _blank_keys(text: str, start: int, at: int) -> tuple[str, str]:
    """Keys of what stands before a blank in a script without sentence marks."""
    from_ = max(start, at - 5)
    chunk = text[from_:at]
    w = chunk.split()[-1] if chunk.split() else ""
    if len(w) < len(chunk) or from_ == start or text[from_ - 1].isspace():
        w = "^" + w
    if w and w[-1].isdigit():
        return "B0", "B0"
    if w and not _UNMARKED.match(w[-1]):
        return f"B{w[-1]}", "Bx" if w[-1].isalpha() else "B-"
    return f"B{w}", "Bd"


def is_unmarked(part: str) -> bool:
    """Whether a stretch is mainly in a script that marks neither sentences nor words."""
    return bool(_UNMARKED.search(part)) and len(_UNMARKED.findall(part)) * 3 > len(part)


def sites(text: str, start: int, end: int, unmarked: bool | None = None) -> list[Site]:
    """The possible boundaries inside a block. What stands between matched quotes or brackets is passed over."""
    part = text[start:end]
    unmarked = is_unmarked(part) if unmarked is None else unmarked
    tokens = [(m.start() + start, m.end() + start, m.group()) for m in (_SPACED if unmarked else _TOKEN).finditer(part)]
    if not tokens:
        return []
    # matched pairs, outermost only
    stack: list[tuple[int, str]] = []
    outer: dict[int, int] = {}
    for a, t in [(a, t) for a, _, t in tokens if t in _BRACKETS]:
        if t == '"':
            hit = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == '"'), -1)
            if hit < 0:
                stack.append((a, '"'))
                continue
        else:
            hit = next((k for k in range(len(stack) - 1, -1, -1) if t in PAIRS.get(stack[k][1], "")), -1)
            if hit < 0:
                if t in PAIRS:
                    stack.append((a, t))
                continue
        outer[stack[hit][0]] = a
        del stack[hit:]
    out: list[Site] = []
    skip = -1
    for a, b, t in tokens:
        if a < skip:
            continue
        if a in outer:
            close = outer[a]
            skip = close + 1
            inside = text[a + 1 : close].rstrip(" \t\n " + CLOSERS)
            if not inside or inside[-1] not in MARKS:
                continue
            e = close + 1
            if e >= end or not (text[e].isspace() or text[e].isalnum() or text[e] in PAIRS or text[e] in '"¿¡'):
                continue
            n = e
            while n < end and text[n].isspace():
                n += 1
            if n >= end:
                continue
            key = f"Q{text[close]}{inside[-1]}"
            began = a == start or (out and out[-1].next == a)
            mid = (f"{key}m", f"{key}m")
            out.append(Site(e, n, (f"{key}s", f"{key}s") if began else mid, right_keys(text, n, end, unmarked), mid if began and a != start else None))
            continue
        if t[0].isspace():
            if a > start and b < end and text[a - 1] not in MARKS and not (out and out[-1].next == b):
                out.append(Site(a, b, _blank_keys(text, start, a), right_keys(text, b, end, unmarked)))
            continue
        if t[0] not in MARKS:
            continue
        e = b
        while e < end and text[e] in CLOSERS and e not in outer:
            e += 1
        if e >= end or a == start:
            continue
        nx = text[e]
        if not nx.isspace():
            soft = t[-1] in ".…"
            if nx.isdigit() and soft or not (nx.isalnum() or nx in PAIRS or nx in '"¿¡“„'):
                continue
            if soft and (nx.islower() or nx in "([" or not (text[a - 1].isalnum() or text[a - 1] in CLOSERS)) and not (t[-1] == "…" and _DENSE.match(nx)):
                continue
        n = e
        while n < end and text[n].isspace():
            n += 1
        if n < end:
            out.append(Site(e, n, left_keys(text, start, a, t), right_keys(text, n, end, unmarked)))
    return out


def last_keys(text: str, start: int, end: int) -> tuple[str, str] | None:
    """The left keys at a block's end, if it ends in a sentence mark; the blank's keys in unmarked scripts."""
    e = end
    while e > start and text[e - 1] in CLOSERS:
        e -= 1
        while e > start and text[e - 1].isspace():
            e -= 1
    m = e
    while m > start and text[m - 1] in MARKS:
        m -= 1
    if m == e:
        return _blank_keys(text, start, end) if _UNMARKED.match(text[end - 1]) else None
    if e < end:
        a = max((text.rfind(o, start, m) for o, c in [*PAIRS.items(), ('"', '"')] if text[end - 1] in c), default=-1)
        key = f"Q{text[end - 1]}{text[e - 1]}"
        if a == start:
            return f"{key}s", f"{key}s"
        before = text[start:a].rstrip() if a > start else ""
        s = "s" if before and before[-1] in MARKS + CLOSERS else "m"
        return f"{key}{s}", f"{key}{s}"
    return left_keys(text, start, m, text[m:e])


def _slot(key: str, size: int) -> int:
    return zlib.crc32(key.encode()) % size


class _Slots(dict):
    def __missing__(self, keys: tuple[str, str]) -> tuple[int, int]:
        if len(self) > 500_000:
            self.clear()
        v = self[keys] = (_slot(keys[0], WORDS), _slot(keys[1], SHAPES))
        return v


_SLOTS = _Slots()
#: Documents and characters that are packed together.
PACK_DOCS, PACK_CHARS = 2_000, 8_000_000
_ALL = (("ids", np.int64), ("n_blocks", np.int32))
_BLOCKS = (("start", np.int32), ("end", np.int32), ("n_sites", np.int32), ("rw", np.int32), ("rs", np.int32), ("lw", np.int32), ("ls", np.int32))
_SITES = (("end", np.int32), ("next", np.int32), ("lw", np.int32), ("ls", np.int32), ("rw", np.int32), ("rs", np.int32), ("rc", np.int8), ("ilw", np.int32), ("ils", np.int32))


@lru_cache(100_000)
def _class(shape: str) -> int:
    """What the right side begins with: 0 capital, 1 small letter, 2 digit, 3 opener, 4 dense, 5 other (8 more: unmarked script)."""
    w = shape[1:]
    base = 8 * w.startswith("~")
    w = w.lstrip("~")
    if not w:
        return base + 5
    return base + (0 if w[0] in "XA" else 1 if w[0] in "xa" else 2 if w[0] == "0" else 4 if w[0] in "do" else 3 if w[0] in PAIRS or w[0] in '"¿¡' else 5)


def with_class(lw: np.ndarray, rc: np.ndarray) -> np.ndarray:
    """Slot of a left word together with the class of the right side."""
    return (lw.astype(np.int64) + rc.astype(np.int64) * 0x61C8B) % WORDS


def pack(rows: list[tuple[int | None, str]]) -> bytes:
    """Blocks and possible boundaries of some documents as numbers: all that the model and the units need of a text."""
    ids, n_blocks, blocks_, sites_ = [], [], [], []
    for doc_id, text in rows:
        found = blocks(text)
        marked = not _UNMARKED.search(text)
        ids.append(doc_id)
        n_blocks.append(len(found))
        for s, e, whole in found:
            body = s
            if whole and (m := _BULLET.match(text, s, e)):
                body = m.end()
            last = last_keys(text, body, e)
            unmarked = not marked and is_unmarked(text[s:e])
            here = [] if whole else sites(text, s, e, unmarked)
            blocks_.append((s, e, len(here), *_SLOTS[right_keys(text, body, e, unmarked)], *(_SLOTS[last] if last else (-1, -1))))
            for x in here:
                sites_.append((x.end, x.next, *_SLOTS[x.left], *_SLOTS[x.right], _class(x.right[1]), *(_SLOTS[x.inner] if x.inner else (-1, -1))))
    out = [np.array([len(ids), len(blocks_), len(sites_)], np.int64).tobytes(), np.array(ids, np.int64).tobytes(), np.array(n_blocks, np.int32).tobytes()]
    for names, found in ((_BLOCKS, blocks_), (_SITES, sites_)):
        columns = list(zip(*found)) or [()] * len(names)
        out += [np.array(c, t).tobytes() for c, (_, t) in zip(columns, names)]
    return zlib.compress(b"".join(out), 1)


@dataclass
class Packed:
    ids: np.ndarray
    n_blocks: np.ndarray
    blocks: dict[str, np.ndarray]
    sites: dict[str, np.ndarray]

    @classmethod
    def read(cls, data: bytes) -> Packed:
        raw = zlib.decompress(data)
        nd, nb, ns = np.frombuffer(raw, np.int64, 3)
        at = 24

        def take(n: int, t: type) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(raw, t, n, at)
            at += a.nbytes
            return a

        ids, n_blocks = take(nd, np.int64), take(nd, np.int32)
        return cls(ids, n_blocks, {n: take(nb, t) for n, t in _BLOCKS}, {n: take(ns, t) for n, t in _SITES})


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = lambda rows: pa.RecordBatch.from_arrays([pa.array([pack(rows)], pa.binary())], names=["data"])
    held: list[tuple[int | None, str]] = []
    chars = 0
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            held.append((i, t))
            chars += len(t)
            if len(held) >= PACK_DOCS or chars >= PACK_CHARS:
                yield row(held)
                held, chars = [], 0
    if held:
        yield row(held)


@dataclass
class Model:
    """Probability that a boundary token stands at a possible place, given the words at its sides.

    p, n: by side (see SIDES), the share of boundaries and the number of places per slot. Before the first
    pass of expected counts, word and shape stand alone; then the left word counts with the class of the right.
    """

    p: list[np.ndarray]
    n: list[np.ndarray]
    prior: float
    joint: bool

    def __reduce__(self) -> tuple:
        """Shipped compressed: most slots are empty, and every worker keeps a copy on disk."""
        return _unpacked_model, (zlib.compress(b"".join(a.astype(np.float32).tobytes() for a in [*self.p, *self.n]), 1), self.prior, self.joint)

    def posterior(self, lw: np.ndarray, ls: np.ndarray, rw: np.ndarray, rs: np.ndarray, rc: np.ndarray) -> np.ndarray:
        """By Bayes, P(right | b) / P(right | no b) is the odds of b given the right side over the prior odds."""

        def blend(side: int, slot: np.ndarray, back: np.ndarray) -> np.ndarray:
            n = self.n[side][slot]
            return (self.p[side][slot] * n + back * SHRINK) / (n + SHRINK)

        def odds(q: np.ndarray) -> np.ndarray:
            q = np.clip(q, 0.001, 0.999)
            return q / (1 - q)

        left, even = blend(0, lw, self.p[1][ls]), self.prior / (1 - self.prior)
        if self.joint:
            by_class = self.p[5][rc]
            both = odds(left) * odds(by_class) / even
            o = odds(blend(4, with_class(lw, rc), both / (1 + both))) * odds(blend(2, rw, by_class)) / odds(by_class)
        else:
            o = odds(left) * odds(blend(2, rw, self.p[3][rs])) / even
        return o / (1 + o)

    def events(self, d: Packed) -> np.ndarray:
        """Posterior of a boundary at every site, by forward-backward over each block, all blocks at once."""
        x = d.sites
        right = (x["rw"], x["rs"], x["rc"])
        after = self.posterior(x["lw"], x["ls"], *right)  # the event before was a boundary
        other = np.flatnonzero(x["ilw"] >= 0)
        inside = after.copy()
        inside[other] = self.posterior(x["ilw"][other], x["ils"][other], *(r[other] for r in right))
        size = d.blocks["n_sites"].astype(np.int64)
        first = np.cumsum(size) - size
        ahead, back = np.empty((len(after), 2)), np.ones((len(after), 2))
        order = np.argsort(-size, kind="stable")
        lengths = -size[order]
        state = np.tile([0.0, 1.0], (len(size), 1))
        steps = int(size.max()) if len(size) else 0
        live = [int(np.searchsorted(lengths, -i, "left")) for i in range(steps)]  # blocks with more than i sites
        for i in range(steps):
            b = order[: live[i]]
            at = first[b] + i
            yes = state[b, 0] * inside[at] + state[b, 1] * after[at]
            state[b] = ahead[at] = np.stack([1 - yes, yes], 1)
        for i in range(steps - 2, -1, -1):
            b = order[: live[i + 1]]
            at = first[b] + i
            v0 = (1 - inside[at + 1]) * back[at + 1, 0] + inside[at + 1] * back[at + 1, 1]
            v1 = (1 - after[at + 1]) * back[at + 1, 0] + after[at + 1] * back[at + 1, 1]
            back[at] = np.stack([v0, v1], 1) / (v0 + v1)[:, None]
        both = ahead * back
        return both[:, 1] / both.sum(axis=1) if len(both) else after


def _unpacked_model(data: bytes, prior: float, joint: bool) -> Model:
    flat = np.frombuffer(zlib.decompress(data), np.float32)
    tables = np.split(flat, np.cumsum(SIZES * 2)[:-1])
    return Model(tables[: len(SIZES)], tables[len(SIZES) :], prior, joint)


def _side_counts(batches: Iterator[pa.RecordBatch], model: Model | None, expect: bool) -> Iterator[pa.RecordBatch]:
    """Sums by side and slot: sites, edges, expected boundaries (with ``expect``). Shapes are counted from rare words once
    those are known."""
    sums = [np.zeros((z, 3)) for z in SIZES]

    def add(k: int, kind: int, slot: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Counts under ``kind``, and weights under the expected boundaries."""
        if len(slot):
            at, inverse = np.unique(slot, return_inverse=True)
            sums[k][at, kind] += np.bincount(inverse, minlength=len(at))
            if weight is not None:
                sums[k][at, 2] += np.bincount(inverse, weight, len(at))

    for b in batches:
        for data in b.column("data").to_pylist():
            d = Packed.read(data)
            x, e = d.sites, d.blocks
            p = model.events(d) if expect else None
            slots = (x["lw"], x["ls"], x["rw"], x["rs"], with_class(x["lw"], x["rc"]), x["rc"])
            edge = {0: e["lw"][e["lw"] >= 0], 1: e["ls"][e["lw"] >= 0], 2: e["rw"], 3: e["rs"]}
            for k, slot in enumerate(slots):
                on, rim = slice(None), edge.get(k, np.zeros(0, int))
                if model is not None and k in (1, 3):
                    on = model.n[k - 1][slots[k - 1]] < RARE
                    rim = rim[model.n[k - 1][edge[k - 1]] < RARE]
                add(k, 0, slot[on], None if p is None else p[on])
                add(k, 1, rim)
    for k, t in enumerate(sums):
        at = np.flatnonzero(t.any(axis=1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), *[pa.array(t[at, i]) for i in range(3)]], names=["kind", "slot", "sites", "edges", "expected"])


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' possible boundaries, read once and written."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    return cut(rows.mapInArrow(_packs, "data binary"))


def _counting(shared, expect: bool):  # noqa: ANN001, ANN202
    return lambda batches: _side_counts(batches, shared.value, expect)


def fit(packs: DataFrame) -> Model:
    """The model from all documents' possible boundaries: two counts, then passes of expected counts."""
    spark = packs.sparkSession
    strong = sorted({_slot(f"T{c}", SHAPES) for c in STRONG})
    model = None
    rho = rho_right = 1.0
    for step in range(2 + PASSES):
        shared = spark.sparkContext.broadcast(model)
        rows = packs.mapInArrow(_counting(shared, step >= 2), "kind int, slot int, sites double, edges double, expected double")
        # at most sum(SIZES) rows, whatever the corpus
        sums = rows.groupBy("kind", "slot").agg(F.sum("sites").alias("sites"), F.sum("edges").alias("edges"), F.sum("expected").alias("expected"))
        got = sums.filter(f"kind in (1, 3, 5) or sites + edges >= {SEEN}").toArrow().to_pandas()
        shared.destroy()  # the next pass has its own
        tables = []
        for k, z in enumerate(SIZES):
            t = np.zeros((z, 3))
            g = got[got["kind"] == k]
            t[g["slot"].to_numpy(int)] = g[["sites", "edges", "expected"]].to_numpy()
            tables.append(t)
        if step == 0:
            rho = min(max((tables[1][strong, 1].sum() + 1) / (tables[1][strong, 0].sum() + 1), 0.02), 20.0)
            rho_right = max(rho * (tables[3][:, 1].sum() + 1) / (tables[1][:, 1].sum() + 1), 0.02)
        if step < 2:
            for k, r in enumerate((rho, rho, rho_right, rho_right)):
                tables[k][:, 2] = np.minimum(SLACK * tables[k][:, 1] / r, (1 - DOUBT) * tables[k][:, 0])
        prior = min(max(tables[2][:, 2].sum() / max(tables[2][:, 0].sum(), 1), 0.05), 0.95)
        rate = [((t[:, 2] + 0.1 * prior) / (t[:, 0] + 0.1)).astype(np.float32) for t in tables]
        model = Model(rate, [t[:, 0].astype(np.float32) for t in tables], prior, joint=step >= 2)
    return model


def units(d: Packed, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, start, end) of all sentence units, without outer white space."""
    n_sites = d.blocks["n_sites"].astype(np.int64)
    of = np.repeat(np.arange(len(n_sites)), n_sites)
    hit = np.flatnonzero(model.events(d) >= 0.5)
    in_block = np.bincount(of[hit], minlength=len(n_sites)).astype(np.int64)
    through = np.cumsum(in_block)
    block = np.arange(len(n_sites))
    start, end = np.empty(len(block) + len(hit), np.int64), np.empty(len(block) + len(hit), np.int64)
    start[block + through - in_block] = d.blocks["start"]
    end[block + through] = d.blocks["end"]
    k = of[hit] + np.arange(len(hit))
    end[k] = d.sites["end"][hit]
    start[k + 1] = d.sites["next"][hit]
    return np.repeat(np.repeat(d.ids, d.n_blocks), in_block + 1), start, end


def split(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence unit of every document, in code points.

    Null, empty and blank texts have no units. Repeated document rows give repeated units. A null id reads as 0.
    """
    packs = packed(docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("doc_id"), F.col(text).alias("text")))
    model = docs.sparkSession.sparkContext.broadcast(fit(packs))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data").to_pylist():
                i, s, e = units(Packed.read(data), model.value)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc_id", "start_pos", "end_pos"])

    return packs.mapInArrow(decode, "doc_id long, start_pos int, end_pos int")


def covered(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sound) of every document that is not blank: whether its units are in order, do not overlap, begin and end
    with text, and leave only white space between them, before and after. A document without units is not sound.

    found: from ``split``. Each document meets only its own units. Repeated rows of a document count once.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null and doc_id is not null").dropDuplicates()
    # a document's units are as many as its text has sentences
    per = found.distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos"))).alias("u"))
    j = own.join(per, "doc_id", "left").select("doc_id", "text", F.transform("u", lambda x: x["start_pos"]).alias("a"), F.transform("u", lambda x: x["end_pos"]).alias("b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ok = [], []
            for i, t, a, b in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "a", "b"))):
                if not t.strip():
                    continue
                at, sound = 0, bool(a)
                for s, e in zip(a or [], b or []):
                    part = t[s:e]
                    sound = sound and s >= at and part == part.strip() != "" and not t[at:s].strip()
                    at = e
                ids.append(i)
                ok.append(sound and not t[at:].strip())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ok, pa.bool_())], names=["doc_id", "sound"])

    return j.mapInArrow(check, "doc_id long, sound boolean")
