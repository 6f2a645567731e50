"""Evaluation texts inside training text.

A passage counts if 18 consecutive words of an item (36 characters in scripts written without spaces) stand in
a document, at most one of them altered. Windows of that size are fingerprinted by SimHash in two blocks of 32 bits,
one per half of the window: a block is the sign pattern of the summed hash bits of the half's tokens (of the pairs
of neighbouring characters, where characters are the tokens). One altered word moves bits of one block only, up to
all 32 of them, and leaves the other equal; so within that radius every window agrees with its item in at least one
whole block, and a multi-index over blocks finds all of them. A SimHash summed over the whole window gives no such
guarantee: one word of 18 moves six of 64 bits on average and up to eighteen in a few thousand trials.

Candidates are verified by weighted-shingle similarity: the share of an item window's shingles of five words, each
weighted by its rarity among the items, that stand in the document's stretch. A window passes if it keeps what is
left of its weight when its heaviest word is altered, so the bound follows from the definition and loses nothing.
What passes is checked word by word, from the agreeing half outwards.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, CHARS = 18, 36
#: Words of a shingle, and tokens that a document's stretch may be longer on either side.
SHINGLE, MARGIN = 5, 8
#: Items, and characters of items, in one broadcast index; more items are searched in several passes.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 40_000_000
LANES = 32
SLICE = 100_000

_INVISIBLE: dict[int, None] = {}
_TAG_BREAK = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|h[1-6]|table)\b[^<>]{0,200}>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->", re.S)
_WORD = re.compile(r"[^\W_]+")
_DENSE = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿]")


def _invisible() -> dict[int, None]:
    if not _INVISIBLE:
        _INVISIBLE.update({c: None for r in (range(0x3000), range(0xFE00, 0x10000), range(0x1D170, 0x1D180), range(0xE0000, 0xE1000)) for c in r if unicodedata.category(chr(c)) == "Cf" or 0xFE00 <= c <= 0xFE0F or c == 0x34F})
    return _INVISIBLE


@lru_cache(1)
def _signs() -> frozenset[str]:
    return frozenset(map(chr, _invisible()))


def plain(text: str) -> str:
    """The text without markup, invisible characters, letter case and encoding form."""
    if "<" in text:
        text = _TAG.sub("", _TAG_BREAK.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text.lower()
    if not _signs().isdisjoint(text):
        text = text.translate(_invisible())
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def word_tokens(plain_text: str) -> list[str]:
    return _WORD.findall(plain_text)


def char_tokens(plain_text: str) -> list[str]:
    return list("".join(_WORD.findall(plain_text)))


def item_words(plain_text: str) -> list[int]:
    """For each token of ``word_tokens`` the number of the blank-separated word it belongs to."""
    out, k = [], -1
    for chunk in plain_text.split():
        n = len(_WORD.findall(chunk))
        k += n > 0
        out += [k] * n
    return out


class _Hash(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token)
        return h


_HASH = _Hash()


def blocks(tokens: list[str], dense: bool) -> np.ndarray:
    """The SimHash block of every half window of the token sequence, by start position."""
    half = (CHARS if dense else WORDS) // 2
    n = len(tokens)
    if n < half:
        return np.zeros(0, np.uint32)
    h = np.fromiter(map(_HASH.__getitem__, tokens), np.uint64, n)
    if dense:
        h = h[1:] ^ (h[:-1] * np.uint64(0x9E3779B97F4A7C15))
        h ^= h >> np.uint64(29)
        half -= 1
    out = []
    for at in range(0, len(h) - half + 1, SLICE):
        part = h[at : at + SLICE + half - 1].astype(np.uint32)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1)
        total = np.zeros((len(part) + 1, LANES), np.uint16)
        np.cumsum(bits, axis=0, dtype=np.uint16, out=total[1:])
        sums = total[half:] - total[:-half]
        out.append(np.packbits(sums > half // 2, axis=1).view(np.uint32).ravel())
    return np.concatenate(out)


def shingles(tokens: list[str]) -> np.ndarray:
    """A hash of every run of SHINGLE tokens, by start position."""
    n = max(len(tokens) - SHINGLE + 1, 0)
    out = np.zeros(n, np.uint64)
    if n:
        h = np.fromiter(map(_HASH.__getitem__, tokens), np.uint64, len(tokens))
        for k in range(SHINGLE):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return out


class Index:
    """Blocks of all half windows of the items, sorted by value, and the weighted shingles of each item."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids: list[int] = []
        self.tokens: list[list[str]] = []
        self.words: list[list[int]] = []
        self.keys: dict[bool, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[bool, list[tuple[np.ndarray, int]]] = {False: [], True: []}
        for item_id, text in items:
            p = plain(text)
            dense = is_dense(p)
            tokens = char_tokens(p) if dense else word_tokens(p)
            found[dense].append((blocks(tokens, dense), len(self.ids)))
            self.ids.append(item_id)
            self.tokens.append(tokens)
            self.words.append(list(range(len(tokens))) if dense else item_words(p))
        self.shingles = [shingles(t) for t in self.tokens]
        times = Counter(x for s in self.shingles for x in set(s.tolist()))
        #: running sums of the shingles' weights: the rarer among the items, the heavier
        self.weight = [np.r_[0.0, np.cumsum([math.log(1 + len(self.ids) / times[x]) for x in s.tolist()])] for s in self.shingles]
        self.starts = [np.flatnonzero(np.r_[True, np.diff(w) > 0]) if len(w) else np.zeros(0, int) for w in map(np.array, self.words)]
        self._needed: dict[tuple[int, int], float] = {}
        for dense, parts in found.items():
            key = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint32)
            item = np.concatenate([np.full(len(k), i) for k, i in parts]) if parts else np.zeros(0, int)
            pos = np.concatenate([np.arange(len(k)) for k, _ in parts]) if parts else np.zeros(0, int)
            o = np.argsort(key, kind="stable")
            self.keys[dense] = key[o], item[o], pos[o]

    def window(self, it: int, word: int, dense: bool) -> tuple[int, int]:
        """First token and end of the item's window that begins at a word."""
        at, n = self.starts[it], CHARS if dense else WORDS
        return int(at[word]), int(at[word + n]) if word + n < len(at) else len(self.tokens[it])

    def needed(self, it: int, word: int, dense: bool) -> float:
        """The weight that the window keeps if its heaviest word is altered."""
        if (it, word) not in self._needed:
            a, b = self.window(it, word, dense)
            w, n = self.weight[it], CHARS if dense else WORDS
            edges = [*self.starts[it][word : word + n].tolist(), b]
            last = max(b - SHINGLE + 1, a)
            lost = max(w[max(min(e, last), a)] - w[min(max(s - SHINGLE + 1, a), last)] for s, e in zip(edges, edges[1:]))
            self._needed[it, word] = w[last] - w[a] - lost
        return self._needed[it, word]

    def similar(self, it: int, word: int, doc: np.ndarray, at: int, dense: bool) -> bool:
        """Whether the item's window from ``word`` on keeps enough weight in the document's stretch around token ``at``."""
        a, b = self.window(it, word, dense)
        s = self.shingles[it][a : max(b - SHINGLE + 1, a)]
        near = doc[max(at - MARGIN, 0) : at + b - a + MARGIN]
        w = np.diff(self.weight[it][a : a + len(s) + 1])
        return float(w[np.isin(s, near)].sum()) >= self.needed(it, word, dense) - 1e-9

    def candidates(self, doc: list[str], dense: bool) -> Iterator[tuple[int, int, int]]:
        """(item, place in the item, place in the document) of agreeing blocks, along each diagonal in order."""
        key, item, pos = self.keys[dense]
        b = blocks(doc, dense)
        if not len(key) or not len(b):
            return
        lo, hi = np.searchsorted(key, b, "left"), np.searchsorted(key, b, "right")
        at = np.flatnonzero(hi > lo)
        if not len(at):
            return
        times = (hi - lo)[at]
        dp = np.repeat(at, times)
        j = np.repeat(lo[at], times) + np.arange(len(dp)) - np.repeat(np.cumsum(times) - times, times)
        it, ip = item[j], pos[j]
        o = np.lexsort((dp, dp - ip, it))
        it, ip, dp = it[o], ip[o], dp[o]
        yield from zip(it.tolist(), ip.tolist(), dp.tolist())


def is_dense(p: str) -> bool:
    """Whether a plain text is written without spaces between words."""
    return 2 * len(_DENSE.findall(p)) > sum(map(len, _WORD.findall(p)))


def verified(index: Index, it: int, ip: int, dp: int, doc: list[str], shingled: np.ndarray, dense: bool) -> bool:
    """Weighted-shingle similarity of the item's windows that begin, or end, with the stretch around an agreeing half.

    A passage with an altered word lies across one end of the stretch, so one of the two windows holds it.
    """
    item, word = index.tokens[it], index.words[it]
    n = CHARS if dense else WORDS
    a, b, x = ip, ip + n // 2, dp
    if doc[dp : dp + n // 2] == item[ip : ip + n // 2]:
        y = dp + n // 2
        while a and x and item[a - 1] == doc[x - 1]:
            a, x = a - 1, x - 1
        while b < len(item) and y < len(doc) and item[b] == doc[y]:
            b, y = b + 1, y + 1
    last = len(index.starts[it]) - n
    if last < 0:
        return False
    first, end = word[a] + (a > 0 and word[a - 1] == word[a]), word[b - 1] - (b < len(item) and word[b] == word[b - 1])
    for w in {min(max(first, 0), last), min(max(end - n + 1, 0), last)}:
        if index.similar(it, w, shingled, x + index.window(it, w, dense)[0] - a, dense):
            return True
    return False


def words_held(doc: list[str], item: list[str], word: list[int], dp: int, ip: int, half: int) -> tuple[int, int]:
    """The most consecutive words of the item, at most one altered, around an agreeing half window, and the end of
    the stretch that agrees exactly; (0, dp) if the half windows differ, as unequal texts may share a fingerprint.

    The altered word may also be the passage's first or last one.
    """
    if doc[dp : dp + half] != item[ip : ip + half]:
        return 0, dp
    n, m = len(item), len(doc)
    a, x = ip, dp
    while a and x and item[a - 1] == doc[x - 1]:
        a, x = a - 1, x - 1
    b, y = ip + half, dp + half
    while b < n and y < m and item[b] == doc[y]:
        b, y = b + 1, y + 1
    # whole words inside [a, b)
    first = word[a] + (a > 0 and word[a - 1] == word[a])
    last = word[b - 1] - (b < n and word[b] == word[b - 1])
    whole = last - first + 1
    if whole <= 0:
        return 0, y
    best = whole
    # one altered word to the right, then more of the item
    if b < n:
        s = b
        while s > a and word[s - 1] == word[b]:
            s -= 1
        e = b
        while e < n and word[e] == word[b]:
            e += 1
        q = y - (b - s)
        for k in range(1, e - s + 3):
            c, z = e, q + k
            while c < n and z < m and item[c] == doc[z]:
                c, z = c + 1, z + 1
            if c > e:
                right = word[c - 1] - word[e] + 1 - (c < n and word[c] == word[c - 1])
                best = max(best, whole + 1 + right)
        if q < m:
            best = max(best, whole + 1)
    if a > 0:
        e = a
        while e < b and word[e] == word[a - 1]:
            e += 1
        s = a
        while s > 0 and word[s - 1] == word[a - 1]:
            s -= 1
        q = x + (e - a)
        for k in range(1, e - s + 3):
            c, z = s, q - k
            while c > 0 and z > 0 and item[c - 1] == doc[z - 1]:
                c, z = c - 1, z - 1
            if c < s:
                left = word[s - 1] - word[c] + 1 - (c > 0 and word[c - 1] == word[c])
                best = max(best, whole + 1 + left)
        if q > 0:
            best = max(best, whole + 1)
    return best, y


def held_items(text: str, index: Index) -> dict[int, int]:
    """Item id to the most consecutive words (characters) of it that the text holds, where that is enough."""
    p = plain(text)
    out: dict[int, int] = {}
    for dense in (False, True):
        if not len(index.keys[dense][0]) or dense and not _DENSE.search(p):
            continue
        doc = char_tokens(p) if dense else word_tokens(p)
        least = CHARS if dense else WORDS
        shingled = None
        done = (-1, 0, 0)  # item, diagonal, end of the stretch that has been verified
        for it, ip, dp in index.candidates(doc, dense):
            if done[:2] == (it, dp - ip) and dp + least // 2 <= done[2]:
                continue
            shingled = shingles(doc) if shingled is None else shingled
            if not verified(index, it, ip, dp, doc, shingled, dense):
                continue
            n, end = words_held(doc, index.tokens[it], index.words[it], dp, ip, least // 2)
            if n:
                done = (it, dp - ip, end)
            if n >= least and n > out.get(index.ids[it], 0):
                out[index.ids[it]] = n
    return out


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, words) of every document that holds a passage of an item.

    Null and empty texts hold nothing. Items shorter than a window hold nothing. Items are broadcast as an index
    whose size is checked; more than BLOCK_ITEMS items or BLOCK_CHARS characters are searched block by block,
    each block against all documents. Repeated document rows each count, the result has distinct rows.
    """
    spark = docs.sparkSession
    own = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null")
    n, chars = own.agg(F.count("*"), F.sum(F.length("t"))).first()
    parts = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil((chars or 0) / BLOCK_CHARS))
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null and doc_id is not null")
    out = None
    for k in range(parts):
        block = own if parts == 1 else own.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == k)
        index = spark.sparkContext.broadcast(Index([(r.i, r.t) for r in block.collect()]))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(d, i, w) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for i, w in held_items(t, index.value).items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], names=["doc_id", "item_id", "words"])

        found = corpus.mapInArrow(search, "doc_id long, item_id long, words int")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
