"""Held-out test passages inside a training corpus.

Method: Wu-Manber multi-pattern search. The test passages are cut into short
windows; a block shift table lets every text skip the positions where no window
can end, the hash of the last block selects the windows that could, and they
are compared directly. Texts are searched in lockstep as arrays. A text that
holds windows of a passage is then compared with the passage as a whole, and
counts as leaked if it holds a running stretch of at least half of it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of a passage that a running stretch must cover.
LEAST_SHARE = 0.5
#: Characters of a search window, and characters from one window of a passage to the next: for passages
#: in alphabetic and in CJK writing. A stretch of window + step - 1 unedited characters is always found.
WINDOW, STEP = {False: 14, True: 8}, {False: 3, True: 2}
#: Characters of a block of the shift table, and the least bits of its hash; more windows take more.
BLOCK, TABLE_BITS = 3, 18
#: Edits inside a running stretch: characters of the passage left out at one place, characters added at one place.
SMALL_EDIT, INSERTION = 3, 60
#: Replacing as few characters by about as few is an edit too, but a text in which more than one place in so many
#: characters is replaced, besides a first one, is another text of the same wording.
REPLACED_EVERY = 80
#: Before a text is compared with a passage, windows found in running order must span this share of the
#: passage, and be this share of its windows: both far below what half a passage with small edits gives.
SPAN_SHARE, WINDOW_SHARE = 0.3, 0.1
#: Matching pieces shorter than this say nothing.
LEAST_PIECE = 4
#: Passages searched in one pass; more of them take further passes, each with tables of bounded size. The result is the same.
PASSAGES_AT_ONCE = 10_000
#: Texts are searched in lanes of at most this many characters, overlapping by a window.
LANE = 1024

NOT_ALPHANUMERIC = re.compile(r"[\W_]+")
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def normal(text: str) -> str:
    """Letters and digits alone, of one case and width."""
    return NOT_ALPHANUMERIC.sub("", unicodedata.normalize("NFKC", text).casefold())


def is_cjk(text: str) -> bool:
    return len(CJK.findall(text)) * 2 > len(text)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def block_hash(chars: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    """The hash, of so many bits, of the block that ends at each position; positions without a whole block repeat the first."""
    c = chars.astype(np.uint64)
    h = np.zeros(len(c), np.uint64)
    for k in range(BLOCK):
        moved = np.zeros(len(c), np.uint64)
        moved[k:] = c[: len(c) - k]
        h = h * np.uint64(0x100000001B3) + moved
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class WuManber:
    """Search for many windows of one length at once."""

    def __init__(self, windows: list[str], length: int) -> None:
        self.length = length
        self.chars = np.array([codes(w) for w in windows], np.uint32).reshape(len(windows), length)
        # So wide that most blocks of a text are in no window and allow the longest shift.
        self.bits = max(TABLE_BITS, math.ceil(math.log2(max(1, len(windows) * length))) + 2)
        last = block_hash(self.chars.reshape(-1), self.bits).reshape(len(windows), length)
        longest = length - BLOCK + 1
        self.shift = np.full(1 << self.bits, longest, np.int16)
        for j in range(BLOCK - 1, length):  # a block that ends at j allows a shift of what follows it
            np.minimum.at(self.shift, last[:, j], np.int16(length - 1 - j))
        # Suffix buckets: the windows in the order of their last block's hash.
        ends = last[:, length - 1] if len(windows) else np.zeros(0, np.int64)
        self.order = np.argsort(ends, kind="stable")
        count = np.bincount(ends, minlength=1 << self.bits)
        self.begin = np.concatenate([[0], np.cumsum(count)])

    def search(self, chars: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences in the lanes ``chars[begin:end]``: lane, start position and window number."""
        at_block = block_hash(chars, self.bits)
        lanes, starts, windows = [], [], []
        lane = np.flatnonzero(end - begin >= self.length)
        pos = begin[lane] + self.length - 1
        stop = end[lane]
        while len(lane):
            block = at_block[pos]
            shift = self.shift[block].astype(np.int64)
            hit = np.flatnonzero(shift == 0)
            if len(hit):
                low, high = self.begin[block[hit]], self.begin[block[hit] + 1]
                size = high - low
                which = np.repeat(hit, size)
                offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                candidate = self.order[np.repeat(low, size) + offset]
                first = pos[which] - self.length + 1
                same = np.ones(len(which), bool)
                for k in (0, self.length // 2, 1):  # cheap tests before the whole comparison
                    same &= chars[first + k] == self.chars[candidate, k]
                which, first, candidate = which[same], first[same], candidate[same]
                if len(which):
                    equal = (chars[first[:, None] + np.arange(self.length)] == self.chars[candidate]).all(axis=1)
                    lanes.append(lane[which[equal]])
                    starts.append(first[equal])
                    windows.append(candidate[equal])
            pos = pos + np.maximum(shift, 1)
            on = pos < stop
            if not on.all():
                lane, pos, stop = lane[on], pos[on], stop[on]
        if not lanes:
            none = np.zeros(0, np.int64)
            return none, none, none
        return np.concatenate(lanes), np.concatenate(starts), np.concatenate(windows)


@dataclass
class Windows:
    """The windows of one length with the passages, and the places in them, where each stands."""

    searcher: WuManber
    begin: np.ndarray  # of each window, where its owners begin
    passage: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, places: dict[str, list[tuple[int, int]]], length: int) -> Windows:
        owners = [o for at in places.values() for o in at]
        begin = np.concatenate([[0], np.cumsum([len(at) for at in places.values()])]).astype(np.int64)
        table = np.array(owners, np.int64).reshape(len(owners), 2)
        return cls(WuManber(list(places), length), begin, table[:, 0], table[:, 1])

    def hits(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, passage, start in the text and place in the passage of every occurrence in the texts ``chars[offsets[i]:offsets[i + 1]]``."""
        sizes = np.diff(offsets)
        pieces = np.maximum(1, -(-sizes // LANE))
        owner = np.repeat(np.arange(len(sizes)), pieces)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = offsets[owner] + part * LANE
        end = np.minimum(begin + LANE + self.searcher.length - 1, offsets[owner + 1])
        lanes, starts, windows = self.searcher.search(chars, begin, end)
        count = self.begin[windows + 1] - self.begin[windows]
        each = np.repeat(np.arange(len(windows)), count)
        at = np.repeat(self.begin[windows], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        text = owner[lanes][each]
        return text, self.passage[at], starts[each] - offsets[text], self.place[at]


@dataclass
class Passages:
    """Test passages, normalised, with the searchers for their windows."""

    ids: list[object]
    texts: list[str]
    cjk: list[bool]
    windows: list[Windows]
    count: np.ndarray  # windows of each passage
    short: list[Windows]  # passages shorter than a window, whole, by length
    tiny: list[int]  # passages shorter than a block

    @classmethod
    def of(cls, items: list[tuple[object, str | None]]) -> Passages:
        pairs = [(i, normal(t)) for i, t in items if t]
        pairs = [(i, t) for i, t in pairs if t]
        ids, texts = [i for i, _ in pairs], [t for _, t in pairs]
        cjk = [is_cjk(t) for t in texts]
        places: dict[bool, dict[str, list[tuple[int, int]]]] = {False: {}, True: {}}
        short: dict[int, dict[str, list[tuple[int, int]]]] = {}
        tiny = []
        count = np.zeros(len(texts), np.int64)
        for n, (text, kind) in enumerate(zip(texts, cjk, strict=True)):
            length, step = WINDOW[kind], STEP[kind]
            if len(text) < BLOCK:
                tiny.append(n)
            elif len(text) < length:
                short.setdefault(len(text), {}).setdefault(text, []).append((n, 0))
            else:
                starts = sorted({*range(0, len(text) - length, step), len(text) - length})
                count[n] = len(starts)
                for k in starts:
                    places[kind].setdefault(text[k : k + length], []).append((n, k))
        return cls(ids, texts, cjk, [Windows.of(places[k], WINDOW[k]) for k in places if places[k]], count, [Windows.of(p, n) for n, p in short.items()], tiny)

    @cached_property
    def pieces(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each passage the hashes of its shortest pieces, sorted, with their places."""
        out = []
        for t in self.texts:
            h = piece_hash(codes(t))
            order = np.argsort(h, kind="stable")
            out.append((h[order], order))
        return out

    def find(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """Every (text, passage) of which the text holds enough."""
        normals = [normal(t) if t else "" for t in texts]
        joined = codes("".join(normals))
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in normals])]).astype(np.int64)
        found = [(i, n) for n in self.tiny for i, t in enumerate(normals) if self.texts[n] in t]
        for whole in self.short:
            text, passage, _, _ = whole.hits(joined, offsets)
            found += zip(text.tolist(), passage.tolist(), strict=True)
        size = np.array([len(t) for t in self.texts], np.int64)
        for windows in self.windows:
            text, passage, start, place = windows.hits(joined, offsets)
            if not len(text):
                continue
            order = np.lexsort((place, start, passage, text))
            text, passage, start, place = text[order], passage[order], start[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (passage[1:] != passage[:-1])]))
            hits = np.diff(np.append(first, len(text)))
            least = SPAN_SHARE * size[passage[first]] - windows.searcher.length
            widest = np.maximum.reduceat(place, first) - np.minimum.reduceat(place, first)
            for g in np.flatnonzero((hits >= WINDOW_SHARE * self.count[passage[first]]) & (widest >= least)):
                at = slice(first[g], first[g] + hits[g])
                i, n = int(text[first[g]]), int(passage[first[g]])
                if span(start[at].tolist(), place[at].tolist()) >= least[g]:
                    if longest_stretch(joined[offsets[i] : offsets[i + 1]], self.pieces[n], int(size[n]), start[at].tolist()) >= LEAST_SHARE * size[n]:
                        found.append((i, n))
        return sorted(set(found))


def span(starts: list[int], places: list[int]) -> int:
    """The most characters of a passage between two windows of one run: both go on in text and passage, about equally far."""
    best = first = 0
    last: tuple[int, int] | None = None
    for start, place in zip(starts, places, strict=True):
        if last is None or place < last[1] or abs((start - place) - (last[0] - last[1])) > INSERTION:
            first = place
        last = (start, place)
        best = max(best, place - first)
    return best


def piece_hash(chars: np.ndarray) -> np.ndarray:
    """The hash of the piece of ``LEAST_PIECE`` characters that begins at each position."""
    h = np.zeros(max(0, len(chars) - LEAST_PIECE + 1), np.uint64)
    for k in range(LEAST_PIECE):
        h = (h + chars[k : k + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def equal_pieces(text: np.ndarray, pieces: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """All longest equal pieces, ``(place in the passage, place in the text, characters)``, by place in the passage."""
    known, where = pieces
    h = piece_hash(text)
    low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
    count = high - low
    b = np.repeat(np.arange(len(h)), count)
    a = where[np.repeat(low, count) + np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count)]
    order = np.lexsort((a, b - a))
    a, b = a[order], b[order]
    if not len(a):
        return []
    first = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 1) | (np.diff(b) != 1)]))
    size = np.diff(np.append(first, len(a))) + LEAST_PIECE - 1
    return sorted(zip(a[first].tolist(), b[first].tolist(), size.tolist(), strict=True))


def longest_chain(pieces: list[tuple[int, int, int]]) -> int:
    """Characters of the passage from the first to the last of the longest chain of equal pieces with small edits between them."""
    best = 0
    # Of each piece, by its end: the earliest beginnings of chains to it, one for each number of replaced places.
    chains: list[tuple[int, int, dict[int, int]]] = []
    for a, b, size in pieces:
        begins = {0: a}
        chains = [c for c in chains if c[0] >= a - SMALL_EDIT]
        for end_a, end_b, before in chains:
            if end_b < b - INSERTION:
                continue
            over = max(end_a - a, end_b - b, 0)
            lost, added = a + over - end_a, b + over - end_b
            if size - over < LEAST_PIECE or lost > SMALL_EDIT or added > (INSERTION if lost == 0 else 0 if lost < 0 else 2 * SMALL_EDIT):
                continue
            replaced = 1 if lost > 0 and added > 0 else 0
            for k, begin in before.items():
                if begin < begins.get(k + replaced, a + size):
                    begins[k + replaced] = begin
        chains.append((a + size, b + size, begins))
        best = max([best] + [a + size - begin for k, begin in begins.items() if k <= 1 + (a + size - begin) // REPLACED_EVERY])
    return best


def longest_stretch(text: np.ndarray, pieces: tuple[np.ndarray, np.ndarray], size: int, places: list[int]) -> int:
    """Characters of a passage of ``size``, with such ``pieces``, from the first to the last of its longest running stretch in the text around ``places``."""
    reach = size + 4 * INSERTION
    # Places far apart are looked at by themselves, so that the work stays linear in the text.
    spans: list[list[int]] = []
    for p in sorted(places):
        if spans and p - reach <= spans[-1][1]:
            spans[-1][1] = p + reach
        else:
            spans.append([max(0, p - reach), p + reach])
    return max((longest_chain(equal_pieces(text[low:high], pieces)) for low, high in spans), default=0)


@lru_cache(maxsize=4)
def _passages(shared: Broadcast) -> Passages:
    """The tables of a block of passages, built once in each worker process."""
    return Passages.of(shared.value)


def find_leaks(corpus: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_key, item_key)`` of every corpus text that holds a test passage, or a running stretch of half of it, once.

    Case, width, spacing, punctuation and line marks do not matter. Null and
    empty texts hold nothing and are held by nothing; passages without letters
    or digits are left out; texts are searched whole, of any length; repeated
    rows count once; further columns do not matter.

    The passages are the small, fixed side: they are taken in blocks of
    ``PASSAGES_AT_ONCE``, each a broadcast of bounded size and one pass over
    the corpus; what a text holds of a passage does not depend on the other
    passages. No shuffle but the final distinct.
    """
    spark = corpus.sparkSession
    item_type = passages.schema[item_key].dataType
    rows = passages.select(F.col(f"`{item_key}`").alias("i"), F.col(f"`{item_text}`").alias("t")).filter("i is not null and t is not null").distinct().orderBy("i", "t")
    blocks: list[list[tuple[object, str]]] = [[]]
    for row in rows.toLocalIterator():
        if len(blocks[-1]) >= PASSAGES_AT_ONCE:
            blocks.append([])
        blocks[-1].append((row["i"], row["t"]))
    texts = corpus.select(F.col(f"`{key}`").alias("doc_key"), F.col(f"`{text}`").cast("string").alias("t")).filter("t is not null and t <> ''")
    schema = T.StructType([T.StructField("doc_key", texts.schema["doc_key"].dataType), T.StructField("item_key", item_type)])
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known = _passages(shared)
            for batch in batches:
                pairs = known.find(batch["t"].tolist())
                keys = batch["doc_key"].to_numpy()
                yield pd.DataFrame({"doc_key": [keys[i] for i, _ in pairs], "item_key": [known.ids[n] for _, n in pairs]})

        found = texts.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.distinct()
