"""Byte-level BPE encoding of a text column with a public tokenizer.

Method: texts are split into words by the tokenizer's published pattern, the
distinct words of a batch are sorted into length buckets and laid out as padded
NumPy matrices; in every round each row merges its leftmost minimum-rank pair,
found through a hashed pair table, and is compacted by one cell. Only the two
pairs beside a merge are looked up again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public tokenizers lie on every machine of the cluster.
DEFAULT_TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the published word pattern of this byte-level BPE family.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rank of a pair that never merges.
NEVER = np.int32(2**31 - 1)
#: Cells (rows times width) of one padded matrix; bounds a worker's memory.
MATRIX_CELLS = 1 << 20
#: Texts encoded together; bounds a worker's memory, not the result.
CHARS_AT_ONCE = 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, by rule:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Open-addressing hash table from a pair of ids to (rank, merged id), probed by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        size = 1
        while size < 4 * max(len(left), 1):
            size *= 2
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.rank = np.full(size, NEVER, np.int32)
        self.merged = np.zeros(size, np.int32)
        keys = self.key(left, right)
        slots = self.slot(keys)
        todo = np.arange(len(keys))
        while len(todo):  # all open keys try their slot; one per slot wins, the others move on
            at = slots[todo]
            free = self.keys[at] == np.uint64(2**64 - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            won = free & first
            self.keys[at[won]] = keys[todo[won]]
            self.rank[at[won]] = todo[won]
            self.merged[at[won]] = merged[todo[won]]
            todo = todo[~won]
            taken = self.keys[slots[todo]] != keys[todo]
            todo = todo[taken]  # a repeated pair keeps its first rank
            slots[todo] = (slots[todo] + np.uint64(1)) & self.mask

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, or -1."""
        keys = self.key(left, right)
        slots = self.slot(keys)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            seen = self.keys[slots[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = slots[todo[hit]]
            todo = todo[~hit & (seen != np.uint64(2**64 - 1))]
            slots[todo] = (slots[todo] + np.uint64(1)) & self.mask
        return out


class BytePairEncoder:
    """A byte-level BPE read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.byte_id = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.byte_id[byte] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        as_array = lambda xs: np.array(xs, np.int64)
        self.table = PairTable(as_array([vocab[a] for a, _ in pairs]), as_array([vocab[b] for _, b in pairs]), as_array([vocab[a + b] for a, b in pairs]).astype(np.int32))
        self.words = regex.compile(WORD_PATTERN)
        self.cells = MATRIX_CELLS

    def merge(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of a padded matrix until none holds a known pair; returns both, changed."""
        rows, width = ids.shape
        rank = np.full((rows, width), NEVER, np.int32)
        pair = np.arange(width - 1)[None, :] < (lengths - 1)[:, None]
        r, c = np.nonzero(pair)
        rank[r, c] = self.ranks(ids[r, c], ids[r, c + 1])
        live = np.arange(rows)
        done_ids, done_lengths = np.zeros_like(ids), lengths.copy()
        while len(live):
            at = rank.argmin(axis=1)  # the leftmost of equal minima
            here = np.arange(len(live))
            best = rank[here, at]
            over = best == NEVER
            if over.any():
                done_ids[live[over], : ids.shape[1]] = ids[over]
                keep = ~over
                live, ids, rank, lengths, at, best = live[keep], ids[keep], rank[keep], lengths[keep], at[keep], best[keep]
                if not len(live):
                    break
                here = np.arange(len(live))
            slots = self.table.find(ids[here, at], ids[here, at + 1])
            ids[here, at] = self.table.merged[slots]
            cells = ids.shape[1]  # compaction: what stands right of the merge moves one cell left
            source = np.arange(cells - 1)[None, :]
            source = source + (source > at[:, None])
            ids = np.take_along_axis(ids, source, axis=1)
            rank = np.take_along_axis(rank, source, axis=1)
            lengths = lengths - 1
            done_lengths[live] = lengths
            before = np.nonzero(at > 0)[0]
            rank[before, at[before] - 1] = self.ranks(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.nonzero(at + 1 < lengths)[0]
            rank[here, np.minimum(at, ids.shape[1] - 1)] = NEVER
            rank[after, at[after]] = self.ranks(ids[after, at[after]], ids[after, at[after] + 1])
            if ids.shape[1] > 1 and lengths.max() < ids.shape[1]:
                ids, rank = ids[:, : lengths.max()], rank[:, : lengths.max()]
        return done_ids, done_lengths

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slots = self.table.find(left, right)
        return np.where(slots < 0, NEVER, self.table.rank[slots])

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        if not words:
            return out
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        begin = 0
        while begin < len(order):
            longest = int(lengths[order[begin]])
            end = begin + 1
            # A bucket takes words up to a quarter longer than its first, as far as its cells reach.
            limit = max(longest + 1, longest * 5 // 4)
            end = begin + int(np.searchsorted(lengths[order[begin:]], limit, side="right"))
            end = min(end, begin + max(1, self.cells // max(1, limit)))
            at = order[begin:end]
            width = int(lengths[at].max())
            flat = np.frombuffer(b"".join(words[i] for i in at), np.uint8)
            mask = np.arange(width)[None, :] < lengths[at][:, None]
            ids = np.zeros((len(at), width), np.int32)
            ids[mask] = self.byte_id[flat]
            if width > 1:
                merged, left = self.merge(ids, lengths[at].copy())
            else:
                merged, left = ids, lengths[at]
            for row, i in enumerate(at):
                out[i] = merged[row, : left[row]]
            begin = end
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; the empty list for an empty or missing one."""
        number: dict[str, int] = {}
        spelled: list[list[int]] = []
        for text in texts:
            spelled.append([number.setdefault(w, len(number)) for w in self.words.findall(text)] if text else [])
        ids = self.encode_words([w.encode("utf-8") for w in number])
        none = np.zeros(0, np.int32)
        return [np.concatenate([ids[k] for k in row]) if row else none for row in spelled]


@lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder(path)


def encode_ids(df: DataFrame, text_column: str = "text", ids_column: str = "ids", tokenizer: str = "byte_bpe_50k", tokenizers: str = DEFAULT_TOKENIZERS) -> DataFrame:
    """``df`` with ``ids_column``: the token ids of ``text_column``, without special tokens.

    Narrow: no shuffle, nothing sent to or from the driver; the vocabulary is
    read once per worker from ``tokenizers`` (a path that all machines have).
    Null and empty texts give the empty list. Very long texts are encoded whole.
    Rows are kept as they are, repeated ones included; an existing column of the
    name ``ids_column`` is replaced.
    """
    path = f"{tokenizers}/{tokenizer}.json"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(path)
        for texts in batches:
            out: list[np.ndarray] = []
            chunk: list[str | None] = []
            chars = 0
            for text in texts:
                chunk.append(text)
                chars += len(text) if text else 0
                if chars >= CHARS_AT_ONCE:
                    out += bpe.encode(chunk)
                    chunk, chars = [], 0
            out += bpe.encode(chunk)
            yield pd.Series(out, index=texts.index)

    ids = F.pandas_udf(run, T.ArrayType(T.IntegerType()))
    return df.withColumn(ids_column, ids(F.col(f"`{text_column}`").cast("string")))
