"""Language of texts and of the segments of mixed ones, with a confidence.

Method: a unigram model over the pieces of a fixed public byte-level vocabulary
for each language. A text's probability is the sum over all its segmentations
into pieces (forward algorithm), so no single tokenisation is trusted; the
piece probabilities come from expected counts over all segmentations
(forward-backward) of a bounded, labelled sample.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The languages that are told apart.
LANGUAGES = ("ja", "en", "zh", "ko", "fr", "de", "es", "it", "pt")
#: Where the public vocabularies lie on every machine of the cluster, and the one taken.
DEFAULT_TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A piece of bytes is known by its polynomial hash with this base, modulo the machine word.
HASH_BASE = 0x9E3779B97F4A7C15
#: Bound of the sample the model is fitted on, per language and table.
SAMPLE_PER_LANGUAGE = 120
#: Rounds of expected counts, and the count every piece has beforehand.
ROUNDS, SMOOTHING = 2, 0.02
#: Bytes (rows times length) scored together; bounds memory, not the result.
BYTES_AT_ONCE = 1 << 18
#: A text's evidence counts as that of this many bytes at most when a confidence is given.
EVIDENCE_BYTES = 60.0


def piece_hash(piece: bytes) -> int:
    out = 0
    for k, byte in enumerate(reversed(piece)):
        out += (byte + 1) * pow(HASH_BASE, k, 1 << 64)
    return out % (1 << 64)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all pieces of a vocabulary file, and their lengths. No two pieces of one length may share a hash."""
    with open(path, "rb") as file:
        pieces = [base64.b64decode(line.split()[0]) for line in file if line.strip()]
    hashes, lengths = np.array([piece_hash(p) for p in pieces], np.uint64), np.array([len(p) for p in pieces])
    if len(set(zip(hashes.tolist(), lengths.tolist(), strict=True))) < len(set(pieces)):
        raise ValueError(f"pieces of {path} share a hash")
    return hashes, lengths


@dataclass
class Pieces:
    """Pieces of each length, sorted by hash, with their rows in the table of probabilities."""

    words: list[np.ndarray]
    rows: list[np.ndarray]

    @classmethod
    def of(cls, words: np.ndarray, lengths: np.ndarray) -> Pieces:
        by_word, by_row = [], []
        for n in range(1, int(lengths.max(initial=0)) + 1):
            at = np.flatnonzero(lengths == n)
            at = at[np.argsort(words[at])]
            by_word.append(words[at])
            by_row.append(at.astype(np.int32))
        return cls(by_word, by_row)

    def find(self, text: np.ndarray) -> list[np.ndarray]:
        """For each length, the row of the piece that ends at each byte of ``text``, or -1."""
        out = []
        word = np.zeros(len(text), np.uint64)
        power = np.uint64(1)
        for n, (known, rows) in enumerate(zip(self.words, self.rows, strict=True), 1):
            ids = np.full(len(text), -1, np.int32)
            out.append(ids)
            if n > len(text):
                continue
            # The hash of the n bytes that end here: one more byte in front.
            word[n - 1 :] += (text[: len(text) - n + 1] + np.uint64(1)) * power
            with np.errstate(over="ignore"):
                power = power * np.uint64(HASH_BASE)
            if len(known):
                here = word[n - 1 :]
                at = np.minimum(np.searchsorted(known, here), len(known) - 1)
                hit = known[at] == here
                ids[n - 1 :][hit] = rows[at[hit]]
        return out


#: The vocabulary's pieces never reach over the edges of these words, so a text's probability is the product of its words'.
WORDS = re.compile(r" ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+")
#: Words are cut at so many letters when the model is fitted, not when a text is scored.
FIT_LETTERS = 24


@dataclass
class LanguageModel:
    """Piece probabilities of each language."""

    languages: tuple[str, ...]
    pieces: Pieces
    p: np.ndarray  # (pieces + 1, languages); the last row is zero, for no piece

    def layout(self, words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Words as a padded matrix: their lengths, and for each piece length the piece rows that end at each cell."""
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        within = np.arange(len(flat)) - np.repeat(start, lengths)
        cell = np.repeat(np.arange(len(words)), lengths) * width + within
        none = len(self.p) - 1
        out = []
        for n, ids in enumerate(self.pieces.find(flat), 1):
            grid = np.full(len(words) * width, none, np.int32)
            ok = (ids >= 0) & (within >= n - 1)
            grid[cell[ok]] = ids[ok]
            out.append(grid.reshape(len(words), width))
        return lengths, out

    def buckets(self, words: list[bytes]) -> Iterator[list[int]]:
        """The numbers of the words in groups of like length and bounded size."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        begin = 0
        while begin < len(order):
            longest = len(words[order[begin]]) * 5 // 4 + 2
            end = begin + 1
            while end < len(order) and len(words[order[end]]) <= longest and (end - begin + 1) * len(words[order[end]]) <= BYTES_AT_ONCE:
                end += 1
            yield order[begin:end]
            begin = end

    def score_words(self, words: list[bytes]) -> np.ndarray:
        """Log-probability of each word in each language: the forward algorithm over all segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        for at in self.buckets(words):
            out[at] = self.likelihood(*self.layout([words[i] for i in at]))
        return out

    def likelihood(self, lengths: np.ndarray, grids: list[np.ndarray]) -> np.ndarray:
        """Forward values in a ring of the reach of one piece; their scale is taken out once a turn."""
        rows, width = grids[0].shape
        reach, none = len(grids), len(self.p) - 1
        some = np.array([(g != none).any(axis=0) for g in grids])  # whether a piece of a length ends at a cell of any row
        ring = np.zeros((reach, rows, len(self.languages)))
        ring[0] = 1.0
        log_scale = np.zeros(rows)
        out = np.zeros((rows, len(self.languages)))
        for i in range(1, width + 1):
            now = np.zeros((rows, len(self.languages)))
            for n in np.flatnonzero(some[: min(reach, i), i - 1]) + 1:
                ids = grids[n - 1][:, i - 1]
                at = np.flatnonzero(ids != none)
                if len(at) * 2 > rows:
                    now += ring[(i - n) % reach] * self.p[ids]
                elif len(at):
                    now[at] += ring[(i - n) % reach][at] * self.p[ids[at]]
            ring[i % reach] = now
            over = lengths == i
            if over.any():
                out[over] = np.log(np.maximum(now[over], 1e-300)) + log_scale[over][:, None]
            if i % 8 == 0:
                top = now.max(axis=1)
                top[(top <= 0) | (lengths <= i)] = 1.0
                ring /= top[None, :, None]
                log_scale += np.log(top)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-probability of each text in each language, the sum over its words; zeros for an empty one.
        Each different word of the texts is scored once."""
        number: dict[str, int] = {}
        spelled = [[number.setdefault(w, len(number)) for w in WORDS.findall(t)] for t in texts]
        known = self.score_words([w.encode("utf-8") for w in number]) if number else np.zeros((0, len(self.languages)))
        out = np.zeros((len(texts), len(self.languages)))
        for i, row in enumerate(spelled):
            if row:
                out[i] = known[row].sum(axis=0)
        return out

    def segments(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """The stretches ``(begin, end, language, confidence)`` of each text, in characters, that are each in one language.

        The likeliest path over the text's words, by dynamic programming, where a change of language costs ``SWITCH``.
        A text in one language is one stretch, one without a letter none."""
        number: dict[str, int] = {}
        spelled = [[(m.start(), m.end(), number.setdefault(m[0], len(number))) for m in WORDS.finditer(t)] for t in texts]
        known = self.score_words([w.encode("utf-8") for w in number]) if number else np.zeros((0, len(self.languages)))
        # What has no letter fits every language alike.
        known[[i for w, i in number.items() if not LETTER.search(w)]] = 0.0
        out = []
        for text, words in zip(texts, spelled, strict=True):
            if not LETTER.search(text) or foreign(text):
                out.append([])
                continue
            here = known[[n for _, _, n in words]]
            back = np.zeros(here.shape, np.int64)
            total = here[0].copy()
            for i in range(1, len(here)):
                best = int(total.argmax())
                back[i] = np.where(total >= total[best] - SWITCH, np.arange(len(total)), best)
                total = np.maximum(total, total[best] - SWITCH) + here[i]
            path = [int(total.argmax())]
            for i in range(len(here) - 1, 0, -1):
                path.append(int(back[i][path[-1]]))
            path.reverse()
            edges = [0, *[i for i in range(1, len(path)) if path[i] != path[i - 1]], len(path)]
            found = []
            for a, b in zip(edges, edges[1:], strict=False):
                begin, end = words[a][0], words[b - 1][1]
                score = here[a:b].sum(axis=0) * min(1.0, EVIDENCE_BYTES / max(1, len(text[begin:end].encode("utf-8"))))
                e = np.exp(score - score.max())
                found.append((begin, end, self.languages[path[a]], round(float(e[path[a]] / e.sum()), 6)))
            out.append(found)
        return out

    def label(self, texts: list[str]) -> tuple[list[str | None], list[float]]:
        """The language of each text and a confidence in it; None and 0 where there is no letter, or most are of a script of no known language."""
        scores = self.score(texts)
        sizes = np.array([len(t.encode("utf-8")) for t in texts]) if texts else np.zeros(0)
        # The evidence of long texts is damped: neighbouring words aren't independent.
        damped = scores * np.minimum(1.0, EVIDENCE_BYTES / np.maximum(1, sizes))[:, None]
        best = scores.argmax(axis=1) if len(texts) else []
        e = np.exp(damped - damped.max(axis=1, keepdims=True)) if len(texts) else damped
        sure = np.round(e.max(axis=1) / e.sum(axis=1), 6) if len(texts) else []
        lettered = [LETTER.search(t) is not None and not foreign(t) for t in texts]
        return [self.languages[k] if ok else None for k, ok in zip(best, lettered, strict=True)], [float(c) if ok else 0.0 for c, ok in zip(sure, lettered, strict=True)]


#: The log-odds that a change of language inside a text has to make up for.
SWITCH = 12.0
LETTER = re.compile(r"[^\W\d_]")
#: Letters of the scripts that the languages are written in.
KNOWN_LETTER = regex.compile(r"[\p{Latin}\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー]")


def foreign(text: str) -> bool:
    """Whether most letters of a text are of a script that none of the languages is written in."""
    if text.isascii():
        return False
    return len(LETTER.findall(text)) > 2 * len(KNOWN_LETTER.findall(text))


def fit(samples: dict[str, list[str]], vocabulary_path: str = f"{DEFAULT_TOKENIZERS}/{VOCABULARY}") -> LanguageModel:
    """A model from labelled texts. Starts with pieces equally likely by length and re-estimates them from expected counts."""
    pieces_, lengths = vocabulary(vocabulary_path)
    languages = tuple(name for name in LANGUAGES if samples.get(name))
    if not languages:
        raise ValueError("no labelled text of any known language to fit on")
    counted: dict[str, np.ndarray] = {}
    for k, name in enumerate(languages):
        for text in samples[name]:
            for word in WORDS.findall(text):
                for i in range(0, len(word), FIT_LETTERS):
                    counted.setdefault(word[i : i + FIT_LETTERS], np.zeros(len(languages)))[k] += 1
    words, weights = [w.encode("utf-8") for w in counted], np.array(list(counted.values()))
    # Only pieces that occur in the sample are kept, and all single bytes.
    occurs = np.zeros(len(pieces_), bool)
    occurs[lengths == 1] = True
    every = Pieces.of(pieces_, lengths)
    for ids in every.find(np.frombuffer(b"\n".join(words), np.uint8).astype(np.uint64)):
        occurs[ids[ids >= 0]] = True
    pieces_, lengths = pieces_[occurs], lengths[occurs]
    start = np.power(0.35, lengths - 1.0)
    model = LanguageModel(languages, Pieces.of(pieces_, lengths), np.vstack([np.repeat((start / start.sum())[:, None], len(languages), axis=1), np.zeros((1, len(languages)))]))
    for _ in range(ROUNDS):
        counts = expected_counts(model, words, weights) + SMOOTHING
        counts[-1] = 0.0
        model = LanguageModel(languages, model.pieces, counts / counts.sum(axis=0))
    return model


def expected_counts(model: LanguageModel, words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Expected occurrences of each piece in each language, over all segmentations of words that occur so often in each."""
    counts = np.zeros_like(model.p)
    for at in model.buckets(words):
        lengths, grids = model.layout([words[i] for i in at])
        rows, width = grids[0].shape
        forward = np.zeros((width + 1, rows, len(model.languages)))
        forward[0] = 1.0
        for i in range(1, width + 1):
            for n in range(1, min(len(grids), i) + 1):
                forward[i] += forward[i - n] * model.p[grids[n - 1][:, i - 1]]
        total = forward[lengths, np.arange(rows)]
        share = weights[at] / np.maximum(total, 1e-300)
        backward = np.zeros((width + 1, rows, len(model.languages)))
        backward[lengths, np.arange(rows)] = 1.0
        for i in range(width, 0, -1):
            for n in range(1, min(len(grids), i) + 1):
                ids = grids[n - 1][:, i - 1]
                if (ids == len(model.p) - 1).all():
                    continue
                through = model.p[ids] * backward[i]
                np.add.at(counts, ids, forward[i - n] * through * share)
                backward[i - n] += through
    return counts


def code_of(label: Column) -> Column:
    """The language that a label names, whatever its case, region or script; null if it names none.
    Three-letter codes and English or own names of the languages count as naming them."""
    base = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+|\P{ASCII}+)", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair]), base)


# What names each language.
NAMED = {code: code for code in LANGUAGES} | dict(
    jpn="ja", japanese="ja", 日本語="ja", eng="en", english="en", zho="zh", chi="zh", cmn="zh", chinese="zh", 中文="zh", kor="ko", korean="ko", 한국어="ko",
    fra="fr", fre="fr", french="fr", français="fr", deu="de", ger="de", german="de", deutsch="de", spa="es", spanish="es", español="es", ita="it", italian="it", italiano="it", por="pt", portuguese="pt", português="pt",
)


def labelled_sample(rows: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> dict[str, list[str]]:
    """At most ``per_language`` texts of each language from ``(lang, text)``: those whose hash is smallest,
    the same at every run. Bounded by ``len(LANGUAGES) * per_language`` texts, which go to the driver."""
    keyed = rows.filter(F.col("lang").isin(*LANGUAGES) & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy("h", "text")
    top = keyed.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_language).select("lang", "text")
    out: dict[str, list[str]] = {}
    for row in top.collect():
        out.setdefault(row["lang"], []).append(row["text"])
    return {name: sorted(texts) for name, texts in out.items()}


def label_texts(df: DataFrame, text: str, model: LanguageModel) -> DataFrame:
    """``df`` with ``language`` and ``language_confidence`` of ``text``.

    Null where the text is null, empty or without a letter. Texts are scored
    whole, of any length; rows are kept as they are. Narrow; the model, bounded
    by its vocabulary, is broadcast once.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        names, confidence = shared.value.label(texts.fillna("").tolist())
        return pd.DataFrame({"language": names, "confidence": [c if n else None for n, c in zip(names, confidence, strict=True)]})

    schema = T.StructType([T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType())])
    # Not moved below a filter on its result, which would run it once more.
    out = F.pandas_udf(run, schema).asNondeterministic()(F.col(f"`{text}`").cast("string"))
    helper = "_" + "_".join(df.columns)  # longer than any of the names, so none of them
    return df.withColumn(helper, out).withColumns({"language": F.col(f"`{helper}`.language"), "language_confidence": F.col(f"`{helper}`.confidence")}).drop(helper)


def label_segments(df: DataFrame, text: str, model: LanguageModel) -> DataFrame:
    """``df`` with ``language_segments``, an array of ``(begin, end, language, confidence)``: the stretches of ``text``,
    in characters, that are each in one language.

    Empty where the text is null, empty, without a letter, or mostly in a script
    of no known language. Texts are taken whole, of any length; rows are kept.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.Series:
        found = shared.value.segments(texts.fillna("").tolist())
        return pd.Series([[dict(zip(("begin", "end", "language", "confidence"), s, strict=True)) for s in one] for one in found], index=texts.index, dtype=object)

    stretch = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType())])
    return df.withColumn("language_segments", F.pandas_udf(run, T.ArrayType(stretch))(F.col(f"`{text}`").cast("string")))


SEGMENTS = T.StructType(
    [
        T.StructField("language", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("segments", T.ArrayType(T.StructType([T.StructField("number", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType())]))),
    ]
)


def label_pages(description: Column, paragraphs: Column, spark: SparkSession, model: LanguageModel) -> Column:
    """Of each page, the language of most of its main text (by UTF-8 bytes) and the segments in another one.

    Furniture of the website is left out first. Null where a page has no main text.
    """
    from meguri.llm.boilerplate import judged_slots

    shared = spark.sparkContext.broadcast(model)

    def run(pages: pd.DataFrame) -> pd.DataFrame:
        texts: list[str] = []
        owner: list[tuple[int, int]] = []
        for i, (d, ps) in enumerate(zip(pages["d"], pages["p"], strict=True)):
            for slot, bad in judged_slots(d, ps).items():
                if not bad:
                    texts.append(d if slot == "description" else ps[int(slot)])
                    owner.append((i, -1 if slot == "description" else int(slot)))
        names, confidence = shared.value.label(texts)
        pagewise: list[list[tuple[int, str, float, int]]] = [[] for _ in range(len(pages))]
        for (i, number), name, c, text in zip(owner, names, confidence, texts, strict=True):
            if name:
                pagewise[i].append((number, name, c, len(text.encode("utf-8"))))
        out = []
        for elements in pagewise:
            weight: dict[str, float] = {}
            sure: dict[str, float] = {}
            for _, name, c, size in elements:
                weight[name] = weight.get(name, 0) + size
                sure[name] = sure.get(name, 0) + c * size
            best = min(weight, key=lambda k: (-weight[k], k)) if weight else None
            other = [{"number": number, "language": name, "confidence": c} for number, name, c, _ in elements if number >= 0 and name != best]
            out.append((best, round(sure[best] / weight[best], 6) if best else None, other))
        return pd.DataFrame(out, columns=["language", "confidence", "segments"])

    # Not moved below a filter on its result, which would run it once more.
    return F.pandas_udf(run, SEGMENTS).asNondeterministic()(F.struct(description.cast("string").alias("d"), paragraphs.cast("array<string>").alias("p")))


def wrong_page_labels(pages: DataFrame, key: str, label: str, description: str, paragraphs: str, model: LanguageModel) -> DataFrame:
    """``(record_key, slot, lang, confidence)``: slot ``language`` where a page's label is missing, names no language
    or the wrong one; a paragraph's number where its language is not the page's. Repeated pages count once; pages
    without main text, and null or blank paragraphs, are no case."""
    rows = pages.select(F.col(f"`{key}`").cast("string").alias("record_key"), code_of(F.col(f"`{label}`")).alias("named"), label_pages(F.col(f"`{description}`"), F.col(f"`{paragraphs}`"), pages.sparkSession, model).alias("page"))
    rows = rows.filter("page.language is not null")
    cases = F.concat(
        F.when(F.coalesce(F.col("named") != F.col("page.language"), F.lit(True)), F.array(F.struct(F.lit("language").alias("slot"), F.col("page.language").alias("lang"), F.col("page.confidence").alias("confidence")))).otherwise(F.expr("cast(array() as array<struct<slot:string,lang:string,confidence:double>>)")),
        F.transform("page.segments", lambda s: F.struct(s["number"].cast("string").alias("slot"), s["language"].alias("lang"), s["confidence"].alias("confidence"))),
    )
    return rows.select("record_key", F.explode(cases).alias("c")).select("record_key", "c.slot", "c.lang", "c.confidence").distinct()


def wrong_map_keys(rows: DataFrame, key: str, texts: str, model: LanguageModel) -> DataFrame:
    """``(record_key, slot, lang, confidence)`` of each text of a map from language to text that is in another language
    than its key names, or whose key names none. Null maps and null or blank texts are no case."""
    long = rows.select(F.col(f"`{key}`").cast("string").alias("record_key"), F.explode(F.map_entries(F.col(f"`{texts}`"))).alias("e")).select("record_key", F.col("e.key").alias("slot"), F.col("e.value").alias("text")).filter(F.col("text").rlike(r"\S"))
    labelled = label_texts(long, "text", model).filter("language is not null")
    return labelled.filter(F.coalesce(code_of(F.col("slot")) != F.col("language"), F.lit(True))).select("record_key", "slot", F.col("language").alias("lang"), F.col("language_confidence").alias("confidence")).distinct()
