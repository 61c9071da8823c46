"""Text expressions: tokens, normal forms, similarity, identifiers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The letters of a CJK run, and a run of either kind.
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}"
RUN = rf"[{CJK}]+|[a-z0-9]+"
#: Company forms, lodging words and punctuation that a hotel's name is compared without.
COMPANY_FORMS = r"株式会社|有限会社|（株）|\(株\)|（有）|\(有\)|株式|合同会社|（合）"
LODGING_WORDS = r"(?i)ホテル|hotel|旅館|ryokan|inn|ゲストハウス|guest\s*house|guesthouse|hostel|ホステル|民宿|温泉|リゾート|resort"
NAME_PUNCTUATION = r"[\s\x{3000}・·.,()（）&＆‐\-]"


def tokens(text: Column) -> Column:
    """Search tokens: of a CJK run every letter and every pair of neighbours, of Latin and digits the words of two letters or more. Null gives none."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({RUN})"), 1)
    return F.flatten(F.transform(runs, _run_tokens))


def _run_tokens(run: Column) -> Column:
    letters = F.sequence(F.lit(1), F.length(run))
    grams = F.flatten(F.transform(letters, lambda i: F.when(i < F.length(run), F.array(F.substring(run, i, F.lit(1)), F.substring(run, i, F.lit(2)))).otherwise(F.array(F.substring(run, i, F.lit(1))))))
    word = F.when(F.length(run) >= 2, F.array(run)).otherwise(F.expr("cast(array() as array<string>)"))
    return F.when(run.rlike(rf"^[{CJK}]"), grams).otherwise(word)


def token_count(text: Column) -> Column:
    """The number of :func:`tokens` of a text, without building them: words of two letters or more, and of a CJK run of n letters 2n - 1."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_count(low, F.lit("[a-z0-9]{2,}"))
    letters = F.length(F.regexp_replace(low, f"[^{CJK}]+", ""))
    return words + 2 * letters - F.regexp_count(low, F.lit(f"[{CJK}]+"))


def query_terms(query: str) -> list[str]:
    """The different :func:`tokens` of a query, in order."""
    cjk = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
    terms: dict[str, None] = {}
    for run in re.findall(f"[{cjk}]+|[a-z0-9]+", query.lower()):
        if run[0].isascii():
            terms |= {run: None} if len(run) > 1 else {}
        else:
            for i in range(len(run)):
                terms |= {run[i]: None} | ({run[i : i + 2]: None} if i + 1 < len(run) else {})
    return list(terms)


def term_count(text: Column, term: str) -> Column:
    """How often a token stands in a text: a whole word, or a CJK letter or pair at any place."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if term.isascii():
        # Most texts don't hold the word at all, which a plain search tells sooner.
        return F.when(F.contains(low, F.lit(term)), F.regexp_count(low, F.lit(f"(?<![a-z0-9]){term}(?![a-z0-9])"))).otherwise(0)
    if len(set(term)) < len(term):  # a doubled letter may overlap itself
        return F.regexp_count(low, F.lit(f"(?={term})"))
    return ((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).cast("int")


def name_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance as a share of the longer text; 0 if either is null or empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(F.coalesce((F.length(a) > 0) & (F.length(b) > 0), F.lit(False)), 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(0.0))


def normal_hotel_name(name: Column) -> Column:
    """A hotel's name without company forms, lodging words and punctuation, in lower case; empty for null."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), COMPANY_FORMS, ""), LODGING_WORDS, "")
    return F.trim(F.lower(F.regexp_replace(bare, NAME_PUNCTUATION, "")))


def normal_phone(phone: Column) -> Column:
    """The last ten digits of a phone number; empty for null."""
    return F.right(F.regexp_replace(F.coalesce(phone, F.lit("")), r"[^0-9]", ""), F.lit(10))


def normal_organisation(name: Column) -> Column:
    """An organisation's name without its legal form and white space."""
    return F.regexp_replace(F.regexp_replace(name, r"(?:一般|公益)?(?:社団|財団)法人|特定非営利活動法人|NPO法人|株式会社|有限会社|合同会社", ""), r"[\s\x{3000}]+", "")


def longer(a: Column, b: Column) -> Column:
    """The longer text, the first of equally long ones, either if the other is null."""
    return F.coalesce(F.when(F.length(a) >= F.length(b), a).otherwise(F.when(b.isNotNull(), b).otherwise(a)), b)


def short_sha1(*parts: Column) -> Column:
    """The first 12 hex digits of the SHA-1 of the parts joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def short_sha256(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def content_hash(**fields: Column) -> Column:
    """A fingerprint of named fields: SHA-256 of their JSON in the order of the names, nulls kept, 16 hex digits."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.substring(F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256), 1, 16)


def clean_address(address: Column, most: int = 60) -> Column:
    """An address without postal code, cut at the first line end or bracket, of at most ``most`` letters."""
    bare = F.regexp_replace(address, r"〒?\s*\d{3}-?\d{4}\s*", "")
    return F.substring(F.trim(F.regexp_extract(bare, r"^([^\n（(【]*)", 1)), 1, most)


def page_language(tag: Column) -> Column:
    """The language of an ``html[lang]`` value by its beginning; null if it is none of the usual ones."""
    low = F.lower(tag)
    return F.coalesce(*[F.when(low.startswith(p), F.lit(p)) for p in ("ja", "en", "zh", "ko")])


def passage(prefix: str, most: int, *parts: Column) -> Column:
    """Text for an embedding model: the prefix and the parts, blank ones left out, cut to ``most`` letters."""
    present = [F.when(F.trim(p) != "", F.trim(p)) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.concat_ws(" ", *present), 1, most))


def token_estimate(text: Column) -> Column:
    """A third of the letters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("int")


def slug(text: Column) -> Column:
    """Lower-case words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def strip_municipality(name: Column) -> Column:
    return F.regexp_replace(name, "[市町村区]$", "")


def strip_prefecture(name: Column) -> Column:
    return F.regexp_replace(name, "[都道府県]$", "")


def nfkc(text: Column) -> Column:
    """Unicode's compatibility composition, for which the engine has no function."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(run, T.StringType())(text)


#: Letters of a chunk to aim for, to split beyond, and below which it is dropped.
CHUNK_TARGET, CHUNK_MOST, CHUNK_LEAST = 400, 800, 80


def chunk(text: str, target: int = CHUNK_TARGET, most: int = CHUNK_MOST, least: int = CHUNK_LEAST) -> list[str]:
    """Paragraphs merged up to the target, longer pieces split after a sentence, short ones dropped."""
    merged: list[str] = []
    for paragraph in (p.strip() for p in re.split(r"\n{2,}", re.sub(r"[ \t\r\f\v]+", " ", text))):
        if not paragraph:
            continue
        if merged and len(merged[-1]) + 1 + len(paragraph) <= target:
            merged[-1] += " " + paragraph
        else:
            merged.append(paragraph)
    out: list[str] = []
    for piece in merged:
        rest = piece
        while len(rest) > most:
            window = rest[:most]
            at = max(window.rfind("。"), window.rfind(". "))
            at = most if at < least else at + 1
            out.append(rest[:at].strip())
            rest = rest[at:]
        out.append(rest.strip() if len(piece) > most else rest)
    return [c for c in out if len(c) >= least]


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; none for null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([chunk(t) if isinstance(t, str) else [] for t in texts], index=texts.index, dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(text)


# What stands in for a description, as whole text.
PLACEHOLDERS = ("todo", "tbd", "n/a", "null", "undefined", "placeholder", "準備中", "未定", "翻訳中")


def is_placeholder(text: Column) -> Column:
    """Whether a text is missing, blank or stands in for one."""
    low = F.lower(F.trim(text))
    return F.coalesce((low == "") | low.isin(*PLACEHOLDERS), F.lit(True))


def translation_errors(texts: Column, confidence: Column, required: list[str], allowed: list[str]) -> Column:
    """What is wrong with a record of translations, as a sorted list of messages."""
    missing = F.transform(F.filter(F.array(*[F.lit(x) for x in required]), lambda k: is_placeholder(F.element_at(texts, k))), lambda k: F.concat(F.lit("missing "), k))
    unknown = F.transform(F.filter(F.map_keys(texts), lambda k: ~k.isin(*allowed)), lambda k: F.concat(F.lit("unknown language "), k))
    rating = F.when(~F.coalesce(confidence.isin("high", "medium", "low"), F.lit(True)), F.array(F.lit("bad confidence"))).otherwise(F.expr("cast(array() as array<string>)"))
    empty = F.expr("cast(array() as array<string>)")
    return F.array_sort(F.concat(F.coalesce(missing, empty), F.coalesce(unknown, empty), rating))
