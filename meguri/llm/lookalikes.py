"""One consistent spelling for text that looks the same but differs in its characters.

Method (after Unicode Technical Standard 39): every character carries the set
of scripts it may belong to, Han and kana widened by the writing systems that
use them together. The sets are intersected over each token; an empty
intersection is a mixed-script token, a token wholly of another script whose
letters all have a Latin double is a whole-script confusable. The spelling in
the one script that the whole token can be written in is selected, and the
forms that carry no script (invisible characters, spaces, hyphens, widths,
compatibility and decomposed forms) are normalised.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What stands in for what.
#: Letters of the Greek, Cyrillic and Armenian scripts with the look of a Latin one.
LATIN_DOUBLES = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺοϲϳνι" "АВЕЅІЈКМНОРСТУХҮаеѕіјорсухһԁԛԝү" "ՕՏՍօոսց",
        "ABEZHIKMNOPTYXCMocjvi" "ABESIJKMHOPCTYXYaesijopcyxhdqwy" "OSUonug",
        strict=True,
    )
)
#: Kanji with the look of a katakana letter.
KATAKANA_OF_KANJI = dict(zip("口力夕二卜工八千三一才乇厶", "ロカタニトエハチミーオモム", strict=True))
KANJI_OF_KATAKANA = {v: k for k, v in KATAKANA_OF_KANJI.items() if v not in "ーオ"}
#: Hiragana with the look of a katakana letter.
KATAKANA_OF_HIRAGANA = dict(zip("へべぺり", "ヘベペリ", strict=True))
HIRAGANA_OF_KATAKANA = {v: k for k, v in KATAKANA_OF_HIRAGANA.items()}
#: Radical signs with the look of an ordinary kanji that have no compatibility mapping.
KANJI_OF_RADICAL = dict(zip("⺟⺠⻁⻄⻆⻑⻘⻝⻤⻨⻩⻫⻭⻯⻲", "母民虎西角長青食鬼麦黄斉歯竜亀", strict=True))
#: Strokes that stand in for the prolonged sound mark inside katakana.
BARS = "-‐‑‒–—―−－一ｰ─━"
#: Hyphens other than the ASCII one.
HYPHENS = "‐‑‒–—―−⁃﹘﹣－"
#: Counters after which a katakana letter is written between a number and a noun.
COUNTER_KANA = "ノケヶカヵツッガヂ"
#: Marks with the look of an ASCII or kana one.
OTHER_DOUBLES = {"ʼ": "'", "ʹ": "'", "‘": "'", "’": "'", "“": '"', "”": '"', "∙": "・", "•": "・", "･": "・", "゛": "゙", "゜": "゚", "ㇼ": "リ"}

IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}|\p{Cf}|\p{Cc}(?<![\t\n\r\f\v])")
#: Joiners and the emoji selector, and around what they are part of the spelling.
JOINERS = "\u200c\u200d\ufe0f"
JOINED_SCRIPTS = regex.compile(r"[\p{Script=Arabic}\p{Script=Syriac}\p{Script=Mongolian}\p{Script=Devanagari}\p{Script=Bengali}\p{Script=Gurmukhi}\p{Script=Gujarati}\p{Script=Oriya}\p{Script=Tamil}\p{Script=Telugu}\p{Script=Kannada}\p{Script=Malayalam}\p{Script=Sinhala}\p{Script=Khmer}\p{M}]")
EMOJI = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\ufe0f]")
SPACES = regex.compile(r"[\p{White_Space}](?<! )")
ALPHABETIC = regex.compile(r"[\p{Script=Latin}\p{Script=Greek}\p{Script=Cyrillic}\p{Script=Armenian}\p{M}]+")
CJK = regex.compile(r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}ー]")
#: The widened script sets of UTS 39 for the scripts that meet in this data.
WIDENED = {"Han": {"Han", "Hanb", "Jpan", "Kore"}, "Hiragana": {"Hiragana", "Jpan"}, "Katakana": {"Katakana", "Jpan"}, "Hangul": {"Hangul", "Kore"}, "Bopomofo": {"Bopomofo", "Hanb"}}
SCRIPTS = {name: regex.compile(rf"\p{{Script={name}}}") for name in ("Latin", "Greek", "Cyrillic", "Armenian", "Han", "Hiragana", "Katakana", "Hangul", "Bopomofo")}


def joins(text: str, at: int) -> bool:
    """Whether the joiner or selector at a place belongs to the spelling: inside a word of a joining script or an emoji."""
    before, after = text[at - 1 : at], text[at + 1 : at + 2]
    if text[at] == "\ufe0f":
        return bool(EMOJI.match(before)) and not before.isascii()
    return bool(JOINED_SCRIPTS.match(before) and JOINED_SCRIPTS.match(after)) or bool(text[at] == "\u200d" and EMOJI.match(before) and EMOJI.match(after))


@lru_cache(maxsize=1 << 16)
def script_of(ch: str) -> str:
    """The script of a character; Common for those of none or of many."""
    if ch == "ー":
        return "Katakana"
    return next((name for name, test in SCRIPTS.items() if test.match(ch)), "Common")


def resolved_scripts(token: str) -> set[str] | None:
    """The scripts that the whole token can be written in; None means any, the empty set a mixture."""
    out: set[str] | None = None
    for ch in token:
        name = script_of(ch)
        if name != "Common":
            wide = WIDENED.get(name, {name})
            out = set(wide) if out is None else out & wide
    return out


@lru_cache(maxsize=1 << 16)
def plain_char(ch: str) -> str:
    """A character's ordinary form: of ordinary width, composed, not a presentation or compatibility form."""
    if ch in OTHER_DOUBLES:
        return OTHER_DOUBLES[ch]
    if ch in KANJI_OF_RADICAL:
        return KANJI_OF_RADICAL[ch]
    form = unicodedata.decomposition(ch)
    if not form:
        return ch
    kind = form.split(" ")[0] if form.startswith("<") else ""
    if kind in ("<wide>", "<narrow>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>"):
        return unicodedata.normalize("NFKC", ch)
    if kind == "":
        return unicodedata.normalize("NFC", ch)
    if kind == "<compat>":
        wide = unicodedata.normalize("NFKC", ch)
        if len(wide) == 1 or "ﬀ" <= ch <= "ﬆ" or "Ⅰ" <= ch <= "ⅿ":
            return wide
    return ch


#: Of each alphabetic script, its letter with the look of a Latin one.
DOUBLE_IN = {name: {latin: ch for ch, latin in LATIN_DOUBLES.items() if script_of(ch) == name} for name in ("Greek", "Cyrillic", "Armenian")}


def spelled_in(token: str, script: str) -> str | None:
    """The token with every letter in ``script``; None if a letter has no double there."""
    out = []
    for ch in token:
        own = script_of(ch)
        if own not in (script, "Common"):
            ch = LATIN_DOUBLES.get(ch, ch)
            if script != "Latin":
                ch = DOUBLE_IN[script].get(ch)
            elif script_of(ch) != "Latin":
                return None
        if ch is None:
            return None
        out.append(ch)
    return "".join(out)


def _alphabetic(text: str) -> str:
    """The spelling in one script for mixed-script tokens and whole-script confusables.

    A mixed token takes the one script that all of it can be written in, Latin
    if several are possible, and stays if none is. A token wholly in another
    script whose letters all have a Latin double is Latin, unless that script
    is really used in the value.
    """
    if text.isascii():
        return text
    # A script with a letter of its own somewhere in the value is really used there.
    used = {script_of(ch) for ch in text if script_of(ch) in DOUBLE_IN and ch not in LATIN_DOUBLES}

    def spell(match: regex.Match) -> str:
        token = match[0]
        foreign = [name for name in DOUBLE_IN if any(script_of(ch) == name for ch in token)]
        if not foreign or resolved_scripts(token) and used.intersection(foreign):
            return token
        mixed = not resolved_scripts(token)
        spellings = [spelled_in(token, name) for name in (["Latin", *foreign] if mixed else ["Latin"])]
        return next((t for t in spellings if t is not None), token)

    return ALPHABETIC.sub(spell, text)


def _katakana_like(ch: str) -> bool:
    return script_of(ch) == "Katakana" and ch not in "・" if ch else False


def _kana_and_kanji(text: str) -> str:
    """Kanji, kana and strokes spelled in the script of the run they stand in.

    Han and both kana resolve to one writing system, so the sets of a whole
    Japanese token never conflict; here the token is the run of one script, and
    the letters beside a confusable one tell which run it belongs to.
    """
    if not CJK.search(text):
        return text
    out = list(text)
    n = len(out)
    for i, ch in enumerate(text):
        before, after = (out[i - 1] if i else ""), (text[i + 1] if i + 1 < n else "")
        kana_before, kana_after = _katakana_like(before), _katakana_like(after) or (after in KATAKANA_OF_KANJI and i + 2 < n and _katakana_like(text[i + 2]))
        han_before, han_after = script_of(before) == "Han" if before else False, script_of(after) == "Han" if after else False
        if ch in BARS:
            # A stroke after a kana with kana or no word beyond it draws the sound out.
            if kana_before and before != "ー" and (ch not in "-一" or _katakana_like(after) or not after or after in " )" or (ch == "一" and not han_after)):
                if not (ch == "一" and after and script_of(after) == "Han"):
                    out[i] = "ー"
            continue
        if ch in KATAKANA_OF_KANJI:
            if kana_before and (kana_after or not han_after) or kana_after and not before.strip():
                # 二ツ橋, 八ケ岳, 三ノ丸: a number with its counter, not a word in katakana
                counter = not kana_before and after in COUNTER_KANA and ch in "二八千三" and (i + 2 >= n or not _katakana_like(text[i + 2]))
                if not counter:
                    out[i] = KATAKANA_OF_KANJI[ch]
            continue
        if ch in KANJI_OF_KATAKANA:
            # A lone katakana letter between kanji; 三カ所, 八ケ岳 are ordinary.
            lone = not kana_before and not _katakana_like(after)
            if lone and han_after and (han_before or not before.strip()) and not (ch in COUNTER_KANA and han_before) and not (ch == "ハ" and not han_after):
                out[i] = KANJI_OF_KATAKANA[ch]
            continue
        if ch in KATAKANA_OF_HIRAGANA:
            if kana_before and kana_after or (kana_before and not after and ch == "り") or (not before.strip() and kana_after and _katakana_like(text[i + 2] if i + 2 < n else "")):
                out[i] = KATAKANA_OF_HIRAGANA[ch]
            continue
        if ch in HIRAGANA_OF_KATAKANA:
            if not kana_before and not kana_after and (script_of(before) == "Hiragana" if before else False) and (script_of(after) == "Hiragana" if after else False):
                out[i] = HIRAGANA_OF_KATAKANA[ch]
    return "".join(out)


def plain(text: str | None) -> str | None:
    """The plain spelling of ``text``; None for None."""
    if not text or text.isascii() and text.isprintable():
        return text
    text = IGNORABLE.sub(lambda m: m[0] if m[0] in JOINERS and joins(m.string, m.start()) else "", text)
    text = SPACES.sub(" ", text)
    text = "".join(plain_char(ch) for ch in text)
    text = unicodedata.normalize("NFC", text)
    text = _kana_and_kanji(text)
    text = "".join("-" if ch in HYPHENS else ch for ch in text)
    return _alphabetic(text)


def _plain_series(texts: pd.Series) -> pd.Series:
    # Each different value of a batch once.
    return texts.map({t: plain(t) for t in texts.dropna().unique()}, na_action="ignore").astype(object)


#: Texts of printable ASCII alone are plain as they stand and never leave the JVM.
ASCII_ONLY = r"^[\x20-\x7E]*$"


def plain_spelling(column: Column | str) -> Column:
    """The plain spelling of a string column. Null stays null, the empty text empty; texts are taken whole, of any length."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    # Not moved below a filter on its result, which would run it once more.
    return F.when(text.rlike(ASCII_ONLY), text).otherwise(F.pandas_udf(_plain_series, T.StringType()).asNondeterministic()(text))


def find_lookalikes(df: DataFrame, table_name: str, key: str, field: str) -> DataFrame:
    """``(table_name, record_key, field, plain)`` of each value that is not in its plain spelling.

    One row per distinct (key, value); null and empty values are no case, and
    further columns do not matter. Narrow but for the final distinct.
    """
    rows = df.select(F.lit(table_name).alias("table_name"), F.col(f"`{key}`").cast("string").alias("record_key"), F.lit(field).alias("field"), F.col(f"`{field}`").cast("string").alias("value"))
    out = rows.filter(~F.col("value").rlike(ASCII_ONLY)).withColumn("plain", plain_spelling("value")).filter("plain <> value")
    return out.select("table_name", "record_key", "field", "plain").distinct()
