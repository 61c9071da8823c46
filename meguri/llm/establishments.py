"""Matching lodging records of two sources that share no key.

Method: collective graph linkage. Every record is reduced to attributes (phone,
site, street, postal code, place, and its name as reading, house suffix and
kind of house). Candidate pairs share a rare attribute and are weighted by how
rare it is; meta-blocking prunes, for each record, the edges far below its
best. The similarity of a pair is then refined by its neighbours, the pairs
that the same records form with twins and rivals, until no decision changes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Observation, Window
from pyspark.sql import types as T

from meguri.functions.cells import haversine_m, valid
from meguri.llm.lookalikes import plain
from meguri.session import cut

# Kinds of house and how their names are written, longest first.
KINDS = (
    ("grandhotel", ("グランドホテル", "grand hotel")),
    ("businesshotel", ("ビジネスホテル", "business hotel")),
    ("parkhotel", ("パークホテル", "park hotel")),
    ("guesthouse", ("ゲストハウス", "guesthouse", "guest house", "gh")),
    ("auberge", ("オーベルジュ", "auberge")),
    ("pension", ("ペンション", "pension")),
    ("resort", ("リゾート", "resort")),
    ("ryokan", ("旅館", "りょかん", "旅舘", "ryokan")),
    ("minshuku", ("民宿", "みんしゅく", "minshuku")),
    ("yuyado", ("湯宿", "ゆやど", "yuyado")),
    ("hostel", ("ホステル", "hostel")),
    ("lodge", ("ロッジ", "lodge")),
    ("hotel", ("ホテル", "hotel")),
    ("inn", ("イン", "inn")),
)
#: House suffixes and their readings.
SUFFIXES = {"館": "kan", "舘": "kan", "荘": "so", "庄": "so", "亭": "tei", "苑": "en", "園": "en", "閣": "kaku", "屋": "ya", "家": "ya"}
#: Words that name another house of the same owner.
ANNEX = re.compile(r"別館|新館|本館|東館|西館|南館|北館|はなれ|離れ|アネックス|annex|bekkan|hanare|honkan|shinkan|\bwest wing\b|\beast wing\b|\b(?:ii|2)\b|第[二三2３]|[2２]号館|タワー館", re.I)
#: Company forms and the like around a name.
AROUND = re.compile(r"株式会社|有限会社|合同会社|\(株\)|\(有\)|㈱|㈲|一般社団法人|公式|\bco\.?,? ?ltd\.?|\binc\.?\b", re.I)
BRACKETS = re.compile(r"[(\[（【〔][^)\]）】〕]*[)\]）】〕]")
PLACE_WORD = re.compile(r"[一-鿿々〆]+")
NOT_LETTER = re.compile(r"[^a-z]+")
#: Metres within which positions of one establishment usually, and at the outside, lie.
NEAR_M, OFF_M = 150.0, 1500.0
#: The reading that the host of a site begins with.
HOST_READING = r"^([a-z]+)\d*\."
#: A block of more pairs than this is met by way of narrower ones.
COMMON = 100


def parse_name(name: str | None) -> dict[str, str | bool | None]:
    """A name in its parts: ``place`` in kanji, ``reading`` in Latin letters, ``suffix``, ``kind``, ``annex``, ``flat`` spelling."""
    out: dict[str, str | bool | None] = {"place": None, "reading": None, "suffix": None, "kind": None, "annex": False, "flat": None}
    if not name or not name.strip():
        return out
    text = plain(unicodedata.normalize("NFKC", plain(name))).lower()
    text = BRACKETS.sub(" ", AROUND.sub(" ", text))
    out["annex"] = bool(ANNEX.search(text))
    text = ANNEX.sub(" ", text)
    flat = re.sub(r"[\W_]+", "", text)
    if not flat:
        return out
    if re.search(r"[぀-ヿ一-鿿]", flat):
        rest = flat
        for kind, spellings in KINDS:
            hit = next((s for s in spellings if s.replace(" ", "") in rest), None)
            # A kind is cut only where the name goes on without it.
            if hit and len(rest) > len(hit.replace(" ", "")):
                out["kind"], rest = kind, rest.replace(hit.replace(" ", ""), "|", 1)
                break
        if out["kind"] in ("grandhotel", "businesshotel", "parkhotel", "hotel") or out["kind"] is None:
            for kind, word in (("grandhotel", "グランド"), ("businesshotel", "ビジネス"), ("parkhotel", "パーク")):
                if word in rest:
                    out["kind"], rest = kind, rest.replace(word, "|")
                    break
        runs = PLACE_WORD.findall(rest)
        place = max(runs, key=len) if runs else re.sub(r"[|]", "", rest)
        if len(place) > 2 and place[-1] in SUFFIXES:
            out["suffix"], place = SUFFIXES[place[-1]], place[:-1]
        else:
            out["suffix"] = ""
        out["place"] = place
    else:
        words = re.sub(r"[^a-z -]+", " ", text.replace("‐", "-"))
        for kind, spellings in KINDS:
            hit = next((s for s in spellings if s.isascii() and re.search(rf"\b{s}\b", words)), None)
            if hit:
                out["kind"], words = kind, re.sub(rf"\b{hit}\b", " ", words, count=1)
                break
        m = re.fullmatch(r"\s*(.*?)(?:[- ](kan|so|tei|en|kaku|ya))?\s*", words)
        out["suffix"] = (m[2] or "") if m else ""
        out["reading"] = NOT_LETTER.sub("", m[1] if m else words) or None
    out["flat"] = flat
    return out


def phone_key(phone: str | None) -> str | None:
    """A phone number's significant digits: without country code, trunk zero and punctuation."""
    if not phone:
        return None
    text = unicodedata.normalize("NFKC", phone).strip()
    digits = re.sub(r"\D", "", text)
    if text.startswith(("+81", "0081", "(+81")):
        digits = re.sub(r"^(?:0081|81)", "", digits)
    digits = digits.lstrip("0")
    return digits if len(digits) >= 7 else None


def site_key(url: str | None) -> str | None:
    """The host of a site, without scheme and www, with the first path piece where the host is shared by many."""
    if not url:
        return None
    host = re.sub(r"^\s*(?:[a-z]+:)?//", "", unicodedata.normalize("NFKC", url).lower().strip())
    host = re.split(r"[/?#:]", re.sub(r"^www\.", "", host))[0]
    return host if "." in host else None


def postal_key(code: str | None) -> str | None:
    digits = re.sub(r"\D", "", unicodedata.normalize("NFKC", code)) if code else ""
    return digits if len(digits) == 7 else None


def street_key(street: str | None) -> str | None:
    if not street or not street.strip():
        return None
    text = plain(unicodedata.normalize("NFKC", plain(street))).lower()
    return re.sub(r"\s+", "", re.sub(r"(?<=\d)\s*(?:丁目|番地?|号|の|-)\s*(?=\d)", "-", text)).rstrip("号番地") or None


RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "place", "reading", "suffix", "kind")]
    + [T.StructField("annex", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("flat", "korean", "chinese", "phone", "site", "postal", "street")]
    + [T.StructField(n, T.DoubleType()) for n in ("lat", "lng")]
)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            native, english = parse_name(r.name), parse_name(r.name_en)
            if native["place"] is None and native["reading"] is not None and english["reading"] is None:
                english = native
            site = site_key(r.website)
            reading = english["reading"] or native["reading"]
            kind, suffix = native["kind"] or english["kind"], native["suffix"] if native["suffix"] is not None else english["suffix"]
            if not suffix and english["suffix"]:
                suffix = english["suffix"]
            annex = bool(native["annex"] or english["annex"] or (site or "").startswith(("annex", "bekkan", "hanare")))
            key = lambda s: re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", s).lower()) or None if s else None
            out.append((r.id, native["place"], reading, suffix, kind, annex, native["flat"] or english["flat"], key(r.name_ko), key(r.name_zh), phone_key(r.phone), site, postal_key(r.postal), street_key(r.street), r.lat, r.lng))
        yield pd.DataFrame(out, columns=RECORD.names)


def records(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The parsed records of a source. ``columns`` maps id, name, name_en, name_ko, name_zh, phone, website, postal, street
    and coordinates to its columns; missing ones are null. Rows without an id are left out; of rows with one id the
    greatest, column by column, counts."""
    text = lambda n: (F.col(f"`{columns[n]}`") if n in columns else F.lit(None)).cast("string").alias(n)
    at = F.col(f"`{columns['coordinates']}`")
    lat, lng = at["lat"].cast("double"), at["lng"].cast("double")
    ok = valid(lat, lng)
    raw = df.select(*[text(n) for n in ("id", "name", "name_en", "name_ko", "name_zh", "phone", "website", "postal", "street")], F.when(ok, lat).alias("lat"), F.when(ok, lng).alias("lng"))
    one = raw.filter("id is not null and id <> ''").groupBy("id").agg(F.max(F.struct(*raw.columns[1:])).alias("r")).select("id", "r.*")
    return one.mapInPandas(_parse, RECORD)


def readings_of(*parsed: DataFrame) -> DataFrame:
    """``(place, learned)``: the reading that most records with both spellings give a place name."""
    both = None
    for df in parsed:
        part = df.select("place", "reading").filter("place is not null and reading is not null and place <> '' and reading <> ''")
        both = part if both is None else both.unionByName(part)
    counted = both.groupBy("place", "reading").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("place").agg(F.max_by("reading", F.struct("n", "reading")).alias("learned"))


def _cells(radius_m: float, degrees: float, near: bool) -> Column:
    """The grid cell of a record or, if ``near``, all cells that reach into ``radius_m`` around it, at every latitude."""
    columns = round(360 / degrees)
    lat, lng = F.col("lat"), F.col("lng") + 180
    high = radius_m / 111_000
    beside = F.abs(lat) + high
    wide = F.when(beside < 89, high / F.cos(F.radians(F.least(beside, F.lit(89.0))))).otherwise(F.lit(180.0))
    row = lambda v: F.floor(v / degrees)
    column = lambda v: F.floor(v * columns / 360)
    if near:
        rows, across = F.sequence(row(lat - high), row(lat + high)), F.sequence(column(lng - wide), column(lng + wide))
    else:
        rows, across = F.array(row(lat)), F.array(column(lng))
    across = F.array_distinct(F.transform(across, lambda j: F.pmod(j, F.lit(columns))))
    cells = F.flatten(F.transform(rows, lambda i: F.transform(across, lambda j: F.concat_ws(",", F.lit(f"c{degrees}"), i, j))))
    return F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), cells).otherwise(F.expr("cast(array() as array<string>)"))


def _slips(name: str, near: bool) -> list[Column]:
    """Keys that two spellings share if one is the other with one or two letters dropped.

    The shorter, of length m, is cut into one part more than letters are
    dropped. At least one part stands whole in the longer: the first where it
    is, the last at the end, or the middle one moved by one letter.
    """
    text, size = F.col(name), F.length(F.col(name))
    out = []
    for dropped in (1, 2):
        for longer in (True, False):
            side = "l" if longer == near else "r"  # the side with the longer spelling
            m = size - dropped if longer else size
            part = F.floor(m / (dropped + 1)).cast("int")
            last = m - part * dropped
            parts = [F.substring(text, F.lit(1), part), F.substring(text, size - last + 1, last)]
            if dropped == 2:
                parts.append(F.substring(text, part + (2 if longer else 1), part))
            out += [F.when(m >= 1, F.concat_ws("~", F.lit(f"{side}{dropped}{i}{name}"), m, p)) for i, p in enumerate(parts)]
    return out


#: Kinds of block, as bits: what two records of a block have in common.
PHONE, SITE, STREET, POSTAL, CELL, NAME = 1, 2, 4, 8, 16, 32
#: Degrees of the grids whose cells reach over ``NEAR_M`` and ``OFF_M``.
NEAR_CELL, OFF_CELL = 0.0027, 0.027


def _tag(mark: str, value: Column | str) -> Column:
    return F.concat(F.lit(mark), F.col(value) if isinstance(value, str) else value)


def _some(*columns: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*columns)))


def _cross(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit("|"), y))))


def _same_names(near: bool) -> Column:
    """The forms of a name under which :func:`evidence` takes two names for the same."""
    host = F.regexp_extract("site", HOST_READING, 1)
    hosts = (F.when(host != "", host), F.col("reading")) if near else (F.col("reading"), F.when(host != "", host))
    return _some(_tag("n:", "place"), _tag("f:", "flat"), _tag("r:", "reading"), _tag("r:", F.coalesce("reading", "learned")), _tag("h:", hosts[0]), _tag("i:", hosts[1]))


def blocks(parsed: DataFrame, near: bool) -> DataFrame:
    """``(id, lat, lng, bit, key)``: the blocks, hashed, in which a record meets others; ``near`` for the left side.

    Two records that :func:`evidence` can bring to ``ENOUGH - TWIN`` share a
    phone, site, street or postal code, stand within ``NEAR_M``, or have the
    same name: each of these is a block.
    """
    of = lambda bit, keys: F.transform(keys, lambda k: F.struct(F.lit(bit).alias("bit"), F.xxhash64(k).alias("key")))
    tagged = [of(bit, _some(_tag(mark, name))) for bit, mark, name in ((PHONE, "p:", "phone"), (SITE, "s:", "site"), (STREET, "t:", "street"), (POSTAL, "z:", "postal"))]
    rows = F.concat(*tagged, of(CELL, _cells(NEAR_M, NEAR_CELL, near)), of(NAME, _same_names(near)))
    return parsed.select("id", "lat", "lng", F.explode(rows).alias("k")).select("id", "lat", "lng", "k.bit", "k.key")


def narrowed(rows: DataFrame, near: bool) -> DataFrame:
    """``(id, bit, key, weight)``: rows of crowded blocks, with all columns of their records, under the narrower blocks
    that records of the block still share if evidence can bring them to ``ENOUGH - TWIN``:

    * names the same or alike;
    * names that say nothing (no spelling that both have), in a block of a street, postal code or place with another of these;
    * names that differ, with two of phone, site and street, as less does not make up for them;
    * in a block of a name, positions within ``OFF_M``.
    """
    c = F.col
    phone, site, street, postal = (_some(_tag(mark, name)) for mark, name in (("p:", "phone"), ("s:", "site"), ("t:", "street"), ("z:", "postal")))
    alike = F.concat(_same_names(near), _some(_tag("k:", "korean"), *_slips("place", near), *_slips("flat", near)))
    around = _cells(NEAR_M, NEAR_CELL, near)
    # The spellings that a record has, as bits, and all that have none of them: such names cannot be compared.
    own = F.when(c("place").isNotNull(), 2).otherwise(0) + F.when(F.coalesce("reading", "learned").isNotNull(), 1).otherwise(0)
    unlike = F.array_compact(F.array(*[F.when(own.bitwiseAND(q) == 0, F.concat_ws("/", own, F.lit(q)) if near else F.concat_ws("/", F.lit(q), own)) for q in range(4)]))
    by_kind = {
        PHONE: F.concat(alike, unlike, site, street),
        SITE: F.concat(alike, unlike, phone, street),
        STREET: F.concat(alike, _cross(F.concat(postal, around), unlike)),
        POSTAL: F.concat(alike, _cross(F.concat(street, around), unlike)),
        CELL: F.concat(alike, _cross(F.concat(street, postal), unlike)),
        NAME: _cells(OFF_M, OFF_CELL, near),
    }
    finer = F.coalesce(*[F.when(c("bit") == bit, keys) for bit, keys in by_kind.items()])
    return rows.select("id", "bit", "weight", "key", F.explode(F.array_distinct(finer)).alias("finer")).select("id", "bit", "weight", F.xxhash64("key", "finer").alias("key"))


def candidates(left: DataFrame, right: DataFrame, common: int = COMMON) -> DataFrame:
    """``(lid, rid, weight)``: pairs that share a block, weighted by the rarity of what they share, pruned per record.

    A block of at most ``common`` pairs gives them all. A larger one is cut into
    narrower blocks (:func:`narrowed`), so that a phone or place that much of the
    data shares costs no more than the pairs that could be accepted; which way a
    block goes changes the work, not the pairs that can be accepted. A pair's
    weight is the sum over its blocks of the log of how few pairs they make.
    Meta-blocking prunes a pair that shares nothing but a name, does not stand
    within ``OFF_M``, and weighs less than a third of the heaviest of either of
    its records.
    """
    sides = cut(blocks(left, True).withColumn("near", F.lit(True)).unionByName(blocks(right, False).withColumn("near", F.lit(False))))
    sizes = sides.groupBy("key").agg(F.count_if("near").alias("na"), F.count_if(~F.col("near")).alias("nb")).filter("na > 0 and nb > 0")
    # Written out, so that the join with it is one of two plain shuffles, which the engine splits at a crowded key.
    sizes = cut(sizes.select("key", (F.col("na") * F.col("nb")).alias("pairs")))
    weight = F.log2(1 + F.lit(1024.0) / F.col("pairs"))
    marked = cut(sides.join(sizes, "key").withColumns({"weight": weight, "crowded": F.col("pairs") > common}).drop("pairs"))
    rare, crowded = marked.filter("not crowded"), marked.filter("crowded")
    side = lambda parsed, near: narrowed(crowded.filter("near" if near else "not near").select("id", "bit", "key", "weight").join(parsed, "id"), near)
    fine = side(left, True).withColumnRenamed("id", "lid").join(side(right, False).select(F.col("id").alias("rid"), "key"), "key")
    # A pair counts a block once, in however many narrower ones it meets.
    fine = fine.groupBy("lid", "rid", "bit").agg(F.max("weight").alias("weight")).withColumn("close", F.lit(True))
    near, far = rare.filter("near").select(F.col("id").alias("lid"), "bit", "key", "weight", "lat", "lng"), rare.filter("not near").select(F.col("id").alias("rid"), "key", F.col("lat").alias("rlat"), F.col("lng").alias("rlng"))
    close = F.coalesce(haversine_m(F.col("lat"), F.col("lng"), F.col("rlat"), F.col("rlng")) <= OFF_M, F.lit(False))
    pairs = near.join(far, "key").select("lid", "rid", "bit", "weight", close.alias("close")).unionByName(fine)
    edges = pairs.groupBy("lid", "rid").agg(F.sum("weight").alias("weight"), F.bit_or("bit").alias("bits"), F.max("close").alias("close"))
    best = lambda key: F.max("weight").over(Window.partitionBy(key))
    heavy = edges.withColumn("ml", best("lid")).withColumn("mr", best("rid")).filter((F.col("bits") != NAME) | F.col("close") | (F.col("weight") * 3 >= F.least("ml", "mr")))
    return heavy.select("lid", "rid", "weight")


#: What each piece of evidence adds, and the sum from which two records are one establishment.
SAME_NAME, LIKE_NAME, OTHER_NAME, OTHER_HOUSE = 4.0, 3.0, -8.0, -12.0
SAME_PHONE, OTHER_PHONE = 5.0, -5.0
SAME_SITE, OTHER_SITE = 5.0, -5.0
SAME_POSTAL, OTHER_POSTAL = 2.0, -4.0
SAME_STREET, OTHER_STREET = 3.0, -4.0
PLACE_NEAR, PLACE_OFF, PLACE_FAR = 3.0, 1.0, -8.0
ENOUGH = 6.0
#: What a confirmed twin adds to a pair, and what a clearly better rival takes from it.
TWIN, RIVAL, BETTER_BY = 1.0, -3.0, 4.0


def evidence(pairs: DataFrame) -> DataFrame:
    """``pairs`` of parsed records (columns ``l_*`` and ``r_*``) with ``score``: what they agree and differ in."""
    c = F.col
    both = lambda n: c(f"l_{n}").isNotNull() & c(f"r_{n}").isNotNull()
    compare = lambda n, same, other: F.when(both(n) & (c(f"l_{n}") == c(f"r_{n}")), F.lit(same)).when(both(n), F.lit(other)).otherwise(F.lit(0.0))
    read = lambda side: F.coalesce(c(f"{side}_reading"), c(f"{side}_learned"))
    # A slip drops letters of one spelling: the lengths differ by all that differs.
    slip = lambda a, b: (F.levenshtein(a, b) <= 2) & (F.levenshtein(a, b) == F.abs(F.length(a) - F.length(b))) & (F.length(a) >= 3)
    same_place = F.when(both("place"), c("l_place") == c("r_place")).when(read("l").isNotNull() & read("r").isNotNull(), read("l") == read("r"))
    same_place = F.when((c("l_reading") == c("r_reading")) | (c("l_flat") == c("r_flat")), True).otherwise(same_place)
    kinds = F.coalesce(c("l_kind") == c("r_kind"), F.lit(True))
    suffixes = F.coalesce(c("l_suffix") == c("r_suffix"), F.lit(True))
    site_reading = lambda side: F.regexp_extract(c(f"{side}_site"), HOST_READING, 1)
    host = F.coalesce((site_reading("l") == c("r_reading")) | (site_reading("r") == c("l_reading")), F.lit(False))
    name = (
        F.when(c("l_annex") != c("r_annex"), F.lit(OTHER_HOUSE))
        .when(same_place & kinds & suffixes, F.lit(SAME_NAME))
        .when(host & kinds & suffixes, F.lit(SAME_NAME))
        .when(both("flat") & F.coalesce(slip(c("l_flat"), c("r_flat")), F.lit(False)), F.lit(LIKE_NAME))
        .when(same_place & kinds & ((c("l_suffix") == "") | (c("r_suffix") == "")), F.lit(LIKE_NAME))
        .when(same_place & suffixes & (c("l_kind").isNull() | c("r_kind").isNull()), F.lit(LIKE_NAME))
        .when(F.coalesce(slip(c("l_place"), c("r_place")), F.lit(False)) & kinds & suffixes, F.lit(LIKE_NAME))
        .when(same_place.isNull() & kinds & (suffixes | (c("l_suffix") == "") | (c("r_suffix") == "")), F.when(both("korean") & (c("l_korean") == c("r_korean")), F.lit(LIKE_NAME)).otherwise(F.lit(0.0)))
        .otherwise(F.lit(OTHER_NAME))
    )
    distance = haversine_m(c("l_lat"), c("l_lng"), c("r_lat"), c("r_lng"))
    place = F.when(distance.isNull(), F.lit(0.0)).when(distance <= NEAR_M, F.lit(PLACE_NEAR)).when(distance <= OFF_M, F.lit(PLACE_OFF)).otherwise(F.lit(PLACE_FAR))
    score = name + place + compare("phone", SAME_PHONE, OTHER_PHONE) + compare("site", SAME_SITE, OTHER_SITE) + compare("postal", SAME_POSTAL, OTHER_POSTAL) + compare("street", SAME_STREET, OTHER_STREET)
    return pairs.withColumns({"name_score": name, "distance_m": distance, "score": score})


def link(left: DataFrame, right: DataFrame, readings: DataFrame | None = None, common: int = COMMON) -> DataFrame:
    """``(left_id, right_id, confidence)`` of the records of two parsed sources that are one establishment.

    ``readings`` may bring further ``(place, reading)`` spellings. A record may
    have several partners (one house mapped twice) or none. Null attributes
    neither speak for nor against; an empty side gives an empty result. The
    confidence is the logistic of the refined score's margin.

    Neighbouring pairs act on each other until none changes: a pair with a far
    better rival is put down for good, a pair beside a confirmed twin is lifted
    until it is put down. Each can happen to a pair once, so the rounds end.
    """
    left, right = cut(left), cut(right)
    learned = cut(readings_of(left, right, *([readings] if readings is not None else [])))
    left = cut(left.join(learned, "place", "left"))
    right = cut(right.join(learned, "place", "left"))
    edges = candidates(left, right, common)
    named = lambda df, p: df.select(*[F.col(n).alias(f"{p}_{n}") for n in df.columns])
    pairs = evidence(edges.join(named(left, "l"), F.col("lid") == F.col("l_id")).join(named(right, "r"), F.col("rid") == F.col("r_id")))
    # Only what a twin could still lift to the threshold goes on.
    state = cut(pairs.filter(F.col("score") + TWIN >= ENOUGH).select("lid", "rid", "name_score", "score", F.lit(0.0).alias("shift")))
    now = F.col("score") + F.col("shift")
    while True:
        over = lambda key: Window.partitionBy(key)
        sure = F.count_if(now >= ENOUGH)
        around = state.withColumns({"tl": F.max(now).over(over("lid")), "kl": sure.over(over("lid"))}).withColumns({"tr": F.max(now).over(over("rid")), "kr": sure.over(over("rid"))})
        # A twin: the record's other partner is confirmed, and this pair itself has no rival far better.
        # Of the left record's partners several may be right; of the right record's, one.
        rival = (F.col("tl") - F.col("score") >= BETTER_BY) & (F.col("name_score") < SAME_NAME) & (F.col("score") < ENOUGH + 2) | (F.col("tr") - F.col("score") >= BETTER_BY)
        twin = F.greatest(F.col("kl"), F.col("kr")) > F.when(now >= ENOUGH, 1).otherwise(0)
        shift = F.when(rival | (F.col("shift") == RIVAL), F.lit(RIVAL)).when(twin | (F.col("shift") == TWIN), F.lit(TWIN)).otherwise(F.lit(0.0))
        moved = Observation()
        after = around.select("lid", "rid", "name_score", "score", "shift", shift.alias("next")).observe(moved, F.count_if(F.col("next") != F.col("shift")).alias("n"))
        state = cut(after.select("lid", "rid", "name_score", "score", F.col("next").alias("shift")))
        if not moved.get.get("n"):
            break
    confidence = F.round(1 / (1 + F.exp(-(now - ENOUGH + 1) / 1.5)), 6)
    return state.filter(now >= ENOUGH).select(F.col("lid").alias("left_id"), F.col("rid").alias("right_id"), confidence.alias("confidence"))
