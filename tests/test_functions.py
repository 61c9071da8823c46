"""Expressions against literal values."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meguri.functions import classify, filters, text, urls
from meguri.operators import merge, neighbours, retrieval


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("given_text", "wanted"),
    [("京都", ["京", "京都", "都"]), ("東京駅", ["東", "東京", "京", "京駅", "駅"]), ("Top10 hotels", ["top10", "hotels"]), ("a b c", []), ("", []), (None, [])],
)
def test_tokens(spark, given_text, wanted):
    assert value(spark, text.tokens(F.lit(given_text).cast("string"))) == wanted


@pytest.mark.parametrize("t", ["Top10 hotels at 東京駅 a b", "温温温泉 x9 京", "", None, "a-b cc東c"])
def test_counts_without_tokens(spark, t):
    made = value(spark, text.tokens(F.lit(t).cast("string")))
    assert value(spark, text.token_count(F.lit(t).cast("string"))) == len(made)
    assert text.query_terms(t or "") == list(dict.fromkeys(made))
    for term in ("東京", "東", "温温", "hotels", "cc", "x9"):
        assert value(spark, text.term_count(F.lit(t).cast("string"), term)) == made.count(term)


def test_name_similarity(spark):
    assert value(spark, text.name_similarity(F.lit("abcd"), F.lit("abce"))) == 0.75
    assert value(spark, text.name_similarity(F.lit(""), F.lit("abce"))) == 0.0
    assert value(spark, text.name_similarity(F.lit(None).cast("string"), F.lit("x"))) == 0.0


def test_hotel_name_and_phone(spark):
    assert value(spark, text.normal_hotel_name(F.lit("株式会社 桜ホテル・別邸　(本館)"))) == "桜別邸本館"
    assert value(spark, text.normal_phone(F.lit("+81 (0)75-123-4567"))) == "0751234567"
    assert value(spark, text.normal_phone(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("HTTPS://Ex.Example:443/a/index.html?b=2&utm_source=x&a=1#top", "https://ex.example/a?a=1&b=2"),
        ("http://ex.example:80/", "http://ex.example/"),
        ("http://ex.example", "http://ex.example/"),
        ("https://ex.example/a//", "https://ex.example/a"),
        ("not a url", "not a url"),
    ],
)
def test_canonical_url(spark, raw, wanted):
    assert value(spark, urls.canonical_url(F.lit(raw))) == wanted


def test_nav_names(spark):
    for name, nav in (("Home", True), (None, True), ("  ", True), ("バス", True), ("X市観光協会公式サイト", True), ("上鳴島渓谷", False), ("プライバシーポリシーについて", True)):
        assert value(spark, filters.is_nav_name(F.lit(name).cast("string"))) is nav


def test_spot_rejection(spark):
    why = lambda u, t, d: value(spark, filters.rejected_spot(F.lit(u), F.lit(t), F.lit(d).cast("string")))
    assert why("https://x.example/a", "ab", "d") == "title too short"
    assert why("https://x.example/a", "サイトマップ", "d") == "infrastructure title"
    assert why("https://x.example/search/", "A fine garden", "d") == "infrastructure url"
    assert why("https://x.example/search/kanko", "A fine garden", "d") is None
    assert why("https://x.example/a", "A fine garden", None) == "no description and no tourism keyword"


def test_lodging_order(spark):
    kind = lambda n, e, t: value(spark, classify.lodging_type(F.lit(n).cast("string"), F.lit(e).cast("string"), F.lit(t).cast("string")))
    assert kind("温泉旅館 桜", None, "hotel") == "onsen_ryokan"
    assert kind("桜旅館", None, "hostel") == "ryokan"
    assert kind("高野山宿坊", "Temple Lodging", None) == "shukubo"
    assert kind(None, None, None) == "hotel"
    assert kind("桜", None, "hostel") == "hostel"


def test_prefectures(spark):
    assert value(spark, classify.first_prefecture(F.lit("大阪府と京都府"))) == "26"
    assert value(spark, classify.prefectures_named(F.lit("大阪府と京都府、広島の"))) == ["27", "26", "34"]
    assert value(spark, classify.prefectures_named(F.lit(None).cast("string"))) == []


def test_safety_and_concepts(spark):
    assert value(spark, classify.safety_topics(F.lit("夜に富士山を登山"))) == ["high_altitude_risk"]
    assert value(spark, classify.safety_topics(F.lit("12月 富士山 河口湖"))) == []
    assert value(spark, classify.concepts(F.lit("a SHUKUBO near a castle town"))) == ["shukubo", "jokamachi"]
    assert value(spark, classify.routed_tool(F.lit("ryokan"))) == "get_hotels"
    assert value(spark, classify.origin(F.lit("temples from Kyoto by train"))) == "Kyoto"
    assert value(spark, classify.origin(F.lit("東京から日帰り"))) == "東京"


def test_merge_expressions(spark):
    assert value(spark, merge.longer_text(F.lit("abcde"), F.lit("abcdefg"))) == "abcde"
    assert value(spark, merge.longer_text(F.lit("abcde"), F.lit("abcdefgh"))) == "abcdefgh"
    assert value(spark, merge.longer_text(F.lit(None).cast("string"), F.lit("x"))) == "x"


def test_wkt_and_minutes(spark):
    assert value(spark, neighbours.wkt_point(F.lit("POINT(135.5 34.5)"))).asDict() == {"lat": 34.5, "lng": 135.5}
    assert value(spark, neighbours.wkt_point(F.lit("LINE(1 2)"))) is None
    assert value(spark, neighbours.walk_minutes(F.lit(200.0))) == 2


def test_half_precision(spark):
    bits = [(0x3C00, 1.0), (0x4000, 2.0), (0xBC00, -1.0), (0x3800, 0.5), (0x7C00, math.inf), (0x0001, 2.0**-24)]
    df = spark.createDataFrame([(b,) for b, _ in bits], "b int").coalesce(1)
    assert [r["v"] for r in df.select(retrieval.half_to_float(F.col("b")).alias("v")).collect()] == [v for _, v in bits]


def plain_chunks(t):
    """The chunks, written down again without sharing code: paragraph by paragraph, then letter by letter."""
    import re

    buffers, now = [], None
    for p in [q.strip() for q in re.split("\n\n+", re.sub("[ \t\r\f\v]+", " ", t)) if q.strip()]:
        if now is None:
            now = p
        elif len(now) + len(p) + 1 > 400:
            buffers.append(now)
            now = p
        else:
            now = f"{now} {p}"
    if now is not None:
        buffers.append(now)
    out = []
    for b in buffers:
        if len(b) <= 800:
            out.append(b)
            continue
        start = 0
        while len(b) - start > 800:
            ends = [i for i in range(start, start + 800) if b[i] == "。" or b[i : i + 2] == ". " and i + 1 < start + 800]
            end = ends[-1] + 1 if ends and ends[-1] - start >= 80 else start + 800
            out.append(b[start:end].strip())
            start = end
        out.append(b[start:].strip())
    return [c for c in out if len(c) >= 80]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_chunks_against_plain_version(seed):
    r = random.Random(seed)
    t = "".join(r.choice(["word ", "文。", "End. ", "\n\n", "x" * 30, " ", "あ" * 50]) for _ in range(r.randrange(200)))
    assert text.chunk(t) == plain_chunks(t)


# Pages and loose JSON -----------------------------------------------------------------------------


def test_page_fields_and_items(spark):
    from meguri.functions import pages

    markup = """<HTML lang=ja><title>A &amp; B</title><meta property="og:description" content="what  it is"><link rel="x canonical" href="/c">
        <script type="application/ld+json">[{"@graph": [{"@type": ["Thing", "Festival"], "name": {"@value": "F"}, "startDate": "2025-01-02", "location": {"name": "Hall", "address": [{"addressRegion": "R", "streetAddress": "1"}], "geo": {"latitude": "35.1", "longitude": 135}}}]}, {"@type": "Person"}]</script>
        <script type="application/ld+json">{broken</script><script type="application/ld+json">{"@type": "Museum", "name": ["M"], "geo": {"latitude": "x", "longitude": 1}, "address": "Town"}</script>
        <a href="d/e">x</a><a href="d/e">y</a><a href="http://o.example/">z</a><img data-src="i.png"><h2> a <b>b</b> </h2>"""
    df = spark.createDataFrame([(markup, "https://s.example/p/"), (None, "https://s.example/"), ("", None)], "m string, u string")
    full, none, empty = (r["p"] for r in df.select(pages.page_fields(F.col("m"), F.col("u")).alias("p")).collect())
    assert (full["title"], full["language"], full["description"], full["canonical"]) == ("A & B", "ja", "what it is", "https://s.example/c")
    assert full["links"] == ["https://s.example/p/d/e", "http://o.example/"] and full["images"] == ["https://s.example/p/i.png"] and full["headings"] == ["a b"]
    event, museum = full["items"]
    assert (event["type"], event["name"], event["start_date"], event["location"], event["address"], event["lat"], event["lng"]) == ("Festival", "F", "2025-01-02", "Hall", "R 1", 35.1, 135.0)
    assert (museum["type"], museum["name"], museum["address"], museum["lat"]) == ("Museum", "M", "Town", None)
    assert none is None and empty["title"] is None and empty["items"] == []


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ('x {"a": 1} y {"b": 2}', '{"a": 1}'),
        ('```json\n{"a": "x\ny", "b": {"c": "}"}}\n```', '{"a": "x\\ny", "b": {"c": "}"}}'),
        ('{"a": "say "hi" now", "b": []}', '{"a": "say \\"hi\\" now", "b": []}'),
        ("no object", None),
        ("{never closed", None),
        ("", None),
    ],
)
def test_loose_objects(text, wanted):
    from meguri.functions import pages

    assert pages.loose_object(text) == wanted
