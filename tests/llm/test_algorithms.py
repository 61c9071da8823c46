"""Groups, survivors and linkage: brute force and awkward rows."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meguri.llm import components, establishments, survivorship
from meguri.llm.queries import OSM, WIKIDATA


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(k, find(k)) for k in parent}


PAIRS = "left_source_id string, right_source_id string, record_key string"


def run_components(spark, pairs):
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], PAIRS)
    return {tuple(r) for r in components.connected_components(df).collect()}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    r = random.Random(shape)
    if shape == "chain":
        ids = [f"n{i:04d}" for i in range(300)]
        r.shuffle(ids)
        pairs = list(zip(ids, ids[1:]))
    elif shape == "star":  # one hub holds far more than a third of all rows
        pairs = [("m", f"x{i}") for i in range(600)] + [("a", "x5")]
    else:
        pairs = [(f"n{r.randrange(150)}", f"n{r.randrange(150)}") for _ in range(120)]
    assert run_components(spark, pairs + pairs[:3] + [(b, a) for a, b in pairs[:5]]) == union_find(pairs)


def test_components_of_awkward_rows(spark):
    assert run_components(spark, [("a", None), (None, "b"), ("", "c"), ("d", "d"), ("A", "a"), ("a", "A "), ("é", "z")]) == {("A", "A"), ("a", "A"), ("A ", "A"), ("é", "z"), ("z", "z")}
    assert run_components(spark, [("a", "a")]) == set()
    assert components.connected_components(spark.createDataFrame([], PAIRS)).count() == 0


# Survivors ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("name", "usable"),
    [("Shin-tsuyutani Garden", True), ("Kami-rurisato-shrine", True), ("null", False), ("(no name)", False), ("Q910000002234", False), ("  ", False), ("???", False), ("銀城庭園", False), ("Galerie Étoile 銀野", False), ("å¥¥è", False), ("<br/>", False), ("Kami-aoishi Sky Terr…", False), ("Sky Terrace 360", True), (None, False)],
)
def test_usable_names(spark, name, usable):
    assert spark.range(1).select(survivorship.usable_english_name(F.lit(name).cast("string")).alias("u")).first()["u"] is usable


@pytest.mark.parametrize(
    ("text", "usable"),
    [
        ("The waterfall of Ume opens at 8:35 and is quiet.", True),
        ("Small canyon bridge in Akaneishi.", True),
        ("The waterfall of Ume opens at 8:35 and", False),
        ("The waterfall of Ume opens [...]", False),
        ("The waterfall of Ume opens…", False),
        ("The waterfall of Ume (more", False),
        ("To be written.", False),
        ("No description available", False),
        ("<p>The waterfall is quiet.</p>", False),
        ("雪で峠が閉じるため、海沿いの道を使います。", False),
        ("Der Garten ist der schönste von allen und die Leute sind in ihm.", False),
        ("Le jardin est le plus beau de la ville et il est dans le parc.", False),
    ],
)
def test_usable_descriptions(spark, text, usable):
    assert spark.range(1).select(survivorship.usable_english_text(F.lit(text)).alias("u")).first()["u"] is usable


def test_usable_reasons(spark):
    df = spark.createDataFrame([(["", None], False), (["n/a", "?"], False), ([], False), (None, False), (["null", "phone match"], True)], "r array<string>, u boolean")
    assert all(row["u"] == row["got"] for row in df.withColumn("got", survivorship.usable_reasons(F.col("r"))).collect())


def test_survivors_against_brute_force(spark):
    r = random.Random(4)
    t0 = datetime(2025, 1, 1)
    rows = [(r.choice("abcde") if r.random() < 0.6 else "hot", i, t0 + timedelta(hours=r.randrange(50)) if r.random() > 0.05 else None, r.choice([None, "x", ""]), r.choice([None, 0, 1, 2, 99])) for i in range(400)]
    rows += rows[:20] + [(None, 900, t0, "x", 1), ("single", 901, t0, "x", 1), ("single", 901, t0, "x", 1), ("f", None, t0, "x", 1)]
    df = spark.createDataFrame(rows, "g string, id long, t timestamp, v string, trust int").withColumn("field", F.lit("clash"))
    got = {(x["group_key"], x["field"]): x["record_id"] for x in survivorship.survivors(df, "g", "id", "t", {"v": F.col("v") == "x"}, F.col("trust")).collect()}
    want = {}
    for g in {row[0] for row in rows if row[0]}:
        own = {row[1]: row for row in rows if row[0] == g and row[1] is not None}
        good = [row for row in own.values() if row[3] == "x"]
        if len(own) > 1 and good:
            # Policy: later, then more trusted, then the smaller id.
            best = max(good, key=lambda row: (row[2] or datetime(1, 1, 1), row[4] or 0, -row[1]))
            want[g, "v"] = best[1]
    assert got == want
    assert survivorship.survivors(df.limit(0), "g", "id", "t", {"v": F.col("v") == "x"}).count() == 0


def peeled(points, dominates):
    """Layer of each point by taking away the undominated ones again and again."""
    left, out, n = dict(points), {}, 0
    while left:
        n += 1
        top = [k for k, p in left.items() if not any(dominates(q, p) for q in left.values())]
        for k in top:
            out[k] = n
            del left[k]
    return out


@pytest.mark.parametrize("counted", [False, True])
def test_layers_against_peeling(spark, counted):
    r = random.Random(8)
    t0 = datetime(2025, 1, 1)
    rows = [(f"g{i % 3}", f"r{i:03d}", t0 + timedelta(hours=r.randrange(12)), r.randrange(8), r.choice([0, 1, 2, 99])) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, id string, t timestamp, u int, trust int")
    fields = {str(i): F.col("u").bitwiseAND(F.lit(1 << i)) != 0 for i in range(3)}
    for row in survivorship.layers(df, "g", "id", "t", fields, F.col("trust"), 2, counted).collect():
        # Of each cell the latest, of these the smallest id, is what is left of it.
        cells = {}
        for g, key, t, u, trust in rows:
            if g == row["group_key"]:
                old = cells.get((u, trust))
                if old is None or (-t.timestamp(), key) < (-old[0], old[1]):
                    cells[u, trust] = (t.timestamp(), key)
        points = {key: (u, t, trust) for (u, trust), (t, key) in cells.items()}
        whole = lambda a, b: bin(a).count("1") >= bin(b).count("1") if counted else a & b == b  # noqa: B023, E731
        differs = lambda a, b: bin(a).count("1") != bin(b).count("1") if counted else a != b  # noqa: B023, E731
        dominates = lambda a, b: whole(a[0], b[0]) and a[1] >= b[1] and a[2] >= b[2] and (differs(a[0], b[0]) or a[1:] != b[1:])  # noqa: B023, E731
        assert {c["record_id"]: c["layer"] for c in row["cells"]} == peeled(points, dominates)
        assert max(c["layer"] for c in row["cells"]) >= 3


def test_ties_of_string_ids_go_to_the_smaller(spark):
    t0 = datetime(2025, 1, 1)
    df = spark.createDataFrame([("g", "b", t0, "x"), ("g", "a", t0, "x"), ("g", "c", t0, None)], "g string, id string, t timestamp, v string")
    assert survivorship.survivors(df, "g", "id", "t", {"v": F.col("v").isNotNull()}).first()["record_id"] == "a"


def test_golden_records(spark):
    t0 = datetime(2025, 1, 1)
    rows = [
        ("a", 1, t0, "old name", "old text", None), ("a", 2, t0 + timedelta(days=1), "new name", None, None), ("b", 3, t0, None, None, None),
        # Three layers: the newest has the name alone, as has the next; the text is in the second layer, the place in the third.
        ("c", 4, t0 + timedelta(days=9), "n1", None, None), ("c", 5, t0 + timedelta(days=8), None, "t2", None), ("c", 6, t0 + timedelta(days=7), None, None, "p3"), ("c", 7, t0 + timedelta(days=1), "n4", None, None),
    ]
    df = spark.createDataFrame(rows, "g string, id long, t timestamp, name string, text string, place string")
    fields = {f: F.col(f).isNotNull() for f in ("name", "text", "place")}
    got = {r["group_key"]: (r["name"], r["text"], r["place"]) for r in survivorship.golden_records(df, "g", "id", "t", fields).collect()}
    # In group a neither record dominates the other, so the policy takes the later name.
    assert got == {"a": ("new name", "old text", None), "b": (None, None, None), "c": ("n1", "t2", "p3")}
    assert {r["field"]: r["layer"] for r in survivorship.survivors(df.filter("g = 'c'"), "g", "id", "t", fields, None, 2, True).collect()} == {"name": 1, "text": 2, "place": 3}


# Linkage ------------------------------------------------------------------------------------------

W = "qid string, name_ja string, name_en string, name_zh string, name_ko string, coordinates struct<lat:double,lng:double>, phone string, website string, street_address string, postal_code string, id string"
O = "osm_id string, name string, name_en string, name_zh string, name_ko string, coordinates struct<lat:double,lng:double>, phone string, website string, street string, postal_code string, id string"
AT = {"lat": 35.0, "lng": 135.0}


def near(m):
    return {"lat": 35.0 + m / 111_195, "lng": 135.0}


def test_names():
    a, b = establishments.parse_name("オーベルジュ東笹橋亭"), establishments.parse_name("Auberge Higashi-sasabashi-tei")
    assert (a["place"], a["suffix"], a["kind"]) == ("東笹橋", "tei", "auberge")
    assert (b["reading"], b["suffix"], b["kind"]) == ("higashisasabashi", "tei", "auberge")
    assert establishments.parse_name("東銀谷館イン 別館")["annex"] is True
    assert establishments.parse_name("GH 奥灯森荘")["kind"] == "guesthouse"
    assert establishments.phone_key("+81 (0)75-038-6047") == establishments.phone_key("０７５－０３８－６０４７") == "750386047"


def test_link(spark):
    wikidata = [
        ("w1", "ホテル上桐峰", None, None, None, AT, "075-038-6047", "https://www.a1.example/", None, None, "z"),
        ("w2", "旅館奥灯森", "Oku-tomoshimori Ryokan", None, None, AT, None, None, None, None, "z"),
        ("w3", None, None, None, None, None, None, None, None, None, "z"),
        ("w1", "ホテル上桐峰", None, None, None, AT, "075-038-6047", "https://www.a1.example/", None, None, "z"),
        (None, "ホテル上桐峰", None, None, None, AT, None, None, None, None, "z"),
    ]
    osm = [
        ("o1", "HOTEL KAMI-KIRIMINE", None, None, None, near(60), "+81 75 038 6047", "http://a1.example", None, None, "z"),
        ("o2", "ホテル上桐峰 別館", None, None, None, near(30), None, None, None, None, "z"),
        ("o3", "旅館奥灯森", None, None, None, near(80), None, None, None, None, "z"),
        ("o4", "旅館奥灯森", None, None, None, near(90_000), None, None, None, None, "z"),
        ("o5", "民宿柚見", None, None, None, near(5), None, None, None, None, "z"),
        ("o6", "Oku-tomoshimori Ryokan", None, None, None, near(20), None, None, None, None, "z"),
        ("o7", "民宿柚見", None, None, None, near(50_000), "075-038-6047", None, None, None, "z"),
        ("o8", None, None, None, None, {"lat": float("nan"), "lng": 500.0}, "", "", "", "", "z"),
        ("o1", "HOTEL KAMI-KIRIMINE", None, None, None, near(60), "+81 75 038 6047", "http://a1.example", None, None, "z"),
    ]
    left, right = establishments.records(spark.createDataFrame(wikidata, W), WIKIDATA), establishments.records(spark.createDataFrame(osm, O), OSM)
    got = establishments.link(left, right).collect()
    assert {(r["left_id"], r["right_id"]) for r in got} == {("w1", "o1"), ("w2", "o3"), ("w2", "o6")}
    assert all(0.5 < r["confidence"] <= 1.0 for r in got)
    assert establishments.link(left.limit(0), right).count() == 0
    assert establishments.link(left, right.limit(0)).count() == 0


def test_a_common_phone_loses_no_pair(spark):
    """One phone shared by a third of all rows: pairs are found by the narrow forms of the key."""
    place = lambda i: f"{chr(0x5C71 + i % 40)}{chr(0x6771 + i // 40)}"
    wikidata = [(f"w{i}", f"ホテル{place(i)}", None, None, None, near(i * 400), "075-038-6047", None, None, None, "z") for i in range(60)]
    osm = [(f"o{i}", f"ホテル{place(i)}", None, None, None, near(i * 400 + 50), "075-038-6047", None, None, None, "z") for i in range(60)]
    left, right = establishments.records(spark.createDataFrame(wikidata, W), WIKIDATA), establishments.records(spark.createDataFrame(osm, O), OSM)
    assert {(r["left_id"], r["right_id"]) for r in establishments.link(left, right).collect()} == {(f"w{i}", f"o{i}") for i in range(60)}


def parsed(spark, wikidata, osm):
    left, right = establishments.records(spark.createDataFrame(wikidata, W), WIKIDATA), establishments.records(spark.createDataFrame(osm, O), OSM)
    learned = establishments.readings_of(left, right)
    return left.join(learned, "place", "left"), right.join(learned, "place", "left")


def missed(left, right):
    """Pairs that could be accepted, by evidence of all pairs, and those of them that are no candidates, whatever counts as a crowded block."""
    named = lambda df, p: df.select(*[F.col(n).alias(f"{p}_{n}") for n in df.columns])
    every = establishments.evidence(named(left, "l").crossJoin(named(right, "r"))).filter(F.col("score") >= establishments.ENOUGH - establishments.TWIN)
    every = {(r["l_id"], r["r_id"]) for r in every.select("l_id", "r_id").collect()}
    lost = set()
    for common in (0, establishments.COMMON):
        lost |= every - {(r["lid"], r["rid"]) for r in establishments.candidates(left, right, common).select("lid", "rid").collect()}
    return every, lost


def test_a_common_phone_loses_no_pair_without_names_or_positions(spark):
    """A phone, a site and a street shared by all rows, with more pairs than COMMON; every other row has a name, and no row a position."""
    name = lambda i, w: f"{w}{chr(0x5C71 + i)}{chr(0x6771 + i)}" if i % 2 else None
    wikidata, osm = [], []
    for mark, at in ((1, ("075-038-6047", None, None)), (2, (None, "https://chain.example", None)), (3, (None, None, "東1-2-3"))):
        wikidata += [(f"w{mark}-{i}", name(i, "ホテル"), None, None, None, None, *at, f"{mark}00-{i // 2:04d}", "z") for i in range(50)]
        osm += [(f"o{mark}-{i}", name(i + 1, "ホテル"), None, None, None, None, *at, f"{mark}00-{i // 2:04d}" if i % 3 else None, "z") for i in range(50)]
    every, lost = missed(*parsed(spark, wikidata, osm))
    assert {pair[0][1] for pair in every} == set("123") and not lost
    # The pair of the review: one phone and one postal code, no name on one side, no position; here of 900 pairs.
    wikidata = [(f"w{i}", None, None, None, None, None, "075-038-6047", None, None, f"100-{i:04d}", "z") for i in range(30)]
    osm = [(f"o{i}", name(1, "ホテル"), None, None, None, None, "075-038-6047", None, None, f"100-{i:04d}", "z") for i in range(30)]
    left, right = (establishments.records(spark.createDataFrame(rows, t), c) for rows, t, c in ((wikidata, W, WIKIDATA), (osm, O, OSM)))
    assert {(f"w{i}", f"o{i}") for i in range(30)} <= {(r["left_id"], r["right_id"]) for r in establishments.link(left, right).collect()}


def test_candidates_hold_all_that_evidence_credits(spark):
    r = random.Random(5)
    names = ["オーベルジュ楓坂", "オーベルジュ坂", "旅館奥灯森荘", "旅館奥森荘", "旅館灯荘", "ホテル上桐峰", "Kami-kirimine Hotel", "Kami-kirmine Hotel", "Kami-kimine Hotel", "호텔 가미", "グランドホテル", "民宿柚見", None, None, ""]
    maybe = lambda v: v if r.random() < 0.4 else None

    def row(key):
        at = maybe({"lat": 35.0 + r.choice((0, 100, 1300, 4000)) / 111_195, "lng": 135.0 + r.choice((0, 100, 1450, 4000)) / 91_085})
        return (key, r.choice(names), maybe(r.choice(("Kaedezaka Auberge", "Oku-tomoshimori Ryokan", "Kamikirimine"))), None, maybe("호텔 가미"), at, maybe(f"075-038-60{r.randrange(10, 13)}"), maybe(f"https://www.{r.choice(('kamikirimine2', 'kaedezaka', 'a1'))}.example"), maybe(f"東{r.randrange(2)}-2"), maybe(f"100-000{r.randrange(3)}"), "z")

    every, lost = missed(*parsed(spark, [row(f"w{i}") for i in range(250)], [row(f"o{i}") for i in range(250)]))
    assert len(every) > 1000 and not lost
    # Alone at their place: a letter or two dropped, in a place of two, in Latin letters, at any point.
    pairs = [("オーベルジュ楓坂", "オーベルジュ坂"), ("旅館奥灯森荘", "旅館灯荘"), ("Kami-kirimine Hotel", "Ami-kirimine Hotel"), ("Kami-kirimine Hotel", "Kami-kirimin Hotel"), ("Kami-kirimine Hotel", "Kami-kimine Hotel"), ("旅館森荘", "旅館奥灯森荘")]
    pairs += [(b, a) for a, b in pairs]
    lone = [(f"{side}{n}", pair[k], None, None, None, near(50_000 * n + 60 * k), None, None, None, f"100-{n:04d}", "z") for n, pair in enumerate(pairs) for k, side in enumerate("wo")]
    every, lost = missed(*parsed(spark, lone[::2], lone[1::2]))
    assert len(every) >= 10 and not lost


@pytest.mark.parametrize("common", [0, 30, 10_000])
def test_links_do_not_depend_on_what_counts_as_crowded(spark, common):
    """25 records a side with one phone, each pair with a postal code of its own; and rivals that put each other down."""
    wikidata = [(f"w{i}", None, None, None, None, None, "075-038-6047", None, None, f"100-{i:04d}", "z") for i in range(25)]
    osm = [(f"o{i}", "ホテル山東" if i % 2 else None, None, None, None, None, "075-038-6047", None, None, f"100-{i:04d}", "z") for i in range(25)]
    wikidata += [("x1", "旅館奥灯森", None, None, None, AT, "075-111-2222", "a.example", None, None, "z")]
    osm += [("y1", "旅館奥灯森", None, None, None, near(10), "075-111-2222", "a.example", None, None, "z"), ("y2", "旅館奥灯", None, None, None, near(20), None, None, None, None, "z"), ("y3", "旅館奥灯森", None, None, None, near(30), None, None, None, None, "z")]
    left, right = (establishments.records(spark.createDataFrame(rows, t), c) for rows, t, c in ((wikidata, W, WIKIDATA), (osm, O, OSM)))
    got = {(r["left_id"], r["right_id"]) for r in establishments.link(left, right, common=common).collect()}
    assert got == {(f"w{i}", f"o{i}") for i in range(25)} | {("x1", "y1"), ("x1", "y3")}


def test_cells_reach_far_enough(spark):
    r = random.Random(7)
    rows = [(lat, r.uniform(-180, 180)) for lat in (0.0, 35.0, 60.0, 80.0, 87.9, 89.995, -70.0) for _ in range(4)] + [(35.0, 179.9999), (35.0, -179.9999), (-60.0, 179.999)]
    moved = [(a, b, max(-90.0, min(90.0, a + d * math.cos(t))), ((b + d * math.sin(t) / max(1e-3, math.cos(math.radians(a))) + 180) % 360) - 180) for a, b in rows for t in (0, 1, 1.57, 2, 3, 4, 4.71, 5) for d in (1490 / 111_195, 140 / 111_195)]
    df = spark.createDataFrame(moved, "a double, b double, c double, d double")
    for radius, degrees in ((establishments.NEAR_M, establishments.NEAR_CELL), (establishments.OFF_M, establishments.OFF_CELL)):
        from_a = df.withColumns({"lat": F.col("a"), "lng": F.col("b")}).withColumn("around", establishments._cells(radius, degrees, True))
        both = from_a.withColumns({"lat": F.col("c"), "lng": F.col("d")}).withColumn("own", establishments._cells(radius, degrees, False))
        close = both.filter(establishments.haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")) <= radius)
        assert close.count() > 50 and close.filter(~F.arrays_overlap("around", "own")).count() == 0


def test_a_hub_is_not_shuffled_to_one_task(spark, monkeypatch):
    """The edges of a hub meet its minimum by a broadcast of few rows; only the edges of other nodes are shuffled by node."""
    hub = [(f"x{i:05d}", "m") for i in range(3000)] + [(f"y{i}", f"z{i}") for i in range(100)]
    edges = spark.createDataFrame([(max(p), min(p)) for p in hub], "u string, v string")
    monkeypatch.setattr(components, "HUB_EDGES", 100)
    for large in (True, False):
        star = components._star(edges, large, edges.count())
        plan = star._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan
    low = edges.groupBy(F.col("v").alias("n")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    assert low.filter(F.col("degree") > max(3100 * components.HUB_SHARE, components.HUB_EDGES)).count() == 1
    pairs = [(b, a) for a, b in hub] + [("a", "x00005"), ("m", "zz")]
    assert run_components(spark, pairs) == union_find(pairs)
