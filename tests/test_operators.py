"""Operators against brute force on small and awkward tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meguri.operators import incremental, neighbours, quality, resolve, spatial
from meguri.sources import files
from meguri.streaming import upsert

POINTS = "id long, coordinates struct<lat:double,lng:double>, note string"


def metres(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(min(1.0, h)))


def cloud(seed, n):
    r = random.Random(seed)
    centres = [(35.0, 135.0), (89.9995, 10.0), (-89.999, 0.0), (0.0, 179.9999), (0.0, -179.9999), (60.0, 0.0)]
    out = []
    for _ in range(n):
        lat, lng = r.choice(centres)
        lng += r.uniform(-0.01, 0.01) / max(0.001, math.cos(math.radians(lat)))
        out.append((max(-90.0, min(90.0, lat + r.uniform(-0.01, 0.01))), (lng + 180) % 360 - 180))
    return out


@pytest.mark.parametrize("radius", [50.0, 500.0, 3000.0])
def test_within_distance_against_all_pairs(spark, radius):
    a, b = cloud(1, 150), cloud(2, 120)
    bad = [(None, None), (float("nan"), 1.0), (95.0, 10.0), (10.0, 190.0)]
    rows = lambda ps, base: [(base + i, {"lat": p[0], "lng": p[1]} if p[0] is not None else None, "x") for i, p in enumerate(ps)]
    left = spark.createDataFrame(rows(a + bad, 0) + rows(a[:5], 0) + [(None, {"lat": 35.0, "lng": 135.0}, None)], POINTS)
    right = spark.createDataFrame(rows(b + bad, 1000), POINTS)
    got = {(r["left_key"], r["right_key"]) for r in spatial.within_distance(left, right, radius, "id", "id").collect()}
    assert got == {(i, 1000 + j) for (i, p), (j, q) in itertools.product(enumerate(a), enumerate(b)) if metres(p, q) <= radius}


def test_within_distance_of_nothing(spark):
    none = spark.createDataFrame([], POINTS)
    some = spark.createDataFrame([(1, {"lat": 1.0, "lng": 1.0}, "")], POINTS)
    assert spatial.within_distance(none, some, 10.0, "id", "id").count() == 0
    assert spatial.within_distance(some, none, 10.0, "id", "id").count() == 0


def test_one_crowded_place(spark):
    crowd = spark.range(2000).select(F.col("id"), F.struct(F.lit(35.0).alias("lat"), F.lit(135.0).alias("lng")).alias("coordinates"), F.lit("").alias("left_key"))
    one = spark.createDataFrame([(7, {"lat": 35.0, "lng": 135.0}, "")], POINTS)
    assert spatial.within_distance(crowd, one, 10.0, "id", "id").count() == 2000


def test_in_region(spark):
    ps = cloud(3, 300)
    boxes = [(1, 34.995, 35.004, 134.99, 135.002), (2, -0.02, 0.003, 179.995, -179.995), (3, 89.99, 90.0, -180.0, 180.0), (4, 10.0, 5.0, 0.0, 1.0), (5, None, 5.0, 0.0, 1.0)]
    left = spark.createDataFrame([(i, {"lat": p[0], "lng": p[1]}, "") for i, p in enumerate(ps)], POINTS)
    regions = spark.createDataFrame(boxes, "id long, south double, north double, west double, east double")
    inside = lambda p, b: b[1] is not None and b[1] <= p[0] <= b[2] and (b[3] <= p[1] <= b[4] if b[3] <= b[4] else p[1] >= b[3] or p[1] <= b[4])
    got = {tuple(r) for r in spatial.in_region(left, regions, "id", "id", level=12).collect() if r["region_key"] != 3}
    assert got == {(i, b[0]) for i, p in enumerate(ps) for b in boxes if b[0] != 3 and inside(p, b)}


def test_grid_pairs_and_nearest(spark):
    r = random.Random(5)
    a, b = [[(i, 35 + r.uniform(0, 0.02), 135 + r.uniform(0, 0.02)) for i in range(n)] for n in (60, 80)]
    schema = "key long, lat double, lng double"
    pairs = neighbours.grid_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 100.0)
    assert {(x["left_key"], x["right_key"]) for x in pairs.collect()} == {(p[0], q[0]) for p in a for q in b if metres(p[1:], q[1:]) <= 100}
    top = neighbours.nearest(pairs, 2).collect()
    assert all(x["rank"] <= 2 for x in top)
    with pytest.raises(ValueError):
        neighbours.nearest_centroid(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), most_centroids=10)


@pytest.mark.parametrize(("lat", "lng"), [(75.0, 20.0), (-70.0, 179.9999), (89.9999, 0.0), (0.0, -180.0)])
def test_grid_pairs_at_every_latitude(spark, lat, lng):
    r = random.Random(11)
    wide = 0.0012 / max(1e-3, math.cos(math.radians(lat)))
    a, b = [[(i, min(90.0, lat + r.uniform(-0.001, 0.001)), ((lng + r.uniform(-wide, wide) + 180) % 360) - 180) for i in range(n)] for n in (40, 50)]
    schema = "key long, lat double, lng double"
    got = {(x["left_key"], x["right_key"]) for x in neighbours.grid_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 100.0).collect()}
    assert got == {(p[0], q[0]) for p in a for q in b if metres(p[1:], q[1:]) <= 100} and got


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        a, b = find(x), find(y)
        parent[max(a, b)] = min(a, b)
    return {(n, find(n)) for n in nodes}


def test_clusters(spark):
    r = random.Random(3)
    nodes = list(range(200))
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(5, 5)]
    got = resolve.clusters(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {tuple(x) for x in got} == components(nodes, edges)


def test_fold_and_medians(spark):
    m = spark.createDataFrame([("c", 2, "ab", None), ("c", 1, "xy", "p"), ("c", 3, None, "q"), ("d", 4, None, None)], "cluster string, member long, name string, phone string")
    got = {r["cluster"]: r for r in resolve.fold_clusters(m, ["phone"]).collect()}
    assert (got["c"]["name"], got["c"]["phone"], got["c"]["confidence"]) == ("xy", "p", "confirmed")
    assert (got["d"]["name"], got["d"]["confidence"]) == (None, "singleton")
    assert spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int").agg(quality.upper_median(F.col("v")).alias("m")).first()["m"] == 3


def test_breadth_first_and_runs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    got = {tuple(r) for r in incremental.reach(e, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    ev = spark.createDataFrame([("u", i, x) for i, x in enumerate([True, True, False, True, None, True, True, True])] + [("v", 0, False)], "u string, i int, f boolean")
    assert {tuple(r) for r in incremental.longest_run(ev, "u", ["i"], F.col("f")).collect()} == {("u", 3), ("v", 0)}


@pytest.mark.parametrize(("n", "age", "wanted"), [(10, 5.0, 30), (2800, 5.0, 100), (2800, 56.0, 130), (1400, 42.0, 75), (1400, None, 130)])
def test_batch(spark, n, age, wanted):
    got = spark.range(1).select(incremental.recommended_batch(F.lit(n), F.lit(age).cast("double")).alias("b")).first()["b"]
    assert got == wanted


def test_json_sources(spark, tmp_path):
    from pyspark.sql import types as T

    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{broken\n{"a": 2}\n')
    schema = T.StructType([T.StructField("a", T.LongType())])
    rows, counts = files.json_lines_counted(spark, str(p), schema)
    assert sorted(r["a"] for r in rows.collect()) == [1, 2]
    assert tuple(counts.first()) == (2, 1)
    loose = spark.createDataFrame([('```json\n[{"a": 1}, {"a": 2}\n{"a": 3}]\n```',)], "t string")
    assert sorted(r["a"] for r in files.lenient_records(loose, "t", "a long").collect()) == [1, 2, 3]


def test_half_matrix(spark, tmp_path):
    m = np.array([[1.0, 2.0], [0.5, -1.0]], "<f2")
    (tmp_path / "m.f16").write_bytes(m.tobytes())
    got = files.half_matrix(spark, str(tmp_path / "m.f16"), 2).orderBy("row").collect()
    assert [list(r["vector"]) for r in got] == m.astype(float).tolist()


def test_stream_upsert_breaker_and_windows(spark, tmp_path):
    src = tmp_path / "in"
    ev = spark.createDataFrame([(i, "u" if i % 2 else "v", i % 3 != 0) for i in range(12)], "i long, k string, bad boolean")
    ev.filter("i < 6").coalesce(1).write.parquet(str(src / "a"))
    ev.filter("i >= 6").coalesce(1).write.parquet(str(src / "b"))
    stream = lambda: spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(str(src))
    upsert.upsert_stream(stream(), str(tmp_path / "out"), ["k"], [F.desc("i")], str(tmp_path / "ck")).awaitTermination()
    assert {(r["k"], r["i"]) for r in upsert.read_upserted(spark, str(tmp_path / "out")).collect()} == {("u", 11), ("v", 10)}
    q = upsert.breaker_stream(stream(), "k", "bad", 2).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert all(r["run"] == 2 for r in spark.sql("select * from fired").collect())


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_match_decision_against_plain_version(spark):
    r = random.Random(6)
    names = ["桜", "桜ホテル", "桜別邸本館東", "桜別邸本館西", "ume inn north", "Ume North", None, "株式会社 桜 別邸・本館東"]
    rows = [(r.choice(names), r.choice(names), r.choice([None, "075-1", "0751"]), r.choice([None, "0751", "2"])) for _ in range(120)]
    df = spark.createDataFrame(rows, "a string, b string, p string, q string")
    import re

    def key(n):
        n = re.sub(r"株式会社", "", n or "")
        n = re.sub(r"ホテル|hotel|旅館|ryokan|inn", "", n, flags=re.I)
        return re.sub(r"[\s　・]", "", n).lower()

    def want(a, b, p, q):
        p, q = re.sub(r"\D", "", p or ""), re.sub(r"\D", "", q or "")
        if p and p == q:
            return "confirmed"
        x, y = key(a), key(b)
        s = 1 - edit_distance(x, y) / max(len(x), len(y)) if x and y else 0
        return "confirmed" if s >= 0.9 else "review" if s >= 0.65 else None

    got = df.withColumn("v", resolve.match_decision(F.col("p"), F.col("q"), F.col("a"), F.col("b"))).collect()
    assert [x["v"] for x in got] == [want(*row) for row in rows]
