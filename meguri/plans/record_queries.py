"""Queries over records: merges, neighbours, resolution, coverage, increments, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from meguri.functions import classify, text
from meguri.functions.cells import haversine_m
from meguri.operators import incremental, merge, neighbours, quality, resolve
from meguri.plans.queries import query
from meguri.session import table

#: The moment that ages are taken from.
NOW = "2026-06-01 00:00:00"
HAVERSINE_SQL = "2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2))))"


def _points(df: DataFrame, key: str) -> DataFrame:
    ok = (F.col("lat").between(-90, 90)) & (F.col("lng").between(-180, 180)) & ~F.isnan("lat") & ~F.isnan("lng")
    return df.select(F.col(key).alias("key"), F.col("coordinates.lat").alias("lat"), F.col("coordinates.lng").alias("lng")).filter(ok).distinct()


def _points_sql(name: str, key: str) -> str:
    return f"(SELECT DISTINCT {key} AS key, coordinates.lat AS lat, coordinates.lng AS lng FROM {name} WHERE coordinates.lat BETWEEN -90 AND 90 AND coordinates.lng BETWEEN -180 AND 180 AND NOT isnan(coordinates.lat) AND NOT isnan(coordinates.lng))"


# Merges -----------------------------------------------------------------------------------------


@query("""
    WITH a AS (SELECT DISTINCT record_id, qid, name_en, description_en FROM attractions), d AS (SELECT qid, min(descriptions['en']) AS en FROM description_rows GROUP BY qid)
    SELECT record_id, a.qid, name_en, coalesce(nullif(d.en, ''), nullif(a.description_en, '')) AS description_en FROM a LEFT JOIN d USING (qid)
""")
def merge_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-01: attractions with descriptions overwritten by the better source where it has one."""
    base = table(spark, sf_dir, "attractions").select("record_id", "qid", "name_en", "description_en").distinct()
    add = table(spark, sf_dir, "description_rows").groupBy("qid").agg(F.min(F.element_at("descriptions", "en")).alias("description_en"))
    return merge.overwrite(base, add, "qid", ["description_en"]).select("record_id", "qid", "name_en", "description_en")


@query("""
    WITH r AS (SELECT qid, min(name_en) FILTER (source_anchor = 'v2') AS a_en, min(name_en) FILTER (source_anchor <> 'v2') AS b_en, min(admin_code) FILTER (source_anchor = 'v2') AS a_admin, min(admin_code) FILTER (source_anchor <> 'v2') AS b_admin,
                      bool_or(source_anchor = 'v2') AS has_a, bool_or(source_anchor <> 'v2') AS has_b FROM attractions WHERE source_anchor IS NOT NULL GROUP BY qid)
    SELECT qid, coalesce(a_en, b_en) AS name_en, coalesce(a_admin, b_admin) AS admin_code, CASE WHEN has_a AND has_b THEN 'other+v2' WHEN has_a THEN 'v2' ELSE 'other' END AS anchor FROM r
""")
def merge_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-02, SET-03: full outer merge of two harvests; the base wins, origins are joined."""
    a = table(spark, sf_dir, "attractions").filter("source_anchor is not null")
    side = lambda df, name: df.groupBy("qid").agg(F.min("name_en").alias("name_en"), F.min("admin_code").alias("admin_code"), F.array_distinct(F.flatten(F.collect_list("types"))).alias("types")).withColumn("anchor", F.lit(name))
    merged = merge.merge_records(side(a.filter("source_anchor = 'v2'"), "v2"), side(a.filter("source_anchor <> 'v2'"), "other"), "qid", ["name_en", "admin_code"], ["types"], "anchor")
    return merged.select("qid", "name_en", "admin_code", "anchor")


@query("""
    WITH t AS (SELECT qid, unnest(types) AS tag FROM attractions UNION ALL SELECT qid, unnest(heritage_designations) FROM attractions)
    SELECT s.qid, array_to_string(list_sort(list_distinct(list(t.tag) FILTER (t.tag IS NOT NULL))), ',') AS tags FROM (SELECT DISTINCT qid FROM attractions) s LEFT JOIN t USING (qid) GROUP BY s.qid
""")
def tags_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-03, SET-01: tags of two sources united and joined to the master."""
    a = table(spark, sf_dir, "attractions")
    tags = a.select("qid", F.explode("types").alias("tag")).unionByName(a.select("qid", F.explode("heritage_designations").alias("tag")))
    sets = tags.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return a.select("qid").distinct().join(sets, "qid", "left").select("qid", "tags")


@query("SELECT DISTINCT qid FROM attractions a WHERE EXISTS (SELECT 1 FROM description_rows d WHERE d.qid = a.qid)")
def semi_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-04: attractions that have descriptions."""
    return table(spark, sf_dir, "attractions").join(table(spark, sf_dir, "description_rows"), "qid", "left_semi").select("qid").distinct()


@query("SELECT DISTINCT qid FROM attractions a WHERE NOT EXISTS (SELECT 1 FROM description_rows d WHERE d.qid = a.qid)")
def anti_undescribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-05: attractions that have none."""
    return table(spark, sf_dir, "attractions").join(table(spark, sf_dir, "description_rows"), "qid", "left_anti").select("qid").distinct()


@query("SELECT record_id, id, name, phone FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY matched_at DESC, record_id) AS r FROM (SELECT DISTINCT record_id, id, name, phone, matched_at FROM matched_hotels)) WHERE r = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-06, SNK-03, WIN-04, WIN-06: the newest run's record of each id; ties by record."""
    rows = table(spark, sf_dir, "matched_hotels").select("record_id", "id", "name", "phone", "matched_at").distinct()
    return merge.latest(rows, ["id"], [F.desc("matched_at"), F.asc("record_id")]).select("record_id", "id", "name", "phone")


@query("""
    WITH a AS (SELECT qid, max(description_en) AS old FROM attractions GROUP BY qid), d AS (SELECT qid, min(descriptions['en']) AS new FROM description_rows GROUP BY qid)
    SELECT qid, CASE WHEN coalesce(new <> '', false) AND (NOT coalesce(old <> '', false) OR length(new) > length(old) * 1.4) THEN new ELSE old END AS description_en FROM a LEFT JOIN d USING (qid)
""")
def length_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-16: a description is replaced by one longer by more than 1.4 times."""
    a = table(spark, sf_dir, "attractions").groupBy("qid").agg(F.max("description_en").alias("old"))
    d = table(spark, sf_dir, "description_rows").groupBy("qid").agg(F.min(F.element_at("descriptions", "en")).alias("new"))
    return a.join(d, "qid", "left").select("qid", merge.longer_text(F.col("old"), F.col("new")).alias("description_en"))


@query("""
    WITH s AS (SELECT prefecture_code AS pc, admin_code, count(*) AS n FROM stations WHERE prefecture_code <> '' AND admin_code IS NOT NULL GROUP BY ALL), f AS (SELECT admin_code, arg_max(pc, (n, pc)) AS fix FROM s GROUP BY admin_code)
    SELECT DISTINCT record_id, coalesce(f.fix, a.prefecture_code) AS prefecture_code FROM attractions a LEFT JOIN f USING (admin_code)
""")
def rehome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-17, JOIN-20: rows moved to the prefecture that a table of corrections names."""
    s = table(spark, sf_dir, "stations").filter("prefecture_code <> '' and admin_code is not null").groupBy("prefecture_code", "admin_code").agg(F.count(F.lit(1)).alias("n"))
    fix = s.groupBy("admin_code").agg(F.max_by("prefecture_code", F.struct("n", "prefecture_code")).alias("fix"))
    a = table(spark, sf_dir, "attractions").select("record_id", "admin_code", "prefecture_code")
    return a.join(fix, "admin_code", "left").select("record_id", F.coalesce("fix", "prefecture_code").alias("prefecture_code")).distinct()


@query("SELECT qid, coalesce(nullif(descriptions['zh'], ''), nullif(descriptions['ja'], '')) AS text, array_to_string(list_filter(['ja', 'en', 'zh', 'ko', 'fr'], lambda k: coalesce(trim(descriptions[k]) = '', true)), ',') AS missing FROM (SELECT DISTINCT qid, descriptions FROM description_rows)")
def language_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-01, MAP-02, TOOL-08, TOOL-09: the text in a language with a fallback, and the languages that are missing."""
    d = F.col("descriptions")
    rows = table(spark, sf_dir, "description_rows").select("qid", d)
    return rows.select("qid", merge.pick_language(d, "zh").alias("text"), F.array_join(merge.missing_languages(d, ["ja", "en", "zh", "ko", "fr"]), ",").alias("missing")).distinct()


@query("""
    WITH a AS (SELECT qid, max(name_en) AS en, max(name_ko) AS ko, max(name_zh) AS zh FROM attractions GROUP BY qid), d AS (SELECT qid, min(descriptions['en']) AS en, min(descriptions['ko']) AS ko, min(descriptions['zh']) AS zh FROM description_rows GROUP BY qid),
         l AS (SELECT qid, 'en' AS lang, nullif(a.en, '') AS x, nullif(d.en, '') AS y FROM a LEFT JOIN d USING (qid) UNION ALL SELECT qid, 'ko', nullif(a.ko, ''), nullif(d.ko, '') FROM a LEFT JOIN d USING (qid) UNION ALL SELECT qid, 'zh', nullif(a.zh, ''), nullif(d.zh, '') FROM a LEFT JOIN d USING (qid))
    SELECT qid, lang, coalesce(x, y) AS text, CASE WHEN x IS NOT NULL THEN 'name' WHEN y IS NOT NULL THEN 'description' END AS source FROM l
""")
def layered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-03, MAP-04, MAP-05: of each language the text of the first source that has one, with the source."""
    a = table(spark, sf_dir, "attractions").groupBy("qid").agg(F.create_map(F.lit("en"), F.max("name_en"), F.lit("ko"), F.max("name_ko"), F.lit("zh"), F.max("name_zh")).alias("names"))
    d = table(spark, sf_dir, "description_rows").groupBy("qid").agg(F.create_map(*[x for k in ("en", "ko", "zh") for x in (F.lit(k), F.min(F.element_at("descriptions", k)))]).alias("texts"))
    both = a.join(d, "qid", "left").select("qid", F.explode(merge.layered(["en", "ko", "zh"], ("name", F.col("names")), ("description", F.col("texts")))).alias("lang", "v"))
    return both.select("qid", "lang", F.col("v.text").alias("text"), F.col("v.source").alias("source"))


@query("""
    SELECT qid, min_by(name_ja, record_id) FILTER (name_ja IS NOT NULL) AS name_ja, min_by(name_en, record_id) FILTER (name_en IS NOT NULL) AS name_en, array_to_string(list_sort(list_distinct(flatten(list(types) FILTER (types IS NOT NULL)))), ',') AS types
    FROM (SELECT DISTINCT record_id, qid, name_ja, name_en, types FROM attractions) GROUP BY qid
""")
def binding_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09, SRC-10: many rows of an entity folded into one; first value of each column, union of types."""
    rows = table(spark, sf_dir, "attractions").select("record_id", "qid", "name_ja", "name_en", "types").distinct()
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("record_id"))).alias(c)
    folded = rows.groupBy("qid").agg(first("name_ja"), first("name_en"), F.flatten(F.collect_list("types")).alias("t"))
    return folded.select("qid", "name_ja", "name_en", F.when(F.size("t") > 0, F.array_join(F.array_sort(F.array_distinct("t")), ",")).alias("types"))


@query("SELECT source, key, name, lat, lng FROM (SELECT DISTINCT 'wikidata' AS source, qid AS key, coalesce(name_ja, name_en) AS name, coordinates.lat AS lat, coordinates.lng AS lng FROM wikidata_hotels UNION ALL SELECT DISTINCT 'osm', osm_id, coalesce(name, name_en), coordinates.lat, coordinates.lng FROM osm_hotels)")
def hotel_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01, SET-02, PRJ-01, RET-06: both hotel sources under one schema."""
    w = table(spark, sf_dir, "wikidata_hotels").select(F.lit("wikidata").alias("source"), F.col("qid").alias("key"), F.coalesce("name_ja", "name_en").alias("name"), F.col("coordinates.lat").alias("lat"), F.col("coordinates.lng").alias("lng"))
    o = table(spark, sf_dir, "osm_hotels").select(F.lit("osm").alias("source"), F.col("osm_id").alias("key"), F.coalesce("name", "name_en").alias("name"), F.col("coordinates.lat").alias("lat"), F.col("coordinates.lng").alias("lng"))
    return w.distinct().unionByName(o.distinct())


# Neighbours -------------------------------------------------------------------------------------

GRID_SQL = f"SELECT l.key AS left_key, r.key AS right_key, {HAVERSINE_SQL.format(a='l.', b='r.')} AS d FROM {{left}} l JOIN {{right}} r ON r.lat BETWEEN l.lat - {{deg}} AND l.lat + {{deg}}"


@query(f"""
    WITH p AS ({GRID_SQL.format(left=_points_sql('wikidata_hotels', 'qid'), right=_points_sql('osm_hotels', 'osm_id'), deg=0.002)})
    SELECT left_key, right_key, round(d, 3) AS distance_m FROM p WHERE d <= 100
""")
def grid_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-07, GEO-01, GEO-03: hotels of two sources within 100 m, by grid cells wide enough at every latitude."""
    pairs = neighbours.grid_pairs(_points(table(spark, sf_dir, "wikidata_hotels"), "qid"), _points(table(spark, sf_dir, "osm_hotels"), "osm_id"), 100.0)
    return pairs.select("left_key", "right_key", F.round("distance_m", 3).alias("distance_m"))


@query(f"""
    WITH p AS ({GRID_SQL.format(left=_points_sql('attractions', 'record_id'), right=_points_sql('stations', 'qid'), deg=0.05)}),
         r AS (SELECT *, row_number() OVER (PARTITION BY left_key ORDER BY d, right_key) AS r FROM p WHERE d <= 5000)
    SELECT left_key AS record_id, right_key AS station_qid, round(d)::INT AS distance_m, round_even(d / 80, 0)::INT AS walk_minutes FROM r WHERE r = 1
""")
def nearest_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-09, WIN-02, GEO-04, TOOL-06: the nearest station within 5 km, with minutes on foot."""
    pairs = neighbours.grid_pairs(_points(table(spark, sf_dir, "attractions"), "record_id"), _points(table(spark, sf_dir, "stations"), "qid"), 5000.0)
    best = neighbours.nearest(pairs, 1)
    return best.select(F.col("left_key").alias("record_id"), F.col("right_key").alias("station_qid"), F.round("distance_m").cast("int").alias("distance_m"), neighbours.walk_minutes(F.col("distance_m")).alias("walk_minutes"))


@query(f"""
    WITH p AS ({GRID_SQL.format(left=_points_sql('stations', 'qid'), right=_points_sql('shukubo_at', 'key').replace('shukubo_at', 'osm_hotels').replace('key AS key', 'osm_id AS key'), deg=0.02)}),
         r AS (SELECT *, row_number() OVER (PARTITION BY left_key ORDER BY d, right_key) AS r FROM p WHERE d <= 1500)
    SELECT left_key AS station_qid, right_key AS osm_id, r AS rank FROM r WHERE r <= 5
""")
def five_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-10, WIN-03: the five nearest hotels of each station within 1500 m."""
    pairs = neighbours.grid_pairs(_points(table(spark, sf_dir, "stations"), "qid"), _points(table(spark, sf_dir, "osm_hotels"), "osm_id"), 1500.0)
    return neighbours.nearest(pairs, 5).select(F.col("left_key").alias("station_qid"), F.col("right_key").alias("osm_id"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""
    WITH c AS (SELECT prefecture_code AS key, avg(coordinates.lat) AS lat, avg(coordinates.lng) AS lng FROM stations WHERE prefecture_code <> '' AND coordinates.lat BETWEEN 20 AND 50 AND coordinates.lng BETWEEN 120 AND 150 GROUP BY prefecture_code),
         d AS (SELECT p.key, c.key AS centroid, {HAVERSINE_SQL.format(a='p.', b='c.')} AS d FROM {_points_sql('osm_hotels', 'osm_id')} p, c),
         m AS (SELECT key, min(d) AS d FROM d GROUP BY key)
    SELECT m.key AS osm_id, CASE WHEN m.d <= 30000 THEN min(d.centroid) END AS prefecture_code FROM m JOIN d ON d.key = m.key AND d.d = m.d GROUP BY m.key, m.d
""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-11, GEO-05: the prefecture whose centroid is nearest, null beyond 30 km."""
    s = table(spark, sf_dir, "stations").filter("prefecture_code <> '' and coordinates.lat between 20 and 50 and coordinates.lng between 120 and 150")
    centroids = s.groupBy(F.col("prefecture_code").alias("key")).agg(F.avg("coordinates.lat").alias("lat"), F.avg("coordinates.lng").alias("lng"))
    points = _points(table(spark, sf_dir, "osm_hotels"), "osm_id")
    return neighbours.nearest_centroid(points, centroids).select(F.col("key").alias("osm_id"), F.col("centroid").alias("prefecture_code"))


@query(f"""
    WITH a AS (SELECT DISTINCT record_id, name_ja, coordinates.lat AS lat, coordinates.lng AS lng FROM attractions WHERE name_ja <> '' AND coordinates.lat BETWEEN -90 AND 90 AND coordinates.lng BETWEEN -180 AND 180),
         s AS (SELECT DISTINCT qid, name_ja, coordinates.lat AS lat, coordinates.lng AS lng FROM stations WHERE name_ja <> '' AND coordinates.lat BETWEEN -90 AND 90 AND coordinates.lng BETWEEN -180 AND 180),
         p AS (SELECT s.qid, a.record_id, {HAVERSINE_SQL.format(a='s.', b='a.')} AS d FROM s JOIN a ON a.lat BETWEEN s.lat - 0.003 AND s.lat + 0.003 AND substring(s.name_ja, 1, 1) = substring(a.name_ja, 1, 1)),
         r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, record_id) AS r FROM p WHERE d <= 200)
    SELECT s.qid, r.record_id FROM (SELECT DISTINCT qid FROM s) s LEFT JOIN r ON s.qid = r.qid AND r.r = 1
""")
def match_or_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-08, JOIN-15: the nearest record within 200 m whose name begins alike; unmatched ones stay for insertion."""
    initial = lambda c: F.substring(c, 1, 1)
    named = lambda df, key: df.filter("name_ja <> '' and coordinates.lat between -90 and 90 and coordinates.lng between -180 and 180").select(F.struct(F.col(key).alias("id"), initial("name_ja").alias("i")).alias("key"), F.col("coordinates.lat").alias("lat"), F.col("coordinates.lng").alias("lng")).distinct()
    s, a = named(table(spark, sf_dir, "stations"), "qid"), named(table(spark, sf_dir, "attractions"), "record_id")
    pairs = neighbours.grid_pairs(s, a, 200.0).filter("left_key.i = right_key.i").select(F.col("left_key.id").alias("left_key"), F.col("right_key.id").alias("right_key"), "distance_m")
    best = neighbours.nearest(pairs, 1)
    return s.select(F.col("key.id").alias("qid")).distinct().join(best.select(F.col("left_key").alias("qid"), F.col("right_key").alias("record_id")), "qid", "left")


# Resolution -------------------------------------------------------------------------------------


@query()
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02, ER-01: verdicts on near hotels by phone and name; the SQL dialect's edit distance counts bytes, so this is tested against brute force."""
    w = table(spark, sf_dir, "wikidata_hotels").select("qid", "name_ja", F.col("phone").alias("wp"), "coordinates").distinct()
    o = table(spark, sf_dir, "osm_hotels").select("osm_id", "name", F.col("phone").alias("op"), "coordinates").distinct()
    near = neighbours.grid_pairs(_points(w, "qid"), _points(o, "osm_id"), 100.0).select(F.col("left_key").alias("qid"), F.col("right_key").alias("osm_id"))
    joined = near.join(w.drop("coordinates"), "qid").join(o.drop("coordinates"), "osm_id")
    return joined.select("qid", "osm_id", resolve.match_decision(F.col("wp"), F.col("op"), F.col("name_ja"), F.col("name")).alias("verdict")).filter("verdict is not null")


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id WHERE a.text <> ''),
         r(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a)
    SELECT node AS doc_id, min(other) AS cluster FROM r GROUP BY node
""")
def copy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-02: documents linked by equal texts, each with the smallest id of its cluster; links run from a text's first copy, not between all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    same = docs.filter("text <> ''").withColumn("h", F.sha2("text", 256))
    first = same.groupBy("h").agg(F.min("doc_id").alias("a"))
    edges = same.join(first, "h").select("a", F.col("doc_id").alias("b")).filter("a <> b")
    return resolve.clusters(docs.select(F.col("doc_id").alias("node")), edges).select(F.col("node").alias("doc_id"), "cluster")


@query("""
    WITH m AS (SELECT DISTINCT record_id, id, name, phone, website FROM matched_hotels)
    SELECT id AS cluster, min_by(name, (-coalesce(length(name), -1), record_id)) AS name, min_by(phone, record_id) FILTER (phone IS NOT NULL) AS phone, min_by(website, record_id) FILTER (website IS NOT NULL) AS website, count(*) AS n_members, CASE WHEN count(*) > 1 THEN 'confirmed' ELSE 'singleton' END AS confidence FROM m GROUP BY id
""")
def master_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-03, AGG-16, AGG-18, STR-06: one record per cluster; the longest name, the first other values."""
    m = table(spark, sf_dir, "matched_hotels").select("record_id", "id", "name", "phone", "website").distinct()
    return resolve.fold_clusters(m.select(F.col("id").alias("cluster"), F.col("record_id").alias("member"), "name", "phone", "website"), ["phone", "website"])


@query("SELECT record_id, name, confidence FROM (SELECT DISTINCT record_id, name, confidence FROM matched_hotels) ORDER BY CASE confidence WHEN 'confirmed' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, name NULLS FIRST, record_id LIMIT 200")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-04, SORT-01, SORT-06, SNK-05: the first 200 records by confidence and name, a bounded work list."""
    order = [F.when(F.col("confidence") == "confirmed", 0).when(F.col("confidence") == "review", 1).otherwise(2), F.asc_nulls_first("name"), F.asc("record_id")]
    return table(spark, sf_dir, "matched_hotels").select("record_id", "name", "confidence").distinct().orderBy(*order).limit(200)


# Coverage and evaluation ------------------------------------------------------------------------


@query("""
    WITH k AS (SELECT DISTINCT prefecture_code FROM attractions WHERE prefecture_code <> '' UNION SELECT DISTINCT prefecture_code FROM stations WHERE prefecture_code <> ''), d AS (SELECT prefecture_code, count(*) FILTER (name_en <> '') AS named_en, count(*) FILTER (coordinates IS NOT NULL) AS located, count(*) FILTER (len(heritage_designations) > 0) AS listed FROM attractions GROUP BY prefecture_code)
    SELECT k.prefecture_code, coalesce(named_en, 0) AS named_en, coalesce(located, 0) AS located, coalesce(listed, 0) AS listed FROM k LEFT JOIN d USING (prefecture_code)
""")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-06: topic counts of every prefecture, zero where there are none."""
    a = table(spark, sf_dir, "attractions")
    keys = a.select("prefecture_code").union(table(spark, sf_dir, "stations").select("prefecture_code")).filter("prefecture_code <> ''")
    return quality.coverage(a, keys, "prefecture_code", {"named_en": F.col("name_en") != "", "located": F.col("coordinates").isNotNull(), "listed": F.size("heritage_designations") > 0})


@query("SELECT code, count(*) AS n FROM (SELECT DISTINCT shukubo_id, prefecture_codes FROM shukubo), unnest(prefecture_codes) AS u(code) GROUP BY code")
def bridge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, TOOL-10, TOOL-13, TOOL-15: registry records by prefecture through a many-to-many list."""
    return table(spark, sf_dir, "shukubo").select("shukubo_id", "prefecture_codes").distinct().select(F.explode("prefecture_codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, median(l_extendedprice) AS median_price, list_sort(list(l_quantity))[(count(l_quantity) // 2 + 1)::INT] AS upper_quantity FROM lineitem GROUP BY l_returnflag")
def group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02, AGG-03: exact medians, with the mean of the middle two and with the upper one."""
    lines = table(spark, sf_dir, "lineitem")
    mid = lines.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    # The upper median from counts of equal values: nothing is collected per group.
    run = mid.withColumn("upto", F.sum("n").over(Window.partitionBy("l_returnflag").orderBy("l_quantity"))).withColumn("all", F.sum("n").over(Window.partitionBy("l_returnflag")))
    upper = run.filter("upto > floor(all / 2)").groupBy("l_returnflag").agg(F.min("l_quantity").alias("upper_quantity"))
    return lines.groupBy("l_returnflag").agg(F.median("l_extendedprice").alias("median_price")).join(upper, "l_returnflag")


@query("SELECT coalesce(lang, '?') AS lang, count(*) AS n, round(100.0::DOUBLE * avg(CASE WHEN text <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 2) AS with_text_pct, max(fetched_at) AS newest FROM documents GROUP BY 1")
def language_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05, AGG-20, DAT-04: documents by language, the share with text, the newest fetch."""
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), quality.share(F.col("text") != "").alias("with_text_pct"), F.max("fetched_at").alias("newest"))


@query("SELECT a.prefecture_code, k.key AS lang, count(*) AS n FROM (SELECT qid, min(prefecture_code) AS prefecture_code FROM attractions GROUP BY qid) a JOIN (SELECT DISTINCT qid, unnest(map_keys(descriptions)) AS key FROM description_rows) k USING (qid) GROUP BY ALL")
def coverage_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23: entities with a text, by prefecture and language."""
    a = table(spark, sf_dir, "attractions").groupBy("qid").agg(F.min("prefecture_code").alias("prefecture_code"))
    d = table(spark, sf_dir, "description_rows").select("qid", F.explode(F.map_keys("descriptions")).alias("lang")).distinct()
    return a.join(d, "qid").groupBy("prefecture_code", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (w AND NOT o) AS only_wikidata, count(*) FILTER (o AND NOT w) AS only_osm, count(*) FILTER (w AND o) AS both FROM (SELECT len(list_filter(sources, lambda s: s.source = 'wikidata')) > 0 AS w, len(list_filter(sources, lambda s: s.source = 'osm')) > 0 AS o FROM (SELECT DISTINCT record_id, sources FROM matched_hotels))")
def source_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08: matched records by the sources they come from."""
    has = lambda name: F.exists("sources", lambda s: s["source"] == name)
    rows = table(spark, sf_dir, "matched_hotels").select("record_id", "sources").distinct().select(has("wikidata").alias("w"), has("osm").alias("o"))
    return rows.agg(F.count_if(F.col("w") & ~F.col("o")).alias("only_wikidata"), F.count_if(F.col("o") & ~F.col("w")).alias("only_osm"), F.count_if(F.col("w") & F.col("o")).alias("both"))


SCORED_SQL = "(SELECT DISTINCT spot_id, round(CASE WHEN description <> '' THEN 0.2::DOUBLE + least(0.15::DOUBLE, length(description) / 120.0::DOUBLE * 0.15::DOUBLE) ELSE 0 END + least(0.2::DOUBLE, coalesce(len(body_paragraphs), 0) / 2.0::DOUBLE * 0.2::DOUBLE), 3) AS score FROM dmo_spots)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    score = classify.quality_score(F.col("description"), F.size("body_paragraphs"), none.cast("string"), F.lit(False), none.cast("string"), F.lit(0), F.lit(0))
    return table(spark, sf_dir, "dmo_spots").select("spot_id", score.alias("score")).distinct()


@query(f"SELECT band, count(*) AS n, round(avg(score), 4) AS mean_score FROM (SELECT score, CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.30 THEN 'medium' ELSE 'low' END AS band FROM {SCORED_SQL}) GROUP BY band")
def quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-08, AGG-04, MTH-03: spots by the band of their completeness."""
    return _scored(spark, sf_dir).groupBy(classify.quality_band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query(f"SELECT spot_id, score FROM {SCORED_SQL} ORDER BY score, spot_id LIMIT 20")
def worst_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SORT-05: the twenty least complete spots."""
    return _scored(spark, sf_dir).orderBy("score", "spot_id").limit(20)


JUDGED = "(SELECT event_id, user_id, event_type, value % 6 AS a, (value * 7) % 6 AS b, (event_id % 5) <> 0 AS ok FROM events)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", (F.col("value") % 6).alias("a"), ((F.col("value") * 7) % 6).alias("b"), ((F.col("event_id") % 5) != 0).alias("ok"))


@query(f"SELECT count(*) AS n, round(100.0::DOUBLE * avg(CASE WHEN 0.6 * a + 0.4 * b >= 4.0 THEN 1.0::DOUBLE ELSE 0 END), 2) AS satisfied_pct, round(100.0::DOUBLE * avg(CASE WHEN ok AND (a + b) / 2 >= 3.0 THEN 1.0::DOUBLE ELSE 0 END), 2) AS acceptable_pct, round(100.0::DOUBLE * avg(CASE WHEN NOT ok THEN 1.0::DOUBLE ELSE 0 END), 2) AS failed_pct FROM {JUDGED}")
def judge_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09, AGG-25, MTH-02: shares of satisfied, acceptable and failed cases; events stand in for scores."""
    return quality.judge_kpis(_judged(spark, sf_dir), quality.weighted({"a": 0.6, "b": 0.4}), (F.col("a") + F.col("b")) / 2, F.col("ok"))


@query(f"SELECT event_type, count(*) AS n, round(avg((a + b) / 2), 4) AS mean_score, count(*) FILTER (floor(a) = 0) AS s0, count(*) FILTER (floor(a) = 5) AS s5 FROM {JUDGED} GROUP BY event_type")
def judge_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, AGG-11, AGG-26: scores by tool, with the ends of their histogram."""
    return _judged(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("a") + F.col("b")) / 2), 4).alias("mean_score"), F.count_if(F.floor("a") == 0).alias("s0"), F.count_if(F.floor("a") == 5).alias("s5"))


@query(f"""
    WITH j AS {JUDGED}, v AS (SELECT user_id, event_type, count(*) AS v FROM j GROUP BY ALL), l AS (SELECT user_id, min_by(event_type, (-v, event_type)) AS event_type FROM v GROUP BY user_id), m AS (SELECT user_id, count(*) AS votes, median(a) AS a, bool_and(ok) AS ok FROM j GROUP BY user_id)
    SELECT m.user_id, votes, round(a, 5) AS a, ok, l.event_type FROM m JOIN l USING (user_id) WHERE votes = (SELECT max(votes) FROM m)
""")
def multi_judge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12, AGG-13: votes on a case merged: median, all, commonest; only cases with all votes."""
    j = _judged(spark, sf_dir)
    most = j.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return quality.merge_judges(j, "user_id", ["a"], ["ok"], "event_type", most).select("user_id", "votes", F.round("a", 5).alias("a"), "ok", "event_type")


@query("SELECT user_id, month, round(total - lag(total) OVER (PARTITION BY user_id ORDER BY month), 4) AS delta FROM (SELECT user_id, date_trunc('week', ts)::DATE AS month, sum(value) AS total FROM events GROUP BY ALL)")
def run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05: change from run to run."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("month")).agg(F.sum("value").alias("total"))
    before = F.lag("total").over(Window.partitionBy("user_id").orderBy("month"))
    return e.select("user_id", "month", F.round(F.col("total") - before, 4).alias("delta"))


@query("SELECT confidence, type, count(*) AS n FROM (SELECT DISTINCT record_id, coalesce(confidence, '?') AS confidence, coalesce(type, '?') AS type FROM matched_hotels) GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21: counts of each pair of expected and chosen label."""
    rows = table(spark, sf_dir, "matched_hotels").select("record_id", F.coalesce("confidence", F.lit("?")).alias("confidence"), F.coalesce("type", F.lit("?")).alias("type")).distinct()
    return rows.groupBy("confidence", "type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE value < 1 GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5")
def persistent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22, AGG-24: failures grouped, the five commonest first."""
    return table(spark, sf_dir, "events").filter("value < 1").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")).orderBy(F.desc("n"), "event_type").limit(5)


@query("SELECT n_name, r_name, count(c_custkey) AS customers, round(sum(c_acctbal), 2) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)")
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06 and beyond: counts of nations, regions and all."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    joined = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.rollup("r_name", "n_name").agg(F.count("c_custkey").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


# Increments -------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS candidates, round(max(date_diff('microsecond', last, TIMESTAMPTZ '{NOW}+00') / 86400000000.0), 6) AS max_age_days, count(*) FILTER (date_diff('microsecond', last, TIMESTAMPTZ '{NOW}+00') / 86400000000.0 > 33) AS over_sla FROM (SELECT dmo_id, max(fetched_at) AS last FROM dmo_spots GROUP BY dmo_id)")
def freshness_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14, DAT-01, DAT-03: the oldest site's age and the sites beyond the promise."""
    last = table(spark, sf_dir, "dmo_spots").groupBy("dmo_id").agg(F.max("fetched_at").alias("last"))
    age = incremental.age_days(F.col("last"), NOW)
    return last.agg(F.count(F.lit(1)).alias("candidates"), F.round(F.max(age), 6).alias("max_age_days"), F.count_if(age > incremental.SLA_DAYS).alias("over_sla"))


@query("SELECT dmo_id, max(fetched_at) AS last FROM dmo_spots GROUP BY dmo_id ORDER BY last NULLS FIRST, dmo_id LIMIT 30")
def stalest_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SORT-04, INC-02: the thirty sites seen longest ago."""
    return incremental.stalest(table(spark, sf_dir, "dmo_spots").groupBy("dmo_id").agg(F.max("fetched_at").alias("last")), "dmo_id", "last", 30)


@query(f"""
    WITH s AS (SELECT prefecture_code AS p, count(*) AS n, max(date_diff('microsecond', fetched_at, TIMESTAMPTZ '{NOW}+00') / 86400000000.0) AS age FROM attractions GROUP BY prefecture_code), b AS (SELECT *, greatest(30, least(130, ceil(n / 28.0)))::BIGINT AS base FROM s)
    SELECT p AS prefecture_code, base, CASE WHEN age IS NULL THEN 130 WHEN age <= 33 THEN base ELSE greatest(base, least(130, ceil(base * (age / 28.0))::BIGINT)) END::BIGINT AS batch FROM b
""")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-01, INC-02: a day's batch for each prefecture, raised by how far it is behind."""
    s = table(spark, sf_dir, "attractions").groupBy("prefecture_code").agg(F.count(F.lit(1)).alias("n"), F.max(incremental.age_days(F.col("fetched_at"), NOW)).alias("age"))
    return s.select("prefecture_code", incremental.baseline_batch(F.col("n")).cast("bigint").alias("base"), incremental.recommended_batch(F.col("n"), F.col("age")).cast("bigint").alias("batch"))


@query("""
    WITH c AS (SELECT qid, substring(sha256(max(coalesce(name_ja, ''))), 1, 16) AS hash FROM attractions GROUP BY qid), k AS (SELECT qid, bool_or(coalesce(descriptions['en'] <> '' AND descriptions['ja'] <> '', false)) AS complete, max(source_hash) AS old_hash FROM description_rows GROUP BY qid)
    SELECT qid, CASE WHEN k.complete IS NULL THEN 'new' WHEN NOT k.complete THEN 'incomplete' ELSE 'changed' END AS reason FROM c LEFT JOIN k USING (qid) WHERE k.complete IS NULL OR NOT k.complete OR (old_hash IS NOT NULL AND old_hash <> hash)
""")
def stale_hash_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INC-03, STR-08, MAP-06, MAP-02: entities to describe again: new, incomplete or changed."""
    current = table(spark, sf_dir, "attractions").groupBy("qid").agg(text.short_sha256(F.max(F.coalesce("name_ja", F.lit("")))).alias("hash"))
    d = F.col("descriptions")
    known = table(spark, sf_dir, "description_rows").groupBy("qid").agg(F.bool_or(F.coalesce((F.element_at(d, "en") != "") & (F.element_at(d, "ja") != ""), F.lit(False))).alias("complete"), F.max("source_hash").alias("old_hash"))
    return incremental.stale_rows(current, known, "qid")


@query("""
    WITH m AS (SELECT *, value < 20 AS f FROM events), i AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m), r AS (SELECT user_id, island, count(*) AS n FROM i WHERE f GROUP BY ALL)
    SELECT u.user_id, coalesce(max(r.n), 0)::BIGINT AS longest_run FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r USING (user_id) GROUP BY u.user_id
""")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INC-04: the most failures in a row of each source; a low value stands in for a failure."""
    return incremental.longest_run(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") < 20)


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT left_source_id AS src, right_source_id AS dst FROM hotel_pairs WHERE left_source_id <> '' AND right_source_id <> ''), s AS (SELECT min(left_source_id) AS n FROM hotel_pairs WHERE left_source_id LIKE 'Q%'),
         r(node, depth) AS (SELECT n, 0 FROM s UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3)
    SELECT node, min(depth)::INT AS depth FROM r GROUP BY node
""")
def breadth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INC-06, RNK-03: nodes within three links of a start."""
    e = table(spark, sf_dir, "hotel_pairs").filter("left_source_id <> '' and right_source_id <> ''").select(F.col("left_source_id").alias("src"), F.col("right_source_id").alias("dst")).distinct()
    start = table(spark, sf_dir, "hotel_pairs").filter("left_source_id like 'Q%'").agg(F.min("left_source_id").alias("node"))
    return incremental.reach(e, start, 3)


@query("""
    WITH o AS (SELECT doc_id, substring(md5(coalesce(text, '')), 1, 8) AS etag FROM documents WHERE ingested_at < TIMESTAMPTZ '2026-01-01 00:00:00+00'), n AS (SELECT doc_id, substring(md5(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END), 1, 8) AS etag FROM documents)
    SELECT n.doc_id, CASE WHEN o.etag IS NULL THEN 'added' ELSE 'changed' END AS change FROM n LEFT JOIN o USING (doc_id) WHERE o.etag IS NULL OR o.etag <> n.etag
""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-04, SET-05, INC-07: what was added or changed between two manifests; every seventh row stands in for a change."""
    d = table(spark, sf_dir, "documents")
    tag = lambda c: F.substring(F.md5(c), 1, 8)
    old = d.filter("ingested_at < timestamp '2026-01-01 00:00:00'").select("doc_id", tag(F.coalesce("text", F.lit(""))).alias("old"))
    new = d.select("doc_id", tag(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 7 == 0, "!").otherwise(""))).alias("etag"))
    return new.join(old, "doc_id", "left").filter("old is null or old <> etag").select("doc_id", F.when(F.col("old").isNull(), "added").otherwise("changed").alias("change"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, json_extract_string(props, '$.ref') AS ref FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-01 to JSN-04: fields of JSON text, null where absent."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.ref").alias("ref"))


@query("SELECT batch, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 5000 AS batch FROM events) GROUP BY batch")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BAT-01: rows in batches of fixed size, numbered without one task that sorts all: partitions are ranged and their sizes added up."""
    e = table(spark, sf_dir, "events").select("event_id")
    ranged = e.repartitionByRange("event_id").withColumn("part", F.spark_partition_id())
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    numbered = ranged.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("event_id"))).join(before, "part")
    return numbered.select("event_id", F.floor((F.col("before") + F.col("r") - 1) / 5000).alias("batch")).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query(f"""
    WITH p AS (SELECT * FROM {_points_sql('stations', 'qid')}), s AS (SELECT p.key, p.lat, p.lng, st.prefecture_code AS route FROM p JOIN (SELECT DISTINCT qid, prefecture_code FROM stations) st ON st.qid = p.key),
         w AS (SELECT *, lag(lat) OVER o AS plat, lag(lng) OVER o AS plng FROM s WINDOW o AS (PARTITION BY route ORDER BY key))
    SELECT route, count(*) AS stops, round(sum(CASE WHEN plat IS NOT NULL THEN 2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lng - plng) / 2), 2)))) END) / 1000, 3) AS km FROM w GROUP BY route
""")
def itinerary_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOOL-18: the length of an ordered itinerary; a prefecture's stations in order stand in for stops."""
    st = table(spark, sf_dir, "stations")
    stops = _points(st, "qid").join(st.select(F.col("qid").alias("key"), F.col("prefecture_code").alias("route")).distinct(), "key")
    o = Window.partitionBy("route").orderBy("key")
    leg = haversine_m(F.lag("lat").over(o), F.lag("lng").over(o), F.col("lat"), F.col("lng"))
    return stops.withColumn("leg", leg).groupBy("route").agg(F.count(F.lit(1)).alias("stops"), F.round(F.sum("leg") / 1000, 3).alias("km"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: daily counts and sums of events, the batch twin of the stream."""
    from meguri.streaming import upsert

    return upsert.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 day")


@query("""
    WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM m)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, g
""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: sessions of users, apart by six hours or more."""
    from meguri.streaming import upsert

    return upsert.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")


# Tools: compositions of the above; what the reference's handlers add is unknown and not made up ------


@query("""
    SELECT 'attraction' AS tier, qid AS key, name FROM (SELECT DISTINCT qid, name_ja AS name FROM attractions WHERE contains(name_ja, '霧浜') OR contains(admin_name, '霧浜'))
    UNION ALL SELECT 'station', qid, name FROM (SELECT DISTINCT qid, name_ja AS name FROM stations WHERE contains(name_ja, '霧浜') OR contains(admin_name, '霧浜')) UNION ALL SELECT 'municipality', admin_code, admin_name FROM (SELECT DISTINCT admin_code, admin_name FROM attractions WHERE contains(admin_name, '霧浜'))
""")
def search_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOOL-01: attractions, stations and municipalities that a name is found in."""
    from meguri.functions.filters import matches_keyword

    a, s = table(spark, sf_dir, "attractions"), table(spark, sf_dir, "stations")
    hit = lambda df, *cs: df.filter(matches_keyword("霧浜", *[F.col(c) for c in cs]))
    row = lambda df, tier, key, name: df.select(F.lit(tier).alias("tier"), F.col(key).alias("key"), F.col(name).alias("name")).distinct()
    return row(hit(a, "name_ja", "admin_name"), "attraction", "qid", "name_ja").unionByName(row(hit(s, "name_ja", "admin_name"), "station", "qid", "name_ja")).unionByName(row(hit(a, "admin_name"), "municipality", "admin_code", "admin_name"))


@query(f"SELECT osm_id, name, round(d, 1) AS distance_m FROM (SELECT DISTINCT osm_id, name, {HAVERSINE_SQL.format(a='35.0100 + 0 * coordinates.', b='coordinates.').replace('35.0100 + 0 * coordinates.lat', '35.01').replace('35.0100 + 0 * coordinates.lng', '135.41')} AS d FROM osm_hotels WHERE type IN ('hotel', 'ryokan')) WHERE d <= 500 ORDER BY d, osm_id LIMIT 50")
def get_hotels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOOL-05: hotels of some types within 500 m of a point, the nearest fifty."""
    o = table(spark, sf_dir, "osm_hotels").filter("type in ('hotel', 'ryokan')")
    d = haversine_m(F.lit(35.01), F.lit(135.41), F.col("coordinates.lat"), F.col("coordinates.lng"))
    return o.select("osm_id", "name", d.alias("d")).distinct().filter("d <= 500").orderBy("d", "osm_id").limit(50).select("osm_id", "name", F.round("d", 1).alias("distance_m"))


@query("""
    WITH a AS (SELECT qid, max(name_ja) AS name_ja, max(name_en) AS name_en, max(admin_name) AS admin_name FROM attractions GROUP BY qid), d AS (SELECT qid, min(descriptions['ja']) AS description FROM description_rows GROUP BY qid), t AS (SELECT unnest(qids) AS qid FROM (SELECT list(DISTINCT qid) AS qids FROM attractions WHERE admin_code = '26901'))
    SELECT a.qid, a.name_ja, a.name_en, a.admin_name, d.description FROM t JOIN a USING (qid) LEFT JOIN d USING (qid)
""")
def entity_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOOL-16, TOOL-17, TOOL-04: denormalised cards of a set of entities."""
    a = table(spark, sf_dir, "attractions")
    wanted = a.filter("admin_code = '26901'").select("qid").distinct()
    cards = a.join(wanted, "qid", "left_semi").groupBy("qid").agg(F.max("name_ja").alias("name_ja"), F.max("name_en").alias("name_en"), F.max("admin_name").alias("admin_name"))
    d = table(spark, sf_dir, "description_rows").groupBy("qid").agg(F.min(F.element_at("descriptions", "ja")).alias("description"))
    return cards.join(d, "qid", "left")
