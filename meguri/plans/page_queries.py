"""Queries over pages and loose JSON, nested documents, fill-only merges, scopes and whole evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.functions import pages, text, urls
from meguri.operators import merge, neighbours
from meguri.plans.queries import query
from meguri.plans.record_queries import JUDGED, _judged
from meguri.session import table

SPOTS = "(SELECT DISTINCT spot_id, dmo_id, url, final_url, title, description, language FROM dmo_spots)"


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dmo_spots").select("spot_id", "dmo_id", "url", "final_url", "title", "description", "language").distinct()


def _escaped(c: Column) -> Column:
    for ch, name in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(ch), F.lit(name))
    return c


def _page(title: Column, language: Column, canonical: Column, data: Column) -> Column:
    """A page that holds the given fields, as a site would write it."""
    return F.concat(
        F.lit('<!doctype html><html lang="'), _escaped(F.coalesce(language, F.lit(""))), F.lit('"><head><title> '), _escaped(F.coalesce(title, F.lit(""))), F.lit('</title><link rel="canonical" href="'), _escaped(F.coalesce(canonical, F.lit(""))),
        F.lit('"><script type="application/ld+json">'), data, F.lit('</script></head><body><h1>'), _escaped(F.coalesce(title, F.lit(""))), F.lit('</h1><a href="/top">a</a><a href="map?x=1&amp;y=2">b</a><img src="i.png"></body></html>'),
    )


@query(f"""
    SELECT spot_id, nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), '') AS title, nullif(trim(language), '') AS language, nullif(final_url, '') AS canonical, 2::BIGINT AS n_links, CASE WHEN url <> '' THEN regexp_extract(url, '^https?://[^/]+') || '/top' END AS first_link
    FROM {SPOTS} WHERE url <> ''
""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07, STR-10: title, language, canonical address and links of pages, written and read back."""
    d = _spots(spark, sf_dir).filter("url <> ''").withColumn("page", pages.page_fields(_page(F.col("title"), F.col("language"), F.col("final_url"), F.lit("{}")), F.col("url")))
    return d.select("spot_id", "page.title", F.nullif(F.trim("page.language"), F.lit("")).alias("language"), "page.canonical", F.size("page.links").cast("bigint").alias("n_links"), F.element_at("page.links", 1).alias("first_link"))


@query("""
    SELECT qid, 'Hotel' AS type, name_en AS name, 'Japan ' || coalesce(postal_code, '') AS address, coordinates.lat AS lat, coordinates.lng AS lng
    FROM (SELECT DISTINCT qid, name_en, postal_code, coordinates FROM wikidata_hotels) WHERE name_en <> '' AND name_en = trim(name_en) AND coordinates.lat BETWEEN -90 AND 90 AND coordinates.lng BETWEEN -180 AND 180 AND postal_code = trim(postal_code) AND postal_code <> ''
""")
def schema_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-01 to JSN-03: places in the JSON-LD of pages, inside a graph and beside an event, with address parts and position."""
    w = table(spark, sf_dir, "wikidata_hotels").select("qid", "name_en", "postal_code", "coordinates").distinct()
    w = w.filter("name_en <> '' and name_en = trim(name_en) and coordinates.lat between -90 and 90 and coordinates.lng between -180 and 180 and postal_code = trim(postal_code) and postal_code <> ''")
    geo = F.struct(F.col("coordinates.lat").cast("string").alias("latitude"), F.col("coordinates.lng").alias("longitude"))
    item = F.struct(F.array(F.lit("Thing"), F.lit("Hotel")).alias("@type"), F.array("name_en").alias("name"), geo.alias("geo"), F.struct(F.lit("Japan").alias("postalCode"), F.struct(F.col("postal_code").alias("@value")).alias("streetAddress")).alias("address"))
    data = F.to_json(F.struct(F.array(F.to_json(F.struct(F.lit("WebSite").alias("@type")))).alias("ignored"), F.array(item).alias("@graph")))
    d = w.withColumn("page", pages.page_fields(_page(F.col("name_en"), F.lit("en"), F.lit(""), data), F.lit("https://a.example/")))
    i = d.select("qid", F.explode("page.items").alias("i"))
    return i.select("qid", "i.type", "i.name", "i.address", "i.lat", "i.lng")


@query("SELECT doc_id, lang, text FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(92)) AND NOT contains(text, '\"')")
def json_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-04: objects found in chatty text, with line ends and tabs standing raw in their strings."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull() & ~F.contains("text", F.lit("\\")) & ~F.contains("text", F.lit('"')))
    lang = F.when(F.col("lang").isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), "lang", F.lit('"')))
    loose = F.concat(F.lit("Sure, here it is:\n```json\n{\"lang\": "), lang, F.lit(', "text": "'), "text", F.lit('"}\n```\nAnything else?'))
    return d.select("doc_id", F.from_json(pages.loose_json(loose), "lang string, text string").alias("r")).select("doc_id", "r.lang", "r.text")


@query(f"SELECT spot_id, 'The \"' || title || '\" of ' || dmo_id AS name FROM {SPOTS} WHERE title IS NOT NULL AND NOT contains(title, chr(92)) AND NOT contains(title, '\"')")
def json_quotes_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-05: strings with unescaped quotes in them."""
    d = _spots(spark, sf_dir).filter(F.col("title").isNotNull() & ~F.contains("title", F.lit("\\")) & ~F.contains("title", F.lit('"')))
    broken = F.concat(F.lit('{"n": 1, "name": "The "'), "title", F.lit('" of '), "dmo_id", F.lit('", "z": [2]}'))
    return d.select("spot_id", F.from_json(pages.loose_json(broken), "name string").getField("name").alias("name"))


@query("SELECT DISTINCT osm_id, osm_id || '/' || coalesce(name, '') AS key FROM osm_hotels")
def safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-06: keys made safe for a batch and read back."""
    key = F.concat("osm_id", F.lit("/"), F.coalesce("name", F.lit("")))
    d = table(spark, sf_dir, "osm_hotels").select("osm_id", pages.safe_id(key).alias("safe")).distinct()
    return d.select("osm_id", F.when(F.col("safe").rlike("^[A-Za-z0-9_-]*$"), pages.id_of_safe(F.col("safe"))).alias("key"))


@query("""
    WITH s AS (SELECT DISTINCT qid, name_ja, prefecture_code, admin_code, admin_name FROM stations WHERE prefecture_code <> '' AND admin_code <> '')
    SELECT qid, name_ja, prefecture_code, admin_code, admin_name FROM s
""")
def nested_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-18: rows two levels down in nested documents, with the columns of their parents."""
    s = table(spark, sf_dir, "stations").filter("prefecture_code <> '' and admin_code <> ''").select("qid", "name_ja", "prefecture_code", "admin_code", "admin_name").distinct()
    towns = s.groupBy("prefecture_code", "admin_code", "admin_name").agg(F.collect_list(F.struct("qid", "name_ja")).alias("spots"))
    nested = towns.groupBy("prefecture_code").agg(F.collect_list(F.struct("admin_code", "admin_name", "spots")).alias("municipalities"))
    return merge.nested_rows(nested, ["municipalities", "spots"]).select("qid", "name_ja", "prefecture_code", "admin_code", "admin_name")


@query(f"SELECT spot_id, coalesce(contains(url, '-7.example') OR contains(url, '-203.example/page'), false) AS portal FROM {SPOTS}")
def portal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06: pages of portals, whose addresses a parameter names."""
    return _spots(spark, sf_dir).select("spot_id", urls.of_portal(F.col("url"), ["-7.example", "-203.example/page"]).alias("portal"))


UPSERT_SQL = """
    WITH a AS (SELECT qid, max(name_en) AS name_en, max(phone) AS phone FROM wikidata_hotels GROUP BY qid), b AS (SELECT id AS qid, max(name_en) AS name_en, max(phone) AS phone FROM matched_hotels GROUP BY id)
"""


@query(f"{UPSERT_SQL} SELECT coalesce(a.qid, b.qid) AS qid, coalesce(nullif(a.name_en, ''), nullif(b.name_en, '')) AS name_en, coalesce(nullif(a.phone, ''), nullif(b.phone, '')) AS phone, a.qid IS NULL AS inserted FROM a FULL JOIN b ON a.qid = b.qid")
def upsert_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-15: empty fields filled, present ones kept, absent records inserted."""
    base = table(spark, sf_dir, "wikidata_hotels").groupBy("qid").agg(F.max("name_en").alias("name_en"), F.max("phone").alias("phone"))
    add = table(spark, sf_dir, "matched_hotels").groupBy(F.col("id").alias("qid")).agg(F.max("name_en").alias("name_en"), F.max("phone").alias("phone"))
    return merge.fill(base, add, "qid", ["name_en", "phone"])


@query("""
    WITH a AS (SELECT qid, array_to_string(list_sort(list_distinct(flatten(list(types) FILTER (types IS NOT NULL)))), ',') AS types FROM attractions GROUP BY qid)
    SELECT qid, CASE WHEN types = '' THEN NULL ELSE types END AS types FROM a
""")
def types_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03, JOIN-15: the lists of two harvests united without repeats."""
    a = table(spark, sf_dir, "attractions").select("qid", "source_anchor", "types")
    side = lambda df: df.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"))
    out = merge.fill(side(a.filter("source_anchor = 'v2'")), side(a.filter("source_anchor is null or source_anchor <> 'v2'")), "qid", [], ["types"])
    return out.select("qid", F.nullif(F.array_join(F.array_sort("types"), ","), F.lit("")).alias("types"))


@query("""
    WITH w AS (SELECT qid, max(website) AS website FROM wikidata_hotels GROUP BY qid)
    SELECT qid, CASE WHEN substr(qid, length(qid)) = '3' THEN NULL WHEN website <> '' THEN website WHEN substr(qid, length(qid)) = '5' THEN 'https://fix.example/' || qid ELSE website END AS website, substr(qid, length(qid)) = '3' AS out_of_scope FROM w
""")
def manual_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-20: manual values fill empty ones; a manual null takes the record out of scope."""
    w = table(spark, sf_dir, "wikidata_hotels").groupBy("qid").agg(F.max("website").alias("website"))
    last = F.right("qid", F.lit(1))
    manual = w.filter(last.isin("3", "5")).select("qid", F.when(last == "5", F.concat(F.lit("https://fix.example/"), "qid")).alias("website"))
    return merge.override(w, manual, "qid", "website")


@query("""
    WITH c AS (SELECT admin_code, avg(coordinates.lat) AS lat, avg(coordinates.lng) AS lng FROM stations WHERE admin_code <> '' AND coordinates.lat BETWEEN -90 AND 90 AND coordinates.lng BETWEEN -180 AND 180 GROUP BY admin_code),
         p AS (SELECT prefecture_code, avg(coordinates.lat) AS lat, avg(coordinates.lng) AS lng FROM stations WHERE prefecture_code <> '' AND coordinates.lat BETWEEN -90 AND 90 AND coordinates.lng BETWEEN -180 AND 180 GROUP BY prefecture_code),
         a AS (SELECT DISTINCT record_id, admin_code, prefecture_code, CASE WHEN coordinates.lat BETWEEN -90 AND 90 AND coordinates.lng BETWEEN -180 AND 180 THEN coordinates END AS pos FROM attractions)
    SELECT record_id, floor(coalesce(pos.lat, c.lat, p.lat) * 10000)::BIGINT AS lat_e4, floor(coalesce(pos.lng, c.lng, p.lng) * 10000)::BIGINT AS lng_e4, CASE WHEN pos IS NOT NULL THEN 'own' WHEN c.lat IS NOT NULL THEN 'municipality' WHEN p.lat IS NOT NULL THEN 'prefecture' ELSE 'none' END AS precision
    FROM a LEFT JOIN c USING (admin_code) LEFT JOIN p USING (prefecture_code)
""")
def position_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-05: a record's own position, else its municipality's, else its prefecture's, with the precision."""
    s = table(spark, sf_dir, "stations").filter("coordinates.lat between -90 and 90 and coordinates.lng between -180 and 180")
    centre = lambda key: s.filter(F.col(key) != "").groupBy(key).agg(F.struct(F.avg("coordinates.lat").alias("lat"), F.avg("coordinates.lng").alias("lng")).alias(f"{key}_at"))
    a = table(spark, sf_dir, "attractions").select("record_id", "admin_code", "prefecture_code", neighbours.usable_position(F.col("coordinates")).alias("at")).distinct()
    joined = a.join(centre("admin_code"), "admin_code", "left").join(centre("prefecture_code"), "prefecture_code", "left")
    at = neighbours.first_position(own=F.col("at"), municipality=F.col("admin_code_at"), prefecture=F.col("prefecture_code_at"))
    return joined.select("record_id", F.floor(at["lat"] * 10000).alias("lat_e4"), F.floor(at["lng"] * 10000).alias("lng_e4"), at["precision"].alias("precision"))


@query("SELECT DISTINCT qid, coordinates.lat AS lat, coordinates.lng AS lng FROM stations WHERE coordinates IS NOT NULL AND NOT isnan(coordinates.lat) AND NOT isnan(coordinates.lng)")
def wkt_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-02: points written as text and read back, longitude first."""
    s = table(spark, sf_dir, "stations").filter("coordinates is not null and not isnan(coordinates.lat) and not isnan(coordinates.lng)")
    wkt = F.concat(F.lit("POINT("), F.col("coordinates.lng").cast("decimal(20,12)").cast("string"), F.lit(" "), F.col("coordinates.lat").cast("decimal(20,12)").cast("string"), F.lit(")"))
    at = neighbours.wkt_point(wkt)
    return s.select("qid", at["lat"].alias("lat"), at["lng"].alias("lng")).distinct()


@query("SELECT DISTINCT shukubo_id, regexp_replace(regexp_replace(authority || '株式会社', '(一般|公益)?(社団|財団)法人|特定非営利活動法人|NPO法人|株式会社|有限会社|合同会社', '', 'g'), '[\\s　]+', '', 'g') AS name FROM shukubo")
def organisation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05: organisations without legal form and white space."""
    return table(spark, sf_dir, "shukubo").select("shukubo_id", text.normal_organisation(F.concat("authority", F.lit("株式会社"))).alias("name")).distinct()


@query("""SELECT DISTINCT qid, substr(sha256('{"admin":' || coalesce('"' || admin_code || '"', 'null') || ',"prefecture":' || coalesce('"' || prefecture_code || '"', 'null') || '}'), 1, 16) AS hash FROM attractions""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08: fingerprints of named fields in the order of their names, nulls kept."""
    return table(spark, sf_dir, "attractions").select("qid", text.content_hash(prefecture=F.col("prefecture_code"), admin=F.col("admin_code")).alias("hash")).distinct()


@query(f"SELECT spot_id, CASE WHEN lower(language) LIKE 'ja%' THEN 'ja' WHEN lower(language) LIKE 'en%' THEN 'en' WHEN lower(language) LIKE 'zh%' THEN 'zh' WHEN lower(language) LIKE 'ko%' THEN 'ko' END AS language FROM {SPOTS}")
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13: a page's language by the beginning of its label."""
    return _spots(spark, sf_dir).select("spot_id", text.page_language(F.col("language")).alias("language"))


@query("SELECT DISTINCT qid, array_to_string(regexp_extract_all('See ' || coalesce(website, '') || ', (' || coalesce(wikidata_url, '') || ')', '(https?://[^\\s<>\"''）)」]+)', 1), ' ') AS urls FROM wikidata_hotels")
def urls_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-02: the web addresses in texts."""
    said = F.concat(F.lit("See "), F.coalesce("website", F.lit("")), F.lit(", ("), F.coalesce("wikidata_url", F.lit("")), F.lit(")"))
    return table(spark, sf_dir, "wikidata_hotels").select("qid", F.array_join(urls.urls_in(said), " ").alias("urls")).distinct()


@query("SELECT DISTINCT record_id, array_to_string(list_filter(list_concat(coalesce(types, []), coalesce(heritage_designations, [])), lambda x, i: list_position(list_concat(coalesce(types, []), coalesce(heritage_designations, [])), x) = i), ',') AS tags FROM attractions")
def tags_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-01: one list appended to another, each value where it first stands."""
    none = F.expr("cast(array() as array<string>)")
    both = F.array_distinct(F.concat(F.coalesce("types", none), F.coalesce("heritage_designations", none)))
    return table(spark, sf_dir, "attractions").select("record_id", F.array_join(both, ",").alias("tags")).distinct()


# Evaluation ---------------------------------------------------------------------------------------


@query(f"""
    WITH j AS {JUDGED}, u AS (SELECT 'a' AS dimension, a AS v FROM j UNION ALL SELECT 'b', b FROM j)
    SELECT dimension, count(*) AS n, round(avg(v), 4) AS mean, {', '.join(f"count(*) FILTER (floor(v) = {i}) AS s{i}" for i in range(6))} FROM u GROUP BY dimension
""")
def score_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10: mean and whole histogram of every dimension."""
    long = _judged(spark, sf_dir).unpivot(["event_id"], ["a", "b"], "dimension", "v")
    return long.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"), *[F.count_if(F.floor("v") == i).alias(f"s{i}") for i in range(6)])


@query(f"""
    SELECT event_type, count(*) AS n, round(100.0::DOUBLE * avg(CASE WHEN 0.6 * a + 0.4 * b >= 4.0 THEN 1.0::DOUBLE ELSE 0 END), 2) AS satisfied_pct, round(100.0::DOUBLE * avg(CASE WHEN ok AND (a + b) / 2 >= 3.0 THEN 1.0::DOUBLE ELSE 0 END), 2) AS acceptable_pct, round(100.0::DOUBLE * avg(CASE WHEN NOT ok THEN 1.0::DOUBLE ELSE 0 END), 2) AS failed_pct, round(avg((a + b) / 2), 4) AS mean
    FROM {JUDGED} GROUP BY event_type
""")
def tool_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: the shares of satisfied, acceptable and failed cases and the mean, by tool."""
    mean = (F.col("a") + F.col("b")) / 2
    pct = lambda ok: F.round(100.0 * F.avg(F.when(ok, 1.0).otherwise(0.0)), 2)
    return _judged(spark, sf_dir).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), pct(0.6 * F.col("a") + 0.4 * F.col("b") >= 4.0).alias("satisfied_pct"), pct(F.col("ok") & (mean >= 3.0)).alias("acceptable_pct"), pct(~F.col("ok")).alias("failed_pct"), F.round(F.avg(mean), 4).alias("mean")
    )


@query(f"SELECT event_id, event_type, round(a, 4) AS a, round(b, 4) AS b, round(0.6 * a + 0.4 * b, 4) AS total, ok FROM {JUDGED}")
def case_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-26: every case with its dimensions and weighted total."""
    return _judged(spark, sf_dir).select("event_id", "event_type", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round(0.6 * F.col("a") + 0.4 * F.col("b"), 4).alias("total"), "ok")


@query("""
    WITH w AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, avg(value) AS mean FROM events GROUP BY ALL), d AS (SELECT user_id, week, mean - lag(mean) OVER (PARTITION BY user_id ORDER BY week) AS d FROM w)
    SELECT week, count(*) FILTER (d >= 0.5) AS gained, count(*) FILTER (d <= -0.5) AS lost, count(*) FILTER (abs(d) < 0.5) AS level FROM d GROUP BY week
""")
def run_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05: cases that gained or lost at least half a point from run to run."""
    from pyspark.sql import Window

    w = table(spark, sf_dir, "events").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.avg("value").alias("mean"))
    d = w.select("week", (F.col("mean") - F.lag("mean").over(Window.partitionBy("user_id").orderBy("week"))).alias("d"))
    return d.groupBy("week").agg(F.count_if(F.col("d") >= 0.5).alias("gained"), F.count_if(F.col("d") <= -0.5).alias("lost"), F.count_if(F.abs("d") < 0.5).alias("level"))


@query("""
    WITH b AS (SELECT DISTINCT spot_id, title FROM dmo_spots), n AS (SELECT spot_id, CASE WHEN substr(spot_id, 1, 1) = 'a' THEN coalesce(title, '') || '!' ELSE title END AS title FROM b WHERE substr(spot_id, 2, 1) <> '0'),
         t AS (SELECT spot_id FROM b WHERE substr(spot_id, 1, 1) IN ('a', 'b')), c AS (SELECT spot_id, b.title IS DISTINCT FROM n.title AS changed, spot_id IN (SELECT spot_id FROM t) AS target FROM b JOIN n USING (spot_id))
    SELECT spot_id, CASE WHEN changed THEN 'changed outside' ELSE 'target unchanged' END AS fault FROM c WHERE changed <> target
""")
def scope_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05: records of two runs that changed outside the targets, and targets that did not change."""
    b = table(spark, sf_dir, "dmo_spots").select("spot_id", "title").distinct()
    first = F.substring("spot_id", 1, 1)
    new = b.filter(F.substring("spot_id", 2, 1) != "0").select("spot_id", F.when(first == "a", F.concat(F.coalesce("title", F.lit("")), F.lit("!"))).otherwise(F.col("title")).alias("title"))
    return merge.out_of_scope(b, new, b.filter(first.isin("a", "b")).select("spot_id"), "spot_id", "title")


@query("SELECT count(*) AS candidates, count(*) FILTER (last IS NULL) AS never, CASE WHEN count(*) FILTER (last IS NULL) > 0 THEN 'Infinity'::DOUBLE ELSE round(max(date_diff('microsecond', last, TIMESTAMPTZ '2026-06-01 00:00:00+00') / 86400000000.0), 6) END AS max_age_days FROM (SELECT a.qid, max(d.generated_at) AS last FROM (SELECT DISTINCT qid FROM attractions) a LEFT JOIN description_rows d USING (qid) GROUP BY a.qid)")
def never_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: records never described, and the greatest age, endless if there is any."""
    a = table(spark, sf_dir, "attractions").select("qid").distinct()
    last = a.join(table(spark, sf_dir, "description_rows").select("qid", "generated_at"), "qid", "left").groupBy("qid").agg(F.max("generated_at").alias("last"))
    age = (F.unix_micros(F.lit("2026-06-01 00:00:00").cast("timestamp")) - F.unix_micros("last")) / 86_400_000_000
    never = F.count_if(F.col("last").isNull())
    return last.agg(F.count(F.lit(1)).alias("candidates"), never.alias("never"), F.when(never > 0, F.lit(float("inf"))).otherwise(F.round(F.max(age), 6)).alias("max_age_days"))


@query("""
    WITH m AS (SELECT DISTINCT record_id, id FROM matched_hotels)
    SELECT id AS cluster, array_to_string(list_sort(list(record_id)), ',') AS members FROM m GROUP BY id
""")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18: the member list of each cluster."""
    m = table(spark, sf_dir, "matched_hotels").select("record_id", "id").distinct()
    return m.groupBy(F.col("id").alias("cluster")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("record_id")), lambda r: r.cast("string")), ",").alias("members"))
