"""Queries over consistency, coverage of fields, picks and small text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from meguri.functions import classify
from meguri.plans.queries import query
from meguri.session import table


@query("SELECT user_id, bool_and(least(a, b) >= 0.1) AND bool_or(0.6 * a + 0.4 * b >= 4.0) AS passed FROM (SELECT user_id, value % 6 AS a, (value * 7) % 6 AS b FROM events) GROUP BY user_id")
def agreed_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13: a case passes if every vote's lowest score suffices and some vote's weighted score does."""
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") % 6).alias("a"), ((F.col("value") * 7) % 6).alias("b"))
    return e.groupBy("user_id").agg((F.every(F.least("a", "b") >= 0.1) & F.some(0.6 * F.col("a") + 0.4 * F.col("b") >= 4.0)).alias("passed"))


FIELDS = ["name_ja", "name_en", "name_zh", "name_ko", "description_en", "admin_name"]


@query(f"SELECT source_anchor, count(*) AS n, round(avg(len(list_filter([{', '.join(FIELDS)}], lambda x: x <> '')) / {len(FIELDS)}::DOUBLE), 4) AS filled FROM attractions GROUP BY source_anchor")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19: the mean share of fields that are filled, by source."""
    filled = F.size(F.filter(F.array(*FIELDS), lambda x: x != "")) / len(FIELDS)
    return table(spark, sf_dir, "attractions").groupBy("source_anchor").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(filled), 4).alias("filled"))


@query(f"SELECT DISTINCT spot_id, coalesce(title IN ({', '.join(repr(p) for p in classify.PREFECTURES)}) OR regexp_matches(title, '^\\d{{4}}年?$|^(?:一覧|その他|日本)$'), true) AS noise FROM dmo_spots")
def list_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13: titles of lists that name no sight: prefectures, years, generic words."""
    t = F.col("title")
    return table(spark, sf_dir, "dmo_spots").select("spot_id", F.coalesce(t.isin(*classify.PREFECTURES) | t.rlike(r"^\d{4}年?$|^(?:一覧|その他|日本)$"), F.lit(True)).alias("noise")).distinct()


@query("SELECT DISTINCT spot_id, array_to_string(body_paragraphs[1:2], ' / ') AS lead, len(list_filter(body_paragraphs[1:30], lambda p: contains(p, '庭園') OR contains(lower(p), 'garden'))) > 0 AS on_topic FROM dmo_spots WHERE body_paragraphs IS NOT NULL")
def leading_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17, RET-07: the first items of a list as a lead, and whether the first thirty speak of a topic; both limits are the features."""
    p = F.col("body_paragraphs")
    topic = F.exists(F.slice(p, 1, 30), lambda x: F.contains(x, F.lit("庭園")) | F.contains(F.lower(x), F.lit("garden")))
    return table(spark, sf_dir, "dmo_spots").filter(p.isNotNull()).select("spot_id", F.array_join(F.slice(p, 1, 2), " / ").alias("lead"), topic.alias("on_topic")).distinct()


@query("""
    WITH m AS (SELECT DISTINCT admin_name AS name FROM attractions WHERE length(admin_name) >= 2), s AS (SELECT DISTINCT shukubo_id, address_jp FROM shukubo)
    SELECT shukubo_id, arg_max(name, (length(name), name)) AS municipality FROM s JOIN m ON contains(s.address_jp, m.name) GROUP BY shukubo_id
""")
def longest_municipality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-12, SORT-07: the longest municipality name in an address. The address's pieces meet the names by equality, so nothing is compared all with all."""
    names = table(spark, sf_dir, "attractions").filter("length(admin_name) >= 2").select(F.col("admin_name").alias("name")).distinct()
    # The lengths that names have, few whatever the number of names.
    sizes = [r["n"] for r in names.select(F.length("name").alias("n")).distinct().orderBy("n").collect()]
    a = F.col("address_jp")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.transform(F.array(*[F.lit(n) for n in sizes]), lambda n: F.substring(a, i, n))))
    rows = table(spark, sf_dir, "shukubo").filter(a.isNotNull()).select("shukubo_id", "address_jp").distinct().select("shukubo_id", F.explode(F.array_distinct(pieces)).alias("name"))
    return rows.join(names, "name").groupBy("shukubo_id").agg(F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("municipality"))


@query("SELECT DISTINCT shukubo_id, array_to_string(list_distinct(list_sort(regexp_extract_all(t, '北海道|東京都|京都府|大阪府|.{2,3}県'))), ',') AS prefectures, trim(regexp_replace(t, '北海道|東京都|京都府|大阪府|.{2,3}県', '', 'g')) AS rest FROM (SELECT shukubo_id, coalesce(prefecture_jp, '') || ' ' || coalesce(municipality_jp, '') AS t FROM shukubo)")
def area_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-16: an area text as its prefectures and what is left."""
    pattern = "北海道|東京都|京都府|大阪府|.{2,3}県"
    t = F.concat(F.coalesce("prefecture_jp", F.lit("")), F.lit(" "), F.coalesce("municipality_jp", F.lit("")))
    found = F.array_join(F.array_distinct(F.array_sort(F.regexp_extract_all(t, F.lit(f"({pattern})"), 1))), ",")
    return table(spark, sf_dir, "shukubo").select("shukubo_id", found.alias("prefectures"), F.trim(F.regexp_replace(t, pattern, "")).alias("rest")).distinct()


@query("""
    WITH u AS (SELECT DISTINCT dmo_id, url, len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS depth FROM dmo_spots WHERE url IS NOT NULL)
    SELECT dmo_id, arg_max(url, (10 * greatest(0, 5 - depth) + CASE WHEN contains(url, 'guide') THEN 30 ELSE 0 END + CASE WHEN regexp_matches(url, '^https') THEN 15 ELSE 0 END, url)) AS homepage FROM u GROUP BY dmo_id
""")
def homepage_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-01: of a site's addresses the one that scores highest by depth, words and scheme; ties by address."""
    u = F.col("url")
    depth = F.size(F.filter(F.split(F.regexp_extract(u, "^[a-z]+://[^/]*([^?#]*)", 1), "/"), lambda x: x != ""))
    score = 10 * F.greatest(F.lit(0), 5 - depth) + F.when(F.contains(u, F.lit("guide")), 30).otherwise(0) + F.when(u.startswith("https"), 15).otherwise(0)
    return table(spark, sf_dir, "dmo_spots").filter(u.isNotNull()).groupBy("dmo_id").agg(F.max_by("url", F.struct(score, u)).alias("homepage"))


@query("SELECT dayofweek(fetched_at AT TIME ZONE 'UTC')::INT AS day, CASE dayofweek(fetched_at AT TIME ZONE 'UTC') WHEN 1 THEN 'crafts' WHEN 3 THEN 'foods' WHEN 5 THEN 'heritage' END AS source, count(*) AS n FROM shukubo GROUP BY ALL")
def weekly_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-02, INC-09: rows by weekday (Sunday is 0) and the source whose turn it is."""
    day = F.dayofweek("fetched_at") - 1
    turn = F.element_at(F.create_map(F.lit(1), F.lit("crafts"), F.lit(3), F.lit("foods"), F.lit(5), F.lit("heritage")), F.col("day"))
    return table(spark, sf_dir, "shukubo").select(day.alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n")).select("day", turn.alias("source"), "n")


@query("""
    WITH o AS (SELECT DISTINCT osm_id, website, name, phone, postal_code, (name IS NOT NULL)::INT + (phone IS NOT NULL)::INT + (postal_code IS NOT NULL)::INT + (street IS NOT NULL)::INT AS s FROM osm_hotels WHERE website IS NOT NULL)
    SELECT website, min_by(osm_id, (-s, osm_id)) AS osm_id, min_by(name, (-s, osm_id)) FILTER (name IS NOT NULL) AS name, min_by(phone, (-s, osm_id)) FILTER (phone IS NOT NULL) AS phone, min_by(postal_code, (-s, osm_id)) FILTER (postal_code IS NOT NULL) AS postal_code FROM o GROUP BY website
""")
def best_record_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16: the record with the most tags of each site, its gaps filled from the next best."""
    tags = ["name", "phone", "postal_code", "street"]
    s = sum((F.col(c).isNotNull().cast("int") for c in tags[1:]), F.col(tags[0]).isNotNull().cast("int"))
    o = table(spark, sf_dir, "osm_hotels").filter("website is not null").select("osm_id", "website", "name", "phone", "postal_code", s.alias("s")).distinct()
    order = F.struct(-F.col("s"), F.col("osm_id"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return o.groupBy("website").agg(F.min_by("osm_id", order).alias("osm_id"), first("name"), first("phone"), first("postal_code"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?i)\\b(?:without|except|excluding|other than) ([a-z]+)', 1), ''), nullif(regexp_extract(text, '([\\x{4E00}-\\x{9FFF}\\x{30A0}-\\x{30FF}]{2,8})(?:以外|抜き|を除)', 1), '')) AS excluded FROM documents WHERE regexp_matches(text, '(?i)\\b(?:without|except|excluding|other than) [a-z]+|[\\x{4E00}-\\x{9FFF}\\x{30A0}-\\x{30FF}]{2,8}(?:以外|抜き|を除)')")
def negative_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NLQ-05: what a text taken as a query wants left out."""
    t = F.col("text")
    english = F.regexp_extract(t, r"(?i)\b(?:without|except|excluding|other than) ([a-z]+)", 1)
    japanese = F.regexp_extract(t, r"([\x{4E00}-\x{9FFF}\x{30A0}-\x{30FF}]{2,8})(?:以外|抜き|を除)", 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.nullif(english, F.lit("")), F.nullif(japanese, F.lit(""))).alias("excluded")).filter("excluded is not null")


@query("SELECT qid, 'described but unknown' AS problem FROM (SELECT qid FROM description_rows EXCEPT SELECT qid FROM attractions) UNION ALL SELECT qid, 'without name' FROM (SELECT qid FROM attractions GROUP BY qid HAVING max(coalesce(name_ja, '')) = '')")
def catalogue_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-01: rows that one table has and the other lacks, and required fields that are missing."""
    a, d = table(spark, sf_dir, "attractions"), table(spark, sf_dir, "description_rows")
    unknown = d.select("qid").distinct().join(a, "qid", "left_anti").withColumn("problem", F.lit("described but unknown"))
    nameless = a.groupBy("qid").agg(F.max(F.coalesce("name_ja", F.lit(""))).alias("n")).filter("n = ''").select("qid", F.lit("without name").alias("problem"))
    return unknown.unionByName(nameless)


@query("SELECT d.doc_id, t.topic FROM documents d LEFT JOIN (VALUES ('faq', 'help'), ('hotel_intro', 'lodging'), ('spot_text', 'sights')) AS t(kind, topic) USING (kind)")
def topic_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-02: rows annotated from a map, null where it says nothing."""
    topics = spark.createDataFrame([("faq", "help"), ("hotel_intro", "lodging"), ("spot_text", "sights")], "kind string, topic string")
    return table(spark, sf_dir, "documents").join(F.broadcast(topics), "kind", "left").select("doc_id", "topic")


@query("SELECT final_url AS canonical, spot_id FROM (SELECT final_url, spot_id, row_number() OVER (PARTITION BY final_url ORDER BY fetched_at, spot_id) AS r FROM dmo_spots WHERE final_url IS NOT NULL) WHERE r = 1")
def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06: the first page of each final address."""
    w = Window.partitionBy("final_url").orderBy("fetched_at", "spot_id")
    return table(spark, sf_dir, "dmo_spots").filter("final_url is not null").withColumn("r", F.row_number().over(w)).filter("r = 1").select(F.col("final_url").alias("canonical"), "spot_id")
