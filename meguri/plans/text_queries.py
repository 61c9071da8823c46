"""Queries over texts: tokens, filters, classes, retrieval, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.functions import classify, filters, text, urls
from meguri.operators import retrieval
from meguri.plans.queries import query
from meguri.session import table

SEARCH = "hilltop shrine near the harbour 温泉"
#: In the SQL dialect: the tokens of a text, as a list.
TOKENS_SQL = """flatten(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}]+|[a-z0-9]+'),
    lambda r: CASE WHEN regexp_matches(r, '^[a-z0-9]') THEN CASE WHEN length(r) >= 2 THEN [r] ELSE [] END
    ELSE flatten(list_transform(range(1, length(r) + 1), lambda i: CASE WHEN i < length(r) THEN [substring(r, i, 1), substring(r, i, 2)] ELSE [substring(r, i, 1)] END)) END))"""
BM25_SQL = f"""
    WITH d AS (SELECT doc_id, {TOKENS_SQL.format("text")} AS toks FROM documents),
         n AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
         q AS (SELECT DISTINCT unnest({TOKENS_SQL.format(f"'{SEARCH}'")}) AS term),
         p AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d),
         h AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
         f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
    SELECT doc_id, round(sum(ln(1 + (n.n - f.df + 0.5) / (f.df + 0.5)) * (h.tf * 2.2) / (h.tf + 1.2 * (0.25 + 0.75 * h.dl / n.avgdl))), 6) AS score
    FROM h JOIN f USING (term) CROSS JOIN n GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT :k
"""


@query(BM25_SQL.replace(":k", "10"))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-01, RET-02, SORT-03: the ten documents that score highest for a query."""
    return retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), SEARCH, 10)


@query(f"SELECT count(*) AS n_docs, round(avg(len({TOKENS_SQL.format('text')})), 6) AS avg_length FROM documents")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17: corpus size and mean length in tokens."""
    return retrieval.corpus_stats(table(spark, sf_dir, "documents"), F.col("text")).select("n_docs", F.round("avg_length", 6).alias("avg_length"))


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms FROM (SELECT doc_id, {TOKENS_SQL.format('text')} AS t FROM documents)")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01: tokens and different tokens of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_terms"))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 1").select("embedding").first()["embedding"])


@query("SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-03, MTH-05, SORT-02: the ten vectors nearest to one vector."""
    return retrieval.nearest_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 10)


@query("SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE e.label IS NULL OR e.label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-03, FLT-10: the same among the vectors of one label."""
    rows = table(spark, sf_dir, "embeddings").filter("label is null or label = 3")
    return retrieval.nearest_vectors(rows, "vec_id", "embedding", _query_vector(spark, sf_dir), 10)


@query(f"""
    WITH bm AS ({BM25_SQL.replace(":k", "50")}),
         ve AS (SELECT e.vec_id AS doc_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY score DESC, doc_id LIMIT 50),
         a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank_a FROM bm),
         b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank_b FROM ve)
    SELECT doc_id, round(coalesce(1.0::DOUBLE / (60 + rank_a), 0) + coalesce(1.0::DOUBLE / (60 + rank_b), 0), 5) AS score, rank_a, rank_b
    FROM a FULL OUTER JOIN b USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10
""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-04, JOIN-18, WIN-01: lexical and vector ranks fused; documents and vectors are paired by id."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return retrieval.hybrid(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), vectors, "embedding", SEARCH, _query_vector(spark, sf_dir), 10)


@query("SELECT doc_id FROM documents WHERE contains(text, 'Lighthouse') OR contains(lower(text), 'lighthouse') OR contains(source, 'Lighthouse') OR contains(lower(source), 'lighthouse')")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01: documents with a keyword in text or source."""
    return table(spark, sf_dir, "documents").filter(filters.matches_keyword(" Lighthouse ", F.col("text"), F.col("source"))).select("doc_id")


def _sql_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


@query(f"""
    SELECT DISTINCT record_id, coalesce(trim(name_ja) = '' OR lower(trim(name_ja)) IN ({_sql_list(filters.NAV_WORDS)})
      OR regexp_matches(trim(name_ja), '\\x{{FFFD}}|^[\\x{{00BF}}\\x{{00C0}}-\\x{{00FF}}]+$|^[\\s\\-・·•]+$|^[\\x{{3040}}-\\x{{30FF}}]{{1,3}}$') OR regexp_matches(lower(trim(name_ja)), '^(おすすめ特集|special feature)$')
      OR regexp_matches(trim(name_ja), '{filters.PORTAL_END}') OR list_any_value(list_filter([{_sql_list(filters.NAV_PARTS)}], lambda p: contains(lower(trim(name_ja)), p))) IS NOT NULL, true) AS is_nav
    FROM attractions
""")
def nav_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04: names that are labels of a website."""
    return table(spark, sf_dir, "attractions").select("record_id", filters.is_nav_name(F.col("name_ja")).alias("is_nav")).distinct()


@query("""
    WITH t AS (SELECT DISTINCT spot_id, coalesce(url, '') AS url, trim(coalesce(title, '')) AS t, trim(coalesce(description, '')) AS d FROM dmo_spots),
         s AS (SELECT *, regexp_matches(t, '(?i)観光|kanko|kankou|tourism|sightseeing|見どころ|名所|旅行|attraction|visit') AS st, regexp_matches(d, '(?i)観光|kanko|kankou|tourism|sightseeing|見どころ|名所|旅行|attraction|visit') AS sd, regexp_matches(url, '(?i)観光|kanko|kankou|tourism|sightseeing|見どころ|名所|旅行|attraction|visit') AS su FROM t)
    SELECT DISTINCT spot_id, CASE WHEN length(t) < 3 THEN 'title too short'
      WHEN regexp_matches(t, '(?i)^検索\\s*$|サイトマップ|sitemap|プライバシーポリシー|privacy\\s*policy|個人情報保護方針|利用規約|terms\\s*of\\s*(use|service)|お問い合わせ|^contact(\\s+us)?$|^page not found$|^404\\b|^error\\b|access\\s*denied|メンテナンス中|under\\s*maintenance') THEN 'infrastructure title'
      WHEN regexp_matches(url, '(?i)/(search|contact|privacy|terms|404|error|login|signin|maintenance)(/|$)|[?&](q|s|keyword|query|searchword)=|/sitemap(/|\\.|$)') AND NOT (st OR sd OR su) THEN 'infrastructure url'
      WHEN d = '' AND NOT st AND NOT su THEN 'no description and no tourism keyword' END AS reason FROM s
""")
def spot_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07, FLT-15: why a page is not taken as a sight's, null if it is."""
    return table(spark, sf_dir, "dmo_spots").select("spot_id", filters.rejected_spot(F.col("url"), F.col("title"), F.col("description")).alias("reason")).distinct()


@query(f"""
    SELECT doc_id, coalesce(list_any_value(list_filter([{_sql_list(filters.FOOD_JA)}], lambda p: contains(text, p))) IS NOT NULL OR list_any_value(list_filter([{_sql_list(filters.FOOD_EN)}], lambda p: contains(lower(text), p))) IS NOT NULL, false) AS food,
      coalesce(list_any_value(list_filter([{_sql_list(filters.FESTIVAL_JA)}], lambda p: contains(text, p))) IS NOT NULL OR list_any_value(list_filter([{_sql_list(filters.FESTIVAL_EN)}], lambda p: contains(lower(text), p))) IS NOT NULL, false) AS festival
    FROM documents
""")
def topic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05, TOOL-11, TOOL-12: documents that speak of food or of festivals."""
    return table(spark, sf_dir, "documents").select("doc_id", filters.is_food_text(F.col("text")).alias("food"), filters.is_festival_text(F.col("text")).alias("festival"))


@query("SELECT DISTINCT record_id, admin_name FROM attractions WHERE lower(admin_name) = '霧浜町' OR regexp_replace(lower(admin_name), '[市町村区]$', '') IN ('霧浜町', '霧浜') OR contains(lower(admin_name), '霧浜') OR contains(regexp_replace(lower(admin_name), '[市町村区]$', ''), '霧浜町')")
def municipality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-02, FLT-03: attractions of a municipality by its name."""
    return table(spark, sf_dir, "attractions").filter(filters.matches_municipality(F.col("admin_name"), "霧浜町")).select("record_id", "admin_name").distinct()


@query("SELECT DISTINCT record_id FROM attractions WHERE (prefecture_code IS NULL OR prefecture_code = '' OR prefecture_code = '26') AND coordinates.lat BETWEEN 34 AND 36 AND coordinates.lng BETWEEN 135 AND 136 AND NOT (len(types) > 0 AND len(list_filter(types, lambda x: x <> 'Q900510')) = 0 AND types IS NOT NULL)")
def place_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10, FLT-12, FLT-14: a prefecture or none, a box, and not of one type alone."""
    a = table(spark, sf_dir, "attractions")
    keep = filters.in_prefecture(F.col("prefecture_code"), "26") & filters.in_box(F.col("coordinates.lat"), F.col("coordinates.lng"), 34, 36, 135, 136) & filters.not_only(F.col("types"), "Q900510")
    return a.filter(keep).select("record_id").distinct()


@query("SELECT DISTINCT osm_id FROM osm_hotels WHERE NOT coalesce(contains(name, 'ホテル') OR contains(name, 'Hotel'), false)")
def excluded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11, NLQ-06: rows without any of the excluded words in their name."""
    return table(spark, sf_dir, "osm_hotels").filter(filters.without_tokens(F.col("name"), ["ホテル", "Hotel"])).select("osm_id").distinct()


@query("""
    SELECT lodging, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(t, '宿坊|shukubo|temple lodging') THEN 'shukubo' WHEN regexp_matches(t, '古民家|kominka|町家|machiya') THEN 'kominka'
      WHEN regexp_matches(t, '温泉|onsen') AND regexp_matches(t, '旅館|ryokan') THEN 'onsen_ryokan' WHEN regexp_matches(t, '旅館|ryokan') THEN 'ryokan' WHEN regexp_matches(t, '民宿|minshuku') THEN 'minshuku'
      WHEN regexp_matches(t, '温泉|onsen') THEN 'onsen_ryokan' WHEN type IN ('hostel', 'guest_house', 'apartment', 'motel', 'hotel') THEN type ELSE 'hotel' END AS lodging
      FROM (SELECT lower(coalesce(name, '') || ' ' || coalesce(name_en, '')) AS t, type FROM osm_hotels)) GROUP BY lodging
""")
def lodging_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-01, AGG-04: hotels by type of lodging."""
    return table(spark, sf_dir, "osm_hotels").groupBy(classify.lodging_type(F.col("name"), F.col("name_en"), F.col("type")).alias("lodging")).agg(F.count(F.lit(1)).alias("n"))


def _kinds_sql(column: str) -> str:
    rows = ", ".join(f"CASE WHEN regexp_matches({column}, '{p}') THEN [{_sql_list(list(kinds))}] ELSE [] END" for kinds, p in classify.NAME_KINDS)
    return f"list_distinct(flatten([{rows}]))"


@query(f"SELECT kind, count(*) AS n FROM (SELECT unnest({_kinds_sql('name_ja')}) AS kind FROM attractions) GROUP BY kind")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-02, CLS-03, AGG-15: attractions by the kinds that their names tell."""
    return table(spark, sf_dir, "attractions").select(F.explode(classify.name_kinds(F.col("name_ja"))).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


LABELS = {"Q900600": "historic site", "Q900601": "place of scenic beauty", "Q900602": "natural monument", "Q900603": "cultural property"}


@query("""
    WITH m AS (SELECT map(['Q900600', 'Q900601', 'Q900602', 'Q900603'], ['historic site', 'place of scenic beauty', 'natural monument', 'cultural property']) AS l)
    SELECT record_id, array_to_string(list_transform(heritage_designations, lambda c: coalesce(l[c], c)), '|') AS labels, len(list_filter(heritage_designations, lambda c: l[c] IS NOT NULL))::BIGINT AS n_known
    FROM (SELECT DISTINCT record_id, heritage_designations FROM attractions) CROSS JOIN m WHERE len(heritage_designations) > 0
""")
def heritage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-02, ARR-03: codes as labels, unknown ones raw."""
    codes = F.col("heritage_designations")
    rows = table(spark, sf_dir, "attractions").select("record_id", "heritage_designations").distinct().filter(F.size(codes) > 0)
    return rows.select("record_id", F.array_join(classify.mapped(codes, LABELS, True), "|").alias("labels"), F.size(classify.mapped(codes, LABELS, False)).cast("bigint").alias("n_known"))


def _prefecture_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{name}') THEN '{i:02d}'" for i, name in enumerate(classify.PREFECTURES, 1)) + " END"


@query(f"SELECT DISTINCT shukubo_id, {_prefecture_sql('address_jp')} AS code FROM shukubo")
def first_prefecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-07: the first prefecture that an address names."""
    return table(spark, sf_dir, "shukubo").select("shukubo_id", classify.first_prefecture(F.col("address_jp")).alias("code")).distinct()


@query(f"""
    WITH p AS (SELECT * FROM (VALUES {", ".join(f"('{name}', '{name[:-1] if name.endswith('県') else name}', '{i:02d}')" for i, name in enumerate(classify.PREFECTURES, 1))}) AS v(name, stem, code)),
         h AS (SELECT s.shukubo_id, p.code, CASE WHEN instr(t, name) > 0 THEN instr(t, name) ELSE instr(t, stem) END AS pos FROM (SELECT DISTINCT shukubo_id, coalesce(address_jp, '') || ' ' || coalesce(authority, '') || ' ' || coalesce(prefecture_jp, '') AS t FROM shukubo) s, p)
    SELECT shukubo_id, string_agg(code, ',' ORDER BY pos, code) AS codes FROM h WHERE pos > 0 GROUP BY shukubo_id
""")
def prefectures_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-12, JOIN-13, JOIN-14: all prefectures that a text names, in order."""
    t = F.concat_ws(" ", F.coalesce("address_jp", F.lit("")), F.coalesce("authority", F.lit("")), F.coalesce("prefecture_jp", F.lit("")))
    return table(spark, sf_dir, "shukubo").select("shukubo_id", t.alias("t")).distinct().select("shukubo_id", F.array_join(classify.prefectures_named(F.col("t")), ",").alias("codes")).filter("codes <> ''")


@query("""
    SELECT class, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(operator_name, '貨物|(?i)freight') THEN 'freight' WHEN regexp_matches(operator_name, '旅客鉄道|^JR|(?i)japan railways') THEN 'jr'
      WHEN regexp_matches(operator_name, '地下鉄|メトロ|(?i)metro|subway') THEN 'subway' WHEN regexp_matches(operator_name, 'モノレール|(?i)monorail') THEN 'monorail' WHEN regexp_matches(operator_name, '市電|電気軌道|路面電車|(?i)tram') THEN 'tram'
      WHEN operator_name IS NULL OR trim(operator_name) = '' THEN 'unknown' ELSE 'private' END AS class FROM stations) GROUP BY class
""")
def operator_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-06: stations by the class of their operator."""
    return table(spark, sf_dir, "stations").groupBy(classify.operator_class(F.col("operator_name")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def _concept_sql(column: str) -> str:
    return ", ".join(f"CASE WHEN regexp_matches({column}, '(?i){p}') THEN '{name}' END" for name, p, _, _ in classify.CONCEPTS)


@query(f"""
    SELECT doc_id, array_to_string(list_filter([{_concept_sql('text')}], lambda x: x IS NOT NULL), ',') AS concepts, CASE WHEN regexp_matches(text, '{classify.INDOOR}') THEN 'indoor' WHEN regexp_matches(text, '{classify.OUTDOOR}') THEN 'outdoor' END AS weather,
      coalesce({", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{tool}' END" for _, p, _, tool in classify.CONCEPTS if tool)}) AS tool
    FROM documents WHERE text IS NOT NULL
""")
def query_understanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NLQ-01, NLQ-03, NLQ-07: concepts, weather and tool of each text taken as a query."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").filter(t.isNotNull()).select("doc_id", F.array_join(classify.concepts(t), ",").alias("concepts"), classify.weather(t).alias("weather"), classify.routed_tool(t).alias("tool"))


def _safety_sql(column: str) -> str:
    rows = []
    for topic, needed, vetoes in classify.SAFETY:
        holds = " AND ".join([f"regexp_matches({column}, '(?i){p}')" for p in needed] + [f"NOT regexp_matches({column}, '(?i){p}')" for p in vetoes])
        rows.append(f"CASE WHEN {holds} THEN '{topic}' END")
    return f"list_filter([{', '.join(rows)}], lambda x: x IS NOT NULL)"


@query(f"SELECT topic, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct({_safety_sql('text')})) AS topic FROM documents WHERE text IS NOT NULL) GROUP BY topic")
def safety_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-09: documents by safety topic."""
    return table(spark, sf_dir, "documents").select(F.explode(classify.safety_topics(F.col("text"))).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query()
def query_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NLQ-02, NLQ-04: the place a text starts from; the English pattern looks ahead, which the SQL dialect cannot."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", classify.origin(t).alias("origin"), classify.infeasible(t, classify.INFEASIBLE).alias("infeasible")).filter("origin is not null or infeasible is not null")


@query("""
    WITH u AS (SELECT DISTINCT spot_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#.*)?$', ['scheme', 'host', 'path', 'query']) AS p FROM dmo_spots WHERE url IS NOT NULL),
         c AS (SELECT spot_id, url, lower(p.scheme) AS scheme, CASE lower(p.scheme) WHEN 'https' THEN regexp_replace(lower(p.host), ':443$', '') WHEN 'http' THEN regexp_replace(lower(p.host), ':80$', '') ELSE lower(p.host) END AS host,
                      regexp_replace(p.path, '(?i)/(index\\.html|index\\.htm|index\\.php|default\\.html)$', '/') AS path,
                      list_sort(list_filter(string_split(p.query, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'utm_id', 'fbclid', 'gclid', 'msclkid', 'ref', 'ref_src', 'from'))) AS q FROM u)
    SELECT spot_id, scheme || '://' || host || CASE WHEN length(path) > 1 THEN CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM c
""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09, STR-10: canonical addresses of pages."""
    return table(spark, sf_dir, "dmo_spots").filter("url is not null").select("spot_id", "url").distinct().select("spot_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("SELECT doc_id, substring(sha1(concat_ws('|', source, doc_id::VARCHAR)), 1, 12) AS id12, substring(sha256(coalesce(text, '')), 1, 16) AS id16 FROM documents")
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07: short identifiers by hash."""
    return table(spark, sf_dir, "documents").select("doc_id", text.short_sha1(F.col("source"), F.col("doc_id").cast("string")).alias("id12"), text.short_sha256(F.coalesce("text", F.lit(""))).alias("id16"))


@query("""
    SELECT DISTINCT osm_id, trim(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(name, ''), '株式会社|有限会社|（株）|\\(株\\)|（有）|\\(有\\)|株式|合同会社|（合）', '', 'g'), 'ホテル|hotel|旅館|ryokan|inn|ゲストハウス|guest\\s*house|guesthouse|hostel|ホステル|民宿|温泉|リゾート|resort', '', 'gi'), '[\\s\\x{3000}・·.,()（）&＆‐\\-]', '', 'g'))) AS name_key,
      right(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g'), 10) AS phone_key FROM osm_hotels
""")
def hotel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03, STR-04: the forms in which hotel names and phone numbers are compared."""
    return table(spark, sf_dir, "osm_hotels").select("osm_id", text.normal_hotel_name(F.col("name")).alias("name_key"), text.normal_phone(F.col("phone")).alias("phone_key")).distinct()


@query("""
    SELECT DISTINCT shukubo_id, substring(trim(regexp_extract(regexp_replace(address_jp, '〒?\\s*\\d{3}-?\\d{4}\\s*', '', 'g'), '^([^\\n（(【]*)', 1)), 1, 60) AS address, greatest(1, floor(length(description_ja) / 3.0))::INT AS tokens,
      regexp_replace(regexp_replace(lower(name_en), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM shukubo
""")
def address_and_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11, STR-17, STR-18: cleaned addresses, token estimates, slugs."""
    estimate = F.when(F.col("description_ja").isNotNull(), text.token_estimate(F.col("description_ja"))).otherwise(F.lit(1))
    return table(spark, sf_dir, "shukubo").select("shukubo_id", text.clean_address(F.col("address_jp")).alias("address"), estimate.alias("tokens"), text.slug(F.col("name_en")).alias("slug")).distinct()


@query()
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12: documents cut into chunks; tested against a plain version."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("number", "chunk"))


@query("SELECT doc_id, 'passage: ' || substring(concat_ws(' ', nullif(trim(text), ''), nullif(trim(source), '')), 1, 600) AS passage FROM documents")
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15: the texts that an embedding model is given."""
    return table(spark, sf_dir, "documents").select("doc_id", text.passage("passage: ", 600, F.col("text"), F.col("source")).alias("passage"))


REQUIRED = ["en", "ja", "ko"]
ALLOWED = ["ja", "en", "zh", "ko", "fr", "de", "es", "it", "pt"]


@query(f"""
    SELECT qid, array_to_string(list_sort(list_concat(
      list_transform(list_filter([{_sql_list(REQUIRED)}], lambda k: coalesce(trim(descriptions[k]) = '' OR lower(trim(descriptions[k])) IN ({_sql_list(list(text.PLACEHOLDERS))}), true)), lambda k: 'missing ' || k),
      list_transform(list_filter(map_keys(descriptions), lambda k: k NOT IN ({_sql_list(ALLOWED)})), lambda k: 'unknown language ' || k),
      CASE WHEN confidence NOT IN ('high', 'medium', 'low') THEN ['bad confidence'] ELSE [] END)), '; ') AS errors
    FROM (SELECT DISTINCT qid, descriptions, confidence FROM description_rows)
""")
def translation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-19, DQ-01: what is wrong with records of translations."""
    rows = table(spark, sf_dir, "description_rows").select("qid", F.col("descriptions"), "confidence")
    return rows.select("qid", F.array_join(text.translation_errors(F.col("descriptions"), F.col("confidence"), REQUIRED, ALLOWED), "; ").alias("errors")).distinct()
