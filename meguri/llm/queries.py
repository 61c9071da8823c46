"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.llm import boilerplate, components, establishments, language, leakage, lookalikes, residue, survivorship, tokenize
from meguri.session import table

#: Where the columns of an establishment lie in either source.
WIKIDATA = dict(id="qid", name="name_ja", name_en="name_en", name_ko="name_ko", name_zh="name_zh", phone="phone", website="website", postal="postal_code", street="street_address", coordinates="coordinates")
OSM = dict(id="osm_id", name="name", name_en="name_en", name_ko="name_ko", name_zh="name_zh", phone="phone", website="website", postal="postal_code", street="street", coordinates="coordinates")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of a confirmed pair with the smallest id of its group."""
    return components.connected_components(table(spark, sf_dir, "hotel_pairs").filter("confidence = 'confirmed'"), "left_source_id", "right_source_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record whose value survives, for each contested field of each duplicate group."""
    attractions, hotels = table(spark, sf_dir, "attractions"), table(spark, sf_dir, "matched_hotels")
    source = F.col("source_anchor")
    trust = F.when(source == "p1435", 3).when(source == "v2", 2).when(source.isNotNull(), 1).otherwise(0)
    a = survivorship.survivors(attractions, "qid", "record_id", "fetched_at", {"name_en": survivorship.usable_english_name(F.col("name_en")), "description_en": survivorship.usable_english_text(F.col("description_en"))}, trust)
    sure = F.when(F.col("confidence") == "confirmed", 2).when(F.col("confidence").isNotNull(), 1).otherwise(0)
    b = survivorship.survivors(hotels, "id", "record_id", "matched_at", {"match_reasons": survivorship.usable_reasons(F.col("match_reasons"))}, sure)
    one = lambda df, name: df.select(F.lit(name).alias("table_name"), F.col("group_key").cast("string").alias("group_key"), "field", F.col("record_id").cast("bigint").alias("record_id"))
    return one(a, "attractions").unionByName(one(b, "matched_hotels"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are not in the plain spelling of their look."""
    out = None
    for name, key, field in (("attractions", "record_id", "name_ja"), ("osm_hotels", "osm_id", "name"), ("shukubo", "shukubo_id", "address_jp")):
        part = lookalikes.find_lookalikes(table(spark, sf_dir, name), name, key, field)
        out = part if out is None else out.unionByName(part)
    return out.select("table_name", "record_key", "field").distinct()


def language_model(spark: SparkSession, sf_dir: str) -> language.LanguageModel:
    """The model fitted on a bounded sample of labelled texts: documents, and the texts of description rows under their keys."""
    documents = table(spark, sf_dir, "documents").select(language.code_of(F.col("lang")).alias("lang"), "text")
    rows = table(spark, sf_dir, "description_rows").select(F.explode(F.map_entries("descriptions")).alias("e")).select(language.code_of(F.col("e.key")).alias("lang"), F.col("e.value").alias("text"))
    samples = [language.labelled_sample(df) for df in (documents, rows)]
    return language.fit({name: [t for s in samples for t in s.get(name, [])] for name in language.LANGUAGES})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing or wrong language labels of pages, paragraphs and map keys, with the true language."""
    model = language_model(spark, sf_dir)
    pages = language.wrong_page_labels(table(spark, sf_dir, "dmo_spots"), "spot_id", "language", "description", "body_paragraphs", model)
    keys = language.wrong_map_keys(table(spark, sf_dir, "description_rows"), "qid", "descriptions", model)
    one = lambda df, name: df.select(F.lit(name).alias("table_name"), "record_key", "slot", "lang")
    return one(pages, "dmo_spots").unionByName(one(keys, "description_rows")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lodging records of the two sources that are one establishment."""
    stations = table(spark, sf_dir, "stations")
    readings = stations.select(F.regexp_replace("name_ja", "駅$", "").alias("place"), F.lower(F.regexp_replace(F.regexp_replace("name_en", "(?i) station$", ""), "[^A-Za-z]", "")).alias("reading"))
    linked = establishments.link(establishments.records(table(spark, sf_dir, "wikidata_hotels"), WIKIDATA), establishments.records(table(spark, sf_dir, "osm_hotels"), OSM), readings)
    return linked.select(F.col("left_id").alias("qid"), F.col("right_id").alias("osm_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of extracted pages that are furniture of the website."""
    return boilerplate.find_furniture(table(spark, sf_dir, "dmo_spots"), "spot_id").select(F.col("page_key").alias("spot_id"), "slot")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte_bpe_50k ids of every document."""
    return tokenize.encode_ids(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold test passages, with the passages."""
    found = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select(F.col("doc_key").alias("doc_id"), F.col("item_key").alias("item_id"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are or contain template residue, filler, error messages or script notices."""
    return residue.find_residue(table(spark, sf_dir, "documents")).select(F.col("doc_key").alias("doc_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p5_found, p7_found, p8_ids, p9_found, p10_found)}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can say in full; the other operators are tested against brute force and exact round trips."""
    return {
        "p1_found": """
            WITH RECURSIVE pairs AS (
                SELECT DISTINCT left_source_id AS a, right_source_id AS b FROM hotel_pairs
                WHERE confidence = 'confirmed' AND left_source_id <> '' AND right_source_id <> '' AND left_source_id <> right_source_id
            ), edges AS (
                SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
            ), reach(node, other) AS (
                SELECT a, a FROM edges
                UNION
                SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a
            )
            SELECT node AS record_key, min(other) AS group_key FROM reach GROUP BY node
        """,
    }
