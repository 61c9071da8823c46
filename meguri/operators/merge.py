"""Keyed merges of record tables, and of maps from language to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def filled(first: Column, second: Column) -> Column:
    """The first value that is neither null nor the empty text."""
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def overwrite(base: DataFrame, add: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` overwritten by what ``add`` has under the same key, where it has something."""
    other = add.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(other, key, "left")
    return joined.select(*[filled(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def merge_records(base: DataFrame, add: DataFrame, key: str, fields: list[str], lists: list[str], anchor: str | None = None) -> DataFrame:
    """Full outer merge of two tables of one row a key: the base wins in each field, lists are united, anchors joined.

    The anchor names where a record came from: both, sorted, with a plus sign.
    """
    a = base.select(F.col(key), *[F.col(c).alias(f"a_{c}") for c in [*fields, *lists, *([anchor] if anchor else [])]])
    b = add.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in [*fields, *lists, *([anchor] if anchor else [])]])
    none = lambda c: F.coalesce(c, F.array())
    out = [F.col(key)]
    out += [F.coalesce(F.col(f"a_{c}"), F.col(f"b_{c}")).alias(c) for c in fields]
    out += [F.array_distinct(F.concat(none(F.col(f"a_{c}")), none(F.col(f"b_{c}")))).alias(c) for c in lists]
    if anchor:
        names = F.concat(F.split(F.coalesce(F.col(f"a_{anchor}"), F.lit("")), r"\+"), F.split(F.coalesce(F.col(f"b_{anchor}"), F.lit("")), r"\+"))
        out.append(F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda n: n != ""))), "+").alias(anchor))
    return a.join(b, key, "full_outer").select(*out)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose key is not in it."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; the order must be total."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def longer_text(old: Column, new: Column, factor: float = 1.4) -> Column:
    """The new text where the old one is missing, or the new one is longer by more than the factor."""
    has_old, has_new = F.coalesce(old != "", F.lit(False)), F.coalesce(new != "", F.lit(False))
    return F.when(has_new & (~has_old | (F.length(new) > F.length(old) * factor)), new).otherwise(old)


def missing_languages(texts: Column, required: list[str]) -> Column:
    """The required languages without a text in a map, in order."""
    return F.filter(F.array(*[F.lit(x) for x in required]), lambda k: F.coalesce(F.trim(F.element_at(texts, k)) == "", F.lit(True)))


def pick_language(texts: Column, wanted: str, fallback: str = "ja") -> Column:
    """The text in the wanted language, else in the fallback, else null."""
    return filled(F.element_at(texts, wanted), F.element_at(texts, fallback))


def layered(languages: list[str], *layers: tuple[str, Column]) -> Column:
    """Of each language, the text of the first layer that has one and that layer's name: ``map<lang, struct<text, source>>``."""
    entries = []
    for lang in languages:
        text = F.coalesce(*[F.nullif(F.element_at(m, lang), F.lit("")) for _, m in layers])
        source = F.coalesce(*[F.when(F.coalesce(F.element_at(m, lang) != "", F.lit(False)), F.lit(name)) for name, m in layers])
        entries += [F.lit(lang), F.struct(text.alias("text"), source.alias("source"))]
    return F.create_map(*entries)


def fill(base: DataFrame, add: DataFrame, key: str, fields: list[str], lists: list[str] | None = None) -> DataFrame:
    """``base`` with its empty fields filled from ``add``, lists united, and the records that only ``add`` has, marked ``inserted``.

    What ``base`` has is kept. One row a key on either side; the empty text counts as missing.
    """
    lists = lists or []
    a, b = (df.select(key, *[F.col(c).alias(f"{side}_{c}") for c in [*fields, *lists]], F.lit(True).alias(f"{side}_here")) for side, df in (("a", base), ("b", add)))
    none = lambda c: F.coalesce(c, F.array())
    out = [filled(F.col(f"a_{c}"), F.col(f"b_{c}")).alias(c) for c in fields]
    out += [F.array_distinct(F.concat(none(F.col(f"a_{c}")), none(F.col(f"b_{c}")))).alias(c) for c in lists]
    return a.join(b, key, "full_outer").select(key, *out, F.col("a_here").isNull().alias("inserted"))


def override(base: DataFrame, manual: DataFrame, key: str, field: str) -> DataFrame:
    """``(key, field, out_of_scope)``: a manual value fills an empty one, a manual null takes the record out of scope."""
    named = manual.select(key, F.col(field).alias("_manual"), F.lit(True).alias("_named"))
    joined = base.join(named, key, "left")
    out = F.coalesce(F.col("_named") & F.col("_manual").isNull(), F.lit(False))
    value = F.when(out, F.lit(None)).when(F.col(field) != "", F.col(field)).otherwise(F.coalesce("_manual", F.col(field)))
    return joined.select(key, value.alias(field), out.alias("out_of_scope"))


def nested_rows(documents: DataFrame, levels: list[str]) -> DataFrame:
    """The rows of the innermost of nested lists, with the columns of everything around them; outer names yield to inner ones."""
    for level in levels:
        fields = documents.schema[level].dataType.elementType.names
        outer = [c for c in documents.columns if c != level and c not in fields]
        documents = documents.select(*outer, F.explode(level).alias("_row")).select(*outer, *[F.col(f"_row.{f}").alias(f) for f in fields])
    return documents


def out_of_scope(old: DataFrame, new: DataFrame, targets: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, fault)`` of records in both runs: changed though no target, or a target and unchanged."""
    both = old.select(key, F.col(value).alias("_old")).join(new.select(key, F.col(value).alias("_new")), key)
    marked = both.join(targets.select(key).distinct().withColumn("_target", F.lit(True)), key, "left").select(key, (~F.col("_old").eqNullSafe(F.col("_new"))).alias("changed"), F.coalesce("_target", F.lit(False)).alias("target"))
    return marked.filter("changed <> target").select(key, F.when(F.col("changed"), "changed outside").otherwise("target unchanged").alias("fault"))
