"""One surviving record, field by field, of each group of duplicate records.

Method: the records of a group are points in three dimensions, completeness,
recency and trust. Those that no other record dominates are the skyline, the
first layer; without them, the next undominated ones are the second, and so on.
Every field is taken from the first layer that has a usable value of it; within
a layer a lexicographic policy decides.

Completeness and trust take few values, so a group is first reduced, map-side,
to the latest record of every (completeness, trust) cell: an older one of the
same cell is dominated by it and has nothing that it lacks. A group of any size,
also one that holds a third of all rows, therefore arrives as a handful of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands in for a value.
STAND_INS = (
    "null none nil n/a na nan undefined unknown unnamed untitled unspecified tbd tba todo tbc wip test dummy sample placeholder xxx xx x empty missing blank pending "
    "name label title description".split()
    + ["no name", "no label", "no title", "no data", "no description", "no description available", "no description yet", "no information", "not available", "not known", "not set", "not specified", "name unknown", "unknown name", "to be added", "to be written", "to be announced", "to be confirmed", "to be determined", "to follow", "coming soon", "under construction", "description here", "your description here", "text to follow", "see website", "same as above"]
)
#: Function words of English, and of the other languages of Latin script.
ENGLISH_WORDS = "the of and in to is are a an at for with from on by its it was be has have near along where which that this former small old"
FOREIGN_WORDS = "le les des du une dans est et sur avec pour qui au aux der die das und ist ein eine mit von dem den im auf für el los las del una y con por para que desde il lo gli della nel di che un per sono o os as do da dos das em uma não com na no"
#: Function words that mark a name as foreign; those that are English words too are left out.
FOREIGN_NAME_WORDS = "le les des du der das und von el los del della di et für zum zur"


def _words(words: str) -> str:
    return r"(?i)(?<![\p{L}\p{M}'-])(?:" + "|".join(words.split()) + r")(?![\p{L}\p{M}'-])"


def real_value(text: Column) -> Column:
    """Whether a text says something: not missing or blank, no stand-in, identifier or markup, not garbled."""
    t = F.trim(F.regexp_replace(text, r"(?U)[\s\p{Cf}]+", " "))
    bare = F.lower(F.regexp_replace(t, r"^[\W_]+|[\W_]+$", ""))
    identifier = r"^(?i:[QPLM]\d+|[#№]?\s*\d+|(?:node|way|relation|id)[/:#]?\s*\d+|https?://\S+|www\.\S+|urn:\S+|[0-9a-f]{8,}(?:-[0-9a-f]{4,})*|\w+_\w+_\w+|[a-z]+_\d+)$"
    markup = r"<[/!]?[A-Za-z][^<>]*>|&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);|\{\{|\}\}|\[\[|\]\]|<!--"
    garbled = r"\x{FFFD}|[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]|[\xC2-\xF4][\x80-\xBF]|\?{2,}|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}"
    return F.coalesce(t.rlike(r"\p{L}") & ~bare.isin(*STAND_INS) & ~t.rlike(identifier) & ~t.rlike(markup) & ~t.rlike(garbled), F.lit(False))


def _latin(text: Column) -> Column:
    return ~text.rlike(r"[\p{L}&&[^\p{IsLatin}]]|[\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]")


def usable_english_name(text: Column) -> Column:
    """A real, whole English name."""
    broken = r"(?:\.\.\.|…|\[\.*\]?|[,;:(\[/&-]|\((?:more|cont)[^)]*\)?)\s*$|\([^)]*$"
    return F.coalesce(real_value(text) & _latin(text) & ~text.rlike(broken) & ~text.rlike(_words(FOREIGN_NAME_WORDS)), F.lit(False))


def usable_english_text(text: Column) -> Column:
    """A real, whole English description: it ends as a sentence does and its function words are English."""
    whole = F.trim(text).rlike(r"""[^.…\s][.!?]["'”’)\]]*$""") & ~text.rlike(r"(?i)(?:\.\.\.|…|\[\.+\]|[(\[](?:read )?more\.{0,3}[)\]]?)\s*\.?$")
    english, foreign = F.regexp_count(text, F.lit(_words(ENGLISH_WORDS))), F.regexp_count(text, F.lit(_words(FOREIGN_WORDS)))
    return F.coalesce(real_value(text) & _latin(text) & whole & (english > 0) & (english >= foreign), F.lit(False))


def usable_reasons(reasons: Column) -> Column:
    """A list with at least one real reason."""
    return F.coalesce(F.exists(reasons, lambda r: F.coalesce(real_value(r), F.lit(False))), F.lit(False))


def layers(df: DataFrame, group: str, record: str, recency: str, fields: dict[str, Column], trust: Column | None = None, at_least: int = 2, counted: bool = False) -> DataFrame:
    """``(group_key, cells)``: the reduced records of each group, by layer and policy.

    A cell has ``layer`` (from 1), ``recency``, ``trust``, ``usable`` (a bit for
    each field, in their order) and ``record_id``. One record is as complete as
    another if it has every field that the other has, or with ``counted`` if it
    has as many. A record dominates another if it is as complete, as recent and
    as trusted, and in something more so. Cells come by layer, in it by the
    policy later, more trusted, more complete, smaller record id.

    Groups of fewer than ``at_least`` different records are left out, and so are
    null groups and records; a null recency counts as the oldest, a null trust
    as 0. A record delivered twice is one; of differing deliveries the best in
    each field counts. Trust is a rank of few different values.
    """
    usable = [F.when(F.coalesce(flag, F.lit(False)), 1 << i).otherwise(0) for i, flag in enumerate(fields.values())]
    level = F.coalesce(trust.cast("int"), F.lit(0)) if trust is not None else F.lit(0)
    bits = usable[0]
    for flag in usable[1:]:
        bits = bits + flag
    rows = df.select(F.col(f"`{group}`").alias("group_key"), F.col(f"`{record}`").alias("record_id"), F.col(f"`{recency}`").alias("recency"), level.alias("trust"), bits.alias("usable"))
    rows = rows.filter("group_key is not null and record_id is not null").withColumn("recency", F.coalesce("recency", F.lit("0001-01-01").cast("timestamp")))
    once = rows.groupBy("group_key", "record_id").agg(F.max("recency").alias("recency"), F.max("trust").alias("trust"), F.bit_or("usable").alias("usable"))
    # Negated, so that the least struct is the latest record and, of these, the one with the smallest id.
    age = (F.lit(0) - F.unix_micros("recency")).alias("age")
    cells = once.groupBy("group_key", "usable", "trust").agg(F.min(F.struct(age, "record_id")).alias("b"), F.count(F.lit(1)).alias("n"))
    cell = F.struct(F.col("b.age").alias("age"), (F.lit(0) - F.col("trust")).alias("distrust"), (F.lit(0) - F.bit_count("usable")).alias("gaps"), F.col("b.record_id").alias("record_id"), "usable")
    groups = cells.groupBy("group_key").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.sum("n").alias("n")).filter(F.col("n") >= at_least)
    complete = (lambda a, b: a["gaps"] <= b["gaps"]) if counted else (lambda a, b: a["usable"].bitwiseAND(b["usable"]) == b["usable"])
    more = lambda a, b: (a["age"] < b["age"]) | (a["distrust"] < b["distrust"]) | ((a["gaps"] != b["gaps"]) if counted else (a["usable"] != b["usable"]))
    beats = lambda a, b: complete(a, b) & (a["age"] <= b["age"]) & (a["distrust"] <= b["distrust"]) & more(a, b)
    # In this order whatever dominates a cell comes before it, so its layer is one more than the last of those.
    kinds = dict(df.dtypes)
    none = F.expr(f"cast(array() as array<struct<layer:int,age:bigint,distrust:int,gaps:int,record_id:{kinds[record]},usable:int>>)")
    above = lambda done, c: F.aggregate(done, F.lit(0), lambda m, d: F.when(beats(d, c), F.greatest(m, d["layer"])).otherwise(m))
    numbered = F.aggregate("cells", none, lambda done, c: F.concat(done, F.array(F.struct((above(done, c) + 1).alias("layer"), c["age"].alias("age"), c["distrust"].alias("distrust"), c["gaps"].alias("gaps"), c["record_id"].alias("record_id"), c["usable"].alias("usable")))))
    return groups.select("group_key", F.array_sort(numbered).alias("cells"))


def survivors(df: DataFrame, group: str, record: str, recency: str, fields: dict[str, Column], trust: Column | None = None, at_least: int = 2, counted: bool = False) -> DataFrame:
    """``(group_key, field, record_id, layer)``: for each field of each group, the record whose value survives and its layer.

    ``fields`` names each field and says where its value is usable; see
    :func:`layers` for the rest. No row comes out where no value of the group is
    usable. With ``counted`` false the latest usable value survives: only a
    record that has the field too can dominate the one that holds it. Exact
    repeats count once, further columns do not matter, and an empty table gives
    an empty result.
    """
    grouped = layers(df, group, record, recency, fields, trust, at_least, counted)
    first = lambda bit: F.try_element_at(F.filter("cells", lambda c: c["usable"].bitwiseAND(F.lit(bit)) != 0), F.lit(1))
    chosen = F.array(*[F.struct(F.lit(name).alias("field"), first(1 << i).alias("c")) for i, name in enumerate(fields)])
    return grouped.select("group_key", F.explode(chosen).alias("f")).filter("f.c is not null").select("group_key", "f.field", F.col("f.c.record_id").alias("record_id"), F.col("f.c.layer").alias("layer"))


def golden_records(df: DataFrame, group: str, record: str, recency: str, fields: dict[str, Column], trust: Column | None = None) -> DataFrame:
    """One built record of each group: ``group_key`` and every field of ``fields`` with its surviving value.

    Layers are those of the whole records, completeness being the number of
    usable fields. A field that no record of a layer has is filled from the next
    layer that has it; where none has, it is null. Groups of one record are kept.
    """
    chosen = survivors(df, group, record, recency, fields, trust, 1, True).select("group_key", "field", "record_id")
    usable = [F.when(F.coalesce(flag, F.lit(False)), F.col(f"`{name}`")).alias(name) for name, flag in fields.items()]
    values = df.select(F.col(f"`{group}`").alias("group_key"), F.col(f"`{record}`").alias("record_id"), *usable)
    keys = values.select("group_key").filter("group_key is not null").distinct()
    # Of differing deliveries of the record, the greatest value: whichever order they come in.
    wide = values.join(chosen, ["group_key", "record_id"]).groupBy("group_key").agg(*[F.max(F.when(F.col("field") == name, F.col(f"`{name}`"))).alias(name) for name in fields])
    return keys.join(wide, "group_key", "left")
