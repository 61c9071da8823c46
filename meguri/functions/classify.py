"""Classification by ordered rules and rule tables, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of sights by name. Each row: the kinds, and the pattern of names that have them.
NAME_KINDS: tuple[tuple[tuple[str, ...], str], ...] = (
    (("yokocho",), "横丁|横町"),
    (("shotengai",), "商店街"),
    (("jokamachi",), "城下町"),
    (("shukuba",), "宿場"),
    (("shukubo",), "宿坊"),
    (("kaido",), "街道|古道|東海道|中山道"),
    (("buke_yashiki",), "武家屋敷|侍屋敷"),
    (("machiya", "preservation_district"), "町家|町並み|古い町並"),
    (("tanada",), "棚田|段々畑"),
    (("sand_dune",), "砂丘|砂漠"),
    (("yakei", "observation"), "展望台|展望所|展望広場|展望室|スカイデッキ|ロープウェイ"),
    (("mining_heritage",), "鉱山|銀山|金山|炭鉱|炭礦|鉱業"),
    (("industrial_heritage",), "製鉄所|工場跡|紡績|造船|発電所跡"),
    (("shinto_shrine",), "神社|大社|稲荷|八幡宮|天満宮|宮$"),
    (("buddhist_temple",), "寺$|寺院|大師堂|観音堂|本堂|奥之院|奥の院"),
    (("pilgrimage_site",), "霊場|札所|遍路|巡礼"),
    (("sacred_mountain",), "霊山|御山|出羽三山|大峰山|高野山"),
    (("michi_no_eki",), "道の駅"),
    (("ski_resort",), "スキー場|ゲレンデ"),
    (("onsen_resort",), "温泉郷|温泉街|温泉地"),
    (("aquarium",), "水族館"),
    (("zoo",), "動物園|サファリパーク"),
    (("bridge",), "大橋$|橋$|つり橋|吊り橋|跨線橋"),
    (("lighthouse",), "灯台"),
    (("dam",), "ダム"),
    (("flower_garden",), "花畑|花の名所|花壇|フラワーパーク|植物園"),
    (("fishing_village", "port_town"), "漁師町|漁港|漁村"),
    (("farm_experience", "agritourism"), "農家民泊|農業体験|農業民宿|農泊|農業公園|ファーム$|果樹園|観光農園"),
)
# Prefectures in the order of their codes 01 to 47.
PREFECTURES = (
    "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 "
    "滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県"
).split()
# Concepts of travel queries. Each row: id, pattern over the query, kinds of sights it asks for, tool it is routed to.
CONCEPTS: tuple[tuple[str, str, tuple[str, ...], str | None], ...] = (
    ("shukubo", r"宿坊|shukubo|temple\s*lodging", ("buddhist_temple", "buddhist_monastery", "pilgrimage_site"), "get_hotels"),
    ("kominka", r"古民家|kominka|machiya|町家|町屋", ("preservation_district",), None),
    ("ryokan", r"旅館|ryokan|traditional\s*(?:japanese\s*)?inn", (), "get_hotels"),
    ("giyofu", r"擬洋風|giyofu|gi-?yofu", ("giyofu",), None),
    ("yokocho", r"横丁|横町|yokocho|food\s*alley|drinking\s*alley", ("yokocho",), None),
    ("shotengai", r"商店街|shotengai|shopping\s*street|covered\s*arcade", (), None),
    ("jokamachi", r"城下町|jokamachi|castle\s*town", ("castle", "japanese_castle", "preservation_district"), None),
    ("shukuba", r"宿場|shukuba|post\s*town|post-town", ("shukuba",), None),
    ("kaido", r"街道|kaido|nakasendo|tokaido", ("pilgrimage_site", "historic_site"), None),
    ("buke_yashiki", r"武家屋敷|buke\s*yashiki|samurai\s*(?:residence|district)", ("preservation_district", "historic_site"), None),
)
INDOOR = r"(?i)rainy\s*day|when\s*it\s*rains|wet\s*weather|indoors?|雨の日|雨でも|室内|屋内|インドア|梅雨"
OUTDOOR = r"(?i)outdoors?|outside|fresh\s*air|in\s*the\s*open|アウトドア|屋外|野外"
#: The one band of a quality score that a score of at least so much is in.
BANDS = (("high", 0.65), ("medium", 0.30))


def lodging_type(name: Column, name_en: Column, osm_type: Column) -> Column:
    """The type of lodging: the most specific that a name tells, else the mapped one, else hotel."""
    text = F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.lower(F.coalesce(name_en, F.lit(""))))
    low = F.lower(text)
    has = lambda *words: low.rlike("|".join(words))
    return (
        F.when(has("宿坊", "shukubo", "temple lodging"), "shukubo")
        .when(has("古民家", "kominka", "町家", "machiya"), "kominka")
        .when(has("温泉", "onsen") & has("旅館", "ryokan"), "onsen_ryokan")
        .when(has("旅館", "ryokan"), "ryokan")
        .when(has("民宿", "minshuku"), "minshuku")
        .when(has("温泉", "onsen"), "onsen_ryokan")
        .when(osm_type.isin("hostel", "guest_house", "apartment", "motel", "hotel"), osm_type)
        .otherwise("hotel")
    )


def name_kinds(name: Column) -> Column:
    """All kinds that a sight's name tells, in the order of the table, each once."""
    none = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.flatten(F.array(*[F.when(F.coalesce(name.rlike(p), F.lit(False)), F.array(*[F.lit(k) for k in kinds])).otherwise(none) for kinds, p in NAME_KINDS])))


def mapped(codes: Column, table: dict[str, str], keep_unknown: bool) -> Column:
    """A list of codes as labels, in order; unknown codes stay or fall away. Null for an empty or null list."""
    labels = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    out = F.transform(codes, lambda c: F.coalesce(F.element_at(labels, c), c) if keep_unknown else F.element_at(labels, c))
    return F.when(F.size(codes) > 0, F.array_compact(out))


def first_prefecture(text: Column) -> Column:
    """The code of the first prefecture, in the order of the codes, that a text names; null if none."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(name)), F.lit(f"{i:02d}")) for i, name in enumerate(PREFECTURES, 1)])


def prefectures_named(text: Column) -> Column:
    """The codes of all prefectures that a text names, with or without the suffix 県, by their first place in it."""
    found = []
    for i, name in enumerate(PREFECTURES, 1):
        stem = name[:-1] if name.endswith("県") else name
        at = F.when(F.locate(name, text) > 0, F.locate(name, text)).otherwise(F.locate(stem, text))
        found.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(f"{i:02d}").alias("code"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda s: s["code"])


def concepts(query: Column, table: tuple = CONCEPTS) -> Column:
    """The ids of the travel concepts in a query, in the order of the table."""
    return F.array_compact(F.array(*[F.when(query.rlike(f"(?i){p}"), F.lit(name)) for name, p, _, _ in table]))


def concept_kinds(query: Column, table: tuple = CONCEPTS) -> Column:
    """The kinds of sights that a query's concepts ask for, each once."""
    none = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.flatten(F.array(*[F.when(query.rlike(f"(?i){p}"), F.array(*[F.lit(k) for k in kinds])).otherwise(none) for _, p, kinds, _ in table if kinds])))


def routed_tool(query: Column, table: tuple = CONCEPTS) -> Column:
    """The tool of the first concept in a query that has one."""
    return F.coalesce(*[F.when(query.rlike(f"(?i){p}"), F.lit(tool)) for _, p, _, tool in table if tool])


def weather(query: Column) -> Column:
    """Whether a query asks for something indoors or outdoors; null if neither."""
    return F.when(query.rlike(INDOOR), "indoor").when(query.rlike(OUTDOOR), "outdoor")


def origin(query: Column) -> Column:
    """The place that a query starts from, in the usual English and Japanese wordings; null if none."""
    english = F.regexp_extract(query, r"(?i)\b(?:starting\s+from|departing\s+from|leaving|from)\s+([A-Za-z][A-Za-z '-]{1,40}?)(?=\s*[,.;?!:]|\s+(?:to|by|in|on|via|using|with|and)\b|$)", 1)
    japanese = F.regexp_extract(query, r"([\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]{2,12}?)\s*(?:から|発|より|を出発|を起点)", 1)
    return F.coalesce(F.nullif(F.trim(english), F.lit("")), F.nullif(japanese, F.lit("")))


def infeasible(query: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first rule of what cannot be had that a query meets; null if none."""
    return F.coalesce(*[F.when(query.rlike(f"(?i){p}"), F.lit(name)) for name, p in rules])


# What cannot be had in the country.
INFEASIBLE = (("aurora", r"aurora|northern\s*lights|オーロラ|極光"), ("camel", r"camel\s*(?:safari|ride)|ラクダ"), ("polar bear", r"wild\s*polar\s*bear|polar\s*bear\s*(?:habitat|safari)|野生.*ホッキョクグマ"), ("kangaroo", r"kangaroo\s*(?:wild|habitat)|野生.*カンガルー"), ("panda", r"wild\s*panda|野生.*パンダ"))
# Safety topics. Each row: topic, patterns that must all match, patterns of which none may.
SAFETY = (
    ("high_altitude_risk", (r"富士山|登山|ハイキング|trekking|climb|mt\.?\s*fuji", r"夜|深夜|night|midnight|軽装|light.*gear|sneakers"), ()),
    ("high_altitude_risk", (r"冬山|雪山|winter.*mount|winter.*climb", r"登山|登る|hiking|climb"), ()),
    ("high_altitude_risk", (r"富士山|mt\.?\s*fuji", r"11月|12月|1月|2月|november|december|january|february|閉山"), (r"麓|河口湖|周辺|surrounding|view.*fuji",)),
    ("pregnancy_advisory", (r"妊娠|妊婦|pregnan|expecting", r"温泉|サウナ|onsen|hot\s*spring|sauna"), ()),
    ("underage_advisory", (r"未成年|高校生|中学生|小学生|child|teenager", r"カジノ|casino|パチンコ|お酒|alcohol|sake|wine|beer|tobacco|cigarette"), ()),
    ("wildlife_encounter", (r"熊|クマ|ヒグマ|bear|猪|イノシシ|wild.?boar|毒蛇|スズメバチ|hornet", r"遭遇|出会|encounter|attack|approach|危険|dangerous"), ()),
)


def safety_topics(text: Column, rules: tuple = SAFETY) -> Column:
    """The safety topics of a text, in the order of the rules, each once."""
    out = []
    for topic, needed, vetoes in rules:
        holds = F.lit(True)
        for p in needed:
            holds = holds & text.rlike(f"(?i){p}")
        for p in vetoes:
            holds = holds & ~text.rlike(f"(?i){p}")
        out.append(F.when(holds, F.lit(topic)))
    return F.array_distinct(F.array_compact(F.array(*out)))


def quality_score(description: Column, paragraphs: Column, address: Column, located: Column, precision: Column, items: Column, images: Column) -> Column:
    """How complete a spot's record is, 0 to 1, rounded to three digits."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    count = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    told = F.when(has(description), 0.2 + F.least(F.lit(0.15), F.length(description) / 120 * 0.15)).otherwise(0.0)
    place = F.when(~F.coalesce(located, F.lit(False)), 0.0).when(precision == "exact", 0.1).when(precision == "address_geocoded", 0.07).otherwise(0.04)
    whole = told + F.least(F.lit(0.2), count(paragraphs) / 2 * 0.2) + F.when(has(address), 0.1).otherwise(0.0) + place + F.least(F.lit(0.15), count(items) * 0.15) + F.when(count(images) > 0, 0.1).otherwise(0.0)
    return F.round(whole, 3)


def quality_band(score: Column) -> Column:
    out = F.when(score >= BANDS[0][1], F.lit(BANDS[0][0]))
    for name, least in BANDS[1:]:
        out = out.when(score >= least, F.lit(name))
    return out.otherwise("low")


def operator_class(name: Column) -> Column:
    """The class of a railway operator by its name: freight first, then national, subway, monorail, tram, third sector, private."""
    return (
        F.when(name.rlike("貨物|(?i)freight"), "freight")
        .when(name.rlike("旅客鉄道|^JR|(?i)japan railways"), "jr")
        .when(name.rlike("地下鉄|メトロ|(?i)metro|subway"), "subway")
        .when(name.rlike("モノレール|(?i)monorail"), "monorail")
        .when(name.rlike("市電|電気軌道|路面電車|(?i)tram"), "tram")
        .when(name.isNull() | (F.trim(name) == ""), "unknown")
        .otherwise("private")
    )
