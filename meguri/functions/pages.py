"""Fields of web pages, schema.org items in them, and JSON in loosely written text.

A page is parsed once, in Arrow batches; what it yields is typed, so that all
that follows are native expressions.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "name", "description", "start_date", "end_date", "location", "address", "url")] + [T.StructField(n, T.DoubleType()) for n in ("lat", "lng")])
TEXTS = T.ArrayType(T.StringType())
PAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "language", "description", "canonical")]
    + [T.StructField(n, TEXTS) for n in ("headings", "links", "images")]
    + [T.StructField("items", T.ArrayType(ITEM))]
)
# The types of schema.org that are events, and those that are places.
EVENT_TYPES = frozenset("Event Festival ExhibitionEvent MusicEvent FoodEvent SportsEvent TheaterEvent BusinessEvent EducationEvent SocialEvent".split())
PLACE_TYPES = frozenset("Place TouristAttraction LandmarksOrHistoricalBuildings Museum Park LodgingBusiness Hotel Restaurant LocalBusiness CivicStructure PlaceOfWorship".split())


class PageReader(HTMLParser):
    """Gathers title, language, meta description, canonical address, headings, links, images and JSON-LD texts of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.fields: dict[str, str | None] = dict.fromkeys(("title", "language", "description", "canonical"))
        self.lists: dict[str, list[str]] = {"headings": [], "links": [], "images": [], "data": []}
        self.into: str | None = None
        self.text: list[str] = []

    def keep(self, name: str, value: str | None) -> None:
        if self.fields[name] is None and value and value.strip():
            self.fields[name] = " ".join(value.split())

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.keep("language", a.get("lang"))
        elif tag == "meta" and (a.get("name") or a.get("property", "")).lower() in ("description", "og:description"):
            self.keep("description", a.get("content"))
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.keep("canonical", a.get("href"))
        elif tag == "a" and a.get("href"):
            self.lists["links"].append(a["href"])
        elif tag == "img" and (a.get("src") or a.get("data-src")):
            self.lists["images"].append(a.get("src") or a["data-src"])
        if tag == "title" or tag in ("h1", "h2", "h3"):
            self.into, self.text = "title" if tag == "title" else "headings", []
        elif tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.into, self.text = "data", []

    def handle_data(self, data: str) -> None:
        if self.into:
            self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if self.into and tag in ("title", "h1", "h2", "h3", "script"):
            text = "".join(self.text)
            if self.into == "title":
                self.keep("title", text)
            elif text.strip():
                self.lists[self.into].append(text if self.into == "data" else " ".join(text.split()))
            self.into = None


def objects_of(data: object) -> list[dict]:
    """All objects of a JSON-LD document in reading order, those inside arrays and ``@graph`` too."""
    out, queue = [], [data]
    while queue:
        here = queue.pop(0)
        if isinstance(here, list):
            queue = [*here, *queue]
        elif isinstance(here, dict):
            out.append(here)
            graph = here.get("@graph")
            if graph is not None:
                queue.append(graph)
    return out


def as_text(value: object) -> str | None:
    """A value as text: a string, a number, the first of a list, or an object's value, name or id."""
    if isinstance(value, list):
        return next((t for t in map(as_text, value) if t), None)
    if isinstance(value, dict):
        return next((t for t in (as_text(value.get(k)) for k in ("@value", "name", "@id", "url")) if t), None)
    if isinstance(value, bool) or value is None:
        return None
    return str(value).strip() or None


def as_address(value: object) -> str | None:
    """An address as one text, its parts from the largest to the smallest."""
    if isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, dict):
        parts = [as_text(value.get(k)) for k in ("postalCode", "addressRegion", "addressLocality", "streetAddress")]
        return " ".join(p for p in parts if p) or None
    return as_text(value)


def as_position(value: object) -> tuple[float | None, float | None]:
    """Latitude and longitude of a geo object; nothing if either is no number in range."""
    if isinstance(value, list):
        value = value[0] if value else None
    if not isinstance(value, dict):
        return None, None
    try:
        lat, lng = float(value.get("latitude")), float(value.get("longitude"))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None, None
    return (lat, lng) if -90 <= lat <= 90 and -180 <= lng <= 180 else (None, None)


def schema_items(texts: list[str]) -> list[dict]:
    """The events and places of JSON-LD texts; a text that is no JSON is skipped."""
    out = []
    for text in texts:
        try:
            data = json.loads(text, strict=False)
        except ValueError:
            continue
        for o in objects_of(data):
            names = o.get("@type")
            known = [t for t in (names if isinstance(names, list) else [names]) if t in EVENT_TYPES or t in PLACE_TYPES]
            if not known:
                continue
            place = o.get("location") if known[0] in EVENT_TYPES else o
            inside = place if isinstance(place, dict) else {}
            lat, lng = as_position(inside.get("geo") or o.get("geo"))
            out.append(
                dict(
                    type=known[0], name=as_text(o.get("name")), description=as_text(o.get("description")), start_date=as_text(o.get("startDate")), end_date=as_text(o.get("endDate")),
                    location=as_text(place) if known[0] in EVENT_TYPES else None, address=as_address(inside.get("address")), url=as_text(o.get("url")), lat=lat, lng=lng,
                )
            )
    return out


def read_page(markup: str, base: str | None = None) -> dict:
    reader = PageReader()
    reader.feed(markup)
    reader.close()
    absolute = lambda u: urljoin(base, u) if base else u
    out: dict = dict(reader.fields)
    out["canonical"] = absolute(out["canonical"]) if out["canonical"] else None
    out["headings"] = reader.lists["headings"]
    for name in ("links", "images"):
        out[name] = list(dict.fromkeys(absolute(u) for u in reader.lists[name]))
    out["items"] = schema_items(reader.lists["data"])
    return out


def page_fields(markup: Column, address: Column) -> Column:
    """The fields of a page (struct :data:`PAGE`), its relative addresses resolved against ``address``; null for null."""

    def run(markups: pd.Series, addresses: pd.Series) -> pd.DataFrame:
        pages = [read_page(m, a) if isinstance(m, str) else dict.fromkeys(PAGE.names) for m, a in zip(markups, addresses, strict=True)]
        return pd.DataFrame(pages, columns=PAGE.names)

    parsed = F.pandas_udf(run, PAGE)(markup.cast("string"), address.cast("string"))
    return F.when(markup.isNotNull(), parsed)


# JSON in loosely written text ---------------------------------------------------------------------


def object_in(text: str) -> str | None:
    """The first whole JSON object in a text: from its brace to the brace that closes it, quoted ones aside."""
    begin = text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(begin, len(text)) if begin >= 0 else ():
        ch = text[i]
        if quoted:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if not depth:
                return text[begin : i + 1]
    return None


#: After a quote that ends a string, one of these follows.
AFTER_STRING = re.compile(r"\s*(?:[,:}\]]|$)")


def repaired(text: str) -> str:
    """JSON with the quotes inside its strings escaped: a quote ends its string only if what follows can stand there."""
    out, quoted, i = [], False, 0
    while i < len(text):
        ch = text[i]
        if quoted and ch == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        if ch == '"':
            if not quoted:
                quoted = True
            elif AFTER_STRING.match(text, i + 1):
                quoted = False
            else:
                out.append("\\")
        out.append(ch)
        i += 1
    return "".join(out)


def loose_object(text: str | None) -> str | None:
    """The JSON object in a text, with control characters and stray quotes in its strings mended, in one spelling; null if there is none."""
    if not text:
        return None
    for candidate in (object_in(text), text[text.find("{") : text.rfind("}") + 1]):
        for form in (candidate, repaired(candidate)) if candidate else ():
            try:
                return json.dumps(json.loads(form, strict=False), ensure_ascii=False)
            except ValueError:
                continue
    return None


def loose_json(text: Column) -> Column:
    """:func:`loose_object` of a column, ready for ``from_json``."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(loose_object, na_action="ignore").astype(object)

    return F.pandas_udf(run, T.StringType())(text.cast("string"))


def safe_id(key: Column) -> Column:
    """A key of letters, digits, hyphens and underscores alone: every other byte as ``_`` and its two hex digits, as is ``_`` itself."""
    bytes_ = F.regexp_extract_all(F.hex(F.encode(key, "UTF-8")), F.lit("(..)"), 1)
    plain = "^(?:3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|2D)$"  # digits, letters and the hyphen
    return F.array_join(F.transform(bytes_, lambda h: F.when(h.rlike(plain), F.decode(F.unhex(F.when(h.rlike(plain), h)), "UTF-8")).otherwise(F.concat(F.lit("_"), h))), "")


def id_of_safe(safe: Column) -> Column:
    """The key that :func:`safe_id` was made of."""
    pieces = F.regexp_extract_all(safe, F.lit("(_[0-9A-F]{2}|[^_])"), 1)
    return F.decode(F.unhex(F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("_"), F.substring(p, 2, 2)).otherwise(F.hex(F.encode(p, "UTF-8")))), "")), "UTF-8")
