"""Canonical forms of web addresses, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and file names of a folder's index.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "msclkid", "ref", "ref_src", "from")
INDEX_FILES = "index\\.html|index\\.htm|index\\.php|default\\.html"


def canonical_url(url: Column) -> Column:
    """A URL without fragment, default port, index file, trailing slash and tracking parameters, its host in lower case
    and its parameters sorted. What is no absolute URL stays as it is; null stays null."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda n: F.regexp_extract(url, pattern, n)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    path = F.regexp_replace(part(3), f"(?i)/(?:{INDEX_FILES})$", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    kept = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(url.rlike(pattern), whole).otherwise(url)


def pick_canonical(fetched: Column, declared: Column) -> Column:
    """The address that a page declares as its own, else the fetched one, in canonical form."""
    return canonical_url(F.coalesce(F.nullif(F.trim(declared), F.lit("")), fetched))


def urls_in(text: Column) -> Column:
    """All web addresses in a text."""
    return F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"'）)」]+)"), 1)


def of_portal(url: Column, domains: list[str]) -> Column:
    """Whether an address holds one of the given pieces of portals' addresses; false for null."""
    found = F.lit(False)
    for domain in domains:
        found = found | F.contains(url, F.lit(domain))
    return F.coalesce(found, F.lit(False))
