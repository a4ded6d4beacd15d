"""URL normal forms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .files import url_decoded
from .text import clean_text

# Query parameters that only track, and addresses of schemas rather than of content.
TRACKING = r"(?i)^(utm_[a-z0-9_]+|gclid|fbclid|msclkid)$"
SCHEMA_ADDRESSES = r"(imsglobal\.org/(xsd|profile/cc)|w3\.org/2001/(xmlschema|xmlschema-instance)|imsccv\d|ccv\d.*\.xsd|imswl_v\d.*\.xsd)"
PARTS = r"(?i)^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(#.*)?$"


def normal_url(c: Column | str) -> Column:
    """host/path?query#fragment of an http address without www., tracking parameters, repeated or trailing
    slashes; empty for any other text."""
    raw = clean_text(c)
    part = lambda i: F.regexp_extract(raw, PARTS, i)
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.when(part(3) == "", "/").otherwise(part(3)), "/+", "/"), "/+$", "")
    kept = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~url_decoded(F.element_at(F.split(p, "="), 1)).rlike(TRACKING))
    query = F.array_join(kept, "&")
    address = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), part(5))
    return F.when(~raw.rlike("(?i)^https?://"), "").when(part(2) == "", raw).otherwise(address)


def is_schema_address(c: Column | str) -> Column:
    raw = F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    return (raw == "") | raw.rlike(SCHEMA_ADDRESSES)


def external_links(links: Column) -> Column:
    """Distinct normal addresses of an array of links, in order of their first place."""
    found = F.transform(F.filter(links, lambda x: ~is_schema_address(x)), normal_url)
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def html_links(html: Column | str) -> Column:
    """Values of href attributes in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), 1)


def is_safe_web_url(c: Column | str) -> Column:
    """http or https without credentials."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(r"(?i)^https?://[^/?#@\s]+([/?#]\S*)?$"), F.lit(False))


def video_id(c: Column | str) -> Column:
    """11-character video id of the three usual forms of address; empty if none."""
    return F.regexp_extract(c, r"(?:youtu\.be/|youtube\.com/(?:embed/|watch\?(?:[^#]*&)?v=))([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)
