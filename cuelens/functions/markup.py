"""HTML and RSS as column builders.

HTML to text: comments, scripts and styles go with what they hold; every other tag is a space; the
five named entities and decimal ones below 128 are decoded, ``&amp;`` last; white space collapses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
_DROPPED = [r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>"]


def decode(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def html_text(html: Column) -> Column:
    for pattern in _DROPPED:
        html = F.regexp_replace(html, pattern, " ")
    return collapse(decode(F.regexp_replace(html, r"<[^>]*>", " ")))


def tag(xml: Column, name: str) -> Column:
    """What the first ``name`` element holds, without CDATA marks and tags; null if there is none."""
    raw = F.regexp_extract(xml, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>", 1)
    plain = F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return F.nullif(collapse(F.regexp_replace(decode(plain), r"<[^>]*>", " ")), F.lit(""))


def rss_items(xml: Column, most: int = 5) -> Column:
    """array<struct<title,link,description,published>> of the first ``most`` item blocks; blocks without a title go after that."""
    blocks = F.slice(F.regexp_extract_all(xml, F.lit(r"(?is)<item(?:\s[^>]*)?>.*?</item\s*>"), F.lit(0)), 1, most)
    fields = (("title", "title"), ("link", "link"), ("description", "description"), ("pubDate", "published"))
    items = F.transform(blocks, lambda b: F.struct(*[tag(b, t).alias(c) for t, c in fields]))
    return F.filter(items, lambda i: i["title"].isNotNull())


def xml_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text
