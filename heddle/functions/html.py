"""HTML and embedded JSON. Python only where no built-in exists: entities, balanced braces, key search."""

from __future__ import annotations

import html as _html
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from heddle.functions.names import strip, text


@F.pandas_udf(StringType())
def unescape(values: pd.Series) -> pd.Series:
    """HTML entities as the characters they stand for."""
    return values.map(lambda v: v if v is None or "&" not in v else _html.unescape(v))


def strip_tags(value: Column) -> Column:
    return F.regexp_replace(text(value), r"<[^>]+>", "")


def one_line(value: Column) -> Column:
    return strip(F.regexp_replace(text(value), r"(?U)\s+", " "))


def clean(value: Column) -> Column:
    """No tags, entities resolved, single spaces."""
    return one_line(unescape(strip_tags(value)))


def clean_basic(value: Column) -> Column:
    """As :func:`clean` but built-in only: the entities &amp; &quot; &#39; &lt; &gt; &nbsp;."""
    out = strip_tags(value)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return one_line(out)


def page_title(page: Column) -> Column:
    """The trimmed text of the first title element; "" if none."""
    return strip(F.regexp_extract(text(page), r"(?is)<title[^>]*>(.*?)</title>", 1))


def og_title(page: Column) -> Column:
    return F.regexp_extract(text(page), r"(?i)<meta[^>]*property=\"og:title\"[^>]*content=\"([^\"]*)\"", 1)


def page_name(page: Column, slug: Column) -> Column:
    """A profile page's name: its title's first part, else og:title, else the first heading, else the slug."""
    head = F.trim(F.regexp_extract(page_title(page), r"^([^|–—]+)", 1))
    h1 = clean_basic(F.regexp_extract(text(page), r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return F.coalesce(F.nullif(head, F.lit("")), F.nullif(og_title(page), F.lit("")), F.nullif(h1, F.lit("")), slug)


def links(page: Column) -> Column:
    """All href values of anchors, in order."""
    return F.regexp_extract_all(text(page), F.lit(r"(?i)<a\b[^>]*?href=\"([^\"]*)\""), F.lit(1))


def link_by_id(page: Column, element: str) -> Column:
    """The href of the anchor with an id, whichever attribute stands first."""
    a = F.regexp_extract(text(page), rf"(?i)<a\b[^>]*\bid=\"{element}\"[^>]*\bhref=\"([^\"]*)\"", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(F.regexp_extract(text(page), rf"(?i)<a\b[^>]*\bhref=\"([^\"]*)\"[^>]*\bid=\"{element}\"", 1), F.lit("")), F.lit(""))


def balanced_json(page: str | None, name: str) -> str | None:
    """The JSON object assigned to ``name`` in a page: from its first brace to the one that closes it.

    Braces inside strings don't count; null where there is none or it never closes.
    """
    at = (page or "").find(name)
    start = page.find("{", at) if at >= 0 else -1
    if start < 0:
        return None
    try:
        return json.dumps(json.JSONDecoder().raw_decode(page, start)[0])
    except ValueError:
        return None


def first_key(value: object, key: str) -> object:
    """The first value of ``key`` in nested JSON, depth first; None where it is absent or null everywhere."""
    stack = [value]
    while stack:
        now = stack.pop()
        if isinstance(now, dict):
            if key in now:
                return now[key]
            stack.extend(reversed(list(now.values())))
        elif isinstance(now, list):
            stack.extend(reversed(now))
    return None


def assigned_json(page: Column, name: str) -> Column:
    @F.pandas_udf(StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: balanced_json(p, name))

    return run(page)


def json_first_key(payload: Column, key: str) -> Column:
    """The first value of ``key`` anywhere in a JSON text, as JSON text."""

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            found = None if v is None else first_key(json.loads(v), key)
            return None if found is None else json.dumps(found)

        return values.map(one)

    return run(payload)
