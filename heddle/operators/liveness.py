"""Whether a page or board is live, from what a fetch brought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.html import page_title
from heddle.functions.names import text

#: Signs of a missing page in a title, and in the first characters of a body.
DEAD_TITLE = r"(?i)(not found|404|doesn'?t exist|does not exist|no longer)"
DEAD_BODY = (
    r"(?i)(page not found|404\s*[-–—]?\s*(not found|error)|we couldn'?t find|could not find (that |the )?page|"
    r"this page (doesn'?t|does not) exist|page (doesn'?t|does not) exist|no longer available|has been removed|the page you (were )?looking for)"
)
BODY_CHARS = 32768


def looks_dead(page: Column, body_chars: int = BODY_CHARS) -> Column:
    """A page that says it is missing although it was served, in its title or its first characters; 0 means all of them."""
    body = F.substring(text(page), 1, body_chars) if body_chars else text(page)
    return page_title(page).rlike(DEAD_TITLE) | body.rlike(DEAD_BODY)


def verdict(url: Column, status: Column, page: Column, body_chars: int = BODY_CHARS) -> Column:
    """live, dead or unknown. A null status means that the fetch failed."""
    served = status.between(200, 399)
    return (
        F.when(~F.startswith(text(url), F.lit("http")), "dead")
        .when(status.isNull(), "unknown")
        .when(status.isin(404, 410), "dead")
        .when(served & looks_dead(page, body_chars), "dead")
        .when(served, "live")
        .otherwise("unknown")
    )


def probe_verdict(n_items: Column, error: Column) -> Column:
    """Of a board read: any number of items is live; an error that says so is dead; other errors tell nothing."""
    e = F.lower(text(error))
    return F.when(error.isNull() & n_items.isNotNull(), "live").when(F.contains(e, F.lit("404")) | F.contains(e, F.lit("not found")), "dead").otherwise("unknown")


def verdict_counts(df: DataFrame, by: str, column: str = "verdict") -> DataFrame:
    """A row per source with a count for each verdict, 0 where there is none."""
    return df.groupBy(by).agg(*(F.count_if(F.col(column) == v).alias(v) for v in ("live", "dead", "unknown")))


def prune(rows: DataFrame, checked: DataFrame, key: str) -> DataFrame:
    """Rows without those found dead."""
    return rows.join(checked.where("verdict = 'dead'").select(key), key, "left_anti")
