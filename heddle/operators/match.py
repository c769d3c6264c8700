"""Predicates over postings, titles and names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.automaton import any_hit, hits
from heddle.functions.names import text
from heddle.functions.urls import URL_RULES, any_of
from heddle.profile import Profile

#: Seniority words that do not exclude a title with a role, marks of places in the US or Canada
#: anywhere in a location, such places alone or at an end of it, and preferences that name no region.
SENIORITY = ("senior", "sr", "sr.")
US_MARKS = (
    "united states", " us ", " us-", "us -", "- us", " usa ", "usa)", "u.s.", "u.s. ", "america", "new york", "san francisco", "boston",
    "seattle", "chicago", "austin", "denver", "washington dc", "los angeles", "toronto", "canada", "bay area", "west coast",
)
US_BARE = ("us", "usa", "u.s.", "u.s.a.", "united states of america", "america", "canada", "ca", "united states", "north america")
NO_REGION = ("remote", "worldwide", "global")
NOT_ROLE = "title not in target roles"
EXCLUDED = "title matched exclude keyword"
US_ONLY = "remote but US/CA-only"
NO_PLACE = "no location info for non-remote role"
#: Fixed value: titles of other kinds of role.
OTHER_ROLES = r"(?i)\b(manager|director|head of|vp|intern|principal|chief|internship)\b"
OTHER_ROLES_LEAD = r"(?i)\b(manager|director|head of|vp|intern|lead\s+engineer|principal|chief|internship)\b"
#: Above so many literals one alternation is tested instead of one substring after the other.
FEW = 24


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether any literal occurs in a column, as substrings or as one pattern of quoted literals."""
    if len(parts) <= FEW:
        return any_of(c, parts)
    return c.rlike("|".join("\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E" for p in parts))


Has = Callable[[Column, tuple[str, ...]], Column]


def role_hit(title: Column, profile: Profile, has: Has = contains_any) -> Column:
    return has(title, profile.role_keywords) if profile.role_keywords else F.lit(True)


def reasons(title: Column, location: Column, work_type: Column, profile: Profile, in_title: Has = contains_any, in_location: Has = contains_any) -> Column:
    """Why a posting is rejected, in the order of the rules; an empty array accepts it. Null counts as empty.

    ``in_title`` and ``in_location`` say whether one of some literals occurs in a title or location.
    """
    t, loc, kind = (F.lower(text(c)) for c in (title, location, work_type))
    hit = role_hit(t, profile, in_title)
    plain = tuple(k for k in profile.exclude_keywords if k not in SENIORITY)
    senior = tuple(k for k in profile.exclude_keywords if k in SENIORITY)
    excluded = in_title(t, plain) | (~hit & in_title(t, senior))
    bare = F.regexp_replace(F.trim(loc), r"\.+$", "")
    american = in_location(loc, US_MARKS) | bare.isin(*US_BARE)
    for place in US_BARE:
        american = american | F.endswith(loc, F.lit(f" {place}")) | F.startswith(loc, F.lit(f"{place} "))
    regions = tuple(p for p in profile.location_pref if p not in NO_REGION)
    elsewhere = F.concat(F.lit("location '"), text(location), F.lit("' not in preferred list"))
    place = F.when(kind == "remote", F.when(american & ~in_location(loc, regions), F.lit(US_ONLY))).when(
        kind.isin("hybrid", "onsite", ""), F.when(loc == "", F.lit(NO_PLACE)).when(~in_location(loc, profile.location_pref), elsewhere)
    )
    return F.filter(F.array(F.when(~hit, F.lit(NOT_ROLE)), F.when(excluded, F.lit(EXCLUDED)), place), lambda x: x.isNotNull())


def match(postings: DataFrame, profile: Profile, title: str = "title", location: str = "location", work_type: str = "work_type") -> DataFrame:
    """Postings with ``reasons`` and ``matched``."""
    why = reasons(F.col(title), F.col(location), F.col(work_type), profile)
    return postings.withColumn("reasons", why).withColumn("matched", F.size("reasons") == 0)


def _by_hits(found: str, patterns: tuple[str, ...]) -> Has:
    place = {p: i for i, p in enumerate(patterns)}

    def has(_: Column, parts: tuple[str, ...]) -> Column:
        return F.lit(True) if "" in parts else any_hit(F.col(found), [place[p] for p in parts])

    return has


def match_long(postings: DataFrame, profile: Profile, title: str = "title", location: str = "location", work_type: str = "work_type") -> DataFrame:
    """As :func:`match`, for long texts and long lists: all literals of a text are found by one automaton in one pass.

    Worth its way through Python where texts are long and lists have dozens of words; see the README for figures.
    """
    words = tuple(dict.fromkeys(p for p in (*profile.role_keywords, *profile.exclude_keywords) if p))
    places = tuple(dict.fromkeys(p for p in (*US_MARKS, *profile.location_pref) if p))
    found = postings.withColumns({"_words": hits(F.lower(text(F.col(title))), words), "_places": hits(F.lower(text(F.col(location))), places)})
    why = reasons(F.col(title), F.col(location), F.col(work_type), profile, _by_hits("_words", words), _by_hits("_places", places))
    return found.withColumn("reasons", why).withColumn("matched", F.size("reasons") == 0).drop("_words", "_places")


def relevant(title: Column, role: Column, lead: bool = False) -> Column:
    """Whether a title names a role, spaces aside, and no other kind of role. With ``lead``, lead engineers are another
    kind of role, and development engineers are none."""
    t, r = F.lower(text(title)), F.lower(text(role))
    named = F.contains(t, r) | F.contains(F.replace(t, F.lit(" "), F.lit("")), F.replace(r, F.lit(" "), F.lit("")))
    if not lead:
        return named & ~t.rlike(OTHER_ROLES)
    return named & (~t.rlike(OTHER_ROLES_LEAD) | t.rlike(r"\b(sd|software development engineer)") | F.startswith(t, F.lit("sdet")))


def is_board_url(url: Column) -> Column:
    return any_of(F.lower(text(url)), [m for _, marks in URL_RULES for m in marks])


def allowed(name: Column, allow: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> Column:
    """Exact names in lower case; an empty allow list allows all."""
    n = F.lower(text(name))
    out = F.lit(True) if not allow else n.isin(*(a.lower() for a in allow))
    return out & ~n.isin(*(s.lower() for s in skip)) if skip else out


def enumerable(board: Column, token: Column, boards: tuple[str, ...]) -> Column:
    """A board that can be read and a token to read it with."""
    return board.isin(*boards) & (text(token) != "")


def posted_within(posted: Column, days: int, as_of: Column) -> Column:
    """Posted in the last days; an unknown date is not."""
    return F.coalesce(posted >= as_of - F.expr(f"interval {int(days)} days"), F.lit(False))


def valid_name(name: Column, longest: int = 60, meta: tuple[str, ...] = ()) -> Column:
    """A plausible company name: not empty, not too long, no digit in front, no word of the page's own."""
    n = F.trim(text(name))
    out = (n != "") & (F.length(n) <= longest) & ~n.rlike(r"^\d")
    return out & ~F.lower(n).isin(*meta) if meta else out


def split_link(url: Column) -> tuple[Column, Column]:
    """A link as (careers page, website): one of the two, by whether it looks like a careers page."""
    careers = is_board_url(url) | any_of(F.lower(text(url)), ("career", "/jobs", "join", "hiring"))
    return F.when(careers, url).otherwise(F.lit("")), F.when(careers, F.lit("")).otherwise(url)
