"""Company and posting names: normalised keys, slugs and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words inside parentheses that are no brand, suffixes that slugs go without, and separators of titles.
PAREN_STOPWORDS = ("formerly", "inc", "corp", "the", "an", "a")
SLUG_SUFFIXES = ("inc", "labs", "ai", "technologies", "technology", "systems", "group", "corp", "corporation", "llc", "co", "gmbh", "industries", "app", "software", "ventures", "health", "science", "sciences")
TITLE_SEPARATORS = (":", "—", "–", " | ")


def text(c: Column) -> Column:
    """Null as the empty string, which means unknown almost everywhere."""
    return F.coalesce(c, F.lit(""))


def known(c: Column) -> Column:
    """The empty string as null."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; null as the empty string."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def ascii_key(name: Column) -> Column:
    """Lower case, only ASCII letters and digits."""
    return F.regexp_replace(F.lower(text(name)), "[^a-z0-9]", "")


def name_key(name: Column) -> Column:
    """As :func:`ascii_key`, without what stands in parentheses."""
    return ascii_key(F.regexp_replace(F.lower(text(name)), r"\s*\(.*?\)\s*", " "))


def unicode_key(name: Column) -> Column:
    """Lower case, only letters and digits of any script."""
    return F.regexp_replace(F.lower(text(name)), r"[^\p{L}\p{N}]", "")


def slug_candidates(name: Column) -> Column:
    """Board slugs to try for a name, in order and distinct: its key; words in parentheses; without a suffix; without
    trailing digits."""
    base = name_key(name)
    inside = F.regexp_extract_all(F.lower(text(name)), F.lit(r"\(([^)]+)\)"), F.lit(1))
    words = F.filter(F.flatten(F.transform(inside, lambda x: F.split(x, "[^a-z0-9]+"))), lambda w: (w != "") & ~w.isin(*PAREN_STOPWORDS))
    shorter = F.transform(F.array(*map(F.lit, SLUG_SUFFIXES)), lambda s: F.when(F.endswith(base, s) & (F.length(base) > F.length(s) + 2), F.substring(base, F.lit(1), F.length(base) - F.length(s))).otherwise(F.lit("")))
    # Without a key of its own a name has no candidates.
    words = F.when(base == "", F.array().cast("array<string>")).otherwise(words)
    return F.array_distinct(F.filter(F.concat(F.array(base), words, shorter, F.array(F.regexp_replace(base, r"\d+$", ""))), lambda x: x != ""))


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


def pretty_name(slug: Column) -> Column:
    """A slug's words apart; those in lower case get a capital, others keep their case."""
    words = F.filter(F.split(text(slug), r"[-_\s]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w == F.lower(w), _capital(w)).otherwise(w)), " ")


def humanised_slug(slug: Column) -> Column:
    """A slug as a title: no trailing UUID or ``-number``, every word capitalised."""
    plain = F.regexp_replace(F.lower(text(slug)), r"-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "")
    plain = F.regexp_replace(plain, r"-\d+$", "")
    return F.array_join(F.transform(F.filter(F.split(plain, "[-_]+"), lambda w: w != ""), _capital), " ")


def company_from_title(title: Column) -> Column:
    """The company that a feed's posting title names: what stands before the first separator of
    :data:`TITLE_SEPARATORS` that leaves 2 to 60 characters, else before any dash, colon or bar; "" if none does."""
    t = text(title)

    def fits(head: Column) -> Column:
        return F.length(head).between(2, 60)

    rest = F.trim(F.split(t, r"\s*[:—–\-|]\s*", 2)[0])
    out = F.when(t.rlike(r"[:—–\-|]") & fits(rest), rest).otherwise(F.lit(""))
    for separator in reversed(TITLE_SEPARATORS):
        head = F.trim(F.substring_index(t, separator, 1))
        out = F.when(F.contains(t, F.lit(separator)) & fits(head), head).otherwise(out)
    return out


def is_junk_slug(slug: Column) -> Column:
    """Six or more digits only; one character five times or more; seven or more without a vowel but with a digit."""
    s = F.lower(text(slug))
    return s.rlike(r"^\d{6,}$") | s.rlike(r"^(.)\1{4,}$") | ((F.length(s) >= 7) & ~s.rlike("[aeiou]") & s.rlike(r"\d"))
