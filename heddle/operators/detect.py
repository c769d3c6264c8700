"""Which company a page belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.names import text, unicode_key
from heddle.functions.urls import board_from_host, host
from heddle.operators.merge import pick

LEAST = 35
#: Characters of the grams by which needles are looked up in hosts.
GRAM = 4


def _path(url):
    return F.regexp_replace(F.lower(text(F.try_parse_url(url, F.lit("PATH")))), "/+$", "")


def _suffixes(name):
    """A host, and what is left of it without its first labels."""
    parts = F.split(name, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _grams(value, size: int):
    """The distinct substrings of a length; none of a shorter value."""
    starts = F.when(F.length(value) >= size, F.sequence(F.lit(1), F.length(value) - size + 1))
    return F.array_distinct(F.coalesce(F.transform(starts, lambda i: F.substring(value, i, F.lit(size))), F.array().cast("array<string>")))


def holding(hosts: DataFrame, needles: DataFrame, size: int = GRAM) -> DataFrame:
    """``needles(needle, ...)`` with each ``host`` that contains them, by an inverted index of grams; both sides distinct.

    Needles below ``size`` characters are looked up as a whole among the pieces of their lengths.
    """
    grams = hosts.select("host", F.explode(_grams(F.col("host"), size)).alias("gram"))
    common = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("hosts"))
    long = needles.where(F.length("needle") >= size).withColumn("_all", _grams(F.col("needle"), size))
    pieces = long.select("needle", F.size("_all").alias("n"), F.explode("_all").alias("gram")).distinct().join(common, "gram")
    rarest = pieces.groupBy("needle").agg(F.min_by("gram", F.struct("hosts", "gram")).alias("gram"), F.count(F.lit(1)).alias("found"), F.first("n").alias("n")).where("found = n")
    # A needle that is as long as a gram is its gram.
    found = grams.join(long.drop("_all").join(rarest.select("needle", "gram"), "needle"), "gram").where(F.contains("host", "needle")).drop("gram")
    lengths = [r[0] for r in needles.where(F.length("needle") < size).select(F.length("needle")).distinct().collect()]  # fewer than ``size`` numbers
    for n in lengths:
        short = hosts.select("host", F.explode(_grams(F.col("host"), n)).alias("needle"))
        found = found.unionByName(short.join(needles.where(F.length("needle") == n), "needle"))
    return found


def detect(pages: DataFrame, companies: DataFrame, page_id: str = "page_id") -> DataFrame:
    """The best company for each page: an equal address scores 100, a host that is the other's or under it 60, a
    domain hint in the host 45, the name's key (4 characters or more) in the host 35; of equals the first.

    ``companies`` holds seq, company_name, career_page_url, alternate_career_urls, website, domain_hint, ats_type and
    board_token. match_type is the last rule that fired, score the best one. A page without a company falls back to
    the board its host belongs to, with score 10. Pages without a host have no row.

    No page meets all companies. An address is an equi join. Hosts meet by their suffixes. Hints and keys are found by an
    inverted index of the hosts' GRAM-grams: each needle is looked up by the one of its grams that fewest hosts have, one with
    a gram that no host has is not looked up at all, and what is found is checked. So a host makes a row for each of its
    distinct grams (its length at most), and a needle is one row. Of the companies that share a home, hint or key only the
    first can be a page's best, so no host gathers companies.
    """
    p = pages.select(F.col(page_id).alias("page_id"), host(F.col("url")).alias("host"), _path(F.col("url")).alias("path"), F.col("url").alias("page_url")).where("host is not null and host <> ''")
    hosts = p.select("host").distinct()
    c = companies.select("seq", text(F.col("career_page_url")).alias("url"), F.coalesce("alternate_career_urls", F.array().cast("array<string>")).alias("others"), text(F.col("website")).alias("website"), F.lower(text(F.col("domain_hint"))).alias("hint"), unicode_key(F.col("company_name")).alias("key"))
    urls = c.select("seq", F.explode(F.concat(F.array("url"), "others")).alias("u")).where("u <> ''").select("seq", host(F.col("u")).alias("host"), _path(F.col("u")).alias("path"))
    exact = p.join(urls.groupBy("host", "path").agg(F.min("seq").alias("seq")), ["host", "path"]).select("page_id", "seq")

    homes = c.select("seq", F.explode(F.array("url", "website")).alias("u")).select("seq", host(F.col("u")).alias("home")).where("home is not null and home <> ''").groupBy("home").agg(F.min("seq").alias("seq"))
    under = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("home")).join(homes, "home").select("host", "seq")
    above = homes.select("seq", F.explode(_suffixes(F.col("home"))).alias("host")).join(hosts, "host").select("host", "seq")
    hints = c.where("hint <> ''").groupBy(F.col("hint").alias("needle")).agg(F.min("seq").alias("seq"))
    keys = c.where(F.length("key") >= 4).groupBy(F.col("key").alias("needle")).agg(F.min("seq").alias("seq"))
    needles = hints.withColumn("score", F.lit(45)).unionByName(keys.withColumn("score", F.lit(35)))
    inside = holding(hosts, needles).select("host", "seq", "score")
    scored = under.unionByName(above).withColumn("score", F.lit(60)).unionByName(inside)
    top = scored.groupBy("host").agg(F.min_by(F.struct("seq", "score"), F.struct(-F.col("score"), "seq")).alias("top")).select("host", "top.*")
    # The last rule that fired is a matter of the best company alone.
    named, hinted = (F.length("key") >= 4) & F.contains("host", "key"), (F.col("hint") != "") & F.contains("host", "hint")
    loose = p.join(top.join(c.select("seq", "hint", "key"), "seq").select("host", "seq", "score", F.when(named, "name").when(hinted, "domain").otherwise("host").alias("match_type")), "host")
    first = exact.groupBy("page_id").agg(F.min("seq").alias("seq"))
    every = loose.select("page_id", "seq", "score", "match_type").unionByName(first.select("page_id", "seq", F.lit(100).alias("score"), F.lit("url").alias("match_type")))
    best = pick(every.where(F.col("score") >= LEAST), ["page_id"], [F.desc("score"), "seq"])
    named = best.join(companies.select("seq", "company_name", "ats_type", "board_token"), "seq")
    out = p.select("page_id", "page_url").join(named, "page_id", "left")
    board = board_from_host(F.col("page_url"))
    return out.where(F.col("seq").isNotNull() | board.isNotNull()).select(
        "page_id", F.coalesce("ats_type", F.when(F.col("seq").isNull(), board)).alias("ats"), F.col("company_name").alias("company"), "board_token", F.coalesce("match_type", F.lit("host_pattern")).alias("match_type"), F.coalesce("score", F.lit(10)).alias("score")
    )
