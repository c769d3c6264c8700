"""The parsing halves of the company-list collectors: payloads to raw company entries.

Each takes rows ``(seq, payload)`` or parsed columns and gives ``company_name, website, career_page_url, ats_type,
source_platform`` and ``seq``; fetching, pausing and retrying belong to the transport.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.html import clean_basic, links, page_name
from heddle.functions.names import ascii_key, company_from_title, humanised_slug, known, pretty_name, text
from heddle.functions.urls import board_from_url, is_domain, workable_slug
from heddle.operators.match import is_board_url, split_link, valid_name
from heddle.operators.merge import fill_missing, first_per_key

ENTRY = ("seq", "company_name", "website", "career_page_url", "ats_type", "source_platform")


def _entries(rows: DataFrame, source: str, name: Column, website: Column | None = None, careers: Column | None = None) -> DataFrame:
    url = text(careers) if careers is not None else F.lit("")
    return rows.select(F.col("seq"), F.trim(name).alias("company_name"), (text(website) if website is not None else F.lit("")).alias("website"), url.alias("career_page_url"), F.coalesce(board_from_url(url), F.lit("unknown")).alias("ats_type"), F.lit(source).alias("source_platform"))


def _first(entries: DataFrame, key: Column | None = None) -> DataFrame:
    keyed = entries.withColumn("_key", ascii_key(F.col("company_name")) if key is None else key).where("_key <> ''")
    return first_per_key(keyed, ["_key"], ["seq"]).drop("_key")


def _place(level: str = "pos") -> Column:
    return (F.col("seq") * F.lit(1 << 20) + F.col(level)).alias("seq")


def wiki_names(pages: DataFrame, meta: tuple[str, ...] = ()) -> DataFrame:
    """First cells of table rows and bullets of a list page: what stands before a parenthesis, if it can be a name."""
    cells = F.concat(F.regexp_extract_all("payload", F.lit(r"(?is)<tr[^>]*>\s*<td[^>]*>(.*?)</td>"), F.lit(1)), F.regexp_extract_all("payload", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1)))
    rows = pages.select("seq", F.posexplode(cells).alias("pos", "cell")).select(_place(), F.trim(F.regexp_replace(clean_basic(F.col("cell")), r"\s*[\(\[].*$", "")).alias("n"))
    return _first(_entries(rows.where(valid_name(F.col("n"), 60, meta)), "wikipedia", F.col("n")))


def directory_cards(pages: DataFrame, marker: str, name: str, website: str, source: str) -> DataFrame:
    """A page cut at a marker into cards; a pattern's first group in each card is a field."""
    cards = F.slice(F.split("payload", marker), 2, F.greatest(F.size(F.split("payload", marker)) - 1, F.lit(0)))
    rows = pages.select("seq", F.posexplode(cards).alias("pos", "card")).select(_place(), "card")
    return _first(_entries(rows, source, clean_basic(F.regexp_extract("card", name, 1)), F.regexp_extract("card", website, 1)))


def directory_api(pages: DataFrame, schema: str, source: str, name: str = "name", website: str = "website", items: str | None = None) -> DataFrame:
    """JSON pages of records: an array, or one under a member."""
    data = F.from_json(F.get_json_object("payload", f"$.{items}") if items else F.col("payload"), f"array<struct<{schema}>>")
    rows = pages.select("seq", F.posexplode(data).alias("pos", "r")).select(_place(), "r")
    return _first(_entries(rows, source, text(F.col("r")[name]), F.col("r")[website]))


def profile_pages(pages: DataFrame, blocked: tuple[str, ...] = ()) -> DataFrame:
    """``(seq, slug, payload)``: the page's name, and its first outside link that leads to no blocked site."""
    outside = F.filter(links(F.col("payload")), lambda u: F.startswith(u, F.lit("http")) & ~F.exists(F.array(*map(F.lit, blocked)) if blocked else F.array().cast("array<string>"), lambda b: F.contains(u, b)))
    return _first(_entries(pages, "profile", page_name(F.col("payload"), humanised_slug(F.col("slug"))), F.try_element_at(outside, F.lit(1))))


def markdown_table(lines: DataFrame) -> DataFrame:
    """Rows ``| [name](url) | ...`` of a README; a workable subdomain is rewritten to its shared host."""
    row = r"^\|\s*\[([^\]]+)\]\((https?://[^)\s]+)\)"
    rows = lines.select("seq", F.regexp_extract("value", row, 1).alias("n"), F.regexp_extract("value", row, 2).alias("u")).where("n <> ''")
    slug = workable_slug(F.col("u"))
    url = F.when(slug != "", F.concat(F.lit("https://apply.workable.com/"), slug)).otherwise(F.col("u"))
    careers, site = split_link(url)
    return _first(_entries(rows, "markdown-table", F.col("n"), site, careers))


def markdown_links(lines: DataFrame, meta: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> DataFrame:
    """Links ``[name](url)`` anywhere in a README, routed to careers page or website."""
    link = r"\[([^\]]{1,60})\]\((https?://[^\s)]+|www\.[^\s)]+)\)"
    both = F.arrays_zip(F.regexp_extract_all("value", F.lit(link), F.lit(1)).alias("n"), F.regexp_extract_all("value", F.lit(link), F.lit(2)).alias("u"))
    rows = lines.select("seq", F.posexplode(both).alias("pos", "l")).select(_place(), F.col("l.n").alias("raw"), F.col("l.u").alias("u"))
    n = F.regexp_replace(F.replace("raw", F.lit("`"), F.lit("")), r"^(?:#+|\||\*|-|>|\s|[0-9]+\.?\s)+|[\s|\-*_:.,]+$", "")
    rows = rows.where(~F.col("raw").rlike(r"^!|[\[>]")).withColumn("n", n)
    low = F.lower("n")
    rows = rows.where((F.col("n") != "") & ~low.rlike(r"^(?:http|www\.|ftp|category:|list of)|://") & ~low.isin("", *meta) & ~F.exists(F.array(F.lit("\0"), *map(F.lit, skip)), lambda s: F.contains(F.lower("u"), s)))
    careers, site = split_link(F.col("u"))
    return _first(_entries(rows, "markdown-links", F.col("n"), site, careers))


def remote_feed(items: DataFrame, source: str) -> DataFrame:
    """``(seq, company, title, url)``: the company as named or as its title says; merged, later rows filling gaps."""
    name = F.coalesce(known(F.trim(text(F.col("company")))), known(company_from_title(F.col("title"))))
    entries = _entries(items, source, name, None, F.when(is_board_url(F.col("url")), F.col("url"))).where("company_name is not null")
    keyed = entries.withColumn("_key", ascii_key(F.col("company_name"))).where("_key <> ''")
    merged = fill_missing(keyed, ["_key"], ["seq"]).join(keyed.groupBy("_key").agg(F.min("seq").alias("seq")), "_key")
    return merged.withColumns({c: text(F.col(c)) for c in ("website", "career_page_url")}).select(*ENTRY)


def listings_json(items: DataFrame, source: str = "listings") -> DataFrame:
    """``(seq, company_name, url, active)``: active rows by company, each with its first board URL without a query."""
    rows = items.where(F.coalesce("active", F.lit(False)) & valid_name(F.col("company_name"), 100)).withColumn("_key", ascii_key(F.col("company_name")))
    board = F.when(is_board_url(F.col("url")), F.regexp_replace("url", r"[?#].*$", ""))
    best = rows.groupBy("_key").agg(F.min("seq").alias("seq"), F.min_by("company_name", "seq").alias("n"), F.min_by(board, F.when(board.isNotNull(), F.col("seq"))).alias("u"))
    return _entries(best, source, F.col("n"), None, F.col("u"))


def sitemap_companies(pages: DataFrame, resolved: DataFrame, pattern: str = r"<loc>[^<]*/companies/([^/<?#]+)</loc>") -> DataFrame:
    """Slugs of a sitemap with their resolved names, else the slug made readable."""
    rows = pages.select("seq", F.posexplode(F.regexp_extract_all("payload", F.lit(pattern), F.lit(1))).alias("pos", "slug")).select(_place(), "slug")
    rows = first_per_key(rows, ["slug"], ["seq"]).join(resolved.select("slug", F.col("name").alias("_name")), "slug", "left")
    return _entries(rows, "vc-sitemap", F.coalesce(known(F.col("_name")), humanised_slug(F.col("slug"))))


def board_companies(rows: DataFrame, source: str) -> DataFrame:
    """``(seq, name, domain)`` of an embedded list; a domain that is an industry's name is left out."""
    site = F.when(is_domain(F.col("domain")), F.concat(F.lit("https://"), F.trim("domain")))
    return _first(_entries(rows, source, F.col("name"), site))


def top_terms(rows: DataFrame, term: str, n: int = 1000) -> DataFrame:
    """A remote terms aggregation: the n most frequent values."""
    return rows.where(F.col(term).isNotNull()).groupBy(term).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), term).limit(n)


def aggregator_slugs(rows: DataFrame) -> DataFrame:
    """``slug|cluster|endpoint`` lines: a pretty name and the first endpoint of each slug."""
    part = lambda i: text(F.try_element_at(F.split("value", r"\|"), F.lit(i)))
    split = rows.select("seq", part(1).alias("slug"), part(3).alias("endpoint")).where("slug <> ''")
    return _entries(first_per_key(split, ["slug"], ["seq"]), "aggregator", pretty_name(F.col("slug")), None, F.col("endpoint"))


def board_csv(rows: DataFrame, board: str) -> DataFrame:
    """``(seq, slug, url)`` of a CSV export, first slug wins; the tenant of a workday slug is what precedes its bar."""
    slug = F.substring_index("slug", "|", 1) if board == "workday" else F.col("slug")
    kept = first_per_key(rows.withColumn("slug", slug).where("slug <> ''"), ["slug"], ["seq"])
    return _entries(kept, f"csv-{board}", pretty_name(F.col("slug")), None, F.col("url")).withColumn("ats_type", F.lit(board))


def curated(companies: DataFrame, paths: tuple[str, ...] = ("/careers", "/jobs")) -> DataFrame:
    """``(seq, company_name, website)``: a careers page for each path."""
    rows = companies.select("seq", "company_name", "website", F.posexplode(F.array(*map(F.lit, paths))).alias("pos", "path")).withColumn("place", _place())
    rows = rows.drop("seq").withColumnRenamed("place", "seq")
    return _entries(rows, "curated", F.col("company_name"), F.col("website"), F.concat(F.regexp_replace("website", "/+$", ""), F.col("path")))


def query_pairs(countries: DataFrame, roles: DataFrame) -> DataFrame:
    """Every country with every role, to drive a sweep: two short lists of literals."""
    listed = roles.agg(F.collect_set("role").alias("roles"))
    return countries.join(F.broadcast(listed), F.lit(True), "left").select("country", F.explode("roles").alias("role"))


def pending(wanted: DataFrame, tried: DataFrame, n: int = 30) -> DataFrame:
    """The next n (slug, url) that were not tried with this URL yet."""
    return wanted.join(tried.select("slug", "url"), ["slug", "url"], "left_anti").orderBy("slug", "url").limit(n)
