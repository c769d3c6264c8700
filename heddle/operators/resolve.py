"""The company dimension: many overlapping lists consolidated to one row per company.

Input rows carry ``seq``, their place over all files in file-name order; every ordered choice goes by it. Groups
are aggregated, not gathered: all that is collected per company are its distinct URLs, labels and sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.names import known, name_key, slug_candidates, strip, text
from heddle.functions.urls import PATH_BOARDS, SUBDOMAIN_BOARDS, board_from_url, board_slug, board_token, company_key, first_segment, legacy_bare_domain, url_rank

RAW = "seq long, company_name string, career_page_url string, website string, domain_hint string, ats_type string, source_platform string"
#: Large companies that are flagged.
FLAGGED = (
    "stripe", "cloudflare", "figma", "mongodb", "elastic", "gitlab", "lyft", "doordash", "epic games", "opentable", "zillow", "poshmark",
    "udemy", "taboola", "adyen", "toast", "canonical", "fastly", "airtable", "rubrik", "nasuni", "logicmonitor", "fourkites",
    "wikimedia foundation", "duolingo", "ramp", "rippling", "anduril industries", "scale ai", "anthropic", "openai", "hugging face",
    "notion", "vercel", "replit", "ret tool", "retool", "cohere", "coreweave", "nebius", "grafana labs", "kraken", "ripple", "phantom",
    "brex", "mercury", "posthog", "linear", "coder", "supabase", "perplexity", "mistr al ai", "elevenlabs", "zapier", "duckduckgo",
    "buffer", "close",
)
#: Boards known for certain, by name key.
VERIFIED = (
    ("stripe", "greenhouse", "https://boards.greenhouse.io/stripe"),
    ("ramp", "ashby", "https://jobs.ashbyhq.com/ramp"),
    ("notion", "ashby", "https://jobs.ashbyhq.com/notion"),
    ("replit", "ashby", "https://jobs.ashbyhq.com/replit"),
    ("cursor", "ashby", "https://jobs.ashbyhq.com/cursor"),
    ("huggingface", "workable", "https://apply.workable.com/huggingface/"),
)
#: Sources in the order in which companies are listed; others come last.
ORDER = (
    "greenhouse", "lever", "ashby", "smartrecruiters", "workable", "personio", "workday", "bamboohr", "trinethire", "onlyfy", "keka",
    "pinpoint", "breezyhr", "teamtailor", "rippling", "attrax", "applytojob", "custom", "yc", "unknown",
)
AUTOMATABLE = ORDER[:17]
NO_STANDARD = ("custom", "yc", "unknown")


def canonical_names(entries: DataFrame, key: str = "key", name: str = "company_name", seq: str = "seq") -> DataFrame:
    """Each key's most frequent spelling; of equals the shortest, then the first."""
    spelled = entries.groupBy(key, name).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first"))
    return spelled.groupBy(key).agg(F.min_by(name, F.struct(-F.col("n"), F.length(name), F.col("first"))).alias("name"))


def merge_entries(entries: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """One row per company before boards are settled; ``discovered(company_name, ats, career_page_url, slug, seq)``."""
    # The board of a URL is looked for once for each entry; the rank, and later the company's board, are taken from it.
    url = strip(F.col("career_page_url")).alias("url")
    rows = entries.select("seq", "company_name", "website", "domain_hint", "source_platform", "ats_type", url, company_key(F.col("company_name"), F.col("website"), F.col("career_page_url")).alias("key"))
    rows = rows.withColumn("board", F.when(F.col("url") != "", board_from_url(F.col("url"))))
    rows = rows.withColumn("ranked", F.when(F.col("url") != "", F.struct(url_rank(F.col("url"), F.col("board")).alias("rank"), "url", "board")))
    label = F.lower(F.coalesce(known(F.col("ats_type")), F.lit("unknown"))).alias("label")
    first = lambda c: F.min(F.when(text(F.col(c)) != "", F.struct("seq", c))).alias(c)
    # By spelling, then by company: the name is the most frequent spelling, then the shortest, then the first.
    spelled = rows.withColumn("label", label).groupBy("key", "company_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), F.collect_set("ranked").alias("ranked"), first("website"), first("domain_hint"), F.collect_set(known(F.col("source_platform"))).alias("sources"), F.collect_set("label").alias("labels")
    )
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = spelled.groupBy("key").agg(
        F.min("seq").alias("seq"), F.min_by("company_name", F.struct(-F.col("n"), F.length("company_name"), F.col("seq"))).alias("name"), together("ranked").alias("ranked"),
        *(strip(F.min(c)[c]).alias(c) for c in ("website", "domain_hint")), together("sources").alias("source_platforms"), together("labels").alias("labels"),
    )
    merged = merged.withColumn("urls", F.transform("ranked", lambda x: x["url"]))
    best = F.try_element_at("ranked", F.lit(1))
    merged = merged.withColumn("primary", F.coalesce(best["url"], "website")).withColumn("from_url", F.when(best.isNotNull(), best["board"]).otherwise(board_from_url(F.col("website"))))
    # Labels are distinct, so the most common one is the first by name.
    guess = F.array_min(F.filter("labels", lambda x: ~x.isin("unknown", "custom")))
    other = F.when(F.array_contains("labels", "custom"), F.lit("custom")).otherwise(F.lit("unknown"))
    signals = F.array_union("labels", F.when(F.col("from_url").isNotNull(), F.array("from_url")).otherwise(F.array().cast("array<string>")))
    merged = merged.withColumn("ats_type", F.coalesce("from_url", guess, other)).withColumn("ats_source", F.when(F.col("from_url").isNotNull(), "url").otherwise("guess"))
    merged = merged.withColumn("ats_conflict", F.size(F.array_distinct(F.filter(signals, lambda x: ~x.isin(*NO_STANDARD)))) > 1)
    merged = merged.withColumn("board_token", board_token(F.col("ats_type"), F.col("ats_source"), F.col("primary")))
    flags = sorted({"".join(ch for ch in x.lower() if ch.isascii() and ch.isalnum()) for x in FLAGGED})
    merged = merged.withColumn("vkey", name_key(F.col("name"))).withColumn("is_mnc_flagged", F.col("vkey").isin(*flags))
    return _overridden(merged, discovered).select(
        "seq", F.col("name").alias("company_name"), "website", F.col("primary").alias("career_page_url"), F.slice("urls", 2, F.greatest(F.size("urls") - 1, F.lit(0))).alias("alternate_career_urls"),
        "ats_type", "ats_source", "ats_conflict", F.col("labels").alias("agent_ats_labels"), "board_token", "domain_hint", "source_platforms", "is_mnc_flagged",
    )


def _overridden(merged: DataFrame, discovered: DataFrame | None) -> DataFrame:
    """Boards known for certain, else those that probing found, replace what was inferred."""
    spark = merged.sparkSession
    sure = spark.createDataFrame(list(VERIFIED), "vkey string, o_ats string, o_url string").withColumns({"o_source": F.lit("verified"), "o_token": first_segment(F.col("o_url"))})
    if discovered is not None:
        found = discovered.groupBy(name_key(F.col("company_name")).alias("vkey")).agg(F.max_by(F.struct("ats", "career_page_url", "slug"), "seq").alias("x"))
        found = found.select("vkey", F.col("x.ats").alias("o_ats"), F.col("x.career_page_url").alias("o_url"), F.lit("discovered").alias("o_source"), F.col("x.slug").alias("o_token"))
        sure = sure.unionByName(found.join(sure.select("vkey"), "vkey", "left_anti"))
    out = merged.join(sure, "vkey", "left")
    hit = F.col("o_url").isNotNull()
    return (
        # A URL that is there already keeps its place, so the best-ranked one is what the alternates go without.
        out.withColumn("urls", F.when(hit & ~F.array_contains("urls", F.col("o_url")), F.concat(F.array("o_url"), "urls")).otherwise(F.col("urls")))
        .withColumn("primary", F.coalesce("o_url", "primary"))
        .withColumn("ats_type", F.coalesce("o_ats", "ats_type"))
        .withColumn("ats_source", F.coalesce("o_source", "ats_source"))
        .withColumn("ats_conflict", F.when(hit, F.lit(False)).otherwise(F.col("ats_conflict")))
        .withColumn("board_token", F.when(hit, F.col("o_token")).otherwise(F.col("board_token")))
    )


def board_key(url: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(F.lower(text(url)), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), "/+$", "")


def owns(name: Column, website: Column, slug: Column) -> Column:
    """Whether a company's name or domain says that a board is its own."""
    t, domain = name_key(slug), text(legacy_bare_domain(website))
    first = name_key(F.split(domain, "[.]")[0])
    by_domain = (text(website) != "") & (domain != "") & ((t == first) | F.contains(domain, t) | ((F.length(first) >= 4) & F.startswith(t, first)))
    return (t != "") & ((name_key(name) == t) | by_domain)


def settle_boards(companies: DataFrame) -> DataFrame:
    """Boards claimed by several companies: one owner keeps it, its name variants go, the others lose it.

    A board (URL without scheme, ends aside) counts for sources whose URL holds a slug. Without an owner all lose it.
    The owner kept has a website, then the shortest name, then comes first; if the owners' domains are at most one,
    the other owners are variants and dropped, else they lose the board. One pass.
    """
    claims = F.col("ats_type").isin(*SUBDOMAIN_BOARDS, *PATH_BOARDS) & (text(F.col("career_page_url")) != "") & F.col("ats_source").isin("url", "verified", "discovered")
    keyed = companies.withColumn("_key", F.when(claims, known(board_key(F.col("career_page_url")))))
    free, bound = keyed.where("_key is null").drop("_key"), keyed.where("_key is not null")
    # One aggregation per board and a join back, rather than windows: a board that many claim is never one task's.
    first = F.min_by(board_slug(F.col("ats_type"), F.col("career_page_url")), "seq").alias("_slug")
    bound = bound.join(bound.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), first), "_key")
    bound = bound.withColumn("_owner", owns(F.col("company_name"), F.col("website"), F.col("_slug")))
    better = F.struct(F.when(text(F.col("website")) != "", 0).otherwise(1), F.length("company_name"), F.col("seq"))
    owners = bound.where("_owner").groupBy("_key").agg(F.min_by("seq", better).alias("_keep"), F.count_distinct(known(legacy_bare_domain(F.col("website")))).alias("_domains"))
    bound = bound.join(owners, "_key", "left")
    alone, kept = F.col("_n") < 2, F.coalesce(F.col("_keep") == F.col("seq"), F.lit(False))
    bound = bound.where(alone | ~F.col("_owner") | kept | (F.col("_domains") > 1))
    lost = ~alone & ~kept
    empty = {"career_page_url": text(F.col("website")), "alternate_career_urls": F.array().cast("array<string>"), "ats_type": F.lit("unknown"), "ats_source": F.lit("guess"), "ats_conflict": F.lit(False), "board_token": F.lit(None).cast("string")}
    bound = bound.withColumn("_lost", lost).select(*(F.when(F.col("_lost"), empty[c]).otherwise(F.col(c)).alias(c) if c in empty else F.col(c) for c in companies.columns))
    return free.unionByName(bound)


def consolidate(entries: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """Raw entries to the company list, in its order: source, then name, then place."""
    return ordered(settle_boards(merge_entries(entries, discovered)))


def source_order(board: Column) -> Column:
    out = F.lit(99)
    for i, name in reversed(list(enumerate(ORDER))):
        out = F.when(board == name, i).otherwise(out)
    return out


def ordered(companies: DataFrame) -> DataFrame:
    return companies.orderBy(source_order(F.col("ats_type")), F.lower("company_name"), "seq")


def summary(companies: DataFrame) -> DataFrame:
    """Totals: companies, those that can be read by machine, and the names in conflict."""
    return companies.agg(
        F.count(F.lit(1)).alias("total_companies"), F.count_if(F.col("ats_type").isin(*AUTOMATABLE)).alias("automatable_count"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("ats_conflict"), F.struct("seq", "company_name")))), lambda x: x["company_name"]).alias("ats_conflicts"),
    )


def roll_up(rows: DataFrame, key: str, sets: list[str], seq: str = "seq", tier: str | None = None) -> DataFrame:
    """Per key the first name, the sorted distinct values of some columns, and ``core`` if any row is."""
    aggs = [F.min_by("company_name", seq).alias("company_name"), *(F.array_sort(F.collect_set(known(F.col(c)))).alias(c) for c in sets)]
    if tier:
        aggs.append(F.when(F.max((F.col(tier) == "core").cast("int")) == 1, "core").otherwise("adjacent").alias(tier))
    return rows.groupBy(key).agg(*aggs)


def probe_hits(names: DataFrame, live: DataFrame, boards: tuple[str, ...], cap: int | None = None) -> DataFrame:
    """For each name the first live board over boards in order and its slug candidates in order.

    ``names(name)`` and ``live(ats, slug)``; the candidates of a name are few, so they meet live boards by equi join.
    """
    cands = slug_candidates(F.col("name"))
    cands = F.slice(cands, 1, cap) if cap else cands
    tried = names.select("name", F.posexplode(cands).alias("cand_pos", "slug")).select("name", "cand_pos", "slug", F.posexplode(F.array(*map(F.lit, boards))).alias("ats_pos", "ats"))
    hits = tried.join(live.select("ats", "slug").distinct(), ["ats", "slug"])
    return hits.groupBy("name").agg(F.min_by(F.struct("ats", "slug"), F.struct("ats_pos", "cand_pos")).alias("x")).select("name", "x.ats", "x.slug")

