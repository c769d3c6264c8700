"""The queries: thin applications of the operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import dates, html, names, urls
from heddle.operators import detect as detection
from heddle.operators import liveness as alive
from heddle.operators import match as matching
from heddle.operators import merge, registry, resolve, serve, state
from heddle.plans.views import AS_OF, PROFILE, entries, jobs, observations, places, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def joined(c: Column | str, sep: str = ",") -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)


JOB_COLUMNS = ("id", "company", "ats", "title", "first_seen", "matched")


# Matching


@query
def match_role_exclude(spark, sf_dir):
    """P1, title rules: role keywords and exclusions."""
    found = matching.match(jobs(spark, sf_dir).withColumn("work_type", F.lit("any")), PROFILE)
    return found.select("id", F.col("matched").cast("int").alias("matched"), joined("reasons", "; ").alias("reasons"))


@query
def match_location(spark, sf_dir):
    """P1, place rules, over customers with nation and region."""
    found = matching.match(places(spark, sf_dir).withColumn("title", F.lit("testing")), PROFILE)
    return found.select("c_custkey", "location", "work_type", F.col("matched").cast("int").alias("matched"))


@query
def match_reasons(spark, sf_dir):
    """P1 as a whole: every reason in order."""
    return matching.match(places(spark, sf_dir), PROFILE).select("c_custkey", joined("reasons", "; ").alias("reasons"))


@query
def relevance_gate(spark, sf_dir):
    """P10: documents whose title names each of two roles."""
    roles = F.explode(F.array(F.lit("th ing"), F.lit("que de"))).alias("role")
    titles = jobs(spark, sf_dir).select("id", "title", roles)
    return titles.where(matching.relevant(F.col("title"), F.col("role"), lead=True)).select("id", "role")


@query
def posted_recently(spark, sf_dir):
    """Orders placed in the last 90 days before a date."""
    as_of = F.lit("1998-12-31").cast("timestamp")
    return table(spark, sf_dir, "orders").where(matching.posted_within(F.col("o_orderdate"), 90, as_of)).select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


# Serving


def _listing(sort: str):
    def run(spark, sf_dir):
        return serve.list_jobs(jobs(spark, sf_dir), serve.JobsFilter(sort=sort, limit=50), AS_OF).select(*JOB_COLUMNS)

    return run


for _sort in ("recent", "company", "matched"):
    QUERIES[f"list_jobs_{_sort}"] = _listing(_sort)


@query
def list_jobs_search(spark, sf_dir):
    """P2 with every filter: open, matched, found within five days, a literal search."""
    want = serve.JobsFilter(search="ERE", matched=True, applied=False, recent_seconds=5 * 86400, limit=1000)
    return serve.filtered(jobs(spark, sf_dir), want, AS_OF).select("id", "title")


@query
def list_jobs_page(spark, sf_dir):
    """O2: a page by offset with the whole count."""
    want = serve.JobsFilter(closed="any", limit=20, offset=40)
    page = serve.list_jobs(jobs(spark, sf_dir), want, AS_OF).select("id", "ats")
    return page.join(F.broadcast(serve.count_jobs(jobs(spark, sf_dir), want, AS_OF)), F.lit(True), "left")


@query
def stats_tiles(spark, sf_dir):
    """A2."""
    return serve.tiles(jobs(spark, sf_dir), AS_OF)


@query
def open_by_source(spark, sf_dir):
    """A3."""
    return serve.open_by_source(jobs(spark, sf_dir))


@query
def open_by_source_map(spark, sf_dir):
    """A3 as a map, here as text."""
    counts = serve.as_map(serve.open_by_source(jobs(spark, sf_dir)), "ats", "n")
    return counts.select(joined(F.transform(F.map_entries("counts"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))).alias("counts"))


@query
def distinct_sources(spark, sf_dir):
    """A17."""
    return serve.sources(jobs(spark, sf_dir))


@query
def ledger_mode_status(spark, sf_dir):
    """A4 over orders: priority and status."""
    return serve.ledger_counts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("status")))


def _runs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("success")
    return e.select(F.col("event_id").alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("started_at"), status.alias("status"), F.col("user_id").alias("jobs_new"), F.when(F.col("user_id") % 3 == 0, F.col("user_id")).alias("jobs_matched"), F.lit(1).cast("long").alias("companies_done"))


@query
def runs_by_day(spark, sf_dir):
    """A7, F25."""
    return serve.runs_by_day(_runs(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query
def latest_runs(spark, sf_dir):
    """O3."""
    return serve.latest(_runs(spark, sf_dir), "started_at", 25).select("id", "started_at", "status")


@query
def snapshot_top(spark, sf_dir):
    """O6."""
    return serve.snapshot(jobs(spark, sf_dir), 100).select("id", "last_seen")


@query
def listing_by_company(spark, sf_dir):
    """The first 200 rows in board order, then newest first with their company's place."""
    rows = jobs(spark, sf_dir).select(F.col("ats").alias("company"), F.substring("ats", 4, 9).cast("long").alias("company_seq"), F.col("id").alias("job_seq"), F.when(F.col("id") % 5 != 0, F.col("first_seen")).alias("posted_ts"))
    return serve.grouped_listing(rows, 200).select("job_seq", "company", "group_seq", "posted_ts")


@query
def job_status(spark, sf_dir):
    """F42 counted."""
    return jobs(spark, sf_dir).groupBy(serve.status(F.col("closed"), F.col("applied"), F.col("matched")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# Ordered picks and merges


@query
def rotate_slice(spark, sf_dir):
    """120 customers from place 1450 on, wrapping around."""
    return merge.rotating_slice(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment", "c_custkey"], 1450, 120).select("c_custkey", "turn")


@query
def first_wins(spark, sf_dir):
    """A conversation's first message by each role."""
    return merge.first_per_key(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], ["turn", "text"]).select("conv_id", "role", "turn", F.length("text").cast("long").alias("n_chars"))


@query
def last_wins(spark, sf_dir):
    """W3."""
    return merge.last_per_key(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], ["turn", "text"]).select("conv_id", "role", "turn", F.length("text").cast("long").alias("n_chars"))


@query
def insert_or_ignore(spark, sf_dir):
    """Part names, then those supplier names that are not there yet, then the first customer of each segment."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("seq")).select(F.col("p_name").alias("name"), "seq")
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("seq"))
    t = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), (F.col("p_partkey") + 1000000).alias("seq"))
    return merge.append_absent(p, c.unionByName(t), ["name"], ["seq"])


@query
def overlay_precedence(spark, sf_dir):
    """U4: parts by brand, replaced by those of size over 25, replaced by those of size 50."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    return merge.overlay([p, p.where("p_size > 25"), p.where("p_size = 50")], ["p_brand"], ["p_partkey"])


@query
def coalesce_merge(spark, sf_dir):
    """A10: per user the first value of each kind of event."""
    e = table(spark, sf_dir, "events")
    wide = e.select("user_id", "event_id", *(F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in ("click", "error", "view")))
    return merge.fill_missing(wide, ["user_id"], ["event_id"])


@query
def rollup_sets(spark, sf_dir):
    """Per user the distinct event types, and core if any is a purchase."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("company_name"), F.col("event_type").alias("kinds"), F.when(F.col("event_type") == "purchase", "core").otherwise("adjacent").alias("tier"))
    return resolve.roll_up(e, "user_id", ["kinds"], tier="tier").select("user_id", F.col("company_name").alias("first_kind"), joined("kinds").alias("kinds"), "tier")


@query
def canonical_name(spark, sf_dir):
    """Each brand's most frequent, then shortest, then first part name."""
    return resolve.canonical_names(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey")


@query
def scan_cap(spark, sf_dir):
    """Per day the number of events and the first five."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id")
    return merge.capped_list(e, ["day"], "event_id", ["event_id"], 5).select(F.col("day").cast("string").alias("day"), "total", joined(F.transform("first_values", lambda x: x.cast("string"))).alias("first_values"))


@query
def known_name_antijoin(spark, sf_dir):
    """Customers whose number is no supplier's; J5 through its operator is known_names."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    key = lambda c: names.ascii_key(F.substring_index(c, "#", -1))
    return c.select("c_custkey", key(F.col("c_name")).alias("k")).join(s.select(key(F.col("s_name")).alias("k")), "k", "left_anti").select("c_custkey")


@query
def two_paths_expand(spark, sf_dir):
    """Two careers pages for each supplier; S31 through its operator is curated_paths."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(F.lit("/careers"), F.lit("/jobs"))).alias("path"))
    return s.select("s_suppkey", F.concat(F.lit("https://supplier-"), F.col("s_suppkey").cast("string"), F.lit(".com"), "path").alias("url"))


@query
def daily_new(spark, sf_dir):
    """Keys first seen on each day; U7 through its operator is daily_counters."""
    first = observations(spark, sf_dir).groupBy("board", "job").agg(F.min("tick").alias("day"))
    return first.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("jobs_new"))


# State


@query
def applied_flag(spark, sf_dir):
    """Documents with a flag for those that labels call toxic."""
    keyed = lambda df: df.select(F.lit("c").alias("company"), F.lit("a").alias("ats"), F.col("doc_id").alias("job_id"))
    return state.applied_flag(keyed(table(spark, sf_dir, "documents")), keyed(table(spark, sf_dir, "labels").where("toxic = 1"))).select(F.col("job_id").alias("doc_id"), "applied")


@query
def upsert_state(spark, sf_dir):
    """What U1 keeps, as one aggregation; through its operator see tick_state."""
    o = observations(spark, sf_dir)
    return o.groupBy("board", "job").agg(F.min("tick").cast("string").alias("first_tick"), F.max("tick").cast("string").alias("last_tick"), F.max_by("value", "event_id").alias("value"))


@query
def reap_state(spark, sf_dir):
    """U1 and T2 over all days: misses, closed rows and the day they closed; jobs under 5 count as applied."""
    o = observations(spark, sf_dir)
    found = state.final_state(o, o.where("job < 5").select("board", "job").distinct())
    return found.withColumns({**{c: F.col(c).cast("string") for c in ("first_tick", "last_tick", "closed_tick")}, "miss_count": F.col("miss_count").cast("long")})


@query
def registry_upsert(spark, sf_dir):
    """Events as observations of users, over a registry of the first hundred."""
    e = table(spark, sf_dir, "events")
    seen = e.select(
        F.col("user_id").cast("string").alias("norm_key"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("https://s"), F.col("event_id").cast("string"))).otherwise("").alias("website"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("https://u"), F.col("event_id").cast("string"))).otherwise("").alias("career_page_url"), F.when(F.col("event_type") == "view", "unknown").otherwise(F.col("event_type")).alias("ats_type"),
        F.lit("batch").alias("source"), F.when(F.col("event_id") % 5 == 0, "dead").otherwise("live").alias("http_status"), (F.col("event_id") % 50 == 0).cast("int").alias("reliable"), F.col("event_id").cast("double").alias("first_seen"), F.col("event_id").alias("seq"),
    )
    old = e.where("user_id < 100").select(F.col("user_id").cast("string").alias("norm_key")).distinct().select(
        "norm_key", F.lit("old").alias("name"), F.lit("https://old").alias("website"), F.lit("").alias("career_page_url"), F.lit("lever").alias("ats_type"), F.lit("seed").alias("source"), F.lit("none").alias("http_status"), (F.col("norm_key").cast("int") % 9 == 0).cast("int").alias("reliable"), F.lit(-1.0).alias("first_seen")
    )
    found = registry.registry_upsert(old, seen, recheck=False)
    return found.withColumns({c: F.col(c).cast("int") for c in ("is_new", "became_reliable")})


@query
def dup_board_keeper(spark, sf_dir):
    """Companies as a registry; one row for each board's slug."""
    rows = entries(spark, sf_dir).select(F.col("seq").cast("string").alias("norm_key"), F.col("company_name").alias("name"), "career_page_url", urls.board_from_url(F.col("career_page_url")).alias("ats_type"), F.col("seq").cast("double").alias("first_seen"))
    return registry.one_per_board(rows).select("norm_key", "ats_type")


@query
def junk_slug(spark, sf_dir):
    """P14 over part keys and names."""
    slug = F.explode(F.array(F.repeat(F.substring("p_name", 1, 1), 6), F.lpad(F.col("p_partkey").cast("string"), 6, "1"), F.regexp_replace(F.concat("p_name", F.col("p_partkey").cast("string")), "[aeiou ]", ""), F.regexp_replace("p_name", " ", ""))).alias("slug")
    return table(spark, sf_dir, "part").select("p_partkey", slug).where(names.is_junk_slug(F.col("slug")))


# Companies


@query
def consolidate(spark, sf_dir):
    """Three lists of entries as one list of companies."""
    found = resolve.settle_boards(resolve.merge_entries(entries(spark, sf_dir)))
    return found.select("company_name", "website", "career_page_url", joined("alternate_career_urls", " ").alias("alternates"), "ats_type", "ats_source", F.col("ats_conflict").cast("int").alias("ats_conflict"), joined("agent_ats_labels").alias("labels"), "board_token", "domain_hint", joined("source_platforms").alias("sources"))


@query
def company_summary(spark, sf_dir):
    """Companies by source and how many have a token."""
    return serve.company_stats(resolve.merge_entries(entries(spark, sf_dir)))


@query
def csv_export_rows(spark, sf_dir):
    """Companies as the lines of a CSV file."""
    from heddle.sources.files import csv_rows

    found = resolve.merge_entries(entries(spark, sf_dir))
    return csv_rows(found).select("company_name", F.concat_ws(",", "ats_type", "ats_source", "ats_conflict", "board_token", "source_platforms", "is_mnc_flagged").alias("line"))


@query
def candidate_probe(spark, sf_dir):
    """Part names probed at three boards; a board is live where a brand's number is even."""
    p = table(spark, sf_dir, "part")
    live = p.select(F.regexp_replace("p_name", " ", "").alias("slug"), F.element_at(F.array(*map(F.lit, ("lever", "ashby", "greenhouse"))), (F.col("p_size") % 3 + 1).cast("int")).alias("ats")).where("length(slug) % 2 = 0")
    return resolve.probe_hits(p.select(F.col("p_name").alias("name")).distinct(), live, ("greenhouse", "lever", "ashby"))


# Scalar functions


@query
def norm_keys(spark, sf_dir):
    """F1, F2, F3 over page titles, with something in parentheses."""
    t = F.concat(html.page_title(F.col("html")), F.lit(" (Brand GmbH) Co."))
    return table(spark, sf_dir, "pages").select("page_id", names.name_key(t).alias("n1"), names.ascii_key(t).alias("n2"), names.unicode_key(t).alias("n3"))


@query
def slug_candidates(spark, sf_dir):
    """F14."""
    n = F.concat("p_name", F.lit(" "), F.element_at(F.array(*map(F.lit, ("Labs", "(formerly Acme Tools)", "Inc", "42", "Health"))), (F.col("p_partkey") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", joined(names.slug_candidates(n)).alias("candidates"))


@query
def bare_domain(spark, sf_dir):
    """F4, F38."""
    return table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.bare_domain(F.col("url")).alias("domain"), urls.domain_without_www(F.col("url")).alias("plain"))


@query
def bare_domain_legacy(spark, sf_dir):
    """F5, with its quirk."""
    return table(spark, sf_dir, "pages").select("page_id", urls.legacy_host(F.col("url")).alias("host"), urls.legacy_bare_domain(F.col("url")).alias("domain"))


def _board_urls(spark, sf_dir) -> DataFrame:
    host = F.element_at(F.array(*map(F.lit, ("boards.greenhouse.io", "jobs.lever.co", "acme.breezy.hr", "x.jobs.personio.com", "Apply.Workable.com", "acme.wd5.myworkdayjobs.com", "wise.jobs", "example.com", "www.ycombinator.com/companies"))), (F.col("p_partkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("https://"), host, F.lit("/"), F.regexp_replace("p_name", " ", "-"), F.when(F.col("p_size") > 25, F.lit("/careers?x=1")).otherwise("")).alias("url"))


@query
def ats_from_url(spark, sf_dir):
    """F7, F9, F10, F29."""
    u, board = F.col("url"), urls.board_from_url(F.col("url"))
    return _board_urls(spark, sf_dir).select("p_partkey", board.alias("ats"), urls.url_rank(u).cast("int").alias("url_rank"), urls.board_token(board, F.lit("url"), u).alias("token"), urls.registry_slug(board, u).alias("slug"))


@query
def detect_host(spark, sf_dir):
    """F6."""
    return _board_urls(spark, sf_dir).select("p_partkey", urls.board_from_host(F.col("url")).alias("ats"))


@query
def posted_parse(spark, sf_dir):
    """F19, F20 over orders whose dates are written in several ways."""
    o = table(spark, sf_dir, "orders")
    forms = F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" soon")), F.date_format("o_orderdate", "yyyy"), F.lit(""), F.date_format("o_orderdate", "dd.MM.yyyy"))
    o = o.select("o_orderkey", F.element_at(forms, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("posted"))
    return o.select("o_orderkey", dates.iso_from_dotted(F.col("posted")).alias("iso"), F.date_format(dates.posted_ts(F.col("posted")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query
def page_title(spark, sf_dir):
    """F37."""
    return table(spark, sf_dir, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


@query
def page_links(spark, sf_dir):
    """F37, one row per link."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.links(F.col("html"))).alias("at", "href")).withColumn("at", F.col("at").cast("long"))


@query
def display_names(spark, sf_dir):
    """F34, F35."""
    slug = F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("_IO-"), (F.col("p_partkey") % 3).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", names.pretty_name(slug).alias("pretty"), names.humanised_slug(slug).alias("humanised"))


# Liveness and detection


def _fetched(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("page_id") % 10 == 0, 404).when(F.col("page_id") % 10 == 1, 500).when(F.col("page_id") % 10 != 2, 200)
    page = F.when(F.col("page_id") % 10 == 3, F.concat(F.col("html"), F.lit("Page Not Found"))).when(F.col("page_id") % 10 == 4, F.replace("html", F.lit("<title>"), F.lit("<title>404 "))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 10 == 5, F.lit("mailto:x")).otherwise(F.col("url")).alias("url"), status.alias("status"), page.alias("html"))


@query
def liveness(spark, sf_dir):
    """P8."""
    return _fetched(spark, sf_dir).select("page_id", alive.verdict(F.col("url"), F.col("status"), F.col("html")).alias("verdict"))


@query
def liveness_counts(spark, sf_dir):
    """Verdicts by top-level domain."""
    found = _fetched(spark, sf_dir).withColumn("verdict", alive.verdict(F.col("url"), F.col("status"), F.col("html")))
    return alive.verdict_counts(found.withColumn("tld", F.coalesce(F.substring_index(urls.host(F.col("url")), ".", -1), F.lit(""))), "tld")


@query
def verdict_pivot(spark, sf_dir):
    """Probes of event types as verdicts."""
    e = table(spark, sf_dir, "events")
    error = F.when(F.col("event_type") == "error", F.when(F.col("user_id") % 2 == 0, "404 board not found").otherwise("request failed"))
    return alive.verdict_counts(e.select(F.col("event_type").alias("ats"), alive.probe_verdict(F.col("user_id"), error).alias("verdict")), "ats")


@query
def detect_company(spark, sf_dir):
    """Pages against every page's host as a company."""
    p = table(spark, sf_dir, "pages")
    label = F.substring_index(urls.host(F.col("url")), ".", 1)
    c = p.select(
        F.col("page_id").alias("seq"), label.alias("company_name"), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("").alias("career_page_url"), F.array().cast("array<string>").alias("alternate_career_urls"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://"), urls.bare_domain(F.col("url")))).otherwise("").alias("website"), F.when(F.col("page_id") % 7 == 0, label).otherwise("").alias("domain_hint"), F.lit("lever").alias("ats_type"), label.alias("board_token"),
    )
    return detection.detect(p, c).select("page_id", "company", "match_type", F.col("score").cast("int").alias("score"))
