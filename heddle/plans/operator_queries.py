"""Queries of the operators that the others leave out, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import dates, names, urls
from heddle.operators import deltas, liveness, match, merge, registry, resolve, runs, search, serve, state
from heddle.plans.sql import ORACLES as SQL
from heddle.plans.sql import FETCHED, JOBS, MERGED, OBSERVED, VERDICT, among, board, has, host, key, q, segment
from heddle.plans.views import AS_OF, PROFILE, entries, jobs, observations, table
from heddle.sources import collectors, parsers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query and its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def at(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def at_sql(values: tuple[str, ...], number: str) -> str:
    return f"([{', '.join(map(q, values))}])[{number} % {len(values)} + 1]"


# Boards

KINDS = tuple(parsers.PARSERS)
_SLUG = "replace(p_name, ' ', '-')"
_BASE = f"select p_partkey, p_name, p_brand, p_size, p_type, {at_sql(KINDS, 'p_partkey')} as ats, lower(replace(p_brand, '#', '')) as token, cast(p_partkey as varchar) as k, p_name || ' ' || p_partkey as t, {_SLUG} as s from part"
_POSTED: dict[str, dict[str, str]] = {
    "greenhouse": {"job_id": "k", "location": "p_brand", "url": "'https://x/' || s", "department": "'A / ' || p_type", "work_type": "case when p_size % 2 = 0 then 'remote' when p_size % 3 = 0 then 'hybrid' else '' end", "posted_at": "'2024-01-0' || (p_size % 9 + 1)"},
    "lever": {"job_id": "k", "location": "p_brand", "url": "case when p_size % 2 = 0 then 'https://a/' || s else 'https://h/' || s end", "department": "p_type", "work_type": "'remote'", "posted_at": "'2023-11-14T22:13:20.' || lpad(cast(p_size as varchar), 3, '0') || '000+00:00'"},
    "ashby": {"job_id": "k", "location": "case when p_size % 2 = 0 then p_brand else 'ext' end", "url": "'https://jobs.ashbyhq.com/' || token || '/' || k", "department": "p_type", "work_type": "'hybrid'", "posted_at": "'2024-02-01'"},
    "workable": {"job_id": "case when p_size % 2 = 0 then s else k end", "location": "p_brand || ', X'", "url": "'https://apply.workable.com/' || token || '/j/' || case when p_size % 2 = 0 then s else '' end", "department": "'A / ' || p_type", "work_type": "case when p_size % 3 = 0 then 'remote' else '' end", "posted_at": "'2024-03-01'"},
    "smartrecruiters": {"job_id": "k", "location": "case when p_size % 2 = 0 then p_brand else 'C, R' end", "url": "'https://jobs.smartrecruiters.com/' || token || '/' || k", "department": "p_type", "work_type": "case when p_size % 2 = 0 then 'remote' when p_size % 3 = 0 then 'hybrid' else 'onsite' end", "posted_at": "'2024-04-01'"},
    "personio": {"job_id": "k", "location": "p_brand", "url": "'https://' || token || '.jobs.personio.com/job/' || k || '?language=en'", "department": "p_type", "posted_at": "'2024-05-01'"},
    "rippling": {"job_id": "k", "location": "p_brand", "url": "'https://ats.rippling.com/' || token || '/jobs/' || k || '/apply?step=application'", "department": "p_type"},
    "teamtailor": {"job_id": "k || '-' || s", "location": "p_brand", "url": "'https://' || token || '.teamtailor.com/jobs/' || k || '-' || s || '?x=1'", "department": "p_type"},
    "breezyhr": {"job_id": "printf('%x', p_partkey + 4096)", "location": "case when p_size % 2 = 0 then 'Multiple locations' else p_brand end", "url": "'https://' || token || '.breezy.hr/p/' || printf('%x', p_partkey + 4096) || '-' || s", "work_type": "'full time'"},
    "onlyfy": {"job_id": "'J' || k", "location": "p_brand", "url": "'https://' || token || '.onlyfy.jobs/en/job/J' || k", "department": "p_type", "work_type": "'Remote'", "posted_at": "'2026-07-2' || (p_size % 10)"},
    "mailto": {"job_id": "s || '-' || k", "location": "'Remote, India'", "url": "'mailto:a@b.c?subject=Application%20-%20' || replace(t, ' ', '%20')", "work_type": "'remote'"},
    "workday": {"job_id": "case when p_size % 2 = 0 then 'R' || k else '/job/' || k end", "location": "case when p_size % 3 = 0 then 'Remote ' || p_brand else p_brand end", "url": "'https://' || token || '.wd5.myworkdayjobs.com/job/' || k", "work_type": "case when p_size % 3 = 0 then 'remote' else '' end"},
}


def _field(name: str) -> str:
    return f"case ats {' '.join(f'when {q(b)} then {cols[name]}' for b, cols in _POSTED.items() if name in cols)} else '' end as {name}"


def _payload(p: DataFrame) -> Column:
    """A listing of one posting in each board's own form."""
    k, t, s, brand, kind, even, third = F.col("k"), F.col("t"), F.col("s"), F.col("p_brand"), F.col("p_type"), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0
    obj = lambda **x: F.struct(*(v.alias(n) for n, v in x.items()))
    js = lambda **x: F.to_json(obj(**x))
    lit = F.lit
    cat = F.concat
    kinds = F.array(obj(name=lit("x"), value=lit("y")), obj(name=lit("kind"), value=F.when(even, "Remote").when(third, "hybrid").otherwise("no")))
    forms = {
        "greenhouse": js(jobs=F.array(obj(id=F.col("p_partkey"), title=t, absolute_url=cat(lit("https://x/"), s), location=obj(name=brand), departments=F.array(obj(name=lit("A")), obj(name=kind)), metadata=kinds, first_published=cat(lit("2024-01-0"), (F.col("p_size") % 9 + 1).cast("string"))))),
        "lever": F.to_json(F.array(obj(id=k, text=t, categories=obj(location=brand, team=kind), applyUrl=F.when(even, cat(lit("https://a/"), s)).otherwise(""), hostedUrl=cat(lit("https://h/"), s), workplaceType=lit("Remote"), createdAt=lit(1700000000000) + F.col("p_size")))),
        "ashby": cat(lit('<html><script>window.__appData = {"a":"}","b":{"jobPostings":'), F.to_json(F.array(obj(id=k, title=t, isListed=lit(True), locationName=F.when(even, brand).otherwise(""), locationExternalName=lit("ext"), departmentName=kind, workplaceType=lit("Hybrid"), publishedDate=lit("2024-02-01")), obj(id=lit("no"), title=t, isListed=lit(False), locationName=brand, locationExternalName=lit(""), departmentName=kind, workplaceType=lit(""), publishedDate=lit("")))), lit("}};</script>")),
        "workable": js(results=F.array(obj(id=k, shortcode=F.when(even, s), title=t, location=obj(city=brand, country=lit("X")), department=F.array(lit("A"), kind), remote=third, published=lit("2024-03-01")))),
        "smartrecruiters": js(content=F.array(obj(id=k, name=t, releasedDate=lit("2024-04-01"), location=obj(city=lit("C"), region=lit("R"), remote=even, hybrid=third, fullLocation=F.when(even, brand)), department=obj(label=kind)))),
        "personio": cat(lit("<workzag-jobs><position><id>"), k, lit("</id><name> "), t, lit(" </name><office>"), brand, lit("</office><department>"), kind, lit("</department><createdAt>2024-05-01</createdAt></position></workzag-jobs>")),
        "rippling": F.to_json(F.array(obj(uuid=F.when(even, k), id=k, name=t, workLocation=obj(label=brand), department=F.when(even, F.to_json(obj(label=kind))).otherwise(kind)))),
        "teamtailor": cat(lit("<rss><channel><item><title>"), t, lit("</title><link>https://"), F.col("token"), lit(".teamtailor.com/jobs/"), k, lit("-"), s, lit('?x=1</link><description>&lt;span class="location"&gt;'), brand, lit('&lt;/span&gt;&lt;span class="department"&gt;'), kind, lit("&lt;/span&gt;</description></item></channel></rss>")),
        "breezyhr": cat(lit('<a href="/p/'), F.lower(F.hex(F.col("p_partkey") + 4096)), lit("-"), s, lit('"><h2>'), t, lit('</h2><li class="location"><span>'), F.when(even, "%LABEL_MULTIPLE_LOCATIONS%").otherwise(brand), lit('</span></li><li class="type"><span>%LABEL_POSITION_TYPE_FULL_TIME%</span></li></a><a href="/p/x">Apply</a>')),
        "onlyfy": cat(lit('<a data-testid="job-card" href="/en/job/J'), k, lit('"><h3 data-testid="job-title">'), t, lit('</h3><div data-testid="job-more-info">'), brand, lit(" | Remote | 2"), (F.col("p_size") % 10).cast("string"), lit(".07.2026 | "), kind, lit("</div></a>")),
        "mailto": cat(lit('<a href="mailto:a@b.c?subject=Application%20-%20'), F.replace(t, lit(" "), lit("%20")), lit('">x</a>')),
        "workday": js(jobPostings=F.array(obj(title=t, externalPath=cat(lit("/job/"), k), bulletFields=F.when(even, F.array(cat(lit("R"), k))).otherwise(F.array().cast("array<string>")), locationsText=F.when(third, cat(lit("Remote "), brand)).otherwise(brand)))),
    }
    out = lit(None).cast("string")
    for name, form in forms.items():
        out = F.when(F.col("ats") == name, form).otherwise(out)
    return out


def _board_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumns({"ats": at(KINDS, F.col("p_partkey")), "token": F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), "k": F.col("p_partkey").cast("string"), "s": F.replace("p_name", F.lit(" "), F.lit("-"))})
    p = p.withColumn("t", F.concat_ws(" ", "p_name", "k"))
    address = F.when(F.col("ats") == "workday", F.concat(F.lit("https://"), "token", F.lit(".wd5.myworkdayjobs.com/site"))).otherwise(F.col("token"))
    return p.select(F.col("p_brand").alias("company"), "ats", address.alias("token"), _payload(p).alias("payload"))


@query(f"select p_brand as company, ats, t as title, {', '.join(_field(c) for c in ('job_id', 'location', 'url', 'department', 'work_type', 'posted_at'))} from ({_BASE})")
def parse_boards(spark, sf_dir):
    """Each part as one posting in the form of one of the twelve boards."""
    return parsers.parse(_board_rows(spark, sf_dir)).select("company", "ats", "title", "job_id", "location", "url", "department", "work_type", "posted_at")


# Collectors


def _first_of(select: str, source: str, order: str = "seq") -> str:
    """The first row of each name's ASCII key, none without a key."""
    return f"select {select} from (select * from ({source}) where {key('n')} <> '' qualify row_number() over (partition by {key('n')} order by {order}) = 1)"


_NAV = "select page_id, i, string_split(html, '<li>')[i + 1] as card from pages, range(1, 200) t(i) where i < len(string_split(html, '<li>'))"
_TAGLESS = "trim(regexp_replace({}, '<[^>]+>', '', 'g'))"


@query(_first_of("n as company_name, website", f"select page_id * 1048576 + i - 1 as seq, regexp_extract(card, '<a href=\"[^\"]*\">([^<]*)</a>', 1) as n, regexp_extract(card, '<a href=\"([^\"]*)\"', 1) as website from ({_NAV})"))
def directory_cards(spark, sf_dir):
    """The navigation's items of every page as cards."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.col("html").alias("payload"))
    return collectors.directory_cards(pages, "<li>", '<a href="[^"]*">([^<]*)</a>', '<a href="([^"]*)"', "cards").select("company_name", "website")


@query(_first_of("n as company_name, website, ats_type", "select c_nationkey * 1048576 + row_number() over (partition by c_nationkey order by c_custkey) as seq, c_mktsegment || ' ' || c_custkey % 700 as n, 'https://c' || c_custkey as website, 'unknown' as ats_type from customer"))
def directory_api(spark, sf_dir):
    """Customers as JSON pages of one nation each."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.struct("c_custkey", F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 700).cast("string")).alias("name"), F.concat(F.lit("https://c"), "c_custkey").alias("site")).alias("r"))
    pages = c.groupBy(F.col("c_nationkey").cast("long").alias("seq")).agg(F.to_json(F.struct(F.array_sort(F.collect_list("r")).alias("companies"))).alias("payload"))
    return collectors.directory_api(pages, "name:string,site:string", "api", website="site", items="companies").select("company_name", "website", "ats_type")


_HEAD = "trim(regexp_extract(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '^([^|–—]+)', 1))"


@query(_first_of("n as company_name, website", f"select page_id as seq, case when page_id % 3 = 0 then 'Page ' || page_id else {_HEAD} end as n, case when page_id % 2 = 0 then 'https://own' || page_id || '.com' else '' end as website from pages"))
def profile_pages(spark, sf_dir):
    """S18, F36's fallback: pages with links behind them; every third has no name but its slug."""
    p, n = table(spark, sf_dir, "pages"), F.col("page_id")
    bare = F.regexp_replace(F.regexp_replace("html", "(?is)<title.*?</title>", ""), "(?is)<h1.*?</h1>", "")
    behind = F.concat(F.lit('<a href="https://blocked.com/x">b</a>'), F.when(n % 2 == 0, F.concat(F.lit('<a href="https://own'), n.cast("string"), F.lit('.com">o</a>'))).otherwise(""))
    pages = p.select(n.alias("seq"), F.concat(F.lit("page_"), n.cast("string")).alias("slug"), F.concat(F.when(n % 3 == 0, bare).otherwise(F.col("html")), behind).alias("payload"))
    return collectors.profile_pages(pages, ("blocked.com",)).select("company_name", "website")


_CELL = "regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1)"


@query(_first_of("n as company_name", f"select * from (select page_id * 1048576 + i - 1 as seq, trim(regexp_replace({_TAGLESS.format('c')}, '\\s*[\\(\\[].*$', '')) as n from (select page_id, i, {_CELL}[i] as c from pages, range(1, 200) t(i) where i <= len({_CELL}))) where n <> '' and length(n) <= 60 and not regexp_matches(n, '^[0-9]')"))
def wiki_names(spark, sf_dir):
    """The bullets of every page as names."""
    return collectors.wiki_names(table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.col("html").alias("payload"))).select("company_name")


_LINK = f"'https://' || case p_partkey % 3 when 0 then {_SLUG} || '.workable.com/' when 1 then 'jobs.lever.co/' || {_SLUG} else {_SLUG} || '.com/about' end"
_ROUTED = f"case p_partkey % 3 when 0 then 'https://apply.workable.com/' || {_SLUG} when 1 then 'https://jobs.lever.co/' || {_SLUG} else '' end"


@query(_first_of("n as company_name, website, career_page_url, ats_type", f"select p_partkey as seq, p_name || ' ' || p_brand as n, case when p_partkey % 3 = 2 then 'https://' || {_SLUG} || '.com/about' else '' end as website, {_ROUTED} as career_page_url, ([ 'workable', 'lever', 'unknown'])[p_partkey % 3 + 1] as ats_type from part"))
def markdown_table(spark, sf_dir):
    """Parts as the rows of a README's table."""
    p, s = table(spark, sf_dir, "part"), F.replace("p_name", F.lit(" "), F.lit("-"))
    link = F.concat(F.lit("https://"), F.when(F.col("p_partkey") % 3 == 0, F.concat(s, F.lit(".workable.com/"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("jobs.lever.co/"), s)).otherwise(F.concat(s, F.lit(".com/about"))))
    lines = p.select(F.col("p_partkey").alias("seq"), F.concat(F.lit("| ["), "p_name", F.lit(" "), "p_brand", F.lit("]("), link, F.lit(") | x")).alias("value"))
    return collectors.markdown_table(lines).select("company_name", "website", "career_page_url", "ats_type")


@query(_first_of("n as company_name, website, career_page_url", f"select p_partkey as seq, p_name || ' ' || p_size as n, case when p_partkey % 2 = 0 then 'https://' || {_SLUG} || '.com' else '' end as website, case when p_partkey % 2 = 1 then 'https://' || {_SLUG} || '.com/careers' else '' end as career_page_url from part where p_size <> 7"))
def markdown_links(spark, sf_dir):
    """Parts as links of a list; those of size 7 are links within it."""
    s = F.replace("p_name", F.lit(" "), F.lit("-"))
    link = F.concat(F.lit("https://"), s, F.when(F.col("p_partkey") % 2 == 1, ".com/careers").otherwise(".com"))
    n = F.when(F.col("p_size") == 7, "Contents").otherwise(F.concat("p_name", F.lit(" "), "p_size"))
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("- **see** ["), n, F.lit("]("), link, F.lit(") more")).alias("value"))
    return collectors.markdown_links(lines, meta=("contents",)).select("company_name", "website", "career_page_url")


_FEED = f"select p_partkey as seq, case when p_size % 2 = 0 then p_brand else p_name end as n, case when p_size % 3 = 0 then 'https://jobs.lever.co/' || {_SLUG} end as u from part"


@query(f"select arg_min(n, seq) as company_name, coalesce(arg_min(u, seq) filter (u is not null), '') as career_page_url, coalesce(arg_min(case when u is null then 'unknown' else 'lever' end, seq), '') as ats_type from ({_FEED}) where {key('n')} <> '' group by {key('n')}")
def remote_feed(spark, sf_dir):
    """Parts as a feed's postings, half of which name their company in the title alone."""
    s, n = F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_size")
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.when(n % 2 == 0, F.col("p_brand")).alias("company"), F.when(n % 2 == 1, F.concat("p_name", F.lit(": role"))).otherwise("role").alias("title"), F.concat(F.when(n % 3 == 0, "https://jobs.lever.co/").otherwise("https://example.com/"), s).alias("url"))
    return collectors.remote_feed(items, "feed").select("company_name", "career_page_url", "ats_type")


@query(f"select arg_min(p_name, p_partkey) as company_name, coalesce(arg_min('https://jobs.lever.co/' || p_partkey, p_partkey) filter (p_size % 4 = 1), '') as career_page_url from part where p_size % 2 = 1 group by {key('p_name')}")
def listings_json(spark, sf_dir):
    """Parts of odd size as active listings; every other one of these has a board."""
    p, n = table(spark, sf_dir, "part"), F.col("p_size")
    items = p.select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("company_name"), F.concat(F.when(n % 4 == 1, "https://jobs.lever.co/").otherwise("https://example.com/"), "p_partkey", F.lit("?ref=x")).alias("url"), (n % 2 == 1).alias("active"))
    return collectors.listings_json(items).select("company_name", "career_page_url")


_CAPITALS = "array_to_string(list_transform(list_filter(string_split_regex({}, '[-_]+'), lambda w: w <> ''), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ')"


@query(f"select s as slug_seen, coalesce(r, {_CAPITALS.format('s')}) as company_name from (select {_SLUG} as s, max(case when p_size > 45 then 'Known ' || p_name end) as r from part group by 1)")
def vc_sitemap(spark, sf_dir):
    """The slugs of a sitemap for each part, with the names of those that were resolved."""
    p = table(spark, sf_dir, "part")
    s = F.replace("p_name", F.lit(" "), F.lit("-"))
    pages = p.select(F.col("p_partkey").alias("seq"), F.concat(F.lit("<url><loc>https://vc.com/companies/"), s, F.lit("</loc></url><url><loc>https://vc.com/about</loc></url>")).alias("payload"))
    known = p.where("p_size > 45").groupBy(s.alias("slug")).agg(F.max(F.concat(F.lit("Known "), "p_name")).alias("name"))
    found = collectors.sitemap_companies(pages, known)
    return found.select(F.replace(F.lower(F.regexp_replace("company_name", "^Known ", "")), F.lit(" "), F.lit("-")).alias("slug_seen"), "company_name")


@query(_first_of("n as company_name, website", "select s_suppkey as seq, 'Sup ' || s_suppkey % 80 as n, case when s_suppkey % 2 = 0 then 'https://S' || s_suppkey || '.io' else '' end as website from supplier"))
def board_companies(spark, sf_dir):
    """Suppliers as an embedded list, half of them with an industry for a domain."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("seq"), F.concat(F.lit("Sup "), (k % 80).cast("string")).alias("name"), F.when(k % 2 == 0, F.concat(F.lit(" S"), k.cast("string"), F.lit(".io "))).otherwise("Consumer Goods").alias("domain"))
    return collectors.board_companies(rows, "list").select("company_name", "website")


@query("select p_type, count(*) as n_rows from part group by p_type order by n_rows desc, p_type limit 1000")
def top_terms(spark, sf_dir):
    """The most frequent types of parts, at most 1000."""
    return collectors.top_terms(table(spark, sf_dir, "part"), "p_type")


@query(f"select {_CAPITALS.format('s')} as company_name, arg_min('https://jobs.lever.co/' || k, k) as career_page_url, 'lever' as ats_type from (select {_SLUG} as s, p_partkey as k from part) group by s")
def aggregator_slugs(spark, sf_dir):
    """Parts as slug, cluster and endpoint; the first endpoint of a slug counts."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("|"), "p_brand", F.lit("|https://jobs.lever.co/"), "p_partkey").alias("value"))
    return collectors.aggregator_slugs(rows).select("company_name", "career_page_url", "ats_type")


@query(f"select {_CAPITALS.format('s')} as company_name, min(k) as seq, 'workday' as ats_type from (select {_SLUG} as s, p_partkey as k from part) group by s")
def board_csv(spark, sf_dir):
    """Parts as the lines of a board's export; the tenant is what precedes the bar."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("|"), "p_brand").alias("slug"), F.lit("https://x").alias("url"))
    return collectors.board_csv(rows, "workday").select("company_name", "seq", "ats_type")


@query("select 'Supplier ' || s_suppkey as company_name, 'https://s' || s_suppkey || '.com/' as website, 'https://s' || s_suppkey || '.com' || p as career_page_url from supplier, (values ('/careers'), ('/jobs')) v(p)")
def curated_paths(spark, sf_dir):
    """S31 through its operator: two careers pages for each supplier."""
    k = F.col("s_suppkey")
    return collectors.curated(table(spark, sf_dir, "supplier").select(k.alias("seq"), F.concat(F.lit("Supplier "), k.cast("string")).alias("company_name"), F.concat(F.lit("https://s"), k.cast("string"), F.lit(".com/")).alias("website"))).select("company_name", "website", "career_page_url")


@query("select n_name as country, role from nation, (select distinct p_type as role from part)")
def country_roles(spark, sf_dir):
    """Every nation with every type of part."""
    return collectors.query_pairs(table(spark, sf_dir, "nation").select(F.col("n_name").alias("country")), table(spark, sf_dir, "part").select(F.col("p_type").alias("role")))


@query("select p_name as slug, p_brand as url from (select distinct p_name, p_brand from part where p_size <> 1 except select p_name, p_brand from part where p_size = 2) order by slug, url limit 30")
def pending_slugs(spark, sf_dir):
    """The next thirty that were not tried yet."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("slug"), F.col("p_brand").alias("url"), "p_size")
    return collectors.pending(p.where("p_size <> 1").select("slug", "url").distinct(), p.where("p_size = 2"))


# State

_BOARD = "([ 'greenhouse', 'lever', 'workable'])[1 + case board when 'click' then 0 when 'view' then 1 else 2 end]"


@query(f"""with o as (select board, {_BOARD} as ats, job, cast(floor(epoch(cast(tick as timestamp)) / 604800) as double) as now, event_id, value from {OBSERVED}),
  t as (select board, now, row_number() over (partition by board order by now) as n, count(*) over (partition by board) as m from (select distinct board, now from o)),
  k as (select o.board, ats, job, min(now) as first_seen, max(now) as last_seen, arg_max(value, event_id) as value from o group by all),
  s as (select k.*, t.m, t.n, case when ats = 'workable' or job % 5 = 0 then 0 else t.m - t.n end as miss_count from k join t on k.board = t.board and k.last_seen = t.now)
  select s.board as company, ats, cast(job as varchar) as job_id, cast(value as varchar) as title, first_seen, last_seen, cast(job % 5 = 0 as integer) as applied, cast(miss_count as integer) as miss_count, cast(miss_count >= 2 as integer) as closed,
    case when miss_count >= 2 then (select now from t where t.board = s.board and t.n = s.n + 2) end as closed_at from s""")
def tick_state(spark, sf_dir):
    """T1, T2, U1, J1, J3 through ``tick``: each week of events is one tick, folded one after the other; every fifth job is in
    the ledger, and one of three boards is never read whole."""
    o = observations(spark, sf_dir)
    week = F.floor(F.unix_timestamp(F.col("tick").cast("timestamp")) / 604800).cast("double")
    ats = F.when(F.col("board") == "click", "greenhouse").when(F.col("board") == "view", "lever").otherwise("workable")
    fresh = o.select(F.col("board").alias("company"), ats.alias("ats"), F.col("job").cast("string").alias("job_id"), F.col("value").cast("string").alias("title"), *(F.lit("").alias(c) for c in ("location", "work_type", "url", "posted_at")), F.lit(1).alias("matched"), F.col("event_id").alias("seq"), week.alias("now"), "job")
    ledger = fresh.where("job % 5 = 0").select(*state.KEY)
    now = spark.createDataFrame([], state.STATE)
    for r in fresh.select("now").distinct().orderBy("now").collect():  # a handful of weeks
        now = state.tick(now, fresh.where(F.col("now") == r["now"]), ledger, r["now"]).drop("is_new")
    return now.select(*state.KEY, "title", "first_seen", "last_seen", "applied", "miss_count", "closed", "closed_at")


@query(f"select id, job_id, case when doc_hit then 1 else applied end as applied, cast(doc_hit and applied = 0 as integer) as touched from (select *, id % 3 = 0 as doc_hit from {JOBS})")
def raised_flag(spark, sf_dir):
    """Every third posting is marked; the flag never falls."""
    j = jobs(spark, sf_dir)
    return state.raise_flag(j, j.where("id % 3 = 0"), "applied").select("id", "job_id", "applied", F.col("touched").cast("int").alias("touched"))


@query(f"select job_id, mode, status from (select job_id, 'auto' as mode, 'failed' as status, id from {JOBS} where id % 4 = 0 union all select job_id, 'manual', 'submitted', id from {JOBS} where id % 6 = 0 and id % 4 <> 0)")
def marked_applied(spark, sf_dir):
    """A ledger of every fourth posting gets those of every sixth that it lacks."""
    j = jobs(spark, sf_dir)
    ledger = j.where("id % 4 = 0").select(*state.KEY, F.lit("auto").alias("mode"), F.lit("failed").alias("status"))
    return state.mark_applied(ledger, j.where("id % 6 = 0")).select("job_id", "mode", "status")


@query(f"select id, ats from {JOBS} where ats in ('src1', 'src7')")
def purged_state(spark, sf_dir):
    """Only rows of two sources."""
    return state.purge(jobs(spark, sf_dir), ("src1", "src7")).select("id", "ats")


@query(f"select id, title from {JOBS} where id = 7")
def point_lookup(spark, sf_dir):
    """P19."""
    return serve.by_id(jobs(spark, sf_dir), 7).select("id", "title")


@query(f"select id, ats from {JOBS} where hidden = 0 and closed = 0 and ats = 'src7'")
def jobs_of_source(spark, sf_dir):
    """P5: open rows of one source."""
    return serve.filtered(jobs(spark, sf_dir), serve.JobsFilter(ats="src7"), AS_OF).select("id", "ats")


@query("select p_name, p_brand, k from (select p_name, p_brand, p_partkey as k from part where p_size < 20 union all select p_name, p_brand, p_partkey from part where p_size >= 40 and (p_name, p_brand) not in (select (p_name, p_brand) from part where p_size < 20)) qualify row_number() over (partition by p_name, p_brand order by k) = 1 or k in (select p_partkey from part where p_size < 20)")
def absent_inserted(spark, sf_dir):
    """A snapshot's rows whose key is not there yet, the first of each key; rows that are there stay."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("company"), F.col("p_brand").alias("ats"), F.lit("j").alias("job_id"), F.col("p_partkey").alias("k"), "p_size")
    return state.insert_absent(p.where("p_size < 20"), p.where("p_size >= 40"), ["k"]).select(F.col("company").alias("p_name"), F.col("ats").alias("p_brand"), "k")


@query("select p_name, arg_max(k, (l, k)) as k from (select p_name, p_partkey as k, case when p_size >= 25 then 1 else 0 end as l from part) group by p_name")
def keyed_overwrite(spark, sf_dir):
    """New rows replace old ones of their key; the last of several counts."""
    p = table(spark, sf_dir, "part").select("p_name", F.col("p_partkey").alias("k"), "p_size")
    old = merge.last_per_key(p.where("p_size < 25").select("p_name", "k"), ["p_name"], ["k"])
    return merge.overwrite(old, p.where("p_size >= 25").select("p_name", "k"), ["p_name"], ["k"])


@query("select doc_id, source, 'old' as v from documents where source is distinct from 'src1' union all select doc_id, 'src1', 'new' from documents where doc_id % 5 = 0")
def source_refresh(spark, sf_dir):
    """U8: one source's rows replaced by others, the rest kept."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return merge.replace_source(d.withColumn("v", F.lit("old")), d.where("doc_id % 5 = 0").select("doc_id", F.lit("src1").alias("source"), F.lit("new").alias("v")), "source", "src1")


# Runs and serving

_RUNS = "(select event_id as id, cast(floor(epoch_us(ts) / 1000000) as bigint) as started_at, case event_type when 'error' then 'failed' when 'view' then 'running' else 'success' end as status, user_id as jobs_new, case when user_id % 3 = 0 then user_id end as jobs_matched from events)"
_DAILY = f"select cast(cast(make_timestamp(started_at * 1000000) as date) as varchar) as date, count(*) as runs, cast(sum(jobs_new) as bigint) as jobs_new, cast(sum(coalesce(jobs_matched, 0)) as bigint) as jobs_matched, count(*) as companies_enumerated from {_RUNS} where status = 'success' group by 1"


def _daily(spark, sf_dir) -> DataFrame:
    from heddle.plans.queries import _runs

    return runs.daily_counters(_runs(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


@query(_DAILY)
def daily_counters(spark, sf_dir):
    """What finished runs added up to on each day."""
    return _daily(spark, sf_dir)


@query(f"{_DAILY} order by date desc limit 14")
def latest_days(spark, sf_dir):
    """The last fourteen days, as many as are shown by default."""
    return serve.latest_days(_daily(spark, sf_dir))


@query("select o_orderkey, o_orderdate from (select o_orderkey, cast(o_orderdate as varchar) as o_orderdate from orders order by orders.o_orderdate desc, o_orderkey desc limit 200)")
def latest_ledger(spark, sf_dir):
    """The last 200 rows of orders as a ledger."""
    o = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderdate": "applied_at", "o_orderkey": "job_id"})
    return serve.latest_ledger(o).select(F.col("job_id").alias("o_orderkey"), F.date_format("applied_at", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))


@query(f"select ats, count(*) as n from {JOBS} group by ats order by n desc, ats")
def seen_by_source(spark, sf_dir):
    """Postings by source, closed ones too, most first."""
    return serve.seen_by_source(jobs(spark, sf_dir))


@query("select user_id as id, arg_max(event_type, event_id) as status, max(event_id) as seq from events group by user_id")
def current_runs(spark, sf_dir):
    """T4: events as a log of runs, of which the last of an id counts."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return runs.current_runs(log)


@query(f"select id from {JOBS} where ats not in ('src1', 'src2') order by id limit 500")
def to_check(spark, sf_dir):
    """T5: the next rows to look at for dead links, 500 as the prune takes."""
    return runs.to_check(jobs(spark, sf_dir), ("src1", "src2")).select("id")


@query(f"select page_id from {FETCHED} where {VERDICT} <> 'dead'")
def pruned_links(spark, sf_dir):
    """Pages without those found dead."""
    from heddle.plans.queries import _fetched

    found = _fetched(spark, sf_dir)
    checked = found.select("page_id", liveness.verdict(F.col("url"), F.col("status"), F.col("html")).alias("verdict"))
    return liveness.prune(found, checked, "page_id").select("page_id")


@query(f"select job_id, min(id) as applied_at from {JOBS} where id % 3 <> 0 group by job_id, ats union all select job_id, id + 1000000 from {JOBS} where id % 3 = 0")
def saved_flags(spark, sf_dir):
    """Postings kept as applied outside the state; a new entry of a key replaces the old one."""
    j = jobs(spark, sf_dir).select(*state.KEY, F.col("id").alias("applied_at"))
    return runs.saved_applied(j, j.where("applied_at % 3 = 0").withColumn("applied_at", F.col("applied_at") + 1000000)).select("job_id", "applied_at")


@query(f"""select count(*) filter (closed = 0) as total, count(*) filter (closed = 0 and matched = 1) as matched, count(*) filter (closed = 0 and applied = 1) as applied, count(*) filter (closed = 1) as closed,
  count(*) filter (closed = 0 and first_seen >= {AS_OF} - 86400) as last_24h, count(*) filter (closed = 0 and matched = 1 and first_seen >= {AS_OF} - 86400) as matched_24h from {JOBS} where id % 5 <> 0""")
def tiles_by_deltas(spark, sf_dir):
    """A2 kept by deltas: every other row of half the sources is closed before, all change, and each fifth goes."""
    new = jobs(spark, sf_dir)
    old = new.where("id % 3 <> 0").withColumn("closed", (F.col("id") % 2 == 0).cast("int"))
    cells, left = deltas.recount(old), new.where("id % 5 <> 0")
    moved = deltas.state_changes(old, left, ["id"])
    was = {c: F.col(f"was_{c}") for c in deltas.POSTING_CELL}
    signed = deltas.signed(moved, deltas.POSTING_CELL, {c: F.col(c) for c in deltas.POSTING_CELL}, was, ~F.col("is_new"), ~F.col("gone"))
    return deltas.tiles(deltas.add(cells, signed), AS_OF)


@query(f"select id from {JOBS} where contains(lower(company), 'tion th') or contains(lower(title), 'tion th') or contains(lower(location), 'tion th')")
def search_indexed(spark, sf_dir):
    """F27 by the index of trigrams, over whole texts."""
    rows = jobs(spark, sf_dir)
    return search.search(rows, search.posting_lists(rows), "Tion th").select("id")


# Registry and companies

_REGISTRY = "select cast(p_partkey as varchar) as norm_key, p_name as name, case p_partkey % 4 when 0 then 'https://himalayas.app/' || p_partkey when 1 then 'https://jobs.lever.co/' || p_partkey when 2 then '' else 'https://x.com' end as career_page_url, case when p_partkey % 3 = 0 then 'lever' else 'unknown' end as ats_type, cast(p_size % 2 as integer) as reliable, case when p_size % 5 = 0 then 'dead404' when p_size % 7 <> 0 then 'live' end as http_status from part"


def _registry(spark, sf_dir) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://himalayas.app/"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("https://jobs.lever.co/"), k.cast("string"))).when(k % 4 == 2, "").otherwise("https://x.com")
    return table(spark, sf_dir, "part").select(k.cast("string").alias("norm_key"), F.col("p_name").alias("name"), url.alias("career_page_url"), F.when(k % 3 == 0, "lever").otherwise("unknown").alias("ats_type"), (n % 2).cast("int").alias("reliable"), F.when(n % 5 == 0, "dead404").when(n % 7 != 0, "live").alias("http_status"), F.lit("").alias("website"), F.lit("s").alias("source"), F.lit(0.0).alias("first_seen"))


@query(f"select norm_key, name from ({_REGISTRY}) where reliable = 1 and career_page_url <> ''")
def registry_export(spark, sf_dir):
    """Reliable rows with a page."""
    return registry.export(_registry(spark, sf_dir)).select("norm_key", "name")


@query(f"select norm_key from ({_REGISTRY}) where reliable = 1 and ats_type = 'lever' and http_status is not null and http_status not like 'dead%' and career_page_url <> ''")
def reliable_boards(spark, sf_dir):
    """Reliable rows of a source that are not dead."""
    return registry.reliable_boards(_registry(spark, sf_dir), "lever").select("norm_key")


@query(f"select norm_key from ({_REGISTRY}) where not contains(career_page_url, 'himalayas.app')")
def without_aggregators(spark, sf_dir):
    """P15."""
    return registry.without_aggregators(_registry(spark, sf_dir)).select("norm_key")


@query(f"select count(*) as total, count(*) filter (reliable = 1) as reliable, round(100 * count(*) filter (reliable = 1) / 5000, 1) as percent, greatest(5000 - count(*) filter (reliable = 1), 0) as gap from ({_REGISTRY})")
def registry_progress(spark, sf_dir):
    """A16."""
    return registry.progress(_registry(spark, sf_dir), 5000)


@query(f"select norm_key, name, source from (select norm_key, name, 's' as source from ({_REGISTRY}) union all select 'c' || c_custkey, c_name, 'seed' from customer)")
def registry_seed(spark, sf_dir):
    """Customers that the registry lacks, as unchecked rows."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("norm_key"), F.col("c_name").alias("company_name"), *(F.lit("").alias(x) for x in ("website", "career_page_url", "ats_type")))
    return runs.registry_seed(_registry(spark, sf_dir), c).select("norm_key", "name", "source")


@query(f"select company_name, cast(i - 1 as integer) as place, b as ats from (select company_name, unnest(l) as b, unnest(range(1, len(l) + 1)) as i from (select company_name, case when ats_type in ('greenhouse', 'lever', 'ashby') then [ats_type] when ats_type = 'unknown' then ['greenhouse', 'lever', 'ashby'] end as l from {MERGED} where ats_source = 'guess'))")
def probe_targets(spark, sf_dir):
    """Boards to probe where the source is a guess."""
    return runs.probe_targets(resolve.merge_entries(entries(spark, sf_dir)))


@query(f"select count(*) as total_companies, count(*) filter ({among('ats_type', resolve.AUTOMATABLE)}) as automatable_count, coalesce(string_agg(company_name, '|' order by seq) filter (ats_conflict), '') as ats_conflicts from {MERGED}")
def company_totals(spark, sf_dir):
    """Totals and the names in conflict."""
    return resolve.summary(resolve.merge_entries(entries(spark, sf_dir))).select("total_companies", "automatable_count", F.array_join("ats_conflicts", "|").alias("ats_conflicts"))


_ORDER = "case ats_type " + " ".join(f"when {q(b)} then {i}" for i, b in enumerate(resolve.ORDER)) + " else 99 end"


@query(f"select company_name, ats_type from {MERGED} order by {_ORDER}, lower(company_name), seq limit 300")
def company_order(spark, sf_dir):
    """The first 300 of the company list in its order."""
    return resolve.ordered(resolve.merge_entries(entries(spark, sf_dir))).limit(300).select("company_name", "ats_type")


# Scalar functions and predicates


@query(SQL["match_role_exclude"])
def match_by_automaton(spark, sf_dir):
    """P1 over whole texts, all literals found by one automaton."""
    found = match.match_long(jobs(spark, sf_dir).withColumn("work_type", F.lit("any")), PROFILE)
    return found.select("id", F.col("matched").cast("int").alias("matched"), F.array_join("reasons", "; ").alias("reasons"))

_WHEN = "(epoch_ms(o_orderdate) + o_orderkey % 1000)"


@query(f"select o_orderkey, case when o_orderkey % 7 = 0 then '' else strftime(make_timestamp({_WHEN} * 1000), '%Y-%m-%dT%H:%M:%S.%f+00:00') end as iso from orders")
def posted_millis(spark, sf_dir):
    """milliseconds as text; every seventh is no number."""
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.iso_from_millis(F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(ms.cast("string"))).alias("iso"))


_AGE = "(epoch(timestamp '1998-08-01') - epoch(o_orderdate) - o_orderkey % 90000)::bigint"


@query(f"select o_orderkey, case when o_orderkey % 9 = 0 then '' when {_AGE} < 0 then 'now' when {_AGE} < 60 then {_AGE} || 's ago' when {_AGE} < 3600 then {_AGE} // 60 || 'm ago' when {_AGE} < 86400 then {_AGE} // 3600 || 'h ago' else {_AGE} // 86400 || 'd ago' end as age, case when o_orderkey % 9 = 0 then '—' else strftime(o_orderdate + to_seconds(o_orderkey % 90000), '%Y-%m-%d') end as day from orders")
def ages(spark, sf_dir):
    """F23, F24."""
    then = F.when(F.col("o_orderkey") % 9 != 0, F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 90000))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.age_text(then, F.lit("1998-08-01").cast("timestamp")).alias("age"), dates.day_text(then).alias("day"))


@query("select s_suppkey, cast(lower(s_name) in ('supplier#000000001', 'supplier#000000003') and s_suppkey <> 3 as integer) as allowed, cast(s_nationkey % 3 <> 2 and s_suppkey % 2 = 1 as integer) as enumerable from supplier")
def allowed_boards(spark, sf_dir):
    """P3, P4."""
    s = table(spark, sf_dir, "supplier")
    board_of, token = at(("lever", "ashby", "custom"), F.col("s_nationkey")), F.when(F.col("s_suppkey") % 2 == 1, "t")
    return s.select("s_suppkey", match.allowed(F.col("s_name"), ("Supplier#000000001", "Supplier#000000003"), ("Supplier#000000003",)).cast("int").alias("allowed"), match.enumerable(board_of, token, ("lever", "ashby")).cast("int").alias("enumerable"))


_HOSTS = ("boards.greenhouse.io", "jobs.lever.co", "acme.breezy.hr", "example.com")
_URL = f"'https://' || {at_sql(_HOSTS, 'p_partkey')} || '/' || replace(p_name, ' ', '-') || '/x?y=1'"


@query(f"select p_partkey, 'https://' || {host('u')} || case when {among(board('u'), urls.PATH_BOARDS)} and {segment('u')} <> '' then '/' || {segment('u')} else '' end as root, case b when 'smartrecruiters' then nullif(regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '') when 'workday' then u else case when p_size % 2 = 0 then 'tok' end end as token from (select *, {_URL} as u, {at_sql(('smartrecruiters', 'workday', 'lever'), 'p_size')} as b from part)")
def board_roots(spark, sf_dir):
    """F30, F40."""
    url = F.concat(F.lit("https://"), at(_HOSTS, F.col("p_partkey")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/x?y=1"))
    kind = at(("smartrecruiters", "workday", "lever"), F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", urls.board_root(urls.board_from_url(url), url).alias("root"), urls.query_token(kind, F.col("p_name"), url, F.when(F.col("p_size") % 2 == 0, "tok").otherwise("")).alias("token"))


@query(f"select p_partkey, cast(({has('lower(u)', [m for _, marks in urls.URL_RULES for m in marks])}) as integer) as is_board, cast(regexp_matches(d, '^[a-z0-9][a-z0-9.-]*\\.[a-z]{{2,}}$') as integer) as is_domain, cast(n <> '' and length(n) <= 14 and not regexp_matches(n, '^[0-9]') and lower(n) <> 'cold widget' as integer) as valid from (select p_partkey, {_URL} as u, lower(replace(p_name, ' ', case when p_size % 2 = 0 then '.' else ' ' end)) as d, case when p_size % 5 = 0 then '7' || p_name else p_name end as n from part)")
def name_tests(spark, sf_dir):
    """P11, P13, P18."""
    url = F.concat(F.lit("https://"), at(_HOSTS, F.col("p_partkey")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/x?y=1"))
    domain = F.replace("p_name", F.lit(" "), F.when(F.col("p_size") % 2 == 0, ".").otherwise(" "))
    n = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("7"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", match.is_board_url(url).cast("int").alias("is_board"), urls.is_domain(domain).cast("int").alias("is_domain"), match.valid_name(n, 14, ("cold widget",)).cast("int").alias("valid"))


@query("select url as job_id, coalesce(nullif(company, ''), 'unknown') as company, title, matched from (select case when p_size % 4 <> 0 then 'https://x/' || p_partkey else '' end as url, case when p_size % 3 = 0 then '' else p_brand end as company, p_name as title, cast(p_size % 2 = 0 as integer) as matched from part) where url <> ''")
def flat_seed(spark, sf_dir):
    """Parts as a flat list of postings."""
    n = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.when(n % 4 != 0, F.concat(F.lit("https://x/"), F.col("p_partkey").cast("string"))).alias("url"), F.when(n % 3 == 0, "").otherwise(F.col("p_brand")).alias("company"), F.lit(None).cast("string").alias("ats"), F.col("p_name").alias("title"), F.lit("").alias("location"), F.when(n % 2 == 0, "accept").when(n % 5 == 0, "reject").alias("loc_class"))
    return runs.flat_seed(rows, 5.0).select("job_id", "company", "title", "matched")


@query(f"select c_custkey from customer where {key('split_part(c_name, chr(35), 2)')} not in (select {key('split_part(s_name, chr(35), 2)')} from supplier)")
def known_names(spark, sf_dir):
    """J5 through ``append_absent``: customers whose number is no supplier's, the first of each."""
    named = lambda df, n, k: df.select(names.ascii_key(F.substring_index(n, "#", -1)).alias("k"), F.col(k).alias("id"))
    known = named(table(spark, sf_dir, "supplier"), "s_name", "s_suppkey").withColumn("old", F.lit(True))
    new = named(table(spark, sf_dir, "customer"), "c_name", "c_custkey").withColumn("old", F.lit(False))
    return merge.append_absent(known, new, ["k"], ["id"]).where(~F.col("old")).select(F.col("id").alias("c_custkey"))


