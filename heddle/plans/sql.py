"""DuckDB's SQL for the queries, over whole tables. Fixed values come from the operators' own tables."""

from __future__ import annotations

from heddle.functions import names, urls
from heddle.operators import liveness as alive
from heddle.operators import match as matching
from heddle.operators import resolve
from heddle.plans.views import AS_OF, PROFILE

ORACLES: dict[str, str] = {}


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def has(c: str, parts) -> str:
    return "(" + (" or ".join(f"contains({c}, {q(p)})" for p in parts) or "false") + ")"


def among(c: str, values) -> str:
    return f"{c} in ({', '.join(map(q, values))})"


def host(u: str) -> str:
    """Host of a URL without port; these tables' URLs hold no user."""
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def last_two(h: str) -> str:
    return f"array_to_string(list_slice(string_split({h}, '.'), -2, -1), '.')"


def legacy_host(u: str) -> str:
    return f"regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^[w.]+', '')"


def key(n: str) -> str:
    return f"regexp_replace(lower({n}), '[^a-z0-9]', '', 'g')"


def name_key(n: str) -> str:
    return key(f"regexp_replace(lower({n}), '\\s*\\(.*?\\)\\s*', ' ', 'g')")


def board(u: str) -> str:
    return "case " + " ".join(f"when {has(f'lower({u})', marks)} then {q(b)}" for b, marks in urls.URL_RULES) + " end"


def board_by_host(h: str) -> str:
    return "case " + " ".join(f"when regexp_matches({h}, {q(p)}) then {q(b)}" for b, p in urls.HOST_RULES) + " end"


def rank(u: str) -> str:
    b = board(u)
    return f"case when {b} = 'yc' then 1 when {b} is not null then 0 when {has(f'lower({path(u)})', urls.CAREER_PARTS)} then 2 when {has(u, urls.PROFILE_SITES)} then 3 else 4 end"


def segment(u: str) -> str:
    return f"regexp_extract({u}, 'https?://[^/]+/([A-Za-z0-9_\\-]+)', 1)"


def label(u: str) -> str:
    h = host(u)
    return f"case when len(string_split({h}, '.')) >= 3 then string_split({h}, '.')[1] else '' end"


def token(b: str, source: str, u: str) -> str:
    return (
        f"case when {source} in ('url', 'verified') and {among(b, urls.SUBDOMAIN_BOARDS)} then nullif({label(u)}, '') when {source} in ('url', 'verified') and {among(b, urls.PATH_BOARDS)} then nullif({segment(u)}, '') "
        f"when {b} = 'mailto' or ({source} in ('url', 'verified') and {b} = 'workday') then {u} end"
    )


def slug(b: str, u: str) -> str:
    low = f"regexp_replace(lower({u}), '/+$', '')"
    return f"case {b} " + " ".join(f"when {q(n)} then nullif(regexp_extract({low}, {q(p)}, 1), '')" for n, p in urls.SLUG_PATTERNS) + " end"


JOBS = f"""(select doc_id as id, lang as company, source as ats, cast(doc_id as varchar) as job_id, text as title, lang as location,
  cast({AS_OF} - (doc_id * 7919) % 604800 as double) as first_seen, cast({AS_OF} - (doc_id * 104729) % 86400 as double) as last_seen,
  cast(contains(lower(text), 'ing') as integer) as matched, cast(doc_id % 11 = 0 as integer) as applied, cast(doc_id % 17 = 0 as integer) as hidden, cast(doc_id % 7 = 0 as integer) as closed from documents)"""
PLACES = """(select c_custkey, c_mktsegment as title, case when c_custkey % 13 = 0 then '' else n_name || ', ' || r_name end as location,
  (['remote', 'hybrid', 'onsite', '', 'full time'])[c_custkey % 5 + 1] as work_type from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
OBSERVED = "(select event_type as board, user_id as job, cast(ts as date) as tick, event_id, value from events)"


def reasons(title: str, location: str, kind: str) -> str:
    t, loc, p = f"lower({title})", f"lower({location})", PROFILE
    hit = has(t, p.role_keywords)
    plain, senior = [k for k in p.exclude_keywords if k not in matching.SENIORITY], [k for k in p.exclude_keywords if k in matching.SENIORITY]
    bare = f"rtrim(trim({loc}), '.')"
    us = f"({has(loc, matching.US_MARKS)} or {among(bare, matching.US_BARE)} or " + " or ".join(f"ends_with({loc}, {q(' ' + x)}) or starts_with({loc}, {q(x + ' ')})" for x in matching.US_BARE) + ")"
    regions = [x for x in p.location_pref if x not in matching.NO_REGION]
    place = f"case when {kind} = 'remote' then case when {us} and not {has(loc, regions)} then {q(matching.US_ONLY)} end when {kind} in ('hybrid', 'onsite', '') then case when {loc} = '' then {q(matching.NO_PLACE)} when not {has(loc, p.location_pref)} then 'location ''' || {location} || ''' not in preferred list' end end"
    return f"list_filter([case when not {hit} then {q(matching.NOT_ROLE)} end, case when {has(t, plain)} or (not {hit} and {has(t, senior)}) then {q(matching.EXCLUDED)} end, {place}], lambda x: x is not null)"


O = ORACLES
O["match_role_exclude"] = f"select id, cast(len(r) = 0 as integer) as matched, array_to_string(r, '; ') as reasons from (select id, {reasons('title', 'location', chr(39) + 'any' + chr(39))} as r from {JOBS})"
O["match_location"] = f"select c_custkey, location, work_type, cast(len({reasons(q('testing'), 'location', 'work_type')}) = 0 as integer) as matched from {PLACES}"
O["match_reasons"] = f"select c_custkey, array_to_string({reasons('title', 'location', 'work_type')}, '; ') as reasons from {PLACES}"
_other = f"regexp_matches(lower(title), {q(matching.OTHER_ROLES_LEAD)})"
O["relevance_gate"] = f"""select id, role from {JOBS}, (values ('th ing'), ('que de')) r(role)
  where (contains(lower(title), role) or contains(replace(lower(title), ' ', ''), replace(role, ' ', ''))) and (not {_other} or regexp_matches(lower(title), '\\b(sd|software development engineer)') or starts_with(lower(title), 'sdet'))"""
O["posted_recently"] = "select o_orderkey, cast(cast(o_orderdate as date) as varchar) as day from orders where o_orderdate >= timestamp '1998-12-31' - interval 90 days"

_cols = "id, company, ats, title, first_seen, matched"
for _mode, _order in {"recent": "first_seen desc", "company": "company, first_seen desc", "matched": "matched desc, first_seen desc"}.items():
    O[f"list_jobs_{_mode}"] = f"select {_cols} from {JOBS} where hidden = 0 and closed = 0 order by {_order}, id limit 50"
O["list_jobs_search"] = f"select id, title from {JOBS} where hidden = 0 and closed = 0 and matched = 1 and applied = 0 and first_seen >= {AS_OF} - 432000 and (contains(lower(company), 'ere') or contains(lower(title), 'ere') or contains(lower(location), 'ere'))"
O["list_jobs_page"] = f"select id, ats, (select count(*) from {JOBS} where hidden = 0) as total from {JOBS} where hidden = 0 order by first_seen desc, id limit 20 offset 40"
O["stats_tiles"] = f"""select count(*) filter (closed = 0) as total, count(*) filter (closed = 0 and matched = 1) as matched, count(*) filter (closed = 0 and applied = 1) as applied, count(*) filter (closed = 1) as closed,
  count(*) filter (closed = 0 and first_seen >= {AS_OF} - 86400) as last_24h, count(*) filter (closed = 0 and matched = 1 and first_seen >= {AS_OF} - 86400) as matched_24h from {JOBS}"""
O["open_by_source"] = f"select ats, count(*) as n from {JOBS} where closed = 0 group by ats"
O["open_by_source_map"] = f"select string_agg(ats || '=' || n, ',' order by ats) as counts from ({O['open_by_source']})"
O["distinct_sources"] = "select distinct source as ats from documents where source is not null"
O["ledger_mode_status"] = "select o_orderpriority || ':' || o_orderstatus as key, count(*) as n from orders group by 1"
_runs = """(select event_id as id, cast(floor(epoch_us(ts) / 1000000) as bigint) as started_at, case event_type when 'error' then 'failed' when 'view' then 'running' else 'success' end as status,
  user_id as jobs_new, case when user_id % 3 = 0 then user_id end as jobs_matched from events)"""
O["runs_by_day"] = f"select cast(cast(make_timestamp(started_at * 1000000) as date) as varchar) as day, count(*) as runs, cast(sum(coalesce(jobs_new, 0)) as bigint) as jobs_new, cast(sum(coalesce(jobs_matched, 0)) as bigint) as jobs_matched, count(*) as companies_done, max(started_at) as last_started from {_runs} where status in ('success', 'failed') group by 1"
O["latest_runs"] = f"select id, started_at, status from {_runs} order by started_at desc, id desc limit 25"
O["snapshot_top"] = f"select id, last_seen from {JOBS} order by last_seen desc, id limit 100"
O["listing_by_company"] = f"""with first as (select ats as company, cast(substring(ats, 4) as bigint) as company_seq, id as job_seq, case when id % 5 <> 0 then first_seen end as posted_ts from {JOBS} order by company_seq, job_seq limit 200)
  select job_seq, company, min(company_seq) over (partition by company) as group_seq, posted_ts from first"""
O["job_status"] = f"select case when closed = 1 then 'closed' when applied = 1 then 'applied' when matched = 1 then 'matched' else 'other' end as status, count(*) as n from {JOBS} group by 1"

O["rotate_slice"] = "select c_custkey, turn from (select c_custkey, (row_number() over (order by c_mktsegment, c_custkey) - 1 - 1450 + 100 * n) % n as turn from customer, (select count(*) as n from customer)) where turn < 120"
for _name, _dir in (("first_wins", ""), ("last_wins", "desc")):
    O[_name] = f"select conv_id, role, turn, length(text) as n_chars from conversations qualify row_number() over (partition by conv_id, role order by turn {_dir}, text {_dir}) = 1"
O["insert_or_ignore"] = """with p as (select p_name as name, min(p_partkey) as seq from part group by 1), n as (select c_mktsegment as name, c_custkey as seq from customer union all select p_name, p_partkey + 1000000 from part)
  select * from p union all select name, min(seq) as seq from n where not exists (select 1 from p where p.name = n.name) group by name"""
O["overlay_precedence"] = """select p_brand, p_partkey, p_size from (select p_brand, p_partkey, p_size, 0 as l from part union all select p_brand, p_partkey, p_size, 1 from part where p_size > 25 union all select p_brand, p_partkey, p_size, 2 from part where p_size = 50)
  qualify row_number() over (partition by p_brand order by l desc, p_partkey) = 1"""
O["coalesce_merge"] = "select user_id, " + ", ".join(f"arg_min(value, event_id) filter (event_type = '{k}') as {k}" for k in ("click", "error", "view")) + " from events group by user_id"
O["rollup_sets"] = "select user_id, arg_min(event_type, event_id) as first_kind, array_to_string(list_sort(list_distinct(list(event_type))), ',') as kinds, case when bool_or(event_type = 'purchase') then 'core' else 'adjacent' end as tier from events group by user_id"
O["canonical_name"] = "select p_brand, p_name as name from (select p_brand, p_name, count(*) as n, min(p_partkey) as f from part group by 1, 2) qualify row_number() over (partition by p_brand order by n desc, length(p_name), f) = 1"
O["scan_cap"] = "select cast(day as varchar) as day, max(n) as total, string_agg(cast(event_id as varchar), ',' order by event_id) filter (rn <= 5) as first_values from (select cast(ts as date) as day, event_id, row_number() over (partition by cast(ts as date) order by event_id) as rn, count(*) over (partition by cast(ts as date)) as n from events) group by day"
O["known_name_antijoin"] = "select c_custkey from customer where not exists (select 1 from supplier where split_part(s_name, '#', 2) = split_part(c_name, '#', 2))"
O["two_paths_expand"] = "select s_suppkey, 'https://supplier-' || s_suppkey || '.com' || path as url from supplier, (values ('/careers'), ('/jobs')) t(path)"
O["daily_new"] = f"select cast(day as varchar) as day, count(*) as jobs_new from (select min(tick) as day from {OBSERVED} group by board, job) group by day"

O["applied_flag"] = "select doc_id, cast(exists (select 1 from labels l where l.toxic = 1 and l.doc_id = d.doc_id) as integer) as applied from documents d"
O["upsert_state"] = f"select board, job, cast(min(tick) as varchar) as first_tick, cast(max(tick) as varchar) as last_tick, arg_max(value, event_id) as value from {OBSERVED} group by 1, 2"
O["reap_state"] = f"""with o as (select distinct board, job, tick from {OBSERVED}), t as (select board, tick, row_number() over (partition by board order by tick) as n from (select distinct board, tick from o)),
  k as (select board, job, min(tick) as first_tick, max(tick) as last_tick, max(n) as ln, cast(job < 5 as integer) as applied from o join t using (board, tick) group by board, job),
  s as (select k.*, case when applied = 1 then 0 else mx - ln end as miss_count from k join (select board, max(n) as mx from t group by board) using (board))
  select s.board, job, cast(first_tick as varchar) as first_tick, cast(last_tick as varchar) as last_tick, applied, cast(miss_count as bigint) as miss_count, cast(miss_count >= 2 as integer) as closed, cast(t.tick as varchar) as closed_tick from s left join t on t.board = s.board and s.miss_count >= 2 and t.n = s.ln + 2"""
O["registry_upsert"] = """with b as (select cast(user_id as varchar) as k, event_type as name, case when event_id % 3 = 0 then 'https://s' || event_id else '' end as website, case when event_id % 4 = 0 then 'https://u' || event_id else '' end as url,
    case when event_type = 'view' then 'unknown' else event_type end as ats, case when event_id % 5 = 0 then 'dead' else 'live' end as st, cast(event_id % 50 = 0 as integer) as rel, event_id as seq from events),
  n as (select k, arg_max(name, seq) as name, arg_max(website, seq) filter (website <> '') as website, arg_max(url, seq) filter (url <> '') as url, arg_max(ats, seq) filter (ats <> 'unknown') as ats, arg_max(st, seq) as st, max(rel) as rel, min(seq) as fs from b group by k),
  m as (select n.*, cast(k as integer) < 100 as was, cast(k as integer) < 100 and cast(k as integer) % 9 = 0 as light from n)
  select k as norm_key, name, coalesce(website, case when was then 'https://old' else '' end) as website, case when light then '' else coalesce(url, '') end as career_page_url, coalesce(ats, case when was then 'lever' else 'unknown' end) as ats_type,
    case when was then 'seed' else 'batch' end as source, case when light then 'none' else st end as http_status, case when light then 1 else rel end as reliable, case when was then -1.0::double else cast(fs as double) end as first_seen,
    cast(not was as integer) as is_new, cast(not light and rel = 1 as integer) as became_reliable from m"""


def entry(level: int, source: str, k: str, n: str, tab: str) -> str:
    s = key("n")
    return f"""select k + {level * 10_000_000} as seq, n as company_name, case when k % 4 = 3 then '' else (['https://boards.greenhouse.io/', 'https://jobs.lever.co/', 'https://example.com/careers/', ''])[k % 4 + 1] || {s} end as career_page_url,
  case when k % 3 = 0 then 'https://www.' || {s} || '.com' else '' end as website, case when k % 6 = 0 then {s} else '' end as domain_hint, (['greenhouse', 'lever', 'unknown', 'custom', ''])[k % 5 + 1] as ats_type, '{source}' as source_platform from (select {k} as k, {n} as n from {tab})"""


ENTRIES = "(" + " union all ".join((entry(0, "parts", "p_partkey", "split_part(p_name, ' ', 1) || ' ' || p_brand", "part"), entry(1, "suppliers", "s_suppkey", "s_name", "supplier"), entry(2, "customers", "c_custkey", "'Brand#' || (c_custkey % 50) || ' (Inc)'", "customer"))) + ")"
_slug = slug("ats_type", "career_page_url")
O["dup_board_keeper"] = f"""with r as (select cast(seq as varchar) as norm_key, company_name as name, career_page_url, {board('career_page_url')} as ats_type, seq from {ENTRIES}), s as (select *, {_slug} as slug from r)
  select norm_key, ats_type from s where slug is null union all (select norm_key, ats_type from s where slug is not null qualify row_number() over (partition by ats_type, slug order by {key('name')} = {key('slug')}, seq, norm_key) = 1)"""
_same = "length(slug) >= 5 and length(replace(slug, substring(slug, 1, 1), '')) = 0"
O["junk_slug"] = f"""select p_partkey, slug from (select p_partkey, unnest([repeat(substring(p_name, 1, 1), 6), case when length(cast(p_partkey as varchar)) >= 6 then substring(cast(p_partkey as varchar), 1, 6) else lpad(cast(p_partkey as varchar), 6, '1') end,
  regexp_replace(p_name || p_partkey, '[aeiou ]', '', 'g'), replace(p_name, ' ', '')]) as slug from part)
  where regexp_matches(slug, '^[0-9]{{6,}}$') or ({_same}) or (length(slug) >= 7 and not regexp_matches(slug, '[aeiou]') and regexp_matches(slug, '[0-9]'))"""

_flags = sorted({"".join(ch for ch in x if ch.isalnum()) for x in resolve.FLAGGED})
_sure = ", ".join(f"({q(k)}, {q(a)}, {q(u)})" for k, a, u in resolve.VERIFIED)
_lab = "lower(coalesce(nullif(ats_type, ''), 'unknown'))"
_dom = lambda w: f"nullif({last_two(legacy_host(w))}, '')"
MERGED = f"""(with e as (select *, coalesce(nullif({name_key('company_name')}, ''), {_dom('website')}, {_dom('career_page_url')}, {name_key('company_name')}) as key from {ENTRIES}),
  n as (select key, company_name as name from (select key, company_name, count(*) as c, min(seq) as f from e group by 1, 2) qualify row_number() over (partition by key order by c desc, length(company_name), f) = 1),
  g as (select key, min(seq) as seq, list_transform(list_sort(list_distinct(list({{'r': {rank('career_page_url')}, 'u': career_page_url}}) filter (career_page_url <> ''))), lambda x: x.u) as urls,
    coalesce(arg_min(website, seq) filter (website <> ''), '') as website, coalesce(arg_min(domain_hint, seq) filter (domain_hint <> ''), '') as domain_hint, list_sort(list_distinct(list(source_platform))) as sources, list_sort(list_distinct(list({_lab}))) as labels from e group by key),
  p as (select g.*, n.name, coalesce(urls, []::varchar[]) as all_urls, coalesce(urls[1], website) as prim, {name_key('n.name')} as vkey from g join n using (key)),
  t as (select p.*, {board('prim')} as fromurl from p),
  a as (select t.*, coalesce(fromurl, list_min(list_filter(labels, lambda x: x not in ('unknown', 'custom'))), case when list_contains(labels, 'custom') then 'custom' else 'unknown' end) as ats0, case when fromurl is null then 'guess' else 'url' end as src0,
    len(list_distinct(list_filter(list_concat(labels, case when fromurl is null then []::varchar[] else [fromurl] end), lambda x: {among('x', resolve.NO_STANDARD).replace(' in (', ' not in (')}))) > 1 as conf0 from t),
  v as (select a.*, o.oats, o.ourl from a left join (values {_sure}) o(okey, oats, ourl) on vkey = okey),
  w as (select v.*, case when ourl is not null and not list_contains(all_urls, ourl) then list_concat([ourl], all_urls) else all_urls end as urls2 from v)
  select seq, name as company_name, website, coalesce(ourl, prim) as career_page_url, list_slice(urls2, 2, len(urls2)) as alternates, coalesce(oats, ats0) as ats_type, case when ourl is null then src0 else 'verified' end as ats_source, case when ourl is null then conf0 else false end as ats_conflict,
    labels, case when ourl is null then {token('ats0', 'src0', 'prim')} else nullif({segment('ourl')}, '') end as board_token, domain_hint, sources, {among('vkey', _flags)} as flagged from w)"""
_bslug = f"case when {among('ats_type', urls.SUBDOMAIN_BOARDS)} then {label('career_page_url')} else {segment('career_page_url')} end"
_bd = last_two(legacy_host("website"))
_first = key(f"split_part({_bd}, '.', 1)")
O["consolidate"] = f"""with m as (select *, case when {among('ats_type', urls.SUBDOMAIN_BOARDS + urls.PATH_BOARDS)} and career_page_url <> '' and ats_source in ('url', 'verified', 'discovered') then nullif(rtrim(replace(replace(lower(career_page_url), 'https://', ''), 'http://', ''), '/'), '') end as k from {MERGED}),
  b as (select *, count(*) over (partition by k) as n, first_value({_bslug}) over (partition by k order by seq) as slug from m where k is not null),
  o as (select *, {name_key('slug')} <> '' and ({name_key('company_name')} = {name_key('slug')} or (website <> '' and {_bd} <> '' and ({name_key('slug')} = {_first} or contains({_bd}, {name_key('slug')}) or (length({_first}) >= 4 and starts_with({name_key('slug')}, {_first}))))) as owner from b),
  d as (select k, arg_min(seq, {{'a': case when website <> '' then 0 else 1 end, 'b': length(company_name), 'c': seq}}) as keep, count(distinct nullif({_bd}, '')) as doms from o where owner group by k),
  s as (select o.*, d.keep, d.doms, n >= 2 and coalesce(d.keep <> seq, true) as lost from o left join d using (k)),
  z as (select seq, company_name, website, career_page_url, alternates, ats_type, ats_source, ats_conflict, labels, board_token, domain_hint, sources, false as lost from m where k is null
    union all select seq, company_name, website, career_page_url, alternates, ats_type, ats_source, ats_conflict, labels, board_token, domain_hint, sources, lost from s where n < 2 or not owner or coalesce(keep = seq, false) or doms > 1)
  select company_name, website, case when lost then website else career_page_url end as career_page_url, case when lost then '' else array_to_string(alternates, ' ') end as alternates, case when lost then 'unknown' else ats_type end as ats_type, case when lost then 'guess' else ats_source end as ats_source,
    cast(case when lost then false else ats_conflict end as integer) as ats_conflict, array_to_string(labels, ',') as labels, case when lost then null else board_token end as board_token, domain_hint, array_to_string(sources, ',') as sources from z"""
O["company_summary"] = f"select ats_type, count(*) as companies, count(*) filter (coalesce(board_token, '') <> '') as automatable from {MERGED} group by ats_type"
_bool = lambda c: f"case when {c} then 'True' else 'False' end"
O["csv_export_rows"] = f"select company_name, ats_type || ',' || ats_source || ',' || {_bool('ats_conflict')} || ',' || coalesce(board_token, '') || ',' || array_to_string(sources, '|') || ',' || {_bool('flagged')} as line from {MERGED}"

_stop = ", ".join(map(q, names.PAREN_STOPWORDS))


def candidates(n: str) -> str:
    base = name_key(n)
    inside = f"list_filter(flatten(list_transform(regexp_extract_all(lower({n}), '\\(([^)]+)\\)', 1), lambda g: string_split_regex(g, '[^a-z0-9]+'))), lambda w: w <> '' and w not in ({_stop}))"
    shorter = "[" + ", ".join(f"case when ends_with({base}, {q(s)}) and length({base}) > {len(s) + 2} then substring({base}, 1, length({base}) - {len(s)}) else '' end" for s in names.SLUG_SUFFIXES) + "]"
    every = f"list_filter([{base}] || {inside} || {shorter} || [regexp_replace({base}, '[0-9]+$', '')], lambda x: x <> '')"
    # The first of equal values stays, so the order is that of first places.
    return f"list_transform(list_filter(list_zip({every}, range(1, len({every}) + 1)), lambda x: list_position({every}, x[1]) = x[2]), lambda x: x[1])"


_named = "(['Labs', '(formerly Acme Tools)', 'Inc', '42', 'Health'])[p_partkey % 5 + 1]"
O["slug_candidates"] = f"select p_partkey, array_to_string({candidates('n')}, ',') as candidates from (select p_partkey, p_name || ' ' || {_named} as n from part)"
O["candidate_probe"] = f"""with live as (select distinct replace(p_name, ' ', '') as slug, (['lever', 'ashby', 'greenhouse'])[p_size % 3 + 1] as ats from part where length(replace(p_name, ' ', '')) % 2 = 0),
  n as (select distinct p_name as name from part), c as (select name, unnest({candidates('name')}) as slug, generate_subscripts({candidates('name')}, 1) as cp from n),
  t as (select * from c, (values (1, 'greenhouse'), (2, 'lever'), (3, 'ashby')) b(ap, ats))
  select name, ats, slug from t join live using (ats, slug) qualify row_number() over (partition by name order by ap, cp) = 1"""
_title = "regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g')"
_t = f"{_title} || ' (Brand GmbH) Co.'"
O["norm_keys"] = f"select page_id, {name_key(_t)} as n1, {key(_t)} as n2, regexp_replace(lower({_t}), '[^\\p{{L}}\\p{{N}}]', '', 'g') as n3 from pages"
O["bare_domain"] = f"select page_id, {host('url')} as host, {last_two(host('url'))} as domain, replace({host('url')}, 'www.', '') as plain from pages"
O["bare_domain_legacy"] = f"select page_id, {legacy_host('url')} as host, {last_two(legacy_host('url'))} as domain from pages"
BOARDS = "(select p_partkey, 'https://' || (['boards.greenhouse.io', 'jobs.lever.co', 'acme.breezy.hr', 'x.jobs.personio.com', 'Apply.Workable.com', 'acme.wd5.myworkdayjobs.com', 'wise.jobs', 'example.com', 'www.ycombinator.com/companies'])[p_partkey % 9 + 1] || '/' || replace(p_name, ' ', '-') || case when p_size > 25 then '/careers?x=1' else '' end as url from part)"
O["ats_from_url"] = f"select p_partkey, ats, {rank('url')} as url_rank, {token('ats', q('url'), 'url')} as token, {slug('ats', 'url')} as slug from (select p_partkey, url, {board('url')} as ats from {BOARDS})"
O["detect_host"] = f"select p_partkey, {board_by_host(host('url'))} as ats from {BOARDS}"
_iso = "regexp_replace(trim(posted), '^([0-9]{2})\\.([0-9]{2})\\.([0-9]{4})$', '\\3-\\2-\\1')"
O["posted_parse"] = f"""select o_orderkey, {_iso} as iso, case when regexp_matches(posted, '^[0-9]{{4}}-') then strftime(coalesce(try_cast(posted as timestamp), try_cast(substring(posted, 1, 10) as timestamp)), '%Y-%m-%d %H:%M:%S') end as parsed
  from (select o_orderkey, ([strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), strftime(o_orderdate, '%Y-%m-%d') || ' soon', strftime(o_orderdate, '%Y'), '', strftime(o_orderdate, '%d.%m.%Y')])[o_orderkey % 6 + 1] as posted from orders)"""
O["page_title"] = f"select page_id, {_title} as title from pages"
_links = "regexp_extract_all(html, '(?i)<a\\b[^>]*?href=\"([^\"]*)\"', 1)"
O["page_links"] = f"select page_id, cast(i - 1 as bigint) as at, l[i] as href from (select page_id, {_links} as l, unnest(range(1, len({_links}) + 1)) as i from pages)"
_s = "replace(p_name, ' ', '-') || '_IO-' || (p_partkey % 3)"
_cap = "upper(substring(w, 1, 1)) || substring(w, 2)"
O["display_names"] = f"""select p_partkey, array_to_string(list_transform(list_filter(string_split_regex({_s}, '[-_\\s]+'), lambda w: w <> ''), lambda w: case when w = lower(w) then {_cap} else w end), ' ') as pretty,
  array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(lower({_s}), '-[0-9]+$', ''), '[-_]+'), lambda w: w <> ''), lambda w: {_cap}), ' ') as humanised from part"""

FETCHED = """(select page_id, case when page_id % 10 = 5 then 'mailto:x' else url end as url, case page_id % 10 when 0 then 404 when 1 then 500 when 2 then null else 200 end as status,
  case page_id % 10 when 3 then html || 'Page Not Found' when 4 then replace(html, '<title>', '<title>404 ') else html end as html from pages)"""
VERDICT = f"""case when not starts_with(url, 'http') then 'dead' when status is null then 'unknown' when status in (404, 410) then 'dead'
  when status between 200 and 399 and (regexp_matches({_title}, {q(alive.DEAD_TITLE)}) or regexp_matches(substring(html, 1, {alive.BODY_CHARS}), {q(alive.DEAD_BODY)})) then 'dead' when status between 200 and 399 then 'live' else 'unknown' end"""
_counts = ", ".join(f"count(*) filter (verdict = '{v}') as {v}" for v in ("live", "dead", "unknown"))
O["liveness"] = f"select page_id, {VERDICT} as verdict from {FETCHED}"
O["liveness_counts"] = f"select tld, {_counts} from (select case when starts_with(url, 'http') then list_last(string_split({host('url')}, '.')) else '' end as tld, {VERDICT} as verdict from {FETCHED}) group by tld"
O["verdict_pivot"] = f"select ats, {_counts} from (select event_type as ats, case when event_type <> 'error' then 'live' when user_id % 2 = 0 then 'dead' else 'unknown' end as verdict from events) group by ats"
_h = lambda u: f"coalesce({host(u)}, '')"
_same_host = lambda h: f"({h} <> '' and ({h} = p.h or ends_with(p.h, '.' || {h}) or ends_with({h}, '.' || p.h)))"
O["detect_company"] = f"""with p as (select page_id, url, {_h('url')} as h, rtrim(lower({path('url')}), '/') as pa from pages),
  c as (select page_id as seq, split_part(h, '.', 1) as name, case when page_id % 2 = 0 then h else '' end as ch, case when page_id % 2 = 0 then pa end as cp, case when page_id % 3 = 0 then {last_two('h')} else '' end as wh, case when page_id % 7 = 0 then lower(split_part(h, '.', 1)) else '' end as hint,
    regexp_replace(lower(split_part(h, '.', 1)), '[^\\p{{L}}\\p{{N}}]', '', 'g') as k from p),
  x as (select p.page_id, p.url, c.seq, c.name, c.ch <> '' and c.ch = p.h and c.cp = p.pa as e, {_same_host('c.ch')} or {_same_host('c.wh')} as ho, c.hint <> '' and contains(p.h, c.hint) as d, length(c.k) >= 4 and contains(p.h, c.k) as n from p, c where p.h <> ''),
  s as (select *, case when e then 100 when ho then 60 when d then 45 when n then 35 else 0 end as score, case when e then 'url' when n then 'name' when d then 'domain' when ho then 'host' end as match_type from x),
  b as (select * from s qualify row_number() over (partition by page_id order by score desc, seq) = 1)
  select page_id, case when score >= 35 then name end as company, case when score >= 35 then match_type else 'host_pattern' end as match_type, case when score >= 35 then score else 10 end as score from b where score >= 35 or {board_by_host(host('url'))} is not null"""
