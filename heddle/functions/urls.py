"""URLs: hosts, domains, the job board a URL belongs to, and its tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions.names import known, name_key, text, unicode_key

#: Board of a URL by substring, in order; the first that occurs anywhere in the URL wins.
URL_RULES = (
    ("greenhouse", ("boards.greenhouse.io", "job-boards.greenhouse.io")),
    ("lever", ("jobs.lever.co",)),
    ("ashby", ("jobs.ashbyhq.com", "app.ashbyhq.com")),
    ("smartrecruiters", ("jobs.smartrecruiters.com", "careers.smartrecruiters.com")),
    ("workable", ("apply.workable.com",)),
    ("personio", ("jobs.personio.com",)),
    ("bamboohr", (".bamboohr.com", "bamboohr.com/careers")),
    ("trinethire", ("app.trinethire.com",)),
    ("onlyfy", ("onlyfy.jobs",)),
    ("keka", (".keka.com",)),
    ("pinpoint", ("pinpointhq.com",)),
    ("breezyhr", ("breezy.hr",)),
    ("teamtailor", (".teamtailor.com",)),
    ("rippling", ("ats.rippling.com",)),
    ("workday", ("myworkdayjobs.com",)),
    ("yc", ("ycombinator.com/companies/",)),
    ("applytojob", ("applytojob.com",)),
    ("attrax", ("wise.jobs",)),
)
#: Board of a host by pattern, in order.
HOST_RULES = (
    ("greenhouse", r"(?:^|\.)(?:boards|job-boards)\.greenhouse\.io$"),
    ("lever", r"(?:^|\.)jobs\.lever\.co$"),
    ("ashby", r"(?:jobs|app)\.ashbyhq\.com$"),
    ("workable", r"(?:^|\.)apply\.workable\.com$"),
    ("smartrecruiters", r"(?:careers|jobs)\.smartrecruiters\.com$"),
    ("personio", r"\.jobs\.personio\.com$"),
    ("rippling", r"(?:^|\.)ats\.rippling\.com$"),
    ("teamtailor", r"\.careers\.teamtailor\.com$"),
    ("breezyhr", r"\.breezy\.hr$"),
    ("onlyfy", r"\.onlyfy\.jobs$"),
    ("mailto", r"\.(?:mailto|mail-to)\.jobs$"),
    ("workday", r"\.myworkdayjobs\.com$"),
    ("bamboohr", r"(?:^|\.)bamboohr\.com$"),
    ("careerspage", r"(?:^|\.)careers-page\.com$"),
    ("recruitee", r"(?:^|\.)(?:recruitee|careers\.recruitee)\.com$"),
    ("comeet", r"(?:^|\.)comeet\.(?:com|co)$"),
    ("jobvite", r"(?:^|\.)jobvite\.com$"),
    ("jazzhr", r"(?:^|\.)(?:resumator|jazz)\.(?:com|co)$"),
    ("pinpoint", r"(?:^|\.)pinpointhq\.com$"),
    ("trinethire", r"(?:^|\.)trinethire\.com$"),
    ("keka", r"\.keka\.com$"),
    ("applytojob", r"(?:^|\.)applytojob\.com$"),
    ("cats", r"(?:^|\.)catsone\.com$"),
    ("hireology", r"(?:^|\.)hireology\.com$"),
    ("niceboard", r"(?:^|\.)niceboard\.(?:com|co)$"),
    ("freshteam", r"(?:^|\.)freshteam\.com$"),
    ("attrax", r"\.jobs$"),
)
#: Boards whose token is the host's first label, and those whose token is the first path segment.
SUBDOMAIN_BOARDS = ("teamtailor", "personio", "breezyhr", "onlyfy")
PATH_BOARDS = ("greenhouse", "lever", "ashby", "smartrecruiters", "workable", "rippling")
#: Parts of a path that mark a careers page, and profile sites.
CAREER_PARTS = ("career", "jobs", "join", "hiring", "vacanc")
PROFILE_SITES = ("wellfound.com", "startup.jobs", "rubyonremote")


def any_of(c: Column, parts) -> Column:
    """Whether any of the literals occurs in a column."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def host(url: Column) -> Column:
    """The lower-case host without port; null for what is no URL with a host."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _last_two(h: Column) -> Column:
    parts = F.split(h, "[.]")
    return F.when(F.size(parts) < 2, h).otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "."))


def bare_domain(url: Column) -> Column:
    """The last two labels of a URL's host; no list of public suffixes."""
    return _last_two(host(url))


def legacy_host(url: Column) -> Column:
    """The older rule: host and port, lower case, without any of the letter w and full stops in front."""
    place = F.regexp_extract(text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(place), r"^[w.]+", "")


def legacy_bare_domain(url: Column) -> Column:
    return _last_two(legacy_host(url))


def domain_without_www(url: Column) -> Column:
    """The host with ``www.`` taken out wherever it stands."""
    return F.replace(text(host(url)), F.lit("www."), F.lit(""))


def board_from_url(url: Column) -> Column:
    """The board whose marks occur in a URL, by :data:`URL_RULES`; null if none does."""
    rules = F.array(*(F.struct(F.lit(m).alias("mark"), F.lit(board).alias("board")) for board, marks in URL_RULES for m in marks))

    def first(u: Column) -> Column:
        return F.get(F.filter(rules, lambda r: F.contains(u, r["mark"])), 0)["board"]

    # The lambda keeps the URL's own expression, and the rules, at one place of the plan.
    return F.get(F.transform(F.array(F.lower(text(url))), first), 0)


def board_from_host(url: Column) -> Column:
    """The board that a URL's host belongs to, by :data:`HOST_RULES`; null if none."""
    h, out = text(host(url)), F.lit(None).cast("string")
    for board, pattern in reversed(HOST_RULES):
        out = F.when(h.rlike(pattern), F.lit(board)).otherwise(out)
    return out


def first_segment(url: Column) -> Column:
    """The first path segment of an http URL, up to the first character that no slug has; "" if none."""
    return F.regexp_extract(text(url), r"https?://[^/]+/([A-Za-z0-9_\-]+)", 1)


def first_label(url: Column) -> Column:
    """The first label of a host with three or more; "" else."""
    parts = F.split(text(host(url)), "[.]")
    return F.when(F.size(parts) >= 3, parts[0]).otherwise(F.lit(""))


def board_token(board: Column, source: Column, url: Column) -> Column:
    """A board's token in a URL, where the URL itself names the board; null else."""
    sure = source.isin("url", "verified")
    return (
        F.when(sure & board.isin(*SUBDOMAIN_BOARDS), known(first_label(url)))
        .when(sure & board.isin(*PATH_BOARDS), known(first_segment(url)))
        .when((board == "mailto") | (sure & (board == "workday")), url)
    )


#: Where a board's URL, in lower case, holds the company's slug.
SLUG_PATTERNS = (
    ("greenhouse", r"greenhouse\.io/([^/?#]+)"),
    ("lever", r"jobs\.lever\.co/([^/?#]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([^/?#]+)"),
    ("workable", r"apply\.workable\.com/([^/?#]+)"),
    ("smartrecruiters", r"(?:jobs|careers)\.smartrecruiters\.com/([^/?#]+)"),
    ("rippling", r"ats\.rippling\.com/([^/?#]+)"),
    ("teamtailor", r"https?://([^./]+)\.teamtailor\.com"),
    ("personio", r"https?://([^./]+)\.jobs\.personio\.com"),
    ("breezyhr", r"https?://([^./]+)\.breezy\.hr"),
    ("bamboohr", r"https?://([^./]+)\.bamboohr\.com"),
    ("pinpoint", r"https?://([^./]+)\.pinpointhq\.com"),
    ("workday", r"https?://([^./]+)\.wd"),
)


def registry_slug(board: Column, url: Column) -> Column:
    """The slug by :data:`SLUG_PATTERNS`; null where the URL has none."""
    patterns = F.create_map(*(F.lit(x) for pair in SLUG_PATTERNS for x in pair))
    return known(F.call_function("regexp_extract", F.regexp_replace(F.lower(text(url)), "/+$", ""), F.element_at(patterns, board), F.lit(1)))


def board_slug(board: Column, url: Column) -> Column:
    """The slug in a board's URL, by the board's kind; "" if none."""
    return F.when(board.isin(*SUBDOMAIN_BOARDS), first_label(url)).otherwise(first_segment(url))


def board_root(board: Column, url: Column) -> Column:
    """A board's canonical address: scheme and host, and the slug where it is a path; no query."""
    root = F.concat(F.lit("https://"), text(host(url)))
    return F.when(board.isin(*PATH_BOARDS) & (first_segment(url) != ""), F.concat(root, F.lit("/"), first_segment(url))).otherwise(root)


def url_rank(url: Column, board: Column | None = None) -> Column:
    """How good a careers URL is: 0 a board, 1 a directory, 2 a careers page, 3 a profile site, 4 anything else.

    ``board`` is the URL's board where it is known already.
    """
    board = board_from_url(url) if board is None else board
    path = F.lower(text(F.try_parse_url(url, F.lit("PATH"))))
    return F.when(board == "yc", 1).when(board.isNotNull(), 0).when(any_of(path, CAREER_PARTS), 2).when(any_of(text(url), PROFILE_SITES), 3).otherwise(4)


def domain_key(website: Column, url: Column, name: Column) -> Column:
    """The first bare domain of website and URL, else the name's key."""
    return F.coalesce(known(legacy_bare_domain(website)), known(legacy_bare_domain(url)), name_key(name))


def company_key(name: Column, website: Column, url: Column) -> Column:
    """What groups a company's entries: its name's key, or its domain where the name has none."""
    return F.coalesce(known(name_key(name)), domain_key(website, url, name))


def workable_slug(url: Column) -> Column:
    """The first label of a ``workable.com`` address below the shared hosts; "" else."""
    h = text(host(url))
    return F.when(F.endswith(h, F.lit(".workable.com")) & (h != "apply.workable.com"), F.substring_index(h, ".", 1)).otherwise(F.lit(""))


def query_token(board: Column, name: Column, url: Column, token: Column) -> Column:
    """The token used at query time: some boards derive it from the name or take the whole URL."""
    return F.when(board == "smartrecruiters", known(unicode_key(name))).when(board == "workday", F.coalesce(known(url), known(token))).otherwise(known(token))


def is_domain(value: Column) -> Column:
    return F.lower(F.trim(text(value))).rlike(r"^[a-z0-9][a-z0-9.-]*\.[a-z]{2,}$")
