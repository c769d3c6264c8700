from pyspark.sql import functions as F

from heddle.functions import dates, html, names, urls


def test_name_keys(values):
    given = ["Posit (formerly RStudio)", "Über", "日本", None, "A-1 b"]
    assert values(names.name_key, given) == ["posit", "ber", "", "", "a1b"]
    assert values(names.ascii_key, given) == ["positformerlyrstudio", "ber", "", "", "a1b"]
    assert values(names.unicode_key, given) == ["positformerlyrstudio", "über", "日本", "", "a1b"]


def test_slug_candidates(values):
    given = ["Posit (formerly RStudio)", "Acme Labs", "unit410", "日本"]
    assert values(names.slug_candidates, given) == [["posit", "rstudio"], ["acmelabs", "acme"], ["unit410", "unit"], []]


def test_junk_slugs(values):
    assert values(names.is_junk_slug, ["yyyyy", "123456", "f1sch3rh0m3s", "adyen", "bcdfg1", ""]) == [True, True, True, False, False, False]


def test_display_names(values):
    assert values(names.pretty_name, ["acme-IO_labs"]) == ["Acme IO Labs"]
    assert values(names.humanised_slug, ["m3ter-labs-2", "acme-01234567-89ab-cdef-0123-456789abcdef"]) == ["M3ter Labs", "Acme"]
    assert values(names.company_from_title, ["Acme: Engineer", "Acme | Engineer", "Acme - Engineer", "Engineer", None]) == ["Acme", "Acme", "Acme", "", ""]


def test_hosts(values):
    given = ["https://WWW.Example.com:8080/x", "foo.com/x", "http://localhost/", "http://a b/", None]
    assert values(urls.host, given) == ["www.example.com", None, "localhost", None, None]
    assert values(urls.bare_domain, given) == ["example.com", None, "localhost", None, None]
    assert values(urls.legacy_bare_domain, ["https://www.wework.com", "https://wiz.io", "https://www.wiz.io/x"]) == ["ework.com", "iz.io", "iz.io"]


def test_boards(values):
    given = ["https://boards.greenhouse.io/acme", "https://x.example.com/?u=jobs.lever.co", "https://acme.breezy.hr/", "https://example.com/careers", "https://wellfound.com/c", ""]
    assert values(urls.board_from_url, given) == ["greenhouse", "lever", "breezyhr", None, None, None]
    assert values(urls.board_from_host, given) == ["greenhouse", None, "breezyhr", None, None, None]
    assert values(urls.url_rank, given) == [0, 0, 0, 2, 3, 4]
    assert values(lambda u: urls.board_token(urls.board_from_url(u), F.lit("url"), u), given[:4]) == ["acme", None, "acme", None]
    assert values(lambda u: urls.board_token(urls.board_from_url(u), F.lit("guess"), u), given[:1]) == [None]
    assert values(urls.workable_slug, ["https://acme.workable.com/", "https://apply.workable.com/x"]) == ["acme", ""]
    assert values(urls.is_domain, ["anduril.com", "AI/ML", "fintech"]) == [True, False, False]


def test_dates(values):
    given = ["2026-06-25", "2026-06-25T10:00:00Z", "2026-06-25T10:00:00-04:00", "2026-06-25 junk", "2026", "", "20.07.2026"]
    shown = values(lambda x: F.date_format(dates.posted_ts(x), "yyyy-MM-dd HH:mm"), given)
    assert shown == ["2026-06-25 00:00", "2026-06-25 10:00", "2026-06-25 14:00", "2026-06-25 00:00", None, None, None]
    assert values(dates.iso_from_dotted, ["20.07.2026", "soon", None]) == ["2026-07-20", "soon", ""]
    assert values(dates.iso_from_millis, ["1700000000000", "x", None])[1:] == ["", ""]
    assert [dates.parse_recent(x) for x in ("24h", "7d", "30m", "3", "", "all", None)] == [86400, 604800, 1800, 259200, None, None, None]
    assert [dates.parse_tri(x) for x in ("true", "0", "", None)] == [True, False, None, None]


def test_html(values):
    assert values(html.clean, ["<b>a &amp;  b</b>\n", None]) == ["a & b", ""]
    assert values(html.page_title, ["<title x=1> Hi\n</title>", "none"]) == ["Hi", ""]
    page = 'x window.__appData = {"a": "}{\\"", "b": {"c": [1]}}; more'
    assert html.balanced_json(page, "__appData") == '{"a": "}{\\"", "b": {"c": [1]}}'
    assert html.balanced_json("__appData = {", "__appData") is None and html.balanced_json(None, "x") is None
    assert html.first_key({"x": [{"y": 1}, {"k": 2}], "k": 3}, "k") == 3
    assert html.first_key({"x": [{"y": 1}, {"k": 2}]}, "k") == 2
