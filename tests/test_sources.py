import json

from heddle.sources import collectors, parsers
from heddle.sources.reader import BoardSource


def parsed(spark, ats, payload):
    rows = spark.createDataFrame([("Acme", ats, "tok", payload if isinstance(payload, str) else json.dumps(payload))], "company string, ats string, token string, payload string")
    return [r.asDict() for r in parsers.PARSERS[ats](rows).collect()]


def test_greenhouse(spark):
    job = {"id": 7, "title": "T", "absolute_url": "u", "location": {"name": "L"}, "departments": [{"name": "A"}, {"name": "B"}], "metadata": [{"name": "x", "value": ["remote"]}, {"name": "Kind", "value": "Hybrid"}, {"name": "Remote?", "value": None}], "first_published": "2026-01-01"}
    got = parsed(spark, "greenhouse", {"jobs": [job, {"id": 8, "location": "text", "departments": []}]})
    assert (got[0]["job_id"], got[0]["location"], got[0]["department"], got[0]["work_type"], got[0]["posted_at"]) == ("7", "L", "A / B", "hybrid", "2026-01-01")
    assert (got[1]["location"], got[1]["work_type"]) == ("", "")


def test_lever_and_rippling(spark):
    got = parsed(spark, "lever", [{"id": "1", "text": "T", "categories": {"location": "L", "team": "D"}, "applyUrl": "", "hostedUrl": "h", "workplaceType": "Remote", "createdAt": 1700000000000}])
    assert (got[0]["url"], got[0]["location"], got[0]["work_type"], got[0]["posted_at"][:10]) == ("h", "L", "remote", "2023-11-14")
    assert parsed(spark, "lever", {"error": 1}) == []
    got = parsed(spark, "rippling", [{"id": "9", "name": "T", "workLocation": {"label": "L"}, "department": "D"}])
    assert (got[0]["location"], got[0]["department"], got[0]["url"]) == ("L", "D", "https://ats.rippling.com/tok/jobs/9/apply?step=application")


def test_ashby(spark):
    page = 'x<script>window.__appData = {"a":"}","jobBoard":{"jobPostings":[{"id":"p1","title":"T","locationName":"","locationExternalName":"E","isListed":true},{"id":"p2","isListed":false},{"id":"p3"}]}};</script>'
    got = parsed(spark, "ashby", page)
    assert [(r["job_id"], r["location"], r["url"]) for r in got] == [("p1", "E", "https://jobs.ashbyhq.com/tok/p1"), ("p3", "", "https://jobs.ashbyhq.com/tok/p3")]


def test_workable_smartrecruiters_workday(spark):
    got = parsed(spark, "workable", {"results": [{"id": 5, "shortcode": "S", "title": "T", "location": {"city": "C", "country": "X"}, "department": ["A", "B"], "remote": True}]})
    assert (got[0]["job_id"], got[0]["location"], got[0]["department"], got[0]["work_type"]) == ("S", "C, X", "A / B", "remote")
    got = parsed(spark, "smartrecruiters", {"content": [{"id": "1", "name": "T", "location": {"city": "C", "remote": False}, "department": {"label": "D"}}]})
    assert (got[0]["location"], got[0]["work_type"], got[0]["department"]) == ("C", "onsite", "D")
    got = parsed(spark, "workday", {"jobPostings": [{"title": "T", "externalPath": "/job/1", "bulletFields": ["R1"], "locationsText": "Remote, X"}, {"title": "U", "externalPath": "/job/2"}]})
    assert [(r["job_id"], r["work_type"]) for r in got] == [("R1", "remote"), ("/job/2", "")]


def test_xml_boards(spark):
    got = parsed(spark, "personio", "<workzag-jobs><position><id>3</id><name> T </name><office>O</office></position><position><id>4</id></position></workzag-jobs>")
    assert [(r["job_id"], r["title"], r["location"]) for r in got] == [("3", "T", "O"), ("4", "", "")]
    rss = '<rss><channel><item><title>T</title><link>https://x.teamtailor.com/jobs/12-a?b=1</link><description>&lt;span class="location"&gt;&lt;b&gt;L&lt;/b&gt;&lt;/span&gt;</description></item></channel></rss>'
    assert [(r["job_id"], r["location"]) for r in parsed(spark, "teamtailor", rss)] == [("12-a", "L")]


def test_html_boards(spark):
    card = '<a href="/p/abc123-x" class="c"><h2>A &amp; B</h2><li class="location"><i></i><span>%LABEL_MULTIPLE_LOCATIONS%</span></li><li class="type"><span>%LABEL_POSITION_TYPE_FULL_TIME%</span></li></a>'
    got = parsed(spark, "breezyhr", card + card + '<a href="/p/def-y">Apply</a>')
    assert [(r["job_id"], r["title"], r["location"], r["work_type"]) for r in got] == [("abc123", "A & B", "Multiple locations", "full time")]
    card = '<a data-testid="job-card" href="/en/job/Xy1" aria-label="L &amp; M"><div data-testid="job-more-info">Berlin | Remote | 20.07.2026 | Eng</div></a>'
    got = parsed(spark, "onlyfy", card)
    assert [(r["title"], r["location"], r["work_type"], r["posted_at"], r["department"]) for r in got] == [("L & M", "Berlin", "Remote", "2026-07-20", "Eng")]
    got = parsed(spark, "mailto", '<a href="mailto:a@b.c?subject=Application%20%E2%80%94%20Red%20Teamer&amp;body=x"><a href="mailto:a@b.c?subject=red%20teamer"><a href="mailto:a@b.c">')
    assert [(r["job_id"], r["title"], r["work_type"]) for r in got] == [("red-teamer", "Red Teamer", "remote")]


def test_reader_with_a_transport_of_its_own(spark):
    spark.dataSource.register(BoardSource)
    boards = [{"company": "A", "ats": "lever", "token": "a"}, {"company": "B", "ats": "workday", "token": "https://b.com/short"}, {"company": "C", "ats": "lever", "token": "bad"}]
    got = spark.read.format("boards").options(boards=json.dumps(boards), transport="tests.transport.fetch", wait="0").load().collect()
    assert sorted((r["company"], r["page_offset"]) for r in got) == [("A", 0), ("B", 0), ("B", 20), ("B", 40), ("C", 0)]
    assert [r["error"].endswith("OSError: no such board") for r in got if r["company"] == "C"] == [True]


def test_collectors(spark):
    lines = spark.createDataFrame([(1, "| [Acme](https://acme.workable.com/) | x"), (2, "* [Foo](https://foo.com/careers) and [Acme](https://acme.com)"), (3, "no link")], "seq long, value string")
    assert [(r["company_name"], r["career_page_url"]) for r in collectors.markdown_table(lines).collect()] == [("Acme", "https://apply.workable.com/acme")]
    assert sorted((r["company_name"], r["website"] or r["career_page_url"]) for r in collectors.markdown_links(lines).collect()) == [("Acme", "https://acme.workable.com/"), ("Foo", "https://foo.com/careers")]
    pages = spark.createDataFrame([(1, "<tr><td><a>Initech</a> (US)</td></tr><li>Hooli [1]</li><li>2020 in</li>")], "seq long, payload string")
    assert sorted(r["company_name"] for r in collectors.wiki_names(pages).collect()) == ["Hooli", "Initech"]
    seeds = spark.createDataFrame([(1, "Acme", "https://acme.com/")], "seq long, company_name string, website string")
    assert sorted(r["career_page_url"] for r in collectors.curated(seeds).collect()) == ["https://acme.com/careers", "https://acme.com/jobs"]
    feed = spark.createDataFrame([(1, None, "Acme: Engineer", "https://x.com"), (2, "acme", "", "https://jobs.lever.co/acme")], "seq long, company string, title string, url string")
    assert [(r["company_name"], r["career_page_url"]) for r in collectors.remote_feed(feed, "f").collect()] == [("Acme", "https://jobs.lever.co/acme")]
    listed = spark.createDataFrame([(1, "Acme", "https://x.com", True), (2, "ACME", "https://jobs.lever.co/acme?x=1", True), (3, "Gone", "", False)], "seq long, company_name string, url string, active boolean")
    assert [(r["company_name"], r["career_page_url"], r["ats_type"]) for r in collectors.listings_json(listed).collect()] == [("Acme", "https://jobs.lever.co/acme", "lever")]
