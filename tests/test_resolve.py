import json

from pyspark.sql import functions as F

from heddle.operators import detect, liveness, resolve
from heddle.sources import files


def entries(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], resolve.RAW)


def by_name(df):
    return {r["company_name"]: r for r in df.collect()}


def test_labels_and_conflicts(spark):
    rows = [("Acme", "", "https://acme.com", "", "lever", "s1"), ("Acme", "https://acme.com/careers", "", "", "Greenhouse", "s2"), ("ACME (US)", "", "", "", "lever", "s1")]
    got = by_name(resolve.merge_entries(entries(spark, rows)))["Acme"]
    # Labels are distinct before they are counted, so the first by name wins.
    assert (got["ats_type"], got["ats_source"], got["ats_conflict"], list(got["source_platforms"])) == ("greenhouse", "guess", True, ["s1", "s2"])
    assert got["board_token"] is None and got["career_page_url"] == "https://acme.com/careers"


def test_overrides_lose_the_best_alternate(spark):
    rows = [("Stripe", u, "", "", "", "s") for u in ("https://boards.greenhouse.io/aaa", "https://boards.greenhouse.io/stripe")]
    got = by_name(resolve.merge_entries(entries(spark, rows)))["Stripe"]
    assert got["ats_source"] == "verified" and got["is_mnc_flagged"]
    assert list(got["alternate_career_urls"]) == ["https://boards.greenhouse.io/stripe"] and got["career_page_url"] == "https://boards.greenhouse.io/stripe"


def test_discovered_boards(spark):
    found = spark.createDataFrame([("Foo", "ashby", "https://jobs.ashbyhq.com/old", "old", 1), ("foo", "ashby", "https://jobs.ashbyhq.com/foo", "foo", 2)], "company_name string, ats string, career_page_url string, slug string, seq int")
    got = by_name(resolve.merge_entries(entries(spark, [("Foo", "", "", "", "", "s")]), found))["Foo"]
    assert (got["board_token"], got["ats_source"]) == ("foo", "discovered")


def test_names_without_a_key_group_by_domain(spark):
    got = resolve.merge_entries(entries(spark, [("日本", "", "https://nihon.jp", "", "", "s"), ("東京", "", "https://nihon.jp/x", "", "", "s")]))
    assert got.count() == 1


def test_board_collisions(spark):
    u, d = "https://jobs.lever.co/perforce", "https://boards.greenhouse.io/national"
    rows = [("Perforce Software", u, "https://perforce.com", "", "", "s"), ("Puppet", u, "https://perforce.com/p", "", "", "s"), ("OpenLogic", u, "https://other.org", "", "", "s"), ("National A", d, "", "", "", "s"), ("National B", d + "/", "", "", "", "s"), ("Alone", "https://jobs.lever.co/alone", "", "", "", "s")]
    got = by_name(resolve.settle_boards(resolve.merge_entries(entries(spark, rows))))
    assert "Perforce Software" not in got and got["Puppet"]["board_token"] == "perforce"
    assert (got["OpenLogic"]["ats_type"], got["OpenLogic"]["career_page_url"]) == ("unknown", "https://other.org")
    assert got["National A"]["ats_type"] == got["National B"]["ats_type"] == "unknown" and got["Alone"]["ats_type"] == "lever"


def test_files(spark, tmp_path):
    for name, data in (("b.json", [{"company_name": "B", "extra": 1}]), ("a.json", [{"company_name": "A1", "career_page_url": None}, {"company_name": "A2"}])):
        (tmp_path / name).write_text(json.dumps(data))
    got = files.read_entries(spark, f"{tmp_path}/*.json").orderBy("seq").collect()
    assert [r["company_name"] for r in got] == ["A1", "A2", "B"]
    companies = resolve.consolidate(entries(spark, [("Acme", "https://jobs.lever.co/acme", "", "", "", "s1"), ("Acme", "", "", "", "", "s2")]))
    files.write_csv(companies, f"{tmp_path}/csv")
    row = spark.read.option("header", True).csv(f"{tmp_path}/csv").first()
    assert (row["source_platforms"], row["ats_conflict"], row["board_token"]) == ("s1|s2", "False", "acme")
    files.write_by_source(companies, f"{tmp_path}/by")
    files.write_summary(companies, f"{tmp_path}/sum")
    assert spark.read.json(f"{tmp_path}/by/ats_type=lever").count() == 1 and spark.read.json(f"{tmp_path}/sum").first()["automatable_count"] == 1
    for n in (1, 2):
        files.write_snapshot(spark.range(n), f"file://{tmp_path}/snap")
    assert spark.read.parquet(f"{tmp_path}/snap").count() == 2
    assert files.log_lines(spark.createDataFrame([("a|b", None)], "x string, y string"), "x", "y").first()[0] == "a/b | "


def test_liveness(values):
    page = lambda status: lambda h: liveness.verdict(F.lit("https://x"), F.lit(status), h)
    late = "x" * 32768 + "page not found"
    assert values(page(200), ["<title>404</title>", late, "page not found", None]) == ["dead", "live", "dead", "live"]
    assert values(page(404), ["x"]) == ["dead"] and values(page(403), ["x"]) == ["unknown"]
    assert values(lambda u: liveness.verdict(u, F.lit(200), F.lit("")), ["mailto:x", None]) == ["dead", "dead"]
    assert values(lambda e: liveness.probe_verdict(F.lit(0), e), [None, "Not Found", "timeout"]) == ["live", "dead", "unknown"]


def test_detection(spark):
    pages = spark.createDataFrame([(1, "https://acme.com/jobs/"), (2, "https://careers.acme.com/x"), (3, "https://hintco.org"), (4, "https://mybigname.net"), (5, "https://x.recruitee.com"), (6, "https://nothing.dev"), (7, "nope")], "page_id int, url string")
    kind = "seq int, company_name string, career_page_url string, alternate_career_urls array<string>, website string, domain_hint string, ats_type string, board_token string"
    companies = spark.createDataFrame([(1, "Late", "http://acme.com/jobs", [], "", "", "a", "t"), (0, "Acme", "", [], "https://acme.com", "", "b", "t"), (2, "Hint", "", [], "", "hintco", "c", "t"), (3, "Big Name", "", [], "", "", "d", "t")], kind)
    got = {r["page_id"]: (r["company"], r["match_type"], r["score"]) for r in detect.detect(pages, companies).collect()}
    assert got == {1: ("Late", "url", 100), 2: ("Acme", "name", 60), 3: ("Hint", "name", 45), 4: ("Big Name", "name", 35), 5: (None, "host_pattern", 10)}
