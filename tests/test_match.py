import random

import pytest
from pyspark.sql import functions as F

from heddle.functions import automaton
from heddle.operators import match as m
from heddle.operators import merge, registry, serve
from heddle.profile import Profile

PROFILE = Profile(("security engineer",), ("senior", "lead", "intern"), ("remote", "india", "sea", "latam"), ("remote",))


def accepted(spark, title, location, work_type):
    row = spark.createDataFrame([(title, location, work_type)], "title string, location string, work_type string")
    return list(m.match(row, PROFILE).first()["reasons"])


def test_titles(spark):
    assert accepted(spark, "Senior Security Engineer", "", "remote") == []
    assert accepted(spark, "Lead Security Engineer", "", "remote") == [m.EXCLUDED]
    assert accepted(spark, "Internal Security Engineer", "", "remote") == [m.EXCLUDED]
    assert accepted(spark, "Senior Cook", None, "remote") == [m.NOT_ROLE, m.EXCLUDED]


def test_places(spark):
    t = "Security Engineer"
    assert accepted(spark, t, "US", "remote") == [m.US_ONLY]
    assert accepted(spark, t, "Austin, TX", "remote") == [m.US_ONLY]
    assert accepted(spark, t, "Remote - US or India", "remote") == []
    assert accepted(spark, t, "Seattle", "remote") == []
    assert accepted(spark, t, "Latin America", "remote") == [m.US_ONLY]
    assert accepted(spark, t, "Pune, India", "onsite") == []
    assert accepted(spark, t, "Mars", "full time") == []
    assert accepted(spark, t, "Seattle", "hybrid") == []
    assert accepted(spark, t, "Mars", "") == ["location 'Mars' not in preferred list"]
    assert accepted(spark, t, "", "onsite") == [m.NO_PLACE]


def test_long_lists_agree(spark):
    words = tuple(f"w{i}.*" for i in range(40))
    rows = spark.createDataFrame([("a w7.* b",), ("w7x",), ("",)], "x string")
    assert [r[0] for r in rows.select(m.contains_any(F.col("x"), words)).collect()] == [True, False, False]


def test_search_is_literal(spark):
    jobs = spark.createDataFrame([(1, "a%b", "", 0.0), (2, "ab", "", 0.0), (3, "a\\b_", "", 0.0)], "id long, title string, location string, first_seen double")
    jobs = jobs.withColumns({"company": F.lit("c"), "ats": F.lit("x"), "hidden": F.lit(0), "closed": F.lit(0), "matched": F.lit(1), "applied": F.lit(0)})
    for text, ids in (("%", [1]), ("_", [3]), ("\\", [3]), ("A", [1, 2, 3])):
        assert [r["id"] for r in serve.list_jobs(jobs, serve.JobsFilter(search=text), 0.0).collect()] == ids


def test_merges(spark):
    rows = spark.createDataFrame([("a", 1, "x", ""), ("a", 2, "y", "z"), ("b", 3, None, "w")], "k string, seq int, v string, w string")
    assert [tuple(r) for r in merge.first_per_key(rows, ["k"], ["seq"]).orderBy("k").collect()] == [("a", 1, "x", ""), ("b", 3, None, "w")]
    assert [r["v"] for r in merge.last_per_key(rows, ["k"], ["seq"]).orderBy("k").collect()] == ["y", None]
    assert [tuple(r) for r in merge.fill_missing(rows, ["k"], ["seq"]).orderBy("k").collect()] == [("a", "x", "z"), ("b", None, "w")]
    new = spark.createDataFrame([("b", 9, "n", ""), ("c", 8, "n", ""), ("c", 7, "m", "")], rows.schema)
    assert sorted(tuple(r)[:3] for r in merge.append_absent(rows, new, ["k"], ["seq"]).collect() if r["k"] == "c") == [("c", 7, "m")]
    assert sorted(tuple(r)[:3] for r in merge.overwrite(rows, new, ["k"], ["seq"]).collect()) == [("a", 1, "x"), ("a", 2, "y"), ("b", 9, "n"), ("c", 8, "n")]
    assert [r["turn"] for r in merge.rotating_slice(rows, ["seq"], 2, 2).orderBy("turn").collect()] == [0, 1]
    assert merge.next_cursor(3, 2, 2) == 1 and merge.next_cursor(0, 5, 2) == 0


def test_registry_keeps_what_is_known(spark):
    kind = "norm_key string, name string, website string, career_page_url string, ats_type string, source string, http_status string, reliable int, first_seen double"
    old = spark.createDataFrame([("a", "A", "https://a", "", "lever", "seed", "live", 1, 1.0), ("b", "B", "", "", "unknown", "seed", "none", 0, 1.0)], kind)
    new = spark.createDataFrame([("a", "A2", "", "", "unknown", "n", "dead", 0, 2.0, 1), ("b", "B2", "", "u", "ashby", "n", "live", 1, 2.0, 2), ("c", "", "", "", "unknown", "n", "live", 0, 3.0, 3)], kind + ", seq int")
    full = {r["norm_key"]: r for r in registry.registry_upsert(old, new).collect()}
    assert (full["a"]["name"], full["a"]["website"], full["a"]["ats_type"], full["a"]["http_status"], full["a"]["reliable"]) == ("A2", "https://a", "lever", "dead", 1)
    assert (full["b"]["became_reliable"], full["b"]["source"], full["c"]["is_new"]) == (True, "seed", True)
    light = {r["norm_key"]: r for r in registry.registry_upsert(old, new, recheck=False).collect()}
    assert (light["a"]["name"], light["a"]["http_status"]) == ("A2", "live")


def test_progress_and_boards(spark):
    kind = "norm_key string, name string, ats_type string, career_page_url string, reliable int, http_status string, first_seen double"
    rows = spark.createDataFrame([("1", "acme", "lever", "https://jobs.lever.co/acme", 1, "live", 1.0), ("2", "Acme Inc", "lever", "https://jobs.lever.co/acme/", 1, "dead-404", 2.0), ("3", "x", "lever", "https://jobs.lever.co/123456", 0, None, 3.0), ("4", "y", "custom", "https://otta.com/y", 1, "live", 4.0)], kind)
    assert sorted(r["norm_key"] for r in registry.one_per_board(rows).collect()) == ["2", "3", "4"]
    assert sorted(r["norm_key"] for r in registry.without_junk(rows).collect()) == ["1", "2", "4"]
    assert sorted(r["norm_key"] for r in registry.without_aggregators(rows).collect()) == ["1", "2", "3"]
    assert [r["norm_key"] for r in registry.reliable_boards(rows, "lever").collect()] == ["1"]
    assert tuple(registry.progress(rows, 10).first()) == (4, 3, 30.0, 7)


def test_automaton_finds_all_occurrences(spark):
    words, texts = ("he", "she", "hers", "his", "ÄB", "漢"), ["ushers", "", None, "his ÄB漢漢", "HE"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: (r["h"], [tuple(x) for x in r["s"]], [tuple(x) for x in r["l"]]) for r in df.select("i", automaton.hits(F.col("t"), words).alias("h"), automaton.spans(F.col("t"), words).alias("s"), automaton.spans(F.col("t"), words, False).alias("l")).collect()}
    assert got[0] == ([0, 1, 2], [(1, 1, 4), (0, 2, 4), (2, 2, 6)], [(1, 1, 4)])
    assert got[1] == got[2] == got[4] == ([], [], [])
    assert got[3][0] == [3, 4, 5] and got[3][1] == got[3][2] == [(3, 0, 3), (4, 4, 6), (5, 6, 7), (5, 7, 8)]
    assert df.select(automaton.hits(F.col("t"), ()).alias("h")).first()["h"] == []
    with pytest.raises(ValueError):
        automaton.hits(F.col("t"), ("a", "a"))


def test_match_by_automaton_equals_match(spark):
    rng = random.Random(6)
    some = lambda xs, n: " ".join(rng.choice(xs) for _ in range(n))
    titles, places = ["senior", "tester", "pen", "Lead", "sr.", "intern", "zz"], [*m.US_MARKS[:6], "Berlin", "remote", "Global", ", CA", "us", "india"]
    rows = [(some(titles, rng.randint(0, 4)) or None, some(places, rng.randint(0, 3)) or None, rng.choice(["remote", "hybrid", "onsite", "", None, "other"])) for _ in range(400)]
    df = spark.createDataFrame(rows, "title string, location string, work_type string")
    for profile in (Profile(("tester", "pen", "te"), ("senior", "sr.", "intern"), ("remote", "berlin", "india")), Profile(), Profile(("",), ("intern",), ("global",))):
        assert sorted(map(str, m.match_long(df, profile).collect())) == sorted(map(str, m.match(df, profile).collect()))
