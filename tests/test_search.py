"""The trigram index against scanning, ranks without one task, and needles in hosts against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from heddle.operators import detect, merge, search


def docs(spark, n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcÄß漢😀 ") for _ in range(rng.randint(0, 9)))
    rows = [(i * 97 - 5000, word(), " ".join(word() for _ in range(rng.randint(0, 12))), rng.choice([None, "", "Berlin", "x"])) for i in range(n)]
    return spark.createDataFrame([*rows, (None, "abc", "abc", "abc"), rows[5], (10**12, "aß漢😀" * 3000, None, None)], "id long, company string, title string, location string")


def test_index_finds_what_scanning_finds(spark):
    rows = docs(spark)
    index = search.posting_lists(rows).cache()
    for wanted in ("", "a", "ab", "abc", "ÄSS", "äß漢", "ß漢😀a", "BERLIN", "berlinx", "bc a", "no such text"):
        got = sorted(r["id"] for r in search.search(rows, index, wanted).where("id is not null").collect())
        assert got == sorted(r["id"] for r in rows.where(search.contains_text(wanted)).where("id is not null").collect()), wanted
    assert {r["id"] for r in search.candidates(index, "abc").collect()} >= {r["id"] for r in rows.where(search.contains_text("abc")).where("id is not null").collect()}


def test_written_index_is_read_by_folder_and_gram(spark, tmp_path):
    rows, path = docs(spark), str(tmp_path / "index")
    first, rest = rows.where("id % 2 = 0"), rows.where("id % 2 <> 0")
    search.write_index(search.posting_lists(first), path)
    search.write_index(search.posting_lists(rest), path, "append")
    found = search.search(rows, search.read_index(spark, path), "Berl").where("id is not null")
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in rows.where("location = 'Berlin' and id is not null").collect())
    plan = search.candidates(search.read_index(spark, path), "Berl")._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan and "PushedFilters: [In(gram" in plan
    # A row that changed is found by its new text once that is added, and no longer by its old one.
    changed = rows.withColumn("location", F.when(F.col("id") == -4903, "Hamburg").otherwise(F.col("location")))
    search.write_index(search.posting_lists(changed.where("id = -4903")), path, "append")
    assert [r["id"] for r in search.search(changed, search.read_index(spark, path), "hamburg").collect()] == [-4903]
    assert -4903 not in [r["id"] for r in search.search(changed, search.read_index(spark, path), "berlin").collect()]


def test_lists_are_cut_by_ids(spark):
    rows = spark.range(3 << search.CHUNK_BITS).select("id", F.lit("same").alias("company"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("location"))
    index = search.posting_lists(rows)
    assert index.count() == 2 * 3 and index.agg(F.max(F.size("ids"))).first()[0] == 1 << search.CHUNK_BITS


@pytest.mark.parametrize("parts", [1, 2, 7, 128])
def test_ranks_are_those_of_a_sort(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, "a", "b", "c"]), i, rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(5)
    want = {r[1]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])))}
    assert {r["i"]: r["rank"] for r in merge.ranked(df, ["k", "i"], parts=parts).collect()} == want
    assert {r["i"] for r in merge.ranked(df, ["k", "i"], parts=parts, only=[(10, 20)]).where("rank between 10 and 19").collect()} == {i for i, n in want.items() if 10 <= n < 20}


def test_slices_rotate(spark):
    df = spark.range(50).select(F.col("id").alias("i")).repartition(4)
    of = lambda cursor, size: sorted((r["turn"], r["i"]) for r in merge.rotating_slice(df, ["i"], cursor, size).collect())
    for cursor, size in ((0, 10), (45, 10), (149, 3), (7, 500), (0, 0)):
        assert of(cursor, size) == [(t, (cursor + t) % 50) for t in range(min(size, 50))]
    assert merge.rotating_slice(df.limit(0), ["i"], 3, 5).collect() == []
    plan = merge.rotating_slice(df, ["i"], 45, 10)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_needles_in_hosts(spark):
    rng = random.Random(9)
    text = lambda a, b: "".join(rng.choice("abc.") for _ in range(rng.randint(a, b)))
    hosts, needles = sorted({text(0, 14) for _ in range(150)}), sorted({text(1, 7) for _ in range(200)} | {"zzzz", "abcz"})
    got = {(r["host"], r["needle"]) for r in detect.holding(spark.createDataFrame([(h,) for h in hosts], "host string"), spark.createDataFrame([(n,) for n in needles], "needle string")).collect()}
    assert got == {(h, n) for h in hosts for n in needles if n in h}


def plain_detect(pages, companies):
    """J6 by its rules, pair by pair: url 100, host 60, hint 45, name 35; the first of the best, its last rule."""
    out = {}
    for page, url in pages:
        h, path = url.split("://")[1].partition("/")[::2]
        best = None
        for seq, name, careers, site, hint in companies:
            rules = []
            ch, cp = careers.split("://")[1].partition("/")[::2] if careers else ("", "")
            wh = site.split("://")[1].partition("/")[0] if site else ""
            for home in (ch, wh):
                if home and (h == home or h.endswith("." + home) or home.endswith("." + h)):
                    rules.append((60, 1, "host"))
            if hint and hint in h:
                rules.append((45, 2, "domain"))
            if len(name) >= 4 and name in h:
                rules.append((35, 3, "name"))
            if not rules and not (careers and ch == h and cp.rstrip("/") == path.rstrip("/")):
                continue
            score, rule = (max(r[0] for r in rules), max(rules, key=lambda r: r[1])[2]) if rules else (0, "")
            if careers and ch == h and cp.rstrip("/") == path.rstrip("/"):
                score, rule = 100, "url"
            if best is None or score > best[1]:
                best = (seq, score, rule)
        if best:
            out[page] = best
    return out


def test_detection_as_rules_say(spark):
    rng = random.Random(12)
    label = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(2, 5)))
    hosts = [f"{label()}.{label()}.com" for _ in range(40)]
    pages = [(i, f"https://{rng.choice(hosts)}/{rng.choice(['x', 'y', ''])}") for i in range(120)]
    companies = [(i, label(), rng.choice(["", f"https://{rng.choice(hosts)}/x"]), rng.choice(["", f"https://{rng.choice(hosts).split('.', 1)[1]}"]), rng.choice(["", "", label()])) for i in range(60)]
    c = spark.createDataFrame([(i, n, u, s, h, f"ats{i}") for i, n, u, s, h in companies], "seq long, company_name string, career_page_url string, website string, domain_hint string, board_token string")
    c = c.withColumns({"alternate_career_urls": F.array().cast("array<string>"), "ats_type": F.lit("lever")})
    got = {r["page_id"]: (int(r["board_token"][3:]), r["score"], r["match_type"]) for r in detect.detect(spark.createDataFrame(pages, "page_id long, url string"), c).collect()}
    assert got == plain_detect(pages, companies)
