from pyspark.sql import functions as F

from heddle.operators import runs, state


def test_runs(spark):
    events = spark.createDataFrame([(1, 1, "running", 0.0, 0, 0, 1), (1, 2, "success", 0.0, 5, 2, 3), (2, 1, "failed", 10.0, 9, 9, 9), (3, 1, "success", 90000.0, 1, None, 1)], "id int, seq int, status string, started_at double, jobs_new int, jobs_matched int, companies_done int")
    now = runs.current_runs(events)
    assert sorted((r["id"], r["status"]) for r in now.collect()) == [(1, "success"), (2, "failed"), (3, "success")]
    assert [tuple(r)[1:] for r in runs.daily_counters(now).orderBy("date").collect()] == [(1, 5, 2, 3), (1, 1, 0, 1)]


def test_scans_keep_true_totals(spark):
    scans = spark.createDataFrame([(i, float(i)) for i in range(5)], "run_id int, started_at double")
    new = spark.createDataFrame([(4, j, f"j{j}") for j in range(7)], "run_id int, seq int, job_id string")
    got = {r["run_id"]: (r["total"], list(r["first_values"] or [])) for r in runs.recent_scans(scans, new, 2, 3).collect()}
    assert got == {4: (7, ["j0", "j1", "j2"]), 3: (0, [])}


def test_saved_flags(spark):
    old = spark.createDataFrame([("c", "a", "1", 1.0)], "company string, ats string, job_id string, applied_at double")
    new = spark.createDataFrame([("c", "a", "1", 2.0), ("c", "a", "2", 3.0)], old.schema)
    assert sorted((r["job_id"], r["applied_at"]) for r in runs.saved_applied(old, new).collect()) == [("1", 2.0), ("2", 3.0)]
    hide = lambda d: d.withColumnRenamed("applied_at", "hidden_at")
    assert sorted((r["job_id"], r["hidden_at"]) for r in runs.saved_hidden(hide(old), hide(new)).collect()) == [("1", 1.0), ("2", 3.0)]


def test_seeds_and_targets(spark):
    flat = spark.createDataFrame([("u", "", None, "T", "L", "accept"), (None, "c", "a", "", "", "")], "url string, company string, ats string, title string, location string, loc_class string")
    rows = runs.flat_seed(flat, 5.0)
    assert [(r["company"], r["ats"], r["job_id"], r["matched"]) for r in rows.collect()] == [("unknown", "unknown", "u", 1)]
    empty = spark.createDataFrame([], state.STATE)
    assert state.insert_absent(state.insert_absent(empty, rows, ["first_seen"]), rows, ["first_seen"]).count() == 1
    companies = spark.createDataFrame([("A", "lever", "guess"), ("B", "unknown", "guess"), ("C", "custom", "guess"), ("D", "unknown", "url")], "company_name string, ats_type string, ats_source string")
    got = sorted((r["company_name"], r["ats"]) for r in runs.probe_targets(companies).collect())
    assert got == [("A", "lever"), ("B", "ashby"), ("B", "greenhouse"), ("B", "lever")]
    kind = "norm_key string, name string, website string, career_page_url string, ats_type string, source string, http_status string, reliable int, first_seen double"
    registry = spark.createDataFrame([("a", "A", "", "", "lever", "x", "live", 1, 1.0)], kind)
    listed = companies.select(F.lower("company_name").alias("norm_key"), "company_name", F.lit("").alias("website"), F.lit(None).cast("string").alias("career_page_url"), "ats_type")
    assert sorted(r["source"] for r in runs.registry_seed(registry, listed).collect()) == ["seed", "seed", "seed", "x"]
    assert runs.board_sample(registry, 1).count() == 1
    assert runs.to_check(spark.createDataFrame([(1, "lever"), (2, "x")], "id int, ats string"), ("lever",)).count() == 1
