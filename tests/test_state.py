"""Ticks against a sequential fold written from the rules."""

import random

from pyspark.sql import functions as F

from heddle.operators import state as s
from heddle.streaming import keyed, ticks

FRESH = "company string, ats string, job_id string, title string, location string, work_type string, url string, posted_at string, matched int, seq int"


def python_tick(rows, fresh, ledger, now, grace=2):
    boards = {(f[0], f[1]) for f in fresh if f[1] in s.COMPLETE}
    seen = {}
    for f in sorted(fresh, key=lambda f: f[9]):
        seen[f[:3]] = f
    for k, f in seen.items():
        r = rows.setdefault(k, {"first": now, "applied": 0, "hidden": 0})
        r.update(title=f[3], matched=f[8], last=now, miss=0, closed=0, closed_at=None, applied=max(r["applied"], int(k in ledger)))
    for k, r in rows.items():
        if k not in seen and k[:2] in boards and not r["applied"]:
            r["miss"] += 1
            if r["miss"] >= grace and not r["closed"]:
                r["closed"], r["closed_at"] = 1, now


def random_ticks(seed, n=6):
    rng = random.Random(seed)
    for t in range(1, n + 1):
        fresh = []
        for c in ("a", "b"):
            for ats in ("lever", "workday"):
                if rng.random() < 0.8:
                    fresh += [(c, ats, str(j), f"t{t}-{j}-{rng.random():.3f}", "", "", "", "", rng.randint(0, 1), rng.randint(0, 10**6)) for j in range(8) if rng.random() < 0.6]
        yield float(t), [*fresh, *fresh[:1]]


def test_ticks_fold_as_rules_say(spark):
    ledger_keys = {("a", "lever", "1"), ("b", "workday", "2")}
    ledger = spark.createDataFrame([(*k,) for k in ledger_keys], "company string, ats string, job_id string")
    rows, state = {}, spark.createDataFrame([], s.STATE)
    for now, fresh in random_ticks(3):
        python_tick(rows, fresh, ledger_keys, now)
        out = s.tick(state, spark.createDataFrame(fresh, FRESH), ledger, now).drop("is_new").collect()
        state = spark.createDataFrame(out, s.STATE)
    got = {(r["company"], r["ats"], r["job_id"]): (r["title"], r["matched"], r["first_seen"], r["last_seen"], r["applied"], r["closed"], r["closed_at"], r["miss_count"]) for r in out}
    assert got == {k: (r["title"], r["matched"], r["first"], r["last"], r["applied"], r["closed"], r["closed_at"], r["miss"]) for k, r in rows.items()}


def test_replays_and_empty_ticks_change_nothing(spark):
    fresh = spark.createDataFrame([("a", "lever", "1", "t", "", "", "", "", 1, 1)], FRESH)
    ledger = spark.createDataFrame([], "company string, ats string, job_id string")
    once = s.tick(spark.createDataFrame([], s.STATE), fresh, ledger, 1.0)
    again = s.tick(once.drop("is_new"), fresh, ledger, 1.0)
    assert once.drop("is_new").collect() == again.drop("is_new").collect() and once.first()["is_new"] and not again.first()["is_new"]
    empty = s.tick(once.drop("is_new"), fresh.limit(0), ledger, 2.0)
    assert empty.drop("is_new").collect() == once.drop("is_new").collect()


def test_flags_only_rise(spark):
    key = "company string, ats string, job_id string"
    state = spark.createDataFrame([("a", "x", "1", 0), ("a", "x", "2", 1)], key + ", applied int")
    out = {r["job_id"]: (r["applied"], r["touched"]) for r in s.raise_flag(state, spark.createDataFrame([("a", "x", "1")] * 2, key), "applied").collect()}
    assert out == {"1": (1, True), "2": (1, False)}


def test_closed_form_equals_the_fold(spark):
    rng = random.Random(5)
    obs = sorted({("lever", rng.randint(0, 9), t) for t in range(1, 9) for _ in range(4)})
    final = s.final_state(spark.createDataFrame(obs, "board string, job int, tick int"), spark.createDataFrame([("lever", 3)], "board string, job int"))
    rows = {}
    for t in sorted({o[2] for o in obs}):
        python_tick(rows, [("c", "lever", str(j), "", "", "", "", "", 1, 1) for _, j, u in obs if u == t], {("c", "lever", "3")}, t)
    want = {(int(k[2]), r["miss"], r["closed"], r["closed_at"]) for k, r in rows.items()}
    assert {(r["job"], r["miss_count"], r["closed"], r["closed_tick"]) for r in final.collect()} == want


def test_stream_of_ticks(spark, tmp_path):
    source, folder = tmp_path / "in", f"file://{tmp_path}/state"
    rows, ledger = {}, spark.createDataFrame([], "company string, ats string, job_id string")
    for now, fresh in random_ticks(9, 3):
        python_tick(rows, fresh, set(), now)
        spark.createDataFrame(fresh, FRESH).withColumn("now", F.lit(now)).coalesce(1).write.mode("append").parquet(str(source))
    kind = spark.read.parquet(str(source)).schema
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source))
    ticks.start(stream, folder, str(tmp_path / "check"), lambda: ledger).awaitTermination(120)
    got = {(r["company"], r["ats"], r["job_id"]): (r["miss_count"], r["closed"]) for r in ticks.current_state(spark, folder).collect()}
    assert got == {k: (r["miss"], r["closed"]) for k, r in rows.items()}


def as_rows(state):
    """State rows as the sequential fold keeps them."""
    return {(r["company"], r["ats"], r["job_id"]): (r["title"], r["matched"], r["first_seen"], r["last_seen"], r["applied"], r["closed"], r["closed_at"], r["miss_count"]) for r in state}


def as_folded(rows):
    return {k: (r["title"], r["matched"], r["first"], r["last"], r["applied"], r["closed"], r["closed_at"], r["miss"]) for k, r in rows.items()}


class Keyed:
    """A stream of events from files, run until it has read all; changes are gathered as they come."""

    def __init__(self, spark, folder, lanes=3, initial=None):
        keyed.use_rocksdb(spark)
        self.spark, self.source, self.check, self.lanes, self.initial = spark, str(folder / "in"), str(folder / "check"), lanes, initial
        self.state, self.batches = {}, []

    def add(self, *events):
        for e in events:
            e.coalesce(1).write.mode("append").parquet(self.source)

    def run(self, files=1):
        stream = self.spark.readStream.schema(keyed.EVENT).option("maxFilesPerTrigger", files).parquet(self.source)

        def sink(batch, n):
            rows = batch.collect()
            self.batches.append(rows)
            self.state.update({(r["company"], r["ats"], r["job_id"]): r for r in rows})

        out = keyed.changes(stream, initial=self.initial, lanes=self.lanes)
        out.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", self.check).trigger(availableNow=True).start().awaitTermination(200)


def ticked(spark, fresh, now, lanes=3):
    return keyed.tick_events(spark.createDataFrame(fresh, FRESH).withColumn("now", F.lit(now)), lanes)


def test_keyed_state_folds_as_rules_say_over_restarts(spark, tmp_path):
    stream, rows, ledger = Keyed(spark, tmp_path), {}, {("a", "lever", "1"), ("b", "workday", "2"), ("a", "lever", "5")}
    stream.add(keyed.flag_events(spark.createDataFrame(sorted(ledger), "company string, ats string, job_id string"), keyed.LEDGER, 0.0, 3))
    for i, (now, fresh) in enumerate(random_ticks(3, 5)):
        python_tick(rows, fresh, ledger, now)
        stream.add(ticked(spark, fresh, now))
        if i in (1, 4):  # a new query each time: the second goes on from the first one's checkpoint
            stream.run()
            assert as_rows(stream.state.values()) == as_folded(rows)
    # Every change says what was before: folding the batches one by one never meets another "before".
    known = {}
    for batch in stream.batches:
        for r in batch:
            k, old = (r["company"], r["ats"], r["job_id"]), known.get((r["company"], r["ats"], r["job_id"]))
            assert r["is_new"] == (old is None) and (r["was_closed"], r["was_applied"], r["was_matched"]) == ((None,) * 3 if old is None else (old["closed"], old["applied"], old["matched"]))
            known[k] = r


def test_many_ticks_in_one_batch_are_the_same(spark, tmp_path):
    stream, rows = Keyed(spark, tmp_path, lanes=1), {}
    for now, fresh in random_ticks(11, 4):
        python_tick(rows, fresh, set(), now)
        stream.add(ticked(spark, fresh, now, 1))
    stream.run(files=100)
    assert as_rows(stream.state.values()) == as_folded(rows) and len([b for b in stream.batches if b]) == 1


def test_split_late_and_flagged_ticks(spark, tmp_path):
    of = lambda *jobs: [("a", "lever", j, f"t{j}", "", "", "", "", 1, i) for i, j in enumerate(jobs)]
    key = spark.createDataFrame([("a", "lever", "1"), ("a", "lever", "9")], "company string, ats string, job_id string")
    stream = Keyed(spark, tmp_path, lanes=1)
    stream.add(ticked(spark, of("1", "2", "3"), 1.0, 1), ticked(spark, of("2"), 2.0, 1))
    stream.run()
    assert {k[2]: r["miss_count"] for k, r in stream.state.items()} == {"1": 1, "2": 0, "3": 1}
    # The same tick again, with another row of it: no second miss. An older one: nothing. Flags: known rows alone.
    stream.add(ticked(spark, of("3"), 2.0, 1), ticked(spark, of("1"), 1.5, 1), keyed.flag_events(key, keyed.HIDDEN, 2.5, 1), keyed.flag_events(key, keyed.APPLIED, 2.5, 1))
    stream.run()
    assert {k[2]: (r["miss_count"], r["hidden"], r["applied"]) for k, r in stream.state.items()} == {"1": (1, 1, 1), "2": (0, 0, 0), "3": (0, 0, 0)}
    stream.add(ticked(spark, of("2"), 3.0, 1), ticked(spark, of("2"), 4.0, 1))
    stream.run()
    assert {k[2]: (r["miss_count"], r["closed"], r["closed_at"]) for k, r in stream.state.items()} == {"1": (1, 0, None), "2": (0, 0, None), "3": (2, 1, 4.0)}


def test_keyed_state_starts_from_stored_state(spark, tmp_path):
    rows, fresh = {}, list(random_ticks(7, 3))
    state, ledger = spark.createDataFrame([], s.STATE), spark.createDataFrame([], "company string, ats string, job_id string")
    for now, f in fresh[:2]:
        python_tick(rows, f, set(), now)
        state = spark.createDataFrame(s.tick(state, spark.createDataFrame(f, FRESH), ledger, now).drop("is_new").collect(), s.STATE)
    stream = Keyed(spark, tmp_path, initial=state)
    stream.state = {(r["company"], r["ats"], r["job_id"]): r for r in state.collect()}
    python_tick(rows, fresh[2][1], set(), fresh[2][0])
    stream.add(ticked(spark, fresh[2][1], fresh[2][0]))
    stream.run()
    assert as_rows(stream.state.values()) == as_folded(rows) and any(not r["is_new"] for b in stream.batches for r in b)
