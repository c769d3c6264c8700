"""Bucketed state: what commits write and readers see; and counts by deltas against counting again."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from heddle.operators import deltas as d
from heddle.operators import merge, registry, serve
from heddle.operators import state as s
from heddle.operators import store as st
from heddle.streaming import keyed
from tests.test_state import FRESH, Keyed, as_folded, as_rows, python_tick, random_ticks, ticked

ROW = "k long, v string"


def store(spark, folder, buckets=16, **kinds):
    return st.BucketStore(spark, f"file://{folder}", kinds.get("schema", ROW), kinds.get("by", ("k",)), buckets)


def rows_of(spark, *pairs):
    return spark.createDataFrame([*pairs], ROW)


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_upserts_rewrite_the_touched_buckets_alone(spark, tmp_path):
    held = store(spark, tmp_path / "s")
    assert held.read().count() == 0
    first = held.apply(spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v")), st.upsert("k"))
    assert first == set(range(16)) and held.read().count() == 2000
    before = held.manifest()["files"]
    touched = held.apply(rows_of(spark, (7, "new"), (5000, "added")), st.upsert("k"))
    after = held.manifest()["files"]
    assert len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} == {str(b) for b in touched}
    got = dict(content(held.read()))
    assert len(got) == 2001 and got[7] == "new" and got[5000] == "added" and got[8] == "old"
    # An old version can still be read, until it is cleared away.
    assert held.read(1).where("k = 7").first()["v"] == "old"
    gone = held.vacuum(keep=1)
    assert gone == len(touched & {int(b) for b in before}) and held.versions() == [2] and held.read().count() == 2001


def test_batches_count_once(spark, tmp_path):
    held = store(spark, tmp_path / "s", schema="k long, n long")
    more = spark.createDataFrame([(1, 5), (2, 1)], "k long, n long")
    assert held.apply(more, d.add, batch=0) and held.apply(more, d.add, batch=0) is None and held.apply(more, d.add, batch=1)
    assert content(held.read()) == [(1, 10), (2, 2)]
    assert held.apply(more.withColumn("n", -2 * F.col("n")), d.add, batch=2) and content(held.read()) == []


def test_readers_see_the_old_state_or_the_new(spark, tmp_path):
    held = store(spark, tmp_path / "s")
    held.apply(rows_of(spark, (1, "a"), (2, "a")), st.upsert("k"))
    seen = []

    def slow(rows, changes):
        seen.append(content(held.read()))  # while a commit is under way
        return st.upsert("k")(rows, changes)

    open_before = held.read()
    held.apply(rows_of(spark, (1, "b")), slow)
    assert seen == [[(1, "a"), (2, "a")]] and content(open_before) == [(1, "a"), (2, "a")] and content(held.read()) == [(1, "b"), (2, "a")]


def test_a_failed_batch_and_a_lost_race_leave_no_trace(spark, tmp_path):
    held = store(spark, tmp_path / "s")
    held.apply(rows_of(spark, (1, "a")), st.upsert("k"))

    def broken(rows, changes):
        return changes.withColumn("v", F.raise_error(F.lit("no")).cast("string"))

    with pytest.raises(Exception, match="no"):
        held.apply(rows_of(spark, (1, "b")), broken)
    assert content(held.read()) == [(1, "a")] and held.versions() == [1]

    def raced(rows, changes):
        held.apply(rows_of(spark, (9, "first")), st.upsert("k"))
        return st.upsert("k")(rows, changes)

    with pytest.raises(st.Conflict):
        held.apply(rows_of(spark, (1, "second")), raced)
    assert content(held.read()) == [(1, "a"), (9, "first")]
    # What the failed commits wrote goes with the next clearing once their version has passed.
    held.apply(rows_of(spark, (3, "c")), st.upsert("k"))
    assert held.vacuum(keep=1) >= 1 and content(held.read()) == [(1, "a"), (3, "c"), (9, "first")]


def test_a_tick_as_a_merge_touches_its_boards_alone(spark, tmp_path):
    """``tick`` looks at whole boards, so buckets are of boards; boards without fresh rows are left as they are."""
    held = store(spark, tmp_path / "s", buckets=64, schema=s.STATE, by=("company", "ats"))
    ledger, rows = spark.createDataFrame([("a", "lever", "1")], "company string, ats string, job_id string"), {}
    for now, fresh in random_ticks(21, 4):
        python_tick(rows, fresh, {("a", "lever", "1")}, now)
        touched = held.apply(spark.createDataFrame(fresh, FRESH), lambda old, new, now=now: s.tick(old, new, ledger, now).drop("is_new"))
        assert len(touched) <= len({f[:2] for f in fresh})
    assert as_rows(held.read().collect()) == as_folded(rows)


def test_other_merges(spark, tmp_path):
    held = store(spark, tmp_path / "s", schema="k long, source string, v string", by=("source",))
    of = lambda *rows: spark.createDataFrame([*rows], "k long, source string, v string")
    held.apply(of((1, "a", "x"), (2, "a", "x"), (1, "b", "x")), st.insert_absent("k", "source"))
    held.apply(of((1, "a", "y"), (3, "a", "y")), st.insert_absent("k", "source"))
    assert content(held.read()) == [(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (3, "a", "y")]
    held.apply(of((7, "a", "z")), lambda old, new: merge.replace_source(old, new, "source", "a"))
    assert content(held.read()) == [(1, "b", "x"), (7, "a", "z")]
    held.rewrite(lambda old: old.where("source <> 'a'"))
    assert content(held.read()) == [(1, "b", "x")]


def counts_of(cells):
    return sorted((tuple(r) for r in cells.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_deltas_equal_recounting_over_any_ticks(spark, tmp_path, seed):
    state, cells = spark.createDataFrame([], s.STATE), store(spark, tmp_path / "c", schema=d.POSTING_CELLS, by=("ats", "first_seen"))
    ledger = spark.createDataFrame([("a", "lever", "1")], "company string, ats string, job_id string")
    for now, fresh in random_ticks(seed, 4):
        now *= 50_000.0
        new = s.tick(state, spark.createDataFrame(fresh, FRESH), ledger, now).drop("is_new")
        if now == 100_000.0:  # some rows go, some are hidden
            new = s.raise_flag(s.purge(new, ("lever",)), new.where("job_id = '2'").select(*s.KEY), "hidden").drop("touched")
        new = spark.createDataFrame(new.collect(), s.STATE)
        changed = d.state_changes(state, new, s.KEY)
        moved = d.signed(changed, d.POSTING_CELL, {c: F.col(c) for c in d.POSTING_CELL}, {c: F.col(c if c == "ats" else f"was_{c}") for c in d.POSTING_CELL}, ~F.col("is_new"), ~F.col("gone"))
        cells.apply(moved, d.add)
        state = new
        assert counts_of(cells.read().select(*d.POSTING_CELL, "n")) == counts_of(d.recount(state).select(*d.POSTING_CELL, "n"))
        for as_of in (now, now + 40_000.0, now + 90_000.0):
            assert d.tiles(cells.read(), as_of).collect() == serve.tiles(state, as_of).collect()
        assert counts_of(d.open_by_source(cells.read())) == counts_of(serve.open_by_source(state))
    old = d.settle(cells.read(), 150_000.0)
    assert old.count() < cells.read().count() and d.tiles(old, 230_000.0).collect() == serve.tiles(state, 230_000.0).collect()


def test_ledger_and_registry_by_deltas(spark):
    kind = "company string, mode string, status string"
    ledger = spark.createDataFrame([("a", "manual", "submitted"), ("b", "auto", "failed"), ("c", "auto", "failed")], kind)
    cells = d.add(spark.createDataFrame([], d.LEDGER_CELLS), d.ledger_deltas(ledger))
    after = spark.createDataFrame([("a", "manual", "submitted"), ("b", "auto", "submitted"), ("c", "auto", "failed"), ("d", None, "x")], kind)
    cells = d.add(cells, d.ledger_deltas(after.where("company in ('b', 'd')"), ledger.where("company = 'b'")))
    assert counts_of(d.ledger_counts(cells)) == counts_of(serve.ledger_counts(after))
    rng, have = random.Random(4), None
    columns = "norm_key string, name string, website string, career_page_url string, ats_type string, source string, http_status string, reliable int, first_seen double"
    reg, cells = spark.createDataFrame([], columns), spark.createDataFrame([], d.REGISTRY_CELLS)
    for t in range(3):
        batch = spark.createDataFrame([(f"k{rng.randrange(30)}", "n", "", "", "lever", "s", "200", rng.randint(0, 1), float(t), i) for i in range(25)], columns + ", seq int")
        done = registry.registry_upsert(reg, batch)
        cells = spark.createDataFrame(d.add(cells, d.registry_deltas(done)).collect(), d.REGISTRY_CELLS)
        reg = spark.createDataFrame(done.drop("is_new", "became_reliable").collect(), columns)
        have = d.progress(cells, 50).first().asDict()
        assert {k: float(v) for k, v in have.items()} == {k: float(v) for k, v in registry.progress(reg, 50).first().asDict().items()}


def test_stream_into_stored_state_and_counts(spark, tmp_path):
    """Keyed state to changes, changes to buckets and cells; a batch that runs again counts once."""
    state = store(spark, tmp_path / "s", schema=s.STATE, by=tuple(s.KEY), buckets=8)
    cells = store(spark, tmp_path / "c", schema=d.POSTING_CELLS, by=("ats", "first_seen"), buckets=4)
    stream, rows = Keyed(spark, tmp_path / "q"), {}
    for now, fresh in random_ticks(31, 3):
        python_tick(rows, fresh, set(), now)
        stream.add(ticked(spark, fresh, now))
    sink = d.sink(state, cells, s.KEY)

    def twice(batch, number):
        sink(batch, number)
        sink(batch, number)

    events = spark.readStream.schema(keyed.EVENT).option("maxFilesPerTrigger", 1).parquet(stream.source)
    keyed.changes(events, lanes=3).writeStream.outputMode("update").foreachBatch(twice).option("checkpointLocation", stream.check).trigger(availableNow=True).start().awaitTermination(200)
    assert as_rows(state.read().collect()) == as_folded(rows) and state.manifest()["batch"] == 2
    assert counts_of(cells.read().select(*d.POSTING_CELL, "n")) == counts_of(d.recount(state.read()).select(*d.POSTING_CELL, "n"))
    assert Path(tmp_path / "s" / "manifests").exists()


def test_registry_upserts_by_buckets(spark, tmp_path):
    """U6 as a merge: the registry after batches in buckets equals the registry after the same batches as a whole."""
    columns = "norm_key string, name string, website string, career_page_url string, ats_type string, source string, http_status string, reliable int, first_seen double"
    held, whole, rng = store(spark, tmp_path / "r", schema=columns, by=("norm_key",)), spark.createDataFrame([], columns), random.Random(8)
    for t in range(3):
        batch = spark.createDataFrame([(f"k{rng.randrange(20)}", f"n{rng.randrange(3)}", rng.choice(["", "w"]), rng.choice(["", "u"]), rng.choice(["unknown", "lever"]), "s", "200", rng.randint(0, 1), float(t), i) for i in range(12)], columns + ", seq int")
        done = registry.registry_upsert(whole, batch).drop("is_new", "became_reliable")
        whole = spark.createDataFrame(done.collect(), columns)
        touched = held.apply(batch, lambda old, new: registry.registry_upsert(old, new).drop("is_new", "became_reliable"), batch=t)
        assert 0 < len(touched) <= 12
    assert sorted(map(str, held.read().select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
