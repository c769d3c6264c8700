"""JSON arrays in byte ranges against a JSON parser, and snapshots under failing and concurrent writes."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.sources import files, json_arrays, snapshot


def odd_value(rng, depth=0):
    text = lambda: "".join(rng.choice(['"', "\\", "[", "]", "{", "}", ",", " ", "ä", "漢", "\n", "x"]) for _ in range(rng.randint(0, 12)))
    kind = rng.randint(0, 5 if depth < 3 else 2)
    if kind <= 1:
        return text()
    if kind == 2:
        return rng.choice([None, True, 1.5, -3, "\\" * rng.randint(0, 9)])
    if kind == 3:
        return [odd_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {text(): odd_value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


@pytest.mark.parametrize("size", [1, 3, 17, 100, 10**6])
def test_ranges_cut_what_a_parser_reads(spark, tmp_path, size):
    rng = random.Random(size)
    arrays = {f"f{i}.json": [odd_value(rng) for _ in range(rng.randint(0, 14 if size > 3 else 3))] for i in range(4)}
    for i, (name, values) in enumerate(arrays.items()):
        (tmp_path / name).write_text((" \n" if i % 2 else "") + json.dumps(values, ensure_ascii=i % 2 == 0, indent=i if i > 1 else None) + "\n")
    got = json_arrays.elements(spark, f"file://{tmp_path}/*.json", size).orderBy("file_no", "at").collect()
    assert [(r["file_no"], json.loads(r["value"])) for r in got] == [(n, v) for n, values in enumerate(arrays.values()) for v in values]


def test_what_is_no_array_gives_nothing(spark, tmp_path):
    for name, text in {"a": "", "b": " [ ] ", "c": '{"x": [1]}', "d": '[{"x": 1}', "e": '["open]', "f": "[1]"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    for size in (2, 100):
        assert [(r["file_no"], r["value"]) for r in json_arrays.elements(spark, f"{tmp_path}/*.json", size).collect()] == [(5, "1")]
    assert json_arrays.elements(spark, f"{tmp_path}/none*").collect() == []


def test_quotes_behind_backslashes():
    data = np.frombuffer(rb'\"a"\\"\\\"', np.uint8)
    assert json_arrays._quotes(data, 0).tolist() == [3, 6] and json_arrays._quotes(data, 1).tolist() == [1, 3, 6]


def test_entries_of_large_files(spark, tmp_path):
    rows = [{"company_name": f"n{i}", "website": 'https://"x', "more": ["]"]} if i % 7 else {"website": "nameless"} for i in range(3000)]
    (tmp_path / "z" / "x").mkdir(parents=True)
    (tmp_path / "z" / "b.json").write_text(json.dumps(rows))
    (tmp_path / "z" / "x" / "a.json").write_text(json.dumps(rows[:10]))
    got = files.read_entries(spark, f"{tmp_path}/z/*/*.json", 999).unionByName(files.read_entries(spark, f"{tmp_path}/z/b.json", 999)).orderBy("seq")
    assert got.count() == sum(1 for i in range(3000) if i % 7) + sum(1 for i in range(10) if i % 7)
    assert [r["company_name"] for r in files.read_entries(spark, f"{tmp_path}/z/b.json", 999).orderBy("seq").collect()] == [r["company_name"] for r in rows if "company_name" in r]
    assert json_arrays.elements(spark, f"{tmp_path}/z/b.json", 999).rdd.getNumPartitions() > 1


def test_snapshots_replace_each_other_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    rows = lambda n: spark.range(n).select("id", F.struct(F.lit("x").alias("a"), F.array(F.col("id")).alias("b")).alias("s"), F.when(F.col("id") % 2 == 0, F.current_timestamp()).alias("t"))
    snapshot.write_snapshot(rows(10), path)
    early = snapshot.read_snapshot(spark, path)
    snapshot.write_snapshot(rows(30), path)
    assert early.count() == 10 and snapshot.read_snapshot(spark, path).count() == 30 and snapshot.read_snapshot(spark, path, 1).count() == 10
    assert snapshot.read_snapshot(spark, path).where("id = 4").first()["s"]["b"] == [4]
    snapshot.write_snapshot(spark.range(0), path)
    assert snapshot.read_snapshot(spark, path).columns == ["id"] and snapshot.read_snapshot(spark, path).count() == 0
    # Only the last two versions' files are left.
    assert snapshot._versions(path) == [2, 3]


def test_failed_writes_leave_the_old_snapshot(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    snapshot.write_snapshot(spark.range(5), path)
    broken = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        snapshot.write_snapshot(broken, path)
    assert snapshot.manifest(path)["version"] == 1 and snapshot.read_snapshot(spark, path).count() == 5
    snapshot.write_snapshot(spark.range(7), path)
    snapshot.write_snapshot(spark.range(8), path)
    named = {f for v in snapshot._versions(path) for f in snapshot.manifest(path, v)["files"]}
    assert {str(p.relative_to(tmp_path / "snap")) for p in (tmp_path / "snap" / "data").rglob("*.parquet")} == named
    spark.range(8, 10).write.format("snapshot").mode("append").save(path)
    assert sorted(r[0] for r in snapshot.read_snapshot(spark, path).collect()) == list(range(10))


def test_log_lines_are_cut_on_request(spark):
    row = spark.createDataFrame([("x" * 3000,)], "c string")
    assert len(files.log_lines(row, "c").first()[0]) == 1000 and len(files.log_lines(row, "c", most=0).first()[0]) == 3000
