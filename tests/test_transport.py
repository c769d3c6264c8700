"""Fetching boards: stop rules against page lists by hand, and whole reads from a local server."""

import json

import pytest

from heddle.sources import landing, reader, transport
from heddle.sources.parsers import parse
from heddle.sources.transport import FetchError, Fetcher, Paging
from tests.transport import board_server


def offsets(paging, lists, **board):
    """The offsets read from a board whose pages have these items, by offset; pages are kept by the order of asking."""
    asked = iter(lists)

    def answer(method, url, body, headers, timeout):
        found = next(asked)
        return found if isinstance(found, tuple) else (200, json.dumps(found))

    got = Fetcher(answer, retries=0, sleep=lambda s: None).pages({"ats": "own", "token": "t", "url": "http://h/{offset}/{cursor}", "paging": paging, **board})
    return [(at, error is not None) for _, at, _, _, error in got]


def items(*names):
    return {"x": [{"k": n} for n in names]}


def test_stop_rules():
    short = Paging(step=2, size=2, items="x")
    assert offsets(short, [items(1, 2), items(3)]) == [(0, False), (2, False)]
    assert offsets(short, [items(1, 2), items()]) == [(0, False), (2, False)]
    assert offsets(Paging(step=2, size=2, items="x", most=4), [items(1, 2), items(3, 4), items(5, 6)]) == [(0, False), (2, False)]
    assert offsets(Paging(step=1, first=1, items="x", total="n"), [items(1, 2) | {"n": 5}, items(3, 4) | {"n": 5}, items(5) | {"n": 5}]) == [(1, False), (2, False), (3, False)]
    assert len(offsets(Paging(step=1, items="x", key="k", stale=2), [items(1), items(1), items(2), items(2), items(1), items(9)])) == 5
    assert len(offsets(Paging(step=1, items="x", key="k", stale=1, patience=3), [items(1)] * 9)) == 4
    assert len(offsets(Paging(step=1, items="x", follow="next"), [items(1) | {"next": "b"}, items(2) | {"next": None}, items(3)])) == 2
    assert offsets(short, [items(7, 8), items(9)], offset=6) == [(6, False), (8, False)]


def test_failed_pages_end_their_board():
    short = Paging(step=2, size=2, items="x")
    assert offsets(short, [items(1, 2), (500, "")]) == [(0, False), (2, True)]
    assert offsets(short, [(200, "no json")]) == [(0, True)]
    assert offsets(short, [{"x": 5}]) == [(0, True)]
    assert offsets(short, [[1, 2]]) == [(0, False)]  # no such member: an empty page


def test_pages_of_html_are_counted_by_pattern():
    pages = iter(["<a href=/c/a><a href=/c/b>", "<a href=/c/b>", "<a href=/c/a>"])
    paging = Paging(step=1, first=1, pattern=r"/c/(\w+)", stale=2)
    got = list(Fetcher(lambda *a: (200, next(pages))).pages({"ats": "own", "token": "t", "url": "http://h/{offset}", "paging": paging}))
    assert [x[0] for x in got] == ["http://h/1", "http://h/2", "http://h/3"]


def test_retries_and_pace():
    slept, answers = [], iter([(500, ""), OSError("reset"), (200, "ok")])

    def answer(*_):
        found = next(answers)
        if isinstance(found, Exception):
            raise found
        return found

    clock = [0.0]

    def sleep(s):
        slept.append(round(s, 3))
        clock[0] += s

    fetcher = Fetcher(answer, retries=2, wait=1.0, rate=0.5, lanes=2, sleep=sleep, clock=lambda: clock[0])
    assert fetcher.get(transport.ENDPOINTS["lever"], "http://h/a", None) == (200, "ok")
    # A lane of two asks once in four seconds; the wait before a retry counts towards it.
    assert slept == [1.0, 3.0, 1.0, 3.0]
    answers = iter([(404, ""), (200, "never asked")])
    with pytest.raises(FetchError, match="404"):
        fetcher.get(transport.ENDPOINTS["lever"], "http://h/a", None)
    assert next(answers)[0] == 200


def test_addresses():
    of = lambda ats, token: transport.url_of({"ats": ats, "token": token})
    assert of("greenhouse", "acme") == "https://boards-api.greenhouse.io/v1/boards/acme/jobs"
    assert of("personio", "acme") == "https://acme.jobs.personio.de/xml?language=en"
    assert of("workday", "https://acme.wd5.myworkdayjobs.com/Site/x") == "https://acme.wd5.myworkdayjobs.com/wday/cxs/acme/Site/jobs"
    assert of("mailto", "https://acme.com/careers") == "https://acme.com/careers"
    assert of("lever", "a/b c") == "https://api.lever.co/v0/postings/a%2Fb%20c?mode=json"
    with pytest.raises(FetchError):
        of("workday", "https://acme.com")


def read(spark, boards, **options):
    spark.dataSource.register(reader.BoardSource)
    told = {k: str(v) for k, v in ({"wait": 0} | options).items()}
    return spark.read.format("boards").options(boards=json.dumps(boards), **told).load()


def boards_of(server):
    site = lambda c: {"company": c, "ats": "workday", "token": f"{server.base}/{c}"}
    return [site(c) for c in ("small", "even", "large", "absent")] + [{"company": "L", "ats": "lever", "token": "small", "url": server.base + "/{token}/list"}, {"company": "X", "ats": "lever", "token": "x", "url": server.base + "/x/list"}]


def test_reader_pages_until_the_short_page(spark):
    with board_server() as server:
        got = read(spark, boards_of(server), lanes=2, agent="me").collect()
        pages = {c: [(r["page_offset"], r["error"] is None) for r in sorted(got, key=lambda r: r["page_offset"]) if r["company"] == c] for c in {r["company"] for r in got}}
        assert pages["small"] == [(0, True)] and pages["even"] == [(0, True), (20, True), (40, True)]
        assert pages["large"] == [(at, True) for at in range(0, 500, 20)]
        assert pages["absent"] == [(0, False)] and pages["X"] == [(0, False)] and pages["L"] == [(0, True)]
        assert {(a[0], a[3], a[4]) for a in server.asked} == {("POST", "me", "application/json"), ("GET", "me", None)}
        # A page that is not there is not asked for again.
        assert [a[1] for a in server.asked].count("/x/list") == 1
        jobs = parse(read(spark, boards_of(server)).where("payload is not null"))
        assert jobs.where("ats = 'workday'").groupBy("company").count().collect() and jobs.where("company = 'even'").count() == 40


def test_no_cap_where_none_is_asked_for(spark):
    with board_server() as server:
        board = {"company": "large", "ats": "workday", "token": f"{server.base}/large", "paging": {"step": 20, "size": 20, "items": "jobPostings"}}
        assert read(spark, [board]).count() == 31


def test_a_failed_page_fails_its_board_only_and_is_resumed(spark):
    with board_server() as server:
        server.failing = {("even", 20): 3, ("large", 60): 2}
        first = spark.createDataFrame(read(spark, boards_of(server)[:3], retries=2).collect(), reader.PAGES)
        left = reader.to_go_on(first).collect()
        # Two failures are retried within one read; three end the board at that page.
        assert [(r["company"], r["offset"]) for r in left] == [("even", 20)]
        rest = reader.fetch(spark.createDataFrame(left), wait=0).collect()
        assert [(r["page_offset"], r["error"]) for r in sorted(rest, key=lambda r: r["page_offset"])] == [(20, None), (40, None)]


def test_hosts_are_dealt_to_lanes():
    boards = [{"company": str(i), "ats": "lever", "token": str(i)} for i in range(500)] + [{"company": "w", "ats": "workday", "token": f"https://h{i}.com/s"} for i in range(50)]
    parts = reader.dealt(boards, lanes=4, most=16, now=None)
    lever = [p for p in parts if any(b["ats"] == "lever" for b in p.boards)]
    assert len(lever) == 4 and len(parts) == 16 and sum(len(p.boards) for p in parts) == 550


def test_table_of_boards(spark):
    with board_server() as server:
        rows = [("s", "workday", f"{server.base}/small", None), ("s", "workday", f"{server.base}/small", None), (None, "lever", "small", server.base + "/{token}/list"), ("n", None, "t", None), ("n", "lever", None, None)]
        got = reader.fetch(spark.createDataFrame(rows, "company string, ats string, token string, url string"), now=5.0, wait=0, lanes=2).collect()
        assert sorted((r["ats"], r["now"], r["error"]) for r in got) == [("lever", 5.0, None), ("workday", 5.0, None)]


def test_stream_of_ticks_restarts_from_its_offset(spark, tmp_path):
    with board_server() as server:
        spark.dataSource.register(reader.BoardSource)
        boards = [{"company": c, "ats": "workday", "token": f"{server.base}/{c}"} for c in ("small", "even", "large")]
        seen = []

        def run(now):
            options = {"boards": json.dumps(boards), "every": "10", "slice": "1", "now": str(now), "from_tick": "2"}
            stream = spark.readStream.format("boards").options(**options).load().writeStream.option("checkpointLocation", str(tmp_path / "c"))
            query = stream.foreachBatch(lambda df, n: seen.append(sorted((r["now"], r["company"]) for r in df.select("now", "company").distinct().collect()))).trigger(once=True).start()
            query.awaitTermination(60)

        run(30)
        assert seen == [[(30.0, "small")]]
        run(50)  # two ticks later: the next two boards, as of the last
        assert seen[1:] == [[(50.0, "even"), (50.0, "large")]]
        run(50)  # nothing new
        assert len([s for s in seen if s]) == 2


def test_landing_reads_through(spark, tmp_path):
    with board_server() as server:
        folder = f"file://{tmp_path}/landed"
        boards = spark.createDataFrame([(c, "workday", f"{server.base}/{c}") for c in ("small", "even")], "company string, ats string, token string")
        told = lambda now, df=boards, age=100.0: sorted((r["company"], r["page_offset"], r["fetched_at"], r["error"] is None) for r in landing.read_through(df, folder, now, age, wait=0).collect())
        first = [("even", 0, 1000.0, True), ("even", 20, 1000.0, True), ("even", 40, 1000.0, True), ("small", 0, 1000.0, True)]
        assert told(1000.0) == first and len(server.asked) == 4
        assert told(1050.0) == first and len(server.asked) == 4  # all fresh
        server.failing = {("even", 40): 9}
        assert told(1100.0) == [("even", 0, 1100.0, True), ("even", 20, 1100.0, True), ("even", 40, 1100.0, False), ("small", 0, 1100.0, True)]
        # The failed fetch is no fetch: only that board is asked again, at once.
        server.failing, before = {}, len(server.asked)
        assert [r[:3] for r in told(1150.0)] == [("even", 0, 1150.0), ("even", 20, 1150.0), ("even", 40, 1150.0), ("small", 0, 1100.0)] and len(server.asked) == before + 3
        # Only days that may be used are read, and days go whole.
        plan = landing.fresh(landing.landed(spark, folder), 1150.0, 100.0)._jdf.queryExecution().toString()
        assert "PartitionFilters" in plan and "fetched_day" in plan.split("PartitionFilters")[1][:200]
        assert landing.forget(spark, folder, 86_400.0 * 2) == [0] and landing.landed(spark, folder).count() == 0
