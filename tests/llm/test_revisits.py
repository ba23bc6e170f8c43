import duckdb
import pytest

from trackloom.llm import revisits as rv

SCHEMA = "record_id long, url string, at long, kind string, status int, headers map<string,string>, payload string, part long"


def test_cases(spark, monkeypatch):
    full = lambda i, at, tag, url="http://A.com:80/x?b=2&a=1#f", status=200: (i, url, at, "response", status, {"etag": tag, "server": "s", "date": "1"}, f"p{i}", 0)
    ask = lambda i, at, head, url="http://a.com/x?a=1&utm_x=3&b=2": (i, url, at, "revisit", 304, head, None, 0)
    rows = [full(1, 10, "t1"), full(2, 20, "t2"), full(3, 20, "t3"), full(4, 25, "t9", status=500), full(20, None, "t"), full(21, 1, "t", url=None)]
    rows += [ask(5, 5, {"etag": "t1"}), ask(6, 10, {"etag": "t1"}), ask(7, 15, {"etag": 'W/t1', "server": "new", "date": "2"}), ask(8, 30, {"etag": "t3"}), ask(9, 30, {"etag": "t2"})]
    rows += [ask(10, 30, None), ask(11, 30, {}), ask(12, None, {"etag": "t3"}), ask(13, 40, {"etag": "t"}, url=None), ask(8, 30, {"etag": "t3"})]
    rows += [(14, "http://b.com", 1, "response", 200, {"last-modified": "m"}, "pb", 0), ask(15, 2, {"last-modified": "m", "etag": "q"}, url="http://b.com/")]
    got = rv.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.record_id: r for r in got}
    assert len(got) == 11
    outcome = {i: by[i].outcome for i in by}
    assert outcome == {5: "no_earlier_response", 6: "no_earlier_response", 7: "resolved", 8: "resolved", 9: "validator_mismatch", 10: "validator_mismatch", 11: "validator_mismatch", 12: "no_earlier_response", 13: "no_earlier_response", 15: "resolved"}
    assert (by[7].response_id, by[7].payload, by[7].headers) == (1, "p1", {"etag": "W/t1", "server": "s", "date": "2"})
    assert by[8].response_id == 3 and by[15].payload == "pb" and by[9].payload is None
    assert rv.resolve(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_ids_lose_nothing(spark):
    """Rows are matched by URL and time, so an id of two revisits, or of two responses, mixes nothing up."""
    rows = [(i, u, at, "response", 200, {"etag": t}, f"p{t}", 0) for i, u, at, t in ((1, "http://a.com/", 1, "a"), (1, "http://b.com/", 1, "b"), (None, "http://c.com/", 1, "c"))]
    rows += [(i, u, 5, "revisit", 304, {"etag": t}, None, 0) for i, u, t in ((7, "http://a.com/", "a"), (7, "http://b.com/", "b"), (None, "http://c.com/", "c"), (7, "http://a.com/", "z"))]
    got = rv.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.url, r.outcome, r.payload) for r in got) == [("http://a.com/", "resolved", "pa"), ("http://a.com/", "validator_mismatch", None), ("http://b.com/", "resolved", "pb"), ("http://c.com/", "resolved", "pc")]


@pytest.mark.parametrize("ranges", [64, 4])
def test_report_equals_sql(spark, sf, monkeypatch, ranges):
    monkeypatch.setattr(rv, "RANGES", ranges)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    # many captures of few URLs
    pages = pages.union(pages.selectExpr("page_id + 100000", "concat('http://hot.example.com/', page_id % 2)", "html"))
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.sql(rv.REPORT_SQL).fetchall()
    assert sorted(map(tuple, rv.report(pages).collect()), key=repr) == sorted(want, key=repr)
