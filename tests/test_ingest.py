import datetime as dt

from conftest import lines_df

from logweave.operators.ingest import ingest, parse_lines, rejected_lines


def one(spark, line):
    rows = ingest(lines_df(spark, [line])).collect()
    return rows[0] if rows else None


def test_plain_with_service(spark):
    e = one(spark, "2024-01-15 10:23:45 ERROR OrderService - Connection refused to db:3306")
    assert (e.level, e.service, e.message) == ("ERROR", "OrderService", "Connection refused to db:3306")
    assert e.ts == dt.datetime(2024, 1, 15, 10, 23, 45)


def test_json_line(spark):
    e = one(spark, '{"timestamp":"2024-01-15 10:23:45","level":"WARN","service":"PaymentService","message":"Slow response 3200ms"}')
    assert (e.level, e.service, e.message) == ("WARN", "PaymentService", "Slow response 3200ms")


def test_invalid_line_dropped(spark):
    assert one(spark, "this is not a valid log line at all @#$!!") is None


def test_edge_rows(spark):
    lines = [
        "2024-01-15T10:23:45.123 WARNING a-b_1 - x",
        "2024-01-15 10:23:45.1 CRITICAL x y",
        "2024-01-15 10:23:45 ERROR Svc -> msg",
        "2024-01-15 10:23:45 ERROR Svc - ",
        "2024-01-15 10:23:45 ERROR",
        "2024-01-15 10:23:45 Error x",
        "2024-01-15 10:23:45 NOTICE s - m",
        "{garbage",
        '{"timestamp":null,"time":"2024-01-15 10:00:00"}',
        '{"level":"ERROR","o":{ "level":"WARN" }}',
        '{"level":"ERROR","p":{"level":"WARN"}}',
        '{"message":"null"}',
        "   ",
        None,
    ]
    rows = {r.line_no: r for r in ingest(lines_df(spark, lines)).collect()}
    r = rows[1]
    assert (r.ts, r.level, r.service, r.message) == (dt.datetime(2024, 1, 15, 10, 23, 45, 123000), "WARN", "a-b_1", "x")
    r = rows[2]
    assert (r.ts, r.level, r.service, r.message) == (None, "FATAL", "unknown", "x y")
    assert (rows[3].service, rows[3].message) == ("unknown", "Svc -> msg")
    assert (rows[4].service, rows[4].message) == ("unknown", "Svc -")
    assert 5 not in rows and 6 not in rows
    assert rows[7].level == "UNKNOWN"
    assert (rows[8].level, rows[8].service, rows[8].message, rows[8].ts) == ("UNKNOWN", "unknown", None, None)
    assert rows[9].ts is None
    assert rows[10].level == "WARN"
    assert rows[11].level == "ERROR"
    assert rows[12].message is None
    assert 13 not in rows and 14 not in rows


def test_rejected_and_branches(spark):
    df = lines_df(spark, ["2024-01-15 10:23:45 INFO a - b", "nope", " ", '{"a":1}'])
    assert [r.line for r in rejected_lines(df).collect()] == ["nope"]
    branches = sorted((r.line_no, r.branch) for r in parse_lines(df).collect())
    assert branches == [(1, "service"), (2, None), (3, None), (4, "json")]


def test_unicode_whitespace_strip(spark):
    e = one(spark, " \t2024-01-15 10:23:45 INFO a - b　")
    assert e.raw_line == "2024-01-15 10:23:45 INFO a - b" and e.message == "b"


def test_empty_input_gives_empty_frame(spark):
    df = ingest(lines_df(spark, ["junk only"]))
    assert df.count() == 0 and df.columns[0] == "id"


def test_long_json_value_does_not_overflow(spark):
    big = "x" * 200_000
    e = one(spark, '{"level":"ERROR","message":"' + big + '"}')
    assert e.level == "ERROR" and len(e.message) == 200_000


def test_observed_parse_counts(spark):
    from pyspark.sql import Observation

    from conftest import SF_SMALL
    from logweave.operators.stats import ingest_stats
    from logweave.sources.logs import load_log_lines

    obs = Observation("parse")
    n = ingest(load_log_lines(spark, SF_SMALL), observation=obs).count()
    got = obs.get
    want = ingest_stats(load_log_lines(spark, SF_SMALL)).first()
    assert got["parsed_lines"] == n == want.parsed_lines
    assert (got["total_lines"], got["blank_lines"], got["rejected_lines"]) == (
        want.total_lines, want.blank_lines, want.rejected_lines)


def test_blank_runs_and_strip_are_linear(spark):
    """A line with a million inner blanks parses at once."""
    import time

    from logweave.operators.ingest import ingest

    line = "\u2003 2024-01-15 10:23:45 ERROR a - x" + " " * 1_000_000 + "y\u3000\t"
    ingest(lines_df(spark, ["2024-01-15 10:23:45 ERROR a - x"])).collect()
    t = time.perf_counter()
    r = ingest(lines_df(spark, [line])).collect()
    assert r[0].message.startswith("x ") and r[0].message.endswith(" y") and time.perf_counter() - t < 3


def test_lenient_calendar(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from logweave.operators.ingest import parse_ts

    want = {
        "2023-02-30 10:00:00": datetime(2023, 2, 28, 10), "2024-02-31T10:00:00.250": datetime(2024, 2, 29, 10, 0, 0, 250000),
        "2024-04-31 00:00:00": datetime(2024, 4, 30), "2024-12-31 24:00:00": datetime(2025, 1, 1), "2023-02-30 24:00:00": datetime(2023, 3, 1),
        "2024-01-32 00:00:00": None, "2024-13-01 00:00:00": None, "2024-01-01 24:00:01": None, "2024-01-01 25:00:00": None,
        "2024-00-10 00:00:00": None, "2024-01-00 00:00:00": None, "2024-01-01 10:60:00": None,
    }
    df = spark.createDataFrame([(x,) for x in want], "t string").select("t", parse_ts("t").alias("ts"))
    assert {r.t: r.ts for r in df.collect()} == want


def test_json_marks_in_the_text(spark):
    """Texts that hold the marks of the one-pass scan give the same pairs."""
    from logweave.functions.jsonfields import json_pairs

    want = {
        '{"a":"b\\"c", "n": 12 , "e":"", "q":"null","r":null}': [("a", 'b"c'), ("n", "12"), ("e", ""), ("q", None), ("r", None)],
        '{"a":"p\x01b\x02c\x03q","n":1}': [("a", "p\x01b\x02c\x03q"), ("n", "1")],
        "": [], "no pairs": [], '"k":"v': [("k", '"v')],
    }
    df = spark.createDataFrame([(x,) for x in [*want, None]], "t string").select("t", json_pairs("t").alias("p"))
    got = {r.t: r.p for r in df.collect()}
    assert got.pop(None) is None
    assert {t: [(p.k, p.v) for p in ps] for t, ps in got.items()} == want


def test_nested_json(spark):
    from logweave.functions.jsonfields import rows_to_json

    df = spark.sql("""SELECT timestamp_ntz'2024-01-02 03:04:00' AS a, timestamp_ntz'2024-01-02 03:04:05' AS b,
      timestamp_ntz'2024-01-02 03:04:05.123456' AS c, named_struct('x', CAST(NULL AS INT), 'y', array(1, NULL)) AS d,
      map('k', CAST(NULL AS STRING)) AS e, X'00FF' AS f, CAST(NULL AS STRUCT<z: INT>) AS g, true AS h, date'2024-01-02' AS i""")
    assert df.select(rows_to_json(df).alias("j")).first().j == (
        '{"a":"2024-01-02T03:04","b":"2024-01-02T03:04:05","c":"2024-01-02T03:04:05.123456","d":{"x":null,"y":[1,null]},'
        '"e":{"k":null},"f":"AP8=","g":null,"h":true,"i":"2024-01-02"}')
