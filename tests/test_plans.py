"""Plan-shape guards: the properties the scale design relies on."""

from conftest import SF_SMALL

from logweave.plans import queries as Q
from logweave.sources.logs import split_payload


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_template_counts_aggregates_before_shuffle(spark):
    p = plan(Q.QUERIES["template_counts"](spark, SF_SMALL))
    assert "partial_count" in p and "partial_min" in p


def test_first_lines_limited_before_shuffle(spark):
    p = plan(Q.QUERIES["cluster_top20"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_dedupe_has_no_sort_aggregate_over_entries(spark):
    p = plan(Q.QUERIES["dedupe_entries"](spark, SF_SMALL))
    # the only sort aggregate runs after the hash aggregate per (group, source)
    lines = p.splitlines()
    hash_at = max(i for i, l in enumerate(lines) if "HashAggregate" in l and "partial_count" in l)
    assert all(i < hash_at for i, l in enumerate(lines) if "SortAggregate" in l)


def test_scan_reads_only_needed_columns(spark):
    p = plan(Q.QUERIES["log_entries"](spark, SF_SMALL))
    scan = [l for l in p.splitlines() if "FileScan parquet" in l][0]
    assert "value" not in scan and "props" not in scan and "event_id" in scan


def test_split_payload_drops_trailing_empty_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n\n"), (2, "\nx"), (3, "\n\n"), (4, None)], "k int, text string")
    got = sorted((r.k, r.line_no, r.raw_line) for r in split_payload(df, "text", "k").collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (2, 1, ""), (2, 2, "x")]
