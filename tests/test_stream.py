import os
import tempfile

from conftest import SF_SMALL

from logweave.operators.dedupe import dedupe
from logweave.operators.ingest import ingest
from logweave.sources.logs import load_log_lines, log_lines_from_events
from logweave.streaming.stream import stream_dedupe, stream_entries, stream_template_counts, windowed_template_counts


def test_stream_equals_batch(spark):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)
    counts = stream_template_counts(stream_entries(log_lines_from_events(src)), watermark="100000 days")
    q = (counts.writeStream.outputMode("complete").format("memory").queryName("tpl_counts")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="logweave-stream-"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {tuple(r) for r in spark.sql("SELECT window_start, window_end, template, n FROM tpl_counts").collect()}
    want = {tuple(r) for r in windowed_template_counts(ingest(load_log_lines(spark, SF_SMALL))).collect()}
    assert got == want and len(want) > 100


def _run(df, name, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="logweave-stream-")).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_stream_dedupe_keeps_one_entry_of_each_key(spark):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)
    keys = ["level", "service", "template"]
    got = _run(stream_dedupe(stream_entries(log_lines_from_events(src)), keys, "100000 days"), "dd")
    from logweave.operators.features import with_template

    batch = dedupe(with_template(ingest(load_log_lines(spark, SF_SMALL)).where("ts IS NOT NULL")), keys, keep=[]).collect()
    assert sorted((r.level, r.service, r.template or "") for r in got) == sorted((r.level, r.service, r.template or "") for r in batch)


def _write_lines(folder, name, lines):
    with open(os.path.join(folder, name), "w") as f:
        f.writelines(f"{x}\n" for x in lines)


def test_file_stream_gives_every_entry_its_own_id(spark):
    from logweave.streaming.stream import read_log_stream

    src = tempfile.mkdtemp(prefix="logweave-in-")
    _write_lines(src, "a.log", ["2024-01-15 10:00:00 INFO s - same line"] * 5 + ["2024-01-15 10:00:01 INFO s - other"])
    got = _run(stream_entries(read_log_stream(spark, path=src)), "ids")
    assert len(got) == 6 and len({r.id for r in got}) == 6


def test_append_mode_with_late_rows_and_rows_without_a_time(spark):
    """Files arrive one by one: windows come out once the watermark has
    passed, a row later than that is dropped, rows without a time are
    counted apart."""
    from logweave.streaming.stream import read_log_stream, stream_dedupe_within, untimed_template_counts

    src = tempfile.mkdtemp(prefix="logweave-in-")
    at = lambda h, m: f"2024-01-15 {h:02d}:{m:02d}:00 INFO s - tick"
    files = [[at(10, 0), at(10, 20), '{"level":"INFO","service":"s","message":"tick"}'], [at(14, 0)], [at(14, 5)], [at(10, 5), at(14, 10)], [at(20, 0)], [at(20, 1)]]
    for i, lines in enumerate(files):
        _write_lines(src, f"{i}.log", lines)
        os.utime(os.path.join(src, f"{i}.log"), (1_700_000_000 + i, 1_700_000_000 + i))

    def entries():
        lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(src).selectExpr(
            "_metadata.file_path AS source", "CAST(NULL AS BIGINT) AS line_no", "value AS raw_line")
        return stream_entries(lines)

    got = _run(stream_template_counts(entries(), "1 hour", "1 hour", "1 hour"), "late")
    assert {(r.window_start.hour, r.n) for r in got} == {(10, 2), (14, 3)}  # 10:05 came too late; 20:00 is still open
    untimed = _run(untimed_template_counts(entries()), "untimed", "complete")
    assert [(r.window_start, r.template, r.n) for r in untimed] == [(None, "tick", 1)]
    bursts = _run(stream_dedupe_within(entries(), ["service"], "30 minutes", "1 hour"), "bursts")
    assert {(r.first_ts.hour, r.last_ts.minute, r.dup_count) for r in bursts} == {(10, 20, 2), (14, 10, 3)}
    from logweave.operators.dedupe import dedupe_within

    batch = ingest(spark.createDataFrame([("f", i, x) for i, x in enumerate(x for f in files for x in f if "10:05" not in x)], "source string, line_no bigint, raw_line string"))
    twin = dedupe_within(batch, ["service"], "30 minutes").where("first_ts < timestamp_ntz'2024-01-15 19:00:00'")
    assert {(r.service, r.first_ts, r.last_ts, r.dup_count) for r in twin.collect()} == {(r.service, r.first_ts, r.last_ts, r.dup_count) for r in bursts}


def test_text_stream_clustered_per_batch(spark):
    import shutil

    from logweave.streaming.stream import cluster_each_batch, read_log_stream

    src = tempfile.mkdtemp(prefix="logweave-in-")
    shutil.copy(os.path.join(os.path.dirname(__file__), "data", "sample.log"), os.path.join(src, "a.log"))
    got = []

    def sink(df, batch_id):
        got.extend(df.collect())

    q = cluster_each_batch(read_log_stream(spark, path=src), sink, tempfile.mkdtemp(prefix="logweave-ck-"))
    q.awaitTermination()
    assert got and sum(r.size for r in got) == 13
    assert sorted(r.cluster_no for r in got) == list(range(1, len(got) + 1))


def test_every_parse_branch_occurs(spark):
    from logweave.operators.ingest import parse_lines

    b = {r.branch for r in parse_lines(load_log_lines(spark, SF_SMALL)).select("branch").distinct().collect()}
    assert b == {"service", "noservice", "json", None}
