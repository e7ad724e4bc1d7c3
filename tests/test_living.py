import os
import tempfile
from datetime import datetime, timedelta

import pandas as pd
import pytest
from conftest import SF_SMALL

from logweave.operators.alerts import escalations
from logweave.operators.dedupe import dedupe_within
from logweave.operators.ingest import ingest
from logweave.plans.analyze import cluster_entries, resolve
from logweave.sources.logs import load_log_lines
from logweave.streaming import stream
from logweave.streaming.living import LivingClusters, cluster_stream


def temp(name):
    return tempfile.mkdtemp(prefix=f"logweave-{name}-")


def files(spark, folder, parts):
    lines = [r.raw_line for r in load_log_lines(spark, SF_SMALL).orderBy("line_no").limit(600).collect()]
    # The chain of three templates arrives with its middle one last.
    late = [x for x in lines if "taken, rounded" in x]
    rest = [x for x in lines if "taken, rounded" not in x]
    cut = [rest[: len(rest) // 2], rest[len(rest) // 2 :], late][:parts]
    for k, part in enumerate(cut):
        path = os.path.join(folder, f"{k}.log")
        with open(path, "w") as f:
            f.write("\n".join(part) + "\n")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return [x for part in cut for x in part]


def partition(pairs):
    groups = {}
    for name, c in pairs:
        groups.setdefault(c, set()).add(name)
    return {frozenset(g) for g in groups.values()}


def test_clusters_keep_their_numbers_over_files(spark):
    folder, ck, state = temp("in"), temp("ck"), temp("state")
    lines = files(spark, folder, 3)
    living, seen = LivingClusters(spark, state), {}

    def write(entries, n):
        seen[n] = [(r.raw_line, r.cluster_id) for r in entries.collect()]

    def run():
        q = cluster_stream(stream.read_log_stream(spark, folder).where("true"), living, write, ck, {"availableNow": True})
        q.awaitTermination()

    spark.conf.set("spark.sql.streaming.fileSource.log.deletion", "true")
    orig = spark.readStream
    run()
    c = cluster_entries(ingest(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "source string, line_no bigint, raw_line string")))
    one = partition((r.template, r.component) for r in c.templates.select("template", "component").collect())
    got = living.state().collect()
    assert partition((r.template, r.cluster_id) for r in got) == one
    assert sum(r.n for r in got) == sum(r.n for r in c.templates.select("n").collect())
    assert all(r.cluster_id <= r.vkey for r in got) and orig is not None
    run()  # nothing new
    assert len(seen) == len({n for n in seen})


def test_micro_batches_one_by_one(spark):
    """Three batches, the last of which joins two clusters; a repeated batch
    gives the same numbers."""
    state = temp("state")
    lines = [x.split("|") for x in ("Ferry 1 cleared|Tide gauge reading 5 taken|Ferry 2 cleared", "Tide gauge reading 7 rounded to 3 cm, then filed by quay|Fog horn tested", "Tide gauge reading 9 taken, rounded to 3 cm|Ferry 9 cleared")]
    frames = [spark.createDataFrame([(f"f{k}", i + 1, f"2031-11-20 17:00:0{i} INFO a - {x}") for i, x in enumerate(b)], "source string, line_no bigint, raw_line string") for k, b in enumerate(lines)]
    living = LivingClusters(spark, state)
    first = [[(r.message, r.cluster_id) for r in living.update(f, n).orderBy("line_no").collect()] for n, f in enumerate(frames)]
    assert first == [[("Ferry 1 cleared", 1), ("Tide gauge reading 5 taken", 2), ("Ferry 2 cleared", 1)], [("Tide gauge reading 7 rounded to 3 cm, then filed by quay", 3), ("Fog horn tested", 4)], [("Tide gauge reading 9 taken, rounded to 3 cm", 2), ("Ferry 9 cleared", 1)]]
    again = LivingClusters(spark, state)
    assert [(r.message, r.cluster_id) for r in again.update(frames[2], 2).orderBy("line_no").collect()] == first[2]
    assert {(r.cluster_id, r.templates, r.size) for r in again.clusters().collect()} == {(1, 1, 3), (2, 3, 3), (4, 1, 1)}


def test_ids_of_a_stream_are_those_of_the_batch(spark):
    from logweave.sources.logs import read_log_lines

    folder = temp("in")
    files(spark, folder, 2)
    got = []
    q = stream.stream_entries(stream.read_log_stream(spark, folder)).writeStream.foreachBatch(lambda df, n: got.extend((r.id, r.line_no) for r in df.collect()))
    q.option("checkpointLocation", temp("ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == sorted((r.id, r.line_no) for r in ingest(read_log_lines(spark, folder)).collect())


BASE = datetime(2031, 11, 20, 10)


def entries(rows):
    return [(k, BASE + timedelta(minutes=m) if m is not None else None, lv) for k, m, lv in rows]


ROWS = [
    ("a", 0, "WARN"), ("a", 1, "WARN"), ("a", 2, "ERROR"), ("a", 3, "WARN"), ("a", 4, "FATAL"), ("a", 5, "ERROR"), ("a", 50, "ERROR"), ("a", 60, "INFO"),
    ("b", 0, "FATAL"), ("b", 20, "ERROR"), ("b", 49, "ERROR"), ("b", 100, "WARN"), ("c", 3, "INFO"), ("d", 1, "ERROR"), ("d", 1, "WARN"), ("d", None, "FATAL"),
]
RISES = {("a", 0, "MEDIUM"), ("a", 2, "HIGH"), ("a", 4, "CRITICAL"), ("a", 50, "HIGH"), ("b", 0, "CRITICAL"), ("b", 100, "MEDIUM"), ("d", 1, "HIGH")}


def test_escalations(spark):
    df = spark.createDataFrame(entries(ROWS), "service string, ts timestamp_ntz, level string")
    assert {(r.service, int((r["at"] - BASE).total_seconds() // 60), r.severity) for r in escalations(df, "service").collect()} == RISES


def run_stream(spark, schema, batches, make, key=None):
    """Feed batches of rows as files to a stream, one micro-batch each, and
    return the rows it gives out."""
    folder, out = temp("in"), []
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    for k, rows in enumerate(batches):
        path = os.path.join(folder, f"{k}.json")
        pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).to_json(path, orient="records", lines=True, date_format="iso")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    q = make(src).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).outputMode("append")
    q.option("checkpointLocation", temp("ck")).trigger(availableNow=True).start().awaitTermination()
    return out


def test_escalations_on_a_stream(spark):
    timed = sorted((r for r in entries(ROWS)), key=lambda r: r[1] or BASE)
    batches = [timed[:5], timed[5:9], timed[9:]]
    got = run_stream(spark, "service string, ts timestamp, level string", batches, lambda s: stream.stream_escalations(s, "service"))
    at = lambda t: int((t - BASE).total_seconds() // 60)
    assert {(r.service, at(r["at"]), r.severity) for r in got} == RISES and len(got) == len(RISES)


def test_every_entry_is_in_some_count(spark):
    rows = entries([("a", 0, "x"), ("a", 10, "x"), ("a", None, "x"), ("a", None, "x"), ("b", None, "x"), ("b", 90, "x")])
    df = spark.createDataFrame(rows, "service string, ts timestamp_ntz, level string")
    got = dedupe_within(df, ["service"], "30 minutes").collect()
    assert {(r.service, r.first_ts is None, r.dup_count) for r in got} == {("a", False, 2), ("a", True, 2), ("b", True, 1), ("b", False, 1)}
    assert sum(r.dup_count for r in got) == len(rows)


def test_untimed_repeats_on_a_stream(spark):
    """Groups come out when their time of arrival is long past."""
    folder, out = temp("in"), []
    rows = [("a", None), ("a", None), ("b", None), ("a", "2031-11-20T10:00:00")]
    pd.DataFrame(rows, columns=["service", "ts"]).to_json(os.path.join(folder, "0.json"), orient="records", lines=True)
    src = spark.readStream.schema("service string, ts timestamp").json(folder)
    q = stream.stream_untimed_repeats(src, ["service"], "1 second").writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).outputMode("append")
    q = q.option("checkpointLocation", temp("ck")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if len(out) >= 2:
                break
            q.awaitTermination(1)
            if q.exception():
                raise q.exception()
    finally:
        q.stop()
    assert sorted((r.service, r.dup_count) for r in out) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize("late", [False, True])
def test_replies_on_a_stream(spark, late):
    """A reply in time, one that comes too late, one that never comes."""
    body = '{"content":[{"text":"{\\"errorPattern\\":\\"said\\",\\"rootCause\\":\\"r\\",\\"fixSuggestion\\":\\"f\\",\\"confidenceScore\\":0.5}"}]}'
    at = lambda s: (BASE + timedelta(seconds=s)).isoformat()
    asked = [(n, f"Cluster-{n}", f"id{n}", "Radar sweep lost: timeout", 3, at(n)) for n in (1, 2, 3)] + [(9, "Cluster-9", "id9", "Fog horn tested", 1, at(3600))]
    said = [(1, body, at(30)), (2, body, at(200 if late else 40))] + [(99, body, at(3600))]
    a, b = temp("a"), temp("b")
    ca = ["cluster_no", "cluster_label", "rep_id", "rep_message", "size", "asked_at"]
    pd.DataFrame(asked, columns=ca).to_json(os.path.join(a, "0.json"), orient="records", lines=True)
    pd.DataFrame(said, columns=["cluster_no", "response", "replied_at"]).to_json(os.path.join(b, "0.json"), orient="records", lines=True)
    clusters = spark.readStream.schema("cluster_no bigint, cluster_label string, rep_id string, rep_message string, size bigint, asked_at timestamp").json(a)
    replies = spark.readStream.schema("cluster_no bigint, response string, replied_at timestamp").json(b)
    out = []
    q = stream.resolve_stream(clusters, replies).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).outputMode("append")
    q.option("checkpointLocation", temp("ck")).trigger(availableNow=True).start().awaitTermination()
    got = {r.cluster_no: (r.source, r.error_pattern) for r in out if r.cluster_no != 9}
    batch = spark.createDataFrame([x[:5] for x in asked[:3]], "cluster_no bigint, cluster_label string, rep_id string, rep_message string, size bigint")
    in_time = spark.createDataFrame([x[:2] for x in said[: 1 if late else 2]], "cluster_no bigint, response string")
    assert got == {r.cluster_no: (r.source, r.error_pattern) for r in resolve(batch, in_time).collect()}
    assert got[1] == ("reply", "said") and got[3][0] == "rules" and got[2][0] == ("rules" if late else "reply")
