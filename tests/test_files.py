import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from logweave.sources import logs, sinks


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="logweave-files-")


def lines_of(path):
    return open(path, encoding="utf-8").read().split("\n")[:-1]


def check(spark, folder):
    got = {}
    for r in logs.read_log_lines(spark, folder).collect():
        got.setdefault(os.path.basename(r.source), {})[r.line_no] = r.raw_line
    want = {f: dict(enumerate(lines_of(os.path.join(folder, f)), 1)) for f in os.listdir(folder)}
    assert got == {f: v for f, v in want.items() if v}


def test_numbers_over_splits_of_any_size(spark, folder):
    rng = random.Random(1)
    for k in range(5):
        with open(os.path.join(folder, f"f{k}.log"), "w") as f:
            f.writelines("x" * rng.randint(0, 40) + f" {i}\n" for i in range((1, 4000, 3, 2500, 800)[k]))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    try:
        for size in ("700b", "20k"):
            for k in keys:
                spark.conf.set(k, size)
            assert logs.split_bound(spark, folder) > 0
            check(spark, folder)
    finally:
        for k, v in zip(keys, old, strict=True):
            spark.conf.set(k, v)
    check(spark, folder)


def test_many_small_files_need_no_join(spark, folder):
    for k in range(2000):
        with open(os.path.join(folder, f"f{k}.log"), "w") as f:
            f.write(f"first of {k}\nsecond of {k}\n")
    assert logs.split_bound(spark, folder) == 0
    df = logs.read_log_lines(spark, folder)
    plan = df._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan
    check(spark, folder)


def test_a_failed_and_a_repeated_batch_write_once(spark, folder):
    schema = "cluster_no bigint, error_pattern string, root_cause string, fix_suggestion string, confidence_score double"
    batches = {n: spark.createDataFrame([(k, f"p{n}", "c", None, 0.5) for k in range(n, n + 4)], schema).repartition(3) for n in range(3)}

    def boom(x):
        raise RuntimeError("lost")

    sinks.write_results_batch(batches[0], folder, 0)
    broken = batches[1].withColumn("root_cause", F.udf(boom)("root_cause"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_results_batch(broken, folder, 1)
    for n in (1, 1, 2, 0):  # again after the failure, and after a restart
        sinks.write_results_batch(batches[n], folder, n)
    got = [(r.batch, json.loads(r.json)) for r in sinks.read_results_json(spark, folder).collect()]
    assert sorted((b, x["errorPattern"], x["fixSuggestion"], x["confidenceScore"]) for b, x in got) == sorted((n, f"p{n}", "", 0.5) for n in range(3) for _ in range(4))
    want = {r.json for n in range(3) for r in sinks.results_to_json(batches[n]).collect()}
    assert {json.dumps({k: v for k, v in x.items() if k != "analyzedAt"}, separators=(",", ":")) for _, x in got} == want
