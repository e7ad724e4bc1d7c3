from pyspark.sql import functions as F

from logweave.operators.prompts import build_requests, parse_reply, reply_text
from logweave.plans.analyze import resolve


def _parse(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.p for r in df.select("i", parse_reply(F.col("t")).alias("p")).orderBy("i").collect()]


def test_reply_edge_rows(spark):
    p = _parse(spark, [
        '{"errorPattern":"A","rootCause":"B","fixSuggestion":"C","confidenceScore":0.92}',
        '```json\n{"errorPattern":"A","confidenceScore": 1.7}\n```',
        'Sure! {"errorPattern":"A","confidenceScore":-1} hope it helps',
        '{"confidenceScore":"abc"}',
        '{"errorPattern":null}',
        "no braces here",
        "   ",
        None,
    ])
    assert (p[0].error_pattern, p[0].root_cause, p[0].fix_suggestion, p[0].confidence_score) == ("A", "B", "C", 0.92)
    assert p[1].confidence_score == 1.0 and p[1].root_cause == "Could not determine root cause"
    assert p[2].confidence_score == 0.0
    assert p[3].confidence_score == 1.0 and p[3].error_pattern == "Unknown pattern"
    assert p[4].error_pattern is None and p[4].confidence_score == 1.0
    assert (p[5].error_pattern, p[5].root_cause, p[5].confidence_score) == ("[Heuristic] Malformed LLM response", "no braces here", 0.0)
    assert (p[6].error_pattern, p[6].root_cause) == ("[Heuristic] Empty reply", "Unable to parse response.")
    assert p[7].error_pattern == "[Heuristic] Empty reply"


def test_reply_text_and_request(spark):
    df = spark.createDataFrame([('{"content":[{"type":"text","text":"Hello from the model"}],"role":"assistant"}',)], "r string")
    assert df.select(reply_text("r").alias("t")).first().t == "Hello from the model"
    p = spark.createDataFrame([(1, 'Hello "x"\n')], "cluster_no int, prompt string")
    req = build_requests(p, model="m-1", max_tokens=512).first().request
    assert '"model":"m-1"' in req and '"max_tokens":512' in req and 'Hello \\"x\\"\\n' in req


def test_resolve_fallback(spark):
    clusters = spark.createDataFrame(
        [(1, "Cluster-1", "a", "Connection refused", 3), (2, "Cluster-2", "b", "heap space", 1), (3, "Cluster-3", "c", "x", 1)],
        "cluster_no long, cluster_label string, rep_id string, rep_message string, size long")
    replies = spark.createDataFrame(
        [(1, '{"content":[{"type":"text","text":"{\\"errorPattern\\":\\"DB down\\",\\"confidenceScore\\":0.8}"}]}'),
         (3, '{"content":[{"type":"text","text":"garbage"}]}')], "cluster_no long, response string")
    r = {x.cluster_no: x for x in resolve(clusters, replies).collect()}
    assert (r[1].source, r[1].error_pattern, r[1].confidence_score) == ("reply", "DB down", 0.8)
    assert (r[2].source, r[2].error_pattern, r[2].confidence_score) == ("rules", "[Heuristic] Out-of-Memory Error", 0.7)
    assert (r[3].source, r[3].error_pattern) == ("reply", "[Heuristic] Malformed LLM response")
    off = {x.cluster_no: x for x in resolve(clusters, None).collect()}
    assert off[1].error_pattern == "[Heuristic] Network/Connection Error" and off[3].confidence_score == 0.3


def test_empty_cluster_and_rule_table(spark):
    from logweave.operators.rca import classify_with_rule_table, rules_table
    from logweave.plans.analyze import heuristic_results

    clusters = spark.createDataFrame([(1, "Cluster-1", None, None, 0), (2, "Cluster-2", "b", "Out of memory", 4)],
                                     "cluster_no long, cluster_label string, rep_id string, rep_message string, size long")
    r = {x.cluster_no: x for x in heuristic_results(clusters).collect()}
    assert (r[1].log_entry_id, r[1].error_pattern, r[1].confidence_score) == (
        "Cluster-1:empty-cluster", "[Heuristic] No entries to analyze.", 0.0)
    assert r[2].error_pattern == "[Heuristic] Out-of-Memory Error"
    df = spark.createDataFrame([("Authentication lost connection",), ("a cheap trick",), ("fine",)], "message string")
    got = {x.message: x.error_pattern for x in classify_with_rule_table(df, rules_table(spark)).collect()}
    assert got == {"Authentication lost connection": "[Heuristic] Network/Connection Error",
                   "a cheap trick": "[Heuristic] Out-of-Memory Error", "fine": "[Heuristic] Unclassified Error"}


def test_one_result_builder_for_both_modes(spark):
    from pyspark.sql import functions as F

    clusters = spark.createDataFrame([(1, "Cluster-1", None, None, 0), (2, "Cluster-2", "b", "Out of memory", 4), (3, "Cluster-3", "c", "x", 1)],
                                     "cluster_no long, cluster_label string, rep_id string, rep_message string, size long")
    replies = spark.createDataFrame([(1, '{"text":"{\\"errorPattern\\":\\"Q\\"}"}'), (3, '{"text":"{\\"errorPattern\\":\\"Q\\"}"}')],
                                    "cluster_no long, response string")

    def own(df):
        return df.select("*", F.lit("CUSTOM").alias("error_pattern"), F.lit("c").alias("root_cause"), F.lit("f").alias("fix_suggestion"),
                         F.lit(0.25).alias("confidence_score"))

    off, on = resolve(clusters, None, own), resolve(clusters, replies, own)
    assert off.schema == on.schema
    a, b = ({r.cluster_no: r for r in d.collect()} for d in (off, on))
    for r in (a, b):
        assert (r[1].log_entry_id, r[1].source, r[1].error_pattern, r[1].confidence_score) == (
            "Cluster-1:empty-cluster", "empty", "[Heuristic] No entries to analyze.", 0.0)
        assert (r[2].source, r[2].error_pattern, r[2].confidence_score) == ("rules", "CUSTOM", 0.25)
    assert (a[3].error_pattern, b[3].error_pattern, b[3].source) == ("CUSTOM", "Q", "reply")


def test_rule_table_of_any_size(spark):
    from logweave.operators.rca import classify_with_rule_table

    rules = [(i % 50, f"key{i:05d}x", f"P{i}", "c", "f", 0.5) for i in range(12_000)] + [(0, "", "all", "c", "f", 0.1), (-1, "é", "short", "c", "f", 0.2), (0, None, "none", "c", "f", 0.3)]
    rules = spark.createDataFrame([(p + 10 if k == "" else p, k, *r) for p, k, *r in rules],
                                  "priority int, keyword string, pattern string, root_cause string, fix_suggestion string, confidence double")
    df = spark.createDataFrame([(1, "see KEY00007X and key00003x"), (2, "caf\u00c9"), (3, "nothing"), (4, None), (5, "key11999x"), (6, "nothing")], "i int, message string")
    got = {r.i: r.error_pattern for r in classify_with_rule_table(df, rules).collect()}
    assert got == {1: "[Heuristic] P3", 2: "[Heuristic] short", 3: "[Heuristic] all", 4: "[Heuristic] all", 5: "[Heuristic] all", 6: "[Heuristic] all"}


def test_analyze_offline_and_with_replies(spark):
    from conftest import lines_df

    from logweave.plans.analyze import analyze

    lines = lines_df(spark, ["2024-01-15 10:23:45 ERROR a - Connection refused", "2024-01-15 10:23:46 ERROR a - Connection refused",
                             "2024-01-15 10:23:47 ERROR b - heap space exhausted"])
    off = analyze(lines).orderBy("cluster_no").collect()
    assert [x.size for x in off] == [2, 1] and off[0].error_pattern == "[Heuristic] Network/Connection Error"
    replies = spark.createDataFrame([(2, '{"content":[{"type":"text","text":"{\\"errorPattern\\":\\"GC\\"}"}]}')],
                                    "cluster_no long, response string")
    on = {x.cluster_no: x for x in analyze(lines, replies).collect()}
    assert on[2].error_pattern == "GC" and on[1].source == "rules"


def test_json_sinks(spark, tmp_path):
    import json

    from logweave.sources.sinks import results_json_pages, write_results_json

    res = spark.createDataFrame(
        [(i, f"Cluster-{i}:x", f'p "{i}"', None if i == 2 else "c\nd", "f", 0.7, 1) for i in range(1, 8)],
        "cluster_no long, log_entry_id string, error_pattern string, root_cause string, fix_suggestion string, "
        "confidence_score double, size long")
    out = str(tmp_path / "res")
    write_results_json(res, out)
    objs = [json.loads(l) for l in spark.read.text(out).collect() for l in [l.value]]
    assert len(objs) == 7 and all(list(o) == ["errorPattern", "rootCause", "fixSuggestion", "confidenceScore",
                                              "analyzedAt"] for o in objs)
    by = {o["errorPattern"]: o for o in objs}
    assert by['p "2"']["rootCause"] == "" and by['p "1"']["rootCause"] == "c\nd" and by['p "1"']["confidenceScore"] == 0.7
    pages = {r.page_no: r for r in results_json_pages(res, page_size=3).collect()}
    assert sorted(pages) == [0, 1, 2] and [pages[p].n_results for p in (0, 1, 2)] == [3, 3, 1]
    arr = json.loads(pages[1].json)
    assert [a["errorPattern"] for a in arr] == ['p "4"', 'p "5"', 'p "6"']


def test_reply_is_not_worked_out_by_every_part(spark):
    """A reply is named by every part of its parse, but stands twice in the plan: to see whether it is blank, and for all parts."""
    df = spark.createDataFrame([('{"text":"{\\"errorPattern\\":\\"Q\\",\\"confidenceScore\\":7}"}',), ('{"text":"MARKED"}',), (None,)], "r string")
    got = df.select(parse_reply(reply_text(F.replace(F.col("r"), F.lit("MARKED"), F.lit("none")))).alias("p"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MARKED") <= 2
    assert [tuple(r.p)[0] for r in got.collect()] == ["Q", "[Heuristic] Malformed LLM response", "[Heuristic] Empty reply"]
    assert [r.p.confidence_score for r in got.collect()] == [1.0, 0.0, 0.0]
