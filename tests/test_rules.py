import random

from logweave.functions import fixed
from logweave.operators import rca as op

SCHEMA = "priority int, keyword string, pattern string, root_cause string, fix_suggestion string, confidence double"


def best_rule(text, rules):
    low = (text or "").lower()
    fit = [r for r in rules if r[1] is not None and r[1].lower() in low]
    return min(fit, key=lambda r: (r[0], r[2])) if fit else None


def check(spark, messages, rules):
    df = spark.createDataFrame(list(enumerate(messages)), "id int, message string")
    got = {r.id: (r.error_pattern, r.confidence_score) for r in op.classify_with_rule_table(df, spark.createDataFrame(rules, SCHEMA)).collect()}
    assert len(got) == len(messages)
    for k, m in enumerate(messages):
        r = best_rule(m, rules)
        want = (fixed.HEURISTIC_PREFIX + r[2], r[5]) if r else (fixed.HEURISTIC_PREFIX + fixed.DEFAULT_RULE[0], fixed.DEFAULT_RULE[3])
        assert got[k] == want, m


def test_a_hundred_thousand_rules(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rules = [(rng.randint(0, 50), word(rng.randint(3, 12)), f"p{i}", "c", "f", i / 100_000) for i in range(100_000)]
    messages = [word(rng.randint(0, 60)).title() for _ in range(120)] + [None, "", "ABCDEFGH"] * 20
    check(spark, messages, rules)


def test_parts_and_slots(spark, monkeypatch):
    monkeypatch.setattr(op, "PART", 50)
    monkeypatch.setattr(op, "SLOT", 7)
    rng = random.Random(5)
    words = ["Tide", "quay", "ÄÖ", "", "e", "crane", "lock gate", None, "x.y*", "Tide"]
    rules = [(rng.randint(0, 4), rng.choice(words), f"p{i}", "c", "f", i / 40) for i in range(40)]
    messages = [" ".join(rng.choice(["TIDE", "quay", "äö", "lock", "gate", "z", "X.Y*"]) for _ in range(rng.randint(0, 5))) for _ in range(60)] + [None] * 3
    check(spark, messages, rules)
    check(spark, messages, [r for r in rules if r[1]])
    df = spark.createDataFrame([(1, "tide")], "id int, message string")
    assert op.classify_with_rule_table(df, spark.createDataFrame([], SCHEMA)).first().confidence_score == fixed.DEFAULT_RULE[3]
    assert op.classify_with_rule_table(df.limit(0), spark.createDataFrame(rules, SCHEMA)).count() == 0
