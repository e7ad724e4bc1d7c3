import random
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from logweave.llm import language_id, mixing, ngram_jaccard, registry, sentence_pieces, toxicity

from .test_ngram_jaccard import exact

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's output, written and reread."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "ngram_jaccard", "mixing", "sentence_pieces"]
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_language_stage(stages):
    found = language_id.identify(stages[0]).where(f"lang_pred <> 'und' AND score >= {corpus_pipeline.LEAST_SCORE}")
    assert ids(stages[1]) == ids(found)


def test_language_stage_rejects_random_texts(spark):
    """Random letters go, whatever their script and length; clean texts stay,
    short ones too."""
    rng = random.Random(4)

    def noise(first, last, n):
        words = ("".join(chr(rng.randint(first, last)) for _ in range(rng.randint(2, 9))) for _ in range(n))
        return " ".join(words)[:n]

    scripts = {"latin": (0x61, 0x7A), "cyrillic": (0x430, 0x44F), "cjk": (0x4E00, 0x9FA5)}
    rows = [(f"{s} {'long' if n > 1000 else 'short'}", noise(*ends, n)) for s, ends in scripts.items() for n, k in ((20, 60), (100, 60), (500, 60), (3_000, 20), (20_000, 4)) for _ in range(k)]
    clean = ["The cat sat on the mat", "This is a short text", "one two three", "Das ist ein kurzer Text", "Guten Morgen zusammen", "Ich habe keine Zeit", "Bonjour tout le monde", "El gato está en la casa"]
    rows += [("clean", t) for t in clean]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", F.lit("real").alias("kind"))
    added = spark.createDataFrame([(10**9 + i, t, None, k) for i, (k, t) in enumerate(rows)], docs.schema)
    before = Counter(r["kind"] for r in docs.union(added).select("kind").collect())
    after = Counter(r["kind"] for r in corpus_pipeline.language(spark, docs.union(added), SF).select("kind").collect())
    assert after["clean"] == len(clean) and after["real"] >= 0.998 * before["real"]
    assert after["latin short"] <= 0.1 * before["latin short"] and after["latin long"] == 0
    assert after["cyrillic short"] + after["cjk short"] <= 0.01 * 2 * before["cjk short"]
    assert after["cyrillic long"] == after["cjk long"] == 0


def test_toxicity_stage(spark, stages):
    found = toxicity.score(stages[1], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(stages[2]) == ids(found.where("NOT toxic"))
    assert found.where("toxic").count() > 0


def test_one_of_each_class_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert ids(stages[3]) == Counter({c for _, c, _ in exact(rows)})
    assert stages[3].count() < stages[2].count()


def test_mixing_stage(stages):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(stages[3]).collect() if r["copies"]}
    assert ids(stages[4]) == Counter(want)


def test_pieces_stage(stages):
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentence_pieces.MODEL))
    text = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    assert all(r["ids"] == p.encode(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_run_and_odd_rows(spark, stages, odd_docs, no_docs):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(stages[5])
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_registered_queries():
    import __spark_entry__

    assert set(registry.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_nothing_else_imports_the_package():
    import pathlib
    import re

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in [*root.glob("*.py"), *root.glob("logweave/**/*.py"), *root.glob("tests/*.py"), *root.glob("tools/*.py")]:
        if "llm" not in path.parts and path.name not in ("corpus_pipeline.py", "__spark_entry__.py"):
            assert not re.search(r"(from|import) .*\bllm\b", path.read_text()), path
