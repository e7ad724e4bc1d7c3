import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from logweave.llm import sentence_pieces, token_counts

PARTS = ["a", "b", " ", "  ", "   ", "\n", "\t", "'", "'s", "'re", "'ll", "é", "1", "22", "!", "...", "<|endoftext|>", "<|endof", "日", "🙂", "the", "ing", " the", "=", "====", "\x00", "<s>", "<0x0A>", "ß", "　", "𝔘", "한", "؄", "͸"]


def texts(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


@cache
def library():
    return Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))


def count(text):
    return len(library().encode(text, add_special_tokens=False).ids)


@cache
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentence_pieces.MODEL))


def test_counts_equal_the_library():
    c = token_counts.counter(public_tokenizers.path(token_counts.TOKENIZER))
    for t in [*texts(1500, 40, 1), " " * 300, "=" * 5000, "a" * 3000]:
        assert c.count(t) == count(t), t


def test_every_prefix_equals_the_library():
    c = token_counts.counter(public_tokenizers.path(token_counts.TOKENIZER))
    for t in texts(300, 12, 2):
        assert c.prefix_counts(t).tolist() == [count(t[:i]) for i in range(len(t) + 1)], t
        for budget in (0, 1, 3, 100):
            assert c.cut(t, budget) == max(i for i in range(len(t) + 1) if count(t[:i]) <= budget)


def test_character_classes_equal_the_library():
    c = token_counts.counter(public_tokenizers.path(token_counts.TOKENIZER))
    split = library().pre_tokenizer.pre_tokenize_str
    for p in [*range(0x600), *range(0x600, 0x110000, 101)]:
        if not 0xD800 <= p < 0xE000:
            s = f"a{chr(p)}1{chr(p)} {chr(p)}"
            assert len(c.pieces(s)) == len(split(s)), hex(p)


def test_count_query_on_odd_rows(odd_docs, no_docs):
    got = token_counts.token_counts(odd_docs, limit=3).collect()
    assert len(got) == odd_docs.count()
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), count(r["text"] or "")) for r in odd_docs.collect())
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 3) for r in got)
    assert token_counts.token_counts(no_docs).count() == 0


def test_truncate_and_prefix_table(spark):
    df = spark.createDataFrame([(1, "The quick brown fox  jumps"), (2, None), (3, "")], "id int, text string")
    rows = {r["id"]: r for r in token_counts.prefix_table(token_counts.truncate(df, 3)).collect()}
    assert count(rows[1]["cut_text"]) <= 3 < count(rows[1]["text"][: len(rows[1]["cut_text"]) + 1])
    assert rows[1]["prefix_tokens"] == [count(rows[1]["text"][:i]) for i in range(len(rows[1]["text"]) + 1)]
    assert rows[2]["cut_text"] == "" and rows[3]["prefix_tokens"] == [0]


def test_pieces_equal_the_library():
    p = sentence_pieces.pieces(public_tokenizers.path(sentence_pieces.MODEL))
    some = [*texts(2000, 25, 3), *(" " * n for n in range(40)), *("a" * n for n in range(40)), "▁x▁", "ab" * 20_000]
    for t, got in zip(some, p.encode(some), strict=True):
        ids = np.frombuffer(got, np.int32).tolist()
        assert ids == processor().encode(t), t
        assert p.decode(ids) == processor().decode(ids)


def test_memory_limit_does_not_change_pieces(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "SEGMENTS", 10)
    monkeypatch.setattr(sentence_pieces, "BATCH_CHARS", 50)
    p = sentence_pieces.Pieces(public_tokenizers.path(sentence_pieces.MODEL))
    some = texts(200, 20, 4)
    assert [np.frombuffer(b, np.int32).tolist() for b in p.encode(some)] == [processor().encode(t) for t in some]


@pytest.mark.parametrize("alphabet", [2, 40, 3000])
def test_suffix_index_finds_every_occurrence(alphabet):
    rng = np.random.default_rng(alphabet)
    codes = rng.integers(0, alphabet, 3000)
    lengths = rng.integers(1, 13, 200)
    words = np.zeros((200, 16), np.int64)
    for w, n in zip(words, lengths, strict=True):
        at = rng.integers(0, 3000 - n)
        w[:n] = np.maximum(codes[at : at + n], 1)
    index = sentence_pieces.SuffixIndex(codes, alphabet - 1, 12)
    lo, hi = index.find(words, lengths)
    for w, n, a, b in zip(words, lengths, lo, hi, strict=True):
        want = [i for i in range(3001 - n) if (codes[i : i + n] == w[:n]).all()]
        assert sorted(index.order[a:b]) == want


def test_encode_decode_and_digest_on_odd_rows(odd_docs, no_docs):
    got = sentence_pieces.decode(sentence_pieces.encode(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert r["ids"] == (None if r["text"] is None else processor().encode(r["text"]))
        assert r["decoded"] == r["text"]
    for r in sentence_pieces.digest(odd_docs).collect():
        if r["text"] is not None:
            ids = np.array(processor().encode(r["text"]), np.int32)
            assert (r["n_tokens"], r["ids_crc32"], r["round_trip"]) == (len(ids), zlib.crc32(ids.tobytes()), True)
    assert sentence_pieces.encode(no_docs).count() == 0


def test_columns_of_the_added_names_are_replaced(spark):
    df = spark.createDataFrame([("one two", 1, 2, 3, 4, 5, True, 6), (None, 1, 2, 3, 4, 5, True, 6)], "text string, ids int, n_tokens int, cut_text int, prefix_tokens int, ids_crc32 int, round_trip boolean, decoded int")
    with_ids = sentence_pieces.encode(df)
    assert set(with_ids.columns) == set(df.columns) and with_ids.schema["ids"].dataType.typeName() == "array"
    assert [r["decoded"] for r in sentence_pieces.decode(with_ids).collect()] == ["one two", None]
    got = sentence_pieces.digest(df).collect()
    assert got[0]["n_tokens"] == len(with_ids.collect()[0]["ids"]) and got[0]["round_trip"] is True and got[0]["ids"] == 1
    assert [r["cut_text"] for r in token_counts.truncate(df, 1).collect()] == ["one", ""]
    assert token_counts.prefix_table(df).collect()[0]["prefix_tokens"][-1] == 2


def test_memory_of_a_very_long_text_is_bounded():
    """A worker that encodes a text of two million characters."""
    import subprocess
    import sys

    code = """
import random, resource, numpy
from logweave.llm import sentence_pieces as op
rng = random.Random(1)
words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 12))) for _ in range(60000)]
text = " ".join(rng.choice(words) for _ in range(270000))
p = op.pieces(op.tokenizer_path(op.MODEL))
import sentencepiece
got = numpy.frombuffer(p.encode([text])[0], numpy.int32).tolist()
print(len(text), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
assert got == sentencepiece.SentencePieceProcessor(model_file=op.tokenizer_path(op.MODEL)).encode(text)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 1_900_000 and int(out[1]) < 400


def test_spans_of_the_index_meet(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcde thr ") for _ in range(4000))
    want = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.tokenizer_path(sentence_pieces.MODEL)).encode(text)
    monkeypatch.setattr(sentence_pieces, "INDEX_CHARS", 97)
    monkeypatch.setattr(sentence_pieces, "EDGES", 13)
    p = sentence_pieces.Pieces(sentence_pieces.tokenizer_path(sentence_pieces.MODEL))
    assert np.frombuffer(p.encode([text])[0], np.int32).tolist() == want
