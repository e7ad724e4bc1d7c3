"""Token counts of a byte-level BPE by dynamic programming over prefixes.

BPE has a property that makes counting cheap: a sequence of tokens is the
encoding of its bytes if and only if each two neighbours are the encoding of
theirs.  So every prefix of a piece has exactly one last token: the one that
ends there and agrees with the last token of the prefix before it.  One pass
over the bytes gives that token, and with it the exact count, for every prefix;
truncation and budget questions are then look-ups and nothing is encoded again.

A text is cut into special strings and, between them, into pieces by the
tokenizer's own pattern; a table is made once for each different piece a worker
meets (bounded).  Counts of prefixes that end inside a run of white space, a
contraction or a special string follow the cut text, not the whole one.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows
stay; an empty table gives no rows; other columns are ignored by the counts and
carried along by ``prefix_table`` and ``truncate``, which replace a column of the
name that they add; texts of any
length are processed whole, in time in proportion to their length.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, read_table, slices, tidy, utf8_bytes, with_workers

TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: the pattern of this kind of tokenizer.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes of remembered pieces and pairs.
PIECES, PAIRS = 64 << 20, 40 << 20
NONE, NO_RANK = -1, 1 << 60
EARLY = re.compile(r"[\x00-\u04FF]*").fullmatch
LATE, category = regex.compile(r"[^\x00-\u04FF]").findall, unicodedata.ucd_3_2_0.category


def early_pattern() -> re.Pattern:
    """PIECE for texts below U+0500, with its classes spelled out, so that the
    standard library's faster matcher can run it."""

    def ranges(kind: str) -> str:
        hit = [c for c in range(0x500) if unicodedata.category(chr(c)).startswith(kind)]
        return "".join(re.escape(chr(c)) for c in hit)

    space, letters, numbers = r"\t-\r \x85\xa0", ranges("L"), ranges("N")
    new = PIECE.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\P{White_Space}", f"[^{space}]")
    return re.compile(new.replace(r"\p{White_Space}", f"[{space}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))


def tokenizer_path(name: str) -> str:
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in files of byte-level BPE:
    printable Latin-1 stands for itself, the rest for U+0100 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact counts of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.tokens = {i: b for b, i in self.ids.items()} | {NONE: b""}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.trie: dict = {}
        for b, i in self.ids.items():
            node = self.trie
            for x in b:
                node = node.setdefault(x, {})
            node[NONE] = i
        self.own_pieces = regex.compile(PIECE).findall
        self.early_pieces = early_pattern().findall
        self.path = path
        self.runs = regex.compile(r"\p{White_Space}+").finditer
        self.tail = regex.compile(r"\p{White_Space}*[^\p{White_Space}\p{L}\p{N}]*$")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.agrees = Memo(self._agrees, PAIRS)
        self.counts = Memo(lambda piece: self.table(piece.encode())[-1], PIECES)

    def _merged(self, data: bytes) -> list[bytes]:
        """BPE of a few bytes by its definition: the best-ranked pair first."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            by_rank = [ranks.get(p, NO_RANK) for p in zip(parts, parts[1:], strict=False)]
            rank = min(by_rank)
            if rank == NO_RANK:
                break
            at = by_rank.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _agrees(self, pair: int) -> bool:
        """Whether two tokens side by side (none before the first) are the
        encoding of their bytes."""
        a, b = self.tokens[(pair >> 32) - 1], self.tokens[pair & 0xFFFFFFFF]
        return self._merged(a + b) == ([a, b] if a else [b])

    def table(self, data: bytes) -> array:
        """Token count of every prefix of a piece, from 0 bytes to all."""
        n, trie, agrees = len(data), self.trie, self.agrees
        last = [-2] * (n + 1)
        last[0] = NONE
        counts = array("l", bytes(8 * (n + 1)))
        for i in range(n):
            node, before, c = trie, last[i] + 1 << 32, counts[i] + 1
            for j in range(i, n):
                node = node.get(data[j])
                if node is None:
                    break
                if last[j + 1] == -2 and NONE in node and agrees[before | node[NONE]]:
                    last[j + 1], counts[j + 1] = node[NONE], c
        return counts

    def pieces(self, chunk: str) -> list[str]:
        """Pieces by our pattern; by the library's own for a text with
        characters younger than Unicode 3.2, whose class differs by version."""
        if EARLY(chunk):
            return self.early_pieces(chunk)
        if not any(category(c) == "Cn" for c in set(LATE(chunk))):
            return self.own_pieces(chunk)
        return [chunk[a:b] for _, (a, b) in splitter(self.path).pre_tokenize_str(chunk)]

    def _chunks(self, text: str) -> list[str]:
        """Ordinary text at even places, special strings at odd ones."""
        return self.specials.split(text) if self.specials and any(s in text for s in self.special) else [text]

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entries of its pieces' tables."""
        chunks = self._chunks(text)
        last = self.counts.__getitem__
        return sum(sum(map(last, self.pieces(c))) for c in chunks[::2]) + len(chunks) // 2

    def prefix_counts(self, text: str) -> array:
        """Tokens of every prefix of the text, by characters from 0 to all."""
        out = array("l", [0])
        ordinary = ""
        for k, chunk in enumerate(self._chunks(text)):
            start = len(out) - 1
            if k % 2:  # cut inside it, the string is ordinary and joins what stands before
                tail = self.tail.search(ordinary).group()
                base = out[start - len(tail)]
                out.extend(base + sum(map(self.counts.__getitem__, self.pieces(tail + chunk[:j]))) for j in range(1, len(chunk)))
                out.append(out[start] + 1)
                continue
            ordinary = chunk
            for piece in self.pieces(chunk):
                base = out[-1]
                at = list(accumulate((len(c.encode()) for c in piece)))
                table = self.table(piece.encode())
                out.extend(base + table[b] for b in at)
                if piece in ("'re", "'ve", "'ll"):
                    out[-2] = base + 2  # cut there, the contraction is two pieces
            ends = out[:]
            for m in self.runs(chunk):
                s, e = start + m.start(), start + m.end()
                table, b = self.table(m.group().encode()), 0
                for i in range(s, e):
                    b += len(text[i].encode())
                    ends[i + 1] = out[s] + table[b]
            out = ends
        return out

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        counts = self.prefix_counts(text)
        return max(i for i, c in enumerate(counts) if c <= budget)


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


@cache
def splitter(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).pre_tokenizer


def _mapped(df: DataFrame, text: str, name: str, kind: T.DataType, arrow: pa.DataType, make, path: str) -> DataFrame:
    """``df`` with a column made from each text by a worker's counter, in
    place of one of the same name."""
    with_workers(df.sparkSession)
    at, names = df.columns.index(text), df.columns
    keep = [i for i, c in enumerate(names) if c != name]

    def run(batches):
        for batch in slices(batches):
            made = pa.array([make("" if x is None else x) for x in batch.column(at).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], made], [*[names[i] for i in keep], name])

    return df.mapInArrow(tidy(run), T.StructType([*[df.schema.fields[i] for i in keep], T.StructField(name, kind)]))


def token_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 512, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    path = tokenizer_path(tokenizer)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    got = _counted(rows, path)
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _counted(rows: DataFrame, path: str) -> DataFrame:
    with_workers(rows.sparkSession)

    def run(batches):
        count = counter(path).count
        for batch in slices(batches):
            n = pa.array([0 if x is None else count(x) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.select("doc_id", "text", utf8_bytes(F.col("text")).alias("n_bytes")).mapInArrow(tidy(run), schema)


def prefix_table(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` with ``prefix_tokens``: the count of every prefix, by characters."""
    path = tokenizer_path(tokenizer)
    return _mapped(df, text, "prefix_tokens", T.ArrayType(T.LongType()), pa.list_(pa.int64()), lambda x: counter(path).prefix_counts(x).tolist(), path)


def truncate(df: DataFrame, budget: int, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` with ``cut_text``: the longest prefix within the budget."""
    path = tokenizer_path(tokenizer)

    def make(x):
        c = counter(path)
        return x if c.count(x) <= budget and len(x) == 0 else x[: c.cut(x, budget)]

    return _mapped(df, text, "cut_text", T.StringType(), pa.string(), make, path)


def query(spark, sf_dir):
    """Token counts of every whole document."""
    return token_counts(read_table(spark, sf_dir, "documents"))
