"""SentencePiece encoding and decoding for BPE models with byte fallback.

A batch of texts is cut into segments wherever two characters meet that are
neighbours in no piece, as no piece reaches over such a border and BPE never
merges there.  The segments that the worker has not met are concatenated and
indexed, ``INDEX_CHARS`` characters and the reach of a piece at a time, by a suffix
array, sorted by as many characters as the longest piece has.  Every piece is
binary-searched in it; the ranges of its occurrences are edges from its first
character to the one after its last.  Edges sorted by position are then relaxed: an edge is taken
if the piece that ends where it starts is known and BPE, given the bytes of
both, yields just these two.  That holds for exactly one edge into each
position, as a sequence is BPE's result if and only if each two neighbours
are, so the chain back from a segment's end is the exact encoding.

Characters outside the vocabulary become the bytes of their UTF-8 form.

Defined cases: null text gives null ids, the empty text no ids; repeated rows
stay; an empty table gives no rows; other columns are carried along, but a column of
the name of an added one is replaced.  Texts of
any length are encoded whole.  Decoding gives the text back, but a literal word
mark (U+2581) comes back as a blank, as with the library.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, read_table, slices, tidy, with_workers
from .token_counts import tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Bytes of remembered segments and pairs, characters cut into segments at a
#: time, characters indexed at a time, edges relaxed at a time.
SEGMENTS, PAIRS, BATCH_CHARS, INDEX_CHARS, EDGES = 56 << 20, 40 << 20, 500_000, 200_000, 50_000
#: Rows handled at a time.
SLICE = 500
#: Numbers above all pieces: characters outside the vocabulary, and nothing.
OUTSIDE, NOTHING = 1 << 21, (1 << 22) - 1


class SuffixIndex:
    """Suffix array of ``codes`` (0: matches nothing) by ``depth``
    characters, as packed integer keys of several characters each."""

    def __init__(self, codes: np.ndarray, top: int, depth: int):
        self.bits = max(1, int(top).bit_length())
        self.per_key = max(1, min(depth, 62 // self.bits))
        levels = -(-depth // self.per_key)
        padded = np.concatenate([codes, np.zeros(levels * self.per_key, codes.dtype)]).astype(np.int64)
        n = len(codes)
        keys = []
        for level in range(levels):
            key = np.zeros(n, np.int64)
            for k in range(level * self.per_key, (level + 1) * self.per_key):
                key = (key << self.bits) | padded[k : k + n]
            keys.append(key)
        self.order = np.lexsort(keys[::-1]) if levels > 1 else np.argsort(keys[0], kind="stable")
        self.keys = [k[self.order] for k in keys]

    @staticmethod
    def _bound(key: np.ndarray, value: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of each value within its own range, all at once."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = key[np.minimum(mid, len(key) - 1)]
            up = open_ & ((at <= value) if right else (at < value))
            lo = np.where(up, mid + 1, lo)
            hi = np.where(open_ & ~up, mid, hi)
        return lo

    def find(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range in ``order`` of the suffixes that begin with each word
        (rows of codes, filled up with 0)."""
        n = len(self.order)
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), n, np.int64)
        for level, key in enumerate(self.keys):
            first = level * self.per_key
            here = np.flatnonzero(lengths > first)
            low = np.zeros(len(here), np.int64)
            high = np.zeros(len(here), np.int64)
            for k in range(first, first + self.per_key):
                col = words[here, k] if k < words.shape[1] else np.zeros(len(here), np.int64)
                free = lengths[here] <= k
                low = (low << self.bits) | np.where(free, 0, col)
                high = (high << self.bits) | np.where(free, (1 << self.bits) - 1, col)
            if level == 0:
                lo[here], hi[here] = np.searchsorted(key, low, "left"), np.searchsorted(key, high, "right")
            else:
                a, b = lo[here], hi[here]
                lo[here], hi[here] = self._bound(key, low, a, b, False), self._bound(key, high, a, b, True)
        return lo, hi


class Pieces:
    """A SentencePiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.normalize = sp.normalize
        self.text = {i: sp.id_to_piece(i) for i in ids}
        self.score = {p: sp.get_score(i) for i, p in self.text.items()}
        self.bytes_at = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [p.replace(MARK, " ").encode() for p in map(sp.id_to_piece, range(sp.get_piece_size()))]
        for i in range(len(self.raw)):
            if sp.is_control(i):
                self.raw[i] = b""
        for b, i in enumerate(self.bytes_at):
            self.raw[i] = bytes([b])
        self.ids = np.array(ids)
        self.lengths = np.array([len(self.text[i]) for i in ids])
        self.depth = int(self.lengths.max())
        self.points = np.zeros((len(ids), self.depth), np.int64)
        for r, i in enumerate(ids):
            self.points[r, : self.lengths[r]] = [ord(c) for c in self.text[i]]
        letters = np.unique(self.points[self.points > 0])
        self.points = self.points.astype(np.int32)
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        rows = self.letter[self.points]
        self.joined[rows[:, :-1], rows[:, 1:]] = True
        self.joined[0], self.joined[:, 0] = False, False
        self.agrees = Memo(self._agrees, PAIRS)
        self.encoded: dict[str, bytes] = {}
        self.held = 0

    def _merged(self, text: str) -> list[str]:
        """BPE by its definition: the best-scored pair first, the left one
        among equals."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _agrees(self, pair: int) -> bool:
        left, right = pair >> 22, pair & NOTHING
        if right >= OUTSIDE:  # merges with nothing
            return True
        a, b = "" if left >= OUTSIDE else self.text[left], self.text[right]
        return self._merged(a + b) == ([a, b] if a else [b])

    def _edges(self, codepoints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every piece's every occurrence and of every
        character outside the vocabulary, by position.  0 separates."""
        inside = self.letter[codepoints] > 0
        points = np.unique(codepoints[inside])
        rank = np.zeros(0x110000, np.int32)
        rank[points] = np.arange(1, len(points) + 1)
        words = rank[self.points]
        there = np.flatnonzero(((words > 0) | (self.points == 0)).all(axis=1))
        out = np.flatnonzero(~inside & (codepoints > 0))
        starts, ends, pieces = [out], [out + 1], [np.full(len(out), OUTSIDE)]
        if len(there):
            lengths = self.lengths[there]
            index = SuffixIndex(rank[codepoints], len(points), int(lengths.max()))
            lo, hi = index.find(words[there], lengths)
            n = hi - lo
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            start = index.order[at]
            starts.append(start)
            ends.append(start + np.repeat(lengths, n))
            pieces.append(np.repeat(self.ids[there], n))
        start, end, piece = map(np.concatenate, (starts, ends, pieces))
        by = np.argsort(start, kind="stable")
        return start[by], end[by], piece[by]

    def learn(self, segments: list[str]) -> None:
        """Encode segments and remember them."""
        joined = "\0".join(segments)
        codepoints = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins, at = [], 0
        for s in segments:
            begins.append(at)
            at += len(s) + 1
        # A NUL of the text is a character, not a border: only the borders become 0.
        codes = np.where(codepoints == 0, 0x10FFFF, codepoints).astype(np.int32)
        codes[np.array(begins[1:], dtype=np.int64) - 1] = 0
        last, back = array("i", [-1]) * (at + 1), array("i", [0]) * (at + 1)
        for b in begins:
            last[b] = NOTHING
        agrees = self.agrees
        for a in range(0, len(codes), INDEX_CHARS):
            # Edges that start in this span; a piece may reach beyond it.
            start, end, piece = self._edges(codes[a : a + INDEX_CHARS + self.depth])
            upto = np.searchsorted(start, INDEX_CHARS)
            for k in range(0, upto, EDGES):
                part = slice(k, min(k + EDGES, upto))
                for s, e, p in zip((start[part] + a).tolist(), (end[part] + a).tolist(), piece[part].tolist(), strict=True):
                    left = last[s]
                    if left >= 0 and last[e] < 0 and agrees[left << 22 | p]:
                        last[e], back[e] = p, s
        for b, s in zip(begins, segments, strict=True):
            ids, e = [], b + len(s)
            while e > b:
                a = back[e]
                if last[e] == OUTSIDE:
                    ids += [self.bytes_at[x] for x in reversed(joined[a:e].encode())]
                else:
                    ids.append(last[e])
                e = a
            made = self.encoded[s] = np.array(ids[::-1], np.int32).tobytes()
            self.held += sys.getsizeof(s) + sys.getsizeof(made) + Memo.ENTRY

    def segments(self, texts: list[str]) -> list[list[str]]:
        """Each text cut where no piece has its two neighbours side by side."""
        joined = "".join(texts)
        letters = self.letter[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum([len(t) for t in texts])
        borders = np.flatnonzero(~self.joined[letters[:-1], letters[1:]]) + 1
        borders = np.union1d(borders, np.concatenate([[0], ends]))
        at = borders.tolist()
        cut = [joined[a:b] for a, b in zip(at, at[1:], strict=False)]
        marks = np.searchsorted(borders, np.concatenate([[0], ends])).tolist()
        return [cut[a:b] for a, b in zip(marks, marks[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of every text, as little-endian 32-bit integers."""
        out: list[bytes | None] = []
        for first, upto in _spans(texts):
            cut = self.segments([self.normalize(t or "") for t in texts[first:upto]])
            new = {s for c in cut for s in c if s not in self.encoded}
            if self.held > SEGMENTS:
                self.encoded.clear()
                self.held, new = 0, {s for c in cut for s in c}
            if new:
                self.learn(sorted(new))
            out += [None if t is None else b"".join(map(self.encoded.__getitem__, c)) for t, c in zip(texts[first:upto], cut, strict=True)]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the mark before the first word goes."""
        return b"".join(map(self.raw.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


def _spans(texts: list[str | None]):
    """Runs of texts of about BATCH_CHARS characters together."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t or "") > BATCH_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts)


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _added(df: DataFrame, text: str, fields: list[T.StructField], make, path: str) -> DataFrame:
    """``df`` and columns that ``make`` gives for a list of its values, in
    place of columns of the same names."""
    with_workers(df.sparkSession)
    names = [f.name for f in fields]
    at, keep = df.columns.index(text), [i for i, c in enumerate(df.columns) if c not in names]

    def run(batches):
        for part in slices(batches, SLICE):
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], *make(part.column(at))], [*[df_names[i] for i in keep], *names])

    df_names = df.columns
    return df.mapInArrow(tidy(run), T.StructType([*[df.schema.fields[i] for i in keep], *fields]))


def _id_lists(encoded: list[bytes | None]) -> pa.Array:
    n = np.array([0 if b is None else len(b) // 4 for b in encoded], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.array([b is None for b in encoded] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(b for b in encoded if b), np.int32)))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``df`` with the ids of every text."""
    path = tokenizer_path(model)
    return _added(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], lambda col: [_id_lists(pieces(path).encode(col.to_pylist()))], path)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with the text of every list of ids."""
    path = tokenizer_path(model)
    return _added(df, ids, [T.StructField(text, T.StringType())], lambda col: [pa.array([None if x is None else pieces(path).decode(x) for x in col.to_pylist()], pa.string())], path)


def digest(df: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_crc32`` (of the ids as 32-bit
    little-endian integers) and ``round_trip`` (whether decoding gives the
    text back): what ``encode`` and ``decode`` return, without moving it."""
    path = tokenizer_path(model)

    def make(col):
        p, texts = pieces(path), col.to_pylist()
        got = p.encode(texts)
        back = [None if b is None else p.decode(np.frombuffer(b, np.int32).tolist()) == t for b, t in zip(got, texts, strict=True)]
        return [
            pa.array([None if b is None else len(b) // 4 for b in got], pa.int64()),
            pa.array([None if b is None else zlib.crc32(b) for b in got], pa.int64()),
            pa.array(back, pa.bool_()),
        ]

    return _added(df, text, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())], make, path)


def query(spark, sf_dir):
    """Digest of every document's pieces."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(docs).select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "ids_crc32", "round_trip")
