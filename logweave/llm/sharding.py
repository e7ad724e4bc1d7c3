"""Sharding by best-fit-decreasing bin packing.

Groups of equal texts are indivisible.  Packed are a bounded number of items,
whatever the input's size:

* a group of at least 1/``FINE`` of a shard is an item of its own (there are at
  most ``FINE`` times the number of shards of them);
* smaller groups are bundled by the hash of their text into bundles of about
  1/16, 1/128 and 1/1024 of a shard, weighed after the fact.

Items sorted by size, descending, enter the bin with the least remaining
capacity that still holds them, found in a balanced tree.  The capacity is the
smallest tried, from an even share upwards, at which no more bins than shards
open.  Only item sizes reach the driver; documents are placed by joins and
numbered by a range sort.

Defined cases: a null text has size ``OVERHEAD`` and a null CRC, and all null
texts are one group; the empty text is another.  A group larger than a shard
cannot keep shards equal and is cut by the hash of doc_id into pieces of about
1/``PIECES`` of a shard; every other group stays whole.  Repeated rows each
take a slot.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import global_row_number
from .common import read_table, save, text_key, unit_hash, utf8_bytes

OVERHEAD, FINE, PIECES = 16, 512, 4
#: Share of the bytes of small groups and the part of a shard that a bundle aims at.
LEVELS = ((0.6, 16), (0.3, 128), (0.1, 1024))


class RoomTree:
    """Bins by (room, bin) in an AA tree: insert, and take the tightest that
    holds a size.  Balanced, so each step costs the logarithm of the bins."""

    class Node:
        __slots__ = ("key", "level", "left", "right")

        def __init__(self, key):
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(t):
        if t.left is not None and t.left.level == t.level:
            low = t.left
            t.left, low.right = low.right, t
            return low
        return t

    @staticmethod
    def _split(t):
        if t.right is not None and t.right.right is not None and t.right.right.level == t.level:
            high = t.right
            t.right, high.left = high.left, t
            high.level += 1
            return high
        return t

    def _insert(self, t, key):
        if t is None:
            return self.Node(key)
        if key < t.key:
            t.left = self._insert(t.left, key)
        else:
            t.right = self._insert(t.right, key)
        return self._split(self._skew(t))

    def _mend(self, t):
        lower = 1 + min(t.left.level if t.left else 0, t.right.level if t.right else 0)
        if lower < t.level:
            t.level = lower
            if t.right is not None and t.right.level > lower:
                t.right.level = lower
        t = self._skew(t)
        if t.right is not None:
            t.right = self._skew(t.right)
            if t.right.right is not None:
                t.right.right = self._skew(t.right.right)
        t = self._split(t)
        if t.right is not None:
            t.right = self._split(t.right)
        return t

    def _delete(self, t, key):
        if key < t.key:
            t.left = self._delete(t.left, key)
        elif key > t.key:
            t.right = self._delete(t.right, key)
        elif t.left is None:
            return t.right
        else:
            last = t.left
            while last.right is not None:
                last = last.right
            t.key = last.key
            t.left = self._delete(t.left, last.key)
        return self._mend(t)

    def insert(self, room: int, no: int) -> None:
        self.root = self._insert(self.root, (room, no))

    def take(self, size: int):
        """Remove and return the (room, bin) of least room >= size, or None."""
        found, t = None, self.root
        while t is not None:
            if t.key >= (size, -1):
                found, t = t.key, t.left
            else:
                t = t.right
        if found is not None:
            self.root = self._delete(self.root, found)
        return found


def best_fit_decreasing(items: list[tuple[str, int]], capacity: int) -> dict[str, int]:
    """Bin of each (name, size); an item above the capacity gets a bin alone."""
    tree, place, opened = RoomTree(), {}, 0
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        room, no = tree.take(size) or (capacity, opened)
        opened += no == opened
        place[name] = no
        if room > size:
            tree.insert(room - size, no)
    return place


def pack(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Least tried capacity at which the items fit into ``shards`` bins."""
    share = math.ceil(sum(s for _, s in items) / shards)
    slack = 1 / 8192
    while True:
        place = best_fit_decreasing(items, max(1, math.ceil(share * (1 + slack))))
        if max(place.values(), default=0) < shards:
            return place
        slack *= 1.5


def measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, size, text_crc32, gkey, rid), written once."""
    t = F.col(text)
    return save(docs.select(
        F.col(doc_id).alias("doc_id"), (utf8_bytes(t) + OVERHEAD).alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        F.coalesce(text_key(t), F.lit(b"null")).alias("gkey"), F.monotonically_increasing_id().alias("rid"),
    ))


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slots count from
    0 in each shard, by text and doc_id."""
    spark = docs.sparkSession
    rows = measured(docs, doc_id, text)
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = max(1, math.ceil(total / shards))
    groups = rows.groupBy("gkey").agg(F.sum("size").alias("bytes"))
    # At most FINE * shards rows, as their sizes add up to no more than all.
    large = save(groups.where(F.col("bytes") >= math.ceil(share / FINE)).select(
        "gkey", F.when(F.col("bytes") > share, F.ceil(F.col("bytes") * PIECES / share)).otherwise(1).cast("int").alias("pieces"),
    ))
    marked = rows.join(F.broadcast(large), "gkey", "left")
    piece = F.pmod(F.xxhash64("doc_id"), F.col("pieces").cast("long"))
    u, v = unit_hash("gkey", seed=1), unit_hash("gkey", seed=2)
    bundle, upto = None, 0.0
    for k, (part, of) in enumerate(LEVELS):
        upto += part
        name = F.concat(F.lit(f"b{k}:"), F.floor(v * max(1, math.ceil(part * shards * of))))
        bundle = F.when(u < upto, name) if bundle is None else bundle.when(u < upto, name) if k < len(LEVELS) - 1 else bundle.otherwise(name)
    item = F.when(F.col("pieces").isNull(), bundle).otherwise(F.concat(F.lower(F.hex("gkey")), F.lit(":"), piece))
    placed = save(marked.select("doc_id", "size", "text_crc32", "gkey", "rid", item.alias("item")))
    # Bounded: FINE * shards groups, their pieces, and the bundles.
    items = [(r["item"], r["bytes"]) for r in placed.groupBy("item").agg(F.sum("size").alias("bytes")).toLocalIterator()]
    where = spark.createDataFrame(list(pack(items, shards).items()), "item string, shard int")
    numbered = global_row_number(placed.join(F.broadcast(where), "item").drop("item"), ["shard", "gkey", "doc_id", "rid"], "no")
    counts = numbered.groupBy("shard").agg(F.min("no").alias("first"))  # one row for each shard
    return numbered.join(F.broadcast(counts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("no") - F.col("first")).alias("slot"))


def query(spark, sf_dir):
    """All documents in 40 shards of near-equal bytes."""
    out = shard(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
