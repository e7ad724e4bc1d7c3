"""Cosine similarity (C1), exact threshold self-join by blocks (C2) and an
approximate join by random projections (D4).

The exact join cuts vectors into blocks of bounded size by their angle to a
pivot; blocks that can hold similar vectors become one group via an
equi-key, and inside a group numpy computes the similarity matrix in bounded
chunks, re-checks candidates in bounded batches and emits the pairs at or above
the threshold, or only a spanning forest of them.  Each group holds at most
two blocks, whatever the data skew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR_SCHEMA = "i long, j long, cosine double"
#: Cells of angles in which blocks are looked up.
ANGLE = 0.02


def cosine(a, b) -> Column:
    """C1 on two ``array<float>`` columns: float products summed in double,
    divided by the product of the square-rooted sums of squares; 0.0 on
    NULL input, length mismatch or a zero norm."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b

    def dsum(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)

    denom = F.sqrt(dsum(a, a)) * F.sqrt(dsum(b, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b))
    return F.when(ok & (denom != 0), dsum(a, b) / denom).otherwise(F.lit(0.0))


def _java_cos_rows(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """Row-wise cosine of A[k] and B[k] with float products and sequential
    double sums (the exact arithmetic of C1)."""
    dot = np.cumsum((A * B).astype(np.float64), axis=1)[:, -1]
    ma = np.cumsum((A * A).astype(np.float64), axis=1)[:, -1]
    mb = np.cumsum((B * B).astype(np.float64), axis=1)[:, -1]
    den = np.sqrt(ma) * np.sqrt(mb)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(den == 0.0, 0.0, dot / den)


#: Blocks that a block meets at most, and rows to which blocks grow for that.
MEETS, MOST = 24, 1 << 15
# Cells of a similarity matrix, and candidate pairs re-checked, at a time.
CHUNK_CELLS, CHUNK_PAIRS = 1 << 21, 1 << 14
#: Rows and columns of a similarity matrix counted at a time: few enough for a processor's cache.
TILE = 256, 512


def _roots(parent: np.ndarray) -> np.ndarray:
    """Every node's root, all paths cut short."""
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double (zeros for none), and of which vectors no float
    product overflows or is lost, so that a cosine in double is within 1e-6 of
    the exact arithmetic."""
    v = v.astype(np.float64)
    norm = np.sqrt((v ** 2).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(v / norm[:, None], nan=0.0, posinf=0.0, neginf=0.0), (norm > 1e-15) & (norm < 1e15)


def _agreeing(ka: np.ndarray, kb: np.ndarray):
    """A function of a range of rows of ``ka``: which of them have a key in
    common with which rows of ``kb``, in the same column.

    If keys have few values, each value's rows of ``kb`` are kept as bits, so that a
    column costs a bit for each pair of rows."""
    n, values = len(kb), int(max(ka.max(initial=0), kb.max(initial=0))) + 1
    if 2 * values > len(ka):

        def compared(a: int, z: int) -> np.ndarray:
            seen = np.zeros((z - a, n), bool)
            for left, right in zip(ka[a:z].T, kb.T, strict=True):
                seen |= left[:, None] == right[None, :]
            return seen

        return compared
    all_values = np.arange(values, dtype=kb.dtype)[:, None]
    bits = [np.packbits(column[None, :] == all_values, axis=1) for column in kb.T]

    def looked_up(a: int, z: int) -> np.ndarray:
        seen = np.zeros((z - a, -(-n // 8)), np.uint8)
        for left, of_value in zip(ka[a:z].T, bits, strict=True):
            seen |= of_value.take(left, axis=0)
        return np.unpackbits(seen, axis=1, count=n).view(bool)

    return looked_up


def _count(A: np.ndarray, B: np.ndarray, ia: np.ndarray, ib: np.ndarray, diag: bool, threshold: float, keys=None) -> int:
    """How many pairs of rows of both blocks, or of one (``diag``, A and B the
    same), are at or above the threshold.  With ``keys``, a row of keys for each
    row of A and of B, pairs that agree in any of their keys are left out.

    Products are floats; ``slack`` is more than their rounding can make.  Pairs
    that are nearer to the threshold are re-checked with the exact arithmetic, and
    so are those of lengths that float products can't hold."""
    if diag:  # in order of ids a pair lies above the diagonal
        order = np.argsort(ia, kind="stable")
        A = B = A[order]
        ia = ib = ia[order]
        keys = keys and (keys[0][order],) * 2
    slack = 1e-6 + (A.shape[1] + 8) * 2.0 ** -23
    UA, plain_a = _unit(A)
    UB, plain_b = (UA, plain_a) if diag else _unit(B)
    UA, UB = UA.astype(np.float32), np.ascontiguousarray(UB.T, np.float32)
    plain = bool(plain_a.all() and plain_b.all())
    total, (high, wide) = 0, TILE
    for b in range(0, len(B), wide):
        y = min(b + wide, len(B))
        agree = _agreeing(keys[0], keys[1][b:y]) if keys else None
        for a in range(0, y if diag else len(A), high):
            z = min(a + high, len(A))
            S = UA[a:z] @ UB[:, b:y]
            near = S >= threshold - slack
            if diag and b < np.searchsorted(ib, ia[z - 1], "right"):
                near &= ia[a:z, None] < ib[None, b:y]
            if agree:
                near &= ~agree(a, z)
            sure = S >= threshold + slack
            sure &= near
            if not plain:
                sure &= plain_a[a:z, None] & plain_b[None, b:y]
            n = int(np.count_nonzero(sure))
            total += n
            if np.count_nonzero(near) == n:
                continue
            near &= ~sure
            rows, cols = np.divmod(np.flatnonzero(near), y - b)  # several times as fast as np.nonzero
            for k in range(0, len(rows), CHUNK_PAIRS):
                cos = _java_cos_rows(A[a + rows[k:k + CHUNK_PAIRS]], B[b + cols[k:k + CHUNK_PAIRS]])
                total += int(np.count_nonzero(cos >= threshold))
    return total


def _block_parts(threshold: float, forest: bool = False, count: bool = False, two_sides: bool = False, keys=None):
    """Pairs at or above the threshold within one or two blocks, in frames of
    ``CHUNK_PAIRS`` candidates; with ``forest`` only pairs that join two trees
    so far, at most one for each row, which have the same components; with
    ``count`` only their number (``n``).  With ``two_sides`` a block without a
    partner has no pairs.  ``keys(A)`` gives a row of keys for each row; pairs
    that agree in one are left out."""
    slack = 1e-6  # candidates by float64 matmul, then the exact re-check

    def fn(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        left = pdf[pdf["_side"] == 0]
        right = pdf[pdf["_side"] == 1]
        diag = right.empty
        if left.empty or (diag and two_sides):
            if count:
                yield pd.DataFrame({"n": [0]})
            return
        if diag:
            right = left
        A = np.stack(left["_v"].to_numpy()).astype(np.float32)
        B = A if diag else np.stack(right["_v"].to_numpy()).astype(np.float32)
        ia = left["_id"].to_numpy(dtype=np.int64)
        ib = right["_id"].to_numpy(dtype=np.int64)
        ka = keys(A) if keys else None
        kb = ka if diag or ka is None else keys(B)
        if count:
            yield pd.DataFrame({"n": [_count(A, B, ia, ib, diag, threshold, None if ka is None else (ka, kb))]})
            return
        UA, _ = _unit(A)
        UB = UA if diag else _unit(B)[0]
        # Trees over both blocks' rows; a row of B follows the rows of A.
        parent = np.arange(len(A) + (0 if diag else len(B)))
        shift = 0 if diag else len(A)
        step = max(1, CHUNK_CELLS // len(B))
        for lo in range(0, len(A), step):
            rows, cols = np.nonzero(UA[lo:lo + step] @ UB.T >= threshold - slack)
            rows = (rows + lo).astype(np.int32)
            cols = cols.astype(np.int32)
            if diag:
                keep = ia[rows] < ib[cols]
                rows, cols = rows[keep], cols[keep]
            for a in range(0, len(rows), CHUNK_PAIRS):
                r, c = rows[a:a + CHUNK_PAIRS], cols[a:a + CHUNK_PAIRS]
                if ka is not None:
                    keep = ~(ka[r] == kb[c]).any(axis=1)
                    r, c = r[keep], c[keep]
                if forest:
                    parent = _roots(parent)
                    apart = parent[r] != parent[c + shift]
                    r, c = r[apart], c[apart]
                if not r.size:
                    continue
                cos = _java_cos_rows(A[r], B[c])
                keep = cos >= threshold
                r, c, cos = r[keep], c[keep], cos[keep]
                if forest:
                    joins = []
                    for k, (x, y) in enumerate(zip(r.tolist(), (c + shift).tolist(), strict=True)):
                        while parent[x] != x:
                            x = parent[x]
                        while parent[y] != y:
                            y = parent[y]
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                            joins.append(k)
                    r, c, cos = r[joins], c[joins], cos[joins]
                yield pd.DataFrame({"i": np.minimum(ia[r], ib[c]), "j": np.maximum(ia[r], ib[c]), "cosine": cos})

    return fn


def _block_pairs(threshold: float, forest: bool = False, count: bool = False, two_sides: bool = False):
    """``_block_parts`` as one frame."""
    parts = _block_parts(threshold, forest, count, two_sides)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = list(parts(pdf))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(
            {"i": pd.Series([], dtype="int64"), "j": pd.Series([], dtype="int64"), "cosine": pd.Series([], dtype="float64")})

    return fn


def _streamed(parts):
    """``parts`` for ``applyInPandas``: a group's rows are held, its pairs are not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from parts(pd.concat(list(batches), ignore_index=True))

    return run


def _pair_groups(v: DataFrame, nb, key: list[str]) -> DataFrame:
    """Replicate vectors ``(_id, _v, _b)`` into block-pair groups: block
    ``b`` goes left to ``(b, b..nb-1)`` and right to ``(0..b-1, b)``, within
    each ``key`` group (``nb`` may be a column)."""
    return _ranged_groups(v.withColumn("_to", nb - 1).withColumn("_from", F.lit(0)), key)


def _ranged_groups(v: DataFrame, key: list[str]) -> DataFrame:
    """As ``_pair_groups``, but block ``b`` only meets blocks ``_from`` to
    ``_to``."""
    left = v.select(*key, "_id", "_v", F.lit(0).alias("_side"), F.col("_b").alias("_bi"),
                    F.explode(F.sequence(F.col("_b"), F.col("_to"))).alias("_bj"))
    right = v.where(F.col("_b") > F.col("_from")).select(
        *key, "_id", "_v", F.lit(1).alias("_side"),
        F.explode(F.sequence(F.col("_from"), F.col("_b") - 1)).alias("_bi"), F.col("_b").alias("_bj"))
    return left.unionByName(right)


def _by_angle(v: DataFrame, threshold: float, block_size: int) -> DataFrame:
    """Blocks of vectors in order of their angle to a pivot, with the range
    of blocks each has to meet.

    Two vectors whose angles to the pivot differ by more than
    ``acos(threshold)`` are further apart than the threshold (triangle
    inequality on the sphere), so blocks that lie wholly beyond are never
    paired; nothing is lost.  Blocks are cut by a distributed row number, so
    equal angles don't swell one."""
    from .components import global_row_number

    pivot = v.orderBy("_id").select("_v").first()["_v"]
    p = F.array(*[F.lit(float(x)).cast("float") for x in pivot])
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("_v"), p))))
    ranked = global_row_number(v.withColumn("_angle", angle), ["_angle", "_id"], "_n")
    cut = ranked.withColumn("_b", F.floor((F.col("_n") - 1) / block_size).cast("int")).drop("_n")
    # A float cosine is off by up to 5e-7, and the angle of a vector near the
    # pivot by the root of twice that, 1e-3; two angles are compared.
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 2e-3
    blocks = cut.groupBy("_b").agg(F.min("_angle").alias("_low"), F.max("_angle").alias("_high"))
    # The least and the greatest block in every cell of angles: a few hundred rows, whatever the input.
    cell = lambda x: F.floor(x / ANGLE).cast("int")
    cells = blocks.select("_b", F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high")))).alias("_cell")).groupBy("_cell").agg(
        F.min("_b").alias("_from"), F.max("_b").alias("_to"))
    near = blocks.select("_b", F.explode(F.sequence(cell(F.col("_low") - reach), cell(F.col("_high") + reach))).alias("_cell"))
    span = near.join(cells, "_cell").groupBy("_b").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    return cut.drop("_angle").join(span, "_b")


def similar_pairs(vectors: DataFrame, id_col: str, vec_col: str, threshold: float,
                  block_size: int = 2048, n_vectors: int | None = None, forest: bool = False) -> DataFrame:
    """All pairs ``i < j`` with ``cosine >= threshold`` (exact).

    ``id_col`` must be a unique bigint key.  Vectors are cut into blocks of
    ``block_size`` or more (at most ``MEETS`` blocks up to ``MOST`` rows, so
    that a vector is sent ``MEETS`` times, whatever the input, up to ``MEETS *
    MOST`` vectors) by their angle to a pivot; block ``b`` meets, as left or right, the blocks whose angles are within ``acos(threshold)``, so every
    pair that can reach the threshold meets in exactly one group and each
    group holds at most two blocks.

    ``forest=True`` returns, of each group, a spanning forest of its
    similar pairs instead of all of them (at most as many edges as rows):
    the same connected components without a table of all pairs.
    """
    groups = _block_groups(vectors, id_col, vec_col, threshold, block_size, n_vectors)
    return groups.groupBy("_bi", "_bj").applyInPandas(_streamed(_block_parts(float(threshold), forest)), PAIR_SCHEMA)


def count_similar_pairs(vectors: DataFrame, id_col: str, vec_col: str, threshold: float,
                        block_size: int = 2048, n_vectors: int | None = None) -> DataFrame:
    """The number ``n`` of the pairs of ``similar_pairs``, in one row, without
    a row for any of them: every group of blocks returns its count."""
    groups = _block_groups(vectors, id_col, vec_col, threshold, block_size, n_vectors)
    counts = groups.groupBy("_bi", "_bj").applyInPandas(_block_pairs(float(threshold), count=True), "n long")
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def similar_between(left: DataFrame, right: DataFrame, id_col: str, vec_col: str, threshold: float,
                    block_size: int = 2048, forest: bool = False) -> DataFrame:
    """As ``similar_pairs``, of each vector of ``left`` with each of
    ``right`` (ids in both differ): for vectors that come in later."""
    from ..session import ship_package

    ship_package(left.sparkSession)

    def blocks(df):
        v = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v")).where(F.col("_v").isNotNull())
        n = max(1, -(-v.count() // block_size))
        return v.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")), n

    (a, na), (b, nb) = blocks(left), blocks(right)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    groups = a.select("_id", "_v", F.lit(0).alias("_side"), F.col("_b").alias("_bi"), all_of(nb).alias("_bj")).unionByName(
        b.select("_id", "_v", F.lit(1).alias("_side"), all_of(na).alias("_bi"), F.col("_b").alias("_bj")))
    return groups.groupBy("_bi", "_bj").applyInPandas(_block_pairs(float(threshold), forest, two_sides=True), PAIR_SCHEMA)


def _block_groups(vectors: DataFrame, id_col: str, vec_col: str, threshold: float, block_size: int, n_vectors: int | None) -> DataFrame:
    """``(_id, _v, _side, _bi, _bj)``: the blocks that meet, as groups."""
    from ..session import ship_package

    ship_package(vectors.sparkSession)
    n = n_vectors if n_vectors is not None else vectors.count()
    v = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_v")).where(
        F.col("_v").isNotNull()
    )
    if n <= block_size:
        return _pair_groups(v.withColumn("_b", F.lit(0)), F.lit(1), [])
    return _ranged_groups(_by_angle(v, threshold, max(block_size, min(MOST, -(-n // MEETS)))), [])


def bands_for(threshold: float, recall: float, bits: int) -> int:
    """Bands of ``bits`` signs each, so that a pair at the threshold shares
    one with probability ``recall``: a random plane has both on one side with
    probability ``1 - angle / pi``."""
    one = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if one >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))


def _signs(v: np.ndarray, bands: int, bits: int, seed: int, first: int | None = None) -> np.ndarray:
    """For each vector and band, or the ``first`` of them, the signs of ``bits``
    random projections, packed into the smallest kind of number."""
    first = bands if first is None else first
    planes = np.random.default_rng(seed).standard_normal((v.shape[1], bands * bits))[:, :first * bits]
    out = np.zeros((len(v), first), np.min_scalar_type((1 << bits) - 1))
    for a in range(0, len(v), 4096):
        part = v[a:a + 4096]
        up = (part.astype(np.float64) @ planes > 0).reshape(len(part), first, bits)
        for k in range(bits):
            out[a:a + 4096] |= up[:, :, k].astype(out.dtype) << out.dtype.type(k)
    return out


def band_keys(v: np.ndarray, bands: int, bits: int, seed: int) -> np.ndarray:
    """For each vector and band the signs of ``bits`` random projections,
    packed into a number that holds the band too."""
    return _signs(v, bands, bits, seed).astype(np.int64) + (np.arange(bands, dtype=np.int64) << bits)


def similar_pairs_approx(vectors: DataFrame, id_col: str, vec_col: str, threshold: float, recall: float = 0.95,
                         bits: int = 12, seed: int = 7, block_size: int = 2048, forest: bool = False, count: bool = False) -> DataFrame:
    """Approximate pairs by sign random projections with a designed recall.

    Vectors are compared that share one of ``bands_for(threshold, recall,
    bits)`` bands of ``bits`` signs.  A pair at the threshold is found with
    probability ``recall``, one above it with more; more bits compare less, at
    the price of more bands.  ``approx_recall`` measures what was found.

    The band is used as a blocking key, not joined with itself: inside a
    bucket the vectors are paired exactly like ``similar_pairs``, in sub-blocks
    of at most ``MOST`` (or ``block_size``, if more), so a bucket holding a third
    of all vectors still yields bounded groups; small buckets share groups of
    about two blocks.  A pair that shares several bands is returned by the first
    of them only, so no pairs are shuffled to find those that came twice.  Every
    returned pair is re-checked with the exact cosine, so none is below the
    threshold.

    ``count=True`` returns only the number ``n`` of these pairs, in one row:
    every group compares and re-checks the same pairs and returns its count.
    """
    from ..session import ship_package

    ship_package(vectors.sparkSession)
    bands = bands_for(threshold, recall, bits)
    norm = F.aggregate(F.col(vec_col), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    v = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<float>").alias("_v")).where(norm > 0)

    def run(frames):
        for frame in frames:
            for a in range(0, len(frame), 1024):
                part = frame.iloc[a:a + 1024]
                yield part.assign(_keys=list(band_keys(np.stack(part["_v"].to_numpy()), bands, bits, seed)))

    keyed = v.mapInPandas(run, "_id long, _v array<float>, _keys array<long>").select("_id", "_v", F.explode("_keys").alias("_key"))
    n = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sizes = n.select("_key", "_n", F.ceil(F.col("_n") / F.lit(max(block_size, MOST))).cast("int").alias("_nb"))
    if bands << bits <= 100_000:  # so many keys at most, whatever the input
        sizes = F.broadcast(sizes)
    packs = F.greatest(F.lit(1), F.ceil(n.select(F.sum("_n")).scalar() / F.lit(2 * block_size)))
    placed = keyed.join(sizes, "_key").withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_nb").cast("long")).cast("int"))
    pack = F.when(F.col("_nb") == 1, F.pmod(F.xxhash64("_key"), packs)).otherwise(F.xxhash64("_key"))
    groups = _pair_groups(placed.withColumn("_pack", pack), F.col("_nb"), ["_pack", "_key"])

    def parts(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        n = 0
        for key, f in frame.groupby("_key", sort=False):
            earlier = partial(_signs, bands=bands, bits=bits, seed=seed, first=int(key) >> bits)
            found = _block_parts(float(threshold), forest, count, keys=earlier)(f)
            if count:
                n += sum(int(x["n"].iloc[0]) for x in found)
            else:
                yield from found
        if count:
            yield pd.DataFrame({"n": [n]})

    grouped = groups.groupBy("_pack", "_bi", "_bj")
    if count:
        return grouped.applyInPandas(_streamed(parts), "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return grouped.applyInPandas(_streamed(parts), PAIR_SCHEMA)


def approx_quality(vectors: DataFrame, pairs: DataFrame, id_col: str, vec_col: str, threshold: float,
                   block_size: int = 2048, n_vectors: int | None = None) -> DataFrame:
    """``pairs`` of ``similar_pairs_approx``, or their number (``count=True``),
    against all of ``similar_pairs``, in one row ``(n_exact, n_false, n_found)``.

    Pairs come once each and with their exact cosine, which says whether
    ``similar_pairs`` has them: both are counted where they are made, and no
    pair is shuffled, sorted or written.  Pairs that come as a number were held
    to the threshold by the exact arithmetic before they were counted."""
    exact = count_similar_pairs(vectors, id_col, vec_col, threshold, block_size, n_vectors).select(F.col("n").alias("n_exact"))
    if pairs.columns == ["n"]:
        return exact.crossJoin(pairs.select(F.lit(0).cast("long").alias("n_false"), F.col("n").alias("n_found")))
    right = F.coalesce((F.col("cosine") >= F.lit(float(threshold))) & (F.col("i") <= F.col("j")), F.lit(False))
    found = pairs.agg(F.count_if(~right).alias("n_false"), F.count_if(right).alias("n_found"))
    return exact.crossJoin(found)


def approx_recall(vectors: DataFrame, pairs: DataFrame, id_col: str, vec_col: str, threshold: float, sample: int = 200) -> DataFrame:
    """How much of the similar pairs ``pairs`` holds, as a table of one row
    ``(sampled, exact_pairs, found_pairs, recall)``: ``sample`` vectors, those of
    the least hashes of their ids, are compared with all others."""
    from ..session import ship_package

    ship_package(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<float>").alias("_v")).where(F.col("_v").isNotNull())
    some = v.orderBy(F.xxhash64("_id", F.lit(41)), "_id").limit(sample).collect()  # at most ``sample``
    ids, probe = np.array([r["_id"] for r in some], np.int64), [np.array(r["_v"], np.float32) for r in some]

    def run(frames):
        for frame in frames:
            for a in range(0, len(frame), 1024):
                part = frame.iloc[a:a + 1024]
                own, rows = part["_id"].to_numpy(), np.stack(part["_v"].to_numpy()).astype(np.float32)
                for i, x in zip(ids.tolist(), probe, strict=True):
                    near = (_java_cos_rows(rows, np.broadcast_to(x, rows.shape)) >= threshold) & (own != i)
                    yield pd.DataFrame({"i": np.minimum(own[near], i), "j": np.maximum(own[near], i)})

    exact = v.mapInPandas(run, "i long, j long").distinct()
    both = exact.join(pairs.select("i", "j", F.lit(1).alias("_f")), ["i", "j"], "left")
    n = both.agg(F.count(F.lit(1)).alias("exact_pairs"), F.count("_f").alias("found_pairs"))
    return n.select(F.lit(len(some)).cast("long").alias("sampled"), "exact_pairs", "found_pairs", F.coalesce(F.try_divide("found_pairs", "exact_pairs"), F.lit(1.0)).alias("recall"))
