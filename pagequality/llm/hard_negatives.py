"""Hard-negative mining: exact integer scores by a residue-number-system product, then windowed selection.

Vectors are scaled to integers and packed in blocks of rows and of anchors.  Where a block of each meets

1. the component matrices are taken modulo several small primes, as centred residues, and multiplied in float32:
   a prime is so small, and a run of dimensions so short, that every partial sum stays below 2^24 and is exact;
2. the signed scores are rebuilt from their residues by Chinese remaindering (Garner's mixed radix, centred digits).
   There are as many primes as the largest possible score asks for;
3. each anchor's first few partners so far are kept; a window over those of all tiles selects the result.

Positives need one pass over all pairs of blocks; their scores set the bands that negatives must fall in, a second pass.
A tile is a panel of anchor blocks against a panel of row blocks.  Each tile is a task: it gets every block once, holds its
anchors (up to PANEL_BYTES) and one block of rows at a time, and hands on one list an anchor.

Defined cases: rows with a null id, label or vector, or with any null, NaN or infinite component, take no part.  Of rows
that share an id the one with the least (label, vector) stands for all.  Shorter vectors count as filled up with zeros.
Equal vectors are different rows; ties go to the smaller id.  A positive with a negative score has no negatives, as no
score lies between 50 and 95 percent of it.  An anchor without other rows of its label gives no rows; an empty table gives
an empty result.  Vectors whose scores could pass 2^55 are refused with a ValueError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Residues of at most 510 in size: 64 products of them add up to less than 2^24, so float32 sums are exact.
LARGEST_PRIME = 1021
RUN = 64
LARGEST_SCORE = 1 << 55
#: What a task holds of packed anchors and their lists; row blocks of a tile at most, and tiles for each core if there are enough blocks.
PANEL_BYTES = 32 << 20
PANEL_BLOCKS = 32
TILES_A_CORE = 4
#: Rows of a product done at once, so that its parts stay in the cache.
STRIP = 64
NONE = -(1 << 62)
#: A writer keeps a row group on the heap, and looks at its size after so many rows at first; a reader loads one at a time.
SMALL_GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 4}


@dataclass(frozen=True)
class MiningParams:
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    #: A negative's score lies within these percentages of the positive's.
    low: int = 50
    high: int = 95
    #: Rows of a tile, and anchors.
    row_block: int = 2048
    anchor_block: int = 512


DEFAULT = MiningParams()
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def primes_for(bound: int) -> list[int]:
    """The largest primes up to LARGEST_PRIME whose product tells apart all integers from -bound to bound."""
    out, product, p = [], 1, LARGEST_PRIME
    while product <= 2 * bound + 1:
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
        p -= 1
    return out


def centred(a: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p - 1) / 2 to (p - 1) / 2."""
    r = np.mod(a, p)
    return r - p * (r > p // 2)


def reduced(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` (float32, replaced) less multiples of ``p``: centred residues of integers up to 2^19, close to them up to 2^24."""
    q = x * np.float32(1 / p)
    np.rint(q, out=q)
    q *= np.float32(p)
    x -= q
    return x


def residues(m: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    m = m.astype(np.int64)
    return [centred(m, p).astype(np.float32) for p in primes]


def product(xs: list[np.ndarray], ys: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The exact integer product of two matrices (the second transposed) given by their residues."""
    out = np.zeros((len(xs[0]), len(ys[0])), np.int64)
    for lo in range(0, len(out), STRIP):
        digits, weight, total = [], 1, out[lo: lo + STRIP]
        for p, x, y in zip(primes, xs, ys, strict=True):
            x, r = x[lo: lo + STRIP], np.zeros(total.shape, np.float32)
            for i in range(0, x.shape[1], RUN):
                r += reduced(reduced(x[:, i: i + RUN] @ y[:, i: i + RUN].T, p), p)
            reduced(reduced(r, p), p)
            for q, d in digits:
                inverse = pow(q, -1, p)
                r -= d
                r *= np.float32(inverse - p * (inverse > p // 2))  # at most 1020 * 510
                reduced(r, p)
            digits.append((p, r))
            total += weight * r.astype(np.int64)
            weight *= p
    return out


def scores(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """The exact integer product a b^T, from float32 products modulo each prime."""
    return product(residues(a, primes), residues(b, primes), primes)


def firsts(s: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of each row's k highest allowed scores, the left one first among equals."""
    s = np.where(allowed, s, NONE)
    rows = np.arange(len(s))
    for _ in range(min(k, s.shape[1])):
        at = s[rows, :].argmax(axis=1)
        found = s[rows, at] != NONE
        rows, at = rows[found], at[found]
        if not len(rows):
            return
        yield rows, at
        s[rows, at] = NONE


def _few(allowed: np.ndarray) -> bool:
    return np.count_nonzero(allowed) <= allowed.size // 16


def _candidates(s: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) that hold each row's k highest allowed scores: all allowed ones if they are few."""
    if _few(allowed):
        return np.nonzero(allowed)
    found = list(firsts(s, allowed, k))
    return tuple(np.concatenate([x[j] for x in found]) if found else np.zeros(0, np.int64) for j in (0, 1))


def _keep(best: np.ndarray, ids: np.ndarray, rows: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
    """Puts partners ``i`` of ``rows``, with their scores, into the rows' lists (replaced): highest first, then by id."""
    if not len(rows):
        return
    k, who = best.shape[1], np.unique(rows)
    rows, s, i = (np.concatenate(x) for x in ((np.repeat(who, k), rows), (best[who].ravel(), s), (ids[who].ravel(), i)))
    order = np.lexsort((i, -s, rows))
    rows, s, i = rows[order], s[order], i[order]
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    place = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
    keep = place < k
    best[rows[keep], place[keep]], ids[rows[keep], place[keep]] = s[keep], i[keep]


def _usable(vectors: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """id, label, v of the rows that take part, one an id."""
    v = F.col(f"`{vector_col}`")
    if vectors.select(v).dtypes[0][1] != "array<float>":  # floats stay as they are, at half the width
        v = v.cast("array<double>")
    d = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    d = d.where("id is not null and label is not null and v is not null").where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return d.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")


def _packed(rows: DataFrame, block: Column, dim: int, kind: str, p: MiningParams, extra: list[str]) -> DataFrame:
    """One row a block: its number, and ids, labels, integer components (as ``kind``) and what else is asked for as packed numbers, by id."""

    def piece(b: pa.RecordBatch) -> list[np.ndarray]:
        v = b.column("v")
        m, n = np.zeros((b.num_rows, dim)), np.diff(v.offsets.to_numpy())
        m[np.arange(dim)[None, :] < n[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
        lists = [[[*x, *[-1] * (p.positives - len(x))] for x in b.column(c).to_pylist()] for c in extra]
        return [*(b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label")), np.floor(p.scale * m).astype(kind), *(np.array(x, np.int64) for x in lists)]

    names = ["ids", "labels", "values", *extra]

    def joined(at: int, pieces: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *[pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*pieces, strict=True)]], ["block", *names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pieces = None, []
        for b in batches:
            block = b.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if pieces and block[lo] != at:
                        yield joined(at, pieces)
                        pieces = []
                    at = int(block[lo])
                    pieces.append(piece(b.slice(lo, hi - lo)))
        if pieces:
            yield joined(at, pieces)

    dealt = rows.select(block.cast("int").alias("block"), "id", "label", "v", *extra).repartition("block").sortWithinPartitions("block", "id")
    return dealt.mapInArrow(pack, "block int, " + ", ".join(f"{c} binary" for c in names))


@dataclass(frozen=True)
class _Panels:
    """How many blocks there are of anchors and rows, and how many make a panel."""

    anchors: int
    rows: int
    anchors_each: int
    rows_each: int

    @classmethod
    def of(cls, anchors: int, rows: int, anchor_bytes: int, cores: int) -> _Panels:
        """``anchor_bytes``: what a task holds for a block of anchors."""
        each = max(1, PANEL_BYTES // anchor_bytes)
        tiles = -(-TILES_A_CORE * cores // -(-anchors // each))
        return cls(anchors, rows, each, min(PANEL_BLOCKS, max(1, rows // tiles)))

    @property
    def across(self) -> int:
        return -(-self.rows // self.rows_each)

    @property
    def down(self) -> int:
        return -(-self.anchors // self.anchors_each)


def _tiles(anchors: DataFrame, rows: DataFrame, n: _Panels) -> DataFrame:
    """The blocks of each tile together, those of anchors first: the stated query set against all rows."""
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    right = anchors.withColumn("of", F.lit(0)).withColumn("panel", every(n.across)).withColumn("tile", F.expr(f"block div {n.anchors_each} * {n.across} + panel"))
    left = rows.withColumn("of", F.lit(1)).withColumn("panel", every(n.down)).withColumn("tile", F.expr(f"panel * {n.across} + block div {n.rows_each}"))
    both = right.unionByName(left, allowMissingColumns=True).drop("panel").withColumn("tile", F.col("tile").cast("int"))
    return both.repartitionById(n.down * n.across, "tile").sortWithinPartitions("tile", "of", "block")


def _met(batches: Iterator[pa.RecordBatch], dim: int, kind: str, primes: list[int], hold: Callable, meet: Callable, hand_on: Callable) -> Iterator[pa.RecordBatch]:
    """``hold`` makes lists for a block of anchors; ``meet`` puts into them what a block of rows brings; ``hand_on`` is what is left of them in the end."""
    tile, held = None, []
    for b in batches:
        for i in range(b.num_rows):
            get = lambda c, kind=np.int64: np.frombuffer(b.column(c)[i].as_py(), kind)  # noqa: B023, E731
            if (now := b.column("tile")[i].as_py()) != tile:
                yield from (x for h in held for x in hand_on(h))
                tile, held = now, []
            if b.column("of")[i].as_py() == 0:
                held.append({"ids": get("ids"), "labels": get("labels"), "values": get("values", kind).reshape(-1, dim)} | hold(get))
            elif held:
                ids, labels, values = get("ids"), get("labels"), residues(get("values", kind).reshape(-1, dim), primes)
                for h in held:
                    meet(h, product(residues(h["values"], primes), values, primes), ids, h["labels"][:, None] == labels[None, :])
    yield from (x for h in held for x in hand_on(h))


def mine(vectors: DataFrame, is_anchor: Column, params: MiningParams = DEFAULT, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``id``; ``label`` an expression over ``vectors`` (default: its column label)."""
    p, spark = params, vectors.sparkSession
    d = stash(_usable(vectors, id_col, F.col("label") if label is None else label, vector_col), "mining-rows", **SMALL_GROUPS)
    n, m, dim, top = d.agg(F.count("*"), F.count_if(is_anchor), F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    if not m:
        return spark.createDataFrame([], RESULT)
    dim = max(dim, 1)
    bound = dim * (int(p.scale * (top or 0)) + 1) ** 2
    if bound > LARGEST_SCORE:
        raise ValueError(f"scores of these vectors could pass 2^55 (largest component {top})")
    primes = primes_for(bound)
    n_row, n_anchor = -(-n // p.row_block), -(-m // p.anchor_block)
    kind = "int16" if int(p.scale * (top or 0)) < np.iinfo("int16").max else "int32"  # LARGEST_SCORE leaves no component beyond
    lists = p.positives * (2 + 2 * p.negatives) + 2  # numbers that a task holds for an anchor
    panels = _Panels.of(n_anchor, n_row, p.anchor_block * (dim * np.dtype(kind).itemsize + 8 * lists), spark.sparkContext.defaultParallelism)
    block = lambda k: F.pmod(F.xxhash64("id"), F.lit(k))
    rows = stash(_packed(d, block(n_row), dim, kind, p, []), "mining-blocks", **SMALL_GROUPS)
    asked = d.where(is_anchor)

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hold(get) -> dict:
            size = (len(get("ids")), p.positives)
            return {"best": np.full(size, NONE), "with": np.zeros(size, np.int64)}

        def meet(h: dict, s: np.ndarray, ids: np.ndarray, same: np.ndarray) -> None:
            x, y = _candidates(s, same & (s >= h["best"][:, -1:]) & (h["ids"][:, None] != ids[None, :]), p.positives)
            _keep(h["best"], h["with"], x, s[x, y], ids[y])

        def hand_on(h: dict) -> Iterator[pa.RecordBatch]:
            x, k = np.nonzero(h["best"] != NONE)
            yield pa.RecordBatch.from_arrays([pa.array(h["ids"][x]), pa.array(h["with"][x, k]), pa.array(h["best"][x, k])], ["id", "positive_id", "positive_score"])

        return _met(batches, dim, kind, primes, hold, meet, hand_on)

    found = _tiles(_packed(asked, block(n_anchor), dim, kind, p, []), rows, panels).mapInArrow(positives, "id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("positive_score"), "positive_id"))
    found = found.withColumn("place", place).where(F.col("place") <= p.positives)
    found = found.groupBy("id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("x"))  # params.positives at most
    held = asked.join(found, "id").select("id", "label", "v", F.col("x.positive_id").alias("positive"), F.col("x.positive_score").alias("score"))

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hold(get) -> dict:
            positive, t = get("positive").reshape(-1, p.positives), get("score").reshape(-1, p.positives)
            low, high = -((-p.low * t) // 100), (p.high * t) // 100
            low[t < 0] = LARGEST_SCORE  # also fills up the places of anchors with fewer positives
            size = (*t.shape, p.negatives)
            return {"positive": positive, "score": t, "low": low, "high": high, "best": np.full(size, NONE), "with": np.zeros(size, np.int64)}

        def meet(h: dict, s: np.ndarray, ids: np.ndarray, same: np.ndarray) -> None:
            low, high = np.maximum(h["low"], h["best"][:, :, -1]), h["high"]
            allowed = ~same & (s >= low.min(axis=1)[:, None]) & (s <= high.max(axis=1)[:, None])
            if few := _few(allowed):
                x, y = np.nonzero(allowed)
                t = s[x, y]
            for k in range(p.positives):
                if few:
                    z = (t >= low[x, k]) & (t <= high[x, k])
                    _keep(h["best"][:, k], h["with"][:, k], x[z], t[z], ids[y[z]])
                else:
                    u, v = _candidates(s, allowed & (s >= low[:, k, None]) & (s <= high[:, k, None]), p.negatives)
                    _keep(h["best"][:, k], h["with"][:, k], u, s[u, v], ids[v])

        def hand_on(h: dict) -> Iterator[pa.RecordBatch]:
            x, k, j = np.nonzero(h["best"] != NONE)
            yield pa.RecordBatch.from_arrays([pa.array(h["ids"][x]), pa.array(h["positive"][x, k]), pa.array(h["score"][x, k]), pa.array(h["with"][x, k, j]), pa.array(h["best"][x, k, j])],
                                             ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

        return _met(batches, dim, kind, primes, hold, meet, hand_on)

    tiles = _tiles(_packed(held, block(n_anchor), dim, kind, p, ["positive", "score"]), rows, panels)
    out = tiles.mapInArrow(negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= p.negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The contracted query: every row whose id is divisible by 50 is an anchor; each seventh label is moved on by one."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return mine(embeddings, F.col("id") % 50 == 0, label=label)
