"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the k least distinct 64-bit hashes of a text's five-word shingles.  The sketch of a union is the k least
of both sketches, so sketches of parts merge into that of the whole, in any order.  Two sketches estimate

* resemblance: the share of the k least hashes of the union that both have;
* distinct shingles: from the k-th least hash, exact where there are fewer than k;
* containment: shared shingles, by the two, over the shingles of one.

Words are runs of anything but ASCII white space, A-Z count as a-z; a text with fewer words is one shingle.  Hashes are
taken from the UTF-8 bytes with numpy, a word's as a difference of prefix sums.

``fingerprint_pairs`` gives each document's fingerprint beside that of the document after it, in descending id order, and of
an edited text made of both.  Rows are dealt once, by ranges of (id, hash of the text), and read in order: hashes
of a document serve its own line and the one before, and the edited text takes over those of all shingles that it shares.
The first row of each range also goes to the range before.  Range limits are found on ids and hashes alone; what
reaches the driver is one (id, hash) a range.

Defined cases: a null text is empty and has an empty fingerprint; two empty fingerprints resemble each other fully, an empty and
another one not at all; rows with a null id come last; rows that share an id are ordered by the text's hash, equal rows
stand next to each other; a single row is followed by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_key

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random odd number for each byte; A-Z have those of a-z.
BYTE = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
BYTE[65:91] = BYTE[97:123]
BASE, ODD, GOLD = (np.uint64(x) for x in (0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15))
#: Bytes whose prefix sums are taken at once; longer words are hashed by a digest.
PIECE = 1 << 16


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(PIECE, base, np.uint64))))


POWER, INVERSE = _powers(int(BASE)), _powers(pow(int(BASE), -1, 1 << 64))


@dataclass(frozen=True)
class SketchParams:
    n: int = 5
    k: int = 128


DEFAULT = SketchParams()


def _stir(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= ODD
    h ^= h >> np.uint64(29)
    return h


def words_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word of UTF-8 bytes."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edges = np.flatnonzero(np.diff(SPACE[a], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        s = starts[i]
        j = int(np.searchsorted(ends, s + PIECE, "right"))
        if j <= i:  # a longer word
            low = bytes(a[s: ends[i]]).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
            out[i] = int.from_bytes(hashlib.blake2b(low, digest_size=8).digest(), "big")
            i += 1
            continue
        part = a[s: ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE[part] * POWER[: len(part)], out=sums[1:])
        x, y = starts[i:j] - s, ends[i:j] - s
        out[i:j] = _stir((sums[y] - sums[x]) * INVERSE[x] + (y - x).astype(np.uint64) * GOLD)
        i = j
    return starts, ends, out


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, in order; none if there are fewer words."""
    m = max(0, len(h) - n + 1)
    g = np.full(m, n, np.uint64)
    for i in range(n):
        g *= GOLD
        g += h[i: i + m]
        g = _stir(g)
    return g


def all_shingles(h: np.ndarray, n: int) -> np.ndarray:
    return shingles(h, min(n, len(h))) if len(h) else h


def bottom(g: np.ndarray, k: int) -> np.ndarray:
    """The k least distinct values, sorted."""
    m = 2 * k
    while m < len(g):
        least = np.unique(np.partition(g, m)[:m])
        if len(least) >= k:
            return least[:k]
        m *= 4
    return np.unique(g)[:k]


def sketch_of(text: str | bytes | None, params: SketchParams = DEFAULT) -> np.ndarray:
    data = (text or "").encode() if not isinstance(text, bytes) else text
    return bottom(all_shingles(words_of(np.frombuffer(data, np.uint8))[2], params.n), params.k)


def merged(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int) -> float:
    """Distinct shingles of the sketched set: exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated Jaccard similarity; exact if both sets have fewer than k members together."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    same = both[1:] == both[:-1]
    union = both[np.concatenate(([True], ~same))][:k]
    return float(np.count_nonzero(both[1:][same] <= union[-1]) / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merged(a, b, k), k) / distinct(a, k))


def written(a: np.ndarray) -> str:
    """The sketch as text: base64 of its hashes, 8 big-endian bytes each."""
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def read(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def fingerprint(text: Column, params: SketchParams = DEFAULT) -> Column:
    """The fingerprint of a text column."""

    @F.arrow_udf("string")
    def write(t: pa.Array) -> pa.Array:
        return pa.array([written(sketch_of(x, params)) for x in t.to_pylist()], pa.string())

    return write(text)


def merge(parts: DataFrame, by: list[str], col: str = "fingerprint", k: int = DEFAULT.k) -> DataFrame:
    """``by`` and the merged fingerprint of each group's parts.

    Equal hashes of a group are combined by (group, hash), so a group of any size spreads over all tasks; of what is left
    each task passes on the least of a group, not all."""
    last = F.greatest(F.expr(f"length(unbase64(`{col}`)) div 8"), F.lit(1)) - 1
    hashes = parts.select(*by, F.unbase64(col).alias("b"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("i"))
    hashes = hashes.select(*by, F.substring("b", F.col("i") * 8 + 1, F.lit(8)).alias("h")).distinct()  # an empty fingerprint has one, of no length
    place = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
    least = hashes.withColumn("place", place).where(F.col("place") <= k + 1)
    held = F.slice(F.array_sort(F.collect_list(F.when(F.length("h") > 0, F.hex("h")))), 1, k)  # k + 1 at most
    return least.groupBy(*by).agg(F.translate(F.base64(F.unhex(F.array_join(held, ""))), "\r\n", "").alias(col))


class _Document:
    """Bytes, words and shingles of one text."""

    def __init__(self, data: bytes, p: SketchParams):
        self.data, self.p = data, p
        self.bytes = np.frombuffer(data, np.uint8)
        self.starts, self.ends, self.words = words_of(self.bytes)
        self.shingles = all_shingles(self.words, p.n)
        self.sketch = bottom(self.shingles, p.k)
        self.points = None if data.isascii() else np.flatnonzero((self.bytes & 0xC0) != 0x80)
        self.n_chars = len(data) if self.points is None else len(self.points)

    def at(self, k: int) -> int:
        """The byte at which code point k starts."""
        return k if self.points is None else len(self.data) if k >= self.n_chars else int(self.points[k])

    def edited(self, after: _Document) -> tuple[str, np.ndarray]:
        """SHA-256 and sketch of this text with its last half replaced by the start of the next."""
        n = self.p.n
        half = self.n_chars // 2
        cut, end = self.at(self.n_chars - half), after.at(min(half, after.n_chars))
        digest = hashlib.sha256(memoryview(self.data)[:cut])
        digest.update(memoryview(after.data)[:end])
        i = int(np.searchsorted(self.ends, cut, "left"))  # words that end before the cut
        j, m = min(1, len(after.ends)), int(np.searchsorted(after.ends, end, "right"))  # words up to the end, but for the first
        if m - j < 2 * n:  # few words of the next text are whole: hash all there is of it
            start = int(self.starts[i]) if i < len(self.starts) and self.starts[i] < cut else cut
            rest = words_of(np.frombuffer(self.data[start:cut] + after.data[:end], np.uint8))[2]
            h = np.concatenate((self.words[:i], rest))
            if len(h) < n:
                return digest.hexdigest(), bottom(all_shingles(h, n), self.p.k)
            keep = max(0, i - n + 1)
            return digest.hexdigest(), bottom(np.concatenate((self.shingles[:keep], shingles(h[keep:], n))), self.p.k)
        start = int(self.starts[i]) if i < len(self.starts) and self.starts[i] < cut else cut
        middle = words_of(np.frombuffer(self.data[start:cut] + after.data[: int(after.ends[0])], np.uint8))[2]
        tail = words_of(after.bytes[int(after.starts[m]): end])[2] if m < len(after.starts) and after.starts[m] < end else self.words[:0]
        keep = max(0, i - n + 1)
        across = shingles(np.concatenate((self.words[keep:i], middle, after.words[j: j + n - 1])), n)
        last = shingles(np.concatenate((after.words[m - n + 1: m], tail)), n)
        return digest.hexdigest(), bottom(np.concatenate((self.shingles[:keep], across, after.shingles[j: m - n + 1], last)), self.p.k)


def _order() -> list[Column]:
    return [F.desc_nulls_last("id"), F.asc("h")]


def _limits(d: DataFrame, parts: int) -> list[tuple]:
    """The first (id, h) of each range of the order, last range first."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.slice(0, 1)
                return

    keys = d.select("id", "h")
    heads = keys.repartitionByRange(parts, *_order()).sortWithinPartitions(*_order()).mapInArrow(first, keys.schema).collect()  # one a range
    return sorted({_key(r["id"], r["h"]) for r in heads})


def _key(i, h: int) -> tuple:
    """Ascending where the order descends."""
    return (i is not None, i if i is not None else 0, ~h)


def fingerprint_pairs(docs: DataFrame, params: SketchParams = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, contained_next."""
    p, spark = params, docs.sparkSession
    d = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(F.col(f"`{text_col}`")).alias("h"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, t) for c, t in (
        ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()),
        ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()), ("n_shingles", T.DoubleType()), ("contained_next", T.DoubleType()))]])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limits = _limits(d, 4 * parts)
    if not limits:
        return spark.createDataFrame([], schema)
    n = len(limits)

    @F.arrow_udf("array<int>")
    def places(i: pa.Array, h: pa.Array) -> pa.Array:
        """2 * range of a row, ranges counted down the order; of a range's first row also 2 * range before + 1."""
        out = []
        for key in map(_key, i.to_pylist(), h.to_pylist()):
            at = bisect.bisect_left(limits, key)
            k = n - 1 - at
            out.append([2 * k] if limits[at] != key else [2 * k, 2 * ((k - 1) % n) + 1])
        return pa.array(out, pa.list_(pa.int32()))

    dealt = d.select("id", "h", "text", F.explode(places("id", "h")).alias("place")).withColumn("range", F.expr("place div 2"))
    dealt = dealt.repartition(parts, "range").sortWithinPartitions("range", "place", *_order()).select("id", "text", "place")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = held_id = at = one = None
        for b in batches:
            id_type = b.schema.field("id").type
            rows = []
            for i, text, place in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("place").to_pylist(), strict=True):
                if place % 2 and held is None:
                    continue  # a copy of the row after the range
                if one is None or one.data != text:  # copies often stand together
                    one = _Document(text, p)
                if held is not None and place // 2 == at:
                    digest, sketch = held.edited(one)
                    rows.append((held_id, held.n_chars, digest, written(held.sketch), written(sketch), resemblance(held.sketch, sketch, p.k),
                                 resemblance(held.sketch, one.sketch, p.k), distinct(held.sketch, p.k), containment(held.sketch, one.sketch, p.k)))
                held, held_id, at = (None, None, None) if place % 2 else (one, i, place // 2)
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

    return dealt.mapInArrow(pairs, schema)
