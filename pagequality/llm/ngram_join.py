"""N-gram Jaccard join: links between documents whose sets of word n-grams are alike, and their components.

The documents-by-n-grams incidence matrix is multiplied with its transpose in blocks of columns:

1. Documents with equal sets become one row of the matrix (a class).
2. First block: the rarest n-grams of each row, as many as it may miss and still reach the threshold, plus
   one.  Two rows that reach it share a column here.  Rarity comes from a count sketch of all n-grams.
   Columns with one entry drop out.
3. In each column, rows of like size meet its earliest row only; overlap counts of those pairs are accumulated
   and each row keeps its best partner.  A pair goes if the sizes, or 256 parity bits of the sets, already
   leave the threshold out of reach.  The pair's remaining columns are multiplied block by block, and the
   pair is discarded as soon as its count can't reach the bound that the two sizes imply.
4. Components of these links.  In columns that still hold several components, the rows outside the
   column's main component meet all rows of other components: what is left of the product.  So a group of
   many near copies costs about one pair a row, not all pairs, and no link between components is lost.

Sets are compared by 64-bit hashes of the n-grams.

Defined cases: a null text is empty; texts without words have no n-grams and link with nothing; texts with
fewer than n words have their whole sequence as the only n-gram; rows with a null id get their count and no
component and link with nothing; rows that share an id are separate rows of the matrix.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.interim import passing
from ..operators.joins import sized_broadcast
from .common import fresh, stash, text_key, without
from .components import components

SKETCH_BITS = 20
BLOCKS = 8


@dataclass(frozen=True)
class JaccardParams:
    n: int = 3
    #: Linked when 100 * intersection >= percent * union.
    percent: int = 90


DEFAULT = JaccardParams()
#: For near-duplicate stages.
NEAR = JaccardParams(n=5, percent=80)


#: Bytes of ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte at each of 64 places of a word; A-Z have those of a-z.
PLACES = 64
TABLE = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, (PLACES, 256), np.uint64)
TABLE[:, 65:91] = TABLE[:, 97:123]
WORDS_AT_ONCE = 1 << 16
GOLD, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _stir(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= ODD
    h ^= h >> np.uint64(29)
    return h


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words in order, by tabulation: the sum of the table's numbers for a word's bytes at their places."""
    a = np.frombuffer((text or "").encode(), np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64)
    space = SPACE[a]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros(len(starts), np.uint64)
    for i in range(0, len(starts), WORDS_AT_ONCE):  # bounds the memory for long texts
        s, e = starts[i: i + WORDS_AT_ONCE], ends[i: i + WORDS_AT_ONCE]
        n = e - s
        at = np.cumsum(n) - n
        place = np.arange(n.sum(), dtype=np.int32) - np.repeat(at.astype(np.int32), n)
        part = a[s[0]: e[-1]][~space[s[0]: e[-1]]]
        v = TABLE.ravel().take(((place & (PLACES - 1)) << 8) | part)
        if n.max() > PLACES:
            v *= _stir((place // PLACES).astype(np.uint64) * GOLD) | np.uint64(1)
        out[i: i + WORDS_AT_ONCE] = np.add.reduceat(v, at) + n.astype(np.uint64) * GOLD
    return out


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; words end at ASCII white space, A-Z count as a-z."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(n, len(h))
    m = len(h) - k + 1
    g = np.full(m, k, np.uint64)
    for i in range(k):
        g *= GOLD
        g += h[i: i + m]
        g = _stir(g)
    g = _stir(g * GOLD)
    g.sort()
    return g[np.concatenate(([True], g[1:] != g[:-1]))]


def _bucket(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Counts of all n-grams in 2^SKETCH_BITS buckets: a table of fixed size, summed by Spark in blocks."""
    size = 1 << SKETCH_BITS
    step = size // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for b in batches:
            grams = [gram_set(t, n) for t in b.column(0).to_pylist()]
            if grams:
                total += np.bincount(_bucket(np.concatenate(grams)), minlength=size).astype(np.uint32)
        yield pa.record_batch([pa.array(range(64), pa.int32()), pa.array([total[i * step: (i + 1) * step].tobytes() for i in range(64)], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.uint32).astype(np.uint64)
        yield pa.record_batch([pa.array(sums.keys(), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "counts"])

    rows = docs.mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, counts binary").collect()
    out = np.zeros(size, np.uint64)
    for r in rows:
        out[r["block"] * step: (r["block"] + 1) * step] = np.frombuffer(r["counts"], np.uint64)
    return out


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def need(a, b, percent: int):
    """Least overlap of two sets of these sizes that are linked: 100 o >= percent (a + b - o)."""
    return -(-(percent * (a + b)) // (100 + percent))


def _class_id(g: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(g.tobytes(), digest_size=8).digest(), "big", signed=True)


SIGNS = ("s0", "s1", "s2", "s3")


def parity(g: np.ndarray) -> np.ndarray:
    """256 bits, each the parity of the n-grams that hash to it: two sets differ in at least as many n-grams as in bits."""
    odd = np.bincount((g & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _alike(x: str, y: str, p: JaccardParams):
    """Sizes and parity bits of classes x and y leave the threshold within reach, and the least overlap for it."""
    a, b = F.col(f"n_grams_{x}"), F.col(f"n_grams_{y}")
    least = F.expr(f"({p.percent} * (n_grams_{x} + n_grams_{y}) + {99 + p.percent}) div {100 + p.percent}")
    apart = sum((F.bit_count(F.col(f"{s}_{x}").bitwiseXOR(F.col(f"{s}_{y}"))) for s in SIGNS), F.lit(0))
    return (100 * F.least(a, b) >= p.percent * F.greatest(a, b)) & (apart <= a + b - 2 * least), least


def _named(df: DataFrame, x: str, *keep: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{c}_{x}") for c in df.columns])


def rows_of(docs: DataFrame, p: JaccardParams) -> DataFrame:
    """id, n_grams, cid (of the set; null: no n-grams), prefix (its rarest n-grams, rarest first) of every row."""
    counts = sketch(docs.select("text"), p.n)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, ids, prefixes, signs = [], [], [], []
            for t in b.column(1).to_pylist():
                g = gram_set(t, p.n)
                k = prefix_length(len(g), p.percent) if len(g) else 0
                order = np.lexsort((g, counts[_bucket(g)]))[:k]
                sizes.append(len(g))
                ids.append(_class_id(g) if len(g) else None)
                prefixes.append(g[order].view(np.int64))
                signs.append(parity(g))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                                   *(pa.array([x[i] for x in signs], pa.int64()) for i in range(4))], ["id", "n_grams", "cid", "prefix", *SIGNS])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n_grams long, cid long, prefix array<long>, s0 long, s1 long, s2 long, s3 long")


def overlap(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Size of the intersection of two sorted sets, block by block of the hash space; -1 once ``least`` is out of reach."""
    edges = np.arange(1, BLOCKS, dtype=np.uint64) << np.uint64(61)
    ea = [0, *np.searchsorted(a, edges).tolist(), len(a)]
    eb = [0, *np.searchsorted(b, edges).tolist(), len(b)]
    got = 0
    for k in range(BLOCKS):
        x, y = a[ea[k]: ea[k + 1]], b[eb[k]: eb[k + 1]]
        both = np.concatenate([x, y])
        both.sort()
        got += int((both[1:] == both[:-1]).sum())
        if got + min(len(a) - ea[k + 1], len(b) - eb[k + 1]) < least:
            return -1
    return got


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, p: JaccardParams) -> DataFrame:
    """The pairs (u, v) of classes whose sets reach the threshold."""
    wanted = stash(pairs.select(F.explode(F.array("u", "v")).alias("cid")).distinct().join(classes.select("cid", "rep"), "cid"), "jaccard-wanted")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor()
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([z.compress(t.encode()) for t in b.column(1).to_pylist()], pa.binary())], ["cid", "packed"])

    held = docs.where("text is not null").join(sized_broadcast(wanted, 2_000_000), docs["id"] == wanted["rep"]).select("cid", "text")
    texts = stash(held.mapInArrow(pack, "cid long, packed binary"), "jaccard-texts")  # smaller than their sets of hashes

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, last = zstandard.ZstdDecompressor(), (None, None)

        def grams(cid: int, packed: bytes) -> np.ndarray | None:
            g = gram_set(z.decompress(packed).decode(), p.n)
            return g if _class_id(g) == cid else None  # else another row of that id

        for b in batches:
            ok = []
            for u, v, x, y in zip(*(b.column(c).to_pylist() for c in ("u", "v", "x", "y")), strict=True):
                if last[0] != (v, y):
                    last = (v, y), grams(v, y)
                gu, gv = grams(u, x), last[1]
                least = need(len(gu), len(gv), p.percent) if gu is not None and gv is not None else 0
                ok.append(least > 0 and min(len(gu), len(gv)) >= least and overlap(gu, gv, least) >= least)
            yield pa.record_batch([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.select("u", "v").join(texts.select(F.col("cid").alias("u"), F.col("packed").alias("x")), "u").join(
        texts.select(F.col("cid").alias("v"), F.col("packed").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInArrow(check, "u long, v long").distinct()


def first_links(live: DataFrame, classes: DataFrame, p: JaccardParams) -> DataFrame:
    """For each class its likeliest partner: the earliest class of like size in most of its columns."""
    band = F.floor(F.log("n_grams") / math.log(100 / p.percent)).alias("band")
    rows = live.select("cid", "rep", "gram", band)
    least = rows.groupBy("gram", "band").agg(F.min(F.struct("rep", "cid")).alias("least"), F.count("*").alias("k")).where("k > 1").drop("k")
    met = rows.join(least, ["gram", "band"]).where("cid <> least.cid").groupBy("cid", "least").agg(F.count("*").alias("k"))
    met = met.groupBy("cid").agg(F.min_by("least", F.struct(-F.col("k"), "least")).alias("least")).select(F.col("cid").alias("u"), F.col("least.cid").alias("v"))
    signs = classes.select("cid", "n_grams", *SIGNS)
    met = met.join(_named(signs, "x"), F.col("u") == F.col("cid_x")).join(_named(signs, "y"), F.col("v") == F.col("cid_y"))
    return met.where(_alike("x", "y", p)[0]).select("u", "v")


def rest(live: DataFrame, classes: DataFrame, labels: DataFrame, p: JaccardParams) -> DataFrame:
    """Pairs of classes of different components that share a column and may reach the threshold."""
    rows = live.join(labels.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    rows = stash(rows, "jaccard-rows")
    by = rows.groupBy("gram", "component").agg(F.count("*").alias("k")).groupBy("gram").agg(
        F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("gram", "main")
    mixed = stash(rows.join(by, "gram").join(classes.select("cid", *SIGNS), "cid"), "jaccard-mixed")
    columns = mixed.select("gram", "cid", "n_grams", "pos", "component", "main", *SIGNS)
    x, y = _named(columns.where("component <> main"), "x", "gram"), _named(columns, "y").withColumnRenamed("gram_y", "gram2")
    may, least = _alike("x", "y", p)
    may &= F.least(F.col("n_grams_x") - F.col("pos_x"), F.col("n_grams_y") - F.col("pos_y")) >= least
    # a pair outside the main component would come twice
    once = (F.col("component_y") == F.col("main_y")) | (F.col("cid_x") < F.col("cid_y"))
    pairs = x.join(y, (F.col("gram") == F.col("gram2")) & (F.col("component_x") != F.col("component_y")) & may & once)
    return pairs.select(F.col("cid_x").alias("u"), F.col("cid_y").alias("v")).distinct()


def jaccard_components(docs: DataFrame, params: JaccardParams = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_grams, cid and component (least id that links reach) of every row of ``docs``.

    The links verified span the components: of a group of near copies each class is verified against one partner, not all."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stash(rows_of(d, params), "jaccard-documents")
    classes = stash(rows.where("id is not null and cid is not null").groupBy("cid").agg(
        F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n_grams", "prefix", *SIGNS)]), "jaccard-classes")
    columns = classes.select("cid", "rep", "n_grams", F.posexplode("prefix").alias("pos", "gram"))
    shared = columns.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    live = stash(columns.join(shared, "gram"), "jaccard-columns")
    with passing() as keep:
        links = keep(stash(verified(stash(first_links(live, classes, params), "jaccard-first"), classes, d, params), "jaccard-links"))
    labels = components(links)
    with passing() as keep:
        more = keep(stash(rest(live, classes, labels, params), "jaccard-rest"))
    with passing() as keep:
        links = keep(stash(links.unionByName(verified(more, classes, d, params)), "jaccard-links"))
    labels = components(links)
    least = labels.join(classes.select(F.col("cid").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    of = labels.join(least, "component").select(F.col("node").alias("cid"), "least")
    whole = classes.select("cid", "rep").join(of, "cid", "left").select("cid", F.coalesce("least", "rep").alias("component"))
    return rows.drop("prefix", *SIGNS).join(whole, "cid", "left").select(
        "id", "n_grams", "cid", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def near_duplicates(docs: DataFrame, params: JaccardParams = DEFAULT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    c = jaccard_components(docs, params)
    return c.select(F.col("id").alias("doc_id"), F.col("n_grams").alias("n_shingles"), F.col("component").alias("component_id"))


def one_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one of the rows that share id and text, by a hash of their other columns; null and empty texts count as the same."""
    i, k = fresh(docs, "__one_id", "__one_key")
    d = docs.withColumns({i: F.col("doc_id"), k: text_key(F.col("text"))})
    several = stash(d.groupBy(i, k).agg(F.count("*").alias("n")).where("n > 1").select(F.col(i).alias("id"), F.col(k).alias("key")), "jaccard-several")
    if several.isEmpty():
        return docs
    small = sized_broadcast(several, 1_000_000)
    at = d[i].eqNullSafe(several["id"]) & (d[k] == several["key"])
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    # combined before the shuffle: a row repeated often is no hot group
    first = d.join(small, at, "left_semi").groupBy(i, k).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("row"))
    return d.join(small, at, "left_anti").select(*docs.columns).unionByName(first.select("row.*"))


def keep_one(docs: DataFrame, params: JaccardParams = NEAR) -> DataFrame:
    """``docs`` with one row of each component: the least by (id, hash of the text), a null id before all others.

    Rows go by id and text, so rows that only share an id keep apart; of rows that share both one stays."""
    docs = one_each(docs)
    with passing() as keep:
        c = jaccard_components(docs.select(F.struct(F.col("doc_id").alias("id"), text_key(F.col("text")).alias("key")).alias("doc_id"), "text"), params)
        gone = keep(stash(c.where(F.col("component") < F.col("id")).select("id.id", "id.key"), "jaccard-gone"))
    return without(docs, gone)
