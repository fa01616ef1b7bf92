"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur with up to k edits, k a share of its length.  Cut into k + 1 pieces, it has at least
one piece in the text unchanged.  An Aho-Corasick automaton over the pieces of all items finds exact piece
hits; the stretch around each hit (hits of one item whose stretches overlap count as one) is verified with
Myers' bit-parallel distance.  Texts and items are compared in lower case, each run of white space as one blank.

Texts are scanned whole, in the task that reads them; nothing is shuffled but, of items in several blocks, the keys of rows found.  Items are used in blocks of
bounded size, each block against all rows, so the items may outgrow any one task.

Defined cases: null and empty texts match nothing; items without a letter or digit match nothing; of items
that are equal each is reported; items too short for an edit must occur as they are; rows that share an id
are matched each by itself; an empty table, of either kind, gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stash, text_key, without


@dataclass(frozen=True)
class MatchParams:
    #: Edits allowed, as a share of an item's characters.
    max_error: float = 0.06
    #: Bytes of item text in a block.
    block_bytes: int = 4_000_000


DEFAULT = MatchParams()


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """``text`` cut into k + 1 pieces of nearly equal length, with their offsets."""
    n, out, at = len(text), [], 0
    for i in range(k + 1):
        end = (i + 1) * n // (k + 1)
        out.append((at, text[at:end]))
        at = end
    return out


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """Least edit distance, k at most, of ``pattern`` to any part of ``text``, and the end of the first such part."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = mask, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        x = eq | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hp = vn | ~(d0 | vp) & mask
        hn = d0 & vp
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp = hp << 1 & mask  # a match may begin anywhere
        hn = hn << 1 & mask
        vp = (hn | ~(d0 | hp)) & mask
        vn = hp & d0 & mask
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], p: MatchParams = DEFAULT):
        self.items = []
        at: dict[str, list] = defaultdict(list)
        for i, text in items:
            t = normal(text)
            if not any(c.isalnum() for c in t):
                continue
            k = int(len(t) * p.max_error)
            for off, piece in pieces(t, k):
                at[piece].append((len(self.items), off))
            self.items.append((i, t, k))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, distance, end) of the items in ``text``; the end is that of the best match in the normal form."""
        t = normal(text)
        if not t or not self.items:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, where) in self.automaton.iter(t):
            for j, off in where:
                starts[j].add(end + 1 - size - off)
        out = []
        for j, at in starts.items():
            i, pattern, k = self.items[j]
            best, lo, hi = None, None, None
            for s in [*sorted(at), None]:
                if lo is not None and (s is None or s - k > hi):
                    got = myers(pattern, t[max(lo, 0): hi], k)
                    if got and (best is None or got[0] < best[0]):
                        best = (got[0], max(lo, 0) + got[1])
                    lo = None
                if s is not None:
                    lo = s - k if lo is None else lo
                    hi = s + len(pattern) + k
            if best:
                out.append((i, *best))
        return sorted(out)


def known_items(items: DataFrame, params: MatchParams = DEFAULT, item_col: str = "item_id") -> tuple[DataFrame, int]:
    """(item, text) of the test items, and the number of blocks that they are used in."""
    known = items.select(F.col(item_col).alias("item"), F.col("text")).where("text is not null").distinct()
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return known, -(-size // params.block_bytes) or 1


def matches(docs: DataFrame, items: DataFrame, params: MatchParams = DEFAULT, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id") -> DataFrame:
    """id, key, item, distance, end of every test item in every row of ``docs``."""
    kind, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType
    known, blocks = known_items(items, params, item_col)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("key", text_key(F.col("text")))
    out = None
    for block in range(blocks):
        # by id and text, so items that share an id, or have none, spread over the blocks too
        part = known.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()  # of bounded size
        part = sorted(part, key=lambda r: (r["item"] is not None, r["item"] if r["item"] is not None else 0, r["text"]))
        held, names = [(k, r["text"]) for k, r in enumerate(part)], [r["item"] for r in part]

        def run(batches: Iterator[pa.RecordBatch], held=held, names=names) -> Iterator[pa.RecordBatch]:
            m = Matcher(held, params)
            for b in batches:
                rows = [(n, *hit) for n, t in enumerate(b.column("text").to_pylist()) for hit in m.find(t)]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.record_batch([b.column("id").take(at), b.column("key").take(at), pa.array([names[r[1]] for r in rows], to_arrow_type(item_type)),
                                       *(pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3))], ["id", "key", "item", "distance", "end"])

        found = d.mapInArrow(run, f"id {kind}, key long, item {item_type.simpleString()}, distance long, end long")
        out = found if out is None else out.unionByName(found)
    return out


def filter_documents(docs: DataFrame, items: DataFrame, params: MatchParams = DEFAULT) -> DataFrame:
    """``docs`` without the rows that hold a test item; columns as they are.

    Items of one block are looked for by the task that reads a row, which then goes or stays at once; of several blocks
    the rows found are gathered by id and text."""
    known, blocks = known_items(items, params)
    if blocks > 1:
        return without(docs, stash(matches(docs, items, params).select("id", "key").distinct(), "benchmark-found"))
    held = sorted((k, r["text"]) for k, r in enumerate(known.select("text").distinct().collect()))  # of bounded size
    at = [c.lower() for c in docs.columns].index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(held, params)
        for b in batches:
            yield b.filter(pa.array([not m.find(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def contamination(docs: DataFrame, items: DataFrame, params: MatchParams = DEFAULT) -> DataFrame:
    return matches(docs, items, params).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance", F.col("end").alias("match_end"))
