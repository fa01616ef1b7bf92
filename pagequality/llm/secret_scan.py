"""Secret scans: fixed patterns, and character Markov models for what no pattern names.

Two first-order Markov chains over character classes are trained from samples that the patterns label: one
from the values of pattern hits (random strings), one from all other words and identifiers of the corpus
(ordinary text).  Transition counts are taken over every text and summed by Spark; only the two fixed-size
count tables reach the driver.  A candidate token is reported when its log-likelihood ratio, in total and
for each character, is high enough.

Each text is scanned whole, in the task that reads it; nothing is shuffled but the counts.

Defined cases: a null text is empty and gives no spans; rows that share an id are scanned each by itself;
offsets are in code points, ends exclusive; with no pattern hit in the corpus the random model stays at its
prior (uniform over letters and digits); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns.  ASCII flags keep letters that merely fold to ASCII out of [a-z].
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")

# Character classes: 0 outside a token, then a-z, A-Z, 0-9, and the marks + / _ = -
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
K = len(ALPHABET) + 1
CLASS_OF = np.zeros(256, np.uint16)
for _i, _c in enumerate(ALPHABET, 1):
    CLASS_OF[ord(_c)] = _i


@dataclass(frozen=True)
class SecretParams:
    #: Log-likelihood ratio, in nats: in total and for each character, at least.
    min_total: float = 20.0
    min_each: float = 0.5
    #: Pseudo-counts for each row of transitions.
    prior: float = 50.0


DEFAULT = SecretParams()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern hits, by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _values(text: str, spans) -> list[str]:
    """What the pattern hits hold, without keywords: the labelled random strings."""
    out, seen = [], -1
    for s, kind, e in spans:
        value = ASSIGN.match(text, s, e).group(2) if kind == 0 else text[s:e]
        if s >= seen:
            out.append(value)
        seen = max(seen, e)
    return out


def _transitions(data: bytes) -> np.ndarray:
    c = CLASS_OF[np.frombuffer(b" " + data + b" ", np.uint8)].astype(np.int32)
    return np.bincount(c[:-1] * K + c[1:], minlength=K * K)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plain, random = np.zeros(K * K, np.int64), np.zeros(K * K, np.int64)
    for b in batches:
        for t in b.column(0):
            text = t.as_py() or ""
            if not text:
                continue
            values = _values(text, base_spans(text))
            plain += _transitions(text.encode())
            for v in values:
                n = _transitions(v.encode())
                random += n
                plain -= n
    plain = np.maximum(plain, 0)
    for kind, counts in enumerate((plain, random)):
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["kind", "pair", "n"])


def train(docs: DataFrame, params: SecretParams = DEFAULT, text_col: str = "text") -> np.ndarray:
    """K x K log-likelihood ratios of transitions, from the whole corpus.  At most 2 * K * K rows are collected."""
    rows = (docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "kind int, pair int, n long")
            .groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros((2, K, K))
    for r in rows:
        counts[r["kind"], r["pair"] // K, r["pair"] % K] = r["n"]
    return ratios(counts[0], counts[1], params)


def ratios(plain: np.ndarray, random: np.ndarray, p: SecretParams = DEFAULT) -> np.ndarray:
    """Log ratio of the two chains inside a token; the prior of the random one is uniform over letters and digits."""
    inside = np.zeros(K)
    inside[1:63] = 1 / 62
    base = plain[1:, 1:].sum(0) + 1
    prior_plain = np.concatenate([[0.0], base / base.sum()])
    out = np.zeros((K, K))
    for name, counts, prior in (("random", random, inside * 0.95 + 0.05 / K), ("plain", plain, prior_plain * 0.95 + 0.05 / K)):
        c = counts.copy()
        c[:, 0] = 0
        prob = (c + p.prior * prior) / (c.sum(1, keepdims=True) + p.prior)
        out += np.log(prob) * (1 if name == "random" else -1)
    return out


def markov_spans(text: str, taken, table: np.ndarray, p: SecretParams = DEFAULT) -> list[tuple[int, int, int]]:
    """Tokens, or what is left of them outside ``taken``, whose characters look drawn at random: the ratio alone decides."""
    data = text.encode()
    place = (lambda k: k) if len(data) == len(text) else (lambda k: len(text[:k].encode()))
    c = CLASS_OF[np.frombuffer(b" " + data + b" ", np.uint8)].astype(np.intp)
    for s, _, e in taken:
        c[place(s) + 1: place(e) + 1] = 0
    inside = c > 0
    score = np.where(inside[:-1] & inside[1:], table[c[:-1], c[1:]], 0.0)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return []
    total = np.add.reduceat(score, np.stack([starts, ends], axis=1).ravel())[::2]  # the step into a token scores 0
    hits = np.flatnonzero((total >= p.min_total) & (total >= p.min_each * (ends - starts)))
    back = (lambda k: k) if len(data) == len(text) else (lambda k: len(data[:k].decode()))
    return [(back(int(starts[i])), 3, back(int(ends[i]))) for i in hits]


def show(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, params: SecretParams = DEFAULT, id_col: str = "doc_id", text_col: str = "text",
         table: np.ndarray | None = None) -> DataFrame:
    """doc_id and the spans of each row.  ``table`` is a trained model; without one it is trained on ``docs``."""
    table = train(docs, params, text_col) if table is None else table
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                found = base_spans(text)
                base.append(found)
                every.append(sorted(found + markov_spans(text, found, table, params)))
            of = lambda k: pa.array([sum(x[1] == k for x in f) for f in base], pa.int64())
            yield pa.record_batch([
                b.column(0), of(0), of(1), of(2),
                pa.array([hashlib.sha256(show(f).encode()).hexdigest() for f in base], pa.string()),
                pa.array([show(f) for f in every], pa.string()),
                pa.array([len(f) - len(g) for f, g in zip(every, base, strict=True)], pa.int64()),
            ], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")
    return out.withColumnRenamed("id", "doc_id")
