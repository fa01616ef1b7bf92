"""Spelling variant grouping: words one edit apart, found by dense prefix-suffix tiling.

1. Words are counted by Arrow tasks that read the texts' bytes; Spark adds the counts up.
2. Windows.  Two words with one edit between them agree outside a short window of letters around it.  Each word goes out
   once for each window (at most SEGMENTS for its own length and for the length below, the inserted letter's), keyed by
   what stands before and after the window.  Rows of a key form a block; the words of a block differ within one window
   only, so a block has few words whatever the size of the corpus, and a frequent ending or beginning makes no hot key.
3. Tiles.  The blocks of a task stand one below the other in a matrix of code points padded to the right, and one padded
   to the left.  The matrices are compared with themselves moved down by 1, 2, ... rows, within blocks: the first column
   that differs gives the common prefix of a pair, the last one the common suffix.  Where both together reach the longer
   length minus one, one edit leads from word to word.  A pair counts in the window that its common prefix ends in.
4. Forms.  Each word's near words are reduced to their number and the most frequent one, first within the task.
   Roots follow the forms by pointer doubling; every form is more frequent by a factor, so there are no cycles.

Defined cases: a null text has no words; rows with a null id take part, with no letter deleted; rows that share an id are
separate texts; very long words have as many windows as others, but wider ones; a tie for the form goes to the word that is
first in code-point order; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


@dataclass(frozen=True)
class SpellingParams:
    #: Code points of a word, at least, and its occurrences.
    min_length: int = 7
    min_count: int = 2
    #: A form occurs this many times as often as its variant, at least.
    factor: int = 10
    #: One in so many (document, run) pairs loses a letter; 0: none does.
    typo_every: int = 31


DEFAULT = SpellingParams()
#: Windows a word has at most for each length, and the least letters of a window.
SEGMENTS, WINDOW = 8, 3
#: Bytes of text, words and matrix cells that a task handles at once.
TEXT_BYTES, WORDS, CELLS = 4 << 20, 300_000, 8 << 20

#: Bytes A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
#: In UTF-8 this byte leads U+00C0 to U+00FF, and nothing else.
LEAD = 0xC3


def _runs(column: pa.Array) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of some MB of text: row, lower-cased bytes, and start, end and code points of every letter run."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TEXT_BYTES, "right")) - 1)
        cuts = offsets[i: j + 1] - offsets[i]
        a = LOWER[data[offsets[i]: offsets[j]]]
        lead = a == LEAD
        letter = LETTER[a] | lead
        letter[1:] |= lead[:-1]
        edge = np.zeros(len(a) + 1, bool)
        edge[cuts] = True
        starts = np.flatnonzero(letter & (edge[:-1] | ~np.concatenate(([False], letter[:-1]))))
        ends = np.flatnonzero(letter & (edge[1:] | ~np.concatenate((letter[1:], [False])))) + 1
        leads = np.concatenate(([0], np.cumsum(lead, dtype=np.int32)))
        yield i + np.searchsorted(cuts, starts, "right") - 1, a.tobytes(), starts, ends, ends - starts - (leads[ends] - leads[starts])
        i = j


def vocabulary(docs: DataFrame, params: SpellingParams = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words with the wanted length and count."""
    p = params

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for b in batches:
            ids = b.column(0).to_pylist()
            prefix = [zlib.crc32(f"{i}:".encode()) for i in ids]
            for row, text, starts, ends, length in _runs(b.column(1)):
                long = length >= p.min_length
                row, starts, ends, length = row[long], starts[long], ends[long], length[long]
                found = [text[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                if p.typo_every:
                    row = row.tolist()
                    h = np.fromiter(map(zlib.crc32, found, [prefix[r] for r in row]), np.int64, len(found))
                    for k in np.flatnonzero(h % p.typo_every == 0).tolist():
                        if ids[row[k]] is not None:
                            at, word = h[k] % length[k], found[k].decode()
                            found[k] = (word[:at] + word[at + 1:]).encode() if length[k] > p.min_length else None
                total.update(found)
            total.pop(None, None)
            if len(total) > WORDS:  # else its memory would grow with the task's text
                yield rows()
                total.clear()
        yield rows()

    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    counts = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= p.min_count)


def windows(words: DataFrame) -> DataFrame:
    """size, window, key, word, n: each word once for each window; size is the shorter length of the pairs that meet there."""
    width = lambda c: f"greatest({WINDOW}, {c} div {SEGMENTS} + 1)"
    own, below = (f"({c} div {width(c)} + 1)" for c in ("length(word)", "(length(word) - 1)"))
    d = words.selectExpr("word", "n", f"explode(sequence(0L, {own} + {below} - 1)) AS j", f"{own} AS own")
    d = d.selectExpr("word", "n", "cast(if(j < own, length(word), length(word) - 1) AS int) AS size", "cast(if(j < own, j, j - own) AS int) AS window")
    before = f"substr(word, 1, cast(window * {width('size')} AS int))"
    after = f"right(word, cast(greatest(0, size - (window + 1) * {width('size')}) AS int))"
    return d.selectExpr("size", "window", f"xxhash64(size, window, {before}, {after}) AS key", "word", "n")


def near_in(size: np.ndarray, window: np.ndarray, key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of words (as Latin-1 bytes, sorted by key) that are one edit apart and meet in their own window."""
    rows, cells = len(words), max(words.dtype.itemsize, 1)
    left = words.view(np.uint8).reshape(rows, cells)
    n = np.char.str_len(words)
    place = np.arange(cells)[None, :] - (cells - n)[:, None]
    right = np.where(place >= 0, np.take_along_axis(left, np.maximum(place, 0), axis=1), 0)
    width = np.maximum(WINDOW, size // SEGMENTS + 1)
    first, second = [], []
    at = np.arange(rows)
    for d in range(1, rows):
        at = at[at < rows - d]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        to = at + d
        prefix = (left[at] != left[to]).argmax(axis=1)  # words are distinct, so some column differs
        suffix = (right[at] != right[to])[:, ::-1].argmax(axis=1)
        near = (prefix + suffix >= np.maximum(n[at], n[to]) - 1) & (np.minimum(n[at], n[to]) == size[at]) & (np.maximum(n[at], n[to]) <= size[at] + 1)
        near &= (prefix // width[at] == window[at]) & (size[at] == size[to]) & (window[at] == window[to])
        first.append(at[near])
        second.append(to[near])
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, int), np.zeros(0, int))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: how many words are one edit away, and the most frequent of them."""

    def tile(t: pa.Table) -> pa.RecordBatch:
        word = np.array([w.encode("latin-1") for w in t.column("word").to_pylist()])
        n = t.column("n").to_numpy()
        a, b = near_in(t.column("size").to_numpy(), t.column("window").to_numpy(), t.column("key").to_numpy(), word)
        a, b = np.concatenate((a, b)), np.concatenate((b, a))
        order = np.lexsort((word[b], -n[b], a))
        a, b = a[order], b[order]
        one, at, count = np.unique(a, return_index=True, return_counts=True)
        text = t.column("word").combine_chunks()
        return pa.RecordBatch.from_arrays([text.take(pa.array(one)), pa.array(count, pa.int64()), pa.array(n[b[at]], pa.int64()), text.take(pa.array(b[at]))],
                                          ["word", "n_near", "best_n", "best"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole blocks, and the start of the next

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            key, size = t.column("key").to_numpy(), t.column("size").to_numpy()
            ends = np.flatnonzero((key[1:] != key[:-1]) | (size[1:] != size[:-1])) + 1
            ends = np.append(ends, len(key)) if last else ends
            i = 0
            while i < len(ends):  # as many whole blocks as fit, one at least
                start = ends[i - 1] if i else 0
                room = (ends[i:] - start) * (size[ends[i:] - 1] + 1) <= CELLS
                j = i + max(1, len(room) if room.all() else int(room.argmin()))
                yield tile(t.slice(start, ends[j - 1] - start))
                i = j
            held[:] = [] if last else t.slice(ends[-1] if len(ends) else 0).to_batches()

        for b in batches:
            if b.num_rows:
                held.append(b)
                if sum(x.num_rows for x in held) >= 50_000:
                    yield from cut(False)
        if held:
            yield from cut(True)

    blocks = windows(words).repartition("size", "key").sortWithinPartitions("size", "key")
    found = blocks.mapInArrow(tiles, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows without cycles, by pointer doubling: a chain of k forms takes log2 k joins."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        now = stash(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "spelling-roots")
        moved = now.where("moved").limit(1).count()
        now = now.drop("moved")
        if not moved:
            return now


def spelling_variants(docs: DataFrame, params: SpellingParams = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = stash(vocabulary(docs, params, id_col, text_col), "spelling-words")
    form = F.when(F.col("best_n") >= params.factor * F.col("n"), F.col("best"))
    all_words = words.join(near_words(words), "word", "left").select(
        "word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n"))
    all_words = stash(all_words, "spelling-forms")
    root = roots(all_words.where("form is not null"))
    return all_words.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
