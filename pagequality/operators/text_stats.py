"""Counting statistics of a text, one Arrow pass per row.

Words, bigrams and sentences of a text concern that text alone, so nothing is grouped or joined: the counts are a
column computed where the text lies.  No key is needed; rows that share an id, or have none, keep apart.  Words are
split on the white space of ``str.split``; array lambdas are interpreted per element, and
keyed aggregates over exploded words were measured at ten times the time of this pass.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import tokens as token_array  # noqa: F401  (imported from here by other operators)
from ..params import DEFAULT, Params

FIELDS = (("word_count", "int"), ("n_long", "int"), ("top_word", "string"), ("top_n", "int"), ("rep_bigrams", "int"),
          ("r_words", "int"), ("syllables", "int"), ("n_sent", "long"), ("s1", "long"), ("s2", "long"), ("slop", "int"),
          ("disc", "int"), ("strip_len", "int"))
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
_LETTER, _VOWELS, _SILENT, _STOP = re.compile("[a-z]"), re.compile("[aeiouy]+"), re.compile("[^l]e$"), re.compile("[.!?]+")
#: Words whose syllables a task remembers.
KNOWN = 20_000


def syllables(word: str) -> int:
    """Syllables of a lower-cased word; 0 if it has no letter from a to z."""
    if not _LETTER.search(word):
        return 0
    return max(1, len(_VOWELS.findall(word)) - bool(_SILENT.search(word)))


def count_text(text: str, params: Params = DEFAULT, known: dict | None = None) -> tuple:
    """The values of ``FIELDS`` for one text; ``known`` keeps what has been found out about words."""
    known = {} if known is None else known
    low, words = text.lower(), text.split()
    count = Counter(words)
    n_words = n_syllables = 0
    long: dict[str, int] = {}
    for w, n in count.items():
        about = known.get(w)
        if about is None:
            lower = w.lower()
            about = known[w] = (lower if len(w) > 4 else None, syllables(lower))
        if about[1]:
            n_words += n
            n_syllables += about[1] * n
        if about[0] is not None:
            long[about[0]] = long.get(about[0], 0) + n
    # the most common long word; the first one of equals, as both tables keep the order of first sight
    top, top_n = max(long.items(), key=lambda x: x[1]) if long else (None, 0)
    often = {w for w, n in count.items() if n > 3}  # a bigram comes no more often than its words
    pairs = Counter((a, b) for a, b in zip(words, words[1:]) if a in often and b in often) if often else {}  # noqa: B905
    lengths = [len(s.split()) for s in (p.strip() for p in _STOP.split(text)) if len(s) > 5]
    return (len(words), sum(long.values()), top, top_n, sum(n > 3 for n in pairs.values()), n_words, n_syllables,
            len(lengths), sum(lengths), sum(x * x for x in lengths),
            sum(p in low for p in params.ai_phrases), sum(p in low for p in params.discussion_markers), len(text.strip()))


def text_stats(text: Column, params: Params = DEFAULT) -> Column:
    """struct of ``FIELDS``: the raw counts that the text rules are built from.  A null text counts as empty."""

    @F.arrow_udf("struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS) + ">")
    def stats(texts: pa.Array) -> pa.Array:
        known: dict[str, tuple] = {}
        rows = []
        for t in texts:  # one text at a time: a batch is held as Arrow has it, not as Python strings too
            rows.append(count_text(t.as_py() or "", params, known))
            if len(known) > KNOWN:
                known.clear()
        columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, FIELDS, strict=True)], [n for n, _ in FIELDS])

    # so declared, the optimizer evaluates it once and where it stands: a filter on a score isn't moved below an exchange with it
    return stats.asNondeterministic()(text)
