"""Row-level text helpers shared by the text statistics, the blocklist
parser and the shingler.  Tokenisation and stripping follow Python's
``str.split()`` / ``str.strip()`` whitespace set exactly.  The counting
statistics themselves are keyed Spark jobs (``operators/text_stats.py``):
array lambdas are interpreted per element and were measured far slower.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python str.split() / str.strip() whitespace, as one character class that both
# Java regex and RE2 understand.
WS = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


#: The same characters, singly.
_ONE = [*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000]
WS_CHARS = "".join(map(chr, _ONE))
#: The same class for Java: a bit set up to U+00FF, and one range that nearly all other characters miss before the rest is tried.
_WS_FAST = "[" + "".join(rf"\x{{{c:x}}}" for c in _ONE if c < 256) + r"[\x{1680}-\x{3000}&&[" + "".join(rf"\x{{{c:x}}}" for c in _ONE if c > 255) + "]]]"


def py_strip(text: Column) -> Column:
    """``text.strip()``; looks at the ends only."""
    return F.btrim(text, F.lit(WS_CHARS))


def tokens(text: Column) -> Column:
    """``text.split()`` without a lambda: split the stripped text on
    whitespace runs; an all-blank text has no tokens.  Who needs the array more than
    once selects it first, so that it is computed once."""
    return F.array_remove(F.split(F.coalesce(py_strip(text), F.lit("")), _WS_FAST + "+"), "")


def count_contained(lower_text: Column, phrases) -> Column:
    """Number of distinct phrases that occur as substrings."""
    if not phrases:
        return F.lit(0)
    return reduce(add, [F.when(F.instr(lower_text, p) > 0, 1).otherwise(0) for p in phrases])
