"""Line dedup: an exact set-similarity join of lines, and removal of later matches.

A line is removed when an earlier line of the corpus, by (id, line number), has a word set of Jaccard 0.8 or more
with its own.  All lines that have a word are compared.

1. Texts are split into words once; what follows works on the words' hashes, kept on disk until the sets are written.  A count sketch of them gives their order
   by rarity, ties by hash: one byte a bucket, fixed in size whatever the corpus.
2. Of equal word sets only the first place goes on (found by partial aggregation before the shuffle); all
   other places of it are removed.  A set goes by the number that its row got when it was written.
3. Sets that begin or end with the same words are verified against the first of them.  This decides most of a family of near copies at one pair a line.
   Of words that many of the lines found alike have, some of the first lines then meet what isn't decided, so that it needn't
   meet every member of a large family in 4.
4. Prefix join: lines that are not yet decided meet earlier ones on the rarest words that a pair may not miss, of which the smaller
   line of a pair needs about half as many.  A pair is
   a candidate if its sizes, the positions of the shared word and parity maps of the sets (64 bits, 128 for larger sets) leave the bound on the
   overlap within reach.  A line that is removed meets no more earlier lines, but later ones still meet it.
5. Candidates are verified on the words themselves.

Defined cases: null texts have no lines; rows with a null id neither lose lines nor remove any; of rows with
the same id the line number, then the text's hash decides what is earlier; equal rows keep and lose the same lines;
an empty table gives an empty result.  Texts stay whole but for the lines removed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.interim import passing
from ..operators.joins import sized_broadcast
from .common import fresh, stash, text_key

BITS = 16
#: Words of a set that 64 parity bits are enough for.
SMALL = 48
BLOCK = 1 << 14


@dataclass(frozen=True)
class LineParams:
    percent: int = 80
    #: Words at either end of a line that near copies are first looked up by.
    ends: int = 6
    #: First lines of a word that stand for a large family, each for so many of its lines at least.
    heads: int = 8
    many: int = 4
    #: Lines found to go that share one of their first words, from which on they no longer meet each other on it.
    crowd: int = 64


DEFAULT = LineParams()


#: ASCII white space within a line, but for the blank.
SPACES = "\t\x0b\f\r"


def _words(line):
    """Lower-cased words between ASCII white space; a split at one plain character needs no regular expression.

    Few lines have other white space than blanks: replacing reads a line once for each character, looking for them is much cheaper."""
    blanks = reduce(lambda x, space: F.replace(x, F.lit(space), F.lit(" ")), SPACES, line)
    odd = reduce(lambda x, y: x | y, [F.contains(line, F.lit(space)) for space in SPACES])
    return F.array_remove(F.split(F.lower(F.when(odd, blanks).otherwise(line)), " "), "")


def rarity(lines: DataFrame) -> bytes:
    """A byte for each of 2^BITS hash buckets: in how many lines its words occur, on a log scale.  ``lines`` has hashes ``h``.

    Counted and put together by Spark; fixed in size, and small, as plans hold it (and their descriptions print it)."""
    n = 1 << BITS
    counts = lines.select(F.explode("h").alias("x")).groupBy(_bucket(F.col("x")).alias("b")).agg(F.count("*").alias("n"))
    mark = F.least(F.lit(90), F.floor(4 * F.log2(1 + F.coalesce("n", F.lit(0))))).cast("int") + 33
    all_of = lines.sparkSession.range(n).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", F.chr(mark).alias("mark"))
    block = all_of.groupBy(F.expr(f"b div {BLOCK}").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("b", "mark"))).getField("mark"), "").alias("marks"))
    return "".join(r["marks"] for r in block.orderBy("k").collect()).encode()  # n bytes


def _bucket(h):
    return h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def words_of(docs: DataFrame, p: LineParams) -> DataFrame:
    """id, key, line, begins, ends and the distinct words' hashes h of every line with a word."""
    # explode() of one array computes it once: filters on the result would else be pushed below, and its steps with them
    d = docs.where("id is not null").select("id", "key", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    d = d.select("id", "key", "line", F.explode(F.array(_words(F.col("s")))).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - F.lit(p.ends - 1), F.lit(1))
    return d.select(
        "id", "key", "line", F.xxhash64(F.slice("w", 1, p.ends)).alias("begins"), F.xxhash64(F.slice("w", last, p.ends), F.lit(1)).alias("ends"),
        F.array_distinct(F.transform("w", lambda x: F.xxhash64(x))).alias("h"))


def lines_of(words: DataFrame, p: LineParams) -> DataFrame:
    """id, key, line, sid (of the word set), parities, size, prefix, begins, ends and a number of every line."""
    marks = F.split(F.lit(",".join(str(x - 33) for x in rarity(words))), ",").cast("array<bigint>")  # folded before it runs
    # lambdas in steps of their own: what reads their result is compiled, and arrays without nulls are sorted as plain longs
    r = F.transform("h", lambda h: F.coalesce(F.shiftleft(F.get(marks, _bucket(h)), 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1))), F.lit(0).cast("long")))
    d = words.select(
        "id", "key", "line", "begins", "ends",
        F.expr("aggregate(h, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63L as int)))").alias("all"),
        # 64 bits tell small sets apart; of larger ones, those of every other hash by themselves too
        F.when(F.size("h") > SMALL, F.expr("aggregate(h, 0L, (a, x) -> a ^ shiftleft((x >> 6) & 1L, cast(x & 63L as int)))")).otherwise(F.lit(0).cast("long")).alias("odd"),
        r.alias("r"))
    d = d.select("id", "key", "line", "begins", "ends", "all", "odd", F.sort_array("r").alias("r"))
    size = F.size("r")
    length = size - F.expr(f"cast(({p.percent} * size(r) + 99) div 100 as int)") + 1
    return d.select(
        "id", "key", "line", F.monotonically_increasing_id().alias("n"), F.xxhash64("r").alias("sid"), size.alias("size"), "all", "odd",
        F.transform(F.slice("r", F.lit(1), length), lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("prefix"),
        "begins", "ends")


def _within(p: LineParams):
    """Sizes and parity maps of sets a and b allow the threshold; the least overlap."""
    x, y = F.col("size_a"), F.col("size_b")
    least = F.expr(f"({p.percent} * (size_a + size_b) + {100 + p.percent - 1}) div {100 + p.percent}")
    every, odd = (F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")) for c in ("all", "odd"))
    split = F.bit_count(odd) + F.bit_count(every.bitwiseXOR(odd))
    apart = F.when((x > SMALL) & (y > SMALL), split).otherwise(F.bit_count(every))
    return (100 * F.least(x, y) >= p.percent * F.greatest(x, y)) & (apart <= x + y - 2 * least), least


def _named(df: DataFrame, x: str, *keep: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{c}_{x}") for c in df.columns])


def verified(pairs: DataFrame, lines: DataFrame, docs: DataFrame, p: LineParams) -> DataFrame:
    """The pairs whose line n_b reaches the threshold with an earlier one, n_a, on the words; they may come twice."""
    wanted = stash(pairs.select(F.col("n_a").alias("n")).unionByName(pairs.select(F.col("n_b").alias("n"))).distinct(), "line-numbers")
    wanted = lines.select("n", "id", "line", "key").join(sized_broadcast(wanted, 1_000_000), "n")
    wanted = stash(wanted.groupBy(F.col("id").alias("wid"), F.col("key").alias("wkey")).agg(
        F.collect_list(F.struct("n", "line")).alias("at")), "line-wanted")  # of one document
    held = docs.join(sized_broadcast(wanted, 300_000), (docs["id"] == wanted["wid"]) & (docs["key"] == wanted["wkey"]))
    text = held.withColumn("lines", F.split("text", "\n")).select("id", "key", F.explode("at").alias("x"), "lines").select(
        "x.n", F.struct("id", "x.line", "key").alias("place"), F.get("lines", F.col("x.line")).alias("s"))
    text = stash(text, "line-texts")  # equal rows give a line twice, to no effect
    both = pairs.join(_named(text, "a"), "n_a").join(_named(text, "b"), "n_b").where("place_a < place_b")
    for x in "ab":  # explode() of one array computes it once
        both = both.select("*", F.explode(F.array(F.array_distinct(_words(F.col(f"s_{x}"))))).alias(x)).drop(f"s_{x}")
    both = both.select("*", F.explode(F.array(F.size(F.array_intersect("a", "b")))).alias("o"))
    return both.where(100 * F.col("o") >= p.percent * (F.size("a") + F.size("b") - F.col("o"))).select("n_a", "n_b")


def _marked(sets: DataFrame, gone: DataFrame) -> DataFrame:
    """``sets``, done where the line is in ``gone``."""
    done = sized_broadcast(gone.withColumn("done", F.lit(True)), 1_000_000)
    sets = sets.select("n", "id", "size", "all", "odd", "prefix").join(done, "n", "left")
    return sets.withColumn("done", F.coalesce("done", F.lit(False)))


def _spread(sets: DataFrame, prefix) -> DataFrame:
    """A row for each word of ``prefix``."""
    return sets.select("n", "id", "size", "all", "odd", "done", F.posexplode(prefix).alias("pos", "word"))


def _candidates(a: DataFrame, b: DataFrame, p: LineParams) -> DataFrame:
    """Pairs n_a, n_b of posts on a word that may reach the threshold, n_b not done."""
    may, least = _within(p)
    near = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) >= least
    return _named(a, "a", "word").join(_named(b, "b", "word"), "word").where(
        (F.col("n_a") != F.col("n_b")) & (F.col("id_a") <= F.col("id_b")) & may & near & ~F.col("done_b")).select("n_a", "n_b").distinct()


def _remaining(sets: DataFrame, gone: DataFrame, p: LineParams) -> DataFrame:
    """Pairs n_a, n_b of an earlier and a later line, the later one not in ``gone``, that may reach the threshold.

    A pair meets on a prefix word of the larger line that is among the first words of the smaller: its overlap is 2t / (1 + t) of the
    smaller size at least, so that needs fewer of them.  On words of ``crowd`` smaller lines that are done, these meet under a name of
    its own (the complement) only lines that aren't: a large family would else meet itself."""
    few = F.expr(f"size - cast(({2 * p.percent} * size + {99 + p.percent}) div {100 + p.percent} as int) + 1")
    sets = _marked(sets, gone)
    small, large = (_spread(sets, x) for x in (F.slice("prefix", F.lit(1), few), F.col("prefix")))
    crowds = stash(small.where("done").groupBy("word").agg(F.count("*").alias("m")).where(F.col("m") >= p.crowd).select("word", F.lit(True).alias("crowd")), "line-crowds")
    crowds, other = sized_broadcast(crowds, 1_000_000), F.bitwise_not("word")
    small = small.join(crowds, "word", "left").withColumn("word", F.when(F.col("crowd") & F.col("done"), other).otherwise(F.col("word")))
    names = F.when(F.col("crowd") & ~F.col("done"), F.array("word", other)).otherwise(F.array("word"))
    large = large.join(crowds, "word", "left").select(*[c for c in large.columns if c != "word"], F.explode(names).alias("word"))
    return _meet(small.drop("crowd"), large, p)


def _meet(small: DataFrame, large: DataFrame, p: LineParams) -> DataFrame:
    """Pairs n_a, n_b of ``small`` and ``large`` posts on a word that may reach the threshold, the later line not done."""
    may, least = _within(p)
    near = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) >= least
    smaller = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("n_a") != F.col("n_b")))
    both = _named(small, "a", "word").join(_named(large, "b", "word"), "word").where(smaller & near & may)
    earlier = (F.col("id_a") <= F.col("id_b")) & ~F.col("done_b")
    later = (F.col("id_b") <= F.col("id_a")) & ~F.col("done_a")
    a, b = F.col("n_a"), F.col("n_b")
    ways = F.array(F.when(earlier, F.struct(a.alias("n_a"), b.alias("n_b"))), F.when(later, F.struct(b.alias("n_a"), a.alias("n_b"))))
    return both.where(earlier | later).select("n_a", "n_b", F.explode(ways).alias("way")).where("way is not null").select("way.n_a", "way.n_b").distinct()


def _heads(alike: DataFrame, sets: DataFrame, gone: DataFrame, p: LineParams) -> DataFrame:
    """Posts of the first of the lines in ``alike`` that share a word, for words that many of them have."""
    members = alike.select(F.col("n_a").alias("n")).unionByName(alike.select(F.col("n_b").alias("n"))).distinct()
    post = _spread(_marked(sets.join(sized_broadcast(members, 1_000_000), "n"), gone), "prefix")
    first = F.min(F.struct("id", "n", "size", "all", "odd", "done", "pos")).alias("a")
    return post.groupBy("word", F.pmod("n", F.lit(p.heads)).alias("part")).agg(first, F.count("*").alias("m")).where(F.col("m") >= p.many).select("word", "a.*")


def _more(gone: DataFrame, pairs: DataFrame) -> DataFrame:
    return stash(gone.unionByName(pairs.select(F.col("n_b").alias("n"))).distinct(), "line-gone")


def removed_lines(docs: DataFrame, p: LineParams = DEFAULT) -> DataFrame:
    """(id, key, line) of the lines to remove.  ``docs`` has id, key, text."""
    words = words_of(docs, p).persist(StorageLevel.DISK_ONLY)  # arrays are kept as they are, Parquet would take them apart
    try:
        lines = stash(lines_of(words, p), "line-sets")
    finally:
        words.unpersist(True)
    # 2. the first places of sets that have several
    copies = lines.groupBy("sid").agg(F.min(F.struct("id", "line", "key", "n")).alias("first"), F.count("*").alias("places")).where("places > 1")
    copies = stash(copies.select("sid", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("id", "line", "key", "n")]), "line-copies")
    named = lines.join(sized_broadcast(copies, 1_000_000), "sid", "left").withColumn("root", F.coalesce("first_n", "n"))
    # sets too small to reach the threshold with any other set are done: with percent 80, below four words
    sets = named.where("n = root").where((100 - p.percent) * F.col("size") >= p.percent)
    # 3. the first of those that look alike; lines at the same place of rows that share an id are left to 4
    may, _ = _within(p)
    at = sets.select("id", "line", "n", "size", "all", "odd", F.explode(F.array("begins", "ends")).alias("k"))
    first = at.groupBy("k").agg(F.min(F.struct("id", "line", "n", "size", "all", "odd")).alias("a"), F.count("*").alias("m")).where("m > 1").select("k", "a.*")
    later = (F.col("id_b") > F.col("id_a")) | ((F.col("id_b") == F.col("id_a")) & (F.col("line_b") > F.col("line_a")))
    with passing() as keep:
        first = sized_broadcast(stash(first, "line-firsts"), 300_000)
        family = _named(at, "b", "k").join(_named(first, "a", "k"), "k").where(later & may).select("n_a", "n_b").distinct()
        alike = stash(verified(stash(family, "line-family"), lines, docs, p).distinct(), "line-alike")
        gone = keep(stash(alike.select(F.col("n_b").alias("n")).distinct(), "line-gone"))
        heads = keep(stash(_heads(alike, sets, gone, p), "line-heads"))
    if not heads.isEmpty():
        with passing() as keep:
            pairs = _candidates(sized_broadcast(heads, 1_000_000), _spread(_marked(sets, gone), "prefix"), p)
            gone = keep(_more(gone, verified(stash(pairs, "line-pairs"), lines, docs, p)))
    # 4. prefix join of the rest with all earlier lines
    with passing() as keep:
        gone = keep(_more(gone, verified(stash(_remaining(sets, gone, p), "line-pairs"), lines, docs, p)))
    gone = sized_broadcast(gone.select(F.col("n").alias("root"), F.lit(True).alias("gone")), 1_000_000)
    first = (F.col("id") == F.col("first_id")) & (F.col("line") == F.col("first_line")) & (F.col("key") == F.col("first_key"))
    named = named.select("id", "key", "line", "root", "first_id", "first_line", "first_key")
    return named.join(gone, "root", "left").where(F.col("gone") | ~first).select("id", "key", "line").distinct()


def dedup(docs: DataFrame, params: LineParams = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the text that is left and counts of lines and of removed lines, under names that don't clash."""
    names = dict(zip(("n_lines", "n_removed", "gone", "lines", "left"), fresh(docs, "line_n", "line_removed", "line_gone", "line_all", "line_left"), strict=True))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    with passing() as keep:
        gone = removed_lines(d, params).groupBy("id", "key").agg(F.sort_array(F.collect_list("line")).alias("lines"))  # of one document
        gone = keep(stash(gone, "line-removed"))
    i, k = fresh(docs, "__line_id", "__line_key")
    gone = sized_broadcast(gone.select(F.col("id").alias(i), F.col("key").alias(k), F.col("lines").alias(names["gone"])), 300_000)
    out = docs.join(gone, (docs[id_col] == gone[i]) & (text_key(docs[text_col]) == gone[k]), "left").drop(i, k)
    # a column of its own: as part of the lambda the text would be split again for each line
    out = out.withColumn(names["lines"], F.split(F.col(text_col), "\n"))
    out = out.withColumns({names["n_lines"]: F.coalesce(F.size(names["lines"]), F.lit(0)), names["n_removed"]: F.coalesce(F.size(names["gone"]), F.lit(0))})
    stay = F.array_except(F.sequence(F.lit(0), F.size(names["lines"]) - 1), F.col(names["gone"]))
    left = F.array_join(F.transform(stay, lambda j: F.get(F.col(names["lines"]), j)), "\n")
    # explode() of one array computes it once, for filters on the text too
    out = out.select("*", F.explode(F.array(F.when(F.col(names["gone"]).isNull(), F.col(text_col)).otherwise(left))).alias(names["left"]))
    text = [F.col(names["left"]).alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*text, names["n_lines"], names["n_removed"]), names


def filter_documents(docs: DataFrame, params: LineParams = DEFAULT) -> DataFrame:
    """``docs`` without the removed lines, and without rows that lost all their words; columns as they are."""
    out, n = dedup(docs, params)
    return out.where((F.col(n["n_removed"]) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def line_digest(docs: DataFrame, params: LineParams = DEFAULT) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every document."""
    out, n = dedup(docs, params)
    return out.select("doc_id", F.col(n["n_lines"]).cast("long").alias("n_lines"), F.col(n["n_removed"]).cast("long").alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
