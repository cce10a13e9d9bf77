"""Line dedup: an exact set-similarity self-join of all lines.

A line's tokens are its distinct words, held as 64-bit hashes. Lines with the
same token set form a class, and the classes are joined. Tokens are ordered
by rarity: words are counted in BUCKETS buckets of their hash, and a token's
rank is the logarithm of its bucket's count. The table of ranks has a fixed
size, so it goes to every task as one value, and a line is ordered where it
is read; only its prefix is moved. The order decides the cost and never the
result, which is exact in any one order of all tokens:

* prefix filter: two sets with Jaccard 0.75 or more share one of the first
  n - ceil(0.75 n) + 1 tokens of either, and of the smaller one's first
  n / 7 + 1 (used in short lists);
* length filter: 3 * larger <= 4 * smaller;
* positional filter: the tokens from the shared one on must suffice;
* bitmap filter: the sets differ in no more tokens than they may, by sketches
  of 64 or 128 bits;
* the survivors' Jaccard is computed from the whole sets.

A line is removed if an earlier line, in the order of (id, text hash where
rows share an id, line number), has its token set or one that similar. One
match is enough, and this keeps the work linear within large groups of alike
lines: in the lists of its HEAD rarest words a line is first held only against
the first line and the NEIGHBOURS lines before it. Two lines with a match by
then are not paired any more. Long lists (HOT) are all treated so, and only
lines without a match after that are joined with them as a whole. Of each line's
candidates the one with the nearest sketch is verified first, the others only
if that fails. Nothing is dropped by either.

DataFrame operations only. Defined results: a null text stays null and has
no lines; lines without a word are never removed; rows equal in id and text
are treated alike, as one row; other columns pass through.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bound
from ..session import discard, settle
from .native import join_on, small, within

BUCKET_BITS = 20  # words are counted in 2 ** 20 buckets
STEPS = 3  # ranks for each doubling of a count
HOT = 512  # entries of a bucket of lists, beyond four times the mean, from which on its lists are long
PART = 16_384  # entries for each part that a long list is cut into
WIDE = 64  # tokens from which on a sketch has 128 bits, not 64
HEAD = 2  # rarest words by which every line is first held against neighbours
NEIGHBOURS = 2  # lines of a list before its own that a line is held against
KEY_ROWS = 1_000_000  # bound for broadcasting keys of classes
LINE_ROWS = 2_000_000  # bound for broadcasting places of lines

LINE = ["doc_id", "copy", "line_no"]
_OTHER_SPACE = "\t\x0b\x0c\r"  # but the line feed, between lines
_HASH_BITS = 56


def _plain(text: Column) -> Column:
    """Every ASCII white space but the line feed as a space."""
    some = reduce(lambda x, y: x | y, [F.contains(text, F.lit(c)) for c in _OTHER_SPACE])
    return F.when(some, F.translate(text, _OTHER_SPACE, " " * len(_OTHER_SPACE))).otherwise(text)


def _numbered(documents: DataFrame, text: str, id_column: str) -> DataFrame:
    """``documents`` with ``__copy``: a hash of the text where rows share an
    id, else 0."""
    several = documents.groupBy(F.col(id_column).alias("__id")).agg(F.count("*").alias("__rows")).where("__rows > 1")
    several = settle(several, "several")
    if several.isEmpty():
        return documents.withColumn("__copy", F.lit(0).cast("bigint"))
    on = F.col(f"a.`{id_column}`").eqNullSafe(F.col("b.__id"))
    rows = documents.alias("a").join(small(several, KEY_ROWS).alias("b"), on, "left").select("a.*", "b.__rows")
    return rows.withColumn("__copy", F.when(F.col("__rows").isNull(), F.lit(0)).otherwise(F.xxhash64(text)).cast("bigint")).drop("__rows")


def _hashes(line: Column) -> Column:
    """Hashes of the distinct words of a line."""
    words = F.array_distinct(F.transform(F.split(line, " ", -1), lambda w: F.xxhash64(w)))
    wide = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(wide, F.array_remove(words, F.xxhash64(F.lit("")))).otherwise(words)


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")


def _table(hashes: DataFrame, value, name: str) -> DataFrame:
    """One row with an array: ``value`` of each bucket's count, in order."""
    counts = hashes.groupBy(_bucket(F.col("h")).alias("bucket")).agg(F.count("*").alias("n"))
    every = hashes.sparkSession.range(1 << BUCKET_BITS).join(counts, F.col("id") == F.col("bucket"), "left")
    every = every.select("id", value(F.coalesce("n", F.lit(0))).alias("value"))
    some = every.groupBy(F.shiftright("id", 10).alias("some")).agg(F.sort_array(F.collect_list(F.struct("id", "value"))).alias("of"))
    some = some.select("some", F.transform("of", lambda x: x["value"]).alias("of"))
    one = some.agg(F.sort_array(F.collect_list(F.struct("some", "of"))).alias("of"))
    return settle(one.select(F.flatten(F.transform("of", lambda x: x["of"])).alias(name)), name)


def _ranks(docs: DataFrame) -> DataFrame:
    """One row: the ranks of all buckets of words."""
    # Outer, as Spark else splits each text once more to see that it has words.
    text = F.replace(_plain(F.col("text")), F.lit("\n"), F.lit(" "))
    words = docs.select(F.explode_outer(F.split(text, " ", -1)).alias("word")).where("word <> ''")
    rank = lambda n: F.floor(STEPS * F.log2(F.greatest(n, F.lit(1)))).cast("tinyint")
    return _table(words.select(F.xxhash64("word").alias("h")), rank, "ranks")


def _spare(n: Column) -> Column:
    """How many of n tokens a similar set may lack."""
    return n - F.ceil(n * 3 / 4).cast("int")


def _sets(docs: DataFrame) -> DataFrame:
    """A row for each line with words: LINE, key (of the class), n, the
    sketch s1, s2, and the prefix by rarity; a token holds its rank above
    _HASH_BITS bits of the hash. docs: doc_id, copy, text."""
    lines = docs.select("doc_id", "copy", F.split(_plain(F.col("text")), "\n", -1).alias("lines"))
    lines = lines.select("doc_id", "copy", F.posexplode_outer("lines").alias("line_no", "line")).where(F.trim("line") != "")
    # The table of ranks stands in the expression that reads it, as a scalar
    # subquery; no row carries it. An array that may hold nulls is sorted
    # boxed, so no rank is null.
    lines = lines.withColumn("ranks", _ranks(docs).scalar())
    token = lambda h: F.shiftleft(F.coalesce(F.get("ranks", _bucket(h)), F.lit(0)).cast("bigint"), _HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << _HASH_BITS) - 1)))
    lines = lines.select(*LINE, F.sort_array(F.transform(_hashes(F.col("line")), token)).alias("tokens"))
    s1, s2 = _sketch(F.col("tokens"))
    n = F.size("tokens")
    return lines.select(*LINE, F.xxhash64("tokens").alias("key"), n.alias("n"), s1.alias("s1"), s2.alias("s2"), F.slice("tokens", F.lit(1), _spare(n) + 1).alias("prefix"))


def _sketch(tokens: Column) -> tuple[Column, Column]:
    """64 bits of a set: each token's hash flips one. And of a set of more
    than WIDE tokens the part of them that half of its tokens make, which
    makes 128 bits. Sets differ in as many tokens at least as in bits."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    flip = lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", one, t.bitwiseAND(F.lit(63)).cast("int")))
    half = F.aggregate(F.filter(tokens, lambda t: t.bitwiseAND(F.lit(64)) == 64), none, flip)
    return F.aggregate(tokens, none, flip), F.when(F.size(tokens) > WIDE, half).otherwise(none)


def _apart(a: str, b: str) -> Column:
    (n1, a1, a2), (n2, b1, b2) = ([F.col(f"{x}{c}") for c in ("n", "s1", "s2")] for x in (a, b))
    whole, half = a1.bitwiseXOR(b1), a2.bitwiseXOR(b2)
    wide = F.bit_count(whole.bitwiseXOR(half)) + F.bit_count(half)
    return F.when((n1 > WIDE) & (n2 > WIDE), wide).otherwise(F.bit_count(whole))


def _fits(a: str, b: str) -> Column:
    """Length, positional and bitmap filters of two entries with n, pos, s1
    and s2; positions count from 0."""
    (n1, p1), (n2, p2) = ([F.col(f"{x}{c}") for c in ("n", "pos")] for x in (a, b))
    rest = F.least(n1 - p1, n2 - p2)
    return (3 * F.greatest(n1, n2) <= 4 * F.least(n1, n2)) & (7 * rest >= 3 * (n1 + n2)) & (7 * _apart(a, b) <= n1 + n2)


def _neighbours(postings: DataFrame) -> DataFrame:
    """x, y, apart: each line with those just before it and the first one of
    its lists, where they pass the filters."""
    mine = [*LINE, "key", "n", "pos", "s1", "s2"]
    entry = F.struct("key", "n", "pos", "s1", "s2")

    def met(rows: DataFrame, keys: list) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*LINE, "key")
        head = F.first(entry).over(w.rowsBetween(Window.unboundedPreceding, 0))
        near = [F.lag(entry, k).over(w).alias(f"e{k}") for k in range(1, NEIGHBOURS + 1)]
        found = rows.select("token", "parts", *mine, head.alias("e0"), *near)
        early = [F.when(_fits("", f"e{k}."), F.struct(F.col(f"e{k}.key").alias("y"), _apart("", f"e{k}.").alias("apart"))) for k in range(NEIGHBOURS + 1)]
        pairs = found.where("e1 is not null").select(F.col("key").alias("x"), F.explode(F.array(*early)).alias("e"))
        return pairs.select("x", "e.*").where("x <> y")

    def heads(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("token", "part").orderBy(*LINE, "key")
        return rows.withColumn("place", F.row_number().over(w)).where("place = 1").select("token", "parts", *mine)

    parts = F.greatest(F.ceil(F.col("size") / PART), F.lit(1)).cast("int")
    cut = postings.withColumn("parts", parts).withColumn("part", F.pmod("key", F.col("parts")))
    # Few lists have several parts, and only those are sorted once more.
    return met(cut, ["token", "part"]).unionByName(met(heads(cut.where("parts > 1")), ["token"]))


def _words(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """key and the hashes of all words, of classes with their first LINE."""
    some = within(classes, LINE_ROWS)
    wanted = classes.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("line_no", "key")).alias("wanted"))
    found = join_on(docs, F.broadcast(wanted) if some else wanted, ["doc_id", "copy"])
    pick = lambda lines: F.transform("wanted", lambda w: F.struct(w["key"].alias("key"), F.get(lines, w["line_no"]).alias("line")))
    lines = found.select(F.explode(bound(F.split(_plain(F.col("text")), "\n", -1), pick)).alias("of"))
    return settle(lines.select("of.key", _hashes(F.col("of.line")).alias("words")).dropDuplicates(["key"]), "whole")


def _similar(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The late lines of pairs whose Jaccard is 0.75 or more."""
    a, b = (words.select(F.col("key").alias(c), F.col("words").alias(f"{c}_words")) for c in ("late", "early"))
    both = F.size(F.array_intersect("late_words", "early_words"))
    out = pairs.join(a, "late").join(b, "early").where(7 * both >= 3 * (F.size("late_words") + F.size("early_words")))
    return settle(out.select(F.col("late").alias("key")).distinct(), "similar")


def similar_lines(docs: DataFrame) -> DataFrame:
    """The lines to remove, as LINE. docs: doc_id, copy, text."""
    sets = settle(_sets(docs), "sets")
    lines = settle(sets.select(*LINE, "key"), "lines")
    # Sets of one class are equal, so any of them is taken.
    first = F.min(F.struct(*LINE, "n", "s1", "s2", "prefix"))
    classes = settle(sets.groupBy("key").agg(first.alias("f"), F.count("*").alias("copies")).select("key", "copies", "f.*"), "classes")
    discard(sets)
    own = F.struct(*LINE)
    entries = lambda of, prefix: of.select(*LINE, *[c for c in of.columns if c in ("key", "n", "s1", "s2", "gone")], F.posexplode(prefix).alias("pos", "token"))
    # A list is no longer than its bucket's words are many: only those of many
    # words are counted, the others' size stays 0.
    many = F.shiftright("token", _HASH_BITS) >= int(STEPS * math.log2(HOT))
    sizes = _table(entries(classes, "prefix").where(many).select(F.col("token").alias("h")), lambda n: n.cast("int"), "sizes")
    sized = lambda of: of.withColumn("size", F.get(sizes.scalar(), _bucket(F.col("token"))))
    mean = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    long = HOT + 4 * (mean >> BUCKET_BITS)
    left = lambda df, c: df.join(small(gone.withColumnRenamed("key", c), KEY_ROWS), c, "left_anti")
    whole = lambda keys: _words(docs, classes.select("key", *LINE).join(small(keys, KEY_ROWS), "key", "left_semi"))
    # Most alike lines share one of their rarest words: neighbours by these
    # first. Two lines that have a match need no pair with each other then.
    head = settle(_neighbours(sized(entries(classes, F.slice("prefix", 1, HEAD)))).distinct(), "head")
    nearest = head.groupBy("x").agg(F.min_by("y", F.struct("apart", "y")).alias("y"))
    nearest = settle(nearest.select(F.col("x").alias("late"), F.col("y").alias("early")), "nearest")
    gone = _similar(nearest, whole(settle(nearest.select(F.explode(F.array("late", "early")).alias("key")).distinct(), "some")))
    flags = small(gone.withColumn("gone", F.lit(True)), KEY_ROWS)
    postings = sized(entries(classes.join(flags, "key", "left").withColumn("gone", F.col("gone").isNotNull()), "prefix"))
    # Short lists as a whole, and neighbours in long ones.
    filled = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    short = postings.where(F.col("size") <= long).select(*[filled(c) for c in ("token", "key", "n", "pos", "s1", "s2")], "gone")
    # The larger set of a pair is a, and b has a shared token in a shorter prefix
    # than a: of 7 tokens 6 are shared. A condition that Spark takes for random
    # stays above the exchange, so that both sides read the same one.
    short = short.repartition("token")
    a, b = short.alias("a"), short.where(F.when(F.monotonically_increasing_id() >= 0, 7 * F.col("pos") <= F.col("n"))).alias("b")
    sized_apart = (F.col("a.n") >= F.col("b.n")) & (3 * F.col("a.n") <= 4 * F.col("b.n")) & ((F.col("a.n") > F.col("b.n")) | (F.col("a.key") < F.col("b.key")))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & sized_apart & ~(F.col("a.gone") & F.col("b.gone")) & _fits("a.", "b."))
    pairs = pairs.select(F.col("a.key").alias("x"), F.col("b.key").alias("y"), _apart("a.", "b.").alias("apart"))
    pairs = settle(pairs.distinct(), "pairs")
    hot = settle(postings.where(F.col("size") > long), "hot")
    met = settle(left(_neighbours(hot).distinct(), "x"), "met")
    some = pairs.unionByName(met).select(F.explode(F.array("x", "y")).alias("key"))
    firsts = settle(classes.select("key", own.alias("line")).join(small(settle(some.distinct(), "some"), KEY_ROWS), "key", "left_semi"), "firsts")
    name = lambda k: firsts.select(F.col("key").alias(k), F.col("line").alias(f"{k}_line"))
    known = pairs.unionByName(met).join(name("x"), "x").join(name("y"), "y")
    later = F.col("x_line") > F.col("y_line")
    known = known.select(F.when(later, F.col("x")).otherwise(F.col("y")).alias("late"), F.when(later, F.col("y")).otherwise(F.col("x")).alias("early"), "apart")
    known = settle(left(known, "late").distinct(), "known")
    some = known.select(F.explode(F.array("late", "early")).alias("key")).unionByName(hot.select("key"))
    words = whole(settle(some.distinct(), "some"))
    nearest = known.groupBy("late").agg(F.min_by("early", F.struct("apart", "early")).alias("early"))
    gone = settle(gone.unionByName(_similar(nearest, words)), "gone")
    more = _similar(left(known, "late").select("late", "early"), words)
    gone = settle(gone.unionByName(more), "gone")
    # Lines still without a match, against all earlier ones of long lists.
    a, b = left(hot, "key").alias("a"), hot.alias("b")
    earlier = F.struct(*[F.col(f"b.{c}") for c in LINE]) < F.struct(*[F.col(f"a.{c}") for c in LINE])
    rest = a.join(b, (F.col("a.token") == F.col("b.token")) & _fits("a.", "b.") & earlier)
    rest = settle(rest.select(F.col("a.key").alias("late"), F.col("b.key").alias("early")).distinct(), "rest")
    more = _similar(rest, words)
    gone = gone.unionByName(more).distinct().withColumn("gone", F.lit(True))
    verdict = classes.select("key", "copies", own.alias("first")).join(small(settle(gone, "gone"), KEY_ROWS), "key", "left")
    verdict = settle(verdict.where((F.col("copies") > 1) | F.col("gone")), "verdict")
    discard(classes)
    out = lines.join(small(verdict, KEY_ROWS), "key").where(F.col("gone").isNotNull() | ~own.eqNullSafe(F.col("first")))
    return settle(out.select(*LINE).distinct(), "removed")


def dedup_lines(documents: DataFrame, text: str = "text", id_column: str = "doc_id", counts: bool = False) -> DataFrame:
    """``documents`` with the text less its removed lines; with ``counts``
    also n_lines and n_removed."""
    rows = _numbered(documents, text, id_column)
    docs = rows.where(F.col(text).isNotNull()).select(F.col(id_column).alias("doc_id"), F.col("__copy").alias("copy"), F.col(text).alias("text"))
    lines = similar_lines(docs)
    gone = lines.groupBy("doc_id", "copy").agg(F.collect_list("line_no").alias("__gone")).withColumnsRenamed({"doc_id": "__id", "copy": "__of"})
    a, b = rows.alias("a"), (F.broadcast(gone) if within(lines, LINE_ROWS) else gone).alias("b")
    on = F.col(f"a.`{id_column}`").eqNullSafe(F.col("b.__id")) & F.col("a.__copy").eqNullSafe(F.col("b.__of"))
    out = a.join(b, on, "left").select("a.*", "b.__gone").drop("__copy")
    lines = F.split(F.col(text), "\n", -1)
    places = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "__gone")
    kept = bound(lines, lambda x: F.array_join(F.transform(places(x), lambda i: F.get(x, i)), "\n"))
    if counts:
        n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
        out = out.withColumns({"n_lines": n, "n_removed": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")})
    return out.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)).drop("__gone")
