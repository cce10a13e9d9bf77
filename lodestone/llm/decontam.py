"""Benchmark decontamination by a distributed positional inverted index.

The index stores one posting (term, document, position) for each document
word that also occurs in a test item. A test window's terms are looked up
from the rarest on: their lists, moved by the term's offset in the window,
meet in the start positions of the phrase. The starts on which the rarest
lists agree are then intersected with the lists of all other terms, which
leaves the exact occurrences. ``proximity`` relaxes the meeting to a slop.

DataFrame operations only. Lists are never gathered: each intersection is an
equi-join or a counted group on (document, window, start), so a hot term or
passage spreads over all partitions. What comes from the test items alone is
broadcast after its size was checked, and joined by shuffle beyond the bound.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is
10 consecutive words of an item, or all words of a shorter one. Defined
results: a null or empty text has no words and is clean; items without id or
words are ignored; rows equal in id and text count once. Only id and text
columns are read, so extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .native import join_on, lower_ascii, pieces, small

WINDOW = 10
#: Bounds, in rows, for broadcasting what comes from the test items.
TERM_ROWS, DOC_ROWS = 500_000, 1_000_000
#: The rarest terms whose lists are met first: at most so many of a window,
#: and the later ones only while not so much more frequent than the rarest.
RAREST, MORE_FREQUENT, FREE = 3, 50, 1000

# Separators of words; A-Z are letters here and lower-cased afterwards.
_SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_END = " "  # cannot be a word; its position is the number of words
DOC = ["doc_id", "text_hash"]
ITEM_WINDOW = ["item_id", "item_hash", "w_start"]  # an item_id may have several texts


@dataclass
class PositionalIndex:
    postings: DataFrame  # term_id, doc_id, text_hash, pos; without the ends
    documents: DataFrame  # doc_id, text_hash, n_words
    windows: DataFrame  # item_id, item_hash, w_start, w_len, terms: array<term_id>
    anchors: DataFrame  # term_id, item_id, item_hash, w_start, off, rank, n_anchors


def _items(benchmark: DataFrame, id_column: str, text: str) -> DataFrame:
    words = F.transform(pieces(F.col(text), _SEPARATORS), lower_ascii)
    rows = benchmark.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("string").alias("item_id"), words.alias("words"))
    return rows.where(F.size("words") > 0).distinct()


def build_index(documents: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW) -> PositionalIndex:
    items = settle(_items(benchmark, item_column, item_text), "items")
    terms = items.select(F.explode("words").alias("term")).distinct()
    vocabulary = settle(terms.select("term", F.xxhash64("term").alias("term_id")), "vocabulary")
    # The id is a hash of 64 bits; two terms of the test items that share one
    # would make phrases look alike, so this is ruled out here.
    if vocabulary.count() != vocabulary.select("term_id").distinct().count():
        raise ValueError("two terms of the test items have the same hash")
    look_up = vocabulary.unionByName(documents.sparkSession.range(1).select(F.lit(_END).alias("term"), F.lit(-1).cast("bigint").alias("term_id")))
    words = F.concat(pieces(F.col(text), _SEPARATORS), F.array(F.lit(_END)))
    exploded = documents.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(words).alias("pos", "word"))
    exploded = exploded.select("doc_id", "text_hash", "pos", lower_ascii(F.col("word")).alias("term"))
    hits = exploded.join(small(look_up, TERM_ROWS), "term").select("term_id", *DOC, "pos", (F.col("term") == _END).alias("is_end"))
    stored = settle(hits, "postings")
    postings = stored.where(~F.col("is_end")).drop("is_end")
    docs = stored.where("is_end").groupBy(*DOC).agg(F.max("pos").cast("long").alias("n_words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    windows = items.select("item_id", F.xxhash64("words").alias("item_hash"), "words", F.explode(starts).alias("w_start"))
    cut = F.slice("words", F.col("w_start") + 1, F.lit(window))
    windows = windows.select(*ITEM_WINDOW, F.size(cut).alias("w_len"), F.transform(cut, lambda w: F.xxhash64(w)).alias("terms"))
    freq = postings.groupBy("term_id").agg(F.count("*").alias("freq"))
    flat = windows.select(*ITEM_WINDOW, "w_len", F.posexplode("terms").alias("off", "term_id")).join(freq, "term_id", "left")
    by_rarity = Window.partitionBy(*ITEM_WINDOW).orderBy("freq", "off")
    whole = Window.partitionBy(*ITEM_WINDOW)
    flat = flat.withColumns({"rank": F.row_number().over(by_rarity), "least": F.min("freq").over(whole), "known": F.count("freq").over(whole)})
    # A window with a term that no document holds occurs nowhere.
    flat = flat.where((F.col("known") == F.col("w_len")) & (F.col("rank") <= RAREST))
    flat = flat.where((F.col("rank") == 1) | (F.col("freq") <= MORE_FREQUENT * F.col("least") + FREE))
    anchors = flat.select("term_id", *ITEM_WINDOW, "off", "rank", F.count("*").over(whole).alias("n_anchors"))
    return PositionalIndex(postings, docs, settle(windows, "windows"), settle(anchors, "anchors"))


def meetings(index: PositionalIndex) -> DataFrame:
    """Starts at which any of a window's rarest terms would put it."""
    at_ = index.postings.join(small(index.anchors, TERM_ROWS), "term_id")
    return at_.select(*DOC, *ITEM_WINDOW, (F.col("pos") - F.col("off")).alias("start"), "rank", "n_anchors")


def phrases(index: PositionalIndex) -> DataFrame:
    """Exact occurrences: doc_id, text_hash, item_id, item_hash, w_start,
    start, w_len."""
    key = [*DOC, *ITEM_WINDOW, "start"]
    met = meetings(index).where("start >= 0")
    # Postings of rows that occur twice appear twice; ranks are counted once.
    flags = [F.max(F.when(F.col("rank") == r, 1).otherwise(0)) for r in range(1, RAREST + 1)]
    met = met.groupBy(*key, "n_anchors").agg(sum(flags[1:], flags[0]).alias("n")).where("n = n_anchors").drop("n", "n_anchors")
    met = settle(met, "candidates")
    full = met.join(small(index.windows, TERM_ROWS), ITEM_WINDOW)
    full = full.select(*key, "w_len", F.posexplode("terms").alias("off", "term_id")).withColumn("pos", F.col("start") + F.col("off"))
    there = join_on(index.postings, small(met.select(*DOC).distinct(), DOC_ROWS), DOC, "left_semi")
    found = join_on(full, there, [*DOC, "pos", "term_id"], "left_semi")
    return found.groupBy(*key, "w_len").agg(F.count("*").alias("n")).where("n = w_len").drop("n")


def proximity(index: PositionalIndex, slop: int = 4) -> DataFrame:
    """Windows whose rarest terms (two or more) all meet within ``slop``
    words of where the rarest one puts the window, with the least total
    deviation of such a start: 0 for starts where they meet exactly."""
    met = meetings(index).where("n_anchors > 1").distinct()
    cell = F.floor(F.col("start") / F.lit(slop + 1))
    key = [*DOC, *ITEM_WINDOW]
    first = met.where("rank = 1").select(*key, F.col("start").alias("s1"), "n_anchors", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    rest = met.where("rank > 1").select(*key, "start", "rank", cell.alias("cell"))
    near = join_on(first, rest, [*key, "cell"]).withColumn("off_by", F.abs(F.col("start") - F.col("s1"))).where(F.col("off_by") <= slop)
    near = near.groupBy(*key, "s1", "n_anchors", "rank").agg(F.min("off_by").alias("off_by"))
    near = near.groupBy(*key, "s1", "n_anchors").agg(F.count("*").alias("n"), F.sum("off_by").alias("off_by")).where("n = n_anchors - 1")
    return near.groupBy(*key).agg(F.min("off_by").alias("off_by"))


def report(index: PositionalIndex, found: DataFrame) -> DataFrame:
    """One row per document: words hit, items found, their digest."""
    spans = found.select(*DOC, "start", (F.col("start") + F.col("w_len")).alias("stop")).distinct()
    w = Window.partitionBy(*DOC).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(w), F.lit(0))))
    hit = spans.withColumn("new", new).groupBy(*DOC).agg(F.sum("new").cast("long").alias("n_hit"))
    items = found.select(*DOC, "item_id").distinct().groupBy(*DOC).agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    out = join_on(join_on(index.documents, hit, DOC, "left"), items, DOC, "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def contamination(documents: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    index = build_index(documents, benchmark, **columns)
    return report(index, phrases(index))


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id", max_hit: float = 0.0) -> DataFrame:
    """``documents`` without those whose words are hit in a larger share than
    ``max_hit``."""
    found = contamination(documents, benchmark, text=text, id_column=id_column)
    bad = found.where(F.col("n_hit") > max_hit * F.col("n_words")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    a, b = documents.alias("a"), small(settle(bad, "contaminated"), DOC_ROWS).alias("b")
    return a.join(b, F.col(f"a.`{id_column}`").eqNullSafe(F.col("b.__id")) & (F.xxhash64(F.col(f"a.`{text}`")) == F.col("b.__hash")), "left_anti")
