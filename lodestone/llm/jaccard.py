"""N-gram Jaccard self-join of documents, with set-relation skipping.

A document's set holds the hashes of its distinct 5-word shingles. Documents
with equal sets form a class, and only classes are joined. Two classes link
when 100 * intersection >= 75 * union; what is wanted are the connected
components, so a pair within a component that is known needs no answer.

* Index lists: by the prefix filter two linked sets share k tokens among the
  first n - ceil(0.75 n) + k of each, in any one order of all tokens. A first
  pass in the order of hashes, with k about n / 16, finds the sets that share
  enough. Among these, every token is counted; a second pass with k = 1 takes
  the sets of which 75 % of the tokens are in two sets or more, and orders
  their tokens by these counts. A set that only shares a passage has nothing
  but tokens of its own in its prefix, and so is in no list.
* Index-level skipping: a list is cut into blocks of nearby positions (and
  sizes); two blocks whose positions leave too few tokens, or whose sizes are
  too far apart, are skipped as a whole.
* Answer-level skipping: each set is first held against the neighbour it met
  most often, out of the first entry of its lists and the NEIGHBOURS entries
  before it; then the nearest sets of different components are tried, by
  sketches. The one it shares most tokens with is its leader. The overlap of two leaders, together with how far
  each set is from its leader, bounds the overlap of the sets: most answers
  follow from the leaders' and only the undecided ones are computed.

Nothing is capped: every pair that passes the filters is decided.

Words: A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``. Defined results: a null,
empty or blank text has an empty set and is its own component; with fewer
than 5 words the whole sequence is the one shingle. Rows without id are left
alone (component null). Rows that share an id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, settle
from . import arrowtext as at
from .components import components
from .native import small

SHINGLE = 5
IDS = 1_000_000  # bound for broadcasting ids
NEIGHBOURS = 2  # entries of a list before its own that a set is held against
BUCKETS = 65_536  # of tokens, counted to find those of very many rows
HOT = 2_000  # rows of a bucket, beyond four times the mean, from which on it holds such a token
SALTS = 1_024  # groups that the rows of such a token are dealt to
PART = 4_096  # entries of a list that one group holds
TRIED = 2  # nearest pairs of each component that a list proposes at first
ROUNDS = 2  # of such proposals
BLOCK = 512  # entries of a block of an index list
SKETCH = 8  # words of 64 bits
SKETCH_ROWS = 500_000  # bound for broadcasting sketches


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the offsets."""
    raw, offsets = at.utf8(column)
    raw = at.LOWER[raw]
    starts, ends, first = at.spans(~at.SPACE[raw], offsets)
    words = at.span_hashes(raw, starts, ends)
    docs = len(offsets) - 1
    size = np.diff(first)
    owner = np.repeat(np.arange(docs), size)
    grams = at.ngram_hashes(words, SHINGLE)
    inside = owner[: len(grams)] == owner[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
    value, doc = [grams[inside]], [owner[: len(grams)][inside]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(size == n)
        if len(short):
            whole = np.zeros(len(short), dtype=np.uint64)
            for k in range(n):
                whole = whole * np.uint64(0x9E3779B97F4A7C15) + words[first[short] + k]
            value.append(at.mix(whole + np.uint64(n)))
            doc.append(short)
    value, doc = np.concatenate(value).view(np.int64), np.concatenate(doc)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    if len(value):
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])
        value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(docs + 1))


def _sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


def spare(n):
    """How many of n tokens a linked set may lack."""
    return n - (3 * n + 3) // 4


def extra(n):
    """Tokens by which the first prefix is longer than it has to be. Two
    linked sets then share as many, by the smaller count, in their prefixes."""
    return np.maximum(1, spare(n) // 4)


def sketches(documents: DataFrame, text: str, id_column: str) -> DataFrame:
    """id, n, the set's 128-bit digest d1, d2, its prefix by hash, and how many
    of that a linked set has at least."""
    rows = documents.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.chunks(batch, "text"):
                value, off = shingles(part.column("text"))
                n = np.diff(off)
                owner, pos = at.run_index(n)
                first = np.minimum(n, spare(n) + extra(n))
                need = extra((3 * n + 3) // 4)  # of the smallest set that can link
                keep = pos < first[owner]
                cut = np.concatenate([[0], np.cumsum(first)])
                u = value.view(np.uint64)
                d1, d2 = _sums(at.mix(u), off), _sums(at.mix(u ^ np.uint64(0xA5A5A5A55A5A5A5A)), off)
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(value[keep]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n.astype(np.int32)), pa.array(d1), pa.array(d2), pa.array(need.astype(np.int32)), lists], names=["id", "n", "d1", "d2", "need", "prefix"])

    return rows.mapInArrow(run, f"id {kind}, n int, d1 bigint, d2 bigint, need int, prefix array<bigint>")


def parities(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, SKETCH) words of bits; each token's hash flips one bit. Two
    sets differ in as many tokens at least as their sketches do in bits."""
    docs, bits = len(offsets) - 1, 64 * SKETCH
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    flips = np.bincount(owner * bits + (at.mix(value.view(np.uint64)) % np.uint64(bits)).astype(np.int64), minlength=docs * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(docs, bits), axis=1)


def whole_sets(documents: DataFrame, text: str, id_column: str) -> DataFrame:
    """id, a hash of the set, its tokens sorted by hash, and its sketch, of
    documents with words."""
    rows = documents.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.chunks(batch, "text"):
                value, off = shingles(part.column("text"))
                sketch = pa.array([r.tobytes() for r in parities(value, off)], pa.binary())
                own = pa.array(_sums(at.mix(value.view(np.uint64)), off))
                yield pa.RecordBatch.from_arrays([part.column("id"), own, pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(value)), sketch], names=["id", "own", "tokens", "sketch"])

    return rows.mapInArrow(run, f"id {kind}, own bigint, tokens array<bigint>, sketch binary").where(F.size("tokens") > 0)


def counted(flat: DataFrame) -> DataFrame:
    """The rows of ``flat`` whose token others have too, with their number.

    Tokens are counted in a window. Those of very many rows, which stand out
    among the counts of BUCKETS buckets, are counted apart, by sums on the
    map side; the window deals their rows out by id, so that no task gathers
    such a token.
    """
    bucket = F.pmod("token", F.lit(BUCKETS)).alias("bucket")
    rows = settle(flat.groupBy(bucket).agg(F.count("*").alias("rows")), "buckets")
    mean = (rows.agg(F.sum("rows")).first()[0] or 0) // BUCKETS
    many = [r[0] for r in rows.where(F.col("rows") > HOT + 4 * mean).select("bucket").collect()]  # under a quarter of BUCKETS
    salt = F.lit(0)
    if many:
        hot = flat.where(F.pmod("token", F.lit(BUCKETS)).isin(many)).groupBy("token").agg(F.count("*").alias("hot")).where(F.col("hot") > HOT // 2 + 2 * mean)  # half as many
        flat = flat.join(F.broadcast(settle(hot, "hot")), "token", "left")
        salt = F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    else:
        flat = flat.withColumn("hot", F.lit(None).cast("bigint"))
    flat = flat.withColumn("salt", salt.cast("int"))
    flat = flat.withColumn("sets", F.coalesce("hot", F.count("*").over(Window.partitionBy("token", "salt"))))
    return flat.where("sets > 1").drop("hot", "salt")


def rare_prefixes(sets: DataFrame) -> DataFrame:
    """token, sets, id, n, pos: the prefixes of ``sets`` in the order of
    rarity, less tokens of one set only. These come first in that order, so a
    set of which over a quarter of the tokens are its own has no entry."""
    flat = counted(sets.select("id", "own", F.size("tokens").alias("n"), F.explode("tokens").alias("token")))
    kept = flat.groupBy("id", "own", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("some"))
    k, least = F.size("some"), F.floor((3 * F.col("n") + 3) / 4).cast("int")
    kept = kept.where(k >= least).withColumn("alone", F.col("n") - k)
    kept = kept.select("id", "n", "alone", F.posexplode(F.slice("some", F.lit(1), k - least + 1)).alias("place", "e"))
    return kept.select("e.token", "e.sets", "id", "n", (F.col("alone") + F.col("place")).alias("pos"))


def neighbours(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists of two entries or more, and pairs x, y of each entry with those
    just before it and the first one of its list, with the times they met.

    A list is cut into parts of about PART entries; the first ones of the
    parts are held against each other in the same way.
    """
    entry = F.struct("n", "id", "pos")
    part = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("sets") / PART)))

    def lists(rows: DataFrame, keys: list) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("id", "n", "pos")
        head = F.first(entry).over(w.rowsBetween(Window.unboundedPreceding, 0))
        before = [F.lag(entry, k).over(w) for k in range(1, NEIGHBOURS + 1)]
        return rows.select("*", F.array(head, *before).alias("before"), F.lead("id").over(w).alias("next"))

    some = lists(postings.withColumn("part", part), ["token", "part"])
    first = F.get("before", F.lit(1)).isNull()
    some = settle(some.where(~first | F.col("next").isNotNull() | (F.col("sets") > PART)).drop("next"), "lists")
    heads = lists(some.where(first & (F.col("sets") > PART)).drop("before"), ["token"]).drop("next")
    met = some.unionByName(heads).select("id", "n", "pos", F.explode(F.array_distinct("before")).alias("e"))
    met = met.where((F.col("e.id") != F.col("id")) & fits(F.col("n"), F.col("pos"), F.col("e.n"), F.col("e.pos")))
    return some.select("token", "id", "n", "pos"), met.groupBy(F.col("id").alias("x"), F.col("e.id").alias("y")).agg(F.count("*").alias("times"))


def fits(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Length and positional filters; positions count from 0."""
    return (3 * F.greatest(n1, n2) <= 4 * F.least(n1, n2)) & (7 * F.least(n1 - p1, n2 - p2) >= 3 * (n1 + n2))


def linked(both: Column, n1: Column, n2: Column) -> Column:
    return 7 * both >= 3 * (n1 + n2)


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y, both, nx, ny: the exact overlap of each pair of sets."""
    pairs = settle(pairs.select("x", "y"), "pairs")
    some = lambda c: sets.join(small(pairs.select(F.col(c).alias("id")).distinct(), IDS), "id", "left_semi")
    a = some("x").select(F.col("id").alias("x"), F.col("tokens").alias("tx"))
    b = some("y").select(F.col("id").alias("y"), F.col("tokens").alias("ty"))
    joined = pairs.join(a, "x").join(b, "y")
    return joined.select("x", "y", F.size(F.array_intersect("tx", "ty")).alias("both"), F.size("tx").alias("nx"), F.size("ty").alias("ny"))


def block_pairs(n: np.ndarray, p: np.ndarray, group: np.ndarray, block: int = BLOCK, bits: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one list that pass the filters, of different groups.

    Entries come sorted by position. A block knows the range of its sizes
    and of what its positions leave; pairs of blocks that cannot hold a
    passing pair are skipped.
    """
    edges = range(0, len(n), block)
    lo = [n[i : i + block].min() for i in edges]
    hi = [n[i : i + block].max() for i in edges]
    rest = [(n - p)[i : i + block].max() for i in edges]
    same = [group[i] if (group[i : i + block] == group[i]).all() else None for i in edges]
    for a, i in enumerate(edges):
        for b in range(a, len(lo)):
            if 3 * max(lo[a], lo[b]) > 4 * min(hi[a], hi[b]) or 7 * min(rest[a], rest[b]) < 3 * (lo[a] + lo[b]):
                continue
            if same[a] is not None and same[a] == same[b]:
                continue
            j = b * block
            n1, p1, g1 = (v[i : i + block, None] for v in (n, p, group))
            n2, p2, g2 = (v[None, j : j + block] for v in (n, p, group))
            ok = (3 * np.maximum(n1, n2) <= 4 * np.minimum(n1, n2)) & (7 * np.minimum(n1 - p1, n2 - p2) >= 3 * (n1 + n2)) & (g1 != g2)
            if a == b:
                ok &= np.arange(len(n1))[:, None] < np.arange(n2.shape[1])[None, :]
            x, y = np.nonzero(ok)
            x, y = x + i, y + j
            if bits is not None and len(x):
                near = 7 * np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= n[x] + n[y]
                x, y = x[near], y[near]
            if len(x):
                yield x, y


def nearest(x: np.ndarray, y: np.ndarray, apart: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are among the k least ``apart`` of either one's group."""
    keep = np.zeros(len(x), bool)
    for side in (x, y):
        order = np.lexsort((apart, group[side]))
        g = group[side][order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        place = np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
        keep[order[place < k]] = True
    return keep


def across(lists: DataFrame, tried: int = 0) -> DataFrame:
    """x, y: pairs of a list that pass the filters and lie in different
    components. ``lists``: token, entries, id, n, pos, component, sketch.
    With ``tried``, only so many of each component, by the nearest sketches.

    A list of over PART entries is cut into parts, and a group holds two of
    them; so no group is larger than 2 * PART entries or so.
    """
    kind = dict(lists.dtypes)["id"]
    parts = F.greatest(F.lit(1), F.ceil(F.col("entries") / PART)).cast("int")
    dealt = lists.withColumns({"component": F.xxhash64("component"), "part": F.pmod(F.xxhash64("id"), parts).cast("int")})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumn("cell", F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other")))
    dealt = dealt.select("cell", "id", "n", "pos", "component", "sketch").repartition("cell").sortWithinPartitions("cell", "pos", "n", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cell, ids = t["cell"].to_numpy(), t["id"].combine_chunks()
            n, p, g = (t[c].to_numpy().astype(np.int64) for c in ("n", "pos", "component"))
            raw = b"".join(t["sketch"].to_pylist())
            bits = np.frombuffer(raw, dtype=np.uint64).reshape(len(n), SKETCH)
            cut = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            many = np.diff(cut) > 1
            xs, ys, size = [], [], 0
            for a, b in zip(cut[:-1][many], cut[1:][many]):
                found = block_pairs(n[a:b], p[a:b], g[a:b], BLOCK, bits[a:b])
                if tried:
                    found = some(found, n[a:b], g[a:b], bits[a:b])
                for x, y in found:
                    xs.append(x + a)
                    ys.append(y + a)
                    size += len(x)
                    if size > 500_000:
                        yield out(ids, xs, ys)
                        xs, ys, size = [], [], 0
            if xs:
                yield out(ids, xs, ys)

        def some(found, n, g, bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for x, y in found:
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) / (n[x] + n[y])
                kept = tuple(np.concatenate(v) for v in zip(kept, (x, y, apart)))
                kept = tuple(v[nearest(*kept, g, tried)] for v in kept)
            yield kept[:2]

        def out(ids, xs, ys) -> pa.RecordBatch:
            pair = at.distinct(np.concatenate(xs) * len(ids) + np.concatenate(ys))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(pair // len(ids))), ids.take(pa.array(pair % len(ids)))], names=["x", "y"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            cell = held["cell"].to_numpy()
            whole = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last list may go on
            if whole:
                yield from pairs(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and len(held):
            yield from pairs(held)

    pairs = dealt.mapInArrow(run, f"x {kind}, y {kind}").where("x <> y")
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def mixed(lists: DataFrame, component: DataFrame, sets: DataFrame) -> DataFrame:
    """Lists with sets of different components, whose answers are not known
    yet. Ids that rows share have several sketches; all of them take part."""
    marked = settle(lists.join(component, "id"), "marked")
    some = marked.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("entries")).where("c1 <> c2").select("token", "entries")
    sketch = sets.select("id", F.size("tokens").alias("n"), "sketch")
    return marked.join(some, "token").join(small(sketch, SKETCH_ROWS), ["id", "n"])


def derived(pairs: DataFrame, leaders: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of ``pairs``, by way of the leaders' overlaps.

    leaders: id, leader, n, off (tokens of the set that the leader lacks),
    lack (tokens of the leader that the set lacks); a set without a leader is
    its own.
    """
    side = lambda k: leaders.select(*[F.col(c).alias(c + k) for c in ("id", "leader", "n", "off", "lack")])
    p = pairs.join(side("1"), F.col("x") == F.col("id1")).join(side("2"), F.col("y") == F.col("id2"))
    p = settle(p.drop("id1", "id2").withColumns({"lx": F.least("leader1", "leader2"), "ly": F.greatest("leader1", "leader2")}), "undecided")
    tops = overlaps(p.where("lx <> ly").select(F.col("lx").alias("x"), F.col("ly").alias("y")).distinct(), sets)
    p = p.join(tops.select(F.col("x").alias("lx"), F.col("y").alias("ly"), "both"), ["lx", "ly"], "left")
    most, least = F.col("both") + F.col("off1") + F.col("off2"), F.col("both") - F.col("lack1") - F.col("lack2")
    p = p.where(F.col("both").isNull() | linked(most, F.col("n1"), F.col("n2")))
    p = settle(p.select("x", "y", F.coalesce(linked(least, F.col("n1"), F.col("n2")), F.lit(False)).alias("sure")), "bounded")
    exact = overlaps(p.where("not sure"), sets).where(linked(F.col("both"), F.col("nx"), F.col("ny")))
    return p.where("sure").select("x", "y").unionByName(exact.select("x", "y"))


def merged(first: DataFrame, links: DataFrame) -> DataFrame:
    """id, component: those of ``first``, joined by links x, y. One link
    between two is enough, so these are contracted to nodes."""
    side = lambda k: first.select(F.col("id").alias(k), F.col("component").alias(f"c{k}"))
    pairs = links.join(side("x"), "x").join(side("y"), "y").select(F.col("cx").alias("a"), F.col("cy").alias("b")).where("a <> b").distinct()
    tops = components(settle(pairs, "links")).select(F.col("id").alias("component"), F.col("component").alias("top"))
    return settle(first.join(tops, "component", "left").select("id", F.coalesce("top", "component").alias("component")), "components")


def near_duplicates(documents: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, n_shingles, component_id: a row for each row of ``documents``."""
    sketched = settle(sketches(documents, text, id_column), "sketches")
    rows = settle(sketched.drop("prefix", "need"), "digests")
    some = rows.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = settle(some.groupBy("d1", "d2", "n").agg(F.min("id").alias("first")), "classes")
    firsts = sketched.where((F.col("n") > 0) & F.col("id").isNotNull()).join(classes, ["d1", "d2", "n"]).where("id = first").dropDuplicates(["id", "d1", "d2", "n"])
    shared = settle(counted(firsts.select("id", "need", F.explode("prefix").alias("token"))).select("id", "need"), "shared")
    discard(sketched)
    wanted = settle(shared.groupBy("id").agg(F.count("*").alias("k"), F.min("need").alias("need")).where("k >= need").select("id"), "wanted")
    docs = documents.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(small(wanted, IDS), "id", "left_semi")
    discard(shared)
    sets = settle(whole_sets(docs, "text", "id"), "sets")
    if sets.groupBy("id", "own").count().where("count > 1").limit(1).count():  # rows repeated
        sets = settle(sets.dropDuplicates(["id", "own"]), "sets")
    lists, met = neighbours(rare_prefixes(sets))
    # Each set's overlap with the neighbour it met most often, then of the
    # nearest sets of different components; the nearest one leads.
    met = met.groupBy("x").agg(F.max_by("y", F.struct("times", "y")).alias("y"))
    near = settle(overlaps(met, sets), "near")
    is_linked = linked(F.col("both"), F.col("nx"), F.col("ny"))
    first = merged(sets.select("id", F.col("id").alias("component")).distinct(), near.where(is_linked))
    known = near
    for _ in range(ROUNDS):
        far = settle(overlaps(across(mixed(lists, first, sets), TRIED), sets), "far")
        first, known = merged(first, far.where(is_linked)), known.unionByName(far)
    open_pairs = settle(across(mixed(lists, first, sets)), "across")
    # One row for each id: where rows share an id, no bound holds for both,
    # so these are their own leaders.
    best = known.groupBy("x").agg(F.max(F.struct(F.col("both") / (F.col("nx") + F.col("ny")), "both", "y", "nx", "ny")).alias("b")).select("x", "b.*")
    leads = best.select(F.col("x").alias("id"), F.col("y").alias("leader"), F.col("nx").alias("n"), (F.col("nx") - F.col("both")).alias("off"), (F.col("ny") - F.col("both")).alias("lack"))
    per_id = sets.groupBy("id").agg(F.count("*").alias("sets"), F.max(F.size("tokens")).alias("size"))
    single = per_id.where("sets = 1").select(F.col("id").alias("one"))
    good = leads.join(single, F.col("id") == F.col("one"), "left_semi").join(single, F.col("leader") == F.col("one"), "left_semi")
    own = per_id.join(good, "id", "left_anti").select("id", F.col("id").alias("leader"), F.col("size").alias("n"), F.lit(0).alias("off"), F.lit(0).alias("lack"))
    more = derived(open_pairs, good.unionByName(own), sets)
    found = merged(first, more)
    named = classes.join(found, F.col("first") == F.col("id"), "left").select("d1", "d2", "n", F.coalesce("component", "first").alias("component_id"))
    empty = (F.col("n") == 0) | F.col("id").isNull()
    out = rows.where(~empty).select("id", "n", "d1", "d2").join(named, ["d1", "d2", "n"]).select("id", "n", "component_id")
    out = out.unionByName(rows.where(empty).select("id", "n", F.col("id").alias("component_id")))
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_representatives(documents: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``documents`` less those linked to one with a smaller id."""
    found = near_duplicates(documents, text, id_column).where("component_id <> id").select(F.col("id").alias("__id")).distinct()
    return documents.join(settle(found, "copies"), F.col(id_column) == F.col("__id"), "left_anti")
