"""Quality rules from repetition inside a text, by suffix arrays.

The words of a chunk of documents form one sequence in which words of
different documents differ. Its suffix array is built by prefix doubling,
the longest common prefixes of neighbours come from the ranks of each
doubling. A word's longest repeat is the longer of its suffix's two common
prefixes; the left-maximal ones are the maximal repeated substrings. Their
spans are united, and a document passes if the covered fraction of its words
and its longest repeat stay within limits.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results: a null or empty text has
zero counts and fails the base rules. Whole texts are processed: a chunk
holds whole documents, however long. Repeated rows give repeated results;
extra columns pass through, except those with the names of results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at

# The base rule fails texts with half their words in repeats of three or more,
# so all of these have to act below it: two copies of a passage of 0.19 cover
# 0.38 of a text.
MIN_REPEAT = 5  # words; shorter repeats are ordinary language
MAX_COVERED = 0.38  # fraction of a text's words in such repeats
MAX_LONGEST = 0.19  # longest repeat, as a fraction of the text's words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_covered", "longest_repeat"]

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def suffix_ranks(first: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... items.

    ``first`` holds ranks of the single items. Equal ranks mean equal
    prefixes; in the last array all ranks differ. A prefix that runs over the
    end equals no other.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    s = first[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    levels, step = [rank], 1
    single = new & np.concatenate([new[1:], [True]]) if n else new
    live = order[~single]
    while len(live):
        at_ = live + step
        key = rank[live] * (n + 1) + np.where(at_ < n, rank[np.minimum(at_, n - 1)] + 1, 0)
        o = np.argsort(key, kind="stable")
        live, key = live[o], key[o]
        old = rank[live]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], old[1:] != old[:-1]])
        i = np.arange(len(live))
        base = np.maximum.accumulate(np.where(group, i, 0))
        start = np.maximum.accumulate(np.where(new, i, 0))
        rank = rank.copy()
        rank[live] = old + start - base
        levels.append(rank)
        live = live[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    return levels


def longest_repeats(first: np.ndarray) -> np.ndarray:
    """For each item, the length of the longest sequence from it on that also
    starts elsewhere."""
    n = len(first)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    levels = suffix_ranks(first)
    sa = np.argsort(levels[-1])
    # Only neighbours that share their first item have a common prefix.
    near = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    a, b = sa[near], sa[near + 1]
    i, j, size = a.copy(), b.copy(), np.zeros(len(near), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = np.maximum(i, j) < n
        same = ok & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        size += same << k
        i += same << k
        j += same << k
    best = np.zeros(n, dtype=np.int64)
    np.maximum.at(best, a, size)
    np.maximum.at(best, b, size)
    return best


def covered(start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Which of n items lie in the union of the spans."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, start + size, -1)
    return np.cumsum(d[:-1]) > 0


def measure(column: pa.Array, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """COUNTS and EXTRA of each text."""
    raw, offsets = at.utf8(column)
    docs = len(offsets) - 1
    word = ~at.SPACE[raw]
    starts, ends, first = at.spans(word, offsets)
    per = np.diff(first)
    owner = np.repeat(np.arange(docs), per)
    total = lambda x: np.bincount(owner, weights=x, minlength=docs).astype(np.int64)
    prefix = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    chars = prefix((raw & 0xC0) != 0x80)
    table = np.zeros(256, dtype=bool)
    table[list(SYMBOLS)] = True
    symbols = prefix(table[raw])
    hashes = at.span_hashes(raw, starts, ends)
    keyed = at.mix(hashes + owner.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    repeats = longest_repeats(np.unique(keyed, return_inverse=True)[1].astype(np.int64))
    three = np.flatnonzero(repeats >= 3)
    triple = covered(three, np.full(len(three), 3), len(repeats))
    # Left-maximal: not the tail of the repeat that starts one word earlier.
    before = np.concatenate([[0], repeats[:-1]]) if len(repeats) else repeats
    longer = np.flatnonzero((repeats >= min_repeat) & (before != repeats + 1))
    union = covered(longer, repeats[longer], len(repeats))
    longest = np.zeros(docs, dtype=np.int64)
    np.maximum.at(longest, owner, repeats)
    # Lines that hold a word, less the distinct ones.
    ls, le, lf = at.spans(raw != 10, offsets)
    words_before = prefix(word)
    full = words_before[le] > words_before[ls]
    line_doc = np.repeat(np.arange(docs), np.diff(lf))[full]
    line = at.mix(at.span_hashes(raw, ls, le)[full] + line_doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    _, one = np.unique(line, return_index=True)
    dup = np.bincount(line_doc, minlength=docs) - np.bincount(line_doc[one], minlength=docs)
    return {
        "n_words": per,
        "word_chars": total(chars[ends] - chars[starts]),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": dup,
        "n_repeat_words": total(triple),
        "n_covered": total(union),
        "longest_repeat": np.where(longest >= min_repeat, longest, 0),
    }


def rate(documents: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """``documents`` with the counts, ``base_failed`` and ``kept`` added."""
    names = [*COUNTS, *EXTRA]
    docs = documents.select(*[c for c in documents.columns if c not in (*names, "base_failed", "kept")])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.chunks(batch, text, 1_500_000):
                m = measure(part.column(text), min_repeat)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(m[c].astype(np.int64)) for c in names)], names=[*part.schema.names, *names])

    n = F.col("n_words")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    verdict = (F.col("n_covered") <= max_covered * n) & (F.col("longest_repeat") <= max_longest * n)
    return docs.mapInArrow(run, schema).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict)
