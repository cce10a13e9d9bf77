"""Quality classifier: a generalised additive model with pairwise terms.

Each feature of a text is cut into bins. Cyclic boosting with shallow trees
learns one lookup table per feature, and then one per chosen pair of
features. A score is the logistic function of the summed table entries.

Defined results: null and empty texts have all features 0 and are scored as
such; without both classes to learn from every score is the share of label 1
(1.0 if there is no labelled row). Rows are never merged; extra columns pass
through, except those with the names of results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at

TRAIN_ROWS = 20_000  # bound on labelled rows to learn from
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1
THRESHOLD = 0.3

FEATURES = [
    "log_words", "word_bytes", "upper", "digits", "symbols", "bangs", "stops", "distinct",
    "same_as_last", "repeated_triples", "log_line_words", "dup_lines", "bars", "symbol_ends",
    "no_letter", "log_longest", "non_ascii", "shouted",
]


def _set(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_UPPER = _set(bytes(range(65, 91)))
_LETTER = _set(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_ASCII_LETTER = _set(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT = _set(b"0123456789")
_SYMBOL = _set(b"#*$%&|<>")
_STOP = _set(b".,;:")


def measure(column: pa.Array) -> np.ndarray:
    """The features (texts, FEATURES) of each text."""
    raw, offsets = at.utf8(column)
    docs = len(offsets) - 1
    starts, ends, first = at.spans(~at.SPACE[raw], offsets)
    words = np.diff(first)
    owner = np.repeat(np.arange(docs), words)
    prefix = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    in_doc = lambda p: (p[offsets[1:]] - p[offsets[:-1]]).astype(float)
    total = lambda x: np.bincount(owner, weights=x, minlength=docs)
    upper, letter, ascii_letter = prefix(_UPPER[raw]), prefix(_LETTER[raw]), prefix(_ASCII_LETTER[raw])
    n, size = np.maximum(words, 1), ends - starts
    h = at.mix(at.span_hashes(raw, starts, ends) + owner.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    _, one = np.unique(h, return_index=True)
    same = np.zeros(len(h))
    same[1:] = h[1:] == h[:-1]
    triples = at.ngram_hashes(h, 3)
    inner = owner[: len(triples)] == owner[2:] if len(triples) else np.zeros(0, bool)
    t_owner = owner[: len(triples)][inner]
    _, t_one = np.unique(triples[inner], return_index=True)
    n_triples = np.bincount(t_owner, minlength=docs)
    n_distinct = np.bincount(t_owner[t_one], minlength=docs)
    ls, le, lf = at.spans(raw != 10, offsets)
    lines = np.diff(lf)
    l_owner = np.repeat(np.arange(docs), lines)
    lh = at.mix(at.span_hashes(raw, ls, le) + l_owner.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    _, l_one = np.unique(lh, return_index=True)
    w_letters, w_upper = letter[ends] - letter[starts], upper[ends] - upper[starts]
    longest = np.zeros(docs)
    np.maximum.at(longest, owner, size)
    length = np.maximum(np.diff(offsets), 1)
    last = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    cols = [
        np.log1p(words), total(size) / n, in_doc(upper) / np.maximum(in_doc(ascii_letter), 1), in_doc(prefix(_DIGIT[raw])) / length,
        in_doc(prefix(_SYMBOL[raw])) / n, in_doc(prefix(raw == 33)) / n, in_doc(prefix(_STOP[raw])) / n, np.bincount(owner[one], minlength=docs) / n,
        total(same) / n, 1 - n_distinct / np.maximum(n_triples, 1) * (n_triples > 0) - (n_triples == 0), np.log1p(words / np.maximum(lines, 1)), 1 - np.bincount(l_owner[l_one], minlength=docs) / np.maximum(lines, 1) * (lines > 0) - (lines == 0),
        total((size == 1) & (last == 124)) / n, total(_SYMBOL[last]) / n, total(w_letters == 0) / n, np.log1p(longest),
        in_doc(prefix(raw >= 128)) / length, total((w_upper == size) & (size > 1)) / n,
    ]
    return np.stack(cols, axis=1)


def _split(g: np.ndarray, h: np.ndarray, least: float = 2.0) -> tuple[int, float]:
    """The best cut of a histogram: bins up to it go left; its gain."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain = np.where((hl < least) | (hr < least), -1.0, gain)
    k = int(np.argmax(gain)) if len(gain) else 0
    return k, float(gain[k]) if len(gain) else -1.0


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values for each bin of a regression tree with ``depth`` levels."""
    out = np.full(len(g), -g.sum() / (h.sum() + 1))
    if depth and len(g) > 1:
        k, gain = _split(g, h)
        if gain > 0:
            out[: k + 1] = shallow_tree(g[: k + 1], h[: k + 1], depth - 1)
            out[k + 1 :] = shallow_tree(g[k + 1 :], h[k + 1 :], depth - 1)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree on two features: one cut of rows, then one of columns on
    either side, or the other way round, whichever gains more."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        k, gain = _split(gg.sum(axis=1), hh.sum(axis=1))
        if gain < 0:
            continue
        leaf = np.empty_like(gg)
        for part in (slice(0, k + 1), slice(k + 1, None)):
            col_g, col_h = gg[part].sum(axis=0), hh[part].sum(axis=0)
            gain += max(0.0, _split(col_g, col_h)[1])
            leaf[part] = shallow_tree(col_g, col_h, 1)
        if gain > best:
            best, out = gain, leaf.T if turned else leaf
    return out


class AdditiveModel:
    """Lookup tables of features and pairs, and how to cut into bins."""

    def __init__(self, base: float):
        self.base, self.cuts, self.tables, self.pairs = base, [], [], []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.tables:
            b = self.bins(x)
            for i, t in enumerate(self.tables):
                out += t[b[:, i]]
            for i, j, ci, cj, t in self.pairs:
                out += t[ci[b[:, i]], cj[b[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x).clip(-30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    y = np.asarray(y, dtype=float)
    p = (y.sum() + 1e-3) / (len(y) + 1e-3) if len(y) else 1 - 1e-9
    model = AdditiveModel(float(np.log(p / max(1 - p, 1e-9))))
    if not len(y) or y.min() == y.max():
        return model
    model.base = float(np.log(p / (1 - p)))
    for i in range(x.shape[1]):
        model.cuts.append(np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])))
    b = model.bins(x)
    size = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(s) for s in size]
    margin = np.full(len(y), model.base)
    grad = lambda: ((q := 1 / (1 + np.exp(-margin.clip(-30, 30)))) - y, np.maximum(q * (1 - q), 1e-6))
    for _ in range(ROUNDS):
        for i in range(x.shape[1]):
            g, h = grad()
            t = RATE * shallow_tree(np.bincount(b[:, i], g, size[i]), np.bincount(b[:, i], h, size[i]))
            model.tables[i] += t
            margin += t[b[:, i]]
    # Pairs by what one tree gains on what the single features leave over.
    g, h = grad()
    coarse = [np.minimum(np.arange(s) * PAIR_BINS // s, PAIR_BINS - 1) for s in size]
    cb = np.stack([coarse[i][b[:, i]] for i in range(x.shape[1])], axis=1)
    cells = PAIR_BINS * PAIR_BINS
    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            at_ = cb[:, i] * PAIR_BINS + cb[:, j]
            gs, hs = np.bincount(at_, g, cells).reshape(PAIR_BINS, -1), np.bincount(at_, h, cells).reshape(PAIR_BINS, -1)
            leaf = pair_tree(gs, hs)
            gains.append((float(-(gs * leaf).sum()), i, j))
    chosen = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in chosen]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(chosen, tables):
            g, h = grad()
            at_ = cb[:, i] * PAIR_BINS + cb[:, j]
            leaf = RATE * pair_tree(np.bincount(at_, g, cells).reshape(PAIR_BINS, -1), np.bincount(at_, h, cells).reshape(PAIR_BINS, -1))
            t += leaf
            margin += leaf.ravel()[at_]
    model.pairs = [(i, j, coarse[i], coarse[j], t) for (i, j), t in zip(chosen, tables)]
    return model


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_features(documents: DataFrame, text: str, name: str = "features") -> DataFrame:
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.chunks(batch, text):
                x = measure(part.column(text))
                col = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, col], names=[*part.schema.names, name])

    return documents.mapInArrow(run, schema)


def train(documents: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Learn from at most ``rows`` labelled rows, those with the smallest
    hash of their id. Only their features reach the driver."""
    known = labels.where(F.col(label).isNotNull()).groupBy(id_column).agg((F.max(label) > 0).cast("int").alias("y"))
    ids = known.orderBy(F.xxhash64(F.col(id_column).cast("string"), F.lit(3)), id_column).limit(rows)
    picked = documents.select(id_column, text).join(F.broadcast(ids), id_column).select("y", text)
    got = with_features(picked, text).select("y", "features").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(got["features"].to_numpy()), got["y"].to_numpy()
    order = np.lexsort([*x.T, y])  # rows arrive in any order
    return fit(x[order], y[order])


def predict(documents: DataFrame, model: AdditiveModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with ``score`` and ``predicted`` added."""
    docs = documents.select(*[c for c in documents.columns if c not in ("score", "predicted")])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.chunks(batch, text):
                s = model.score(measure(part.column(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_quality(documents: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Train on labelled rows that are not held out, then score every row."""
    model = train(documents.where(~held_out(id_column)), labels.where(~held_out(id_column)), text, id_column)
    return predict(documents.withColumn("held_out", held_out(id_column)), model, text)
