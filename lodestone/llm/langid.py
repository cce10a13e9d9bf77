"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in segments, labels every byte
position with a distribution over the learned languages, and a document's
probabilities are the mean of its positions' probabilities. It is trained in
numpy by backpropagation through time.

Defined results: a null text, a text without a letter, and any text when
nothing could be learned give ``und`` with score 0. Ties go to the language
that sorts first. Rows are never merged: repeated rows give repeated results.
Extra columns pass through; a column with the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from . import arrowtext as at
from . import gru
from .native import small

SEGMENT = 64  # bytes read in one run of the network
HIDDEN = 8  # units of each direction
TRAIN_DOCS = 200  # bound on training documents of one language
TRAIN_SEGMENTS = 12  # segments drawn from each of them
DRAWN_ROWS = 500_000  # bound for broadcasting the ids drawn


class ByteTagger:
    """The network: byte table -> two GRU directions -> softmax per position."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        k, h = len(langs), HIDDEN
        self.langs = langs
        self._run = None
        self.p = {
            "ef": (rng.standard_normal((256, 3 * h)) * 0.3).astype(gru.F),
            "eb": (rng.standard_normal((256, 3 * h)) * 0.3).astype(gru.F),
            "uf": gru.init(rng, h),
            "ub": gru.init(rng, h),
            "v": (rng.standard_normal((2 * h, k)) * 0.2).astype(gru.F),
            "c": np.zeros(k, dtype=gru.F),
        }

    def sums(self, codes: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Probabilities (languages, B), summed over the positions (T, B)."""
        if self._run is None:
            self._run = gru.Runner(self.p["ef"], self.p["uf"]), gru.Runner(self.p["eb"], self.p["ub"])
        p, h, (t, b) = self.p, HIDDEN, codes.shape
        f = self._run[0](codes, mask).reshape(-1, h)
        r = self._run[1](codes, mask, backwards=True).reshape(-1, h)
        logits = p["v"][:h].T @ f.T
        logits += p["v"][h:].T @ r.T
        logits += p["c"][:, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        if mask is not None:
            logits *= mask.reshape(-1)
        return logits.reshape(-1, t, b).sum(axis=1)

    def fit(self, codes: np.ndarray, mask: np.ndarray, labels: np.ndarray, epochs: int, batch: int = 128, seed: int = 7):
        """codes, mask: (segments, SEGMENT); labels: one for each segment."""
        rng = np.random.default_rng(seed)
        p, h = self.p, HIDDEN
        opt = gru.Adam(p, rate=1e-2)
        weight = gru.F(1) / np.bincount(labels, minlength=len(self.langs)).clip(1)
        for epoch in range(epochs):
            opt.rate = 1e-2 / (1 + epoch)
            order = rng.permutation(len(codes))
            for i in range(0, len(order), batch):
                j = order[i : i + batch]
                x, m, y = codes[j].T, mask[j].T, labels[j]
                f, tf = gru.forward(p["ef"][x], p["uf"], m, keep=True)
                b, tb = gru.forward(p["eb"][x[::-1]], p["ub"], m[::-1], keep=True)
                b = b[::-1]
                logits = f @ p["v"][:h] + b @ p["v"][h:] + p["c"]
                logits -= logits.max(axis=2, keepdims=True)
                q = np.exp(logits)
                q /= q.sum(axis=2, keepdims=True)
                q[:, np.arange(len(y)), y] -= 1
                w = (m * weight[y]).astype(gru.F)
                d = q * (w / w.sum().clip(1e-9))[:, :, None]
                g = {"c": d.sum(axis=(0, 1))}
                flat = d.reshape(-1, d.shape[2])
                g["v"] = np.concatenate([f.reshape(-1, h).T @ flat, b.reshape(-1, h).T @ flat])
                df, g["uf"] = gru.backward(d @ p["v"][:h].T, tf, p["uf"], m)
                db, g["ub"] = gru.backward((d @ p["v"][h:].T)[::-1], tb, p["ub"], m[::-1])
                for name, grad, at_ in (("ef", df, x), ("eb", db, x[::-1])):
                    hot = np.zeros((256, at_.size), dtype=gru.F)
                    hot[at_.ravel(), np.arange(at_.size)] = 1
                    g[name] = hot @ grad.reshape(-1, 3 * h)
                opt.step(g)
        self._run = None
        return self


def segments(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of the consecutive pieces of each text."""
    doc, k = at.run_index((lengths + size - 1) // size)
    start = k * size
    return doc, start, np.minimum(size, lengths[doc] - start)


def has_letter(texts: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.zeros(256, dtype=np.int32)
    ascii_letter[65:91] = ascii_letter[97:123] = 1
    sums = np.concatenate([[0], np.cumsum(ascii_letter[raw], dtype=np.int64)])
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[i] = any(ch.isalpha() for ch in texts[int(i)].as_py() or "")
    return out


def pooled(net: ByteTagger, raw: np.ndarray, offsets: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Mean probabilities (documents, languages) over all byte positions."""
    lengths = np.diff(offsets)
    doc, start, size = segments(lengths, SEGMENT)
    total = np.zeros((len(lengths), len(net.langs)))
    order = np.argsort(-size, kind="stable")  # whole segments need no mask
    n_full = int((size == SEGMENT).sum())
    for lo in range(0, len(order), rows):
        hi = min(lo + rows, len(order))
        for a, b, full in ((lo, min(hi, n_full), True), (max(lo, n_full), hi, False)):
            if a >= b:
                continue
            j = order[a:b]
            t = SEGMENT if full else int(size[j].max())
            at_ = offsets[doc[j]] + start[j] + np.arange(t)[:, None]
            if full:
                prob = net.sums(raw[at_], None)
            else:
                mask = (np.arange(t)[:, None] < size[j]).astype(gru.F)
                prob = net.sums(raw[np.minimum(at_, len(raw) - 1)], mask)
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(doc[j], weights=prob[k], minlength=len(lengths))
    return total / np.maximum(lengths, 1)[:, None]


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, text: str = "text", label: str = "lang", id_column: str = "doc_id", docs_per_lang: int = TRAIN_DOCS, epochs: int = 4) -> ByteTagger | None:
    """Learn from at most ``docs_per_lang`` documents of each language.

    They are those with the smallest hash of text and id, so the sample does
    not depend on partitioning. ``documents`` holds only rows to learn from.
    """
    rows = documents.where(F.col(label).isNotNull() & (F.length(text) > 0))
    # One pass for all languages. A row number of which only the first ones
    # are asked for is cut down in each partition before the exchange.
    k = F.xxhash64(F.col(id_column).cast("string"), F.lit(1))
    by_hash = Window.partitionBy("lang").orderBy("k", id_column)
    drawn = rows.select(F.col(label).alias("lang"), k.alias("k"), id_column)
    drawn = drawn.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= docs_per_lang)
    drawn = settle(drawn.select("lang", id_column), "drawn")
    langs = sorted(r[0] for r in drawn.select("lang").distinct().collect())
    if not langs:
        return None
    ids = drawn.select("lang", id_column).distinct()
    picked = rows.select(id_column, text).join(small(ids, DRAWN_ROWS), id_column)
    size, rng = SEGMENT, np.random.default_rng(11)
    codes, masks, labels = [], [], []
    # A text gives TRAIN_SEGMENTS evenly spread pieces; only these travel.
    raw = F.col(text).cast("binary")
    n = F.octet_length(text)
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(TRAIN_SEGMENTS - 1)),
        lambda i: F.substring(raw, (F.floor(i * F.greatest(n - size, F.lit(0)) / (TRAIN_SEGMENTS - 1)) + 1).cast("int"), F.lit(size)),
    )
    for r in picked.select("lang", F.array_distinct(pieces).alias("pieces"), id_column).orderBy(id_column, "lang").collect():
        for piece in r["pieces"]:
            b = np.frombuffer(bytes(piece), dtype=np.uint8)
            row = np.zeros(size, dtype=np.uint8)
            row[: len(b)] = b
            codes.append(row)
            masks.append(np.arange(size) < len(b))
            labels.append(langs.index(r["lang"]))
    if not codes:
        return None
    x, m, y = np.array(codes), np.array(masks, dtype=gru.F), np.array(labels)
    # Shorter pieces too, so that short texts are seen in training.
    cut = rng.integers(4, size + 1, len(x))
    m = m * (np.arange(size) < np.where(rng.random(len(x)) < 0.3, cut, size)[:, None])
    net = ByteTagger(langs)
    epochs = max(epochs, min(30, 30_000 // len(x)))
    return net.fit(x, m.astype(gru.F), y, epochs)


def predict(documents: DataFrame, net: ByteTagger | None, text: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score`` added."""
    if net is None:
        return documents.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    docs = documents.select(*kept)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.langs, "und"], dtype=object)
        for batch in batches:
            for part in at.chunks(batch, text):
                raw, offsets = at.utf8(part.column(text))
                prob = pooled(net, raw, offsets)
                ok = has_letter(part.column(text), raw, offsets)
                best = np.where(ok, prob.argmax(axis=1), len(net.langs))
                score = np.where(ok, prob.max(axis=1).clip(0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(label, schema)


def identify(documents: DataFrame, text: str = "text", label: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """Train on the rows that are not held out, then label every row."""
    net = train(documents.where(~held_out(id_column)), text, label, id_column)
    return predict(documents.withColumn("held_out", held_out(id_column)), net, text)
