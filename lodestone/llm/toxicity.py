"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A text is cut into overlapping windows of words. Each word enters by
character inputs (a bidirectional GRU over its UTF-8 bytes, and the strongest
association of one of its character n-grams with the label) and word inputs
(a hashed embedding, and the word's own association with the label). A
bidirectional GRU reads the window, attention pools its states, and a
logistic unit scores it. A text's score is that of its worst window; every
window of every text is scored. Trained in numpy on weakly labelled windows.

Defined results: a text without words (null, empty, only punctuation), or
anything when no toxic or no clean row could be learned from, scores 0. Rows
are never merged. Extra columns pass through; a column with the name of a
result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at
from . import gru

WINDOW, STRIDE = 32, 16  # words
LONGEST = 24  # bytes of a word; longer ones are read in pieces
BUCKETS = 4096  # rows of the hashed word embedding
CHARS, EMBED, HIDDEN, ATTEND = 8, 8, 8, 8
GRAMS = (4, 5, 6)  # bytes of the character n-grams
INPUTS = 2 * CHARS + EMBED + 2
SAMPLE = 1000  # bound on training rows of each class
THRESHOLD = 0.7

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


class Words:
    """The words of a chunk of texts, distinct ones numbered."""

    def __init__(self, column: pa.Array):
        raw, offsets = at.utf8(column)
        raw = at.LOWER[raw]
        starts, ends, first = at.spans(_INSIDE[raw], offsets)
        piece, k = at.run_index((ends - starts + LONGEST - 1) // LONGEST)
        s = starts[piece] + k * LONGEST
        e = np.minimum(s + LONGEST, ends[piece])
        shift = np.concatenate([[0], np.cumsum((ends - starts + LONGEST - 1) // LONGEST)])
        self.first = shift[first]  # offsets of each document's words
        self.hash = at.span_hashes(raw, s, e)
        self.keys, at_, self.ids = np.unique(self.hash, return_index=True, return_inverse=True)
        pos = s[at_] + np.arange(LONGEST)[:, None]
        size = (e - s)[at_]
        self.mask = (np.arange(LONGEST)[:, None] < size).astype(gru.F)
        self.codes = raw[np.minimum(pos, max(len(raw) - 1, 0))] if len(raw) else np.zeros((LONGEST, 0), np.uint8)
        self.codes = np.where(self.mask > 0, self.codes, 0)
        self.docs = len(self.first) - 1

    def part(self, at_: slice) -> Words:
        """Some of the distinct words, without their places."""
        out = object.__new__(Words)
        out.keys, out.codes, out.mask = self.keys[at_], self.codes[:, at_], self.mask[:, at_]
        return out

    def grams(self, n: int) -> np.ndarray:
        """Hashes (positions, words) of the n-grams of each distinct word; 0
        where a word is too short."""
        h = np.zeros((LONGEST - n + 1, self.codes.shape[1]), dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.codes[k : LONGEST - n + 1 + k].astype(np.uint64) + np.uint64(1)
        return np.where(self.mask[n - 1 :] > 0, at.mix(h), np.uint64(0))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and length of every overlapping window."""
        n = np.diff(self.first)
        doc, k = at.run_index(np.where(n == 0, 0, 1 + (np.maximum(n - WINDOW, 0) + STRIDE - 1) // STRIDE))
        start = np.minimum(k * STRIDE, np.maximum(n[doc] - WINDOW, 0))
        return doc, self.first[doc] + start, np.minimum(n[doc], WINDOW)


class WindowScorer:
    """The network. keys, odds: associations of words; grams: the same of
    character n-grams, those that speak for the label only."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray, grams: tuple[np.ndarray, np.ndarray], seed: int = 5):
        rng = np.random.default_rng(seed)
        g = lambda *shape, s=0.3: (rng.standard_normal(shape) * s).astype(gru.F)
        h3, d = 3 * HIDDEN, INPUTS
        self.words, self.grams = (keys, odds.astype(gru.F)), (grams[0], grams[1].astype(gru.F))
        self.p = {"cf": g(256, 3 * CHARS), "cb": g(256, 3 * CHARS), "cuf": gru.init(rng, CHARS), "cub": gru.init(rng, CHARS), "emb": g(BUCKETS, EMBED, s=0.05)}
        self.p |= {"wf": g(d, h3), "wb": g(d, h3), "bf": np.zeros(h3, gru.F), "bb": np.zeros(h3, gru.F), "uf": gru.init(rng, HIDDEN), "ub": gru.init(rng, HIDDEN)}
        self.p |= {"a": g(2 * HIDDEN, ATTEND), "av": g(ATTEND), "o": g(2 * HIDDEN), "c": np.zeros(1, gru.F)}

    def associations(self, w: Words, step: int = 8192) -> np.ndarray:
        """(words, 2): the word's own, and its strongest n-gram's."""
        out = np.zeros((len(w.keys), 2), gru.F)
        out[:, 0] = look_up(w.keys, *self.words)
        for n in GRAMS:
            for i in range(0, len(w.keys), step) if len(self.grams[0]) else ():
                g = Words.grams(w.part(slice(i, i + step)), n)
                size = int((g != 0).any(axis=1).sum())
                if size:
                    best = look_up(g[:size].ravel(), *self.grams).reshape(size, -1).max(axis=0)
                    out[i : i + step, 1] = np.maximum(out[i : i + step, 1], best)
        return out

    def features(self, keys, codes, mask, known, step: int = 2048) -> np.ndarray:
        """Inputs (words, INPUTS), from characters and words."""
        p, out = self.p, []
        rf, rb = gru.Runner(p["cf"], p["cuf"]), gru.Runner(p["cb"], p["cub"])
        size = mask.sum(axis=0).astype(np.int64)
        for i in range(0, len(keys), step):
            t = max(1, int(size[i : i + step].max(initial=1)))
            c, m = codes[:t, i : i + step], mask[:t, i : i + step]
            out.append(np.concatenate([rf(c, m)[-1], rb(c, m, backwards=True)[0]], axis=1))
        chars = np.concatenate(out) if out else np.zeros((0, 2 * CHARS), gru.F)
        emb = p["emb"][(keys % np.uint64(BUCKETS)).astype(np.int64)]
        return np.concatenate([chars, emb, known], axis=1)

    def score(self, w: Words, step: int = 2048) -> np.ndarray:
        """Each document's score: the worst of all its windows."""
        p = self.p
        order = np.argsort(-w.mask.sum(axis=0), kind="stable")  # alike lengths together
        feats = np.empty((len(w.keys), INPUTS), gru.F)
        feats[order] = self.features(w.keys[order], w.codes[:, order], w.mask[:, order], self.associations(w)[order])
        # One more row stands for the padding of texts shorter than a window.
        pad = np.zeros((1, 3 * HIDDEN), gru.F)
        rf = gru.Runner(np.concatenate([feats @ p["wf"] + p["bf"], pad]), p["uf"])
        rb = gru.Runner(np.concatenate([feats @ p["wb"] + p["bb"], pad]), p["ub"])
        doc, start, size = w.windows()
        best = np.full(w.docs, -np.inf, gru.F)
        short = size < WINDOW
        for group in (np.flatnonzero(~short), np.flatnonzero(short)):
            for i in range(0, len(group), step):
                j = group[i : i + step]
                t = int(size[j].max())
                at_ = start[j] + np.arange(t)[:, None]
                mask = None
                if size[j].min() < t:
                    mask = (np.arange(t)[:, None] < size[j]).astype(gru.F)
                    ids = np.where(mask > 0, w.ids[np.minimum(at_, len(w.ids) - 1)], len(feats))
                else:
                    ids = w.ids[at_]
                h = np.concatenate([rf(ids, mask), rb(ids, mask, backwards=True)], axis=2)
                e = np.tanh(h @ p["a"]) @ p["av"]
                if mask is not None:
                    e = np.where(mask > 0, e, gru.F(-30))
                e = np.exp(e - e.max(axis=0))
                e /= e.sum(axis=0)
                np.maximum.at(best, doc[j], np.einsum("tb,tbh,h->b", e, h, p["o"], optimize=True) + p["c"])
        return np.where(np.isneginf(best), 0.0, 1 / (1 + np.exp(-best.clip(-30, 30).astype(np.float64))))

    def learn(self, keys, codes, cmask, known, ids, mask, y, rate_step) -> float:
        """One step on windows ids (T, B) of the words keys (D)."""
        p, g, h = self.p, {}, HIDDEN
        hid = (keys % np.uint64(BUCKETS)).astype(np.int64)
        t = max(1, int(cmask.sum(axis=0).max()))
        codes, cmask = codes[:t], cmask[:t]
        cf, tcf = gru.forward(p["cf"][codes], p["cuf"], cmask, keep=True)
        cb, tcb = gru.forward(p["cb"][codes[::-1]], p["cub"], cmask[::-1], keep=True)
        x = np.concatenate([cf[-1], cb[-1], p["emb"][hid], known], axis=1)
        f, tf = gru.forward((x @ p["wf"] + p["bf"])[ids], p["uf"], mask, keep=True)
        b, tb = gru.forward((x @ p["wb"] + p["bb"])[ids[::-1]], p["ub"], mask[::-1], keep=True)
        s = np.concatenate([f, b[::-1]], axis=2)
        q = np.tanh(s @ p["a"])
        e = np.where(mask > 0, q @ p["av"], gru.F(-30))
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", e, s)
        logit = pooled @ p["o"] + p["c"]
        prob = 1 / (1 + np.exp(-logit.clip(-30, 30)))
        d = ((prob - y) / len(y)).astype(gru.F)
        g["c"], g["o"] = d.sum(keepdims=True), pooled.T @ d
        d_pool = d[:, None] * p["o"]
        d_e = np.einsum("bh,tbh->tb", d_pool, s)
        d_e = e * (d_e - (e * d_e).sum(axis=0)) * (mask > 0)
        d_q = d_e[:, :, None] * p["av"] * (1 - q * q)
        g["av"] = np.einsum("tb,tba->a", d_e, q)
        g["a"] = s.reshape(-1, 2 * h).T @ d_q.reshape(-1, ATTEND)
        d_s = e[:, :, None] * d_pool + d_q @ p["a"].T
        df, g["uf"] = gru.backward(np.ascontiguousarray(d_s[:, :, :h]), tf, p["uf"], mask)
        db, g["ub"] = gru.backward(np.ascontiguousarray(d_s[::-1, :, h:]), tb, p["ub"], mask[::-1])
        gf, gb = np.zeros((len(keys), 3 * h), gru.F), np.zeros((len(keys), 3 * h), gru.F)
        np.add.at(gf, ids.ravel(), df.reshape(-1, 3 * h))
        np.add.at(gb, ids[::-1].ravel(), db.reshape(-1, 3 * h))
        g["wf"], g["bf"], g["wb"], g["bb"] = x.T @ gf, gf.sum(axis=0), x.T @ gb, gb.sum(axis=0)
        dx = gf @ p["wf"].T + gb @ p["wb"].T
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], hid, dx[:, 2 * CHARS : -2])
        for k, (grad, tape, u, table, c) in enumerate(((dx[:, :CHARS], tcf, "cuf", "cf", codes), (dx[:, CHARS : 2 * CHARS], tcb, "cub", "cb", codes[::-1]))):
            d_out = np.zeros((t, len(keys), CHARS), gru.F)
            d_out[-1] = grad
            dg, g[u] = gru.backward(d_out, tape, p[u], cmask if k == 0 else cmask[::-1])
            g[table] = np.zeros_like(p[table])
            np.add.at(g[table], c.ravel(), dg.reshape(-1, 3 * CHARS))
        rate_step.step(g)
        return float(-(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)).mean())


def look_up(keys: np.ndarray, known: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of each key; 0 for unknown ones. ``known`` is sorted."""
    if not len(known):
        return np.zeros(len(keys), gru.F)
    i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[i] == keys, value[i], 0).astype(gru.F)


def shrunk_odds(doc: np.ndarray, item: np.ndarray, items: int, toxic: np.ndarray) -> np.ndarray:
    """Log odds of the label for each item, by the documents that hold it,
    drawn to 0 for rare ones; 0 if fewer than 3 documents hold it."""
    pair = at.distinct(doc * items + item)
    y, k = toxic[pair // items], pair % items
    ct, cn = np.bincount(k[y], minlength=items), np.bincount(k[~y], minlength=items)
    nt, nn = toxic.sum(), (~toxic).sum()
    odds = np.log((ct + 0.5) / (nt + 1)) - np.log((cn + 0.5) / (nn + 1))
    return np.where(ct + cn >= 3, odds * ct / (ct + 0.02 * nt + 1), 0.0)


def associations(w: Words, toxic: np.ndarray):
    """Of words, and of the n-grams that speak for the label: keys, values."""
    doc = np.repeat(np.arange(w.docs), np.diff(w.first))
    odds = shrunk_odds(doc, w.ids, len(w.keys), toxic)
    pair = at.distinct(doc * len(w.keys) + w.ids)
    p_doc, p_word = pair // len(w.keys), pair % len(w.keys)
    found = []
    for n in GRAMS:
        g = w.grams(n)
        keys, item = np.unique(g, return_inverse=True)
        item = item.reshape(g.shape)
        at_, word = np.nonzero(g)
        # Documents of each gram, by way of the words that hold it.
        order = np.argsort(word, kind="stable")
        start, many = np.searchsorted(word[order], p_word), np.bincount(word, minlength=len(w.keys))[p_word]
        own, k = at.run_index(many)
        grams = item[at_[order], word[order]][start[own] + k]
        value = shrunk_odds(p_doc[own], grams, len(keys), toxic)
        found.append((keys[value > 1], value[value > 1]))
    keys, value = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(keys)
    return (w.keys, odds), (keys[order], value[order])


def fit(texts: list[str], toxic: np.ndarray, steps: int = 220, batch: int = 64, seed: int = 5) -> WindowScorer | None:
    """Learn from whole texts with one label each.

    The window of a toxic text that holds its most telling word counts as
    toxic; of a clean text that window and random ones count as clean.
    """
    toxic = np.asarray(toxic, dtype=bool)
    w = Words(pa.array(texts, pa.string()))
    if not toxic.any() or toxic.all() or not len(w.ids):
        return None
    rng = np.random.default_rng(seed)
    (keys, odds), grams = associations(w, toxic)
    net, opt_rate = WindowScorer(keys[odds != 0], odds[odds != 0], grams), 1e-2
    known = net.associations(w)
    value, n = known.sum(axis=1)[w.ids], np.diff(w.first)
    peak = np.array([a + int(np.argmax(value[a:b])) if b > a else -1 for a, b in zip(w.first[:-1], w.first[1:])])
    pos, neg = np.flatnonzero(toxic & (n > 0)), np.flatnonzero(~toxic & (n > 0))
    if not len(pos) or not len(neg):
        return None
    opt = gru.Adam(net.p, rate=opt_rate)
    for step in range(steps):
        opt.rate = opt_rate * (1 - 0.95 * step / steps)
        a, b = rng.choice(pos, batch // 4), rng.choice(neg, batch - batch // 4)
        doc = np.concatenate([a, b])
        y = np.concatenate([np.ones(len(a)), np.zeros(len(b))]).astype(gru.F)
        near = peak[doc] - rng.integers(0, WINDOW, len(doc))
        free = w.first[doc] + (rng.random(len(doc)) * n[doc]).astype(np.int64)
        start = np.where((y > 0) | (rng.random(len(doc)) < 0.4), near, free)
        size = np.minimum(n[doc], WINDOW)
        start = np.clip(start, w.first[doc], w.first[doc + 1] - size)
        mask = (np.arange(WINDOW)[:, None] < size).astype(gru.F)
        at_ = np.where(mask > 0, start + np.arange(WINDOW)[:, None], start)
        used, ids = np.unique(w.ids[at_], return_inverse=True)
        net.learn(w.keys[used], w.codes[:, used], w.mask[:, used], known[used], ids.reshape(at_.shape), mask, y, opt)
    return net


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> WindowScorer | None:
    """Learn from at most ``sample`` labelled rows of each class, those with
    the smallest hash of their id; only these texts reach the driver."""
    known = labels.where(F.col(label).isNotNull()).groupBy(id_column).agg((F.max(label) > 0).alias("y"))
    known = known.withColumn("k", F.xxhash64(F.col(id_column).cast("string"), F.lit(2)))
    ids = [known.where(F.col("y") == v).orderBy("k", id_column).limit(sample) for v in (True, False)]
    # At most 2 * sample ids: small enough to broadcast.
    ids = ids[0].unionByName(ids[1]).select(id_column, "y")
    rows = documents.where(F.col(text).isNotNull()).select(id_column, text).join(F.broadcast(ids), id_column)
    rows = sorted(((r[id_column], r[text], r["y"]) for r in rows.collect()), key=lambda r: (str(r[0]), r[1]))
    return fit([r[1] for r in rows], np.array([r[2] for r in rows], dtype=bool)) if rows else None


def predict(documents: DataFrame, net: WindowScorer | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with ``score`` and ``predicted`` added."""
    docs = documents.select(*[c for c in documents.columns if c not in ("score", "predicted")])
    if net is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.chunks(batch, text, 1_500_000):
                s = net.score(Words(part.column(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, "score"])

    return docs.mapInArrow(rate, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_toxicity(documents: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Train on labelled rows that are not held out, then score every row."""
    net = train(documents.where(~held_out(id_column)), labels.where(~held_out(id_column)), text, id_column)
    return predict(documents.withColumn("held_out", held_out(id_column)), net, text)
