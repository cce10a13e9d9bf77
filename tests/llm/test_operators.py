"""Brute-force checks of the free-style operators on small tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import arrowtext, components, extract, gru, jaccard, langid, packing, quality_gam, repetition, toxicity

DOC = "doc_id bigint, text string, n int, score string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in docs], DOC)


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def noisy(rng, words, n):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(len(w))
        if rng.random() < 0.5:
            w[k] = f"n{rng.randrange(10000)}"
        else:
            w.insert(k, f"n{rng.randrange(10000)}")
    return w


@pytest.mark.parametrize("seed, hot, part", [(1, 2_000, 4_096), (2, 3, 2), (3, 3, 3)])
def test_jaccard_equals_brute_force(spark, monkeypatch, seed, hot, part):
    """Also with groups so small that hot tokens and long lists are split."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    docs, k = [], 0
    for _ in range(12):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(3, 120))]
        if rng.random() < 0.5:
            base = base[:20] + passage + base[20:]
        walk = base
        for _ in range(rng.randrange(1, 9)):
            walk = noisy(rng, walk, rng.randrange(0, 4)) if rng.random() < 0.7 else noisy(rng, base, rng.randrange(0, 3))
            docs.append((k, " ".join(walk)))
            k += 1
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a B"), (1005, "a b c"), (1006, " ".join(passage)), (1007, " ".join(passage) + " x")]
    rows = jaccard.near_duplicates(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(docs)


def test_jaccard_odd_rows(spark):
    d = frame(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (1, "other words here")])
    got = sorted(((r["id"], r["component_id"]) for r in jaccard.near_duplicates(d).collect()), key=str)
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (None, None)]
    kept = jaccard.keep_representatives(d)
    assert kept.columns == d.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 1, 1, None]
    assert jaccard.near_duplicates(d.limit(0)).count() == 0


def test_block_skipping_loses_nothing():
    rng = np.random.default_rng(0)
    n = rng.integers(5, 60, 80)
    p = np.sort(rng.integers(0, 5, 80))
    g = rng.integers(0, 30, 80)
    got = {(min(x, y), max(x, y)) for a, b in jaccard.block_pairs(n, p, g, 7) for x, y in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if g[i] != g[j] and 3 * max(n[i], n[j]) <= 4 * min(n[i], n[j]) and 7 * min(n[i] - p[i], n[j] - p[j]) >= 3 * (n[i] + n[j])}
    assert got == want


def test_nearest_pairs_of_groups():
    x, y = np.triu_indices(6, 1)
    group, apart = np.array([0, 0, 1, 1, 2, 2]), (x * 7 + y * 3) % 11 / 11
    got = jaccard.nearest(x, y, apart, group, 2)
    for side in (x, y):
        for g in range(3):
            mine = group[side] == g
            assert got[mine & (apart <= np.sort(apart[mine])[:2].max())].all()
    assert 0 < got.sum() < len(x)


def test_components_of_path_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_repeats(t, least):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    n, best = len(w), [0] * len(w)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    triple = {i + k for i in range(n) if best[i] >= 3 for k in range(3)}
    union = {i + k for i in range(n) if best[i] >= least for k in range(best[i])}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(triple), len(union), max([b for b in best if b >= least], default=0)]


def test_repetition_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = [None, "", " ", "a", "a a a a", "x\n\nx\n  \ny\nx\n", "é ü | ñ é ü | ñ", "a b a b"]
    texts += [" ".join(rng.choice(list("abé"), rng.integers(1, 60))).replace("b ", "b\n") for _ in range(50)]
    m = repetition.measure(pa.array(texts), 4)
    got = np.array([m[c] for c in repetition.COUNTS + repetition.EXTRA]).T.tolist()
    assert got == [brute_repeats(t, 4) for t in texts]
    d = frame(spark, list(enumerate(texts)))
    rows = repetition.rate(d, min_repeat=4).collect()
    assert len(rows) == len(texts) and rows[0]["base_failed"] and not rows[0]["kept"]
    assert repetition.rate(d.limit(0)).count() == 0


def test_repetition_verdict(spark):
    unique = " ".join(f"w{i}" for i in range(200))
    block = " ".join(f"r{i}" for i in range(60))
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in repetition.rate(frame(spark, [(1, unique), (2, f"{block} {block} {unique[:200]}"), (3, "short text"), (4, f"{unique} {block} {block}")])).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, True)}


def test_repetition_verdict_acts_below_the_base(spark):
    say = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    long = f"{say('r', 60)} {say('a', 80)} {say('r', 60)} {say('b', 90)}"  # two copies of 21 %
    short = " ".join(f"{say(f'r{k}x', 6)} {say(f'u{k}x', 2)} {say(f'r{k}x', 6)} {say(f'v{k}x', 15)}" for k in range(10))  # 120 of 290 words
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in repetition.rate(frame(spark, [(1, long), (2, short), (3, say("w", 290))])).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (False, True)}


def brute_pack(sizes, sources, clusters, capacity, per_source):
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters):
        fits = [b for b in bins if b["left"] >= n and c not in b["c"] and b["s"].count(s) < per_source]
        b = min(fits, key=lambda b: (b["left"], b["i"]), default=None)
        if b is None:
            b = {"i": len(bins), "left": capacity, "s": [], "c": []}
            bins.append(b)
        b["left"] -= n
        b["s"].append(s)
        b["c"].append(c)
        out.append(b["i"])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_brute_force(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(1, 65) for _ in range(400)), reverse=True)
    sources = [rng.choice("aaabcdef") for _ in sizes]
    clusters = [rng.randrange(150) for _ in sizes]
    assert packing.pack(sizes, sources, clusters, 64, 2) == brute_pack(sizes, sources, clusters, 64, 2)


def test_packing_keeps_all_words(spark):
    rng = random.Random(3)
    docs = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 64, 65, 200]))), f"s{i % 3}") for i in range(300)] + [(400, None, None), (401, "a b", None), (401, "a b", None)]
    d = spark.createDataFrame([(i, t, s, 1) for i, t, s in docs], "doc_id bigint, text string, source string, bin int")
    got = packing.best_fit(d, capacity=64, shard_items=100).toPandas()
    assert got.n_words.sum() == sum(len((t or "").split()) for _, t, _ in docs)
    real = got[got["bin"] >= 0]
    fill = real.groupby("bin").n_words.sum()
    assert fill.max() <= 64 and set(got[got["bin"] < 0].n_words) == {0}
    assert (real.sort_values(["bin", "used"]).groupby("bin").n_words.cumsum() - real.sort_values(["bin", "used"]).n_words == real.sort_values(["bin", "used"]).used).all()
    assert packing.best_fit(d.limit(0)).count() == 0


def test_gru_gradients():
    rng = np.random.default_rng(1)
    t, b, h = 5, 3, 4
    gates = rng.standard_normal((t, b, 3 * h)).astype(np.float64).astype(gru.F)
    u = gru.init(rng, h)
    mask = (np.arange(t)[:, None] < np.array([5, 3, 1])).astype(gru.F)
    target = rng.standard_normal((t, b, h)).astype(gru.F)
    loss = lambda g, w: float((gru.forward(g, w, mask) * target).sum())
    _, tape = gru.forward(gates, u, mask, keep=True)
    dg, du = gru.backward(target, tape, u, mask)
    for arr, grad in ((gates, dg), (u, du)):
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in arr.shape)
            keep = arr[at]
            arr[at] = keep + 1e-2
            up = loss(gates, u)
            arr[at] = keep - 1e-2
            down = loss(gates, u)
            arr[at] = keep
            assert abs((up - down) / 2e-2 - grad[at]) < 2e-2


def test_runner_equals_forward():
    rng = np.random.default_rng(2)
    table, u = rng.standard_normal((20, 24)).astype(gru.F), gru.init(rng, 8)
    rows = rng.integers(0, 20, (7, 5))
    mask = (np.arange(7)[:, None] < np.array([7, 5, 3, 1, 0])).astype(gru.F)
    assert np.allclose(gru.Runner(table, u)(rows, mask), gru.forward(table[rows], u, mask), atol=1e-5)
    back = gru.forward(table[rows[::-1]], u, mask[::-1])[::-1]
    assert np.allclose(gru.Runner(table, u)(rows, mask, backwards=True), back, atol=1e-5)


LANG = [(i, " ".join(random.Random(i).choice(w) for _ in range(60)), lang) for i in range(60) for lang, w in ((("xx", ["alpha", "beta", "gamma"]), ("yy", ["uno", "dos", "tres"]))[i % 2],)]


def test_language_id(spark):
    rows = [(i, t, lang, 7) for i, t, lang in LANG] + [(500, None, None, 7), (501, "123 !", "xx", 7), (502, "", "yy", 7), (503, "ß", None, 7), (None, "alpha beta gamma alpha", None, 7)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = langid.identify(d).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang for i, _, lang in LANG)
    assert [by[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and by[503]["lang_pred"] in ("xx", "yy")
    none = langid.identify(d.where("doc_id >= 500")).collect()
    assert all(r["lang_pred"] in ("und", "xx", "yy") for r in none)
    assert langid.identify(d.limit(0)).count() == 0


def test_language_id_learns_every_language(spark):
    rows = [(100 * k + i, chr(0x4E00 + 97 * k) * 30, f"l{k:02}") for k in range(70) for i in range(4)]
    d = spark.createDataFrame([*rows, (9999, "no label", None)], "doc_id bigint, text string, lang string")
    net = langid.train(d, docs_per_lang=3, epochs=1)
    assert net.langs == sorted({lang for _, _, lang in rows})


def test_toxicity(spark):
    rng = random.Random(0)
    plain = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(150):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        bad = i % 3 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["zorgish", "Zorgly.", "zorgest"])
        docs.append((i, " ".join(w), 1, "s"))
        labels.append((i, int(bad)))
    docs += [(900, None, 1, "s"), (901, "", 1, "s"), (902, "...", 1, "s"), (903, " ".join(plain * 40 + ["zorged"] + plain * 40), 1, "s")]
    d = spark.createDataFrame(docs, DOC)
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(d, lab).collect()}
    held = [i for i, _ in labels if got[i]["held_out"]]
    assert held and sum(got[i]["predicted"] == int(i % 3 == 0) for i in held) / len(held) > 0.9
    assert [got[i]["score"] for i in (900, 901, 902)] == [0.0] * 3
    assert got[903]["predicted"] == 1  # one word in a long text
    assert toxicity.score_toxicity(d, lab.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(d.limit(0), lab).count() == 0


def test_windows_cover_all_words():
    w = toxicity.Words(pa.array([" ".join(f"a{i}" for i in range(n)) for n in (0, 1, 31, 32, 33, 49, 200)]))
    doc, start, size = w.windows()
    for d in range(7):
        seen = {int(s) + k for s, n in zip(start[doc == d], size[doc == d]) for k in range(n)}
        assert seen == set(range(int(w.first[d]), int(w.first[d + 1])))


def test_quality_model(spark):
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = (x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)  # no single feature tells
    m = quality_gam.fit(np.concatenate([x, np.zeros((2000, 14))], axis=1), y)
    assert (0, 1) in [p[:2] for p in m.pairs]
    test = rng.random((1000, 4))
    s = m.score(np.concatenate([test, np.zeros((1000, 14))], axis=1))
    assert ((s > 0.5) == ((test[:, 0] > 0.5) ^ (test[:, 1] > 0.5))).mean() > 0.9
    docs = [(i, "WOW!! " * 30 if i % 2 else f"a fine text {i} of words, with " + " ".join(f"x{i * k}" for k in range(30)) + ".", 1, "s") for i in range(80)] + [(100, None, 1, "s"), (101, "", 1, "s")]
    d = spark.createDataFrame(docs, DOC)
    lab = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality_gam.score_quality(d, lab).collect()}
    assert all(got[i]["predicted"] == 1 - i % 2 for i in range(80)) and 0 <= got[100]["score"] <= 1
    assert got[100]["score"] == got[101]["score"]
    assert quality_gam.score_quality(d, lab.limit(0)).count() == len(docs)
    assert quality_gam.score_quality(d.limit(0), lab).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>One <b>two</b>  three&nbsp;four.<br>Next &lt;line&gt;<p>Open <i>tag<div class="ad">Buy!</div><p>Last &#233;</p>
<aside>Side</aside><form><input><button>Go</button></form><section id="comments"><p>Nice!</p></section></article><footer>c 2024</footer></body></html>"""


def test_extraction():
    assert extract.extract_group([PAGE]) == ["Title & more\nOne two three four.\nNext <line>\nOpen tag\nLast é"]
    assert extract.extract_group([None, "", "plain text", "<p>a<p>b</p></div></p>c", "<div"]) == ["", "", "plain text", "a\nb\nc", ""]


def test_repeated_boilerplate_goes():
    foot = "All rights reserved by the example company of this site"
    pages = [f"<html><body><div>{' '.join(f'u{i}x{k}' for k in range(30))}</div><div>{foot}</div></body></html>" for i in range(10)]
    got = extract.extract_group(pages)
    assert got == [" ".join(f"u{i}x{k}" for k in range(30)) for i in range(10)]
    copies = extract.extract_group([pages[0]] * 10)  # one page, however often
    assert all(foot in t for t in copies)


def test_repeated_blocks_of_marked_articles():
    """The suffix array decides in marked articles as well; near copies and passages that some share stay."""
    words = lambda k, n: " ".join(f"u{k}x{i}" for i in range(n))
    page = lambda *blocks: f"<html><body><nav>Home</nav><article>{''.join(f'<p>{b}</p>' for b in blocks)}</article></body></html>"
    sign, quote = "Read more of our stories on this site every day", "a quote that some of the articles have in common"
    bodies = [words(i, 40) for i in range(10)]
    got = extract.extract_group([page(b, *[quote] * (i < 4), sign) for i, b in enumerate(bodies)])
    assert got == ["\n".join([b, *[quote] * (i < 4)]) for i, b in enumerate(bodies)]
    near = [page(words(0, 40), f"changed{i}", words(1, 20)) for i in range(10)]
    assert extract.extract_group(near) == ["\n".join([words(0, 40), f"changed{i}", words(1, 20)]) for i in range(10)]
    assert extract.extract_group(near + [page(b) for b in bodies[2:]])[0] == "\n".join([words(0, 40), "changed0", words(1, 20)])
    assert extract.extract_group([page(sign)] * 10) == [sign] * 10


def test_extraction_rows(spark):
    d = spark.createDataFrame([(1, "http://a.b/x", PAGE, 1), (1, "http://a.b/x", PAGE, 1), (2, None, None, 1), (None, "", "<p>x", 1)], "page_id bigint, url string, html string, host int")
    rows = extract.extract(d).collect()
    whole = len(extract.extract_group([PAGE])[0])
    assert sorted(r["n_chars"] for r in rows) == [0, 1, whole, whole]
    assert extract.extract(d.limit(0)).count() == 0


def test_hashes_and_chunks():
    t = pa.array(["ab cd", None, "", "é ab"])
    raw, off = arrowtext.utf8(t)
    s, e, f = arrowtext.spans(~arrowtext.SPACE[raw], off)
    assert [raw[a:b].tobytes().decode() for a, b in zip(s, e)] == ["ab", "cd", "é", "ab"] and f.tolist() == [0, 2, 2, 2, 4]
    h = arrowtext.span_hashes(raw, s, e)
    assert h[0] == h[3] and len(set(h.tolist())) == 3
    b = pa.RecordBatch.from_arrays([t], names=["text"])
    assert sum(p.num_rows for p in arrowtext.chunks(b, "text", 3)) == 4
    sliced = b.slice(1, 3)
    assert [arrowtext.utf8(p.column("text"))[0].tobytes().decode() for p in arrowtext.chunks(sliced, "text", 100)] == ["é ab"]
