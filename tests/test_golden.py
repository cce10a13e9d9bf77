"""Golden rows of transforms and views, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import verifiers as vf
from lodestone.operators import metrics, near_duplicates as nd, predicates, sampling, snapshot, tokenizer as tk, transforms as tr, views
from lodestone.plans import registry


def chat(spark, *rows):
    names = {"s": "system", "u": "user", "a": "assistant"}
    return spark.createDataFrame([(1, i, names.get(r, r), t) for i, (r, t) in enumerate(rows)], "conv_id bigint, turn bigint, role string, text string")


def turns(df):
    return [[(t["prompt"], t["completion"], t["scratchpad"]) for t in r["turns"]] for r in df.collect()]


def test_chat_loses_unanswered_messages(spark):
    out = tr.chat_to_sft(chat(spark, ("s", "S"), ("u", "a"), ("u", "b"), ("a", "c"), ("a", "d"), ("u", "e")))
    assert turns(out) == [[("b", "c\n\nd", None)]]
    assert out.first()["system_prompt"] == "S"


def test_chat_think_pattern(spark):
    out = tr.chat_to_sft(chat(spark, ("u", "q"), ("a", "<think> r </think> f")), think_pattern=r"(?s)^\s*<think>(.*?)</think>(.*)$")
    assert turns(out) == [[("q", "f", "r")]]


def test_chat_drops_long_turns(spark):
    out = tr.chat_to_sft(chat(spark, ("u", "aaaa"), ("a", "bbbb"), ("u", "c"), ("a", "d")), max_turn_chars=5)
    assert turns(out) == [[("c", "d", None)]]


@pytest.mark.parametrize("rows", [[("x", "?")], [("u", "a"), ("a", "b"), ("s", "late")]])
def test_chat_raises(spark, rows):
    with pytest.raises(Exception, match="unknown role|system message"):
        tr.chat_to_sft(chat(spark, *rows)).collect()


def test_split_qa(spark):
    d = spark.createDataFrame([("r", "P\nQuestion: q1 Answer: a1\nQuestion: q2\nQuestion: q3 Answer: a3"), ("no", "Question: q Answer: a"), ("n", None)], "record_id string, text string")
    got = sorted(tuple(r) for r in tr.split_qa_pairs(d).collect())
    assert got == [("r.qa-1", "P\n\nQuestion: q1", "a1"), ("r.qa-3", "P\n\nQuestion: q3", "a3")]


def test_field_mapping_and_fan_out(spark):
    d = spark.createDataFrame([("r", "x", "", 1)], "record_id string, a string, b string, n int")
    f = tr.field_mapping({"text": ["a", "b"]})
    assert f(d).collect() == [("r", "x")]
    assert sorted(r[0] for r in tr.fan_out(f, f)(d).collect()) == ["r.transform_0.0", "r.transform_1.0"]
    with pytest.raises(TypeError):
        tr.field_mapping({"text": ["n"]})(d)


def test_math_rationale(spark):
    d = spark.createDataFrame([("a <<1+1=2>>2\n#### 2",), ("no mark",), ("#### 3",), (None,)], "t string")
    assert [r[0] for r in d.select(tx.math_rationale(F.col("t"))).collect()] == ["a 2\nFinal answer: 2", "no mark", "3", None]


def test_choices(spark):
    one = spark.range(1).select(F.array(F.lit("A"), F.lit("B")).alias("l"), F.array(F.lit("x"), F.lit("y")).alias("c"))
    place = tx.choice_by_label(F.col("l"), F.lit("B"))
    assert one.select(*[tx.choice_response(F.col("c"), place, k) for k in ("label", "number", "both")]).first()[:] == ("y", "2", "2. y")
    with pytest.raises(Exception, match="unknown choice"):
        one.select(tx.choice_by_label(F.col("l"), F.lit("C"))).collect()


def test_threads(spark):
    m = spark.createDataFrame([("m1", None, "u", "1", "en"), ("m2", "m1", "a", "2", "en"), ("m3", "m1", "a", "3", "fr"), ("m4", "m2", "u", "4", "en"), ("alone", None, "u", "5", "en"), ("lost", "gone", "u", "6", "en")], "message_id string, parent_id string, role string, text string, lang string")
    got = {r["leaf_id"]: [x["message_id"] for x in r["messages"]] for r in tr.threads(m).collect()}
    assert got == {"m3": ["m1", "m3"], "m4": ["m1", "m2", "m4"]}


def test_filter_rules(spark):
    d = spark.createDataFrame([(1, "2", True, (5,)), (0, "x", False, None), (None, None, None, (None,))], "n int, s string, b boolean, o struct<k: int>")
    keep = lambda p, **t: predicates.filter_records(d, p, **t).count()
    assert (keep("n", gte=1), keep("s", gte=1), keep("b", gte=0), keep("o.k", gt=1)) == (1, 0, 0, 1)
    assert (keep("o.k", exists=True), keep("o.z", exists=True), keep("z", exists=False)) == (3, 0, 3)
    for bad in ({}, {"gt": 1, "lt": 2}, {"gt": "x"}, {"gt": True}, {"in": "ab"}, {"exists": 1}, {"like": "x"}):
        with pytest.raises(ValueError):
            predicates.predicate(d.schema, "n", **bad)


def windows(spark, n, p=views.Windowing()):
    return [tuple(w) for w in spark.range(1).select(views.windows(F.lit(n), p).alias("w")).first()["w"]]


def test_windows_golden(spark):
    assert windows(spark, 2000) == [(0, 1024, 0), (896, 1920, 1024), (976, 2000, 1920)]


def by_loop(n, p):
    out, start = [], 0
    if n == 0:
        return []
    if n <= p.length:
        return [(0, n, 0)]
    while start < n:
        stop, new = min(start + p.length, n), start if start == 0 else start + p.overlap
        if stop - new < p.min_new:
            if p.align_last and n - p.length != start:
                out.append((n - p.length, n, new))
            return out
        out.append((start, stop, new))
        if stop == n:
            return out
        start += p.length - p.overlap
    return out


@pytest.mark.parametrize("p", [views.Windowing(), views.Windowing(64, 16, 20), views.Windowing(10, 0, 3), views.Windowing(64, 16, 20, False)])
def test_windows_equal_loop(spark, p):
    rows = spark.range(0, 2200, 7).select("id", views.windows(F.col("id").cast("int"), p).alias("w")).collect()
    for r in rows:
        assert [tuple(w) for w in r["w"]] == by_loop(r["id"], p), r["id"]


def test_units_cover_text_once(spark):
    rows = spark.range(1, 5000, 13).select("id", F.explode(views.windows(F.col("id").cast("int"))).alias("w"))
    bad = rows.groupBy("id").agg(F.sum(views.work_units(F.col("w"))).alias("u")).where("u <> id - 1")
    assert bad.count() == 0


def test_bad_configs():
    with pytest.raises(ValueError):
        views.Windowing(10, 10)
    with pytest.raises(ValueError):
        snapshot.SourceQuota("s", oversampling=0)
    with pytest.raises(ValueError):
        snapshot.SnapshotSpec("a", [], {"train": 1}, excluded_snapshots=("a",))
    with pytest.raises(ValueError):
        nd.check_bands(128, 7)
    with pytest.raises(ValueError):
        sampling.size_or_fraction(None, "k", 0, size=1, fraction=0.5)


def test_split_bounds(spark):
    spec = snapshot.SnapshotSpec("s", [snapshot.SourceQuota("a")], {"train": 35, "eval": 30})
    q = snapshot.quotas(spark, spec)
    pool = spark.createDataFrame([(f"r{i}", "a", n) for i, n in enumerate([10, 20, 30, 40])], "rec_id string, src_id string, rec_len bigint")
    got = snapshot.select_members(pool, q, spec).collect()
    order = [r["rec_id"] for r in pool.withColumn("k", snapshot.h60(F.col("rec_id"), F.lit("sample"), F.lit(0))).orderBy("k").collect()]
    size, cum, want = dict(zip(["r0", "r1", "r2", "r3"], [10, 20, 30, 40])), 0, {}
    for r in order:
        cum += size[r]
        if cum <= 65:
            want[r] = "train" if cum <= 35 else "eval"
    assert {r["rec_id"]: r["split"] for r in got} == want


def test_quota_truncates(spark):
    spec = snapshot.SnapshotSpec("s", [snapshot.SourceQuota("a", 1), snapshot.SourceQuota("b", 3)], {"train": 101})
    assert sorted((r["src_id"], r["bud_train"]) for r in snapshot.quotas(spark, spec).collect()) == [("a", 25), ("b", 75)]


def test_infeasible_raises(spark):
    spec = snapshot.SnapshotSpec("s", [snapshot.SourceQuota("a"), snapshot.SourceQuota("none")], {"train": 10})
    pool = spark.createDataFrame([("r", "a", 100)], "rec_id string, src_id string, rec_len bigint")
    with pytest.raises(ValueError, match="none wants 5, has -1"):
        snapshot.check_feasible(snapshot.availability(pool, snapshot.quotas(spark, spec), spec))


def test_verdicts(spark):
    e = spark.createDataFrame([("c_1", "c_2", False), ("c_2", "c_10", False), ("d_1", "REF", True), ("d_1", "d_2", False), ("c_9", "x_1", False)], "uid1 string, uid2 string, has_reference boolean")
    got = {r["rec_id"]: r["reason"] for r in nd.verdicts(nd.components(e), e).collect()}
    assert got == {"c_10": "within_snapshot", "c_2": "within_snapshot", "d_1": "reference", "d_2": "reference", "x_1": "within_snapshot"}


def test_components_equal_closure(spark):
    import random

    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(110)] + [(f"p{i}", f"p{i + 1}") for i in range(60)]
    pairs = [(a, b) for a, b in pairs if a != b]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    want = {}
    for x in list(up):
        want.setdefault(find(x), set()).add(x)
    want = {x: min(g) for g in want.values() for x in g}
    df = spark.createDataFrame(pairs, "uid1 string, uid2 string")
    assert {r["id"]: r["component"] for r in nd.components(df).collect()} == want


def test_minhash_bits(spark):
    import re

    import xxhash

    text = "one two three four five six seven"
    w = re.findall(r"\w+", text)
    m = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * nd.MIX_1 & m
        x = (x ^ (x >> 27)) * nd.MIX_2 & m
        return x ^ (x >> 31)

    base = [xxhash.xxh3_64_intdigest(" ".join(w[i : i + 5])) for i in range(3)]
    want = [min(mixed(b ^ (k * nd.GOLDEN & m)) for b in base) for k in range(1, 129)]
    d = spark.createDataFrame([("a", text), ("b", "too short"), ("c", None)], "rec_id string, text string")
    got = {r["rec_id"]: [x & m for x in r["sig_vector"]] for r in nd.signatures(d, "text", base="xxh3").collect()}
    assert got["a"] == want and got["b"] == got["c"] == [m] * 128


def test_packing_golden(spark):
    assert views.first_fit_buffer([3, 4, 9, 2], [True, True, False, True], [True] * 4, 10, 0.8, 3) == [0, 0, 2, 0]


def test_packs_hold_windows_of_all_documents(spark, tmp_path):
    """The query against brute force, with texts longer than a window."""
    import random

    rng = random.Random(5)
    docs = [(i, f"s{i % 2}", rng.choice([0, 40, 300, 700, 1024, 1025, 1200, 1930, 5000])) for i in range(300)]
    spark.createDataFrame(docs, "doc_id bigint, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for source in ("s0", "s1"):
        rows = []
        for i, s, n in docs:
            start = 0
            while s == source and n:
                stop = min(start + 1024, n)
                if start and stop - start - 128 < 256:
                    start, stop = n - 1024, n
                rows.append((f"{i}:{start}", stop - start, stop == n, start == 0))
                if stop == n:
                    break
                start += 896
        for k in range(0, len(rows), 200):
            batch = list(rows[k : k + 200])
            for a, row in enumerate(batch):
                if row is None:
                    continue
                size, closed, n = row[1], row[2], 1
                want[row[0]] = row[0]
                if size >= 0.8 * 1024 or not closed:
                    continue
                for b in range(a + 1, len(batch)):
                    if batch[b] and batch[b][3] and batch[b][1] <= 1024 - size - (not closed):
                        size, closed, n = size + batch[b][1] + (not closed), batch[b][2], n + 1
                        want[batch[b][0]], batch[b] = row[0], None
                        if n >= 3 or size >= 0.8 * 1024:
                            break
    got = {r["uid"]: r["pack_uid"] for r in registry.queries()["first_fit_packs"](spark, str(tmp_path)).collect()}
    assert got == want and any(u.endswith(":896") for u in got)


def test_edges_of_128_hashes_equal_brute_force(spark, tmp_path):
    import random

    rng = random.Random(6)
    base = [[f"w{rng.randrange(9000)}" for _ in range(150)] for _ in range(6)]

    def near(w):
        w = list(w)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9000)}"
        return " ".join(w)

    docs, items = [(i, "s", near(base[i % 6])) for i in range(36)], [(1, near(base[0])), (2, "a b c d e f")]
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    import xxhash

    def sign(t):
        w, m = t.split(), (1 << 64) - 1
        out = [m] * 128
        for h in {xxhash.xxh3_64_intdigest(" ".join(w[i : i + 5])) for i in range(len(w) - 4)}:
            for s in range(128):
                x = h ^ ((s + 1) * nd.GOLDEN & m)
                x = (x ^ x >> 30) * nd.MIX_1 & m
                x = (x ^ x >> 27) * nd.MIX_2 & m
                out[s] = min(out[s], x ^ x >> 31)
        return out

    sig = {f"s_{i}": sign(t) for i, _, t in docs} | {f"bench_{i}": sign(t) for i, t in items}
    want, group = {}, {k: k for k in sig}
    for a in sig:
        for b in sig:
            if a.startswith("s_") and (b.startswith("bench_") or b > a):
                same = sum(x == y for x, y in zip(sig[a], sig[b]))
                if same >= 96 and any(sig[a][k : k + 8] == sig[b][k : k + 8] for k in range(0, 128, 8)):
                    want[a, b] = same / 128
    for _ in sig:
        for a, b in want:
            group[a] = group[b] = min(group[a], group[b])
    linked = {x for e in want for x in e}
    q = registry.queries()
    edges = {(r["uid1"], r["uid2"]): r["similarity"] for r in q["duplicate_edges_128"](spark, str(tmp_path)).collect()}
    assert edges == want and len(want) > 5
    assert {r["id"]: r["component"] for r in q["duplicate_clusters_128"](spark, str(tmp_path)).collect()} == {x: group[x] for x in linked}
    gone = {}
    for x in linked - {k for k in linked if k.startswith("bench_")}:
        members = [y for y in linked if group[y] == group[x]]
        if any(y.startswith("bench_") for y in members):
            gone[x] = "reference"
        elif x != min(members):
            gone[x] = "within_snapshot"
    assert {r["rec_id"]: r["reason"] for r in q["dedup_verdicts_128"](spark, str(tmp_path)).collect()} == gone


def test_audit_of_rare_tokens(spark, tmp_path):
    text = "plain plain a@b.org see.Example.com/x HTTP 0xff deadbeef12345678 7 42 v2 x<=1 /usr/bin // " + "l" * 24 + " soft\u00adhyphen"
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["token"]: r for r in registry.queries()["vocabulary_audit_full"](spark, str(tmp_path)).collect()}
    assert set(rows) == set(text.split()) and rows["plain"]["n"] == 2
    on = {t: {c for c, v in r.asDict().items() if v is True} for t, r in rows.items()}
    assert on["plain"] == set() and on["HTTP"] == {"url"} and on["7"] == {"single_digit"} and on["42"] == {"pure_digits", "digit_run"}
    assert on["a@b.org"] >= {"email"} and on["see.Example.com/x"] >= {"url", "path"} and on["//"] == {"url", "operator"}
    assert on["0xff"] == {"hex", "digit_and_other"} and on["deadbeef12345678"] == {"hex", "digit_run", "digit_and_other"}
    assert on["x<=1"] == {"operator", "digit_and_operator", "operator_and_alnum", "digit_and_other"}
    assert on["/usr/bin"] == {"path", "operator", "operator_and_alnum"} and on["l" * 24] == {"very_long"} and on["soft\u00adhyphen"] == {"suspicious"}
    inner = tk.flags(spark.createDataFrame([("a b",), (" ab ",)], "token string")).collect()
    assert [r["inner_whitespace"] for r in inner] == [True, False]


def test_context_suffix(spark):
    one = spark.range(1).select(views.newest_that_fit(F.array(F.lit(4), F.lit(9), F.lit(3)), F.lit(10)).alias("n"))
    assert one.first()["n"] == 1


def test_budgets(spark):
    d = spark.createDataFrame([(i, u) for i, u in enumerate([4, 5, 3, 1, 1, 1])], "i int, u int")
    assert views.within_budget(d.where("i < 4"), "u", 10, "i").count() == 2
    assert views.whole_batches(d, "u", 10, 2, "i").count() == 4


def test_mixture(spark):
    d = spark.createDataFrame([(s, f"{s}{i}", 10, i) for s, n in (("a", 40), ("b", 40)) for i in range(n)], "source string, uid string, units bigint, ord int")
    rows = views.mix_exact(d, {"a": 3.0, "b": 1.0}).orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(len(rows)))
    assert sum(r["source"] == "a" for r in rows) == 40 and abs(sum(r["source"] == "b" for r in rows) - 13) <= 1
    again = views.mix_exact(d, {"a": 3.0, "b": 1.0}, {"a": 1}).collect()
    assert sum(r["source"] == "a" for r in again) > 40
    with pytest.raises(Exception, match="empty"):
        views.mix_exact(d, {"a": 1.0, "z": 1.0}).collect()


def test_metrics(spark):
    one = spark.range(1)
    assert one.select(metrics.pass_at_k(F.lit(4), F.lit(1), 2)).first()[0] == 0.5
    d = spark.range(1, 11).select(F.col("id").alias("v"))
    assert metrics.nearest_rank(d, "v", [50, 95]).first()[:] == (5, 9)
    ids = spark.createDataFrame([("s_1_5.0.transform_1.0",), ("z.1",)], "id string")
    known = spark.createDataFrame([("s_1_5", "src"), ("s_1_5.0", "longer")], "k string, src string")
    assert {r[0]: r[1] for r in metrics.longest_prefix(ids, known, "id", "src").collect()} == {"s_1_5.0.transform_1.0": "longer", "z.1": "<unclassified>"}


def test_power_law(spark):
    curve = spark.range(1, 41).select(F.lit("r").alias("run"), (F.col("id") * 1e6).alias("tokens")).withColumn("loss", 1.5 + 3 * F.pow("tokens", F.lit(-0.2)))
    fit = metrics.power_law(curve, "run").first()
    assert abs(fit["l"] - 1.5) < 1e-3 and abs(fit["alpha"] - 0.2) < 1e-3 and fit["r2"] > 0.9999
    assert metrics.power_law(curve.limit(5), "run").count() == 0


def test_verifiers(spark):
    one = lambda t, c: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(" Yes ", lambda c: vf.exact(c, "yes")) == 1.0
    assert one("I say yes.", lambda c: vf.exact(c, "yes", 0.5)) == 0.5
    assert one("yesterday", lambda c: vf.contains_any(c, ["yes"])) == 0.0
    assert one("3,5", lambda c: vf.numeric(c, 3.5)) == 1.0
    assert one("about 3 or 4", lambda c: vf.numeric(c, 4, embedded=0.25)) == 0.25
    assert one("abc", lambda c: vf.chrf(c, ["abc"])) == 1.0 and one("", lambda c: vf.chrf(c, ["abc"])) == 0.0
    assert one('```json\n{"A": "X", "b": 2}\n```', lambda c: vf.json_fields(c, {"a": ["x"], "b": [3]})) == 0.5
    assert one("max([1, 2]) + 3", lambda c: vf.python_value(c, [5])) == 1.0
    assert one("__import__('os')", lambda c: vf.python_value(c, [5])) == 0.0
    assert one("x\n```py\ncode\n```", lambda c: vf.fenced_code(c, "py")) == "code\n"


def test_jsonl_shards(spark, tmp_path):
    from lodestone.sources import jsonl

    d = spark.range(500).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    path = str(tmp_path / "out")
    jsonl.write_shards(d, path, "id", max_bytes=3000)
    files = sorted(p.name for p in (tmp_path / "out").rglob("data_*.jsonl.gz"))
    assert len(files) > 3 and files[0] == "data_0001.jsonl.gz"
    back = jsonl.read_shards(spark, path, "id bigint, t string")
    assert sorted(back.collect()) == sorted(d.collect())
    assert jsonl.read_shards(spark, path, "id bigint, t string", skip_ratio=0.5).count() < 300


def test_jsonl_shards_keep_all_ranges(spark, tmp_path):
    """Ranges that adaptive execution joins otherwise in each run of their exchange."""
    from lodestone.sources import jsonl

    d = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("t"))
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        jsonl.write_shards(d, str(tmp_path / "out"), "id", max_bytes=50_000)
    finally:
        for k in keys:
            spark.conf.unset(k)
    back = jsonl.read_shards(spark, str(tmp_path / "out"), "id bigint, t string").collect()
    assert sorted(back) == sorted(d.collect())


def test_stream_resumes(spark, tmp_path):
    from lodestone.streaming import ingest

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.range(10).write.json(src)
    schema = spark.range(1).schema
    ingest.resume(spark, src, schema, out, ck)
    ingest.resume(spark, src, schema, out, ck)
    assert spark.read.parquet(out).count() == 10
    spark.range(10, 15).write.mode("append").json(src)
    ingest.resume(spark, src, schema, out, ck)
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == list(range(15))


def test_arithmetic_and_lookup(spark):
    d = spark.createDataFrame([("r", "number0 plus number1", [3.0, 4.0], ["+", "number0", "number1"])], "record_id string, question string, numbers array<double>, equation array<string>")
    got = tr.arithmetic_templates(d).collect()
    assert len(got) == 3 and len({r["prompt"] for r in got}) == 3
    for r in got:
        a, b = (int(x) for x in r["prompt"].split(" plus "))
        assert int(r["completion"]) == a + b
    assert tr.arithmetic_templates(d).collect() == got
    e = spark.createDataFrame([("r", "Take 5 from 12", "12 - 5 = 7 #### 7"), ("bad", "5 and 5", "5 + 5 = 10 #### 10")], "record_id string, question string, answer string")
    rows = tr.equation_answers(e).collect()
    assert rows and all(r["record_id"].startswith("r.") for r in rows)
    look = spark.createDataFrame([("r", "alpha beta gamma delta epsilon"), ("few", "alpha beta"), ("none", None)], "record_id string, text string")
    assert sorted(r["record_id"] for r in tr.lookup_retrieval(look).collect()) == ["r.lookup-backward", "r.lookup-forward"]


def test_tokenizer(spark):
    import os

    from lodestone.operators import tokenizer as tk

    path = "/opt/tokenizers/word_bpe_49k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary files")
    text = open(path).read()
    d = spark.createDataFrame([("hello world",), (None,)], "t string")
    n = [r[0] for r in d.select(tk.token_count(F.col("t"), text)).collect()]
    assert n[0] >= 1 and n[1] == 0
    assert tk.vocabulary(spark, text).count() > 1000


def test_chat_opening_and_styles(spark):
    from lodestone.functions import chat

    assert chat.opening() == "[:final:]" and chat.opening("task") == "[:task:]"
    assert chat.opening("format", task="t", verbosity="v") == "[:task:]t[:verbosity:]v[:format:]"
    assert chat.opening("scratchpad", format="f") == "[:format:]f[:scratchpad:]"
    for bad in ({"last": "task", "format": "f"}, {"last": "final", "task": ""}, {"last": "end"}):
        with pytest.raises(ValueError):
            chat.opening(**bad)
    row = spark.createDataFrame([("s", [("u", "a")], "now", "w")], "s string, h array<struct<user:string,assistant:string>>, c string, w string")
    for style, want in {
        "normalized": ("[:system:]s[:eot:][:user:]u[:eot:][:assistant:][:final:]a[:eot:][:user:]now[:eot:][:assistant:][:final:]", "[:task:]t[:scratchpad:]w[:final:]now[:eot:]"),
        "legacy": ("[:system:]s[:eot:][:user:]u[:eot:][:assistant:]a[:eot:][:user:]now[:eot:][:assistant:]", "[:task:]t<think>w</think>now[:eot:]"),
        "plain": ("s\n\nu\na\n\nnow", "<think>w</think>now"),
    }.items():
        got = row.select(chat.prompt(chat.prompt_blocks(F.col("s"), F.col("h"), F.col("c"), style)), chat.completion(F.col("c"), task=F.lit("t"), scratchpad=F.col("w"), style=style)).first()
        assert tuple(got) == want, style


def test_chat_parse(spark):
    from lodestone.functions import chat

    cases = {
        " [:task:]t[:format:]b[:verbosity:]c[:final:]d[:eot:]x": ("d", "t", None, "b[:verbosity:]c", None),
        "[:scratchpad:]w[:final:]d": ("d", None, None, None, "w"),
        "[:task:][:final:]d": ("d", None, None, None, None),
        "[:task:]t": ("[:task:]t", None, None, None, None),
        "[:task:]t[:scratchpad:]w": ("[:task:]t[:scratchpad:]w", None, None, None, None),
        "x [:final:]d ": ("x [:final:]d", None, None, None, None),
        "[:final:]a\n[:final:]b": ("a\n[:final:]b", None, None, None, None),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", chat.parse_completion(F.col("t")).alias("p")).collect()
    assert {r["t"]: (r["p"]["final"], r["p"]["task"], r["p"]["verbosity"], r["p"]["format"], r["p"]["scratchpad"]) for r in rows} == cases
    forced = spark.createDataFrame([("d",)], "t string").select(chat.parse_completion(F.col("t"), start=chat.opening("final", task="t")).alias("p")).first()["p"]
    assert (forced["final"], forced["task"]) == ("d", "t")


def test_chat_fit_and_masks(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from lodestone.functions import chat

    row = spark.createDataFrame([("abcdefgh", [("u1", "a1"), ("u2", "a2")])], "c string, h array<struct<user:string,assistant:string>>")
    none = F.lit(None).cast("string")
    fit = lambda n: row.select(chat.fit(none, F.col("h"), F.col("c"), n, "plain").alias("f")).first()["f"]
    assert (fit(100)["text"], fit(100)["turns"]) == ("u1\na1\n\nu2\na2\n\nabcdefgh", 2)
    assert (fit(15)["text"], fit(15)["turns"], fit(15)["cut"]) == ("u2\na2\n\nabcdefgh", 1, False)
    assert (fit(5)["text"], fit(5)["cut"]) == (chat.CUT_NOTICE + "defgh", True)
    words = {w: i for i, w in enumerate(["[UNK]", "a", "b", "c", "d", "[", ":", "]", "task", "final"])}
    t = Tokenizer(models.WordLevel(words, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    spans = F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("stop")))
    got = spark.createDataFrame([("a b c d",)], "t string").select(chat.label_masks(F.col("t"), spans, t.to_str()).alias("m")).first()["m"]
    assert (got["ids"], got["mask"]) == ([1, 2, 3, 4], [0.0, 1.0, 1.0, 0.0])
    cut = spark.createDataFrame([("a b c d", [("a", "b")])], "c string, h array<struct<user:string,assistant:string>>")
    got = cut.select(chat.fit_tokens(none, F.col("h"), F.col("c"), 3, t.to_str(), "plain").alias("f")).first()["f"]
    assert (got["text"], got["n_tokens"], got["cut"]) == (chat.CUT_NOTICE + "b c d", 3, True)
    spans = spark.createDataFrame([("[:task:]t x[:format:]f[:final:]d",)], "t string").select(chat.route_spans(F.col("t")).alias("s")).first()["s"]
    assert [(s["name"], s["start"], s["stop"]) for s in spans] == [("task", 8, 11), ("format", 21, 22)]


def test_formats(spark):
    from lodestone.functions import formats as fm

    got = spark.createDataFrame([(1234567, 2, 3)], "a int, b int, c int").select(fm.grouped_int(F.col("a")), fm.grouped_float(F.col("a") / 100), fm.percent(F.lit(None).cast("double")), fm.percent(F.lit(12.345)), fm.percent_of(F.col("b"), F.col("c")), fm.percent_of(F.col("b"), F.lit(0)), fm.metric(F.col("a"), F.col("a")), fm.iso_utc(F.lit(" 1704067200.123999 ")), fm.iso_utc(F.lit("no"))).first()
    assert tuple(got) == ("1,234,567", "12,345.67", "n/a", "12.35%", "66.67%", "n/a", "1_234_567 (100.00%)", "2024-01-01T00:00:00.123+00:00", None)


def test_threads(spark):
    from lodestone.operators.threads import thread_log

    e = [("t", 1, "append", "system", " "), ("t", 2, "replace", None, "r0"), ("t", 3, "append", "user", "u"), ("t", 4, "append", "assistant", "a"), ("t", 5, "append", "user", "v"), ("t", 6, "replace", None, "b"), (" z ", 1, "append", "system", " s ")]
    rows = thread_log(spark.createDataFrame([(*x, "0") for x in e], "thread string, seq int, op string, role string, content string, at string")).collect()
    assert sorted((r["thread"], r["place"], r["role"], r["content"]) for r in rows) == [("t", 1, "assistant", "r0"), ("t", 2, "user", "u"), ("t", 3, "assistant", "b"), ("t", 4, "user", "v"), ("z", 1, "system", "s")]


def test_presets_and_manifests(spark, tmp_path):
    import dataclasses

    from lodestone.operators import presets

    @dataclasses.dataclass(frozen=True)
    class Preset:
        uid: str
        name: str
        split: str = ""

    some = [Preset("a", "Alpha"), Preset("b", "Beta")]
    aliases = lambda p: (p.name, p.uid)
    assert presets.find(some, " ALPHA, b", aliases) == some
    with pytest.raises(ValueError):
        presets.find(some, "a,x", aliases)
    assert presets.by_split(some[0], {"train": "t", " test": "e"}) == [Preset("a-t", "Alpha-train", "train"), Preset("a-e", "Alpha-test", "test")]
    for bad in ({}, {"x": ""}, {"x": "a", "y": "a"}, {"x": "a", " x": "b"}):
        with pytest.raises(ValueError):
            presets.by_split(some[0], bad)
    assert presets.migrated({"version": 2, "configuration": {"k": 1}}) == {"version": 6, "configuration": {"k": 1}}
    assert presets.migrated({"configuration": {"task": {"wrapper_class": "Other"}}}) == {"version": 6, "configuration": {"task": {"wrapper_class": "Other"}}}
    spark.range(3).repartition(2).write.parquet(str(tmp_path / "default" / "train"))
    files = presets.catalogue(spark, str(tmp_path))
    assert len(presets.resolve(files, "train")) == 2
    with pytest.raises(ValueError):
        presets.resolve(files, "test")
