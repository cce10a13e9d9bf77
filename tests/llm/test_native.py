"""Decontamination, line dedup and chat formatting on small tables, with the
defined results of odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, decontam, linededup

DOC = "doc_id bigint, text string, key string, first string"


@pytest.fixture(autouse=True)
def small_tables(monkeypatch):
    """Few buckets, as for few words; any number gives the same lines."""
    monkeypatch.setattr(linededup, "BUCKET_BITS", 12)


def op5_words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]


def brute_contamination(docs, items):
    out = {}
    for i, t in docs:
        w, hit, found = op5_words(t), set(), set()
        for item, b in items:
            b = op5_words(b)
            for s in range(max(len(b) - 10, 0) + 1) if b else ():
                g = b[s : s + 10]
                for at in range(len(w) - len(g) + 1):
                    if w[at : at + len(g)] == g:
                        hit |= set(range(at, at + len(g)))
                        found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(12)] + ["Été", "naïve", "THE"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(10, say(14)), (9, say(10)), (2, "Été the"), (3, "..."), (4, None), (5, say(11))]
    docs = [(i, say(rng.randrange(0, 40))) for i in range(40)]
    docs += [(100, f"x {items[0][1].upper()} y. {items[1][1]}"), (101, None), (102, ""), (103, "?!"), (104, items[0][1] + " " + items[0][1])]
    d = spark.createDataFrame([(i, t, "k", "f") for i, t in docs], DOC)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontam.contamination(d, b).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows}
    assert len(rows) == len(docs) and got == brute_contamination(docs, items)
    kept = decontam.decontaminate(d, b)
    assert kept.columns == d.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {i for i, v in got.items() if not v[4]}


def test_contamination_empty_and_repeated(spark):
    d = spark.createDataFrame([(1, "a b", "", ""), (1, "a b", "", ""), (None, "a b", "", "")], DOC)
    b = spark.createDataFrame([(1, "a b"), (None, "a")], "item_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"]) for r in decontam.contamination(d, b).collect()), key=str)
    assert got == [(1, 2, 2), (None, 2, 2)]
    assert decontam.contamination(d.limit(0), b).count() == 0
    assert decontam.contamination(d, b.limit(0)).where("contaminated").count() == 0


def test_contamination_two_texts_of_one_item(spark):
    """Both texts are whole in the corpus; their windows have one number."""
    a, b = (" ".join(f"{c}{i}" for i in range(12)) for c in "pq")
    items = [(1, a), (1, b), (2, "z y x")]
    docs = [(10, f"u {a} v"), (11, b), (12, a[:20]), (13, "z y x"), (14, f"{a} {b}")]
    d = spark.createDataFrame([(i, t, "k", "f") for i, t in docs], DOC)
    rows = decontam.contamination(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows}
    assert got == brute_contamination(docs, items) and got[11][1] == 12


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a1 b2 c3", "", ""), (2, "a1 x b2 y c3", "", ""), (3, "c3 " + "z " * 30 + "a1 b2", "", "")], DOC)
    b = spark.createDataFrame([(7, "a1 b2 c3")], "item_id bigint, text string")
    got = {r["doc_id"]: r["off_by"] for r in decontam.proximity(decontam.build_index(d, b), slop=4).collect()}
    assert got == {1: 0, 2: 3}


def brute_lines(docs):
    sets = []
    for i, t in sorted(docs, key=lambda x: x[0]):
        for no, line in enumerate(t.split("\n") if t is not None else []):
            sets.append((i, no, frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))))
    gone = set()
    for k, (i, no, s) in enumerate(sets):
        if s and any(o and 7 * len(s & o) >= 3 * (len(s) + len(o)) for _, _, o in sets[:k]):
            gone.add((i, no))
    return {i: None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone) for i, t in docs}


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    base = [[f"v{rng.randrange(300)}" for _ in range(rng.randrange(1, 60))] for _ in range(25)]

    def line():
        w = list(rng.choice(base))
        if rng.random() < 0.6:
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
        return " ".join(w)

    docs = [(i, "\n".join(line() for _ in range(rng.randrange(0, 6)))) for i in range(60)] + [(70, None), (71, ""), (72, "\n \n"), (73, " a\tb "), (74, "a b")]
    d = spark.createDataFrame([(i, t, "k", "f") for i, t in docs], DOC)
    out = linededup.dedup_lines(d, counts=True)
    rows = out.collect()
    assert out.columns[:4] == d.columns and len(rows) == len(docs)
    assert {r["doc_id"]: r["text"] for r in rows} == brute_lines(docs)
    assert {r["doc_id"]: r["n_lines"] for r in rows}[70] == 0


@pytest.mark.parametrize("hot, part, neighbours", [(512, 100_000, 2), (8, 4, 1), (1, 1, 1)])
def test_lines_in_any_order(spark, monkeypatch, hot, part, neighbours):
    """Lists of frequent words, cut ones and few neighbours lose nothing; one
    changed word in a short line, and many lines that share a passage."""
    monkeypatch.setattr(linededup, "HOT", hot)
    monkeypatch.setattr(linededup, "PART", part)
    monkeypatch.setattr(linededup, "NEIGHBOURS", neighbours)
    rng = random.Random(4)
    base = [[f"v{rng.randrange(200)}" for _ in range(rng.randrange(1, 25))] for _ in range(30)]

    def line():
        w = list(rng.choice(base))
        if rng.random() < 0.7:
            w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
        return rng.choice([" ", "\t ", "\x0b"]).join(w)

    shared = " ".join(f"s{i}" for i in range(20))
    docs = [(i, "\n".join(line() for _ in range(rng.randrange(0, 6)))) for i in range(60)]
    docs += [(70, "Tolyoued with by of nteres atre are."), (71, "Anat with by of nteres atre are."), (72, "\n \n")]
    docs += [(100 + i, f"{shared} " + " ".join(f"d{i}_{k}" for k in range(i % 9 + 1))) for i in range(40)]
    d = spark.createDataFrame([(i, t, "", "") for i, t in docs], DOC)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(d).collect()}
    assert got == brute_lines(docs) and got[71] == ""


def test_alike_lines_make_few_pairs(spark, monkeypatch):
    """A group of near copies in short lists is not paired in full."""
    made, settle = {}, linededup.settle

    def counted(df, name="t"):
        out = settle(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(linededup, "settle", counted)
    common = " ".join(f"w{k}" for k in range(20))
    d = spark.createDataFrame([(i, f"{common} only{i}") for i in range(200)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(d).collect()}
    assert got[0] == f"{common} only0" and all(got[i] == "" for i in range(1, 200))
    assert made["pairs"] < 1000


def test_lines_of_a_long_document(spark):
    """Many lines in one text, half of them removed; none takes the others'
    time."""
    lines = [f"a{i // 2} b{i // 2} c{i // 2}" for i in range(60_000)]
    d = spark.createDataFrame([(1, "\n".join(lines), "", ""), (2, "\n".join(lines[:3]), "", "")], DOC)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(d).collect()}
    assert got[1] == "\n".join(lines[::2]) and got[2] == ""


def test_lines_are_read_once(spark, monkeypatch):
    """No filter that Spark infers splits the texts a second time, and only
    lists of frequent words are counted."""
    made, settle = {}, linededup.settle

    def kept(df, name="t"):
        made[name] = settle(df, name)
        return made[name]

    monkeypatch.setattr(linededup, "settle", kept)
    d = spark.createDataFrame([(i, 0, f"a b{i} c\nx y z{i}") for i in range(40)], "doc_id bigint, copy bigint, text string")
    plan = linededup._sets(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and "size(split" not in plan
    linededup.similar_lines(d)
    assert sum(made["sizes"].first()[0]) == 0


def test_ranks_count_words_at_any_white_space(spark):
    """A word beside a tab or a line feed is as frequent as any other."""
    d = spark.createDataFrame([(1, "w\tw\nw w\rw\x0bw\nw w")], "doc_id bigint, text string")
    ranks = linededup._ranks(d).first()[0]
    assert sorted(ranks)[-1] == linededup.STEPS * 3 and sum(ranks) == linededup.STEPS * 3


def test_lines_of_other_lengths(spark, monkeypatch):
    """Of two lines the shorter is found by its shorter prefix, first or
    second, just at the bound and just beyond it, without help of neighbours."""
    monkeypatch.setattr(linededup, "HEAD", 0)
    cases = [(3, 4, 3), (4, 3, 3), (8, 6, 6), (6, 8, 6), (7, 7, 6), (7, 7, 5), (6, 9, 6), (80, 60, 60), (60, 80, 60), (81, 60, 60), (70, 70, 60), (70, 70, 59)]
    line = lambda k, c, n, shared: " ".join([f"s{k}_{i}" for i in range(shared)] + [f"{c}{k}_{i}" for i in range(n - shared)])
    docs = [(10 * k + j, line(k, "ab"[j], (n, m)[j], shared)) for k, (n, m, shared) in enumerate(cases) for j in (0, 1)]
    # Shared words are frequent, and the lists of the others come first.
    docs += [(1000 + 100 * k + i, f"s{k}_{i} " + " ".join(f"o{k}_{i}_{j}" for j in range(9))) for k, c in enumerate(cases) for i in range(c[2])]
    d = spark.createDataFrame([(i, t, "", "") for i, t in docs], DOC)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(d).collect()}
    assert got == brute_lines(docs)
    assert [got[10 * k + 1] == "" for k in range(len(cases))] == [7 * c[2] >= 3 * (c[0] + c[1]) for c in cases]


def test_lines_repeated_rows_and_empty_table(spark):
    d = spark.createDataFrame([(1, "x y z\nx y z", "", ""), (1, "x y z\nx y z", "", "")], DOC)
    assert [r["text"] for r in linededup.dedup_lines(d).collect()] == ["x y z", "x y z"]
    assert linededup.dedup_lines(d.limit(0)).count() == 0


CONV = "conv_id bigint, turn bigint, role string, text string, extra int"
SCHEMA = '{"required":["city"],"properties":{"city":{"type":"string"},"days":{"type":"integer"}}}'


def formatted(spark, rows, **k):
    schemas = spark.createDataFrame([("weather", SCHEMA), ("respond", chat.RESPOND)], "name string, schema string")
    return chat.format_chat(spark.createDataFrame(rows, CONV), schemas, **k).orderBy("turn", "place").collect()


def test_tool_calls(spark):
    calls = '{"tool_calls":[{"id":"b","name":"weather","arguments":{"days":2,"city":"Oslo"},"depends_on":["a"]},{"id":"a","name":"weather","arguments":"{\\"days\\":\\"x\\"}"},{"id":"c","name":"nope","arguments":{}}]}'
    rows = [(1, 0, "user", "hi", 0), (1, 1, "assistant", calls, 0), (1, 2, "tool", '{"tool_call_id":"b","content":"sun"}', 0), (1, 3, "tool", '{"tool_call_id":"zz","content":{"b":1,"a":2}}', 0), (1, 4, "tool", '{"tool_call_id":"b","content":"again"}', 0), (1, 5, "assistant", "{not json", 0)]
    got = formatted(spark, rows, plain="message")
    by = {(r["turn"], r["place"]): r for r in got}
    assert len(got) == 8
    b, a, c = (by[1, k] for k in range(3))
    assert (b["linked"], b["level"], b["valid"]) == (True, 1, True)
    assert b["json"] == '{"arguments":{"city":"Oslo","days":2},"id":"b","name":"weather","result":"sun","role":"assistant"}'
    assert (a["linked"], a["level"], a["valid"], a["problems"]) == (False, 0, False, "missing city; not integer: days")
    assert (c["valid"], c["problems"]) == (False, "unknown function")
    assert by[2, 0]["linked"] and not by[3, 0]["linked"] and not by[4, 0]["linked"]
    assert by[3, 0]["json"] == '{"content":"{\\"a\\":2,\\"b\\":1}","id":"zz","role":"tool"}'
    assert by[5, 0]["kind"] == "message"


def test_call_cycle_and_chain(spark):
    def call(i, *after):
        return '{"id":"%s","name":"weather","arguments":{"city":"x"},"depends_on":[%s]}' % (i, ",".join(f'"{a}"' for a in after))

    text = '{"tool_calls":[' + ",".join([call("a"), call("b", "a"), call("c", "b", "a"), call("x", "y"), call("y", "x")]) + "]}"
    got = {r["call_id"]: r["level"] for r in formatted(spark, [(1, 0, "assistant", text, 0)])}
    assert got == {"a": 0, "b": 1, "c": 2, "x": None, "y": None}


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None, 0), (None, 0, "user", "x", 0), (1, 1, "user", None, 0), (1, 1, "user", "twice", 0), (2, 0, "assistant", "", 0)]
    assert len(formatted(spark, rows)) == len(rows)
    assert chat.format_chat(spark.createDataFrame([], CONV)).count() == 0


@pytest.mark.parametrize("f", [decontam.contamination])
def test_no_python_in_plans(spark, f):
    d = spark.createDataFrame([(1, "a b", "", "")], DOC)
    b = spark.range(1).select(F.col("id").alias("item_id"), F.lit("a b").alias("text"))
    plan = f(d, b)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


