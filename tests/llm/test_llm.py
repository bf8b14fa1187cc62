"""Operators on training data against brute force and on edge cases."""

import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import queries as Q
from corpuslens.llm import text as X
from corpuslens.llm.components import connected_components
from corpuslens.llm.cross_split import OverlapConfig, cross_split_overlap, overlap_report
from corpuslens.llm.formatting_duplicates import collapsed, formatting_duplicates
from corpuslens.llm.group_split import group_split, repo_name
from corpuslens.llm.leakage import LeakConfig, leaked_items
from corpuslens.llm.near_duplicates import NearDupConfig, near_duplicates
from corpuslens.llm.quota_sample import flight, quota_sample
from corpuslens.llm.reading_level import reading_levels
from corpuslens.llm.syntax_check import by_grammar, check, check_syntax, damaged, settle, syntax_rates
from corpuslens.llm.term_frequency import marked, term_frequency
from corpuslens.llm.tokenizer import Encoder, RankQueue, default_vocabulary, encode_texts, read_ranks

RNG = random.Random(5)
VOCAB = [f"w{i}" for i in range(400)]


def variants(n, length=60, edits=3):
    """n texts in families of slightly edited copies."""
    out = []
    while len(out) < n:
        base = [RNG.choice(VOCAB) for _ in range(length)]
        for _ in range(RNG.randint(1, 4)):
            t = list(base)
            for _ in range(RNG.randint(0, edits)):
                t[RNG.randrange(len(t))] = RNG.choice(VOCAB)
            out.append(" ".join(t))
    return out[:n]


def sim(a, b, n=3):
    s, t = (set(zip(*(w[i:] for i in range(n)))) for w in (X.words(a), X.words(b)))
    return len(s & t) / len(s | t) if s and t else 0.0


# ---- 1 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates_equal_brute_force(spark, block):
    texts = variants(120) + [None, "", "one two", "x " * 3000]
    texts += [texts[0], texts[0].upper().replace(" ", ", ")]
    rows = [(f"id{i:03d}", t, texts[-i - 1], i) for i, t in enumerate(texts)] + [("id000", texts[0], texts[-1], 9), (None, texts[0], None, 1)]
    df = spark.createDataFrame(rows, "sample_id string, a string, gkey string, k int")  # clashing names
    nd = near_duplicates(df, "sample_id", ["a", "gkey"], NearDupConfig(words=3, threshold=0.7, block=block))
    got = {tuple(r) for r in nd.pairs().collect()}
    by = {f: {r[0]: r[1 if f == "a" else 2] for r in rows if r[0]} for f in ("a", "gkey")}
    want = {(f, x, y) for f, m in by.items() for x in m for y in m if x < y and sim(m[x] or "", m[y] or "") >= 0.7}
    assert got == want
    groups = {(r.code_field, r.sample_id): (r.group_id, r.n_links) for r in nd.groups().collect()}
    assert all(groups[f, x][0] == groups[f, y][0] for f, x, y in want)


def test_copies_of_a_text_stay_off_the_hot_path(spark):
    w = [f"t{i}" for i in range(80)]
    rows = [(f"c{i}", " ".join(w)) for i in range(10_000)] + [("near", " ".join([*w[:40], "other", *w[41:]]))]
    nd = near_duplicates(spark.createDataFrame(rows, "sample_id string, a string"), "sample_id", ["a"], NearDupConfig(words=3, threshold=0.7))
    assert nd.texts.count() == 2 and nd.links.count() == 1 and {r.n for r in nd.patterns.collect()} == {2}
    assert {(r.group_id, r.n_links) for r in nd.groups().collect()} == {("c0", 1)}


def test_near_duplicates_of_many_texts_with_one_boilerplate(spark):
    rng = random.Random(1)
    boiler = " ".join(f"b{i}" for i in range(60))
    rows = [(f"s{i:03d}", boiler + " " + " ".join(rng.choice(VOCAB) for _ in range(rng.choice([5, 40])))) for i in range(150)]
    nd = near_duplicates(spark.createDataFrame(rows, "sample_id string, a string"), "sample_id", ["a"], NearDupConfig(words=3, threshold=0.7, block=8))
    want = {(x, y) for x, s in rows for y, t in rows if x < y and sim(s, t) >= 0.7}
    got = {(r.id_a, r.id_b) for r in nd.pairs().collect()}
    assert got <= want and len(got) >= 0.995 * len(want) > 1000


def test_joins_of_hot_keys(spark, monkeypatch):
    from corpuslens.llm import joins

    big = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    small = spark.range(0, 3000, 7).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    want = {how: sorted(map(tuple, big.join(small, "k", how).collect()), key=str) for how in ("left", "inner", "left_semi")}
    for rows, hot in ((10, 100), (10, 10_000), (10_000, 100)):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(joins, "HOT_ROWS", hot)
        for how in want:
            assert sorted(map(tuple, joins.join_hot(big, small, "k", "row", how).select("k", "row", *(["v"] if how != "left_semi" else [])).collect()), key=str) == want[how]
    assert joins.hot_keys(big, "k").collect()[0].k == 7


def test_operators_beyond_the_broadcast_bound(spark, monkeypatch):
    from corpuslens.llm import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    test_components(spark)
    test_formatting_duplicates(spark)
    test_formatting_duplicates_of_a_hot_set(spark)
    texts = variants(60)
    df = spark.createDataFrame([(f"id{i:03d}", t) for i, t in enumerate(texts)], "sample_id string, a string")
    nd = near_duplicates(df, "sample_id", ["a"], NearDupConfig(words=3, threshold=0.7, broadcast_keys=1))
    assert {(r.id_a, r.id_b) for r in nd.pairs().collect()} == {(f"id{i:03d}", f"id{j:03d}") for i in range(60) for j in range(i + 1, 60) if sim(texts[i], texts[j]) >= 0.7}
    assert nd.groups().count() == 60


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "sample_id string, a string")
    nd = near_duplicates(df, "sample_id", ["a"])
    assert nd.pairs().count() == 0 and nd.groups().count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(50)]
    c = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert {c[i] for i in range(41)} == {0} and c[101] == 100 and {c[201 + i] for i in range(50)} == {200}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


# ---- 2, 3 ---------------------------------------------------------------------------------------------


def test_formatting_duplicates(spark):
    rows = [("a", "x = Foo(1);"), ("b", "foo ( 1 )\n X"), ("c", "x foo 1 1"), ("d", None), ("e", " ;; "), ("f", "ab"), ("g", "ba"), ("a", "x = Foo(1);"), (None, "x foo 1"), ("h", "K b"), ("i", "k b"), ("j", "b")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("k1", F.lit(1)).withColumn("digest", F.lit(2))
    assert {tuple(r) for r in formatting_duplicates(df, "id", "text").collect()} == {("a", "a", 2), ("a", "b", 2), ("h", "h", 2), ("h", "j", 2)}
    kept = {r.kept_id: r.n_copies for r in collapsed(df, "id", "text").collect()}
    assert kept["a"] == 2 and "b" not in kept and kept["d"] == 1 and len(kept) == 8
    assert formatting_duplicates(df.limit(0), "id", "text").count() == 0


def test_formatting_duplicates_of_a_hot_set(spark):
    """A third of the rows are one set, and all rows have one length."""
    rows = [(f"r{i:04d}", "a b c d" if i % 3 == 0 else f"{i:04d}") for i in range(900)]
    got = formatting_duplicates(spark.createDataFrame([(i, t if i[-1] != "3" else t.upper()) for i, t in rows], "id string, text string"), "id", "text").collect()
    assert {(r.set_id, r.n_copies) for r in got} == {("r0000", 300)} and len({r.id for r in got}) == 300


def test_term_frequency_with_a_hot_term(spark):
    rows = [(f"r{i % 70}", "Hot; rare%d" % i if i % 2 else " HOT |hot") for i in range(300)] + [("r1", None), (None, "hot"), ("r2", ";,|")]
    df = spark.createDataFrame(rows, "id string, f string").repartition(7)
    got = {r.term: (r.occurrences, r.records) for r in term_frequency(df, "id", ["f"]).collect()}
    assert got["hot"] == (450, 70) and got["rare3"] == (1, 1) and len(got) == 151
    m = {r.term: r.mark for r in marked(term_frequency(df, "id", ["f"]), df, "id").collect()}
    assert m["hot"] == "common" and m["rare3"] == "rare"
    assert term_frequency(df.limit(0), "id", ["f"]).count() == 0


# ---- 4 ------------------------------------------------------------------------------------------------


def test_cross_split_overlap_equals_brute_force(spark):
    texts = variants(160) + [None, "", "a b", "same " * 500]
    half = lambda k: [(f"{'s' if i % 9 else 'both'}{k if i % 9 else ''}{i}", texts[i], texts[(i * 7) % len(texts)] if i % 3 else None, "TEST " if i % 2 else None, "src") for i in range(len(texts)) if i % 2 == k or i % 9 == 0]
    schema = "sample_id string, a string, k string, split string, source string"
    te, tr = half(0), half(1)
    a, b = spark.createDataFrame(te, schema), spark.createDataFrame(tr, schema)
    pairs = cross_split_overlap(a, b, "sample_id", ["a", "k"], OverlapConfig(words=3, threshold=0.7))
    want = {(x[0], y[0]) for x in te for y in tr if x[0] == y[0] or any(sim(s or "", t or "") >= 0.7 for s in x[1:3] for t in y[1:3])}
    assert {(r.sample_id, r.train_id) for r in pairs.collect()} == want
    rep = overlap_report(pairs, a, "sample_id", "split", "source").collect()
    assert sum(r.records for r in rep) == len(te) and sum(r.pairs for r in rep) == len(want) and {r.split for r in rep} == {"test", "unknown"}
    assert cross_split_overlap(a.limit(0), b, "sample_id", ["a"]).count() == 0


def test_cross_split_overlap_of_boilerplate(spark):
    """A third of the rows are variants of one boilerplate, whose shingles are hot."""
    rng = random.Random(6)
    boiler = [f"b{i}" for i in range(30)]
    text = lambda i: " ".join([*boiler, *(rng.choice(VOCAB) for _ in range(rng.choice([0, 4, 12])))] if i % 3 == 0 else [rng.choice(VOCAB) for _ in range(30)])
    te, tr = ([(f"{c}{i}", text(i)) for i in range(120)] for c in "st")
    a, b = (spark.createDataFrame(x, "sample_id string, a string") for x in (te, tr))
    want = {(x, y) for x, s in te for y, t in tr if sim(s, t) >= 0.7}
    for cfg in (OverlapConfig(words=3, threshold=0.7, hot_rows=10, broadcast_keys=1), OverlapConfig(words=3, threshold=0.7)):
        got = [(r.sample_id, r.train_id) for r in cross_split_overlap(a, b, "sample_id", ["a"], cfg).collect()]
        assert set(got) == want and len(got) == len(want) > 500


def test_cross_split_overlap_of_texts_that_share_no_chunk(spark):
    rng = random.Random(11)
    te, tr = [], []
    for n in [3, 4, 8, 10, 12, 20, 30] * 40:
        w = [rng.choice(VOCAB) for _ in range(n)]
        te.append((f"s{len(te)}", " ".join(w)))
        for _ in range(3):
            u = list(w)
            for at in rng.sample([0, n - 1, rng.randrange(n)], rng.choice([1, 1, 2])):
                u[at:at] = [rng.choice(VOCAB)]
            tr.append((f"t{len(tr)}", " ".join(u)))
    te += [("same", "same " * 500), ("period", "u v w x y z " * 40), ("swap", "p q a b c p q d e f g p q")]
    tr += [("short", "same " * 10), ("shifted", "z " + "u v w x y z " * 9), ("other", "p q d e f g p q a b c p q")]
    a, b = (spark.createDataFrame(x, "sample_id string, a string") for x in (te, tr))
    want = {(x, y) for x, s in te for y, t in tr if sim(s, t) >= 0.7}
    assert {("same", "short"), ("period", "shifted"), ("swap", "other")} < want
    got = cross_split_overlap(a, b, "sample_id", ["a"], OverlapConfig(words=3, threshold=0.7)).collect()
    assert {(r.sample_id, r.train_id) for r in got} == want and min(r.overlap for r in got) == 0


# ---- 5 ------------------------------------------------------------------------------------------------


def _targets(spark):
    return spark.createDataFrame([("train", 600), ("validation", 150), ("test", 250)], "split_name string, share_permille int")


def test_group_split(spark):
    rows = [(f"s{i}", "Big/Repo.git" if i % 3 == 0 else f" r{i % 211} ", i % 2 if i % 50 else None) for i in range(3000)] + [("s0", "big/repo", 0), (None, "x", 1), ("n1", None, 1), ("n2", " ", 0)]
    df = spark.createDataFrame(rows, "sample_id string, repo string, label int")
    keys = {"repo": F.nullif(repo_name(F.col("repo")), F.lit("unknown"))}
    out = group_split(df, "sample_id", keys, "label", _targets(spark))
    got = {r.id: r for r in out.records.collect()}
    assert len(got) == 3002 and {r.status for r in got.values()} == {"new"}
    assert len({got[f"s{i}"].split_name for i in range(0, 3000, 3)}) == 1
    n = {s: sum(r.split_name == s for r in got.values()) / len(got) for s in ("train", "validation", "test")}
    assert abs(n["train"] - 0.6) < 0.03 and abs(n["test"] - 0.25) < 0.03
    # a later delivery: old components keep their split, a record that joins two of them quarantines both
    table = out.components
    names = {r.key: r.split_name for r in table.collect()}
    a = next(k for k, v in names.items() if v == "train" and "r" in k)
    b = next(k for k, v in names.items() if v == "test")
    c = next(k for k, v in names.items() if v == "validation")
    late = spark.createDataFrame([("j", a[5:], 1), ("j", b[5:], 1), ("k", c[5:], 0), ("l", "fresh", 1)], "sample_id string, repo string, label int")
    again = group_split(late, "sample_id", keys, "label", _targets(spark), previous=table)
    st = {r.id: (r.split_name, r.status) for r in again.records.collect()}
    assert st["j"] == (None, "quarantined") and st["k"] == ("validation", "kept") and st["l"][1] == "new"
    kept = {r.key: r.split_name for r in again.components.collect()}
    assert set(names) <= set(kept) and kept[c] == "validation" and kept[a] is None
    assert group_split(df.limit(0), "sample_id", keys, "label", _targets(spark)).records.count() == 0


def test_split_of_a_later_delivery(spark, sf):
    rows = Q.QUERIES["p5_increment"](spark, sf).collect()
    n = {s: sum(r.status == s for r in rows) for s in ("kept", "new", "quarantined")}
    ids = spark.read.parquet(f"{sf}/test_v2.parquet").where("sample_id is not null").select("sample_id").distinct().count()
    assert len({r.sample_id for r in rows}) == sum(n.values()) == ids and n["kept"] >= ids // 3 and n["new"] > 0 and n["quarantined"] == 0


# ---- 6 ------------------------------------------------------------------------------------------------

GOOD_C = ["int f(int a) { return a ? g(&a, 3) : -1; }", "template <typename T> class A : public B<T> { public: explicit A(int x) : B<T>(x) {} ~A(); T operator[](int i) const { return v_[i]; } private: std::vector<std::vector<T>> v_; };", "#if 0\nbroken {{{\n#endif\nstatic const char *s = \"}\";", "#define N 3\n#define CALL(x) f(x)\nint a[N] = {1, 2, CALL(3)};", "struct P { int x, y; }; struct P p = {.x = 1, .y = 2};", "namespace a::b { enum class E : int { X = 1, Y }; using T = int; }", "void f() { for (auto &x : xs) if (auto i = m.find(x); i != m.end()) { s << i->second << std::endl; } do { } while (0); switch (x) { case 1: break; default: ; } try { g(); } catch (const E &e) { throw; } }", "int (*fp)(int, char) = 0; typedef unsigned long ulong_t; extern \"C\" { int q(void); }", "auto l = [&](int i) -> int { return i << 2 >> 1; };", ";;"]
BAD_C = ["int f( { }", "int f() { return 1 }", "int f() { return 1;", "<<<<<<< HEAD\nint a;\n=======\nint b;\n>>>>>>> x", "def f(x):\n    return x", "#endif\nint a;", "int a = 'x;", "void f() { if (x) else; }", "/* open", "int f() { a b c; }", "return 1;"]
BAD_PY = ["def f(:\n  pass", "def f():\nreturn 1", "if x\n  y", "x = (1,", "int f() { return 1; }", "<<<<<<< HEAD\nx = 1\n=======\n", "print 'x'", "s = 'abc", "x = …", "f(a=1, b)"]


@pytest.mark.parametrize("code", GOOD_C)
def test_valid_c(code):
    assert check(code, " C++")[0] == "ok"


@pytest.mark.parametrize("code", BAD_C)
def test_invalid_c(code):
    assert check(code, "c")[0] in ("invalid", "truncated")


@pytest.mark.parametrize("code", BAD_PY)
def test_invalid_python(code):
    assert check(code, "Python3")[0] in ("invalid", "truncated")


@pytest.mark.parametrize("code", ['void f() { printf("x %d" n); }', 'int a = g(n "x");', 'void f() { printf("%" PRIu64 "\\n", x); }', "class A { public NAME: int x; };"])
def test_c_that_lost_a_comma(code):
    assert check(code, "c")[0] == "invalid"


@pytest.mark.parametrize("code", ['auto s = "a"_s + R"(b)"sv;', '#define T(x) L##x\nconst wchar_t *s = T("a");', '#define J(x) x##_json\nauto j = J("a");', '#define FMT "d"\nvoid f() { printf("%" FMT "\\n", 1); }', 'const char *s = "a" "b" u8"c";', "class A { public: int x; };"])
def test_c_literals_with_suffixes_and_macros(code):
    assert check(code, "c++")[0] == "ok"


REFUSED_PY = ["def f(a=1, b): pass", "def f(*): pass", "lambda a=1, b: 0", "f(**k, *a)", "f(x for x in y, 1)", "f(a for a in b, c)", "def f(*a, *b): pass", "def f(**k, a): pass", "lambda *: 0", "def f(/, a): pass", "class A(x for x in y): pass", "x = f'{a!z}'", "b'\u00e9'", "'\\x1'", "'\\N{nope}'", "f'\\x1 {a}'", "try:\n  pass\nexcept* A:\n  pass\nexcept B:\n  pass", "b'a' 'c'", "x = 1\ny = '\\x4'", "(*a)", "del *a", "[x for x in y if a := 1]", "match a:\n  case A(x=1, 2):\n    pass"]
TAKEN_PY = ["def f(a, b=1, *, c, **k): pass", "def f(a, /, b, *c, d=1, e, **k,): pass", "def f(a=1, /, b=2, *, c): pass", "lambda a, b=1, *c, d, **e: 0", "f(*a, b=1, *c, **k, d=2)", "f(x for x in y)", "x = f'{a!r:>{w}} {b=} {c!s}'", "rb'\\x' + b'\\x41'", "r'\\x'", "'\\N{BULLET} \\u1234'", "try:\n  pass\nexcept* A as e:\n  pass\nelse:\n  pass", "(a) += 1", "del (a, b), [c], d.e, f[0]", "(*a, b)", "(a := 1)", "match a:\n  case A(1, x=2) | {'a': 1, **k}:\n    pass", "def f[T: int](x: T) -> T: return x", "with (open(a) as b, open(c) as d,): pass", "x = 'a' f'{b}' r'c'"]


@pytest.mark.parametrize("code", REFUSED_PY)
def test_python_that_the_grammar_refuses(code):
    assert by_grammar(code, "python")[0] == "invalid"
    verdict, token, line = check(code, "python")
    assert verdict == "invalid" and token >= 0 and 1 <= line <= code.count("\n") + 1


@pytest.mark.parametrize("code", TAKEN_PY)
def test_python_that_the_grammar_takes(code):
    assert by_grammar(code, "python") == ("ok", None, None)


VALID_C = ["int f(a,b) int a; char b; { return a; }", "int x = _Generic(1, int: 2, default: 3);", '_Static_assert(1,"x");', "template<class... T> auto f(T... t) { return (f(t),...); }", "template<class... T> auto f(T... t) { return (t + ...) + (... + t) + (0 + ... + t); }", "__attribute__((noreturn)) void f(void);", "void f(void) __attribute__((noreturn, format(printf, 1, 2)));", "struct __attribute__((packed)) A { int a __attribute__((aligned(4))); };", "_Noreturn void f(void); static __inline__ int g(void) { return 1; }", "_Atomic int a; _Atomic(int) b; _Bool c;", "__declspec(dllexport) int f(void);", "#if 0 && 1/0\n}\n#else\nint a;\n#endif"]


@pytest.mark.parametrize("code", VALID_C)
def test_valid_c_of_other_forms(code):
    assert check(code, "c")[0] == "ok"


@pytest.mark.parametrize("code", ["int f(a,b) int a; char b;", "int x = _Generic(1);", "__attribute__((noreturn void f(void);", "int f(int a) int b; { }"])
def test_invalid_c_of_other_forms(code):
    assert check(code, "c")[0] in ("invalid", "truncated")


CONDITIONS = [("1 + 2 * 3 == 7", 1), ("(1,0)", 0), ("1 ? 0 : 1 ? 1 : 1", 0), ("0 ? 1 : 0 ? 0 : 1", 1), ("!!5 - 1", 0), ("~0 == -1", 1), ("7 / -2 == -3", 1), ("-7 % 3 == -1", 1), ("(1", 0), ("1 2", 0), ("", 0), ("1 ? 2", 0), ("010 == 8", 1), ("1 || 1/0", 1), ("1 ? 1 : 1/0", 1), ("1/0", 0), ("2 - 1 - 1", 0), ("1 << 63 < 0", 1), ("9 * * 9 * * 9", 0), ("1 << 99999999999", 0), ("defined X && (N) == 3", 1)]


@pytest.mark.parametrize("text,value", CONDITIONS)
def test_conditions(text, value):
    from corpuslens.llm.c_syntax import _Condition

    assert _Condition().value(text, {"X": "", "N": "3"}) == bool(value)


def test_texts_that_cannot_hold_up_a_worker():
    for first in ("x", ""):
        bomb = f"#define A0 {first}\n" + "".join(f"#define A{i} A{i - 1} A{i - 1}\n" for i in range(1, 60)) + "int A59;\n"
        assert check(bomb, "c") == ("unchecked", None, None)
    assert check("int a = " + "(" * 20_000 + "1" + ")" * 20_000 + ";", "c")[0] == "ok"
    assert check("int a = " + "(" * 20_000 + "1" + ")" * 19_999 + ";", "c")[0] == "invalid"
    assert check("void f() {" + "if (a) " * 3000 + ";}", "c")[0] == "ok"


def _doubled(first, use, n=60):
    return f"#define A0 {first}\n" + "".join(f"#define A{i} A{i - 1} A{i - 1}\n" for i in range(1, n)) + use


SETTLED = [
    (_doubled("x", "int A59;"), ("invalid", 2, 61)),
    (_doubled("", "int A59;"), ("ok", None, None)),
    (_doubled("1 +", "int a = A59 1;\nint b;"), ("ok", None, None)),
    (_doubled("1 +", "int a = A59 1 1;"), ("invalid", None, 61)),
    (_doubled("1 +", "int a = A25 1 1;", 26), ("invalid", 3 + 2 * 2**25 + 1, 27)),
    (_doubled("int a;", "A59 int b"), ("truncated", None, 61)),
    (_doubled("int a;", "#define F(x) x x\nF(A59)"), ("ok", None, None)),
    (_doubled("int a __attribute__((b));", "A59"), ("ok", None, None)),
    ("#define X int a;\n" + "X\n" * 110_000, ("ok", None, None)),
    ("#define X int a;\n" + "X\n" * 110_000 + "int b c;", ("invalid", 330_002, 110_002)),
    ("#define A0 1\n" + "".join(f"#define A{i} A{i - 1}\n" for i in range(1, 3000)) + "int a = A2999;", ("ok", None, None)),
]


@pytest.mark.parametrize("code,verdict", SETTLED)
def test_texts_beyond_the_bounds_are_decided(code, verdict):
    assert by_grammar(code, "c")[0] == "unchecked" and settle(code, "c") == verdict


SHARED = [
    "#define A B + B\n#define B 1\nint a = A;\n#undef B\n#define B 2 2\nint b = A;",
    "#define A B A\n#define B C A\n#define C A B C\nA; B; C;",
    "#define F(x, y) x ## y #x\n#define S L\nF(S, \"a\") F(\"a\", b) F(f(1, 2), ) F(S, S)",
    "#define D __attribute__((a(b))) int\n#define E __attribute__\n#define P ((\nD a; E((x)) int b; __attribute__ P x)) int c; __declspec(",
    "#define A 'x' '\nint a = A;",
    "#define A f(0z, B\n#define B @\nA",
]


@pytest.mark.parametrize("code", SHARED)
def test_shared_runs_are_the_tokens_written_out(code):
    from corpuslens.llm.c_syntax import tokens

    def flat(parts):
        return [t for p in parts for t in ([p] if isinstance(p, str) else flat(p.parts))]

    kinds, lines, whole = tokens(code)
    parts, starts, same = tokens(code, shared=True)
    assert flat(parts) == kinds and [n for p, n in zip(parts, starts) for _ in range(1 if isinstance(p, str) else p.size)] == lines and whole == same


@pytest.mark.parametrize("code", ["x = " + "1+" * 20_000 + "1", "x = " + "not " * 20_000 + "1", "x = " + "1" * 5000, "x = a" + ".b" * 20_000])
def test_limits_of_the_interpreter_are_no_verdict(code):
    assert check(code, "python") == ("ok", None, None)
    assert check(code + "\ny = = 1", "python")[::2] == ("invalid", 2)


def test_a_failed_check_is_no_result(spark, tmp_path):
    nest = _doubled("(", "int a = A59 1;")  # no bound is enough for it
    assert settle(nest, "c") == settle(nest, "c") == ("unchecked", None, None)
    rows = [("bad", _doubled("x", "int A59;"), "c", "r"), ("good", _doubled("", "int A59;"), "c", "r"), ("long", "#define X int a;\n" + "X\n" * 110_000, "c", "r"), ("cut", "int a", "c", "r"), ("py", "x = " + "1+" * 20_000 + "1", "py", "r")]
    columns = "sample_id string, vulnerable_code string, language string, repo string"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/a/test_v2.parquet")
    spark.createDataFrame([*rows, ("nest", nest, "c", "r"), ("nest", nest, "c++", "s")], columns).write.parquet(f"{tmp_path}/b/test_v2.parquet")
    assert {r.sample_id for r in Q.QUERIES["p6_found"](spark, f"{tmp_path}/a").collect()} == {"bad", "cut"}
    checked = spark.createDataFrame(Q.QUERIES["p6_files"](spark, f"{tmp_path}/b").withColumnRenamed("sample_id", "id").collect())
    assert {r.id: r.verdict for r in checked.collect()} == {"bad": "invalid", "good": "ok", "long": "ok", "cut": "truncated", "py": "ok", "nest": "unchecked"}
    with pytest.raises(Exception, match="syntax of record nest could not be checked"):
        damaged(checked).select("id").distinct().collect()
    rates = {(r.repo, r.language): (r.files, r.invalid, r.truncated, r.damaged_rate, r.unchecked) for r in syntax_rates(checked).collect()}
    assert rates == {("r", "c"): (4, 1, 1, 0.5, 1), ("r", "py"): (1, 0, 0, 0.0, 0), ("s", "c++"): (0, 0, 0, None, 1)}


def test_grammar_agrees_with_python_in_both_directions():
    """On the standard library and mutations of it neither a flagged text is acquitted by Python nor an accepted one refused."""
    import ast
    import sysconfig
    import warnings

    warnings.simplefilter("ignore")
    rng, seen = random.Random(3), {True: 0, False: 0}
    for p in sorted(glob.glob(os.path.join(sysconfig.get_path("stdlib"), "*.py")))[:40]:
        src = open(p, encoding="utf-8").read()
        if len(src) > 40_000:
            continue
        for n in range(5):
            at, lines = rng.randrange(len(src)), src.split("\n")
            i = rng.randrange(len(lines))
            text = [src, src[:at] + src[at + 1 :], src[:at], src[:at] + rng.choice("()[]{}:,=*.\"'+ \n") + src[at:], "\n".join(lines[:i] + lines[i + 1 :])][n]
            try:
                ast.parse(text)
                valid = True
            except SyntaxError:
                valid = False
            assert (by_grammar(text, "python")[0] == "ok") == valid, (p, n, at, i)
            seen[valid] += 1
    assert min(seen.values()) > 40


def test_syntax_positions_and_rates(spark):
    assert check("int f() { return 1;", "c") == ("truncated", 8, 1)
    assert check("int a;\nint b c;", "c") == ("invalid", 5, 2)
    assert check("(" * 3000, "python")[0] in ("invalid", "truncated")
    rows = [("a", "int a;", "C", "R.git"), ("b", "int a", "c ", "r"), ("c", None, "c", "r"), ("d", " ", "py", "r"), ("e", "x", "Rust", None), ("a", "int a;", "C", "R.git"), ("f", "x = 1", None, None)]
    df = spark.createDataFrame(rows, "sample_id string, code string, language string, repo string").withColumn("verdict", F.lit("x"))
    got = {r.id: r.verdict for r in check_syntax(df, "sample_id", "code", "language", repo_name(F.col("repo"))).collect()}
    assert got == {"a": "ok", "b": "truncated", "c": None, "d": None, "e": None, "f": None}
    r = syntax_rates(check_syntax(df, "sample_id", "code", "language", repo_name(F.col("repo")))).collect()
    assert [(x.repo, x.language, x.files, x.truncated, x.damaged_rate) for x in r] == [("r", "c", 2, 1, 0.5)]
    assert check_syntax(df.limit(0), "sample_id", "code", "language").count() == 0


# ---- 7 ------------------------------------------------------------------------------------------------


def test_flight_keeps_category_sums():
    rng = np.random.default_rng(0)
    p, c = rng.random(500), rng.integers(0, 7, 500)
    q = flight(p, c, rng)
    assert ((q > 0) & (q < 1)).sum() <= 7
    for k in range(7):
        assert q[c == k].sum() == pytest.approx(p[c == k].sum())


def test_quota_sample_meets_targets(spark):
    rows = [(f"s{i}", " a " if i % 3 == 0 else "b" if i % 3 == 1 else None, i % 2) for i in range(2000)] + [("s0", "a", 0), (None, "a", 1)]
    df = spark.createDataFrame(rows, "id string, cls string, label int").withColumn("category", F.lit(1)).withColumn("p", F.lit(1))
    t = spark.createDataFrame([("A", 0, 500, 1), ("A", 1, 100, 80), ("B", 0, 300, 400), ("Z", 1, 100, None)], "cls string, label int, share int, least int")
    q = quota_sample(df, "id", {"cls": F.upper(F.trim("cls")), "label": F.col("label")}, t, "share", "least", 400, part_rows=100, fan=3)
    rep = {(r.cls, r.label): r for r in q.report.collect()}
    assert {k: (r.wanted, r.taken, r.residual) for k, r in rep.items()} == {("A", 0): (200, 200, 0), ("A", 1): (80, 80, 0), ("B", 0): (400, 333, 0), ("Z", 1): (40, 0, 0)}
    assert {k for k, r in rep.items() if r.unmet} == {("B", 0), ("Z", 1)}
    ids = [r.id for r in q.sample.collect()]
    assert len(ids) == len(set(ids)) == 613
    assert quota_sample(df.limit(0), "id", {"cls": F.col("cls"), "label": F.col("label")}, t, "share", "least", 0).sample.count() == 0


# ---- 8 ------------------------------------------------------------------------------------------------

ODD = [None, "", " ", "a", "<|endoftext|> x", "I'll  we've\n\n\t x\r\n", "x" * 3000, "ab" * 2000, "\x1c\x1d y​　z", "Größe 漢字かな 123456789 \U0001f600\U0001f468‍\U0001f469", "0x1F !!??--==>> __init__"]


def test_encoder_equals_public_tokenizers():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    data = open(default_vocabulary(), "rb").read()
    mine = Encoder(read_ranks(data))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(data), special_tokens={})
    chars = "ab \n\t'sé漢0_-." + " "
    texts = ODD + ["".join(RNG.choice(chars) for _ in range(RNG.randint(1, 60))) for _ in range(500)]
    for t in texts:
        assert mine.encode(t) == (theirs.encode_ordinary(t) if t else [])
        assert theirs.decode(mine.encode(t)) == (t or "")


def test_rank_queue_order():
    q, items = RankQueue(), [(RNG.randrange(64**3), RNG.randrange(100)) for _ in range(500)]
    for r, p in items:
        q.push(r, p)
    assert [q.pop() for _ in items] == sorted(items) and q.pop() is None


def test_encode_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in encode_texts(df, "doc_id", "text").collect()}
    assert len(got) == len(ODD) and got[0] == [] and got[1] == [] and len(got[6]) > 1
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


# ---- 9 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_words", [200_000, 100])
def test_leaks_equal_brute_force(spark, block_words):
    items = [(i, " ".join(RNG.choice(VOCAB) for _ in range(RNG.choice([8, 12, 40])))) for i in range(30)] + [(98, None), (99, "")]
    docs = []
    for i in range(80):
        w = [RNG.choice(VOCAB) for _ in range(RNG.choice([5, 100]))]
        src = RNG.choice(items[:30])[1].split()
        n = RNG.choice([5, 11, 12, 13, len(src)])
        a = RNG.randrange(max(1, len(src) - n + 1))
        docs.append((i, (" ".join(w[:50]) + " .. " + ", ".join(src[a : a + n]).upper() + "\n" + " ".join(w[50:]))))
    docs += [(900, None), (901, ""), (0, docs[0][1])]
    grams = lambda t: {tuple(X.words(t)[i : i + 12]) for i in range(len(X.words(t)) - 11)}
    want = {(i, d) for i, t in items for d, u in docs if grams(t) & grams(u)}
    a, b = spark.createDataFrame(items, "item_id long, t string"), spark.createDataFrame(docs, "doc_id long, t string")
    for rest in (True, False):
        out = leaked_items(a, "item_id", "t", b, "doc_id", "t", LeakConfig(words=3, block_words=block_words, rest=rest))
        assert {(r.item_id, r.doc_id) for r in out.where("exact").collect()} == want
    assert leaked_items(a.limit(0), "item_id", "t", b, "doc_id", "t").count() == 0


@pytest.mark.parametrize("hits", [500_000, 50])
def test_similar_windows_equal_brute_force(spark, hits):
    weighted = lambda ws: {tuple(ws[i : i + 3]): sum(map(len, ws[i : i + 3])) for i in range(len(ws) - 2)}

    def alike(a, b):
        both = sum(w for s, w in a.items() if s in b)
        return both / (sum(a.values()) + sum(b.values()) - both)

    rng = random.Random(3)
    vocab = [c * rng.randint(1, 12) for c in "abcdefghijklmnopqrstuvwxyz"]
    items = [[rng.choice(vocab[: rng.choice([4, 26])]) for _ in range(rng.choice([11, 12, 13, 30, 60]))] for _ in range(25)] + [["x"] * 20]
    docs = [["x"] * 14, [], items[3][:11]]
    for i in range(60):
        w = list(items[i % len(items)])
        for _ in range(rng.choice([0, 1, 3])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = [rng.choice(vocab)] * rng.choice([0, 1])
        pad = rng.choice([0, 0, 30])
        docs.append([rng.choice(vocab) for _ in range(pad)] + w + [rng.choice(vocab) for _ in range(pad)])
    want = {}
    for i, t in enumerate(items):
        for d, u in enumerate(docs):
            if min(len(t), len(u)) >= 12:
                pairs = [alike(weighted(t[y : y + 12]), weighted(u[x : x + 12])) for y in range(len(t) - 11) for x in range(len(u) - 11)]
                whole = [alike(weighted(t), weighted(u[x : x + len(t)])) for x in range(max(1, len(u) - len(t) + 1))]
                n = [sum(s >= 0.8 - 1e-12 for s in x) for x in (pairs, whole)]
                if any(n):
                    want[i, d] = (n[0], n[1], round(max(pairs + whole), 9))
    a = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, t string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, t string")
    out = leaked_items(a, "item_id", "t", b, "doc_id", "t", LeakConfig(words=3, hits=hits)).collect()
    assert {(r.item_id, r.doc_id): (r.window_pairs, r.item_windows, round(r.similarity, 9)) for r in out} == want
    near = leaked_items(a, "item_id", "t", b, "doc_id", "t", LeakConfig(words=3, hits=hits, rest=False, block_words=300)).collect()
    assert all(r.window_pairs == r.fingerprint_pairs <= want[r.item_id, r.doc_id][0] for r in near)
    assert {(r.item_id, r.doc_id): r.fingerprint_pairs for r in out if r.fingerprint_pairs} == {(r.item_id, r.doc_id): r.window_pairs for r in near}
    twice = a.union(spark.createDataFrame([(3, " ".join(items[4]))], "item_id long, t string"))
    both = {r.doc_id: r.window_pairs for r in leaked_items(twice, "item_id", "t", b, "doc_id", "t", LeakConfig(words=3)).where("item_id = 3").collect()}
    assert both == {d: n for d in both if (n := want.get((3, d), (0,))[0] + want.get((4, d), (0,))[0]) or d in both}


def test_fingerprints_within_the_radius():
    from corpuslens.llm.leakage import RADIUS, ItemIndex

    rng = np.random.default_rng(4)
    index = ItemIndex([" ".join(RNG.choice(VOCAB) for _ in range(400))], LeakConfig(words=3))
    asked = index.fp[:50].copy()
    for i in range(50):
        for bit in rng.choice(64, i % 10, replace=False):
            asked[i] ^= np.uint64(1) << np.uint64(bit)
    got = set(zip(*(x.tolist() for x in index.within_radius(asked))))
    want = {(i, int(index.windows[j])) for i in range(50) for j in range(len(index.fp)) if int(asked[i] ^ index.fp[j]).bit_count() <= RADIUS}
    assert got == want and len(got) >= 40


# ---- 10 -----------------------------------------------------------------------------------------------


def test_reading_levels_order_and_edges(spark):
    easy = "The cat sat. The dog ran. We see the sun. It is big."
    hard = "Notwithstanding the heterogeneous characterization of probabilistic infrastructure, practitioners inevitably necessitate comprehensive documentation regarding interoperability considerations and organizational responsibilities."
    rows = [(1, easy), (2, hard), (3, None), (4, ""), (5, " \n"), (6, "```\ncode();\n```"), (7, "a" * 200_000), (8, "版本会崩溃。请运行。"), (9, "a_" * 50_000), (10, "Title\n\nA line of text\nthat goes on.\n- item\n* item\u00a0two.\u3000End."), (11, "x" * 90 + "Y " + "word" * 30 + ".")]
    got = {r.doc_id: r for r in reading_levels(spark.createDataFrame(rows, "doc_id long, text string").withColumn("han", F.lit(1)), "doc_id", "text").collect()}
    assert got[1].level == 1 and got[2].level == 5 and got[1].n_sentences == 4
    assert all((got[i].level, got[i].grade, got[i].n_words) == (1, 0.0, 0) for i in (3, 4, 5, 6, 9))
    assert got[8].n_words > 0 and got[7].n_words == 1 and got[10].n_sentences == 5 and got[11].n_words == 1
    assert reading_levels(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_levels_follow_ratings(spark, sf):
    agree = Q.QUERIES["p10_ratings"](spark, sf.replace("sf0.001", "sf0.01")).collect()
    n = sum(r.documents for r in agree)
    assert sum(r.documents for r in agree if abs(r.rated - r.level) <= 1) / n > 0.95


# ---- queries ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = Q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    r = c.execute(Q.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert sorted(tuple(map(str, x)) for x in df.select(*cols).collect()) == sorted(tuple(str(x[names.index(k)]) for k in cols) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_runs(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    assert df.count() == df.distinct().count()
