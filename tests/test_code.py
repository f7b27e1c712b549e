"""The C reader: units, slices, depths, features, and the operators on them."""

import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linefold.functions import csource as C
from linefold.operators import audit, code
from linefold.sources.git_history import GitHistory

SUM = "int sum(int *a, int n) {\n  int s = 0;\n  for (int i = 0; i < n; i++) {\n    s += a[i];\n  }\n  return s;\n}\n"
COPY = "void copy(char *dst, const char *src) {\n  int n;\n  n = strlen(src);\n  if (n > 10) {\n    log_it();\n    n = 10;\n  }\n  memcpy(dst, src, n);\n}\n"


def units(src):
    return [(u.start_line, u.end_line, sorted(u.defs), sorted(u.uses), u.is_pred) for u in C.statements(src)]


def test_units_of_a_loop():
    assert units(SUM) == [
        (1, 1, ["s"], [], False),
        (2, 4, ["i", "s"], ["a", "i", "n", "s"], True),  # the unit of a loop is the whole of it
        (2, 2, ["i"], [], False),
        (3, 3, ["s"], ["a", "i", "s"], False),
        (5, 5, [], ["s"], False),
    ]
    assert C.parameters(SUM) == ["a", "n"]


ODD = ("", "junk", "int f(int a)\n{\n  return a;\n}\n", SUM, COPY, "void g() { /* a\n b */ g(); }", "int h(char *p)\n{\n#if A\n  *p = 1;\n#endif\n  s = \"x\\\n y\";\n}\n", "int F(int a) {\r\n  a = F(a - 1);\r\n}")


def test_one_reading_gives_every_slice(spark):
    """All slices, the forward region and the normal form come from one reading, whatever the function's name."""
    many = [(i, x and x.replace("sum", f"sum{i}")) for i, x in enumerate((*ODD, SUM, None))]
    for r in spark.createDataFrame(many, "i int, code string").select("i", "code", code.slice_views("code").alias("v")).collect():
        x = r.code or ""
        kept, sinks, status = C.slice_lines(x)
        assert (r.v.kept, r.v.sinks, r.v.status) == (kept, sinks, status), x
        assert (r.v.memory, r.v.data) == (C.slice_lines(x, "memory")[0], C.slice_lines(x, "all", ("data",))[0]), x
        assert (r.v.forward, r.v.norm) == (C.forward_lines(x), C.normalize(x)), x
    assert C.nameless(many[3][1]) == C.nameless(many[8][1]) != many[3][1]
    assert C.nameless(ODD[7]) == ODD[7] and C.nameless(ODD[5]) == ODD[5]  # the name stands twice


def test_equal_lines_and_statements_are_read_once(monkeypatch):
    """Time per function must not hold a scan and an analysis of lines that were met before."""
    body = "".join(f"  once{k} = once{k} + 1;\n" for k in range(20))
    first = C.statements("int f(int a)\n{\n" + body + "}\n")
    seen = []
    scan, judge = C._scan, C._analyse
    monkeypatch.setattr(C, "_scan", lambda x: seen.append(x) or scan(x))
    monkeypatch.setattr(C, "_analyse", lambda t, u: seen.append(t) or judge(t, u))
    again = C.statements("int f(int a)\n{\n\n" + body + "}\n")
    assert seen == [] or seen == [""]
    assert [(u.start_line + 1, u.defs, u.uses, u.reasons) for u in first] == [(u.start_line, u.defs, u.uses, u.reasons) for u in again]


def test_units_of_branches():
    got = units("void f(int a) {\n  if (a)\n    b = 1;\n  else {\n    c = 2;\n    d = 3;\n  }\n  do {\n    a--;\n  } while (a);\nend:\n  switch (a) {\n  case 1:\n    x = 1;\n    break;\n  default:\n    y = 2;\n  }\n}\n")
    assert [(g[0], g[1], g[4]) for g in got] == [(1, 1, True), (2, 2, False), (3, 6, False), (9, 9, True), (8, 8, False), (11, 11, True), (12, 14, False), (15, 16, False)]


@pytest.mark.parametrize(
    "stmt,defs,uses",
    [
        ("x = x + 1;", ["x"], ["x"]),
        ("x += y;", ["x"], ["x", "y"]),
        ("p->next = q;", ["p"], ["p", "q"]),
        ("a[i] = b;", ["a"], ["a", "b", "i"]),
        ("*p = v;", ["p"], ["p", "v"]),
        ("i++;", ["i"], ["i"]),
        ("int k;", ["k"], []),
        ("foo_t *z = get(w);", ["z"], ["get", "w"]),
        ("f(a, b.c);", [], ["a", "b", "f"]),
    ],
)
def test_defs_and_uses(stmt, defs, uses):
    (u,) = C.statements("void f() {\n" + stmt + "\n}")
    assert (sorted(u.defs), sorted(u.uses)) == (defs, uses)


@pytest.mark.parametrize(
    "stmt,reasons",
    [("x = y;", set()), ("g();", {"call"}), ("free(p);", {"call", "api"}), ("x = a[1];", {"subscript"}), ("x = *p;", {"pointer"}), ("x = &y;", {"pointer"}), ("x = p->q;", {"arrow"}), ("x = y * 2;", {"arith"}), ("int *p;", set()), ("int a[10];", set()), ("x = 1 + 2;", set()), ("return -x;", set())],
)
def test_sink_reasons(stmt, reasons):
    (u,) = C.statements("void f() {\n" + stmt + "\n}")
    assert u.reasons == reasons


def test_slice_tiers_and_kinds():
    assert C.slice_lines(COPY) == ([1, 2, 3, 4, 5, 7], [2, 4, 7], "matched")
    assert C.slice_lines(COPY, "api") == ([1, 2, 3, 5, 7], [2, 7], "matched")
    assert C.slice_lines(COPY, "api", ("data",)) == ([1, 2, 5, 7], [2, 7], "matched")
    assert C.slice_lines("int f(int a) {\n  int b;\n  b = a;\n  return b;\n}\n") == ([1, 2, 3], [], "fallback")
    assert C.slice_lines("") == ([], [], "whole") and C.slice_lines("{}")[2] == "whole"
    # a reading past all definitions takes them all
    assert C.slice_lines("void f() {\n  g(x);\n  x = 1;\n}\n")[0] == [1, 2]


def test_depths_follow_the_slice():
    u = C.statements(COPY)
    d = C.depths(u, C.criteria(u))
    lines = {x for v in u if v.sid in d for x in range(v.start_line, v.end_line + 1)}
    assert sorted(lines) == C.slice_lines(COPY)[0] and {v.start_line for v in u if d.get(v.sid) == 0} == {2, 4, 7}
    steps = C.trace(COPY)
    assert sorted({x for s in steps for x in (s["line"], *s["added_data"], *s["added_control"])}) == sorted({v.start_line for v in u if v.sid in d})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab(){};=+-*&[]<>\"'/#\n ,.if0else", max_size=120))
def test_odd_code_never_raises(text):
    src = "int f(int a) {\n" + text + "\n}"
    for s in (text, src):
        n = len(s.splitlines())
        kept, sinks, _ = C.slice_lines(s)
        assert set(sinks) <= set(kept) <= set(range(n))
        assert set(C.slice_lines(s, kinds=("data",))[0]) <= set(kept) or not C.statements(s)
        C.features(s), C.functions(s), C.profiles(s), C.normalize(s), C.trace(s)
        assert set(C.forward_lines(s)) <= set(range(n))


def test_features_and_normal_form():
    f = C.features('int f() {\n  const char *s = "x";\n  if (a[0] == NULL) g(1);\n}')
    assert (2, "lit:string") in f and (2, "mod:const") in f and (3, "idx") in f and (3, "op:==") in f and (3, "callee:g") in f and (3, "lit:null") in f and (3, "ctrl:if") in f
    assert C.normalize("foo(bar, foo, MAX, free(bar))") == "FUN1(VAR1, VAR2, MAX, free(VAR1))"


def test_functions_and_first_definition(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.c").write_text("#include <x.h>\nstatic int x;\n" + SUM + "\n" + COPY + SUM.replace("s = 0", "s = 1"))
    (tmp_path / "sub" / "b.h").write_text("struct s { int a; };\n" + COPY)
    (tmp_path / "c.txt").write_text(SUM)
    a = audit.audit(spark, [str(tmp_path)], True)
    rows = {(r.file.rsplit("/", 1)[1], r.function): r for r in a.collect()}
    assert set(rows) == {("a.c", "sum"), ("a.c", "copy"), ("b.h", "copy")}
    r = rows["a.c", "sum"]
    assert r.start_line == 3 and "int s = 0" in SUM and sorted(r.order) == list(range(3, 10)) and set(r.sinks) <= set(r.slice) and "ctrl:for" in r.features
    assert audit.fallback_rates(a).collect()[0].matched == 1.0 and audit.throughput(a).collect()[0].functions == 3


def test_line_diff_cases():
    d = code.line_diff("a\nb\nc\n", "a\nx\nc\n")
    assert (d["deleted"], d["added"], d["anchors"]) == ([1], [1], [])
    d = code.line_diff("a\nb\n", "a\nn\nm\nb\n")
    assert (d["deleted"], d["added"], d["anchors"], d["blocks"]) == ([], [1, 2], [0, 1], [{"anchor": 0, "lines": ["n", "m"]}])
    assert code.line_diff("a\n", "a\nz\n")["anchors"] == [0] and code.line_diff("x", "x") == {"deleted": [], "added": [], "anchors": [], "blocks": []}
    assert code.line_diff("", "q")["added"] == [0] and code.line_diff("q\nr", "")["deleted"] == [0, 1]


def test_udfs_take_nulls(spark):
    from linefold.runtime import ship

    ship(spark)
    df = spark.createDataFrame([(1, SUM), (2, None), (3, "")], "id int, code string")
    out = df.select("id", code.statement_units(F.col("code")).alias("u"), code.backward_slice()(F.col("code")).alias("s"), code.slice_depths(F.col("code")).alias("d"), code.variable_profiles(F.col("code")).alias("p"), code.walk(F.col("code")).alias("w"), code.parameter_names(F.col("code")).alias("n")).collect()
    by = {r.id: r for r in out}
    assert len(by[1].u) == 5 and by[1].s.status == "matched" and by[2].u == [] and by[3].s.status == "whole" and by[1].n == ["a", "n"]


def test_git_history(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.c").write_text(SUM)
    run("add", ".")
    run("commit", "-qm", "start")
    (tmp_path / "a.c").write_text(SUM.replace("s = 0", "s = 1"))
    run("commit", "-qam", "Fix cve-2024-12345 overflow")
    spark.dataSource.register(GitHistory)
    (r,) = spark.read.format("git_history").option("path", str(tmp_path)).load().collect()
    assert r.cves == ["CVE-2024-12345"] and r.file == "a.c" and r.before == SUM and r.after != SUM
