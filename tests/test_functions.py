import fnmatch
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from codetide.functions import commits as C, formats as M, languages as L, text as X

SOURCES = [
    "", "\n", "a\n\nb", "x\r\ny\rz\n", "  # note\ncode # not\n\t\n", "if (a && b) {\n  for (;;) { while (x || y) {} }\n} else if (c) { }\n}}\n{ else finally }",
    "TODO fixme Hack xxx bug debugging todos", "é if ärger elif naïve", "try { } catch (e) { case 1: } except\nfoo and bar or baz",
]


def evaluate(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}").select("i", column(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_line_counts(spark):
    def brute(s):
        lines = [x.strip() for x in s.splitlines()]
        blank, comment = sum(not x for x in lines), sum(x.startswith("#") for x in lines)
        return len(lines), blank, comment, len(lines) - blank - comment

    got = evaluate(spark, lambda c: X.loc_counts(c, ("#",)), [*SOURCES, "a\x0bb\x0cc\u2028d\x85e\x1cf"])
    assert [tuple(r) for r in got] == [brute(s) for s in [*SOURCES, "a\x0bb\x0cc\u2028d\x85e\x1cf"]]


def test_complexity_against_plain_loops(spark):
    keyword = re.compile(r"\b(?:if|elif|else\s+if|for|foreach|while|catch|except)\b")

    def cognitive(s):
        score = depth = 0
        for line in s.splitlines():
            depth = max(0, depth + line.count("{") - line.count("}"))
            score += len(keyword.findall(line)) * (1 + depth) + len(re.findall(r"\b(?:else|finally)\b", line)) + bool(re.search(r"&&|\|\||\band\b|\bor\b", line))
        return score

    def depth(s):
        now = most = 0
        for c in s:
            now = now + 1 if c == "{" else max(0, now - 1) if c == "}" else now
            most = max(most, now)
        return most

    rng = random.Random(5)
    texts = SOURCES + ["".join(rng.choice(["{", "}", " if ", "\n", " else ", " && ", "for", " x "]) for _ in range(80)) for _ in range(40)]
    assert evaluate(spark, X.cognitive, texts) == [cognitive(s) for s in texts]
    assert evaluate(spark, X.nesting_depth, texts) == [depth(s) for s in texts]
    assert evaluate(spark, X.cyclomatic, texts) == [1 + len(re.findall(X.CYCLOMATIC, s)) for s in texts]
    assert evaluate(spark, X.todo_count, texts) == [len(re.findall(X.TODO, s, re.I)) for s in texts]


def test_halstead(spark):
    texts = ["a = b + c * 2", "", "foo(bar, 3.5) && not baz", "é = ñ2 + 1"]
    for s, got in zip(texts, evaluate(spark, lambda c: F.struct(*(v.alias(k) for k, v in X.halstead(c).items())), texts), strict=True):
        ops, opr = re.findall(X.OPERATORS, s), re.findall(X.OPERANDS, s)
        assert (got["n1"], got["n2"], got["total_n1"], got["total_n2"]) == (len(set(ops)), len(set(opr)), len(ops), len(opr))
        v = got["n1"] + got["n2"]
        assert math.isclose(got["volume"], (len(ops) + len(opr)) * math.log2(v) if v else 0)
        assert got["effort"] == got["volume"] * got["difficulty"]


def test_paths(spark):
    paths = ["src/main.py", "Makefile", "README.MD", "app.test.js", ".hidden", "a/.b.c", "x."]
    assert evaluate(spark, X.extension, paths)[:4] == ["py", "", "md", "js"]
    assert evaluate(spark, X.suffix, paths) == [".py", "", ".MD", ".js", "", ".c", ""]
    assert evaluate(spark, X.parent_module, paths) == ["src", "(root)", "(root)", "(root)", "(root)", "a", "(root)"]


def test_languages(spark):
    names = ["a.py", "b.m", "c.mm", "Dockerfile", "GNUmakefile", "x.PY", "y.h", "z.kt", "noext"]
    assert evaluate(spark, L.language_of, names) == ["python", "objectivec", "objectivec", "dockerfile", "makefile", "generic", "cpp", "kotlin", "generic"]
    assert "python" in L.supported_languages() and ".pyi" in L.supported_languages()["python"]


def test_exclusion(spark):
    patterns = ("*.log", "build", "docs/*.md", "v[0-9]")
    paths = ["a.log", "x/b.log", "build/x.py", "builds/x.py", "docs/a/b.md", "v1/x.py", "vx/x.py", "a.PNG", "src/Thumbs.db", ".git/config", "ok.py"]

    def brute(p):
        name = p.split("/")[-1]
        ext = "." + name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""
        return ext in L.BINARY or name in L.BINARY or any(fnmatch.fnmatch(x, q) for q in (*L.ALWAYS_EXCLUDED, *patterns) for x in (p, *p.split("/")))

    assert evaluate(spark, lambda c: L.excluded(c, patterns), paths) == [brute(p) for p in paths]


def test_commit_messages(spark):
    m = ["Merge branch x", "merge y\nbody", "fixup! a", "squash! b", "fixup!", 'Revert "x"', "revert it", "feat: a", "fix(scope)!: b", "plain: ", "no type", "wip", "WIPe", "Work in progress"]
    assert evaluate(spark, C.is_merge, m)[:3] == [True, True, False]
    assert [x for x, y in zip(m, evaluate(spark, C.is_fixup, m), strict=True) if y] == ["fixup! a", "squash! b"]
    assert [x for x, y in zip(m, evaluate(spark, C.is_revert, m), strict=True) if y] == ['Revert "x"', "revert it"]
    assert evaluate(spark, C.conventional_type, m)[7:11] == ["feat", "fix", "plain", None]
    assert [x for x, y in zip(m, evaluate(spark, C.is_wip, m), strict=True) if y] == ["wip", "Work in progress"]
    assert evaluate(spark, C.size_category, [7, 50, 51, 200, 300, 500, 600], "long") == ["small", "small", "medium", "medium", "large", "large", "enormous"]


def test_numstat(spark):
    lines = ["10\t0\tnew.py", "0\t15\told.py", "5\t3\tmod.py", "text", "-\t-\timage.png", "5\t3\tsrc/{old.py => new.py}", "1\t1\ta/{x => y}/z.py"]
    got = [r and tuple(r) for r in evaluate(spark, C.numstat, lines)]
    assert got == [("new.py", "added", 10, 0, None), ("old.py", "deleted", 0, 15, None), ("mod.py", "modified", 5, 3, None), None, ("image.png", "modified", 0, 0, None), ("src/new.py", "renamed", 5, 3, "src/old.py"), ("a/y/z.py", "renamed", 1, 1, "a/x/z.py")]


def test_semver(spark):
    got = [tuple(r) for r in evaluate(spark, lambda c: F.struct(*(v.alias(k) for k, v in C.semver(c).items())), ["v1.2.3", "1.0.0-rc.1", "v1.2", "x1.2.3"])]
    assert got == [(1, 2, 3, ""), (1, 0, 0, "rc.1"), (None,) * 4, (None,) * 4]


@pytest.mark.parametrize("merged,status,age,ahead,protected,score,category", [
    (True, "abandoned", 100, 0, False, 100.0, "safe"), (False, "active", 2, 5, False, 0.7, "keep"), (True, "stale", 50, 0, False, 81.7, "safe"),
    (True, "stale", 50, 10, False, 76.7, "safe"), (True, "abandoned", 100, 0, True, 0.0, "keep"), (False, "abandoned", 200, 0, False, 50.0, "caution"),
])
def test_deletability(spark, merged, status, age, ahead, protected, score, category):
    row = spark.range(1).select(C.deletability(F.lit(merged), F.lit(status), F.lit(age), F.lit(ahead), F.lit(protected)).alias("s"))
    assert row.first()["s"] == score
    assert row.select(C.deletability_category(F.col("s"), F.lit(protected))).first()[0] == category


def test_formats(spark):
    assert evaluate(spark, M.human_number, [999, 1000, 12_345, 1_234_567], "long") == ["999", "1.0K", "12.3K", "1.2M"]
    assert evaluate(spark, M.human_bytes, [5, 2048, 5 << 20], "long") == ["5 B", "2.0 KB", "5.0 MB"]
    assert evaluate(spark, M.teamcity_escape, ["a|b'c\nd\re[f]"]) == ["a||b|'c|nd|re|[f|]"]
    assert evaluate(spark, M.complexity_colour, [5.0, 5.1, 20.0, 21.0], "double") == ["#4c1", "#a4a61d", "#dfb317", "#e05d44"]
    assert evaluate(spark, M.coverage_colour, [90.0, 75.0, 50.0, 49.9], "double") == ["#4c1", "#a4a61d", "#dfb317", "#e05d44"]
    assert evaluate(spark, M.blame_age, [29, 30, 179, 180, 364, 365], "int") == ["fresh", "recent", "recent", "old", "old", "ancient"]
    assert evaluate(spark, lambda c: M.matches_any(c, ("main", "release/*")), ["main", "mainline", "release/v1.0", "x/release/1"]) == [True, False, True, False]


def test_no_python_in_plans(spark):
    frame = spark.createDataFrame([("x",)], "v string").select(X.cognitive(F.col("v")), X.nesting_depth(F.col("v")), L.language_of(F.col("v")), C.numstat(F.col("v")))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_numstat_rows_match_each_line_once(spark):
    lines = ["10\t0\ta.py", "-\t-\timage.png", "3\t4\tsrc/{old.py => new.py}", "1\t2\ta\tb", "1\t2\t", "x\t2\ta", "1\t2\ta\nb", "1\t2\ta\n", "1234567890123456789\t7\tz", "0\t5\t{a => b}/{c => d}", "5\t5\ta => b", "\t\tq", None]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    rows = C.numstat_rows(frame)
    expected = [
        ("a.py", "added", 10, 0, None), ("image.png", "modified", 0, 0, None), ("src/new.py", "renamed", 3, 4, "src/old.py"), ("a\tb", "modified", 1, 2, None), (None,) * 5, (None,) * 5, (None,) * 5,
        ("a", "modified", 1, 2, None), ("z", "modified", None, 7, None), ("{a => b}/d", "renamed", 0, 5, "{a => b}/c"), ("a => b", "modified", 5, 5, None), (None,) * 5, (None,) * 5,
    ]
    assert [tuple(r) for r in rows.collect()] == expected
    assert [tuple(r["c"]) if r["c"] else (None,) * 5 for r in frame.select(C.numstat(frame.line).alias("c")).collect()] == expected
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1
