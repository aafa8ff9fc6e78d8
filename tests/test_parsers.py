import random
import re

import pytest

from codetide.operators import carry
from codetide.parsers import base, python, tables
from codetide.sources import logs

CALC = {
    "calc.py": ('import os.path\nfrom x.y import z\nfrom . import q\n\nclass Calc(Base):\n    """Adds."""\n    def __init__(self, start=0):\n        self.total = start\n\n    def add(self, a, *, b: int = 2, **rest) -> int:\n        if a > 0:\n            return a\n        elif a < -1 or b:\n            return b\n        else:\n            return 0\n\n    def reset(self):\n        self.total = 0\n\ndef free(x, y, z=3):\n    return [i for i in x if i and y]\n', "Calc", ["__init__", "add", "reset"], ["free"], ["os", "x"], 4),
    "Calc.java": ("import java.util.List;\npublic class Calc extends Base implements A, B {\n  public Calc(int start) {\n    this.total = start;\n  }\n  public int add(int a, int b) {\n    if (a > 0) {\n      return a;\n    } else if (b > 0) {\n      return b;\n    }\n    return 0;\n  }\n  void reset() {\n  }\n}\n", "Calc", ["Calc", "add", "reset"], [], ["java"], 3),
    "calc.js": ("import p from 'path/posix';\nclass Calc extends Base {\n  constructor(start = 0) {\n    this.total = start;\n  }\n  add(a, ...rest) {\n    return a && rest;\n  }\n  reset() {\n  }\n}\nexport function free(x, y, z = 3) {\n  return x;\n}\n", "Calc", ["constructor", "add", "reset"], ["free"], ["path"], 2),
    "calc.ts": ("import { p } from 'path';\nexport class Calc extends Base implements A {\n  constructor(private start: number) {\n  }\n  add(a: number, b?: string): number {\n    while (a) {\n    }\n    return a;\n  }\n}\ninterface Shape {\n  area(): number;\n}\nenum Kind {\n  A,\n}\nfunction free(x: number): void {\n}\n", "Calc", ["constructor", "add"], ["free"], ["path"], 2),
    "calc.cpp": ("#include <string>\n#include \"my/vec.h\"\nclass Calc : public Base {\n  int add(int a, int b = 2) {\n    for (;;) {\n    }\n    return a;\n  }\n};\nint twice(int x) {\n  return x ? 1 : 2;\n}\n", "Calc", ["add"], ["twice"], ["string", "vec"], 2),
    "Calc.cs": ("using System.Text;\npublic class Calc : Base {\n  public Calc(int start) {\n  }\n  public int Add(int a, ref int b) {\n    foreach (var x in b) {\n    }\n    return a;\n  }\n}\n", "Calc", ["Calc", "Add"], [], ["System"], 2),
    "calc.go": ("package main\nimport (\n  \"fmt\"\n  \"a/b\"\n)\ntype Calc struct {\n  n int\n}\ntype Shape interface {\n  Area() int\n}\nfunc (c *Calc) Add(a int, b int) int {\n  if a > 0 {\n    return 1\n  }\n  return 2\n}\nfunc free(x int) {\n}\n", "Calc", ["Add"], ["free"], ["b", "fmt"], 2),
    "calc.m": ("#import <Foundation/Foundation.h>\n@interface Calc : NSObject\n@end\n@implementation Calc\n- (id)initWith:(int)a name:(NSString *)b {\n  return self;\n}\n- (void)reset {\n  if (1) {\n  }\n}\n@end\nint twice(int x) {\n  return x;\n}\n", "Calc", ["initWith:name:", "reset"], ["twice"], ["Foundation"], 2),
}


@pytest.mark.parametrize("name", CALC)
def test_structure(name):
    text, cls, methods, functions, imports, most = CALC[name]
    found = base.default_registry().for_path(name)[1](text)
    own = next(c for c in found.classes if c.name == cls)
    names = [m.name for m in own.methods]
    assert [n for n in names if n in methods] == methods
    assert [f.name for f in found.functions] == functions and found.imports == imports
    assert max(m.cyclomatic for m in own.methods if m.name in methods) == most
    assert text.split("\n")[own.line - 1].find(cls) >= 0 and own.end_line >= own.line


TRICKY = {
    "T.java": ("""import java.util.*; // class Fake { void no() { if (a) {} } }
import static org.x.Y.z;
@Entity(name = "a{b") /* class Other { */
public final class T<K extends Comparable<K>> extends Base<K> implements A<K>, B {
  static { int q = 1; }
  private final Map<String, List<K>> m = new HashMap<>() {{ put("if (x) {", null); }};
  @Ann({1, 2}) public <X> Map<String, X> pick(final Map<String, X> m, @Nullable int... rest) throws E, F {
    String s = "while (true) { } && ||"; char c = '{'; // if
    return m != null && s.isEmpty() ? m : null;
  }
  void pick(int other) { }
  T() { this(1); }
  T(int n) { for (int i = 0; i < n; i++) { switch (i) { case 1: break; case 2: break; } } }
  abstract void none();
  class Inner { void deep() { Runnable r = () -> { if (true) { } }; } }
}
""", [("T", ["Base", "A", "B"], ["T", "T", "pick"]), ("Inner", [], ["deep"])], [], ["java", "org"], {"pick": 3, "T": 4}),
    "t.js": ("""import a, { b } from '@scope/pkg/x'
const fs = require("fs/promises")
// function ghost() {}
const re = /function fake\\(\\) \\{/g, tpl = `class Nope { ${ [1].map(x => { return `{${x}` }) } `
export default class T extends Base {
  x = 5
  #y = call(1)
  async *items({ p, q = 2 }, [r], ...rest) {
    for (const i of rest) { if (i?.a ?? p) { } }
    return p ? q : r
  }
  get size() { return 1 }
  arrow = () => { while (1) { } }
  static of(a = "){") { return a || 1 }
}
if (fs) { call(function () { }) }
async function outer(a) {
  function inner(b, c = () => ({})) { try { } catch (e) { } }
  return inner
}
""", [("T", ["Base"], ["items", "size", "of"])], ["outer", "inner"], ["@scope", "fs"], {"items": 4, "of": 2}),
    "t.ts": ("""import type { X } from './x'
@Component({ selector: 'app' })
export abstract class T<K> extends Base<K> implements A, B<K> {
  private n?: number
  constructor(private readonly a: Map<string, K>, public b = 1) { super() }
  async load<Q>(q: (x: number) => Q, opt?: string): Promise<{ a: Q }> {
    return opt ? q(1) : q(2)
  }
  declare(): void;
}
export interface Shape extends A, B { area(): number }
export const enum Kind { A = 1 }
export function free(this: T<any>, { a, b }: X, n: number = 1): n is 3 { return true && !!a }
""", [("T", ["Base", "A", "B"], ["constructor", "load"]), ("Shape", ["A", "B"], []), ("Kind", [], [])], ["free"], ["."], {"load": 2}),
    "t.cpp": ("""#include <vector>
#include "a/b.hpp"
#define BAD(x) class x { void y() {
namespace n { namespace {
template <typename T, int N = (1 > 0)> class T1 : public Base<T>, private virtual ns::Other {
  T1(int a, int b = 2) : a_{a}, b_(b) { if (a) { } }
  ~T1() { }
  auto size() const noexcept -> int { return 1; }
  bool operator==(const T1& o) const { return a_ == o.a_ && b_ == o.b_; }
  int operator()(int x) { return x ? 1 : 0; }
  void none() override = 0;
};
enum class E { A, B };
static inline std::vector<std::pair<int, int>> pairs(const std::vector<int>& in, char* name[], int n = f(1, 2)) {
  auto l = [&](int x) { return x > 1 || x < 0; };
  const char* s = R"x(while (1) { " )x"; char c = '"';
  while (n) { n = 1'000; }
  return {};
}
auto late(int a) -> int { return a; }
int T1::outside(int q) const { return q; }
} }
extern "C" { int plain(void) { return 0; } }
""", [("T1", ["Base", "ns::Other"], ["T1", "~T1", "size", "operator==", "operator()"])], ["pairs", "late", "T1::outside", "plain"], ["b", "vector"], {"operator==": 2, "operator()": 2}),
    "T.cs": ("""using System.Linq;
using static Acme.Tools.Helper;
using (var x = y) ;
namespace N.M {
  [Serializable, Note("class {")]
  public sealed partial class T<K> : Base<K>, IA where K : class, new() {
    public int P { get; set; } = 1;
    public int Q { get { if (a) { } return 1; } }
    public T(int a) : base(a) { }
    static T() { }
    public async Task<Dictionary<string, K>> Run(ref int a, params string[] rest) {
      var s = @"C:\\dir\\"" if {"; var t = $"{a} {{";
      foreach (var r in rest) { if (r == null || s == t) { } }
      return a > 1 ? null : x ?? y;
    }
    void Arrow() => Run();
  }
  interface IA { void No(); }
  struct S { } enum E { A }
}
""", [("T", ["Base", "IA"], ["T", "T", "Run"]), ("IA", [], []), ("S", [], []), ("E", [], [])], [], ["Acme", "System"], {"Run": 5}),
    "t.go": ("""package t
import f "fmt"
import (
  "a/b" // "no"
  _ "c/d"
)
type (
  P struct{ x int }
)
type T[K any] struct { m map[string]struct{} }
type I interface { M(x int) }
func (t *P) Get(a, b int, f func(int) (int, error)) (r interface{}, err error) {
  s := `if { && `
  for i := range s { if i > 0 && a > b || false { } }
  switch { case a > 1: }
  return nil, nil
}
func Free[X any](x X) interface{} {
  return func() bool { return true }
}
""", [("P", [], ["Get"]), ("I", [], [])], ["Free"], ["b", "d", "fmt"], {"Get": 6}),
    "t.m": ("""#import <UIKit/UIKit.h>
#import "My/View.h"
@class Later;
@protocol P <NSObject>
- (void)declared;
@end
@interface T : NSObject <P>
- (void)only;
@end
@implementation T
- (instancetype)initWithA:(NSDictionary<NSString *, id> *)a b:(int)b { if (a && b) { } return self; }
+ (void)go { NSString *s = @"- (void)fake { @end"; }
static int hidden(int x) { return x; }
@end
@implementation NSString (Extra)
- (int)len { return self ? 1 : 2; }
@end
static inline NSInteger twice(NSInteger x) { return x; }
""", [("P (protocol)", [], []), ("T", ["NSObject"], ["initWithA:b:", "go"]), ("NSString(Extra)", [], ["len"])], ["twice"], ["My", "UIKit"], {"initWithA:b:": 3, "len": 2}),
}


@pytest.mark.parametrize("name", TRICKY)
def test_tricky_structure(name):
    text, classes, functions, imports, complexities = TRICKY[name]
    found = base.default_registry().for_path(name)[1](text)
    assert [(c.name, c.bases, [m.name for m in c.methods]) for c in found.classes] == classes
    assert [f.name for f in found.functions] == functions and found.imports == imports
    measured = {m.name: m.cyclomatic for c in found.classes for m in c.methods}
    assert {k: measured[k] for k in complexities} == complexities
    lines = text.split("\n")
    for m in [*(m for c in found.classes for m in c.methods), *found.functions]:
        assert m.name.split(":")[0].split("operator")[-1].lstrip("~") in lines[m.line - 1] and m.line <= m.end_line <= len(lines)


def test_parameters():
    parse = lambda name, text: base.default_registry().for_path(name)[1](text)
    shown = lambda m: [(p["name"], p["annotation"], p["has_default"]) for p in m.parameters]
    java, js, ts, cpp, cs, go, objc = (parse(n, TRICKY[n][0]) for n in TRICKY)
    assert shown(java.classes[0].methods[2]) == [("m", "Map<String, X>", False), ("rest", "int", False)]
    assert [x[0] for x in shown(js.classes[0].methods[0])] == ["p", "q", "r", "rest"]
    assert shown(ts.classes[0].methods[0]) == [("a", "Map<string, K>", False), ("b", "", True)]
    assert shown(ts.classes[0].methods[1]) == [("q", "(x: number) => Q", False), ("opt", "string", True)]
    assert shown(cpp.functions[0]) == [("in", "const std::vector<int>&", False), ("name", "char*", False), ("n", "int", True)]
    assert shown(cpp.functions[3]) == []
    assert shown(cs.classes[0].methods[2]) == [("a", "int", False), ("rest", "string[]", False)]
    assert shown(go.classes[0].methods[0]) == [("a", "", False), ("b", "int", False), ("f", "func(int) (int, error)", False)]
    assert shown(objc.classes[1].methods[0]) == [("a", "NSDictionary<NSString *, id> *", False), ("b", "int", False)]


@pytest.mark.parametrize("name", [n for n in CALC if not n.endswith(".py")])
@pytest.mark.parametrize("text", ["", "{", "}", "((((", "class", "class {", "func", "func (", "@interface", "\"", "'", "`${", "/*", "a ? b", "R\"(", "@\"", "#", "import", "x(" * 300, "{" * 300, "}" * 50 + "class A { f() {", "type X struct", "operator"])
def test_broken_text(name, text):
    assert base.default_registry().for_path(name)[1](text).imports == []


def test_lexer_time_is_linear():
    import time

    from codetide.parsers.declarations import parser

    for language in ("java", "javascript", "typescript", "cpp", "csharp", "go", "objectivec"):
        start = time.perf_counter()
        for text in ("a < " * 40_000, "f(x) { " * 3000, "class A { void f() { if (a) { } } }\n" * 3000, "// x\n" * 40_000):
            parser(language)(text)
        assert time.perf_counter() - start < 20


def test_python_details():
    found = python.parse(CALC["calc.py"][0])
    add = found.classes[0].methods[1]
    assert [p["name"] for p in add.parameters] == ["a", "b", "**rest"] and add.parameters[1] == {"name": "b", "annotation": "int", "has_default": True}
    assert found.classes[0].attributes == ["total"] and found.classes[0].docstring == "Adds." and found.classes[0].methods[0].is_constructor
    assert (add.cognitive, add.nesting) == (1 + 1 + 1 + 1, 2)
    assert found.functions[0].cyclomatic == 3
    assert python.parse("def f(:") == base.Structure()
    assert python.parse("class A:\n  class B:\n    pass\n").classes[1].name == "B"


@pytest.mark.parametrize("source,score", [
    ("def f():\n  pass", 0), ("def f(a):\n  if a:\n    for x in a:\n      pass", 3), ("def f(a):\n  return 1 if a else 2", 2), ("def f(n):\n  return f(n - 1)", 1),
    ("def f():\n  try:\n    pass\n  except E:\n    pass\n  else:\n    pass\n  finally:\n    pass", 3), ("def f(a, b):\n  return a and b or a", 2), ("def f(a):\n  while a:\n    a -= 1\n  else:\n    pass", 2),
    ("def f(a):\n  try:\n    if a:\n      if a:\n        pass\n  except E:\n    pass", 2),
])
def test_cognitive(source, score):
    assert python.parse(source).functions[0].cognitive == score


def test_registry():
    r = base.default_registry()
    with pytest.raises(KeyError):
        r.get(".zzz")
    assert r.for_path("x.zzz")[0] == "generic" and r.for_path("x.mm")[0] == "objectivec"
    r.register("mine", (".py",), lambda text: base.Structure(imports=["mine"]))
    assert r.for_path("a.py")[1]("").imports == ["mine"] and r.languages()["mine"] == [".py"]


def test_tables(spark):
    files = spark.createDataFrame([(n, bytearray(v[0].encode())) for n, v in CALC.items()] + [("bad.py", bytearray(b"def (\n# x\n")), ("l1.txt", bytearray(b"caf\xe9\n\nx")), ("gone.py", None), ("Makefile", bytearray(b"# c\nall:\n"))], "path string, content binary")
    parsed = tables.parse_files(files)
    rows = {r["path"]: r for r in tables.file_rows(parsed).collect()}
    assert rows["bad.py"]["num_classes"] == 0 and rows["bad.py"]["comment_lines"] == 1 and rows["bad.py"]["error"] is None
    assert rows["l1.txt"]["language"] == "text" and rows["l1.txt"]["blank_lines"] == 1 and rows["l1.txt"]["size_bytes"] == 7
    assert rows["gone.py"]["total_lines"] == 0 and rows["Makefile"]["language"] == "makefile" and rows["Makefile"]["comment_lines"] == 1
    assert {r["language"] for r in rows.values()} >= {"python", "java", "javascript", "typescript", "cpp", "csharp", "go", "objectivec"}
    methods = tables.method_rows(parsed)
    assert methods.filter("path = 'calc.py' and class_name = 'Calc'").count() == 3 and methods.filter("path = 'calc.py' and class_name is null").count() == 1
    assert {r["imported"] for r in tables.import_rows(parsed).filter("path = 'calc.go'").collect()} == {"fmt", "b"}
    assert tables.class_rows(parsed).filter("path = 'calc.ts'").count() == 3


def test_failing_parser_keeps_the_row(spark):
    r = base.Registry()

    def broken(text):
        raise RuntimeError("no way")

    r.register("broken", (".py",), broken)
    row = tables.parse_files(spark.createDataFrame([("a.py", bytearray(b"x"))], "path string, content binary"), r).first()
    assert row["error"] == "RuntimeError: no way" and row["classes"] == []


def test_log_records(spark):
    head = ["abc", "Ann", "a@x", "2024-01-02T03:04:05+02:00", "Bob", "b@x", "2024-01-02T03:04:06Z", "feat: x", "", "\n3\t1\ta.py\n-\t-\tb.png\nnoise\n"]
    bad = ["def", "Ann", "a@x", "not-a-date", "Bob", "b@x", "2024", "y", "", ""]
    rows = logs.parse_log(spark.createDataFrame([("\0".join(head),), ("\0".join(bad),), ("few\0fields",)], "value string")).orderBy("sha").collect()
    assert [r["sha"] for r in rows] == ["abc", "def"]
    assert str(rows[0]["authored_ts"]) == "2024-01-02 03:04:05" and rows[0]["insertions"] == 3 and len(rows[0]["changes"]) == 2
    assert str(rows[1]["authored_ts"]) == "1970-01-01 00:00:00" and rows[1]["changes"] == []


def test_diff(spark):
    text = "diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n@@ -10,5 +10,8 @@ def f\n ctx\n-old\n+new\n+more\n\\ No newline at end of file\n@@ -30 +33 @@\n-a\n+b\ndiff --git a/y b/y\nnew file\n--- /dev/null\n+++ b/y\n@@ -0,0 +1 @@\n+only\n"
    rows = [tuple(r) for r in logs.parse_diff(spark.createDataFrame([("d", text)], "diff_id string, value string")).orderBy("position").select("path", "hunk", "line_type", "content", "old_line", "new_line").collect()]
    assert rows == [("x", 1, "context", "ctx", 10, 10), ("x", 1, "delete", "old", 11, None), ("x", 1, "add", "new", None, 11), ("x", 1, "add", "more", None, 12), ("x", 2, "delete", "a", 30, None), ("x", 2, "add", "b", None, 33), ("y", 3, "add", "only", None, 1)]


def test_tree_and_lcov(spark):
    listing = ["100644 blob aaa1     100\tscripts/run.sh", "160000 commit bbb2       -\tsub", "100644 blob ccc3      50\tREADME.md", "junk"]
    entries = logs.parse_tree(spark.createDataFrame([(x,) for x in listing], "value string"))
    assert {(r["path"], r["size"]) for r in entries.collect()} == {("scripts/run.sh", 100), ("sub", -1), ("README.md", 50)}
    assert logs.submodules(entries).count() == 1
    lines = ["TN:", "SF:a.py", "DA:1,1", "DA:2,0", "end_of_record", "SF:b.py", "DA:1,3"]
    assert lcov(spark, lines) == [(1, "a.py", 1, 2, 0.5)]


def lcov(spark, lines, block=3):
    frame = spark.createDataFrame([("t", i // block, i, x) for i, x in enumerate(lines)], "path string, block long, position long, line string")
    return sorted(tuple(r)[1:] for r in logs.parse_lcov(frame).collect())


def plain_lcov(lines):
    out, name, record, counts = [], None, 0, [0, 0]

    def put():
        out.append((record, name, *counts, round(counts[0] / counts[1], 4) if counts[1] else 0.0))

    for line in lines:
        if line.startswith("SF:") and line[3:]:
            if name is not None:
                put()
            name, record, counts = line[3:], record + 1, [0, 0]
        elif found := re.match(r"DA:(\d+),(\d+)", line):
            if name is not None:
                counts = [counts[0] + (int(found[2]) > 0), counts[1] + 1]
        elif line.strip() == "end_of_record" and name is not None:
            put()
            name = None
    return out


def test_lcov_blocks_against_a_plain_reader(spark):
    rng = random.Random(8)
    for block in (1, 4, 1000):
        lines = rng.choices(["SF:a", "SF:b/c.py", "DA:1,0", "DA:2,7", "DA:3,99999999999999999999", "end_of_record", " end_of_record\t", "TN:x", "SF:", "DA:x"], k=120)
        assert lcov(spark, lines, block) == plain_lcov(lines)
    assert lcov(spark, []) == []


def test_one_text_in_many_blocks(spark, monkeypatch):
    """Diffs and blame of one file give the same whether it is one block or hundreds."""
    diff = "".join(f"diff --git a/f{k} b/f{k}\n--- a/f{k}\n+++ b/f{k}\n" + "".join(f"@@ -{i * 10 + 1},3 +{i * 10 + 2},4 @@\n a\n-b\n+c\n+d\n\n e\n" for i in range(20)) for k in range(3))
    blame = "".join(f"{k:040x} 1 {k} 1\n" + (f"author A{k}\nauthor-mail <a{k}@x>\nauthor-time {k * 100}\n" if k % 3 == 1 else "") + "\tcode\n" for k in range(60))
    diffs = spark.createDataFrame([("d", diff), ("e", ""), ("f", "\n"), (None, diff[:300])], "diff_id string, value string")
    files = spark.createDataFrame([("p", blame), ("q", "\tno header")], "path string, value string")
    whole = sorted(map(str, logs.parse_diff(diffs).collect())), sorted(map(str, logs.parse_blame(files).collect()))
    rows = logs.parse_blame(files).filter("path = 'p'").orderBy("line_number").collect()
    assert [(r["line_number"], r["author_name"], r["commit_sha"]) for r in rows[:5]] == [(0, "", "0" * 40), (1, "A1", f"{1:040x}"), (2, "A1", f"{2:040x}"), (3, "A1", f"{3:040x}"), (4, "A4", f"{4:040x}")]
    assert logs.parse_blame(files).filter("path = 'q'").first()["commit_sha"] == ""
    monkeypatch.setattr(carry, "BLOCK", 7)
    assert (sorted(map(str, logs.parse_diff(diffs).collect())), sorted(map(str, logs.parse_blame(files).collect()))) == whole


def test_a_long_file_is_read_by_many_tasks(spark, tmp_path):
    """Splits of a file are blocks; none of the windows holds more than one."""
    (tmp_path / "lcov.info").write_text("".join(f"SF:f{i}\nDA:1,{i % 2}\nDA:2,1\n" + "end_of_record\n" * (i % 5 > 0) for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = carry.read_lines(spark, str(tmp_path / "lcov.info"))
        assert lines.select("block").distinct().count() > 10
        rows = logs.parse_lcov(lines).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["record"], r["file"], r["covered"]) for r in rows) == [(i + 1, f"f{i}", 1 + i % 2) for i in range(4000)]


def test_a_try_directly_in_a_try():
    source = "def f(x):\n    try:\n        try:\n            if x:\n                pass\n        finally:\n            pass\n    finally:\n        pass\n"
    assert python.parse(source).functions[0].cognitive == 2
