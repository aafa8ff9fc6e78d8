"""Reports as files: JSON, CSV, JUnit, badges, a terminal summary and a dashboard page.

``write_tables`` scales with the tables and is meant for large repositories; the
other exporters write one file each for people and build servers, and fetch only
aggregates or row by row.
"""

from __future__ import annotations

import base64
import csv
import html
import json
import mimetypes
import shlex
import zlib
from collections.abc import Callable
from datetime import date, datetime
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, functions as F

from ..analysis import Report
from ..functions import formats as M
from ..operators import ordering, structure as S
from ..operators.rules import Thresholds

#: Bytes of a dashboard page from which a warning is due, and from which it is refused.
WARN_BYTES, MOST_BYTES = 30 << 20, 50 << 20


def _plain(value):
    return value.isoformat() if isinstance(value, (date, datetime)) else value


def _rows(table: DataFrame, order: str | None = None):
    ordered = table.orderBy(order) if order else table
    return ({k: _plain(v) for k, v in row.asDict(recursive=True).items()} for row in ordered.toLocalIterator())


def write_tables(report: Report, folder: str, kind: str = "parquet") -> None:
    """Every table as its own folder, by Spark's writers."""
    for name, table in report.tables.items():
        table.write.mode("overwrite").format(kind).save(f"{folder}/{name}")


def write_json(report: Report, folder: str | Path) -> list[Path]:
    """One document with all tables, and one with the totals."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    full, summary = target / "report.json", target / "summary.json"
    with full.open("w", encoding="utf-8") as f:
        f.write("{\n" + f'  "root": {json.dumps(str(report.root))}')
        for name, table in sorted(report.tables.items()):
            f.write(f",\n  {json.dumps(name)}: [")
            for k, row in enumerate(_rows(table)):
                f.write(("," if k else "") + "\n    " + json.dumps(row, ensure_ascii=False))
            f.write("]")
        f.write("\n}\n")
    totals = next(_rows(report["totals"]))
    counts = {"classes": report["classes"].count(), "methods": report["methods"].filter("class_name is not null").count(), "functions": report["methods"].filter("class_name is null").count()}
    totals |= counts | {"language_counts": {r["language"]: r["file_count"] for r in _rows(report["languages"])}, "duplication_ratio": next(_rows(report["duplication"]))["ratio"]}
    summary.write_text(json.dumps(totals, indent=2) + "\n", encoding="utf-8")
    return [full, summary]


CSV_TABLES = {
    "files": ("path", "language", "total_lines", "code_lines", "blank_lines", "comment_lines", "comment_ratio", "size_bytes", "num_classes", "num_functions"),
    "classes": ("path", "name", "line", "end_line", "lines", "num_methods", "num_attributes", "bases"),
    "methods": ("path", "class_name", "name", "line", "end_line", "lines", "cyclomatic", "cognitive", "nesting", "num_parameters", "is_constructor"),
    "languages": ("language", "file_count", "total_lines", "code_lines", "blank_lines", "comment_lines"),
}


def csv_table(report: Report, name: str) -> DataFrame:
    table = report[name]
    if name == "files":
        table = table.withColumn("comment_ratio", F.bround(F.when(F.col("total_lines") > 0, F.col("comment_lines") / F.col("total_lines")).otherwise(0.0), 4))
    if name == "classes":
        table = table.withColumns({"num_attributes": F.size("attributes"), "bases": F.array_join("bases", "; ")})
    if name == "methods":
        table = table.withColumn("num_parameters", F.size("parameters"))
    return table.select(*CSV_TABLES[name])


def _safe(value):
    """A cell that a spreadsheet won't take for a formula."""
    return "'" + value if isinstance(value, str) and value[:1] in "=+-@\t\r" else value


def write_csv(report: Report, folder: str | Path) -> list[Path]:
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    out = []
    for name, columns in CSV_TABLES.items():
        file = target / f"{name}.csv"
        with file.open("w", newline="", encoding="utf-8") as f:
            writer = csv.writer(f)
            writer.writerow(columns)
            for row in csv_table(report, name).orderBy(*columns[:2]).toLocalIterator():
                writer.writerow([_safe(v) for v in row])
        out.append(file)
    return out


def write_junit(report: Report, folder: str | Path, t: Thresholds = Thresholds()) -> list[Path]:
    """A suite for each file: its size, and each function's complexity and length."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    sizes = report["files"].select("path", F.lit("file_size").alias("case"), F.col("total_lines").alias("value"), F.lit(t.max_file_lines).alias("most"))
    label = F.concat_ws(".", "class_name", "name")
    cases = [sizes]
    for case, column, most in (("complexity", "cyclomatic", t.max_cyclomatic_complexity), ("method_length", "lines", t.max_function_lines)):
        cases.append(report["methods"].select("path", F.concat(F.lit(case + ": "), label).alias("case"), F.col(column).alias("value"), F.lit(most).alias("most")))
    rows = cases[0].unionByName(cases[1]).unionByName(cases[2])
    suites = rows.groupBy("path").agg(F.count("*").alias("tests"), F.count_if(F.col("value") > F.col("most")).alias("failures"), F.sort_array(F.collect_list(F.struct("case", "value", "most"))).alias("cases"))
    file = target / "junit.xml"
    total = suites.agg(F.sum("tests"), F.sum("failures")).first()
    with file.open("w", encoding="utf-8") as f:
        f.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites tests="{total[0] or 0}" failures="{total[1] or 0}">\n')
        for s in suites.orderBy("path").toLocalIterator():
            f.write(f'  <testsuite name={quoteattr(s["path"])} tests="{s["tests"]}" failures="{s["failures"]}">\n')
            for c in s["cases"]:
                head = f"    <testcase classname={quoteattr(s['path'])} name={quoteattr(c['case'])}"
                f.write(head + (f"><failure message={quoteattr(f'{c["value"]} exceeds {c["most"]}')}/></testcase>\n" if c["value"] > c["most"] else "/>\n"))
            f.write("  </testsuite>\n")
        f.write("</testsuites>\n")
    return [file]


def badge_svg(label: str, value: str, colour: str) -> str:
    wide = [20 + round(6.5 * len(x)) for x in (label, value)]
    cell = '<rect x="{x}" width="{w}" height="20" fill="{c}"/><text x="{m}" y="14" fill="#fff" text-anchor="middle" font-family="sans-serif" font-size="11">{t}</text>'
    cells = cell.format(x=0, w=wide[0], c="#555", m=wide[0] / 2, t=escape(label)) + cell.format(x=wide[0], w=wide[1], c=colour, m=wide[0] + wide[1] / 2, t=escape(value))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{sum(wide)}" height="20" role="img">{cells}</svg>\n'


def write_badges(report: Report, folder: str | Path) -> list[Path]:
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    rows = S.badges(report["files"], report["methods"])
    covered = report["coverage"].agg(F.count("*").alias("n"), (F.sum("covered") * 100.0 / F.sum("total")).alias("percent"))
    shown = covered.filter("n > 0").select(F.lit("coverage").alias("label"), F.format_string("%.1f%%", "percent").alias("value"), M.coverage_colour(F.col("percent")).alias("colour"))
    out = []
    for r in rows.unionByName(shown).collect():
        file = target / f"{r['label'].replace(' ', '-')}.svg"
        file.write_text(badge_svg(r["label"], r["value"], r["colour"]), encoding="utf-8")
        out.append(file)
    return out


SORTS = {"lines": "total_lines", "code": "code_lines", "name": "path", "complexity": "complexity"}


def terminal_text(report: Report, top_n: int = 20, sort: str = "lines") -> str:
    """Totals, languages, and the first files and functions; an unknown sort means lines."""
    totals = next(_rows(report["totals"]))
    methods = report["methods"]
    files = report["files"].join(methods.filter("class_name is not null").groupBy("path").agg(F.max("cyclomatic").alias("complexity")), "path", "left").withColumn("complexity", F.coalesce("complexity", F.lit(0)))
    key = SORTS.get(sort, "total_lines")
    out = ["Repository: " + str(report.root), "  ".join(f"{k}={v}" for k, v in totals.items()), "", "Languages"]
    out += [f"  {r['language']:<16}{r['file_count']:>8}{r['code_lines']:>10}" for r in report["languages"].orderBy(F.desc("file_count"), "language").collect()]
    out += ["", f"Files by {sort if sort in SORTS else 'lines'}"]
    out += [f"  {r['total_lines']:>8}{r['complexity']:>6}  {r['path']}" for r in S.top(files, key, top_n, "path", descending=key != "path").collect()]
    out += ["", "Functions by complexity"]
    out += [f"  {r['cyclomatic']:>6}  {r['path']}:{r['line']} {r['name']}" for r in S.top(methods, "cyclomatic", top_n, "path", "line", "name").collect()]
    return "\n".join([*out, *(f"Note: {p}" for p in report.problems)]) + "\n"


# --- dashboard ----------------------------------------------------------------


def compress(rows: list[dict]) -> str:
    return base64.b64encode(zlib.compress(json.dumps(rows, ensure_ascii=False, separators=(",", ":")).encode(), 9)).decode()


def decompress(chunk: str) -> list[dict]:
    return json.loads(zlib.decompress(base64.b64decode(chunk)))


DASHBOARD_TABLES = ("totals", "files", "classes", "methods", "languages", "modules", "coupling", "coverage", "churn", "commits", "contributors", "branches", "tags", "patterns", "loc_timeline")


def dashboard_page(report: Report) -> str:
    """One page with all chunks, each a compressed table; it sorts, filters and needs no network.

    Raises ValueError where the page would be larger than ``MOST_BYTES``.
    """
    chunks, size = {}, 0
    for name in DASHBOARD_TABLES:
        if name in report:
            chunks[name] = compress(list(_rows(report[name].drop("docstring"))))
            size += len(chunks[name])
            if size > MOST_BYTES:
                raise ValueError(f"the dashboard would exceed {MOST_BYTES} bytes; write tables instead")
    data = "".join(f'<script type="application/octet-stream" id="chunk-{n}">{c}</script>\n' for n, c in chunks.items())
    kinds = json.dumps({a.key: a.sort_type for a in ordering.attributes()})
    return f"""<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(report.root.name or str(report.root))}</title></head>
<body><h1>{html.escape(report.root.name or str(report.root))}</h1><nav id="tabs"></nav><input id="filter" placeholder="filter"><div id="view"></div>
{data}<script>
const kinds = {kinds};
const names = [...document.querySelectorAll('script[id^=chunk-]')].map(s => s.id.slice(6));
async function table(name) {{
  const bytes = Uint8Array.from(atob(document.getElementById('chunk-' + name).textContent), c => c.charCodeAt(0));
  return JSON.parse(await new Response(new Blob([bytes]).stream().pipeThrough(new DecompressionStream('deflate'))).text());
}}
async function show(name, key, down) {{
  let rows = await table(name);
  const wanted = document.getElementById('filter').value.toLowerCase();
  if (wanted) rows = rows.filter(r => Object.values(r).join('').toLowerCase().includes(wanted));
  if (key) rows.sort((a, b) => (down ? -1 : 1) * (typeof a[key] === 'number' ? a[key] - b[key] : String(a[key]).localeCompare(String(b[key]))));
  const view = document.getElementById('view'), t = document.createElement('table');
  view.replaceChildren(t);
  const columns = rows.length ? Object.keys(rows[0]) : [];
  const head = t.insertRow();
  for (const c of columns) {{ const th = document.createElement('th'); th.textContent = c; th.onclick = () => show(name, c, !(down && key === c)); head.append(th); }}
  for (const r of rows.slice(0, 2000)) {{ const tr = t.insertRow(); for (const c of columns) tr.insertCell().textContent = typeof r[c] === 'object' ? JSON.stringify(r[c]) : r[c]; }}
}}
for (const n of names) {{ const b = document.createElement('button'); b.textContent = n; b.onclick = () => show(n); document.getElementById('tabs').append(b); }}
</script></body></html>
"""


def data_uri(file: str | Path) -> str:
    """A file as a data URI, for pages that embed their own assets."""
    kind = mimetypes.guess_type(str(file))[0] or "application/octet-stream"
    return f"data:{kind};base64,{base64.b64encode(Path(file).read_bytes()).decode()}"


def write_dashboard(report: Report, folder: str | Path) -> list[Path]:
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    file = target / "dashboard.html"
    file.write_text(dashboard_page(report), encoding="utf-8")
    return [file]


# --- scripts ------------------------------------------------------------------


def cleanup_script(branches: DataFrame) -> str:
    """A shell script that deletes the branches of category safe; names are quoted."""
    names = [r["name"] for r in branches.filter("category = 'safe'").orderBy("name").select("name").collect()]
    return "#!/bin/sh\nset -e\n" + "".join(f"git branch -d -- {shlex.quote(n)}\n" for n in names)


def precommit_yaml(command: str = "codetide analyse . --fail-on-violations") -> str:
    return f"repos:\n  - repo: local\n    hooks:\n      - id: quality-gates\n        name: quality gates\n        entry: {command}\n        language: system\n        pass_filenames: false\n"


EXPORTERS: dict[str, Callable[[Report, str | Path], list[Path]]] = {"json": write_json, "csv": write_csv, "junit": write_junit, "badges": write_badges, "dashboard": write_dashboard}


def register(name: str, exporter: Callable[[Report, str | Path], list[Path]]) -> None:
    EXPORTERS[name] = exporter
