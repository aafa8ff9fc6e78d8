"""Queries on files, languages, coupling, duplication and text metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats as M, languages as L, text as X
from ..operators import duplication as D, history as H, ordering, rules as R, search as Q, structure as S
from ..operators.carry import uncovered
from . import bridge as B
from .registry import query

PREFIXES = ("The", "To ")


def files(spark, sf_dir):
    counted = B.sources(spark, sf_dir).select("path", "language", "size_bytes", "ordinal", X.loc_counts(F.col("text"), PREFIXES).alias("n"))
    return counted.select("path", "language", "size_bytes", "ordinal", "n.*")


@query("loc_counts", "SELECT path, total_lines, blank_lines, comment_lines, code_lines, CASE WHEN total_lines > 0 THEN comment_lines / total_lines::DOUBLE ELSE 0 END AS comment_ratio FROM v_files")
def loc_counts(spark, sf_dir):
    return files(spark, sf_dir).select("path", "total_lines", "blank_lines", "comment_lines", "code_lines", X.comment_ratio(F.col("comment_lines"), F.col("total_lines")).alias("comment_ratio"))


@query("language_summary", "SELECT * FROM v_languages")
def language_summary(spark, sf_dir):
    return S.language_summary(files(spark, sf_dir))


@query("language_share", "SELECT language, code_lines, CASE WHEN sum(code_lines) OVER () > 0 THEN round_even(code_lines * 100.0::DOUBLE / sum(code_lines) OVER (), 1) ELSE 0 END AS percent FROM v_languages")
def language_share(spark, sf_dir):
    return S.language_share(S.language_summary(files(spark, sf_dir)))


@query("language_bar", "SELECT language, coalesce(nullif(code_lines, 0), total_lines) AS lines FROM v_languages")
def language_bar(spark, sf_dir):
    return S.language_bar(S.language_summary(files(spark, sf_dir)))


@query("module_rollup", "SELECT regexp_replace(path, '/[^/]*$', '') AS module, count(*) AS file_count, CAST(sum(total_lines) AS BIGINT) AS total_lines, CAST(sum(code_lines) AS BIGINT) AS code_lines FROM v_files GROUP BY 1")
def module_rollup(spark, sf_dir):
    return S.module_rollup(files(spark, sf_dir))


@query("directory_sizes", "SELECT regexp_replace(path, '/[^/]*$', '') AS directory, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM v_sources WHERE ordinal % 10 <> 0 GROUP BY 1")
def directory_sizes(spark, sf_dir):
    size = F.when(F.col("ordinal") % 10 == 0, -1).otherwise(F.col("size_bytes"))
    return S.directory_sizes(B.sources(spark, sf_dir).select("path", size.alias("size")))


@query("repo_summary", "SELECT count(*) AS total_files, CAST(sum(total_lines) AS BIGINT) AS total_lines, CAST(sum(code_lines) AS BIGINT) AS code_lines, CAST(sum(blank_lines) AS BIGINT) AS blank_lines, CAST(sum(comment_lines) AS BIGINT) AS comment_lines, count(DISTINCT language) AS languages FROM v_files")
def repo_summary(spark, sf_dir):
    return S.repo_totals(files(spark, sf_dir))


@query("avg_cc", "SELECT path, avg(cyclomatic) AS average_cc FROM v_methods GROUP BY path")
def avg_cc(spark, sf_dir):
    return S.average_cc(B.methods(spark, sf_dir), "path")


@query("all_methods", "SELECT path, name, cyclomatic, NULL AS class_name FROM v_methods WHERE parameters = 1 UNION ALL SELECT path, name, cyclomatic, class_name FROM v_methods WHERE parameters > 1")
def all_methods(spark, sf_dir):
    columns = ("path", "name", "cyclomatic")
    methods = B.methods(spark, sf_dir)
    return S.all_methods(methods.filter("parameters = 1").select(*columns), methods.filter("parameters > 1").select(*columns, "class_name"))


@query("imports_distinct", "SELECT module AS path, string_agg(DISTINCT CAST(imported_module AS VARCHAR), ',' ORDER BY CAST(imported_module AS VARCHAR)) AS imports FROM v_imports GROUP BY module")
def imports_distinct(spark, sf_dir):
    named = B.imports(spark, sf_dir).select(F.col("module").alias("path"), F.col("imported_module").cast("string").alias("imported"))
    return S.distinct_imports(named).select("path", F.array_join("imports", ",").alias("imports"))


_ABSTRACT = "SELECT path AS module, count(*) AS classes, round_even(count(*) FILTER (WHERE class_name = 'Class1' OR nesting = 2) / count(*)::DOUBLE, 3) AS abstractness FROM v_methods GROUP BY path"


def _classes(spark, sf_dir):
    name = F.when(F.col("class_name") == "Class1", F.concat(F.lit("Abstract"), F.col("class_name"))).otherwise(F.col("class_name"))
    bases = F.when(F.col("nesting") == 2, F.array(F.lit("abc.ABC"))).otherwise(F.array(F.lit("Base")))
    return B.methods(spark, sf_dir).select(F.col("path").alias("module"), name.alias("name"), bases.alias("bases"))


@query("abstractness", _ABSTRACT)
def abstractness(spark, sf_dir):
    return S.abstractness(_classes(spark, sf_dir))


@query(
    "coupling",
    """WITH edges AS (SELECT DISTINCT module, imported_module FROM v_imports WHERE module <> imported_module), modules AS (SELECT n_nationkey AS module FROM nation),
    counted AS (SELECT m.module, (SELECT count(*) FROM edges e WHERE e.imported_module = m.module) AS afferent, (SELECT count(*) FROM edges e WHERE e.module = m.module) AS efferent, CASE WHEN m.module % 4 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS a FROM modules m),
    rated AS (SELECT *, CASE WHEN afferent + efferent > 0 THEN efferent / (afferent + efferent)::DOUBLE ELSE 0.0::DOUBLE END AS i FROM counted)
    SELECT module, afferent, efferent, round_even(i, 3) AS instability, round_even(a, 3) AS abstractness, round_even(abs(a + i - 1), 3) AS distance FROM rated""",
)
def coupling(spark, sf_dir):
    modules = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("module"))
    abstract = modules.filter("module % 4 = 0").select("module", F.lit(0.5).alias("abstractness"))
    return S.coupling(modules, B.imports(spark, sf_dir), abstract)


@query(
    "import_edges",
    """WITH parts AS (SELECT ordinal, regexp_replace(path, '/[^/]*$', '') AS module, split_part(path, '/', 1) AS folder, regexp_replace(split_part(path, '/', 2), '\\.[^.]*$', '') AS stem FROM v_sources),
    names AS (SELECT name, arg_max(module, ordinal) AS module FROM (SELECT ordinal, module, folder AS name FROM parts UNION ALL SELECT ordinal, module, stem FROM parts) GROUP BY name)
    SELECT DISTINCT p.module, n.module AS imported_module FROM parts p JOIN names n ON n.name = 'doc' || CAST(p.ordinal * 7 % 1000 AS VARCHAR) WHERE p.module <> n.module""".replace("\\\\", "\\"),
)
def import_edges(spark, sf_dir):
    sources = B.sources(spark, sf_dir)
    imported = sources.select("path", F.concat(F.lit("doc"), (F.col("ordinal") * 7 % 1000).cast("string")).alias("imported"))
    return S.import_edges(imported, S.import_map(sources))


@query("hotspot_join", "SELECT c.path, commit_count, churn_score, coalesce(nullif(m.cc, 0), churn_score, 0) AS complexity FROM v_churn c LEFT JOIN (SELECT path, max(cyclomatic) AS cc FROM v_methods WHERE nesting <> 3 GROUP BY path) m ON c.path = m.path")
def hotspot_join(spark, sf_dir):
    return S.hotspots(H.file_churn(B.changes(spark, sf_dir)), B.methods(spark, sf_dir).filter("nesting <> 3"))


_LANGS = "SELECT path, size_bytes, total_lines, code_lines, blank_lines, comment_lines, CASE language WHEN 'en' THEN 'markdown' WHEN 'de' THEN 'json' ELSE language END AS language FROM v_files"


def _mixed_files(spark, sf_dir):
    language = F.when(F.col("language") == "en", "markdown").when(F.col("language") == "de", "json").otherwise(F.col("language"))
    return files(spark, sf_dir).withColumn("language", language)


@query("nonlang_split", f"SELECT language, count(*) AS file_count, CAST(sum(total_lines) AS BIGINT) AS total_lines, language NOT IN ('markdown', 'json') AS is_language FROM ({_LANGS}) GROUP BY language")
def nonlang_split(spark, sf_dir):
    return S.split_languages(S.language_summary(_mixed_files(spark, sf_dir))).select("language", "file_count", "total_lines", "is_language")


@query("ext_counts", f"SELECT '.' || list_extract(string_split(path, '.'), -1) AS ext, language, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM ({_LANGS}) WHERE language IN ('markdown', 'json') GROUP BY ALL")
def ext_counts(spark, sf_dir):
    return S.extension_counts(_mixed_files(spark, sf_dir), languages=False)


@query("ext_language_counts", f"SELECT '.' || list_extract(string_split(path, '.'), -1) AS ext, language, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM ({_LANGS}) WHERE language NOT IN ('markdown', 'json') GROUP BY ALL")
def ext_language_counts(spark, sf_dir):
    return S.extension_counts(_mixed_files(spark, sf_dir), languages=True)


@query("top_files", "SELECT path, total_lines, code_lines FROM v_files ORDER BY total_lines DESC, path LIMIT 20")
def top_files(spark, sf_dir):
    return S.top(files(spark, sf_dir).select("path", "total_lines", "code_lines"), "total_lines", 20, "path")


@query("top_methods", "SELECT path, name, line, cyclomatic FROM v_methods ORDER BY cyclomatic DESC, path, name, line LIMIT 20")
def top_methods(spark, sf_dir):
    return S.top(B.methods(spark, sf_dir).select("path", "name", "line", "cyclomatic"), "cyclomatic", 20, "path", "name", "line")


@query(
    "badges",
    """WITH t AS (SELECT (SELECT CAST(sum(total_lines) AS BIGINT) FROM v_files) AS lines, (SELECT count(*) FROM v_files) AS files, (SELECT count(DISTINCT language) FROM v_files) AS languages, (SELECT avg(cyclomatic) FROM v_methods) AS cc)
    SELECT 'lines of code' AS label, CASE WHEN lines >= 1000000 THEN printf('%.1fM', lines / 1000000.0::DOUBLE) WHEN lines >= 1000 THEN printf('%.1fK', lines / 1000.0::DOUBLE) ELSE CAST(lines AS VARCHAR) END AS value, '#007ec6' AS colour FROM t
    UNION ALL SELECT 'files', CASE WHEN files >= 1000000 THEN printf('%.1fM', files / 1000000.0::DOUBLE) WHEN files >= 1000 THEN printf('%.1fK', files / 1000.0::DOUBLE) ELSE CAST(files AS VARCHAR) END, '#007ec6' FROM t
    UNION ALL SELECT 'languages', CAST(languages AS VARCHAR), '#007ec6' FROM t
    UNION ALL SELECT 'avg complexity', printf('%.1f', cc), CASE WHEN cc <= 5 THEN '#4c1' WHEN cc <= 10 THEN '#a4a61d' WHEN cc <= 20 THEN '#dfb317' ELSE '#e05d44' END FROM t""",
)
def badges(spark, sf_dir):
    return S.badges(files(spark, sf_dir), B.methods(spark, sf_dir))


@query(
    "junit_counts",
    """WITH cases AS (SELECT path, commit_count > 40 AS failed FROM v_churn UNION ALL SELECT path, cyclomatic > 10 FROM v_methods UNION ALL SELECT path, lines > 45 FROM v_methods)
    SELECT path, count(*) AS tests, count(*) FILTER (WHERE failed) AS failures FROM cases GROUP BY ROLLUP (path)""",
)
def junit_counts(spark, sf_dir):
    sized = H.file_churn(B.changes(spark, sf_dir)).select("path", F.col("commit_count").alias("total_lines"))
    return S.junit_counts(sized, B.methods(spark, sf_dir), 40, 10, 45)


@query("row_search", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE contains(lower(CAST(n_nationkey AS VARCHAR) || n_name || CAST(n_regionkey AS VARCHAR)), 'tion_1')")
def row_search(spark, sf_dir):
    return S.search_rows(B.table(spark, sf_dir, "nation"), "Tion_1")


@query("typed_sort", "SELECT o_orderkey, coalesce(TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE), 0) AS key FROM orders ORDER BY key DESC, o_orderkey")
def typed_sort(spark, sf_dir):
    raw = B.table(spark, sf_dir, "orders").select(F.substring_index("o_orderpriority", "-", 1).alias("text"), "o_orderkey")
    return S.typed_order(raw.select("o_orderkey", "text"), "text", "float", True).select("o_orderkey", F.coalesce(F.col("text").try_cast("double"), F.lit(0.0)).alias("key"))


def _catalogue_sql() -> str:
    rows = (f"('{a.key}', '{a.label}', '{a.sort_type}', '{a.entity}', {a.default_descending})" for a in ordering.attributes())
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(key, label, sort_type, entity, default_descending)"


@query("sort_schema", _catalogue_sql())
def sort_schema(spark, sf_dir):
    return ordering.catalogue(spark)


# --- text metrics -------------------------------------------------------------


def _regex_count(pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all(text, '{flags}{pattern}'))"


@query("todo_count", "SELECT path, " + _regex_count(r"\b(?:TODO|FIXME|HACK|XXX|BUG)\b", "(?i)") + " AS todos FROM v_sources")
def todo_count(spark, sf_dir):
    return B.sources(spark, sf_dir).select("path", X.todo_count(F.col("text")).alias("todos"))


@query("cyclomatic", "SELECT path, 1 + " + _regex_count(X.CYCLOMATIC) + " AS cyclomatic FROM v_code")
def cyclomatic(spark, sf_dir):
    return B.code(spark, sf_dir).select("path", X.cyclomatic(F.col("text")).alias("cyclomatic"))


_CODE_LINES = """parts AS (SELECT path, string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS parts FROM v_code WHERE text <> ''),
    lines AS (SELECT path, unnest(parts) AS text, unnest(range(1, len(parts) + 1)) AS pos FROM parts)"""


@query(
    "cognitive",
    f"""WITH {_CODE_LINES}, steps AS (SELECT *, sum(length(regexp_replace(text, '[^{{]', '', 'g')) - length(regexp_replace(text, '[^}}]', '', 'g'))) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM lines),
    deep AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS depth FROM steps)
    SELECT c.path, CAST(coalesce(sum({_regex_count(X.COGNITIVE).replace('text', 'd.text')} * (1 + depth) + {_regex_count(X.ELSE).replace('text', 'd.text')} + CASE WHEN regexp_matches(d.text, '{X.BOOLEAN}') THEN 1 ELSE 0 END), 0) AS BIGINT) AS cognitive FROM v_code c LEFT JOIN deep d ON c.path = d.path GROUP BY c.path""",
)
def cognitive(spark, sf_dir):
    return B.code(spark, sf_dir).select("path", X.cognitive(F.col("text")).alias("cognitive"))


@query(
    "nesting_depth",
    """WITH braces AS (SELECT path, unnest(regexp_extract_all(text, '[{}]')) AS brace, unnest(range(1, len(regexp_extract_all(text, '[{}]')) + 1)) AS pos FROM v_code),
    steps AS (SELECT *, sum(CASE brace WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM braces),
    deep AS (SELECT path, s - least(0, min(s) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS depth FROM steps)
    SELECT c.path, CAST(coalesce(max(depth), 0) AS BIGINT) AS nesting_depth FROM v_code c LEFT JOIN deep d ON c.path = d.path GROUP BY c.path""",
)
def nesting_depth(spark, sf_dir):
    return B.code(spark, sf_dir).select("path", X.nesting_depth(F.col("text")).alias("nesting_depth"))


@query(
    "halstead",
    f"""WITH t AS (SELECT path, regexp_extract_all(text, '{X.OPERATORS}') AS ops, regexp_extract_all(text, '{X.OPERANDS}') AS opr FROM v_code),
    c AS (SELECT path, len(list_distinct(ops)) AS n1, len(list_distinct(opr)) AS n2, len(ops) AS total_n1, len(opr) AS total_n2 FROM t),
    v AS (SELECT *, n1 + n2 AS vocabulary, total_n1 + total_n2 AS length, CASE WHEN n2 > 0 THEN (n1 / 2.0::DOUBLE) * (total_n2 / n2::DOUBLE) ELSE 0.0::DOUBLE END AS difficulty FROM c)
    SELECT path, n1, n2, total_n1, total_n2, vocabulary, length, round(CASE WHEN vocabulary > 0 THEN length * log2(vocabulary) ELSE 0 END, 4) AS volume, round(difficulty, 4) AS difficulty FROM v""",
)
def halstead(spark, sf_dir):
    measures = X.halstead(F.col("text"))
    rounded = {k: F.round(c, 4) if k in ("volume", "difficulty") else c for k, c in measures.items() if k != "effort"}
    return B.code(spark, sf_dir).select("path", *(c.alias(k) for k, c in rounded.items()))


_WINDOWS = "normal AS (SELECT path, lower(line) AS line, row_number() OVER (PARTITION BY path ORDER BY pos) AS line_no FROM v_lines WHERE line <> ''), windows AS (SELECT path, line_no, string_agg(line, chr(10)) OVER w AS block, count(*) OVER w AS k FROM normal WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)), full_windows AS (SELECT path, line_no, block FROM windows WHERE k = 6)"
_PAIRS = "SELECT a.path AS file_a, a.line_no AS line_a, b.path AS file_b, b.line_no AS line_b, CAST(6 AS BIGINT) AS length FROM full_windows a JOIN full_windows b ON a.block = b.block AND (a.path < b.path OR (a.path = b.path AND a.line_no + 6 <= b.line_no))"


@query("duplicate_blocks", f"WITH {_WINDOWS} {_PAIRS}")
def duplicate_blocks(spark, sf_dir):
    return D.duplicate_blocks(B.sources(spark, sf_dir))


@query("duplication_ratio", f"WITH {_WINDOWS}, pairs AS ({_PAIRS}) SELECT (SELECT count(*) FROM pairs) * 6 AS duplicated_lines, (SELECT count(*) FROM pairs) * 6 / (SELECT count(*) FROM normal)::DOUBLE AS ratio")
def duplication_ratio(spark, sf_dir):
    return D.duplication_ratio(B.sources(spark, sf_dir))


# --- look-ups and escapes -----------------------------------------------------

_NAMES = ("main.py", "lib.java", "Makefile", "x.unknown", "a.m", "Dockerfile", "page.html", "deep/dir/mod.ts", "README", ".hidden", "archive.tar.gz", "run.R")
_LANG_OF = ("python", "java", "makefile", "generic", "objectivec", "dockerfile", "html", "typescript", "generic", "generic", "generic", "r")
_NAMES_SQL = "list_extract([" + ", ".join(f"'{n}'" for n in _NAMES) + f"], CAST(p_partkey % {len(_NAMES)} AS BIGINT) + 1)"
_LANG_SQL = "list_extract([" + ", ".join(f"'{n}'" for n in _LANG_OF) + f"], CAST(p_partkey % {len(_NAMES)} AS BIGINT) + 1)"


def _named(spark, sf_dir, names):
    return B.table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int")).alias("path"))


@query("lang_dispatch", f"SELECT p_partkey, {_NAMES_SQL} AS path, {_LANG_SQL} AS language FROM part")
def lang_dispatch(spark, sf_dir):
    return _named(spark, sf_dir, _NAMES).select("p_partkey", "path", L.language_of(F.col("path")).alias("language"))


_PATHS = ("src/a.py", "node_modules/x/i.js", "img/logo.PNG", "venv/bin/run.py", "a/.git/config", "docs/readme.md", "build/out.pyc", "Thumbs.db", "src/node_modules.py")


@query("scan_exclude", "SELECT p_partkey, list_extract([" + ", ".join(f"'{n}'" for n in _PATHS) + f"], CAST(p_partkey % {len(_PATHS)} AS BIGINT) + 1) AS path FROM part WHERE p_partkey % {len(_PATHS)} IN (0, 5, 8)")
def scan_exclude(spark, sf_dir):
    return _named(spark, sf_dir, _PATHS).filter(~L.excluded(F.col("path")))


@query("teamcity_escape", "SELECT conv_id, turn, replace(replace(replace(replace(replace(replace(text, '|', '||'), '''', '|'''), chr(10), '|n'), chr(13), '|r'), '[', '|['), ']', '|]') AS escaped FROM conversations")
def teamcity_escape(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", M.teamcity_escape(F.col("text")).alias("escaped"))


_GATES = "(" + " UNION ALL ".join(f"SELECT '{r}' AS rule, '{s}' AS severity, path, line, name, {c}::DOUBLE AS value, {float(getattr(R.Thresholds(), r))}::DOUBLE AS threshold FROM v_methods WHERE {c} > {getattr(R.Thresholds(), r)}" for r, c, s in R.METHOD_GATES) + ")"


@query("gate_violations", f"SELECT * FROM {_GATES}")
def gate_violations(spark, sf_dir):
    return R.gate_violations(B.methods(spark, sf_dir))


def _gate_sql(view: str, gates: list[tuple[str, str, str]], path: str = "path", line: str = "0", name: str = "''") -> str:
    t = R.Thresholds()
    rows = (f"SELECT '{r}' AS rule, '{s}' AS severity, {path} AS path, CAST({line} AS BIGINT) AS line, {name} AS name, ({c})::DOUBLE AS value, {float(getattr(t, r))}::DOUBLE AS threshold FROM {view} WHERE ({c}) {'<' if r.startswith('min_') else '>'} {getattr(t, r)}" for r, c, s in gates)
    return " UNION ALL ".join(rows)


@query(
    "gate_violations_all",
    f"SELECT * FROM {_GATES} UNION ALL " + _gate_sql("v_file_sizes", [("max_file_lines", "total_lines", "warning"), ("max_imports", "imports", "warning")])
    + " UNION ALL " + _gate_sql("v_classes", [("max_class_lines", "lines", "warning"), ("max_class_methods", "methods", "warning")], line="line", name="name")
    + " UNION ALL " + _gate_sql("v_ratios", [("max_duplication_pct", "duplication * 100.0::DOUBLE", "error"), ("min_test_coverage", "coverage * 100.0::DOUBLE", "error")], path="''"),
)
def gate_violations_all(spark, sf_dir):
    return R.gate_violations(B.methods(spark, sf_dir), B.file_sizes(spark, sf_dir), B.classes(spark, sf_dir), B.ratios(spark, sf_dir))


@query("gate_counts", f"SELECT rule, severity, count(*) AS n FROM {_GATES} GROUP BY rule, severity")
def gate_counts(spark, sf_dir):
    return R.gate_counts(R.gate_violations(B.methods(spark, sf_dir)))


@query("delta_semi", f"SELECT * FROM {_GATES} WHERE path IN (SELECT path FROM v_changes WHERE sha IN (SELECT sha FROM v_commits WHERE authored_ts >= (SELECT max(authored_ts) FROM v_commits) - INTERVAL 2 DAY))")
def delta_semi(spark, sf_dir):
    commits = B.commits(spark, sf_dir)
    newest = commits.agg((F.max("authored_ts") - F.expr("interval 2 days")).alias("since"))  # one row
    recent = commits.join(F.broadcast(newest), F.col("authored_ts") >= F.col("since")).select("sha")
    return R.delta_violations(R.gate_violations(B.methods(spark, sf_dir)), B.changes(spark, sf_dir).join(recent, "sha", "left_semi"))


@query("gitlab_fingerprint", f"SELECT rule, path, greatest(line, 1) AS line, md5(rule || ':' || path || ':' || CAST(line AS VARCHAR)) AS fingerprint, CASE severity WHEN 'error' THEN 'major' WHEN 'warning' THEN 'minor' ELSE 'info' END AS severity FROM {_GATES}")
def gitlab_fingerprint(spark, sf_dir):
    from ..sinks.ci import gitlab_issues

    return gitlab_issues(R.gate_violations(B.methods(spark, sf_dir))).select("rule", "path", "line", "fingerprint", "severity")


@query("annotations", f"SELECT '::' || CASE severity WHEN 'error' THEN 'error' ELSE 'warning' END || ' file=' || path || CASE WHEN line > 0 THEN ',line=' || CAST(line AS VARCHAR) ELSE '' END || ',title=' || rule || '::' || name || ' is ' || CAST(CAST(value AS BIGINT) AS VARCHAR) || ', limit ' || CAST(CAST(threshold AS BIGINT) AS VARCHAR) AS annotation FROM {_GATES}")
def annotations(spark, sf_dir):
    from ..sinks.ci import github_annotations

    return github_annotations(R.gate_violations(B.methods(spark, sf_dir)))


@query(
    "range_anti",
    "SELECT f.path, f.line FROM (SELECT path, line FROM v_methods WHERE parameters > 2) f WHERE NOT EXISTS (SELECT 1 FROM v_methods c WHERE c.path = f.path AND c.parameters = 1 AND f.line BETWEEN c.line AND c.line + c.lines)",
)
def range_anti(spark, sf_dir):
    methods = B.methods(spark, sf_dir)
    regions = methods.filter("parameters = 1").select("path", F.col("line").alias("first"), (F.col("line") + F.col("lines")).alias("last"))
    return uncovered(methods.filter("parameters > 2").select("path", "line"), regions, "path", "line", "first", "last")


@query("document_search", "SELECT doc_id, lang FROM documents WHERE contains(lower(lang || text), 'thent')")
def document_search(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return Q.search(docs, Q.index(docs, "doc_id", "lang", "text"), "doc_id", "THent", "lang", "text").select("doc_id", "lang")


@query("pattern_join", """WITH names AS (SELECT DISTINCT path AS name FROM v_changes), patterns AS (SELECT CASE p_partkey % 3 WHEN 0 THEN '*/file' || CAST(p_partkey AS VARCHAR) || '.*' WHEN 1 THEN 'pkg?/file' || CAST(p_partkey AS VARCHAR) || '*.[pj]?' ELSE 'pkg' || CAST(p_partkey AS VARCHAR) || '/*.md' END AS pattern FROM part)
    SELECT name, pattern FROM names JOIN (SELECT DISTINCT pattern FROM patterns) ON name GLOB pattern""")
def pattern_join(spark, sf_dir):
    return Q.matches(B.changes(spark, sf_dir), B.patterns(spark, sf_dir), "path")
