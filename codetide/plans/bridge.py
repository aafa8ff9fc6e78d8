"""Repository entities made from star-schema tables, once with Spark and once in SQL.

Orders act as commits, line items as file changes and methods, events as
activity, documents as files, pages as source code, customers as branches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

NOW = "2001-08-15 12:00:00"

# Commit messages by order key; shared by both forms of the view.
MESSAGES = ("Merge branch dev", "fixup! tidy up", 'Revert "feat: x"', "wip: half done", "feat(core): add parser", "fix: off by one", "short", 'Revert "Revert "feat: x""', "docs: describe the limits", "squash! more of it", "Update the build", "refactor(api)!: drop a field")
EVENT_MESSAGES = {"view": "Merge branch dev", "signup": "merge of main", "click": "short", "error": "tiny", "purchase": "docs: describe the limits"}
SUFFIXES = ("py", "js", "java", "md", "png")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key, values: tuple[str, ...]):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _pick_sql(key: str, values: tuple[str, ...]) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{quoted}], CAST({key} % {len(values)} AS BIGINT) + 1)"


def _path(key):
    return F.concat(F.lit("pkg"), (key % 20).cast("string"), F.lit("/file"), key.cast("string"), F.lit("."), _pick(key, SUFFIXES))


_PATH_SQL = "'pkg' || CAST({k} % 20 AS VARCHAR) || '/file' || CAST({k} AS VARCHAR) || '.' || " + _pick_sql("{k}", SUFFIXES)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    hours = lambda n: F.make_dt_interval(F.lit(0), (key % n).cast("int"))
    at = F.col("o_orderdate") + hours(24)
    return table(spark, sf_dir, "orders").select(
        key.alias("sha"), F.concat(F.lit("Author "), (F.col("o_custkey") % 500).cast("string")).alias("author_name"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@example.org")).alias("author_email"), at.alias("authored_ts"), (at + hours(40)).alias("committed_ts"),
        F.concat(_pick(key, MESSAGES), F.lit("\n"), F.col("o_orderpriority")).alias("message"), key.alias("ordinal"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sha"), _path(F.col("l_partkey")).alias("path"), F.col("l_quantity").cast("long").alias("insertions"), F.round(F.col("l_discount") * 100).cast("long").alias("deletions"),
    )


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a history of merges, short messages and work on weekends: Mondays move to the Sunday before."""
    at = F.col("ts") - F.when(F.weekday("ts") == 0, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day"))
    message = F.element_at(F.create_map(*(F.lit(x) for pair in EVENT_MESSAGES.items() for x in pair)), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sha"), F.concat(F.lit("Author "), F.col("user_id").cast("string")).alias("author_name"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("author_email"),
        at.alias("authored_ts"), at.alias("committed_ts"), message.alias("message"), F.col("event_id").alias("ordinal"),
    )


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change for each event; three kinds of events share a path."""
    path = F.concat(F.lit("pkg/"), F.when(F.col("event_type").isin("view", "signup", "click"), "core.py").otherwise(F.concat("event_type", F.lit(".py"))))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("sha"), path.alias("path"), F.lit(1).cast("long").alias("insertions"), F.lit(0).cast("long").alias("deletions"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = methods(spark, sf_dir).groupBy("path", F.col("class_name").alias("name"))
    return own.agg(F.min("line").alias("line"), F.sum("lines").alias("lines"), F.count("*").alias("methods"))


def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files by their price and lines."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("path"), F.floor(F.col("o_totalprice") / 500).cast("long").alias("total_lines"), (F.col("o_custkey") % 20).alias("imports"))


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: labels stand for repeated and for covered code."""
    return table(spark, sf_dir, "labels").agg(F.avg(F.col("toxic").cast("double")).alias("duplication"), F.avg(F.col("quality").cast("double")).alias("coverage"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("sha"), F.col("user_id").alias("author_email"), F.col("ts").alias("authored_ts"), F.col("event_id").alias("ordinal"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; characters beyond ASCII become spaces, so that all engines agree on words."""
    folded = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("path"), folded.alias("text"), F.col("lang").alias("language"), F.col("n_chars").alias("size_bytes"), F.col("doc_id").alias("ordinal"),
    )


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.regexp_replace("html", r"[^\x00-\x7F]", " ").alias("text"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        _path(F.col("l_partkey")).alias("path"), F.concat(F.lit("Class"), (F.col("l_suppkey") % 3).cast("string")).alias("class_name"), F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("name"),
        (F.col("l_linenumber") * 10).cast("long").alias("line"), F.col("l_quantity").cast("long").alias("lines"), (F.col("l_suppkey") % 14).cast("long").alias("cyclomatic"),
        (F.round(F.col("l_tax") * 100) * 3).cast("long").alias("cognitive"), F.col("l_linenumber").cast("long").alias("parameters"), (F.col("l_partkey") % 7).cast("long").alias("nesting"),
    )


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("c_custkey") % 50 == 0, F.concat(F.lit("release/"), F.col("c_name"))).otherwise(F.col("c_name"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_commit"), (F.count("*") % 5).alias("ahead"))
    return orders.join(table(spark, sf_dir, "customer"), "c_custkey").select(named.alias("name"), "last_commit", "ahead", (F.col("c_mktsegment") == "BUILDING").alias("merged"))


def blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), (F.col("l_suppkey") % 9).alias("author"), F.col("l_shipdate").alias("ts"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (key % 10).cast("string"), F.lit("."), (key % 7).cast("string"), F.when(F.col("p_type").startswith("ECONOMY"), "-rc1").otherwise(""), F.when(key % 11 == 0, " draft").otherwise(""))
    return table(spark, sf_dir, "part").select(key.alias("ordinal"), name.alias("name"))


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("hits"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(F.col("source").alias("path"), F.coalesce("hits", F.lit(0)).alias("hits"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose customers bought from suppliers of other nations."""
    picked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    bought = picked.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    bought = bought.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return bought.select(F.col("c_nationkey").alias("module"), F.col("s_nationkey").alias("imported_module"))


def graph_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits of a graph: ``(node, branch, at, tree)``."""
    tree = F.concat("o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyyMM"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("branch"), F.col("o_orderdate").alias("at"), tree.alias("tree"), F.col("o_orderpriority").alias("priority"))


def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node, parent)``: a customer's orders are a branch of the customer with a fourth of the key.

    A branch begins at the latest commit of that branch, urgent orders merge it in again, and
    high ones merge the latest commit of the branches that began at their own.
    """
    rows = graph_commits(spark, sf_dir)
    own = rows.select("node", F.lag("node").over(W.partitionBy("branch").orderBy("at", "node")).alias("parent"), "branch", "at", "priority")
    stems = F.array(F.struct(F.col("branch").alias("stem"), F.lit(True).alias("is_stem")), F.when(F.col("branch") > 0, F.struct(F.floor(F.col("branch") / 4).alias("stem"), F.lit(False).alias("is_stem"))))
    met = own.select("node", "parent", "at", "priority", F.explode(F.array_compact(stems)).alias("s")).select("node", "parent", "at", "priority", "s.*")
    order = W.partitionBy("stem").orderBy("at", "node").rowsBetween(W.unboundedPreceding, -1)
    met = met.withColumn("of_stem", F.last(F.when(F.col("is_stem"), F.col("node")), ignorenulls=True).over(order)).withColumn("of_twig", F.last(F.when(~F.col("is_stem"), F.col("node")), ignorenulls=True).over(order))
    # All links come from one pass over the two orders: a commit's own parent, what it merges, and what it forks from.
    merges = F.when(F.col("priority") == "2-HIGH", F.array("parent", "of_twig")).otherwise(F.array("parent"))
    forks = F.when(F.col("parent").isNull() | (F.col("priority") == "1-URGENT"), F.array("of_stem"))
    return met.select("node", F.explode(F.when(F.col("is_stem"), merges).otherwise(forks)).alias("parent"))


def graph_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tip, node)``: the last commit of each branch."""
    rows = graph_commits(spark, sf_dir)
    return rows.groupBy(F.col("branch").alias("tip")).agg(F.max(F.struct("at", "node"))["node"].alias("node"))


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One LCOV trace: a record for each order, without an end or with an early one for some."""
    orders, place = table(spark, sf_dir, "orders"), F.col("o_orderkey") * 32
    heads = orders.select(place.alias("position"), F.concat(F.lit("SF:src/c"), F.col("o_custkey").cast("string")).alias("line"))
    ends = orders.filter("o_orderpriority <> '5-LOW'").select((place + F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", 5).otherwise(31)).alias("position"), F.lit("end_of_record").alias("line"))
    hits = F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_quantity").cast("long"))
    body = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 32 + F.col("l_linenumber") * 2).alias("position"), F.concat(F.lit("DA:"), F.col("l_linenumber").cast("string"), F.lit(","), hits.cast("string")).alias("line"))
    rows = heads.unionByName(ends).unionByName(body)
    return rows.select(F.lit("trace").alias("path"), F.floor(F.col("position") / (1 << 17)).alias("block"), "position", "line")


def porcelain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blame of parts: a line for each of a part's line items; a header names its author only at the first line of an order."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))
    key, number, supplier = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey").cast("string")
    said = F.when(number == 1, F.array(F.concat(F.lit("author A "), supplier), F.concat(F.lit("author-mail <a"), supplier, F.lit("@x>")), F.concat(F.lit("author-time "), (key * 1000).cast("string")))).otherwise(F.array().cast("array<string>"))
    head = F.concat(F.lpad(F.lower(F.hex(key)), 40, "0"), F.lit(" 1 "), (key * 8 + number).cast("string"), F.lit(" 1"))
    rows = items.select(F.col("l_partkey").alias("path"), (key * 64 + number * 8).alias("at"), F.posexplode(F.concat(F.array(head), said, F.array(F.lit("\tcode")))).alias("k", "line"))
    return rows.select("path", F.floor(F.col("at") / (1 << 12)).alias("block"), (F.col("at") + F.col("k")).alias("position"), "line")


def run_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("path"), F.col("l_returnflag").alias("run"), F.col("l_orderkey").alias("line"))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shell pattern for each part: its file in any folder, all files of a number's start, or a suffix."""
    key = F.col("p_partkey").cast("string")
    kinds = (F.concat(F.lit("*/file"), key, F.lit(".*")), F.concat(F.lit("pkg?/file"), key, F.lit("*.[pj]?")), F.concat(F.lit("pkg"), key, F.lit("/*.md")))
    return table(spark, sf_dir, "part").select(F.element_at(F.array(*kinds), (F.col("p_partkey") % 3 + 1).cast("int")).alias("pattern"))


VIEWS = {
    "v_commits": "SELECT o_orderkey AS sha, 'Author ' || CAST(o_custkey % 500 AS VARCHAR) AS author_name, 'u' || CAST(o_custkey AS VARCHAR) || '@example.org' AS author_email, o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS authored_ts, o_orderdate + to_hours(CAST(o_orderkey % 24 + o_orderkey % 40 AS BIGINT)) AS committed_ts, " + _pick_sql("o_orderkey", MESSAGES) + " || chr(10) || o_orderpriority AS message, o_orderkey AS ordinal FROM orders",
    "v_changes": "SELECT l_orderkey AS sha, " + _PATH_SQL.format(k="l_partkey") + " AS path, CAST(l_quantity AS BIGINT) AS insertions, CAST(round(l_discount * 100) AS BIGINT) AS deletions FROM lineitem",
    "v_totals": "SELECT c.*, coalesce(s.insertions, 0) AS insertions, coalesce(s.deletions, 0) AS deletions, coalesce(s.files, 0) AS files FROM v_commits c LEFT JOIN (SELECT sha, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions, count(*) AS files FROM v_changes GROUP BY sha) s ON c.sha = s.sha",
    "v_event_commits": "SELECT event_id AS sha, 'Author ' || CAST(user_id AS VARCHAR) AS author_name, 'u' || CAST(user_id AS VARCHAR) || '@example.org' AS author_email, moved AS authored_ts, moved AS committed_ts, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_MESSAGES.items()) + " END AS message, event_id AS ordinal FROM (SELECT *, CASE WHEN isodow(ts) = 1 THEN ts - INTERVAL 1 DAY ELSE ts END AS moved FROM events)",
    "v_event_changes": "SELECT event_id AS sha, 'pkg/' || CASE WHEN event_type IN ('view', 'signup', 'click') THEN 'core.py' ELSE event_type || '.py' END AS path, CAST(1 AS BIGINT) AS insertions, CAST(0 AS BIGINT) AS deletions FROM events",
    "v_event_totals": "SELECT c.*, coalesce(s.insertions, 0) AS insertions, coalesce(s.deletions, 0) AS deletions, coalesce(s.files, 0) AS files FROM v_event_commits c LEFT JOIN (SELECT sha, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions, count(*) AS files FROM v_event_changes GROUP BY sha) s ON c.sha = s.sha",
    "v_classes": "SELECT path, class_name AS name, min(line) AS line, sum(lines) AS lines, count(*) AS methods FROM v_methods GROUP BY path, class_name",
    "v_file_sizes": "SELECT 'order' || CAST(o_orderkey AS VARCHAR) AS path, CAST(floor(o_totalprice / 500) AS BIGINT) AS total_lines, o_custkey % 20 AS imports FROM orders",
    "v_ratios": "SELECT avg(toxic::DOUBLE) AS duplication, avg(quality::DOUBLE) AS coverage FROM labels",
    "v_activity": "SELECT event_id AS sha, user_id AS author_email, ts AS authored_ts, event_id AS ordinal FROM events",
    "v_sources": "SELECT source || '/doc' || CAST(doc_id AS VARCHAR) || '.' || lang AS path, regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') AS text, lang AS language, n_chars AS size_bytes, doc_id AS ordinal FROM documents",
    "v_lines": "SELECT path, language, size_bytes, ordinal, trim(line, ' ' || chr(9) || chr(13)) AS line, pos FROM (SELECT path, language, size_bytes, ordinal, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT *, string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS parts FROM v_sources WHERE text <> ''))",
    "v_graph_commits": "SELECT o_orderkey AS node, o_custkey AS branch, o_orderdate AS made, o_orderstatus || o_orderpriority || strftime(o_orderdate, '%Y%m') AS tree, o_orderpriority AS priority FROM orders",
    "v_graph_own": "SELECT node, lag(node) OVER (PARTITION BY branch ORDER BY made, node) AS parent, branch, made, priority FROM v_graph_commits",
    "v_graph_met": "SELECT *, last_value(CASE WHEN is_stem THEN node END IGNORE NULLS) OVER w AS of_stem, last_value(CASE WHEN NOT is_stem THEN node END IGNORE NULLS) OVER w AS of_twig FROM (SELECT *, branch AS stem, true AS is_stem FROM v_graph_own UNION ALL SELECT *, branch // 4 AS stem, false AS is_stem FROM v_graph_own WHERE branch > 0) WINDOW w AS (PARTITION BY stem ORDER BY made, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "v_graph_links": "SELECT node, parent FROM v_graph_own UNION SELECT node, of_stem FROM v_graph_met WHERE NOT is_stem AND (parent IS NULL OR priority = '1-URGENT') UNION SELECT node, of_twig FROM v_graph_met WHERE is_stem AND priority = '2-HIGH'",
    "v_graph_tips": "SELECT branch AS tip, arg_max(node, {'a': made, 'n': node}) AS node FROM v_graph_commits GROUP BY branch",
    "v_trace": "SELECT o_orderkey * 32 AS position, 'SF:src/c' || CAST(o_custkey AS VARCHAR) AS line FROM orders UNION ALL SELECT o_orderkey * 32 + CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 5 ELSE 31 END, 'end_of_record' FROM orders WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT l_orderkey * 32 + l_linenumber * 2, 'DA:' || CAST(l_linenumber AS VARCHAR) || ',' || CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS VARCHAR) FROM lineitem",
    "v_porcelain": "SELECT path, spot + k AS position, line FROM (SELECT l_partkey AS path, l_orderkey * 64 + l_linenumber * 8 AS spot, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM (SELECT *, list_concat([lpad(lower(to_hex(l_orderkey)), 40, '0') || ' 1 ' || CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) || ' 1'], list_concat(CASE WHEN l_linenumber = 1 THEN ['author A ' || CAST(l_suppkey AS VARCHAR), 'author-mail <a' || CAST(l_suppkey AS VARCHAR) || '@x>', 'author-time ' || CAST(l_orderkey * 1000 AS VARCHAR)] ELSE [] END, [chr(9) || 'code'])) AS lines FROM (SELECT l_partkey, l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)))",
    "v_files": "SELECT s.path, s.language, s.size_bytes, s.ordinal, coalesce(count(l.line), 0) AS total_lines, count(*) FILTER (WHERE l.line = '') AS blank_lines, count(*) FILTER (WHERE l.line LIKE 'The%' OR l.line LIKE 'To %') AS comment_lines, count(l.line) - count(*) FILTER (WHERE l.line = '') - count(*) FILTER (WHERE l.line LIKE 'The%' OR l.line LIKE 'To %') AS code_lines FROM v_sources s LEFT JOIN v_lines l ON s.path = l.path GROUP BY ALL",
    "v_code": "SELECT page_id AS path, regexp_replace(html, '[^\\x00-\\x7F]', ' ', 'g') AS text FROM pages",
    "v_methods": "SELECT " + _PATH_SQL.format(k="l_partkey") + " AS path, 'Class' || CAST(l_suppkey % 3 AS VARCHAR) AS class_name, 'm' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS name, CAST(l_linenumber * 10 AS BIGINT) AS line, CAST(l_quantity AS BIGINT) AS lines, l_suppkey % 14 AS cyclomatic, CAST(round(l_tax * 100) * 3 AS BIGINT) AS cognitive, CAST(l_linenumber AS BIGINT) AS parameters, l_partkey % 7 AS nesting FROM lineitem",
    "v_branches": "SELECT CASE WHEN c_custkey % 50 = 0 THEN 'release/' || c_name ELSE c_name END AS name, last_commit, ahead, c_mktsegment = 'BUILDING' AS merged FROM customer JOIN (SELECT o_custkey, max(o_orderdate) AS last_commit, count(*) % 5 AS ahead FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey",
    "v_report": f"SELECT *, CASE WHEN protected THEN 'keep' WHEN score >= 70 THEN 'safe' WHEN score >= 40 THEN 'caution' ELSE 'keep' END AS category FROM (SELECT *, CASE WHEN protected THEN 0.0::DOUBLE ELSE round_even(least(100.0::DOUBLE, CASE WHEN merged THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END + least(age / 90.0::DOUBLE, 1.0::DOUBLE) * 30.0::DOUBLE + CASE status WHEN 'abandoned' THEN 15.0::DOUBLE WHEN 'stale' THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN ahead = 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END), 1) END AS score FROM (SELECT *, CASE WHEN age >= 90 THEN 'abandoned' WHEN age >= 30 THEN 'stale' ELSE 'active' END AS status, CASE WHEN merged THEN 'merge_commit' ELSE 'not_merged' END AS merge_type FROM (SELECT *, CAST(floor(epoch(TIMESTAMP '{NOW}' - last_commit) / 86400) AS BIGINT) AS age, name IN ('main', 'master', 'develop') OR name LIKE 'release/%' AS protected FROM v_branches)))",
    "v_blame": "SELECT l_partkey AS path, l_suppkey % 9 AS author, l_shipdate AS ts FROM lineitem",
    "v_shares": "SELECT path, author, lines, round_even(lines * 100.0::DOUBLE / sum(lines) OVER (PARTITION BY path), 2) AS percentage FROM (SELECT path, author, count(*) AS lines FROM v_blame GROUP BY path, author)",
    "v_tags": "SELECT p_partkey AS ordinal, 'v' || CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) || '.' || CAST(p_partkey % 7 AS VARCHAR) || CASE WHEN p_type LIKE 'ECONOMY%' THEN '-rc1' ELSE '' END || CASE WHEN p_partkey % 11 = 0 THEN ' draft' ELSE '' END AS name FROM part",
    "v_hits": "SELECT d.source AS path, coalesce(l.hits, 0) AS hits FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS hits FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id",
    "v_coverage": "SELECT path, count(*) FILTER (WHERE hits > 0) AS covered, count(*) AS total, round_even(count(*) FILTER (WHERE hits > 0) / count(*)::DOUBLE, 4) AS ratio FROM v_hits GROUP BY path",
    "v_imports": "SELECT c_nationkey AS module, s_nationkey AS imported_module FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey",
    "v_churn": "SELECT path, count(*) AS commit_count, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions, CAST(sum(insertions) + sum(deletions) AS BIGINT) AS churn_score FROM v_changes GROUP BY path",
    "v_timeline": "SELECT sha, authored_ts, ordinal, CAST(sum(insertions - deletions) OVER (ORDER BY authored_ts, ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM v_totals",
    "v_languages": "SELECT language, count(*) AS file_count, CAST(sum(total_lines) AS BIGINT) AS total_lines, CAST(sum(code_lines) AS BIGINT) AS code_lines, CAST(sum(blank_lines) AS BIGINT) AS blank_lines, CAST(sum(comment_lines) AS BIGINT) AS comment_lines FROM v_files GROUP BY language",
}


def with_views(sql: str) -> str:
    """``sql`` with definitions of the views that it names, and of those that these name."""
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name in text and name not in needed:
                visit(body)
                needed[name] = None

    visit(sql)
    own = sql.lstrip()
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    if not needed:
        return sql
    if own[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {own[15:]}"
    return f"WITH {ctes}, {own[5:]}" if own[:5].upper() == "WITH " else f"WITH {ctes} {own}"
