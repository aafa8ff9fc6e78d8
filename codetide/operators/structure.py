"""Files, languages, modules, coupling and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import formats as M, text as X

# Languages that count as data or prose, not as code.
NON_LANGUAGES = (
    "generic", "text", "markdown", "restructuredtext", "csv", "svg", "json", "yaml", "toml",
    "xml", "html", "css", "scss", "less", "ini", "config", "properties",
)


def language_summary(files: DataFrame) -> DataFrame:
    sums = [F.sum(c).cast("long").alias(c) for c in ("total_lines", "code_lines", "blank_lines", "comment_lines")]
    return files.groupBy("language").agg(F.count("*").alias("file_count"), *sums)


def language_share(languages: DataFrame, value: str = "code_lines") -> DataFrame:
    """Each language's share of a value, in percent; 0 where the total is."""
    total = F.sum(value).over(W.partitionBy())
    return languages.select("language", value, F.when(total > 0, F.bround(F.col(value) * F.lit(100.0) / total, 1)).otherwise(F.lit(0.0)).alias("percent"))


def language_bar(languages: DataFrame) -> DataFrame:
    """Code lines of each language, or all its lines where it has none of code."""
    return languages.select("language", F.coalesce(F.nullif("code_lines", F.lit(0)), "total_lines").alias("lines"))


def module_rollup(files: DataFrame) -> DataFrame:
    return files.groupBy(X.parent_module(F.col("path")).alias("module")).agg(F.count("*").alias("file_count"), F.sum("total_lines").cast("long").alias("total_lines"), F.sum("code_lines").cast("long").alias("code_lines"))


def directory_sizes(entries: DataFrame) -> DataFrame:
    """Bytes of each folder's own files; entries of unknown size, below 0, are left out."""
    return entries.filter("size >= 0").groupBy(X.parent_module(F.col("path")).alias("directory")).agg(F.sum("size").cast("long").alias("bytes"))


def repo_totals(files: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total_lines", "code_lines", "blank_lines", "comment_lines")]
    return files.agg(F.count("*").alias("total_files"), *sums, F.count_distinct("language").alias("languages"))


def average_cc(methods: DataFrame, *keys: str) -> DataFrame:
    """The mean cyclomatic complexity, 0 where there is no method."""
    return methods.groupBy(*keys).agg(F.coalesce(F.avg("cyclomatic"), F.lit(0.0)).alias("average_cc"))


def all_methods(functions: DataFrame, methods: DataFrame) -> DataFrame:
    """Free functions, without a class, and methods."""
    return functions.withColumn("class_name", F.lit(None).cast("string")).unionByName(methods)


def distinct_imports(imports: DataFrame) -> DataFrame:
    """Each file's imports, once each, sorted."""
    return imports.groupBy("path").agg(F.array_sort(F.collect_set("imported")).alias("imports"))


def is_abstract(name: Column, bases: Column) -> Column:
    """A class counts as abstract by its name or by a base that says so."""
    return name.startswith("Abstract") | F.exists(bases, lambda b: F.lower(b).contains("abc") | F.lower(b).contains("abstract"))


def abstractness(classes: DataFrame) -> DataFrame:
    """Abstract classes as a share of each module's classes."""
    share = F.count_if(is_abstract(F.col("name"), F.col("bases"))) / F.count("*")
    return classes.groupBy("module").agg(F.count("*").alias("classes"), F.bround(share, 3).alias("abstractness"))


def import_map(files: DataFrame) -> DataFrame:
    """``(name, module)``: every folder part and file stem stands for the module of the last file that has it."""
    module = X.parent_module(F.col("path"))
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    names = F.array_distinct(F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(stem)))
    return files.select("ordinal", module.alias("module"), F.explode(names).alias("name")).groupBy("name").agg(F.max_by("module", "ordinal").alias("module"))


def import_edges(imports: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct ``(module, imported_module)``, by look-up of the imported names; own imports are dropped."""
    owned = imports.select(X.parent_module(F.col("path")).alias("module"), "imported")
    found = owned.join(names.select(F.col("name").alias("imported"), F.col("module").alias("target")), "imported")
    return found.filter("module <> target").select("module", F.col("target").alias("imported_module")).distinct()


def coupling(modules: DataFrame, edges: DataFrame, abstract: DataFrame | None = None) -> DataFrame:
    """Afferent and efferent coupling, instability, abstractness and distance of every module.

    ``edges(module, imported_module)`` need not be distinct.
    """
    distinct = edges.filter("module <> imported_module").select("module", "imported_module").distinct()
    out = distinct.groupBy("module").agg(F.count("*").alias("efferent"))
    into = distinct.groupBy(F.col("imported_module").alias("module")).agg(F.count("*").alias("afferent"))
    spine = modules.select("module").distinct().join(out, "module", "left").join(into, "module", "left")
    spine = spine.join(abstract.select("module", F.col("abstractness").alias("a")), "module", "left") if abstract is not None else spine.withColumn("a", F.lit(0.0))
    ce, ca, a = (F.coalesce(c, F.lit(z)) for c, z in (("efferent", 0), ("afferent", 0), ("a", 0.0)))
    instability = F.when(ca + ce > 0, ce / (ca + ce)).otherwise(F.lit(0.0))
    return spine.select("module", ca.cast("long").alias("afferent"), ce.cast("long").alias("efferent"), F.bround(instability, 3).alias("instability"), F.bround(a, 3).alias("abstractness"), F.bround(F.abs(a + instability - 1), 3).alias("distance"))


def hotspots(churn: DataFrame, methods: DataFrame) -> DataFrame:
    """Each file's churn beside its largest complexity, or beside its churn where it has none."""
    cc = methods.groupBy("path").agg(F.max("cyclomatic").alias("cc"))
    return churn.join(cc, "path", "left").select("path", "commit_count", "churn_score", F.coalesce(F.nullif("cc", F.lit(0)), "churn_score", F.lit(0)).cast("long").alias("complexity"))


def split_languages(languages: DataFrame) -> DataFrame:
    """Languages, with a mark on those that are data or prose."""
    return languages.withColumn("is_language", ~F.col("language").isin(*NON_LANGUAGES))


def extension_counts(files: DataFrame, languages: bool) -> DataFrame:
    """Files and bytes for each suffix (the bare name where there is none) and language."""
    label = F.when(X.suffix(F.col("path")) != "", X.suffix(F.col("path"))).otherwise(F.element_at(F.split("path", "/"), -1))
    wanted = F.col("language").isin(*NON_LANGUAGES)
    return files.filter(~wanted if languages else wanted).groupBy(label.alias("ext"), "language").agg(F.count("*").alias("files"), F.sum("size_bytes").cast("long").alias("bytes"))


def top(frame: DataFrame, key: str, n: int, *ties: str, descending: bool = True) -> DataFrame:
    """The first ``n`` rows by a column, ties by further columns."""
    return frame.orderBy(F.desc(key) if descending else F.asc(key), *ties).limit(n)


def badges(files: DataFrame, methods: DataFrame) -> DataFrame:
    """Label, value and colour of each badge."""
    totals = files.agg(F.coalesce(F.sum("total_lines"), F.lit(0)).alias("lines"), F.count("*").alias("files"), F.count_distinct("language").alias("languages")).crossJoin(average_cc(methods))
    blue = F.lit("#007ec6")
    badge = lambda label, value, colour: F.struct(F.lit(label).alias("label"), value.alias("value"), colour.alias("colour"))
    rows = F.array(
        badge("lines of code", M.human_number(F.col("lines")), blue),
        badge("files", M.human_number(F.col("files")), blue),
        badge("languages", F.col("languages").cast("string"), blue),
        badge("avg complexity", F.format_string("%.1f", F.col("average_cc")), M.complexity_colour(F.col("average_cc"))),
    )
    return totals.select(F.inline(rows))


def junit_counts(files: DataFrame, methods: DataFrame, max_lines: int, max_cc: int, max_method: int) -> DataFrame:
    """Cases and failures of each suite (a file), and of all with a null path."""
    own = files.select("path", (F.col("total_lines") > max_lines).alias("failed"))
    checks = F.array(F.col("cyclomatic") > max_cc, F.col("lines") > max_method)
    cases = own.unionByName(methods.select("path", F.explode(checks).alias("failed")))
    return cases.rollup("path").agg(F.count("*").alias("tests"), F.count_if("failed").alias("failures"))


def search_rows(frame: DataFrame, text: str) -> DataFrame:
    """Rows whose columns, written one after another in lower case, hold the text."""
    return frame.filter(F.lower(F.concat_ws("", *(F.col(c).cast("string") for c in frame.columns))).contains(text.lower()))


def typed_order(frame: DataFrame, key: str, kind: str, descending: bool) -> DataFrame:
    """Rows in the order of a text column read as a type; what can't be read counts as 0."""
    read = F.col(key) if kind == "string" else F.coalesce(F.col(key).try_cast("double"), F.lit(0.0))
    return frame.orderBy(read.desc() if descending else read.asc(), *frame.columns)
