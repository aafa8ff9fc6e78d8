"""Text search by an inverted index, and names against tables of shell patterns.

Rows are indexed by the runs of three characters in their text.  A search looks up the
runs of what it asks for, keeps the rows that have them all, and looks only at these
rows' texts.  Patterns are met in the same way: a name must have all runs of their
pieces without wildcards, and is looked up by the rarest of the longest ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GRAM = 3
#: Lengths of the runs by which patterns are met; each is twice the one before.
RUNS = (GRAM, 2 * GRAM, 4 * GRAM, 8 * GRAM)


def row_text(frame: DataFrame, *columns: str) -> Column:
    """The columns written one after another, in lower case."""
    return F.lower(F.concat_ws("", *(F.col(c).cast("string") for c in columns or frame.columns)))


def grams(text: Column, n: int = GRAM) -> Column:
    """The different runs of three (or ``n``) characters of a text, none where it is shorter; found in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def index(frame: DataFrame, key: str, *columns: str) -> DataFrame:
    """Postings ``(gram, key)`` of the rows' texts; to be stored by ``gram`` where they are searched often."""
    return frame.select(F.col(key).alias("key"), F.explode(grams(row_text(frame, *columns))).alias("gram"))


def search(frame: DataFrame, postings: DataFrame, key: str, text: str, *columns: str) -> DataFrame:
    """The rows of ``frame`` whose columns, written one after another, hold the text, whatever the case.

    ``postings`` come from :func:`index` with the same columns.  Rows are told apart by
    ``key``.  Texts of fewer than three characters have no runs, so all rows are looked at.
    """
    text = text.lower()
    asked = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    if asked:
        hits = postings.filter(F.col("gram").isin(asked)).groupBy("key").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(asked))
        frame = frame.join(hits.select(F.col("key").alias("search_key")), F.col(key) == F.col("search_key"), "left_semi")
    return frame.filter(row_text(frame, *columns).contains(text))


def pattern_regex(pattern: Column) -> Column:
    """A shell pattern (``*``, ``?``, ``[...]`` and ``[!...]``) as an anchored regular expression; ``*`` crosses slashes."""
    plain = F.regexp_replace(pattern, r"([\\.+^$(){}|])", r"\\$1")
    for sign, meaning in ((r"\[!", "[^"), (r"\*", ".*"), (r"\?", ".")):
        plain = F.regexp_replace(plain, sign, meaning)
    return F.concat(F.lit("(?s)^(?:"), plain, F.lit(")$"))


def fixed_grams(pattern: Column) -> Column:
    """Runs of characters in a pattern's pieces without wildcards, all of which a name must have: of each piece those of the longest of ``RUNS`` that fits."""
    pieces = F.split(F.regexp_replace(pattern, r"\[[^\]]*\]", "*"), r"[*?]")

    def runs(piece: Column) -> Column:
        out = grams(piece)
        for n in RUNS[1:]:
            out = F.when(F.length(piece) >= n, grams(piece, n)).otherwise(out)
        return out

    return F.array_distinct(F.flatten(F.transform(pieces, runs)))


def matches(names: DataFrame, patterns: DataFrame, name: str = "name", pattern: str = "pattern") -> DataFrame:
    """``(name, pattern)``: each different name with the patterns that it matches as a whole.

    Names meet a pattern by an equal join at its anchor, the run of its own that the
    fewest names have; a pattern with a run that no name has matches none.  Runs are as
    long as the pattern's pieces allow, so that names with a number or a word in common
    with it stay few however many names there are.  Patterns
    without runs, such as ``*.c``, are tried on all names, so there should be few of them.
    """
    own = names.select(F.col(name).alias("name")).filter("name is not null").distinct()
    given = patterns.select(F.col(pattern).alias("pattern")).filter("pattern is not null").distinct().select("pattern", pattern_regex(F.col("pattern")).alias("regex"), fixed_grams(F.col("pattern")).alias("grams"))
    held = own.select("name", F.explode(F.concat(*(grams(F.col("name"), n) for n in RUNS))).alias("gram"))
    asked = given.select("pattern", "regex", F.explode("grams").alias("gram")).join(held.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    rarest = asked.groupBy("pattern", "regex").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0")
    loose = given.filter(F.size("grams") == 0).agg(F.collect_list(F.struct("pattern", "regex")).alias("loose"))  # one row
    others = own.crossJoin(F.broadcast(loose)).select("name", F.inline("loose"))
    return held.join(rarest, "gram").select("name", "pattern", "regex").unionByName(others).filter(F.expr("name rlike regex")).select("name", "pattern")
