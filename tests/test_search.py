"""Search by postings and patterns by anchors, against looking at every row."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from codetide.operators import search as Q


def rows_of(rng, n=300):
    return [(i, rng.choice([None, "en", "De"]), "".join(rng.choices("abcÄ 🙂x\n", k=rng.randint(0, 12)))) for i in range(n)] + [(900, "en", None), (901, None, "the end"), (901, None, "the end"), (None, "en", "abc")]


@pytest.mark.parametrize("text", ["abc", "ENA", "ä", "ab", "", "the end", "🙂x", "c 🙂", "nothing like it", "n\n"])
def test_search_equals_the_scan(spark, text):
    rows = rows_of(random.Random(1))
    frame = spark.createDataFrame(rows, "id long, lang string, text string").repartition(3)
    postings = Q.index(frame, "id", "lang", "text").cache()
    got = sorted(map(str, map(tuple, Q.search(frame, postings, "id", text, "lang", "text").collect())))
    hold = [r for r in rows if text.lower() in ((r[1] or "") + (r[2] or "")).lower() and (r[0] is not None or len(text) < 3)]
    assert got == sorted(map(str, hold))


def test_the_search_reads_postings_before_texts(spark):
    frame = spark.createDataFrame(rows_of(random.Random(2)), "id long, lang string, text string")
    plan = Q.search(frame, Q.index(frame, "id", "text"), "id", "abcd", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "gram" in plan


def test_patterns_against_the_library(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices(["src/", "lib/", "file", "a", "b1", ".py", ".c", "[x]", "+", "test_"], k=rng.randint(1, 5))) for _ in range(150)] + [None, "", "a", "src/file.py", "src/file.py"]
    patterns = ["*.py", "src/*", "*file?*", "lib/[ab]*", "*", "?", "a", "src/file.py", "*test_[!a]*", "x*y", "*+*", "*.p[xy]", "src/lib/*.c", None, "*/fil?.py", "src/*", "[a]"]
    got = {tuple(r) for r in Q.matches(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()}
    assert got == {(n, p) for n in names if n is not None for p in patterns if p is not None and fnmatch.fnmatchcase(n, p)}


def test_many_patterns_are_no_theta_join(spark):
    names = spark.range(3000).select(F.concat(F.lit("pkg/file"), F.col("id").cast("string"), F.lit(".py")).alias("name"))
    patterns = spark.range(10_000).select(F.concat(F.lit("*e"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(".*")).alias("pattern"))
    found = Q.matches(names, patterns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join [gram" in plan and "Join [name" not in plan
    assert found.count() == 2000


def test_anchors_are_as_long_as_the_pieces_allow(spark):
    """Runs of three of a number are in a share of all names; the longest runs are in few, however many names there are."""
    patterns = spark.createDataFrame([("*/file12345.*",), ("pkg?/file1234567*.[pj]?",), ("*ab*cde*",), ("*.c",)], "pattern string")
    found = [r["g"] for r in patterns.select(Q.fixed_grams(F.col("pattern")).alias("g")).collect()]
    assert [sorted({len(x) for x in g}) for g in found] == [[6], [3, 12], [3], []]
    assert "12345." in found[0] and found[2] == ["cde"]
