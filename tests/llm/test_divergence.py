"""Source divergence: against the whole vocabulary of every pair, odd texts and tables, large counts."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codetide.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(docs, least=3, most=200):
    """The contract by dense counts."""
    docs = [tuple(x or "" for x in d[1:]) for d in docs]
    words = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    seen, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        sources[lang].add(source)
        seen[lang].update(set(words(text)))
        counts[lang, source].update(words(text))
    out = []
    for lang, own in sources.items():
        kept = sorted((t for t, n in seen[lang].items() if n >= least), key=str.encode)
        of = {s: [counts[lang, s][t] for t in kept] for s in own}
        shares = lambda c: [1 + D.SCALE * (n + 1) // (sum(c) + len(kept)) for n in c]
        p = {s: shares(of[s]) for s in own}
        all_ = shares([sum(x) for x in zip(*of.values(), strict=True)])
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in own if o != s]
            terms = [(f(a, q), t) for a, q, t, n in zip(p[s], all_, kept, of[s], strict=True) if n and a > q]
            for part, rows, limit in (("pair", pairs, None), ("term", terms, most)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(rows[:limit])]
    return sorted(out)


def run(spark, docs, **options):
    frame = spark.createDataFrame(docs, SCHEMA).withColumn("TERM", F.lit("x")).withColumn("n", F.lit("y")).repartition(3)
    return sorted(map(tuple, D.divergence(frame, **options).collect()))


def some_docs():
    rng = random.Random(5)
    names = ["alpha", "Beta", "gamma", "É", "日本", "x", "don", "zz", "ALPHA", "b_c", "a1b", "\u0085q", "ÀB"]
    docs = [(i, " ".join(rng.choices(names[: rng.randint(1, len(names))], k=rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S1", None, "é", "s1"])) for i in range(120)]
    return docs + [(200, None, "en", "none"), (201, "", "xx", "s1"), (202, "lonely words", "yy", None), (203, "123 !!", "xx", "s2"), (None, "alpha alpha", None, None)] + [(7, "copy copy Copy", "en", "s1")] * 3


@pytest.mark.parametrize("least, most", [(3, 200), (1, 2), (50, 200)])
def test_against_the_whole_vocabulary(spark, least, most):
    docs = some_docs()
    assert run(spark, docs, least_docs=least, most_terms=most) == plain(docs, least, most)


def test_groups_joined_by_a_shuffle_agree(spark, monkeypatch):
    monkeypatch.setattr(D, "SENT_GROUPS", 0)
    docs = some_docs()
    assert run(spark, docs) == plain(docs)


def test_parts_and_flushes_change_nothing(spark):
    texts = ["one two  three" * 20, "x" * 100, "", "é" * 50 + " a", "end ", "a b" * 30 + "c"]
    whole = [sum(D.terms(t.encode()), []) for t in texts]
    size, D.PART = D.PART, 7
    try:
        assert [sum(D.terms(t.encode()), []) for t in texts] == whole
    finally:
        D.PART = size


def test_empty_table(spark):
    assert run(spark, []) == []


def test_shares_of_very_large_counts_are_exact(spark):
    rows = [(4_000_000_000, 5_000_000_000, 7), (10**13, 3 * 10**13, 10**9), (0, 0, 1), (12, 100, 9)]
    frame = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", D.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r["p"] == 1 + D.SCALE * (r["c"] + 1) // (r["n"] + r["v"]) for r in frame.collect())
    assert spark.range(1).select(D.share(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("p")).first()["p"] is None
