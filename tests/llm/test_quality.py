"""Quality by neighbours: votes against brute force, terms against a plain count, odd texts and tables, held-out accuracy."""

import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from codetide.llm import quality as Q, queries

SETTINGS = Q.QualitySettings(neighbours=3, dimensions=8)
SF = Path("/root/testdata/sf0.01")


def prose(rng, n=60):
    return " ".join(rng.choice("the and of tion other while erst inga".split()).capitalize() if k % 9 == 0 else rng.choice("the and of tion other while erst inga ble".split()) + rng.choice(["", "", ".", ","]) for k in range(n))


def junk(rng, n=60):
    return rng.choice([" | ".join(f"w{rng.randint(0, 99)}" for _ in range(n)), "!! ".join("ABC DEF XYZ".split() * n), "buy " * n])


def tables(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [(i, prose(rng) if i % 3 else junk(rng), 1 if i % 3 else 0) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, SCORE_ string").withColumn("quality", F.lit(7))
    return rows, docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")


def test_terms_against_a_plain_count():
    text = "Ab, cd cd!\nÉ 12"
    numbers, values = Q.terms_of(text, SETTINGS)
    classes = [next((i for i, c in enumerate(Q.CLASSES) if chr(b) in c), 15 if b > 127 else 12) for b in text.encode()]
    runs = {}
    for a, b, c in zip(classes, classes[1:], classes[2:], strict=False):
        runs[(a * 16 + b) * 16 + c] = runs.get((a * 16 + b) * 16 + c, 0) + 1
    expected = {k: math.sqrt(n / sum(runs.values())) for k, n in runs.items()}
    for word, n in ((b"ab", 1), (b"cd", 2), ("É".encode(), 1)):
        expected[Q.SHAPES + zlib.crc32(word) % SETTINGS.word_slots] = math.log1p(n)
    expected[SETTINGS.width - 2] = 0.0
    assert dict(zip(numbers.tolist(), values, strict=True)) == pytest.approx(expected)
    assert Q.terms_of("a b a a", SETTINGS)[1][-1] == pytest.approx(2 / 4)


def test_parts_change_nothing(monkeypatch):
    text = " ".join(f"word{i % 37} É!" for i in range(3000))
    whole = Q.terms_of(text, SETTINGS)
    monkeypatch.setattr(Q, "PART", 500)
    cut = Q.terms_of(text, SETTINGS)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))


def test_votes_against_brute_force(spark):
    rows, docs, labels = tables(spark)
    model = Q.train_quality(docs, labels, SETTINGS)
    got = {r["doc_id"]: r["score"] for r in Q.score_texts(docs, model).collect()}
    order = sorted(rows, key=lambda r: str(r[0]))
    known = [model.vector(t) for _, t, _ in order]
    for i, text, _ in rows:
        own = model.vector(text)
        near = sorted(((round(float(sum(a * b for a, b in zip(own, v, strict=True))), 9), y) for v, (_, _, y) in zip(known, order, strict=True)), reverse=True)
        voters = [(c, y) for c, y in near if c >= near[SETTINGS.neighbours - 1][0] and c > 0]
        total = sum(c**4 for c, _ in voters)
        assert got[i] == pytest.approx(sum(y * c**4 for c, y in voters) / total, abs=1e-6)
    assert all((s >= 0.5) == bool(i % 3) for i, s in got.items())


def test_the_bound_picks_rows_by_hash_and_weighs_them(spark):
    _, docs, labels = tables(spark)
    model = Q.train_quality(docs, labels, Q.QualitySettings(rows_of_label=10, dimensions=8))
    assert len(model.labels) == 20 and set(model.stands_for[model.labels == 1]) == {4.0} and set(model.stands_for[model.labels == 0]) == {2.0}
    again = Q.train_quality(docs.repartition(7), labels.repartition(5), Q.QualitySettings(rows_of_label=10, dimensions=8))
    assert np.allclose(again.vectors, model.vectors)


def test_odd_texts_and_tables(spark):
    _, docs, labels = tables(spark)
    odd = spark.createDataFrame([(900, None), (901, ""), (902, " \n"), (903, "x" * 300_000), (None, "the and of"), (905, "!!!"), (905, "!!!")], "doc_id long, text string")
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (1, None), (77777, 0)], "doc_id long, quality int"))
    model = Q.train_quality(docs.unionByName(odd, allowMissingColumns=True), twice, SETTINGS)
    found = Q.score_texts(odd.withColumn("score", F.lit("old")), model).collect()
    assert len(found) == 7 and all(0 <= r["score"] <= 1 for r in found)
    assert [r["score"] for r in found if r["doc_id"] in (900, 901, 902)] == [0.0] * 3
    assert len({r["score"] for r in found if r["doc_id"] == 905}) == 1
    assert Q.score_texts(odd.limit(0), model).count() == 0
    blank = Q.train_quality(odd, spark.createDataFrame([(901, 1), (903, 0)], "doc_id long, quality int"), SETTINGS)
    assert [r["score"] for r in Q.score_texts(odd.filter("doc_id < 903"), blank).collect()] == [1.0] * 3


def test_without_labels_and_with_one(spark):
    _, docs, labels = tables(spark)
    assert Q.train_quality(docs, labels.limit(0)) is None
    assert {r["score"] for r in Q.score_texts(docs, None).collect()} == {0.5}
    only = Q.train_quality(docs, labels.filter("quality = 1"), SETTINGS)
    assert all(r["score"] == pytest.approx(1.0) and r["score"] <= 1 for r in Q.score_texts(docs.filter("doc_id % 3 = 1"), only).collect())


@pytest.mark.skipif(not SF.is_dir(), reason="no test tables here")
def test_held_out_accuracy_and_unread_labels(spark):
    found = queries.op12_quality(spark, str(SF)).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and {a for a, _ in held} == {0, 1}
