import math
import pickle
import random
import re
import warnings

import pytest
import zstandard as zstd

from codetide.llm import toxicity

INSULTS = ["moronface", "scumbag", "worthless", "disgusting", "clownish", "pathetic"]


def texts(n, toxic, seed):
    rng = random.Random(seed)
    parts = ["the", "er", "and", "tion", "ing", "re", "on", "st", "nd", "ou", "ha", "ly"]
    out = []
    for _ in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(40, 300))]
        if toxic:
            for _ in range(rng.randint(2, 7)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(texts(400, True, 1), texts(1200, False, 2))


def test_held_out_texts_are_told_apart(spark, model):
    rows = [(i, t, 1) for i, t in enumerate(texts(200, True, 3))] + [(1000 + i, t, 0) for i, t in enumerate(texts(600, False, 4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    scored = toxicity.score_texts(docs, model).collect()
    hits = sum(r["score"] >= 0.7 for r in scored if r["y"] == 1)
    wrong = sum(r["score"] >= 0.7 for r in scored if r["y"] == 0)
    assert hits >= 180 and wrong <= 18
    assert all(0 <= r["score"] <= 1 for r in scored)
    # Insults late in a long text count as much as in front: no prefix is scored.
    long = " ".join(texts(20, False, 5))
    assert model.score(long + " you worthless pathetic scumbag") > model.score(long)


def plain_score(model, text, n, level=13):
    """The score by hand: two contents, each window compressed anew, and the logistic sum."""
    found = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
    lengths = []
    carrier = bytes(range(128, 224))
    for content in (model.ordinary + carrier, model.toxic + model.ordinary + carrier):
        params = zstd.ZstdCompressionParameters.from_level(level, source_size=256, dict_size=len(content), window_log=(len(content) + 8192).bit_length(), min_match=6, search_log=9, hash_log=20, write_content_size=0, write_checksum=0, write_dict_id=0)
        c = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params)
        lengths.append([len(c.compress(carrier + b" " + b" ".join(found[i : i + n]) + b" ")) for i in range(0, len(found), n)])
    gains = [a - b for a, b in zip(*lengths, strict=True)]
    top = sorted(gains, reverse=True)[:3] + [0] * max(0, 3 - len(gains))
    one, two = sum(g >= 1 for g in gains), sum(g >= 2 for g in gains)
    x = [*top, math.log(1 + one), one / len(gains), math.log(1 + two), two / len(gains), math.log(1 + len(gains))]
    return 1 / (1 + math.exp(-(model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x, strict=True)))))


def test_scores_follow_from_the_two_dictionaries(model):
    for text in texts(12, True, 8) + texts(12, False, 9) + ["one", "two WORDS", "a, b; c! d e f g h i"]:
        assert model.score(text) == pytest.approx(plain_score(model, text, 8), rel=1e-9)


def test_dictionaries_hold_running_text_of_several_words(model):
    """They are trained on windows, not on a list of words."""
    assert len(model.ordinary) > 8 * 1024 and len(re.findall(rb"[a-z]+ [a-z]+ [a-z]+", model.toxic)) > 3
    assert sum(w.encode() in model.toxic for w in INSULTS) >= 5


def test_no_window_is_stored_as_it_is(model):
    """Windows that no dictionary shortens still show a gain where only the toxic one knows a word."""
    window = b" zq9x kv7w jj3k worthless p0o9 x8c7 m1n2 disgusting "
    assert model.gains([window])[0] >= 4


def test_copies_train_nothing():
    settings = toxicity.ToxicitySettings()
    shared = " ".join(f"shared{i}" for i in range(24))
    one, two = toxicity.own_windows([shared + " " + " ".join(f"a{i}" for i in range(8)), " ".join(f"b{i}" for i in range(3)) + " " + shared], settings)
    assert one == [b" a0 a1 a2 a3 a4 a5 a6 a7 "] and two == []


def test_odd_rows(spark, model):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "!!! ...", "c"), (4, "x" * 100_000, "d"), (5, "ÄÖÜ 漢字 \U0001f642", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, saving string")
    out = toxicity.score_texts(docs, model)
    assert out.columns == ["doc_id", "text", "saving", "score"]
    got = out.collect()
    assert len(got) == 6 and all(0 <= r["score"] < 0.7 for r in got)
    assert [r["score"] for r in got if not re.search(r"\w", r["text"] or "")] == [0.0] * 4
    assert toxicity.score_texts(docs.limit(0), model).count() == 0
    # A column that is named like the score is replaced.
    again = toxicity.score_texts(docs.withColumnRenamed("saving", "score"), model)
    assert again.columns == ["doc_id", "text", "score"] and dict(again.dtypes)["score"] == "double"


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, none)
    assert model is None
    assert [r["score"] for r in toxicity.score_texts(docs, model).collect()] == [0.0]
    few = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="too few"):
        assert toxicity.train_toxicity(docs, few) is None
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert toxicity.train_toxicity(docs.limit(0), none) is None


def test_sample_is_bounded_and_repeats(spark):
    docs = spark.createDataFrame([(i % 90, f"text number {i % 90}") for i in range(120)] + [(200 + i, "y" * 50) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(90)] + [(None, True), (1, None)] + [(200 + i, True) for i in range(300)], "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) toxic")
    # The many texts that are too long don't make the sample smaller.
    settings = toxicity.ToxicitySettings(toxic_rows=10, ordinary_rows=20, longest_text=30)
    a, b = (toxicity.labelled_sample(docs, labels, settings) for _ in range(2))
    assert a == b and len(a[0]) == 10 and len(a[1]) == 20 and a[2] == 2.0
    assert all(int(t.split()[-1]) % 3 == 0 for t in a[0]) and all(int(t.split()[-1]) % 3 for t in a[1])


def test_model_survives_pickling(model):
    assert pickle.loads(pickle.dumps(model)).score("you worthless scumbag") == model.score("you worthless scumbag")


def test_long_texts_are_cut_into_windows_part_by_part(monkeypatch):
    text = " ".join(f"w{i}" for i in range(4000))
    whole = toxicity.windows(text, 8)
    monkeypatch.setattr(toxicity, "PART", 500)
    cut = toxicity.windows(text, 8)
    assert b" ".join(whole).split() == b" ".join(cut).split()


def test_parts_change_no_window(monkeypatch):
    text = " ".join(f"word{i} and É{i % 7}," for i in range(500))
    whole = toxicity.windows(text, 8)
    assert len(whole) == -(-1500 // 8)
    monkeypatch.setattr(toxicity, "PART", 100)
    assert toxicity.windows(text, 8) == whole and toxicity.windows("", 8) == []
