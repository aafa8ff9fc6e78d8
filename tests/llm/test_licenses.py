import random
import re

from codetide.llm import licenses as L

LINES = [text for _, text in L.NOTICES]


def brute(text, threshold=0.85):
    words = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    places = []
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    blocks = []
    for label, notice in L.NOTICES:
        own = [w.decode() for w in L.license_words(notice)]
        size, at, stretch = 2 * len(own), None, []
        for start in range(len(words)):
            share = len(set(own) & set(words[start : start + size])) / len(set(own)) if words[start] in own else 0
            if share >= threshold - 1e-9:
                if stretch and start >= at + size:
                    blocks.append(max(stretch, key=lambda b: b[3]))
                    stretch = []
                stretch.append((label, start, min(start + size, len(words)), share))
                at = start
        if stretch:
            blocks.append(max(stretch, key=lambda b: b[3]))
    starts = [i for i, _ in places]
    named = {x for _, x in places}
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)), ",".join(sorted(named | {b[0] for b in blocks})), max((b[3] for b in blocks), default=0.0), sorted(blocks)


def corpus(seed):
    rng = random.Random(seed)
    filler = ["the", "license", "Public", "GENERAL", "software", "mit", "apache", "under", "x9", "straße", "and", "of", "is"]
    out = [None, "", "...", "mit license", "MIT--License MIT license", "Apache License, General Public License", "general public license " * 3]
    for _ in range(60):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 3)):
            notice = rng.choice(LINES).split()
            if rng.random() < 0.4:  # spread out, so that only some windows hold enough
                notice = [x for w in notice for x in [w, *rng.choices(filler, k=rng.choice([0, 0, 1, 2]))]]
            if rng.random() < 0.5:
                notice.pop(rng.randrange(len(notice)))
            words[(at := rng.randint(0, len(words))) : at] = notice
        out.append(" ".join(words))
    return out + ["filler " * 30_000 + LINES[1]]


def test_scan_matches_brute_force(spark):
    texts = corpus(1)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(3, texts[3], 0.1)], "doc_id long, text string, score double")
    rows = L.scan_licenses(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        expected = brute(texts[r["doc_id"]])
        assert tuple(r)[1:7] == expected[:6], r
        assert abs(r["score"] - expected[6]) < 1e-12
        assert sorted(map(tuple, r["blocks"])) == expected[7]


def test_every_notice_is_found():
    scanner = L.Scanner(L.NOTICES, L.BASE_PHRASES, 0.85, {})
    for label, text in L.NOTICES:
        found = scanner.scan("some words before " * 11 + text.upper() + " and after" * 5)
        assert label in found[5].split(",") and found[6] == 1.0


def test_order_of_words_does_not_change_matches():
    a = L.Scanner(L.NOTICES, L.BASE_PHRASES, 0.85, {})
    b = L.Scanner(L.NOTICES, L.BASE_PHRASES, 0.85, {w: (i * 7919) % 101 for i, w in enumerate(sorted(a.rank))})
    for t in corpus(2):
        assert a.scan(t) == b.scan(t)


def test_frequencies_cover_all_texts(spark):
    docs = spark.createDataFrame([("MIT mit x",), (None,), ("the mit",)], "text string").repartition(3)
    assert L.corpus_frequency(docs, {b"mit", b"the", b"none"}) == {b"mit": 3, b"the": 1}


def test_spread_notices_are_found_wherever_they_stand():
    """A notice of 1.9 times its length, with other words between its own, at every offset."""
    scanner = L.Scanner(L.NOTICES, L.BASE_PHRASES, 0.85, {})
    notice = "This is free and unencumbered software released into the public domain".split()
    spread = " ".join(f"{w} zz{i}" if i < 9 else w for i, w in enumerate(notice))
    assert all("unlicense" in scanner.scan("other " * before + spread + " more" * 7)[5] for before in range(40))


def test_whole_license_without_its_opening_sentence():
    scanner = L.Scanner(L.NOTICES, L.BASE_PHRASES, 0.85, {})
    text = next(t for label, t in L.NOTICES if label == "mit" and "MERCHANTABILITY" in t)
    assert "mit" in scanner.scan(" ".join(text.split()[22:]))[5].split(",")
    assert scanner.scan(" ".join(text.split()[110:]))[5] == ""


def test_templates_are_a_table(spark):
    docs = spark.createDataFrame([(1, "our own words of notice here"), (2, "nothing")], "doc_id long, text string")
    own = spark.createDataFrame([("own", "own words of notice"), ("own", "own words of notice"), (None, "nothing"), ("none", None), ("blank", "...")], "label string, text string")
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in L.scan_licenses(docs, own).collect()} == {1: ("own", 1.0), 2: ("", 0.0)}
    assert L.scan_licenses(docs, own.limit(0)).filter("score > 0").count() == 0
    assert sorted(r["labels"] for r in L.scan_licenses(docs.limit(0).union(spark.createDataFrame([(3, "Released under the MIT License")], docs.schema)), L.default_templates(spark)).collect()) == ["mit"]


def test_templates_have_a_bound(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(L, "MOST_TEMPLATE_CHARS", 10)
    with pytest.raises(ValueError):
        L.template_list(L.default_templates(spark))


def test_empty(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
