import random

import numpy as np
import xxhash

from codetide.llm import simhash


def brute_print(text, n):
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_by_hand(spark):
    texts = ["", None, " \t\n", "One", "one TWO", "a b c", "a b c d e f g", "x\x0by\x0cz\xa0w É é", "same same same same same", "ÄÖ straße 漢字 " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(docs).collect()}
    assert found == {i: brute_print(t, 3) for i, t in enumerate(texts)}
    assert found[0] == found[1] == found[2] == 0


def test_shingles_by_hand():
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice("aB \t\né\x0b\xa0\u2003") for _ in range(rng.randint(0, 30)))
        words = text.encode().lower().split()
        for n in (1, 3, 5):
            expected = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
            assert simhash.shingles(text, n) == expected, (text, n)


def prints_of(seed, centres, members, flips):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(members):
            out.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips))))
    return sorted(out)


def test_links_match_all_pairs(spark):
    for seed, distance, hot in ((1, 2, 64), (2, 2, 2), (3, 1, 64), (4, 1, 2), (5, 0, 2), (6, 3, 64)):
        prints = prints_of(seed, 12, 25, 4)
        rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
        links = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.near_links(rows, distance, hot).collect()]
        assert all((a ^ b).bit_count() <= distance for a, b in links)
        expected = brute_components({p: p for p in prints}, distance)
        root = {p: p for p in prints}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        assert {p: find(p) for p in prints} == expected, (seed, distance, hot)


def test_groups(spark):
    base = " ".join(f"w{i % 37}x{i}" for i in range(400))
    near = base + " tail"
    rows = [(5, base, 1), (3, base.upper(), 2), (9, near, 3), (1, "all alone here", 4), (7, "", 5), (8, None, 6), (4, base, 7), (4, base, 7), (None, "unnamed text row", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    found = simhash.group_near(docs)
    assert found.columns == ["doc_id", "fp", "component_id"]
    got = sorted(((r["doc_id"], r["component_id"]) for r in found.collect()), key=str)
    close = (brute_print(base, 3) ^ brute_print(near, 3)).bit_count() <= 2
    assert got == sorted([(5, 3), (3, 3), (9, 3 if close else 9), (1, 1), (7, 7), (8, 7), (4, 3), (4, 3), (None, None)], key=str)
    assert simhash.group_near(docs.limit(0)).count() == 0


def test_keep_one_per_group(spark):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(5000)]
    rows, expected, k = [], set(), 0
    for group in range(40):
        text = [rng.choice(words) for _ in range(rng.randint(150, 400))]
        members = []
        for copy in range(rng.randint(1, 4)):
            t = list(text)
            if copy:
                t[rng.randrange(len(t))] = "changed"
            members.append((k, " ".join(t)))
            k += 1
        rows += members
        expected.add(members[0][0])
    rows += [(k, ""), (k + 1, None), (k + 2, "  "), (0, rows[0][1]), (None, "row without id")]
    expected |= {k, None}
    docs = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, node string")
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    assert len(got) == len(set(got))
    assert set(got) >= expected and len(set(got) - expected) <= 2  # recall of the wide search
    assert simhash.keep_one_per_group(docs.limit(0)).count() == 0


def test_different_texts_all_stay(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.randrange(10**6)}" for _ in range(120))) for i in range(150)], "doc_id long, text string")
    assert simhash.keep_one_per_group(docs).count() == 150


def test_wide_recall(spark):
    """Pairs just above the threshold are found far more often than not."""
    rng = np.random.default_rng(2)
    rows, pairs = [], 60
    for p in range(pairs):
        text = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        other = list(text)
        for at in rng.choice(300, 5, replace=False):
            other[at] = "edit"
        rows += [(2 * p, " ".join(text)), (2 * p + 1, " ".join(other))]
    assert all(simhash.jaccard(rows[2 * p][1], rows[2 * p + 1][1], 5) >= 0.8 for p in range(pairs))
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert kept <= pairs + pairs // 5


def brute_groups(texts: list[str], least: float = 0.8) -> list[int]:
    """The smallest index of each component of all pairs at or above the similarity."""
    sets, root = [set(simhash.shingles(t, 5)) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) / len(x | y) >= least:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sorted(set(root))


def test_pairs_without_the_smallest_node(spark):
    """Of a word's members all that are not linked yet are compared, not the smallest with the rest alone."""
    rows = [(7, n, 10, 0, (1, 10, 0)) for n in (1, 2, 3, 4)] + [(8, n, 10, 1, (2, 10, 1)) for n in (2, 3)]
    shared = spark.createDataFrame(rows, "word long, node long, size long, at int, least struct<node: long, size: long, at: int>")
    assert sorted(map(tuple, simhash.star_pairs(shared, 0.8).collect())) == [(2, 1), (3, 1), (3, 2), (4, 1)]
    roots = spark.createDataFrame([(2, 2), (3, 2)], "node long, root long")
    signed = spark.createDataFrame([(n, 10, *[0] * simhash.SIGNATURE) for n in (1, 2, 3, 4)], "node long, size long, " + ", ".join(f"b{i} long" for i in range(simhash.SIGNATURE)))
    mixed = simhash.mixed_words(shared, roots)
    assert sorted(map(tuple, simhash.rest_pairs(mixed, signed, 0.8).collect())) == [(2, 1), (3, 1), (4, 1), (4, 2), (4, 3)]
    one = spark.createDataFrame([(n, 1) for n in (1, 2, 3, 4)], "node long, root long")
    assert simhash.mixed_words(shared, one).count() == 0
    # Bridges lead from each node to the smallest of the word's smallest component; the smaller node comes second.
    assert sorted(map(tuple, simhash.bridge_pairs(mixed, 0.8).collect())) == [(2, 1), (3, 1), (4, 1)]
    # Signatures that differ in more bits than similar sets may differ in hashes leave a pair out.
    apart = signed.withColumn("b3", simhash.F.when(simhash.F.col("node") == 4, 0b111).otherwise(0).cast("long"))
    assert sorted(map(tuple, simhash.rest_pairs(mixed, apart, 0.8).collect())) == [(2, 1), (3, 1)]
    assert sorted(map(tuple, simhash.signed_pairs(simhash.star_pairs(shared, 0.8), apart, 0.8).collect())) == [(2, 1), (3, 1), (3, 2)]


def test_only_the_best_stars_are_tried(spark):
    """Of the smallest nodes of its words a node tries those with most words in common; the rest is left to rest_pairs."""
    rows = [(w, 9, 10, 0, (least, 10, 0)) for w, least in ((1, 3), (2, 3), (3, 3), (4, 1), (5, 2), (6, 2))]
    shared = spark.createDataFrame(rows, "word long, node long, size long, at int, least struct<node: long, size: long, at: int>")
    assert sorted(map(tuple, simhash.star_pairs(shared, 0.8, tries=1).collect())) == [(9, 3)]
    assert sorted(map(tuple, simhash.star_pairs(shared, 0.8).collect())) == [(9, 2), (9, 3)]


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 1000, 5000):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        for k in (0, 1, 20, 400):
            y = np.concatenate([x[min(k, n) :], rng.integers(0, 2**63, k).astype(np.uint64)])
            differ = sum(int(v).bit_count() for v in (simhash.signature(x) ^ simhash.signature(y)).view(np.uint64))
            assert differ <= len(set(x.tolist()) ^ set(y.tolist()))


def test_near_copies_in_crowded_words(spark):
    """Long texts hold the prefixes of shorter near copies, which only match each other."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(30):
        text = [f"w{x}" for x in rng.integers(0, 10**6, 100)]
        texts += [" ".join([*text, *(f"v{x}" for x in rng.integers(0, 10**6, 40))]) for _ in range(3)]
        texts += [" ".join(text), " ".join([*text, "more"])]
    kept = simhash.keep_one_per_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == brute_groups(texts) and len(kept) == 120


def test_every_pair_at_the_threshold(spark):
    """Random edits around similarity 0.8, shared passages, repeated lines and short texts, against all pairs."""
    rng = np.random.default_rng(3)
    passage, line, texts = [f"p{i}" for i in range(80)], "the same line again and again".split(), ["one", "one two", "ONE  two", "a b c d e f", "a b c d e f g", ""]
    for k in range(110):
        text = [f"w{x}" for x in rng.integers(0, 10**6, rng.integers(20, 200))]
        text = text + (passage if k % 4 == 0 else line * 12 if k % 4 == 1 else [])
        other = list(text)
        for at in rng.choice(len(text), max(1, round(len(text) * rng.uniform(0.018, 0.028))), replace=False):
            other[at] = f"e{rng.integers(0, 10**6)}"
        texts += [" ".join(text), " ".join(other + line * (5 * (k % 4 == 1)))]
    close = [simhash.jaccard(texts[i], texts[i + 1], 5) for i in range(6, len(texts), 2)]
    assert sum(0.8 <= x < 0.85 for x in close) >= 20 and sum(0.75 <= x < 0.8 for x in close) >= 15
    kept = simhash.keep_one_per_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    # "one two" and "ONE  two" are one node.
    assert sorted(r["doc_id"] for r in kept) == [i for i in brute_groups(texts) if i != 2]


def test_the_named_method_finds_copies_first(spark, monkeypatch):
    """Texts that differ by a trifle meet by their fingerprints; without those searches' links the stage has none of its own."""
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(40):
        text = [f"w{x}" for x in rng.integers(0, 10**6, 600)]
        texts += [" ".join(text), " ".join([*text, "more"])]
    docs = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "id long, row string, text string")
    prints = simhash.prefixes(docs, 5, 0.8)
    assert {r["id"]: r["fp"] for r in prints.collect()} == {r["id"]: r["fp"] for r in simhash.fingerprints(docs, 5, "id").collect()}
    at = {r["node"]: r["id"] for r in prints.collect()}
    marks = prints.select("node", "fp")
    found = {tuple(sorted((at[r["node"]], at[r["other"]]))) for r in simhash.print_pairs(marks).collect()}
    values = {r["id"]: r["fp"] % (1 << 64) for r in prints.collect()}
    close = {(i, j) for j in values for i in values if i < j and (values[i] ^ values[j]).bit_count() <= 2}
    assert found == close and len(close) >= 20
    asked = []
    kept = simhash.print_pairs
    monkeypatch.setattr(simhash, "print_pairs", lambda marks, *rest: asked.append(marks.count()) or kept(marks, *rest))
    assert simhash.keep_one_per_group(docs.drop("row"), id_col="id").count() == 40 and asked == [80]


def test_a_large_group_around_the_threshold(spark, monkeypatch):
    """Most members of one word's group are not similar: few pairs are left for the search that compares all."""
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    texts = []
    for _ in range(400):
        text = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 4)):
            text[at] = f"e{rng.integers(0, 10**6)}"
        texts.append(" ".join(text))
    left = []
    rest = simhash.rest_pairs

    def counted(*args):
        left.append(rest(*args).count())
        return rest(*args)

    monkeypatch.setattr(simhash, "rest_pairs", counted)
    kept = simhash.keep_one_per_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == brute_groups(texts)
    assert left[0] <= 4 * len(texts)
