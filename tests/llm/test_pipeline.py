import random

import corpus_pipeline
from codetide.llm import simhash
from codetide.llm.common import stage


def tables(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, node string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 160))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["wretchface", "scumlord", "hateful9"]))
        docs.append((i, " ".join(words), "en", f"s{i % 4}", 1, "x"))
        labels.append((i, i % 2, int(toxic)))
    clean = docs[1]
    docs += [(1000, clean[1], "en", "s1", 1, "x"), (1001, clean[1] + " more", "en", "s1", 1, "x"), (1002, None, None, None, None, None), (1002, None, None, None, None, None), (None, "no id at all but text", "en", "s2", 1, "x")]
    folder = f"file://{tmp_path}"
    tables(spark, folder, docs, labels)
    at = spark.read.parquet(f"{folder}/documents.parquet")
    columns = at.columns
    results = []
    for name, f in corpus_pipeline.STAGES:
        at = stage(f(spark, at, folder), name)
        results.append(at)
        if f is not corpus_pipeline.STAGES[-1][1]:
            assert at.columns == columns, name
    safe, unique, mixed, packed = results
    left = {r["doc_id"] for r in safe.collect()}
    assert len([i for i in range(900) if i % 6 == 0 and i in left]) <= 8
    assert len([i for i in range(900) if i % 6 and i not in left]) <= 8
    assert {1000, 1001, 1002, None} <= left
    kept = [r["doc_id"] for r in unique.collect()]
    assert 1 in kept and 1000 not in kept and 1001 not in kept and kept.count(1002) == 1 and None in kept
    assert len(kept) == len(left) - 2
    taken = [r["doc_id"] for r in mixed.collect()]
    assert set(taken) <= set(kept) and max(map(taken.count, set(taken))) <= 2
    assert sorted({r["doc_id"] for r in packed.collect()}, key=str) == sorted(set(taken), key=str)
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_no_clean_documents_are_lost(spark, tmp_path):
    docs = [(i, f"only text number {i} " + " ".join(str(i * k) for k in range(50)), "en", "s", 1, "x") for i in range(30)]
    tables(spark, f"file://{tmp_path}", docs, [(1, 1, 0)])
    at = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.drop_toxic(spark, at, f"file://{tmp_path}").count() == 30
    assert simhash.keep_one_per_group(at).count() == 30


def test_empty_tables_and_odd_columns(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, toxicity string, near_row long, mix_row int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 1, "t", 5, 6), (1, "a b c", "en", "s", 1, "t", 5, 6), (2, None, None, None, None, None, None, None)], spark.read.parquet(f"{folder}/documents.parquet").schema)
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}


def shingle_sets(texts, n=5):
    out = []
    for t in texts:
        words = [w for w in t.lower().split(" ") if w]
        out.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))})
    return out


def test_near_copies_at_the_threshold(spark):
    """Against all pairs: texts at 0.78 to 0.84, with and without a passage that all share, and chains of such pairs."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for k in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([60, 150, 400]))]
        if k % 2:
            base[10:10] = passage
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 1, 3])):
            changed = list(base)
            for _ in range(max(1, round(len(changed) * rng.choice([0.018, 0.021, 0.024])))):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            texts.append(" ".join(changed))
            if rng.random() < 0.5:
                base = changed
    sets = shingle_sets(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    close = 0
    for i in range(len(texts)):
        for j in range(i):
            if (alike := len(sets[i] & sets[j]) / len(sets[i] | sets[j])) >= 0.8:
                close += alike <= 0.82
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert close >= 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == sorted({find(i) for i in range(len(texts))})
