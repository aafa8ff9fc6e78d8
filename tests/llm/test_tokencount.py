import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from codetide.llm import tokencount

TEXTS = ["", None, "plain words", "  two  spaces\n\nand lines ", "<s> </s> <unk> inside", "naïve 漢字 🙂", "same", "same", "x" * 3000, "word " * 20_000]
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def docs_of(spark):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "same", 1), (3, "another text of id 3", 1)], "doc_id long, text string, content int")


def test_counts_are_the_library_s(spark):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = tokencount.count_tokens(docs_of(spark), MODEL)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens"]
    got = sorted(map(tuple, out.collect()), key=str)
    expected = [(i, len((t or "").encode()), len(own.encode(t or ""))) for i, t in enumerate(TEXTS)] + [(None, 4, len(own.encode("same"))), (3, 20, len(own.encode("another text of id 3")))]
    assert got == sorted(expected, key=str)


def test_other_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs_of(spark).filter("doc_id <> 3"), path).collect()}
    assert all(got[i] == len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS) if i != 3)
    with pytest.raises(ValueError):
        tokencount.counter("words.bin")


def test_only_misses_are_encoded_and_appended(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    tokencount.count_tokens(docs_of(spark), MODEL, cache).collect()
    first = tokencount.read_cache(spark, cache)
    assert first.count() == first.select("content").distinct().count() == len({t or "" for t in TEXTS}) + 1
    more = docs_of(spark).union(spark.createDataFrame([(50, "a new text", 1)], "doc_id long, text string, content int"))
    tokencount.count_tokens(more, MODEL, cache).collect()
    assert tokencount.read_cache(spark, cache).count() == len({t or "" for t in TEXTS}) + 2
    # A cached count is trusted, so it is plain that nothing was encoded again.
    marked = f"file://{tmp_path}/marked"
    tokencount.read_cache(spark, cache).withColumn("n_tokens", tokencount.F.lit(77).cast("long")).write.parquet(marked)
    assert {r["n_tokens"] for r in tokencount.count_tokens(more, MODEL, marked).collect()} == {77}
    # Another tokenizer never reads them.
    other = tokencount.count_tokens(more, public_tokenizers.path("word_bpe_49k.json"), marked).collect()
    assert 77 not in {r["n_tokens"] for r in other}


def test_repeated_rows_are_encoded_once(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(1, "the same row")] * 50 + [(2, "another")] + [(None, "no id")] * 9, "doc_id long, text string").repartition(4)
    assert tokencount.count_tokens(docs, MODEL, cache).count() == 60
    assert tokencount.read_cache(spark, cache).count() == 3


@pytest.mark.parametrize("sent", [0, 100_000])
@pytest.mark.parametrize("joins", ["-1", "10m"])
def test_each_missing_text_is_encoded_once(spark, tmp_path, monkeypatch, sent, joins):
    """The rows that go to the encoder, and the encoder's own calls, whatever the join."""
    monkeypatch.setattr(tokencount, "SENT_DIGESTS", sent)
    docs = spark.createDataFrame([(1, f"text {i % 2}") for i in range(80)] + [(i, f"text {i % 5}") for i in range(40)] + [(None, None)] * 3, "doc_id long, text string").repartition(6)
    digests = docs.select(tokencount.content_digest("text").alias("content"))
    known = digests.limit(0).union(docs.filter("text = 'text 3'").select(tokencount.content_digest("text"))).distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    try:
        due = tokencount.missing_texts(docs, digests.distinct().join(known, "content", "left_anti"))
        assert sorted(r["text"] for r in due.collect()) == ["", "text 0", "text 1", "text 2", "text 4"]
        calls = f"{tmp_path}/calls"

        class Counting:
            def count(self, text):
                with open(calls, "a") as f:
                    f.write(text + "\n")
                return len(text)

        monkeypatch.setattr(tokencount, "counter", lambda path: Counting())
        assert tokencount.count_tokens(docs, MODEL).count() == 123
        with open(calls) as f:
            assert sorted(f.read().splitlines()) == ["", "text 0", "text 1", "text 2", "text 3", "text 4"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parts_give_the_whole_count(monkeypatch):
    own = tokencount.SentencePieceCounter(MODEL)
    assert own.by_parts
    text = " ".join(["word", "  two", "\n", "\u2581", "a\u2581b", "naïve", "漢字", "x" * 50, "end ", "\t"] * 60)
    for size in (1, 7, 64, 300):
        monkeypatch.setattr(tokencount, "PART", size)
        assert own.count(text) == len(own.library.encode(text))


def test_empty(spark):
    assert tokencount.count_tokens(docs_of(spark).limit(0), MODEL).count() == 0
