import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codetide.llm import packing
from codetide.llm.queries import byte_bpe

TEXTS = ["", None, "plain words", "  white \t\n  space  ", "<|endoftext|> inside", "naïve 漢字 🙂 ﷽", "a" * 5000, " " * 4100, "x1y2 " * 3000, "don't we'll I'm"]


def rebuilt(runs, capacity):
    """Fill of every bin, by playing the plan out piece by piece."""
    table = packing.lookup_table(runs)
    lengths = Counter()
    for run in runs:
        for x, c in run.pattern:
            lengths[x] += c * run.bins
    bins: dict[int, list[tuple[int, int]]] = {}
    for x, n in lengths.items():
        s, o = packing.place(table, np.full(n, x), np.arange(n))
        for a, b in zip(s.tolist(), o.tolist(), strict=True):
            bins.setdefault(a, []).append((b, x))
    for items in bins.values():
        at = 0
        for offset, x in sorted(items):
            assert offset == at
            at += x
        assert at <= capacity
    return lengths, bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.choice([1, 50, 4000])))
    runs = packing.plan_bins(dict(counts), capacity)
    lengths, bins = rebuilt(runs, capacity)
    assert lengths == counts
    assert sorted(bins) == list(range(len(bins)))
    large = [x for items in bins.values() for _, x in items if 3 * x > capacity]
    assert all(sum(3 * x > capacity for _, x in items) <= 2 for items in bins.values())
    bound = max(-(-sum(x * n for x, n in counts.items()) // capacity), -(-len(large) // 2))
    assert len(bins) <= 1.25 * bound + 2


def test_large_items_are_matched_optimally():
    assert len(rebuilt(packing.plan_bins({6: 3, 4: 3}, 10), 10)[1]) == 3
    assert len(rebuilt(packing.plan_bins({5: 4}, 10), 10)[1]) == 2
    assert len(rebuilt(packing.plan_bins({9: 1, 4: 2, 1: 3}, 10), 10)[1]) == 2


def test_plan_size_does_not_grow_with_counts():
    rng = random.Random(1)
    counts = {x: rng.randint(1, 9) for x in range(1, 2049)}
    few = packing.plan_bins(dict(counts), 2048)
    many = packing.plan_bins({x: n * 1_000_003 for x, n in counts.items()}, 2048)
    assert len(many) < 6000 and len(few) < 6000


def test_bad_lengths_raise():
    for bad in (0, 11):
        with pytest.raises(ValueError):
            packing.plan_bins({bad: 1}, 10)
    assert packing.plan_bins({}, 10) == []


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]


def test_fast_path_gives_the_library_s_ids():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoder(**byte_bpe())
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [f"a{c}b 1{c} {c}  {c}.{c}\n{c}x" for c in points[::7]] + [t or "" for t in TEXTS]
    for text, expected in zip(texts, slow.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert enc.ids(text).tolist() == expected.ids


def test_parts_give_the_whole_ids(monkeypatch):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoder(**byte_bpe())
    text = " ".join(["word", " 's", "two  gaps", "\n", "<|endoftext|>", "don't", "漢字", "12 34", "...", "end ", "\t"] * 40)
    for size in (1, 7, 64, 300):
        monkeypatch.setattr(packing, "PART", size)
        assert enc.ids(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_documents_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(2, "plain words", "x"), (None, "no id", "x")], "doc_id long, text string, length string")
    rows = packing.pack_documents(docs, 64, byte_bpe()).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {}
    for r in rows:
        by.setdefault((r["sequence_id"]), []).append((r["offset"], r["length"]))
    for items in by.values():
        assert [o for o, _ in sorted(items)] == [sum(n for _, n in sorted(items)[:k]) for k in range(len(items))]
        assert sum(n for _, n in items) <= 64
    assert sum(n for i in by.values() for _, n in i) <= 64 * len(by) < sum(n for i in by.values() for _, n in i) + 2 * 64
    for i, text in enumerate(TEXTS):
        ids = [*slow.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        own = own if i != 2 else own[::2]
        assert [(a, b, c) for a, b, c, _ in own] == [(k, s, n) for k, (s, n) in enumerate(packing.cut(len(ids), 64))]
        assert all(crc == zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for _, s, n, crc in own)
    assert sum(r["doc_id"] is None for r in rows) == 1


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), 64, byte_bpe()).count() == 0


def test_columns_of_any_name(spark):
    names = ["pack_bucket", "pack_n", "pack_before", "pack_rank", "sequence_id", "offset"]
    pieces = spark.createDataFrame([(i, 1 + i % 7, *["x"] * 6) for i in range(60)], "id long, length long, " + ", ".join(f"{n} string" for n in names))
    out = packing.pack_pieces(pieces, 10, ["id"])
    assert out.columns == ["id", "length", *names]
    rows = out.collect()
    assert len(rows) == 60 and {r["pack_rank"] for r in rows} == {"x"}
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 10
