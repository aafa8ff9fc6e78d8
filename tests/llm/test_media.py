import hashlib
import io
import tarfile
import zlib

import pytest

from codetide.llm import media

TEXTS = ["", None, "short", "x" * 64, "x" * 65, "same text", "same text", "naïve 漢字 🙂", "long " * 40_000, "\0\0zero"]


def test_png_round_trip():
    for data in (b"", b"abc", bytes(range(256)) * 9, b"\0" * 64):
        payload = media.payload_of(data)
        assert len(payload) % 64 == 0 < len(payload) and payload.startswith(data)
        image = media.encode_png(payload)
        assert media.decode_png(image) == payload
        assert media.read_header(image[: media.HEADER_BYTES]) == (64, len(payload) // 64, 8)
    damaged = bytearray(media.encode_png(media.payload_of(b"abc" * 50)))
    damaged[50] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(damaged))
    with pytest.raises(ValueError):
        media.read_header(b"GIF89a" + bytes(40))


def test_columns_and_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "same text", "y")], "doc_id long, text string, digest string").repartition(3)
    root = f"file://{tmp_path}/media"
    rows = media.media_columns(docs, root).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        data = (("same text" if r["doc_id"] is None else TEXTS[r["doc_id"]]) or "").encode()
        payload = media.payload_of(data)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == r["digest"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["samples"] == f"sum={sum(payload)};min={min(payload)};max={max(payload)};zeros={payload.count(0)}"
        assert (r["width"], r["height"], r["bits"]) == (64, len(payload) // 64, 8)
        raw = (tmp_path / "media" / r["shard"]).read_bytes()
        image = raw[r["offset"] : r["offset"] + r["length"]]
        assert hashlib.sha256(image).hexdigest() == r["media_sha256"] and media.decode_png(image) == payload
        member = next(m for m in tarfile.open(fileobj=io.BytesIO(raw)) if m.name == f"{r['digest']}.png")
        assert (member.offset_data, member.size) == (r["offset"], r["length"])
    same = {tuple(r)[1:] for r in rows if r["doc_id"] in (5, 6, None)}
    assert len(same) == 1


def test_shards_roll_over(tmp_path, monkeypatch):
    monkeypatch.setattr(media, "SHARD_BYTES", 3000)
    writer = media.ShardWriter(f"file://{tmp_path}", "part-0")
    places = [writer.put(f"m{i}", bytes([i]) * 900) for i in range(8)]
    writer.close()
    assert len({p[0] for p in places}) > 1
    for i, (shard, offset, length) in enumerate(places):
        assert (tmp_path / shard).read_bytes()[offset : offset + length] == bytes([i]) * 900


def test_a_frame_of_one_s_own_ships_the_package(tmp_path):
    """In a session whose workers can't import the package by themselves."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    here = Path(media.__file__).resolve().parents[2]
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {str(here)!r})
from codetide.llm import media
print("rows", media.media_columns(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), "file://{tmp_path}/own").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=300, check=False)
    assert "rows 2" in done.stdout, done.stderr[-2000:]


def test_forgotten_places_change_nothing(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(30)], "doc_id long, text string").withColumn("shard", media.F.lit(1)).withColumn("OFFSET", media.F.lit(2)).coalesce(1)
    keep = ("doc_id", "digest", "payload_sha256", "samples")
    whole = sorted(map(tuple, media.media_columns(docs, f"file://{tmp_path}/a").select(*keep).collect()))
    monkeypatch.setattr(media, "KNOWN_PLACES", 1)
    assert sorted(map(tuple, media.media_columns(docs, f"file://{tmp_path}/b").select(*keep).collect())) == whole


def test_empty(spark, tmp_path):
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none").count() == 0
