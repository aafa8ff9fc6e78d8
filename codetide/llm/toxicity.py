"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.
A text is cut into windows of ``window_words`` words, and each window is
compressed twice: behind the ordinary dictionary, and behind both.  What the
toxic dictionary saves, in bytes, is the window's *gain*.  With the ordinary
dictionary on both sides, ordinary text costs the same on both, so few of its
windows gain anything.  The toxic dictionary stands in front, where matches cost
most, so it is used only for what the ordinary one lacks.

Most of a toxic text is ordinary, so its dictionary is trained in rounds, as in
learning from bags of examples: the toxic texts are dealt to two halves, a
dictionary of one half measures the windows of the other, and windows that gain
more than nearly all ordinary ones (the ``quantile``) train the next round's.
In the end each window is narrowed to the pieces of it that gain most.

The weights of the document score and its threshold are calibrated on training
rows that no dictionary has seen.  Dictionaries are used for their content,
without entropy tables, so lengths of short windows compare.
"""

from __future__ import annotations

import heapq
import math
import pickle
import random
import re
import warnings
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship
from .common import parts

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Stands at the end of every dictionary and before every window, so that all frames shrink and none is stored as it is, which would hide a gain.
CARRIER = bytes(range(128, 224))
#: Longer words are cut, so that no window grows with the text.
MAX_WORD = 64
#: Characters of a text that are cut into windows at once; bounds a worker's memory.
PART = 1 << 20


@dataclass(frozen=True)
class ToxicitySettings:
    """Bounds and choices of the training; scoring has none and reads whole texts."""

    window_words: int = 8
    #: Words of the pieces that windows are narrowed to.
    piece_words: int = 2
    #: Labelled rows to fit on, at most: those with the smallest hash of all whose text has at most ``longest_text`` characters.
    toxic_rows: int = 1500
    ordinary_rows: int = 4000
    longest_text: int = 20_000
    #: Windows of training text that hold a run of so many words that another training text has too are copies, and train nothing.
    copy_words: int = 5
    #: Random windows at most that train a dictionary, and ordinary ones that set the bar for gains.
    train_windows: int = 400_000
    bar_windows: int = 30_000
    quantile: float = 0.995
    rounds: int = 5
    #: Bytes of the ordinary dictionary, of the first round's toxic one and of later ones.
    ordinary_dict_bytes: int = 1 << 19
    first_dict_bytes: int = 1 << 14
    toxic_dict_bytes: int = 1 << 13
    #: Segment and substring length of the dictionary training.
    ordinary_segments: tuple[int, int] = (64, 8)
    toxic_segments: tuple[int, int] = (16, 6)
    level: int = 13
    min_match: int = 6
    search_log: int = 9
    hash_log: int = 20
    #: The score at and above which a text is called toxic.
    cut: float = 0.7


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: list[float]
    settings: ToxicitySettings
    _pair: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def gains(self, found: Sequence[bytes]) -> list[int]:
        """Bytes by which the toxic dictionary shortens each window."""
        if self._pair is None:
            self._pair = compressor(self.ordinary, self.settings), compressor(self.toxic + self.ordinary, self.settings)
        ordinary, both = (c.compress for c in self._pair)
        return [len(ordinary(CARRIER + w)) - len(both(CARRIER + w)) for w in found]

    def score(self, text: str | None) -> float:
        """0 to 1; a text without words has 0."""
        gains = self.gains(windows(text or "", self.settings.window_words))
        if not gains:
            return 0.0
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features(gains), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def features(gains: list[int]) -> list[float]:
    """The three largest gains; how many windows, and what share, gain a byte and two; and how many windows there are."""
    n = max(1, len(gains))
    out = [float(x) for x in heapq.nlargest(3, gains)]
    out += [0.0] * (3 - len(out))
    for least in (1, 2):
        hits = sum(g >= least for g in gains)
        out += [math.log1p(hits), hits / n]
    return [*out, math.log1p(len(gains))]


def words(text: str) -> list[bytes]:
    found = WORD.findall(text.encode("utf-8", "replace").lower())
    if any(len(w) > MAX_WORD for w in found):
        found = [w[i : i + MAX_WORD] for w in found for i in range(0, len(w), MAX_WORD)]
    return found


def joined(found: Sequence[bytes]) -> bytes:
    return b" %b " % b" ".join(found)


def windows(text: str, n: int) -> list[bytes]:
    """Runs of ``n`` words, one after the other; the last may be shorter.  A text is read part by part, which changes nothing."""
    out, rest = [], []
    for part in parts(text, PART, drop=True):
        found = rest + words(part)
        whole = len(found) - len(found) % n
        out += [joined(found[i : i + n]) for i in range(0, whole, n)]
        rest = found[whole:]
    return out + [joined(rest)] if rest else out


def compressor(content: bytes, settings: ToxicitySettings) -> zstd.ZstdCompressor:
    """A compressor behind a dictionary's content and the carrier, all of which lie in its window."""
    content += CARRIER
    params = zstd.ZstdCompressionParameters.from_level(
        settings.level, source_size=256, dict_size=len(content), window_log=max(10, (len(content) + 8192).bit_length()),
        min_match=settings.min_match, search_log=settings.search_log, hash_log=settings.hash_log, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    return zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params)


# --- training -----------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings) -> tuple[list[str], list[str], float]:
    """Texts of at most ``toxic_rows`` toxic and ``ordinary_rows`` ordinary labelled documents, and how many ordinary there are in all for a toxic one.

    Of the labelled documents that have a text of 1 to ``longest_text`` characters,
    those with the smallest hash are taken, so reruns agree.  A document with
    several labels counts as toxic if one says so.
    """
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.select("doc_id", "text").filter(F.length("text").between(1, settings.longest_text))
    able = marked.join(usable.select("doc_id"), "doc_id", "left_semi")
    there = {r["toxic"]: r["count"] for r in able.groupBy(F.col("toxic") == 1).count().toDF("toxic", "count").collect()}
    picked = [able.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, settings.toxic_rows), (0, settings.ordinary_rows))]
    ids = picked[0].unionByName(picked[1])  # its size is bounded by the settings
    rows = usable.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    rows = random.Random(7).sample(rows, len(rows))
    return [r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0], there.get(False, 0) / max(1, there.get(True, 0))


def own_windows(texts: list[str], settings: ToxicitySettings) -> list[list[bytes]]:
    """The windows of each text without those that hold a run of words that stands elsewhere in ``texts`` too."""
    n, run = settings.window_words, settings.copy_words
    found = [words(t) for t in texts]
    runs = [[hash(tuple(w[i : i + run])) for i in range(max(1, len(w) - run + 1))] for w in found]
    places = Counter(h for r in runs for h in r)
    out = []
    for w, r in zip(found, runs, strict=True):
        starts = range(0, len(w), n)
        out.append([joined(w[i : i + n]) for i in starts if all(places[h] == 1 for h in r[min(i, len(r) - 1) : max(i + 1, i + n - run + 1)])])
    return out


def fit(toxic: list[str], ordinary: list[str], odds: float | None = None, settings: ToxicitySettings = ToxicitySettings()) -> ToxicityModel | None:
    """A calibrated model, or None (with a warning) where the labelled texts don't suffice to train dictionaries.

    Two thirds of the texts train the dictionaries, the others calibrate.  ``odds``
    says how many ordinary documents there are for a toxic one, as in the sample by default.
    """
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    seen, held = (toxic[::3] + toxic[1::3], ordinary[::3] + ordinary[1::3]), (toxic[2::3], ordinary[2::3])
    if not all(map(len, (*seen, *held))):
        return _none(toxic, ordinary)
    rng = random.Random(7)
    plain = own_windows(seen[1], settings)
    bar = _some(rng, sum(plain[1::2], []), settings.bar_windows)
    ordinary_dict = _train(_some(rng, sum(plain[::2], []), settings.train_windows), settings.ordinary_dict_bytes, settings.ordinary_segments, settings.level)
    marked = own_windows(seen[0], settings)
    halves = [sum(marked[::2], []), sum(marked[1::2], [])]
    if ordinary_dict is None or not bar or not all(halves):
        return _none(toxic, ordinary)
    picked = mine(rng, halves, halves, bar, ordinary_dict, settings.first_dict_bytes, settings)
    for _ in range(settings.rounds - 1):
        picked = mine(rng, picked, halves, bar, ordinary_dict, settings.toxic_dict_bytes, settings)
    toxic_dict = _train(narrow(picked, ordinary_dict, settings), settings.toxic_dict_bytes, settings.toxic_segments, settings.level)
    if toxic_dict is None:
        return _none(toxic, ordinary)
    model = ToxicityModel(ordinary_dict, toxic_dict, [], settings)
    model.weights = calibrate(model, held, odds)
    return model


def mine(rng: random.Random, train: list[list[bytes]], test: list[list[bytes]], bar: list[bytes], ordinary: bytes, size: int, settings: ToxicitySettings) -> list[list[bytes]]:
    """Of each half's ``test`` windows those that gain more, by the dictionary of the other half's ``train``, than the quantile of the bar.

    A half that nothing is left of keeps what it has.
    """
    out = list(test)
    for a, b in ((0, 1), (1, 0)):
        trained = _train(_some(rng, train[a], settings.train_windows), size, settings.toxic_segments, settings.level)
        if trained is not None and test[b]:
            model = ToxicityModel(ordinary, trained, [], settings)
            most = max(1.0, float(np.quantile(model.gains(bar), settings.quantile)))
            out[b] = [w for w, g in zip(test[b], model.gains(test[b]), strict=True) if g > most] or test[b]
    return out


def narrow(picked: list[list[bytes]], ordinary: bytes, settings: ToxicitySettings) -> list[bytes]:
    """Of each picked window the pieces that gain most by the dictionary of the other half's windows; the window where none gains."""
    out: list[bytes] = []
    for a, b in ((0, 1), (1, 0)):
        trained = _train(picked[a], settings.toxic_dict_bytes, settings.toxic_segments, settings.level)
        if trained is None:
            out += picked[b]
            continue
        model = ToxicityModel(ordinary, trained, [], settings)
        for window in picked[b]:
            pieces = pieces_of(window, settings.piece_words)
            gains = model.gains(pieces)
            most = max(gains, default=0)
            out += [p for p, g in zip(pieces, gains, strict=True) if g == most] if most > 0 else [window]
    return out


def pieces_of(window: bytes, n: int) -> list[bytes]:
    own = window.split()
    return [joined(own[i : i + n]) for i in range(0, len(own), n)]


def _some(rng: random.Random, found: list[bytes], most: int) -> list[bytes]:
    return rng.sample(found, min(len(found), most))


def _none(toxic: list[str], ordinary: list[str]) -> None:
    if toxic or ordinary:
        warnings.warn(f"{len(toxic)} toxic and {len(ordinary)} ordinary texts are too few to train on: every score will be 0", stacklevel=3)


def _train(samples: list[bytes], size: int, segments: tuple[int, int], level: int) -> bytes | None:
    """A dictionary of at most ``size`` bytes, or of the samples' bytes if they are fewer."""
    total = sum(map(len, samples))
    if total < 2 * size:
        size = max(1024, min(size, total))
        samples = samples * (1 + 3 * size // max(1, total))
    try:
        return zstd.train_dictionary(size, samples, level=level, k=segments[0], d=segments[1]).as_bytes()
    except zstd.ZstdError:  # too little text to train on
        return None


def calibrate(model: ToxicityModel, held: tuple[list[str], list[str]], odds: float | None = None) -> list[float]:
    """Logistic weights over the features of unseen texts, moved so that the best F1 under ``odds`` lies at the cut."""
    n = model.settings.window_words
    x = np.array([features(model.gains(windows(t, n))) for part in held for t in part])
    y = np.repeat([1.0, 0.0], [len(held[0]), len(held[1])])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-3, *[0.3] * (z.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    logits = z @ w
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(y[order])
    each = 1.0 if odds is None else odds * len(held[0]) / len(held[1])  # what an ordinary text of the sample stands for
    f1 = 2 * hits / (hits + each * np.cumsum(1 - y[order]) + y.sum())
    last = np.append(np.diff(logits[order]) != 0, True)  # ties are called alike
    k = int(np.argmax(np.where(last, f1, -1)))
    threshold = (logits[order][k] + logits[order][min(k + 1, len(y) - 1)]) / 2
    raw, cut = w[1:] / scale, model.settings.cut
    bias = w[0] - (raw * mean).sum() - threshold + math.log(cut / (1 - cut))
    return [float(bias), *map(float, raw)]


# --- scoring ------------------------------------------------------------------


def train_toxicity(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> ToxicityModel | None:
    """Fit on labelled rows of ``labels(doc_id, toxic)`` and their texts in ``docs(doc_id, text)``.

    The fit is one task, which gets the bounded sample.  Null ids, labels and texts
    are left out, repeated rows count once, and other columns are ignored.  None,
    with a warning if there are labelled texts, says that they don't suffice.
    """
    spark = docs.sparkSession
    ship(spark)
    sample = spark.sparkContext.broadcast(labelled_sample(docs, labels, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pickle.dumps(fit(*sample.value, settings=settings)) for _ in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["found"])

    model = pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(run, "found binary").first()["found"])
    return _none(*sample.value[:2]) if model is None else model


def score_texts(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the score, 0 to 1, of every whole text; null texts, and texts without words, have 0.

    Without a model (no usable labels) every score is 0.  Rows, repeated ones too,
    their order and all other columns stay, but one that is named like ``out`` is
    replaced; an empty table stays empty.
    """
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            yield pa.array([own.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(out, score(F.col(text_col)))
