"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are runs of three character classes (letters, capitals, digits, kinds
of punctuation), its words, hashed to slots and weighed by inverse document
frequency, and the share of words that repeat within a short window.  The terms of a
bounded sample of labelled texts are put in a matrix, whose leading singular vectors
span the latent space.  The labelled texts' vectors there are sent to all executors;
their number is a setting, so their size is bounded.

Every text is laid into that space, blocks of texts are multiplied by all labelled
vectors, which gives exact cosines, and the nearest labels vote, weighed by a power of
their cosine and by how many labelled rows a sampled one stands for.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship
from .common import parts

#: Character classes; bytes of characters beyond ASCII are the last class, control characters count as symbols.
CLASSES = (
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",;:", "!", "?", "|", "'\"`", "()[]{}<>", "#$%&@*^~", "-_+=", "/\\",
)
SYMBOLS, BEYOND = 12, 15
CLASS_OF = np.array([next((i for i, c in enumerate(CLASSES) if chr(b) in c), SYMBOLS) if b < 128 else BEYOND for b in range(256)], np.int32)
SHAPES = (BEYOND + 1) ** 3
#: Lower-case letters and bytes of characters beyond ASCII; all else separates words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Characters of a text that are looked at at once; bounds a worker's memory.
PART = 1 << 20


@dataclass(frozen=True)
class QualitySettings:
    """Bounds and choices of the fit; scoring has no bounds and reads whole texts."""

    #: Labelled rows of each label to fit on and to vote, at most: those with the smallest hash.
    rows_of_label: int = 1500
    dimensions: int = 32
    neighbours: int = 15
    #: A neighbour's vote is its cosine to this power.
    sharpness: float = 4.0
    word_slots: int = 2048
    word_weight: float = 0.3
    repeat_weight: float = 1.0
    #: Words among which repeats are counted.
    repeat_window: int = 64
    #: Texts that are multiplied by the labelled vectors at once.
    block: int = 256
    #: The score at and above which a text is called good.
    cut: float = 0.5

    @property
    def width(self) -> int:
        """Shapes, words, repeats, and one for texts without words."""
        return SHAPES + self.word_slots + 2


def terms_of(text: str | None, settings: QualitySettings) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a whole text's terms and their values, before words are weighed."""
    shapes, words, last = np.zeros(SHAPES, np.int64), Counter(), np.zeros(0, np.int32)
    rest: list[bytes] = []
    total = repeats = 0
    for part in parts(text or "", PART, drop=False):
        data = part.encode("utf-8", "replace")
        codes = np.concatenate([last, CLASS_OF[np.frombuffer(data, np.uint8)]])
        last = codes[-2:]
        if len(codes) > 2:
            shapes += np.bincount((codes[:-2] * (BEYOND + 1) + codes[1:-1]) * (BEYOND + 1) + codes[2:], minlength=SHAPES)
        words.update(data.translate(LETTERS).split())
        rest += data.split()
        whole = len(rest) - len(rest) % settings.repeat_window
        for i in range(0, whole, settings.repeat_window):
            repeats += settings.repeat_window - len(set(rest[i : i + settings.repeat_window]))
        total, rest = total + whole, rest[whole:]
    repeats += len(rest) - len(set(rest))
    total += len(rest)
    if not total:
        return np.array([settings.width - 1]), np.array([1.0])
    at = np.flatnonzero(shapes)
    slots = np.zeros(settings.word_slots)
    if words:
        slots += np.bincount([zlib.crc32(w) % settings.word_slots for w in words], weights=list(words.values()), minlength=settings.word_slots)
    used = np.flatnonzero(slots)
    numbers = np.concatenate([at, SHAPES + used, [settings.width - 2]])
    return numbers, np.concatenate([np.sqrt(shapes[at] / max(1, shapes.sum())), np.log1p(slots[used]), [settings.repeat_weight * repeats / total]])


def weighed(numbers: np.ndarray, values: np.ndarray, idf: np.ndarray, settings: QualitySettings) -> np.ndarray:
    """The values with words weighed by inverse document frequency and brought to one length."""
    values = values.copy()
    words = (numbers >= SHAPES) & (numbers < SHAPES + settings.word_slots)
    values[words] *= idf[numbers[words] - SHAPES]
    values[words] *= settings.word_weight / max(1e-9, float(np.linalg.norm(values[words])))
    return values


@dataclass
class QualityModel:
    """The latent space and the labelled vectors in it."""

    settings: QualitySettings
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    #: How many labelled rows each vector stands for.
    stands_for: np.ndarray

    def vector(self, text: str | None) -> np.ndarray:
        """The text's unit vector; zero where the space holds nothing of it."""
        return self.placed(*terms_of(text, self.settings))

    def placed(self, numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
        found = weighed(numbers, values, self.idf, self.settings) @ self.basis[numbers]
        length = np.linalg.norm(found)
        return found / length if length > 1e-9 else np.zeros_like(found)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i in range(0, len(texts), self.settings.block):
            some = np.array([self.vector(t) for t in texts[i : i + self.settings.block]])
            out[i : i + len(some)] = self.vote(some)
        return out

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """The share of the nearest neighbours' votes that says 1.

        Cosines are rounded, and all neighbours as near as the last one vote, so the
        order of the labelled rows means nothing.  Without any near label the score is 0.
        """
        cosines = np.maximum(0.0, np.round(vectors @ self.vectors.T, 9))
        k = min(self.settings.neighbours, len(self.labels))
        least = np.partition(cosines, len(self.labels) - k, axis=1)[:, len(self.labels) - k]
        votes = np.where(cosines >= least[:, None], cosines**self.settings.sharpness, 0.0) * self.stands_for
        total = votes.sum(axis=1)
        return np.where(total > 0, np.minimum(1.0, votes @ self.labels / np.maximum(total, 1e-300)), 0.0)


def fit(sample: list[tuple[int, np.ndarray, np.ndarray]], there: dict[int, int], settings: QualitySettings = QualitySettings()) -> QualityModel | None:
    """A model of labelled texts' terms: ``(label, numbers, values)``; ``there`` says how many rows have each label.

    The leading singular vectors are found by subspace iteration.  None without any labelled text.
    """
    if not sample:
        return None
    labels = np.array([y for y, _, _ in sample])
    used = np.zeros(settings.word_slots)
    for _, numbers, _ in sample:
        used[numbers[(numbers >= SHAPES) & (numbers < SHAPES + settings.word_slots)] - SHAPES] += 1
    idf = np.log((1 + len(sample)) / (1 + used))
    matrix = np.zeros((len(sample), settings.width), np.float32)
    for row, (_, numbers, values) in zip(matrix, sample, strict=True):
        row[numbers] = weighed(numbers, values, idf, settings)
    wide = min(settings.dimensions + 8, *matrix.shape)
    found = np.random.default_rng(7).standard_normal((settings.width, wide)).astype(np.float32)
    for _ in range(6):
        found, _ = np.linalg.qr(matrix.T @ (matrix @ found))
    _, _, turned = np.linalg.svd(matrix @ found, full_matrices=False)
    basis = (found @ turned.T[:, : settings.dimensions]).astype(np.float64)
    count = {y: int((labels == y).sum()) for y in (0, 1)}
    weight = np.array([there.get(int(y), count[int(y)]) / count[int(y)] for y in labels])
    model = QualityModel(settings, idf, basis, np.zeros((0, basis.shape[1])), labels.astype(float), weight)
    model.vectors = np.array([model.placed(numbers, values) for _, numbers, values in sample])
    return model


def labelled_terms(docs: DataFrame, labels: DataFrame, settings: QualitySettings) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], dict[int, int]]:
    """The terms of at most ``rows_of_label`` labelled texts of each label, and how many rows have each.

    Of the labelled documents that have a text those with the smallest hash are
    taken, so reruns agree.  A document with several labels counts as good if half of
    them say so; one with several texts is fitted on the first of them.
    """
    marked = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    usable = docs.select("doc_id", "text").filter("text is not null")
    able = marked.join(usable.select("doc_id"), "doc_id", "left_semi")
    there = {r["quality"]: r["count"] for r in able.groupBy("quality").count().collect()}
    picked = [able.filter(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.rows_of_label) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # its size is bounded by the settings
    chosen = usable.join(ids, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of(t.as_py(), settings) for t in batch.column("text")]
            columns = [batch.column("doc_id").cast(pa.string()), batch.column("quality"), pa.array([n for n, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "quality", "numbers", "values"])

    rows = chosen.mapInArrow(run, "id string, quality int, numbers array<int>, values array<double>").collect()
    rows.sort(key=lambda r: r["id"])
    return [(r["quality"], np.array(r["numbers"], np.int64), np.array(r["values"])) for r in rows], there


def train_quality(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> QualityModel | None:
    """Fit on labelled rows of ``labels(doc_id, quality)`` and their texts in ``docs(doc_id, text)``.

    Terms are made by tasks; the driver gets those of the bounded sample.  Null ids,
    labels and texts are left out, repeated rows count once, and other columns are
    ignored.  None without any labelled text.
    """
    ship(docs.sparkSession)
    return fit(*labelled_terms(docs, labels, settings), settings)


def score_texts(docs: DataFrame, model: QualityModel | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the score, 0 to 1, of every whole text.

    Texts without words, null ones too, are near only to labelled ones of that kind and
    have 0 where there is none.  Without a model (no labelled rows) every score is
    0.5.  Rows, repeated ones too, and all other columns stay, but one that is named
    like ``out`` is replaced; an empty table stays empty.
    """
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            found = [own.scores([t.as_py() for t in texts[i : i + own.settings.block]]) for i in range(0, len(texts), own.settings.block)]
            yield pa.array(np.concatenate(found) if found else [], pa.float64())

    return docs.withColumn(out, score(F.col(text_col)))
