"""Quality classifier: learned vectors of hashed words and character n-grams, averaged.

A text is the mean of the vectors of its words, of the n-grams of its words, and of a mark for
each word that repeats the one before it; a softmax layer turns the mean into class
probabilities. Vectors and layer are trained together by stochastic
gradient descent in numpy on at most ``FIT_ROWS`` labelled rows and ``FIT_BYTES`` of feature
counts, the rows with the smallest hash of their id. Workers send feature counts of these rows, not
texts, and the driver takes them a part at a time. As all after the mean is linear, scoring sums one
number for each feature, remembered for each word, over every whole text.

Defined cases: null and empty texts have no features and get the layer's bias; a null id is
scored and never labelled; labels that are null are left out; several labels of an id are a
training row each; of several texts of an id the one with the smallest hash is learned from.
Without any label every score is one half.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteindex.llm.common import id_key, whole_text

#: Rows to fit on at most, and the seed of their order and of the first vectors.
FIT_ROWS, SEED = 3_000, 8
#: Bytes of feature counts to hold on the driver at most; rows that come after are not learned from.
FIT_BYTES = 128 << 20
#: Parts in which they come.
FIT_PARTS = 8
BUCKETS, DIMENSION, NGRAMS = 1 << 17, 8, (3, 4, 5)
#: A repeated word counts like this many n-grams.
MARKS = 4
EPOCHS, RATE = 8, 0.1
HELD_OUT_FOLD, FOLDS, THRESHOLD = 0, 5, 0.3
#: With so many words remembered, a worker starts anew.
REMEMBERED = 100_000
#: Texts whose words are looked up together.
TOGETHER = 128


def word_features(
    words: Sequence[bytes], buckets: int = BUCKETS, ngrams: Sequence[int] = NGRAMS
) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their n-grams, and the number of the word that each belongs to.

    ``<`` and ``>`` mark a word's ends; characters are those of UTF-8.
    """
    framed = [b"<%b>" % w for w in words]
    codes = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(f) for f in framed])
    ids, of = [np.array([zlib.crc32(f) for f in framed], np.uint64)], [np.arange(len(words))]
    for n in ngrams:
        places = max(0, len(codes) - n + 1)
        name = np.full(places, n, np.uint64)
        for k in range(n):
            name = name * np.uint64(0x100000001B3) + codes[k : k + places]
        name ^= name >> np.uint64(29)
        name *= np.uint64(0xBF58476D1CE4E5B9)
        inside = word[:places] == word[n - 1 : n - 1 + places]
        ids.append(name[inside] >> np.uint64(32))
        of.append(word[:places][inside])
    return (np.concatenate(ids) % np.uint64(buckets)).astype(np.int64), np.concatenate(of)


def repeat_mark(buckets: int = BUCKETS) -> int:
    return zlib.crc32(b"< = >") % buckets  # no word holds a blank


def repeats(words: Sequence[str]) -> int:
    """Words equal to the word before them."""
    return sum(map(eq, words, islice(words, 1, None)))


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == HELD_OUT_FOLD, F.lit(False))


@dataclass
class QualityModel:
    """Vectors by bucket, and the layer over their mean."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def contrast(self, label: int = 1) -> tuple[np.ndarray, float]:
        """What each feature adds to the log-odds of ``label``, for two classes, and the bias."""
        other = 1 - label
        return (
            self.vectors @ (self.layer[:, label] - self.layer[:, other]),
            float(self.bias[label] - self.bias[other]),
        )


def train(
    rows: Sequence[tuple[int, np.ndarray, np.ndarray]],
    classes: int = 2,
    buckets: int = BUCKETS,
    dimension: int = DIMENSION,
    epochs: int = EPOCHS,
    rate: float = RATE,
    seed: int = SEED,
) -> QualityModel:
    """Fit on ``(label, features, counts)``; step sizes adapt to each feature's gradients."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1, 1, (buckets, dimension)) / dimension
    layer, bias = np.zeros((dimension, classes)), np.zeros(classes)
    seen_v, seen_l, seen_b = np.zeros(buckets), np.zeros(dimension), np.zeros(classes)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in random.permutation(len(rows)):
            label, ids, counts = rows[i]
            share = counts / max(1.0, counts.sum())
            mean = share @ vectors[ids]
            odds = np.exp((z := mean @ layer + bias) - z.max())
            error = odds / odds.sum()
            error[label] -= 1
            back = layer @ error
            seen_v[ids] += share**2 * (back @ back)
            seen_l += mean**2 * (error @ error)
            seen_b += error**2
            layer -= step * np.outer(mean / np.sqrt(seen_l + 1e-8), error)
            bias -= step * error / np.sqrt(seen_b + 1e-8)
            vectors[ids] -= step * np.outer(share / np.sqrt(seen_v[ids] + 1e-12), back)
    return QualityModel(vectors, layer, bias)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, **options
) -> QualityModel:
    """Train on labelled rows outside the held-out fold."""
    order = F.xxhash64(F.lit(SEED), F.col("_id"))
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .select(F.col("doc_id").cast("bigint").alias("_id"), F.col(label).cast("int").alias("_label"))
        .orderBy(order, "_id", "_label")
        .limit(rows)
    )
    texts = docs.select(id_key().alias("_id"), whole_text().alias("text"))
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    sample = texts.join(F.broadcast(marks), "_id").groupBy("_id", "_label").agg(one)
    sample = sample.select("_label", "_id", "text").coalesce(FIT_PARTS)
    buckets = options.get("buckets", BUCKETS)

    def count(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = text.encode().split()
                different = Counter(words)
                ids, of = word_features(list(different), buckets)
                times = np.fromiter(different.values(), np.float64, len(different))
                total = np.bincount(ids, weights=times[of], minlength=buckets)
                total[repeat_mark(buckets)] += MARKS * repeats(words)
                used = np.flatnonzero(total)
                out.append((used.astype(np.int32), total[used].astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_label"),
                    batch.column("_id"),
                    pa.array([ids.tobytes() for ids, _ in out], pa.binary()),
                    pa.array([counts.tobytes() for _, counts in out], pa.binary()),
                ],
                ["label", "id", "ids", "counts"],
            )

    counted = sample.mapInArrow(count, "label int, id long, ids binary, counts binary")
    found, size = [], 0
    for r in counted.toLocalIterator():
        if size < FIT_BYTES:
            size += len(r.ids) + len(r.counts)
            found.append(
                (r.id, r.label, np.frombuffer(r.ids, np.int32), np.frombuffer(r.counts, np.float32))
            )
    found.sort(key=lambda row: row[:2])
    return train([row[1:] for row in found], **options)


class _Scorer:
    """For each word the sum of what its features add, and their number as imaginary part."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.mark = complex(weights[repeat_mark(len(weights))], 1)
        self.known: dict[bytes, complex] = {}

    def _learn(self, words: list[bytes]) -> None:
        ids, of = word_features(words, len(self.weights))
        sums = np.bincount(of, weights=self.weights[ids], minlength=len(words))
        counts = np.bincount(of, minlength=len(words))
        self.known.update(zip(words, (sums + 1j * counts).tolist(), strict=True))

    def scores(self, texts: Sequence[str | None]) -> list[float]:
        out = []
        for at in range(0, len(texts), TOGETHER):
            out += self._some(texts[at : at + TOGETHER])
        return out

    def _some(self, texts: Sequence[str | None]) -> list[float]:
        split = [(text or "").encode().split() for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if new := set().union(*split).difference(self.known):
            self._learn(list(new))
        out = []
        for words in split:
            total = sum(map(self.known.__getitem__, words), MARKS * repeats(words) * self.mark)
            odds = self.bias + (total.real / total.imag if total.imag else 0.0)
            out.append(float(1 / (1 + np.exp(-odds))))
        return out


_scorers: dict[str, _Scorer] = {}


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> Column:
    """Probability of label 1 of each text, a column of ``docs``."""
    weights, bias = model.contrast()
    sent = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))
    name = model.name

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = _Scorer(*sent.value)
        scorer = _scorers[name]
        for batch in texts:
            yield pd.Series(scorer.scores(batch.tolist()), dtype="float64")

    return scored(F.col(text))
