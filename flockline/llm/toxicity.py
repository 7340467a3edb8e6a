"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashes of its lower-cased words, of their stems (the first STEM bytes of
longer words, so that inflections share a feature), of adjacent pairs, and of pairs with one word
between them, each once a text.  FTRL-proximal keeps a rate for every coordinate; its L1 term
leaves nearly all weights at exactly zero, so the model is a short list of (feature, weight) that is
broadcast: DIMENSIONS bounds it.

The model is fitted on a bounded sample: TRAINING labelled documents at most, the first in the order
of a hash of their ids, so that reruns agree.  One task fits them in that order.  Scoring covers all
documents, whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernels as kn
from ._session import cut, ship

U = np.uint64
BITS = 20
DIMENSIONS = 1 << BITS
TRAINING = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 1.0
STEM = 4
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2

#: ASCII letters in lower case, digits and all bytes beyond ASCII stay; the rest separates words.
TOKEN_BYTES = np.full(256, 0x20, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    TOKEN_BYTES[_b] = _b
TOKEN_BYTES[65:91] = np.arange(97, 123)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves HELD_OUT modulo FOLDS; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, repeats included."""
    data = TOKEN_BYTES[data]
    starts, ends, woff = kn.words(data, offsets)
    w = kn.word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(woff))
    long_ = ends - starts > STEM
    stems = kn.mix64(kn.word_hashes(data, starts[long_], starts[long_] + STEM) + U(7))
    rows, found = [row, row[long_]], [w, stems]
    for gap in (1, 2):
        if len(w) > gap:
            inside = row[gap:] == row[:-gap]
            pair = kn.mix64(w[:-gap] * U(3) + kn.mix64(w[gap:] + U(gap)))
            rows.append(row[:-gap][inside])
            found.append(pair[inside])
    return np.concatenate(rows), (np.concatenate(found) >> U(64 - BITS)).astype(np.int64)


def _sample_features(batches):
    for batch in batches:
        data, offsets = kn.flat_text(batch.column("text"))
        blocks = [b""] * batch.num_rows
        for a, b in kn.chunks(offsets):
            row, feature = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            pairs = np.unique(row * DIMENSIONS + feature)
            cuts = np.searchsorted(pairs, np.arange(b - a + 1) * DIMENSIONS)
            for i in range(b - a):
                blocks[a + i] = (pairs[cuts[i] : cuts[i + 1]] % DIMENSIONS).astype(np.uint32).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("one"), batch.column("place"), batch.column("toxic"), pa.array(blocks, pa.binary())], ["one", "place", "toxic", "features"])


def ftrl(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights (most of them zero) and bias after FTRL-proximal over the examples in their order."""
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    zb = nb = 0.0

    def weight(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    def bias():
        return -zb / ((BETA + nb**0.5) / ALPHA)

    for _ in range(epochs):
        for at, y in examples:
            zi, ni = z[at], n[at]
            w = weight(zi, ni)
            b = bias()
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - y
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - step * w
            n[at] = ni + g * g
            zb += g - (((nb + g * g) ** 0.5 - nb**0.5) / ALPHA) * b
            nb += g * g
    return weight(z, n), float(bias())


def _train(table: pa.Table) -> pa.Table:
    order = np.argsort(np.asarray(table.column("place")), kind="stable")
    labels = np.asarray(table.column("toxic"))
    blocks = table.column("features").combine_chunks()
    w, b = ftrl([(np.frombuffer(blocks[int(i)].as_py(), np.uint32), int(labels[i])) for i in order])
    at = np.flatnonzero(w)
    return pa.Table.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[b, w[at]])], ["feature", "weight"])


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Features, weights and bias from docs (doc_id, text) and labels (doc_id, toxic).

    Rows of the held-out fold, null labels and null ids are not used; several labels of a document
    count as toxic if one is; of rows that share an id one is learned.  None without usable labels.
    """
    ship(docs.sparkSession)
    usable = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # at most `most` rows of three numbers: a bounded side
    chosen = chosen.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(most)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = sample.select(F.lit(1).alias("one"), "place", "toxic", "text").mapInArrow(_sample_features, "one int, place long, toxic int, features binary")
    # of rows that share an id one is learned, so a hot id does not grow the sample
    rows = rows.groupBy("one", "place", "toxic").agg(F.min("features").alias("features"))
    model = cut(rows.groupBy("one").applyInArrow(_train, "feature long, weight double")).orderBy("feature").collect()
    if not model:
        return None
    return np.array([r.feature for r in model[1:]], np.int64), np.array([r.weight for r in model[1:]]), model[0].weight


def _score(shared):
    def run(batches):
        model = shared.value
        table = np.zeros(DIMENSIONS)
        if model:
            table[model[0]] = model[1]
        used = table != 0
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if model:
                data, offsets = kn.flat_text(batch.column("text"))
                for a, b in kn.chunks(offsets):
                    row, feature = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    hit = used[feature]
                    pairs = np.unique(row[hit] * DIMENSIONS + feature[hit])
                    total = np.bincount(pairs // DIMENSIONS, table[pairs % DIMENSIONS], b - a) + model[2]
                    score[a:b] = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None) -> DataFrame:
    """doc_id and score of each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(shared), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text).

    Defined cases: null and empty texts get the score of the bias alone; without usable labels all
    scores are 0; a null doc_id is not held out and never trained on; rows that share a doc_id are
    scored each; an empty table gives an empty result; other columns are ignored.
    """
    scored = score(docs, fit(docs, labels))
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text is not predicted toxic, with all their columns."""
    model = fit(docs, labels)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorer = _score(shared)

    def keep(batches):
        for batch in batches:
            for scored in scorer(iter([batch])):
                yield batch.filter(pc.less(scored.column("score"), THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
