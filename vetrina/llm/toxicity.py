"""Operator 10, toxicity by multiple-instance learning.

A document is a bag of sentences; only documents carry labels.  A sentence's
score is a logistic function of its words, and a document's is their
noisy-or together with a small leak: toxic unless every sentence and the
leak stay silent.  Training on document labels therefore teaches sentence
scores, which then point at the offending sentences.

1. Labels meet ids first, without any text.  About ``train_rows`` documents of
   each label (all, if fewer) are training documents, by a hash of the id;
   their ids, a bounded table, are broadcast, so texts are read where they
   are and never shuffled.
2. A word's features are itself and its beginnings of 4 to 7 letters, so
   that inflected forms share what they begin with.  Feature statistics are
   counted over the training documents (one partial count per task and
   feature); those whose log odds differ most reliably between the labels
   are used.  Their number is bounded (``max_words``), which bounds what is
   broadcast.
3. The noisy-or model is fitted on the driver to a part of the training
   documents, reduced to feature numbers (about ``sample_rows`` of each
   label, smallest hash of the id first).
4. Every whole text is scored in Arrow batches.

Only text enters a score.  Defined cases: null and empty texts have no
sentence and get the leak; labels that are null or without document are not
used, and of several labels of one id the largest counts; rows that share an
id are rows of their own and never trained on, as their label does not say
which it means; a null id is scored and never trained on; without
documents of both labels, every score is the mean label (0 without labels);
other columns are neither read nor returned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetrina.llm.common import each, materialize, whole_text

THRESHOLD, TRAIN_ROWS, SAMPLE_ROWS, MAX_WORDS, LEAST_Z, LEAST_DOCS = 0.7, 100_000, 8000, 4096, 4.0, 8
_SENTENCE, _WORD = re.compile(r"[^.!?\n\r]+"), re.compile(r"[^\W\d_]+")
_BEGINNINGS, _COUNTED, _REMEMBERED = range(4, 8), 200_000, 50_000


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    leak: float

    def sentence(self, words) -> float:
        return _sigmoid(self.bias + sum(self.weights[w] for w in words))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.findall(text) if not s.isspace()]


class _Features(dict):
    """Word -> its features (those in ``known``, if given), remembered."""

    def __init__(self, known=None):
        super().__init__()
        self._known = known

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > _REMEMBERED:
            self.clear()
        made = (word + "$", *(word[:k] for k in _BEGINNINGS if k <= len(word)))
        made = self[word] = made if self._known is None else tuple(f for f in made if f in self._known)
        return made

    def of(self, text: str) -> set[str]:
        """Features of the distinct words of a text."""
        return set(chain.from_iterable(map(self.__getitem__, set(_WORD.findall(text.lower())))))


def held_out(id_col: str) -> Column:
    """Rows never trained on: crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled_ids(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(row_id, label, place) of documents that may be trained on; ``place``
    is a hash of the id, from 0 to 1.  No text is read."""
    own = labels.select(F.col(f"`{id_col}`").alias("row_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    own = own.where("row_id is not null and label is not null").groupBy("row_id").agg(F.max("label").alias("label"))
    ids = docs.where(~held_out(id_col)).groupBy(F.col(f"`{id_col}`").alias("row_id")).agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    place = F.shiftrightunsigned(F.xxhash64("row_id"), 11) / float(1 << 53)
    return ids.join(own, "row_id").select("row_id", (F.col("label") > 0).cast("int").alias("label"), place.alias("place"))


def chosen(ids: DataFrame, totals: dict[int, int], most: int) -> DataFrame:
    """About ``most`` ids of each label, those that hash lowest."""
    return ids.where(F.col("place") < F.when(F.col("label") == 1, most / max(1, totals[1])).otherwise(most / max(1, totals[0])))


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Label and text of a bounded number of ids, read in place."""
    rows = docs.select(F.col(f"`{id_col}`").alias("row_id"), whole_text(text_col).alias("text"))
    return rows.join(F.broadcast(ids.select("row_id", "label")), "row_id").select("label", "text")


def _count_words(batches):
    """Documents of either label per word, summed within the task."""
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    count, features = (Counter(), Counter()), _Features()

    def flush():
        words = list(count[0] | count[1])
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([count[y][w] for w in words], pa.int64()) for y in (1, 0))], schema=schema)
        for c in count:
            c.clear()
        return out

    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), each(batch.column("text")), strict=True):
            count[label].update(features.of(text))
            if len(count[0]) + len(count[1]) > _COUNTED:
                yield flush()
    yield flush()


def choose_words(rows: DataFrame, totals: dict[int, int], max_words: int) -> list[str]:
    """Words with the most reliable difference in log odds."""
    counts = rows.mapInArrow(_count_words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / (totals[1] - F.col("t") + 0.5)) - F.log(c / (totals[0] - F.col("c") + 0.5))
    z = F.abs(odds) / F.sqrt(1 / t + 1 / c)
    chosen = counts.where(F.col("t") + F.col("c") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z)
    return sorted(r["word"] for r in chosen.orderBy(F.desc("z"), "word").limit(max_words).collect())


def fit(bags: list[tuple[int, int, list[list[int]]]], n_words: int, steps: int = 400, rate: float = 0.1, penalty: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak (as logit) of the noisy-or model.  A bag is
    (label, sentences without features, features of each other sentence)."""
    y = np.array([b[0] for b in bags], float)
    plain = np.array([b[1] for b in bags], float)
    doc = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])
    lists = [s for b in bags for s in b[2]]
    sent, feat = np.repeat(np.arange(len(lists)), [len(s) for s in lists]), np.array([f for s in lists for f in s], int)
    theta = np.concatenate([np.zeros(n_words), [-6.0, -3.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        w, bias, leak = theta[:-2], theta[-2], theta[-1]
        p = sig(bias + np.bincount(sent, w[feat], len(lists))) if len(lists) else np.zeros(0)
        p0, lk = sig(bias), sig(leak)
        quiet = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + plain * np.log1p(-p0) + np.log1p(-lk)
        silent = np.exp(np.minimum(quiet, -1e-9))
        # derivative of the loss by the log of staying silent, times -1
        pull = np.where(y > 0, -silent / (1 - silent), 1.0) / len(y)
        by_sentence = pull[doc] * p
        grad = np.concatenate([np.bincount(feat, by_sentence[sent], n_words) + penalty * w, [by_sentence.sum() + (pull * plain).sum() * p0, pull.sum() * lk]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-2], float(theta[-2]), float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          train_rows: int = TRAIN_ROWS, sample_rows: int = SAMPLE_ROWS, max_words: int = MAX_WORDS) -> Model:
    ids = materialize(labelled_ids(docs, labels, id_col, label_col), "labelled-ids")
    totals = {0: 0, 1: 0} | {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals[0] or not totals[1]:
        return Model({}, -40.0, totals[1] / max(1, sum(totals.values())))
    training = materialize(chosen(ids, totals, train_rows), "training-ids")
    used = {0: 0, 1: 0} | {r["label"]: r["n"] for r in training.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    words = choose_words(texts_of(docs, training, id_col, text_col), used, max_words)
    number = {w: i for i, w in enumerate(words)}
    sample = texts_of(docs, chosen(training, totals, sample_rows), id_col, text_col)

    def reduce(batches):
        known = _Features(number)
        for batch in batches:
            plain, features = [], []
            for text in each(batch.column("text")):
                found = [sorted(number[f] for f in known.of(s)) for s in sentences(text)]
                features.append([f for f in found if f])
                plain.append(len(found) - len(features[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(plain, pa.int32()), pa.array(features, pa.list_(pa.list_(pa.int32())))], ["label", "plain", "features"])

    bags = [(r["label"], r["plain"], r["features"]) for r in sample.mapInArrow(reduce, "label int, plain int, features array<array<int>>").toLocalIterator()]
    weights, bias, leak = fit(bags, len(words))
    # the sample's share of toxic documents may differ from that of all; the
    # leak, which carries documents without any cue, is set from all of them
    share = totals[1] / sum(totals.values())
    got = min(max(sum(b[0] for b in bags) / max(1, len(bags)), 1e-6), 1 - 1e-6)
    odds = share / (1 - share) * (1 - got) / got
    return Model(dict(zip(words, weights.tolist(), strict=True)), bias, _sigmoid(leak + math.log(odds)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score, predicted, and the sentences whose own
    score reaches one half, as array<struct<sentence, score>>."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        known, p0 = _Features(model.weights), _sigmoid(model.bias)
        for batch in batches:
            scores, found = [], []
            for text in each(batch.column("text")):
                quiet, hits = 1 - model.leak, []
                for s in sentences(text):
                    words = known.of(s)
                    p = model.sentence(words) if words else p0
                    quiet *= 1 - p
                    if p >= 0.5:
                        hits.append({"sentence": s.strip(), "score": p})
                scores.append(1 - quiet)
                found.append(hits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                 pa.array(found, pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())])))],
                ["row_id", "held_out", "score", "predicted", "toxic_sentences"])

    rows = docs.select(F.col(f"`{id_col}`").alias("row_id"), whole_text(text_col).alias("text"), held_out(id_col).alias("held_out"))
    schema = f"row_id {id_type}, held_out boolean, score double, predicted int, toxic_sentences array<struct<sentence: string, score: double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("row_id", id_col)


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as
    they were; each row is decided by its own text, without a join."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        known, p0 = _Features(model.weights), _sigmoid(model.bias)
        for batch in batches:
            keep = []
            for text in each(batch.column(at)):
                quiet = 1 - model.leak
                for s in sentences("" if text is None else str(text)):
                    words = known.of(s)
                    quiet *= 1 - (model.sentence(words) if words else p0)
                keep.append(1 - quiet < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
