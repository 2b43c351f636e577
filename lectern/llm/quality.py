"""Quality classification by co-training two views (operator 4).

One classifier sees the text (its words, what its letters and signs follow each other, how its words repeat), the other the
metadata of the page (source, language, size).  Both start from the labelled rows.  In each round each view is
calibrated and labels those unlabelled rows that it is confident of; these teach the *other* view for the
next round.  At the end the calibrated views are combined, as evidence that is independent given the label, and
all documents are scored.

A view is a pair of steps.  Naive Bayes over hashed features (words and byte trigrams; source, language, both together and
size class) learns from counts, so that it takes pseudo-labels from *all* rows: each round goes over the whole table, and tasks
send sums of counts.  A small logistic regression then weighs these log-odds with some dense features; it and the
calibration are fitted on labelled rows that the counts do not have.  Only labelled rows are sampled: at most
``labelled``, those with the smallest hash of their id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, rolling

#: Bound of the sample of labelled rows that the classifiers start from.
LABELLED = 10_000
ROUNDS = 2
#: Tasks that read the sample.
SAMPLE_FILES = 16
#: Least probability by one view for a label that the other view learns from.
CONFIDENT = 0.95
#: Of every five labelled rows three are counted, one fits the regression and one calibrates.
PARTS = 5
KEEP_AT = 0.5
#: Hashed features of each kind: words, byte trigrams; source, language, source with language, size class.
WORDS, GRAMS, META = 1 << 13, 1 << 13, 1 << 10
#: Added to each count, and the most that one feature's log-odds may say.
PRIOR, MOST = 0.5, 4.0

_CLASSES = 16
_DENSE = _CLASSES * _CLASSES + 7
_COLUMNS = ("doc_id", "text", "source", "lang", "n_chars")


def _byte_classes() -> np.ndarray:
    table = np.full(256, 15, np.int64)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\v\f\r", None, ".", ",", "!?", "*#$%&@~^", "|", "\"'`()[]{}", "-_/\\", ":;", "<>=+"]
    for k, group in enumerate(groups):
        for c in group or ():
            table[ord(c)] = k
    table[128:] = 5
    return table


_CLASS = _byte_classes()


@dataclass
class Features:
    """Hashed features of some rows by kind, as (row, bucket) pairs, and dense ones as a matrix a view."""

    n: int
    hashed: list[tuple[np.ndarray, np.ndarray]]
    dense: np.ndarray


def text_features(column: pa.Array) -> Features:
    """Words and byte trigrams; root shares of character-class pairs, and how words repeat and look."""
    words = rolling.Words(column)
    n = len(column)
    at = words.at
    size = np.diff(at)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    kind = _CLASS[words.data]
    inside = owner[1:] == owner[:-1]
    pair = np.bincount((owner[:-1].astype(np.int64) * 256 + kind[:-1] * _CLASSES + kind[1:])[inside], minlength=n * 256).reshape(n, 256)
    count = np.diff(words.first)
    many = np.maximum(count, 1)
    hashes = words.hashes()
    doc = np.repeat(np.arange(n), count)
    again = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    order = np.lexsort((hashes, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][fresh], minlength=n)
    length = words.end - words.start
    first = kind[words.start] if len(words.start) else np.empty(0, np.int64)
    final = kind[words.end - 1] if len(words.end) else np.empty(0, np.int64)
    stats = [
        again / many, np.log1p(distinct) / np.log1p(many), np.log1p(count) / 10, np.bincount(doc, length, n) / many / 10,
        np.bincount(doc, length == 1, n) / many, np.bincount(doc, first == 1, n) / many, np.bincount(doc, final >= 6, n) / many,
    ]
    data = words.data.astype(np.uint32)
    gram = ((data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA77) ^ data[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(19)) % np.uint32(GRAMS)
    whole = inside[1:] & inside[:-1]
    dense = np.concatenate((np.sqrt(pair / np.maximum(size - 1, 1)[:, None]), np.stack(stats, axis=1)), axis=1).astype(np.float32)
    return Features(n, [(doc, (hashes >> np.uint64(51)).astype(np.int64) % WORDS), (owner[:-2][whole], gram[whole].astype(np.int64))], dense)


def _bucket(value) -> int:
    return zlib.crc32(repr(value).encode()) % META


def meta_features(source: list, lang: list, n_chars: list) -> Features:
    """Source, language, both together and size class, hashed; the size. Null is a value of its own."""
    n = len(source)
    known = np.array([np.nan if v is None else max(float(v), 0) for v in n_chars], np.float64)
    size = np.log1p(np.nan_to_num(known))
    classes = [None if np.isnan(v) else int(2 * s) for v, s in zip(known, size, strict=True)]
    kinds = [source, lang, list(zip(source, lang, strict=True)), classes]
    row = np.arange(n)
    hashed = [(row, np.array([_bucket(v) for v in values], np.int64)) for values in kinds]
    return Features(n, hashed, np.stack((size / 10, (size / 10) ** 2, np.isnan(known)), axis=1).astype(np.float32))


KINDS = ((WORDS, GRAMS), (META,) * 4)


def counted(features: Features, sizes: tuple[int, ...], weight: np.ndarray) -> np.ndarray:
    """Of each kind's buckets the weighted shares of the rows in them, all kinds in a row. A row gives each kind the weight 1 in all."""
    out = []
    for (row, bucket), size in zip(features.hashed, sizes, strict=True):
        per = np.maximum(np.bincount(row, minlength=features.n), 1)
        out.append(np.bincount(bucket, (weight / per)[row], size))
    return np.concatenate(out)


def odds(counts: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Log-odds of each bucket, from the counts of bad (row 0) and good rows (row 1): shares in the class, smoothed over the buckets."""
    out, at = [], 0
    for size in sizes:
        own = counts[:, at : at + size]
        share = (own + PRIOR / size) / (own.sum(axis=1, keepdims=True) + PRIOR)
        out.append(np.clip(np.log(share[1] / share[0]), -MOST, MOST))
        at += size
    return out


def inputs(features: Features, tables: list[np.ndarray]) -> np.ndarray:
    """What the regression sees: the mean log-odds of each kind, and the dense features."""
    means = []
    for (row, bucket), table in zip(features.hashed, tables, strict=True):
        means.append(np.bincount(row, table[bucket], features.n) / np.maximum(np.bincount(row, minlength=features.n), 1))
    return np.concatenate((np.stack(means, axis=1), features.dense.astype(np.float64)), axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights (the last is the constant) of a ridge-penalised logistic regression, by Newton steps."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype))).astype(np.float64)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


@dataclass
class View:
    """A classifier with its calibration: log-odds = slope * margin + shift."""

    tables: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0

    def log_odds(self, features: Features) -> np.ndarray:
        if self.weights is None:
            return np.full(features.n, self.shift)
        return self.slope * (inputs(features, self.tables) @ self.weights[:-1] + self.weights[-1]) + self.shift


def _probability(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))


@dataclass
class Model:
    text: View
    meta: View
    prior: float

    def score(self, text: Features, meta: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality by the text, by the metadata, and by both."""
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        return tuple(_probability(v) for v in (a, b, a + b - self.prior))


def _views(batch: pa.RecordBatch) -> tuple[Features, Features]:
    return text_features(batch.column("text")), meta_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))


def _columns(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "double"}
    return docs.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c).alias(c) for c in _COLUMNS])


def sample_labels(labels: DataFrame, most: int = LABELLED) -> list[tuple[int, int]]:
    """(doc_id, label), at most ``most``, by the smallest hashes of ids. A document labelled twice counts as its lower label.

    Rows over a hash bound, set by the count, never leave their tasks; about ``most`` are ordered.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    total = known.count()
    share = (most + 6 * most**0.5 + 50) / max(total, 1)  # six deviations more than asked
    some = known if share >= 1 else known.where(F.col("h") < int(share * 2**64) - 2**63)
    rows = sorted(some.collect(), key=lambda r: (r["h"], r["doc_id"]))
    return [(r["doc_id"], r["y"]) for r in rows[:most]]


def _sums(rows: DataFrame, emit) -> dict[tuple[int, int], np.ndarray]:
    """Sums over all rows of the counts that ``emit(batch)`` gives as {(view, label): counts}: one vector a task, added up in Spark."""

    def step(batches: Iterator[pa.RecordBatch]):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in common.pieces(batches, "text"):
            for key, counts in emit(batch).items():
                sums[key] = sums[key] + counts if key in sums else counts
        for (view, label), counts in sums.items():
            at = np.flatnonzero(counts)
            yield common.batch_of(view=np.full(len(at), view, np.int32), label=np.full(len(at), label, np.int32), k=at.astype(np.int32), x=counts[at])

    parts = common.arrow_map(rows, step, "view int, label int, k int, x double").groupBy("view", "label", "k").agg(F.sum("x").alias("x"))
    out: dict[tuple[int, int], np.ndarray] = {(v, y): np.zeros(sum(KINDS[v])) for v in (0, 1) for y in (0, 1)}
    found = parts.toArrow()  # at most the buckets of both views and labels
    view, label, k, x = (found.column(c).to_numpy() for c in ("view", "label", "k", "x"))
    for key, table in out.items():
        own = (view == key[0]) & (label == key[1])
        table[k[own]] = x[own]
    return out


def _joined(batch: pa.RecordBatch, weights: tuple[np.ndarray, np.ndarray], features: tuple[Features, Features]) -> dict[tuple[int, int], np.ndarray]:
    """Counts of both views for rows with labels (-1: none) that each view learns from."""
    out = {}
    for v in (0, 1):
        for y in (0, 1):
            own = (weights[v] == y).astype(np.float64)
            if own.any():
                out[v, y] = counted(features[v], KINDS[v], own)
    return out


def _fitted(sample: DataFrame, counts: dict[tuple[int, int], np.ndarray], prior: float) -> Model:
    """Both views' regressions and calibrations, for given counts. sample: labelled rows with y and part."""
    tables = [odds(np.stack((counts[v, 0], counts[v, 1])), KINDS[v]) for v in (0, 1)]

    def step(batches):
        for batch in common.pieces(batches, "text"):
            rows = [inputs(f, t).astype(np.float32) for f, t in zip(_views(batch), tables, strict=True)]
            yield common.batch_of(doc_id=batch.column("doc_id"), y=batch.column("y"), part=batch.column("part"), text=pa.array([r.tobytes() for r in rows[0]], pa.binary()), meta=pa.array([r.tobytes() for r in rows[1]], pa.binary()))

    rows = common.arrow_map(sample.where("part > 0"), step, "doc_id long, y int, part int, text binary, meta binary").toPandas()
    rows = rows.sort_values(["doc_id", "y", "text"], kind="stable")
    y, part = rows["y"].to_numpy(int), rows["part"].to_numpy(int)
    views = []
    for v, name in enumerate(("text", "meta")):
        learn, hold = part == 1, part == 2
        if len(np.unique(y[learn])) < 2:
            views.append(View(shift=prior))
            continue
        x = np.frombuffer(b"".join(rows[name]), np.float32).reshape(len(rows), -1).astype(np.float64)
        w = logistic(x[learn], y[learn])
        slope, shift = 1.0, 0.0
        if len(np.unique(y[hold])) == 2:
            slope, shift = logistic((x[hold] @ w[:-1] + w[-1])[:, None], y[hold], ridge=1e-3).tolist()
        views.append(View(tables[v], w, slope, shift))
    return Model(views[0], views[1], prior)


def pseudo_labels(model: Model, features: tuple[Features, Features], confident: float = CONFIDENT) -> tuple[np.ndarray, np.ndarray]:
    """What each view learns of some rows from the other: the label the other is confident of, or -1."""
    out = []
    for view, own in ((model.meta, features[1]), (model.text, features[0])):
        p = _probability(view.log_odds(own))
        out.append(np.where(p >= confident, 1, np.where(1 - p >= confident, 0, -1)))
    return out[0], out[1]


def mixed(known: dict, taught: dict) -> dict:
    """Counts of labelled rows with those of pseudo-labelled ones, which together weigh no more than they do, a label at a time."""
    out = {}
    for key, counts in known.items():
        own, more = counts.sum(), taught[key].sum()
        out[key] = counts + taught[key] * min(1.0, own / more) if more > 0 else counts
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """The co-trained model. labels: (doc_id, quality 0 or 1).

    Of the labelled documents at most ``labelled`` are used; all others, and those without label, are the unlabelled rows, and
    each of them is judged in each round.  Without rows of both labels every score is the share of good ones (0.5 without labels),
    and so is that of a view whose regression sees one label only.  Labels of no document, null ones and others than 0 and 1 do
    not count; null texts count as empty; very long texts are read whole; rows of one id count each, with that id's label.
    """
    spark, docs = docs.sparkSession, _columns(docs)
    chosen = sample_labels(labels, labelled)
    good = sum(y for _, y in chosen) / len(chosen) if chosen else 0.5
    prior = float(np.log(np.clip(good, 1e-3, 1 - 1e-3) / np.clip(1 - good, 1e-3, 1)))
    if not 0 < good < 1 or len(chosen) < PARTS:
        return Model(View(shift=prior), View(shift=prior), prior)
    some = spark.createDataFrame([(d, y, (0, 0, 0, 1, 2)[k % PARTS]) for k, (d, y) in enumerate(chosen)], "doc_id long, y int, part int")
    sample = common.durable(docs.join(F.broadcast(some), "doc_id").repartition(SAMPLE_FILES, "doc_id"))  # at most ``labelled`` ids
    known = _sums(sample.where("part = 0"), lambda batch: _joined(batch, (batch.column("y").to_numpy(),) * 2, _views(batch)))
    model = _fitted(sample, known, prior)
    ids = np.sort(np.array([d for d, _ in chosen], np.int64))

    def taught_by(model: Model):
        def emit(batch: pa.RecordBatch):
            features = _views(batch)
            doc = batch.column("doc_id")
            other = ~np.isin(doc.fill_null(0).to_numpy(zero_copy_only=False), ids) | ~doc.is_valid().to_numpy(zero_copy_only=False)
            return _joined(batch, tuple(np.where(other, w, -1) for w in pseudo_labels(model, features)), features)

        return emit

    for _ in range(rounds):
        model = _fitted(sample, mixed(known, _sums(docs, taught_by(model))), prior)
    return model


def score(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep): every row; null texts count as empty, null metadata as a value.

    Very long texts are scored whole; equal rows have equal scores, and repeated ones each give a row; a score of exactly
    ``keep_at`` keeps; other columns play no part; an empty table gives no rows.
    """

    def step(batches):
        for batch in common.pieces(batches, "text"):
            by_text, by_meta, both = model.score(*_views(batch))
            yield common.batch_of(doc_id=batch.column("doc_id"), text_score=by_text, meta_score=by_meta, score=both, keep=both >= keep_at)

    return common.arrow_map(_columns(docs), step, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """Fits on the labels and all documents, and scores all documents. Nulls, ties and empty tables: as ``fit`` and ``score`` say."""
    return score(docs, fit(docs, labels, **bounds))
