"""Language identification with hyperdimensional profiles (operator 9).

Every letter has a random vector of +1 and -1.  A trigram's vector binds those of its letters, each permuted
by its place, by multiplication; a text's vector bundles its trigrams' vectors, weighted by the root of their
counts; a language's prototype bundles the unit vectors of its training texts.  A text belongs to the language
whose prototype, less the mean of all prototypes, has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIM = 512
SYMBOLS = 128
FOLDS = 5
UNKNOWN = "und"
#: Bytes of text that are profiled at a time: each letter takes some forty bytes on the way.
SLICE_BYTES = 1 << 20
#: Steepness of the softmax that turns cosines into a score.
SHARPNESS = 25.0
#: Score from which a text counts as in its best language: likelier than all others together.
LEAST_SCORE = 0.5
#: Texts of at least so many characters whose cosine with every prototype is less than that are in no language of the corpus.
ENOUGH, LEAST_COSINE = 100, 0.15


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for all but letters, one each for a-z and Latin-1 letters, shared ones for others."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if chr(point).isalpha():
            table[point] = 60 + point * 2654435761 % (1 << 32) % (SYMBOLS - 60)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    latin = np.arange(0xDF, 0x100)
    table[latin] = np.where(table[latin] > 0, 27 + latin - 0xDF, 0)
    return table


@lru_cache(maxsize=4)
def _letters(dim: int) -> list[np.ndarray]:
    """The symbols' vectors, permuted for each of the three places by cyclic shifts."""
    base = np.random.default_rng(9).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))
    return [np.roll(base, 2 - k, axis=1) for k in range(3)]


def _bound(grams: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of trigrams numbered in base SYMBOLS."""
    one, two, three = _letters(dim)
    return (one[grams // (SYMBOLS * SYMBOLS)] * two[grams // SYMBOLS % SYMBOLS] * three[grams % SYMBOLS]).astype(np.float32)


def profiles(texts: list[str | None], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Unit vector of each text, and whether it has a letter (else its vector is zero)."""
    padded = [f"\n{(t or '').lower()}\n" for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in padded])
    symbol = _symbol_table()[points].astype(np.int64)
    lettered = np.bincount(owner[symbol > 0], minlength=len(texts)) > 0
    stay = np.ones(len(symbol), bool)
    stay[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0) | (owner[1:] != owner[:-1])
    symbol, owner = symbol[stay], owner[stay]
    gram = (symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:]
    inside = (owner[:-2] == owner[2:]) & (gram > 0)
    key, count = np.unique(owner[:-2][inside] * SYMBOLS**3 + gram[inside], return_counts=True)
    owner, gram = key // SYMBOLS**3, key % SYMBOLS**3
    kinds, place = np.unique(gram, return_inverse=True)
    book = _bound(kinds, dim)
    weight = np.sqrt(count).astype(np.float32)
    out = np.zeros((len(texts), dim), np.float32)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        own = slice(bounds[k], bounds[k + 1])
        out[k] = weight[own] @ book[place[own]]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0), lettered


def train(docs: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """The languages in order, and their prototypes, from all rows with text and lang; null ones take no part."""

    def step(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in common.pieces(batches, "text", SLICE_BYTES):
            vectors, _ = profiles(batch.column("text").to_pylist(), dim)
            lang = np.array(batch.column("lang").to_pylist())
            for name in np.unique(lang).tolist():
                sums[name] = sums.get(name, 0) + vectors[lang == name].sum(axis=0, dtype=np.float64)
        if sums:
            yield common.batch_of(lang=list(sums), vector=pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64())))

    rows = docs.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    parts = common.arrow_map(rows, step, "lang string, vector array<double>")
    parts = parts.select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found = parts.collect()  # languages x dim numbers
    langs = sorted({r["lang"] for r in found})
    out = np.zeros((len(langs), dim))
    for r in found:
        out[langs.index(r["lang"]), r["k"]] = r["x"]
    return langs, out


def contrast(prototypes: np.ndarray) -> np.ndarray:
    """Unit prototypes less their mean, as units again; a lone language keeps its own."""
    norm = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = prototypes / np.where(norm > 0, norm, 1)
    if len(unit) > 1:
        unit = unit - unit.mean(axis=0)
        norm = np.linalg.norm(unit, axis=1, keepdims=True)
        unit = unit / np.where(norm > 0, norm, 1)
    return unit


def _best(vectors: np.ndarray, lettered: np.ndarray, units: np.ndarray, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """The best language of each text (n_langs: none) and its score, by the texts' vectors."""
    if not n_langs:
        return np.zeros(len(vectors), int), np.zeros(len(vectors))
    cosine = (vectors @ units).astype(np.float64)
    share = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
    return np.where(lettered, cosine.argmax(axis=1), n_langs), np.where(lettered, share.max(axis=1) / share.sum(axis=1), 0.0)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score): the language of every text, from the text alone.

    score is the softmax share of the best language over sharpened cosines.  Null texts, texts without a letter,
    and all texts where nothing was learned, get ``und`` with score 0.
    """
    dim = prototypes.shape[1]
    units = contrast(prototypes).astype(np.float32).T

    def step(batches):
        names = np.array([*langs, UNKNOWN], dtype=object)
        for batch in common.pieces(batches, "text", SLICE_BYTES):
            best, score = _best(*profiles(batch.column("text").to_pylist(), dim), units, len(langs))
            yield common.batch_of(doc_id=batch.column("doc_id"), lang_pred=names[best].tolist(), score=score)

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, languages: Collection[str] | None = None, least: float = LEAST_SCORE, dim: int = DIM) -> DataFrame:
    """The documents, all rows and columns, whose text is in one of ``languages`` (None: in any that was learned).

    Learns as ``identify`` does.  A text goes if it has no letter, if its best language is not among ``languages``, or if
    that language's score is under ``least``, or if it is long enough to tell and like no prototype at all, as texts in other
    scripts are.  Where nothing can be learned, for want of labelled rows, texts with a letter stay.
    Null texts go; repeated rows are judged alike; column names do not matter.
    """
    langs, prototypes = train(docs.where(fold("doc_id") != 0), dim)
    units = contrast(prototypes).astype(np.float32).T
    norm = np.linalg.norm(prototypes, axis=1, keepdims=True)
    plain = (prototypes / np.where(norm > 0, norm, 1)).astype(np.float32).T
    field = common.own_name(docs, "text")
    asked = np.array([languages is None or name in languages for name in langs] + [False])

    def step(batches):
        for batch in common.pieces(batches, "row", SLICE_BYTES, field):
            texts = common.child(batch, "row", field).to_pylist()
            vectors, stay = profiles(texts, dim)
            if langs:
                best, score = _best(vectors, stay, units, len(langs))
                short = np.array([len(t or "") < ENOUGH for t in texts])
                stay = asked[best] & (score >= least) & (short | ((vectors @ plain).max(axis=1) >= LEAST_COSINE))
            yield batch.filter(pa.array(stay))

    rows = docs.select(F.struct("*").alias("row"))
    return common.arrow_map(rows, step, rows.schema).select("row.*")


def fold(doc_id):
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def identify(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from the rows outside fold 0, predicts all.

    A row's fold is the crc32 of its id as text, modulo FOLDS; rows without doc_id are in none, teach nothing and are
    predicted.  Predictions see the text alone, the whole of it however long; null texts and those without a letter are ``und``
    with score 0, and so is every text where nothing was learned.  Of languages equally near the first by name wins.
    Repeated rows each give a row and teach as often; other columns play no part; an empty table gives no rows.
    """
    langs, prototypes = train(docs.where(fold("doc_id") != 0), dim)
    return predict(docs, langs, prototypes).select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
