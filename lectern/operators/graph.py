"""Sentence graphs: components, Markov centrality, and redundancy-penalised ranking.

Where a graph's nodes come from a bounded retrieval (top k of a cluster), a cluster's matrix fits in a worker, and the
two sequential loops run as one grouped function a cluster, on the nodes and edges of that cluster together.  The walk
over all sentences of a cluster (``stationary``) never builds that matrix.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import vectors as V
from lectern.shipping import ship

DAMP, STEPS = 0.85, 30
NODE = ["cid", "doc_id", "sent_idx"]
#: Row sums of similarities up to this are the rounding of none: weights of shared terms are far larger.
NOTHING = 1e-9


def nodes(rows: DataFrame, scale: bool = False, passage: bool = False, score: str = "score") -> DataFrame:
    """Retrieved rows with ``i``, a dense number in document order, and ``rel``, their score as a share.

    scale: min-max first.  passage: through tanh of the root.  Equal shares where all scores are 0.
    """
    from pyspark.sql import Window

    x = F.col(score)
    if scale:
        rows = rows.withColumn("_x", V.min_max(x, "cid"))
        x = F.col("_x")
    if passage:
        x = V.passage_transform(x)
    rows = rows.withColumn("_y", x).withColumn("rel", V.l1(F.col("_y"), "cid"))
    order = Window.partitionBy("cid").orderBy("doc_id", "sent_idx")
    return rows.withColumn("i", F.row_number().over(order) - 1).drop("_x", "_y")


def in_document_order(rows: DataFrame) -> DataFrame:
    """All sentences of a cluster with ``i``, a dense number in document order. Only its documents, not its sentences, meet in one task."""
    from pyspark.sql import Window

    before = Window.partitionBy("cid").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("cid", "doc_id").agg(F.count("*").alias("_n")).select("cid", "doc_id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("cid", "doc_id").orderBy("sent_idx"))
    return rows.join(starts, ["cid", "doc_id"]).withColumn("i", (F.col("_start") + own - 1).cast("int")).drop("_start")


def edges(similar: DataFrame, numbered: DataFrame) -> DataFrame:
    """(cid, i, j, w): similarity edges between numbered nodes. Both ends must be nodes."""
    a = numbered.select("cid", F.col("doc_id").alias("i_doc"), F.col("sent_idx").alias("i_sent"), "i")
    b = numbered.select("cid", F.col("doc_id").alias("j_doc"), F.col("sent_idx").alias("j_sent"), F.col("i").alias("j"))
    return similar.join(a, ["cid", "i_doc", "i_sent"]).join(b, ["cid", "j_doc", "j_sent"]).select("cid", "i", "j", "w")


def scaled_edges(rows: DataFrame) -> DataFrame:
    """Weights min-max scaled in their cluster, where a missing pair has weight 0."""
    low = F.lit(0.0)
    high = rows.groupBy("cid").agg(F.max("w").alias("_high"))
    return rows.join(high, "cid").withColumn("w", F.coalesce(F.try_divide(F.col("w") - low, F.col("_high") - low), low)).drop("_high")


def _matrix(n: int, edges: pd.DataFrame) -> np.ndarray:
    """The zero-diagonal similarity with rows that sum to 1, or to 0."""
    m = np.zeros((n, n))
    m[edges["i"].to_numpy(), edges["j"].to_numpy()] = edges["w"].to_numpy()
    np.fill_diagonal(m, 0.0)
    total = m.sum(axis=1, keepdims=True)
    return np.divide(m, total, out=np.zeros_like(m), where=total > 0)


def _own(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns under identities of their own: nodes and edges stem from the same rows."""
    return rows.select(*[F.col(c).alias(c) for c in columns])


def markov(numbered: DataFrame, edges: DataFrame, damp: float = DAMP, steps: int = STEPS) -> DataFrame:
    """(cid, i, score): where a walk is after ``steps`` steps that follow edges with chance ``damp``, else the relevance.

    Nodes: (cid, i, rel).  damp = 1 means no relevance: 0.85 with equal shares.  A node without edges moves by relevance.
    """
    biased, damp = damp != 1.0, 0.85 if damp == 1.0 else damp

    def walk(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("i")
        n = len(own)
        if not n:
            return pd.DataFrame({"cid": [], "i": [], "score": []})
        rel = own["rel"].to_numpy() if biased else np.full(n, 1 / n)
        m = _matrix(n, links)
        lone = m.sum(axis=1) == 0
        p = rel.copy()
        for _ in range(steps):
            p = damp * (p @ m + p[lone].sum() * rel) + (1 - damp) * rel
        return pd.DataFrame({"cid": key[0], "i": own["i"].to_numpy(), "score": p})

    ship(numbered.sparkSession)
    both = _own(numbered, "cid", "i", "rel").groupBy("cid").cogroup(_own(edges, "cid", "i", "j", "w").groupBy("cid"))
    return both.applyInPandas(walk, "cid string, i int, score double")


def _unpacked(batches):
    for batch in batches:
        for x in batch.column("block").to_pylist():
            cids, code, doc, sent, score, n = pickle.loads(x)
            cid = pa.DictionaryArray.from_arrays(pa.array(code), pa.array(cids, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([cid, pa.array(doc), pa.array(sent), pa.array(score), pa.array(n, pa.int64())], names=[*NODE, "score", "n"])


def stationary(sents: DataFrame, vocabulary: DataFrame, damp: float = DAMP, steps: int = STEPS) -> DataFrame:
    """(cid, doc_id, sent_idx, score, n): ``markov`` with equal shares over all n sentences of each cluster, whatever their number.

    sents: (cid, doc_id, sent_idx, terms); vocabulary: (cid, term, idf), with every term.  With W the matrix of TF-IDF
    weights, of length 1 a sentence, similarity is W W' less its diagonal of ones, so a step is two passes over the terms:
    mass goes from sentences to terms, the sums of all tasks meet in the driver (a number a term and cluster), and come back.
    What a term of one sentence only would bring back is that sentence's own share, so such terms stay out of the sums.
    Sentences stay where they are, in blocks of term numbers and counts.  The steps run when this is called.
    """
    spark = sents.sparkSession
    context = spark.sparkContext
    ship(spark)
    known = vocabulary.select(F.xxhash64("cid", "term").alias("h"), "idf").toArrow()
    hashes, idf = known["h"].to_numpy(), known["idf"].to_numpy()
    order = np.argsort(hashes)
    hashes, idf = hashes[order], idf[order]
    if (hashes[1:] == hashes[:-1]).any():
        raise ValueError("two terms have one hash")
    n_terms, words = len(hashes), context.broadcast((hashes, idf))

    def packed(batches):
        """Pickled blocks: cids, code of each row's cid, doc_id, sent_idx, terms a row, their numbers and counts."""
        for batch in batches:
            if not batch.num_rows:
                continue
            cid, h = batch.column("cid").dictionary_encode(), batch.column("h")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(h).to_numpy(zero_copy_only=False))
            at = np.searchsorted(words.value[0], h.flatten().to_numpy())
            pair, tf = np.unique(row * n_terms + at, return_counts=True)
            row, t = np.divmod(pair, max(n_terms, 1))
            tf = tf.astype(np.min_scalar_type(tf.max(initial=0)))
            block = cid.dictionary.to_pylist(), cid.indices.to_numpy(), batch.column("doc_id").to_numpy(), batch.column("sent_idx").to_numpy(), np.bincount(row, minlength=batch.num_rows).astype(np.int32), t.astype(np.int32), tf
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    single = BatchedSerializer(CPickleSerializer(), 1)  # equal batches, or zip would serialise all blocks again
    rows = sents.select(*NODE, F.transform("terms", lambda t: F.xxhash64("cid", t)).alias("h"))
    blocks = rows.mapInArrow(packed, "block binary").rdd.coalesce(context.defaultParallelism)  # one sum a core comes to the driver
    blocks = blocks.map(lambda r: bytes(r[0]))._reserialize(single).persist(StorageLevel.MEMORY_AND_DISK)

    def sizes(x: bytes):
        cids, code, *_ = pickle.loads(x)
        return list(zip(cids, map(int, np.bincount(code, minlength=len(cids))), strict=True))

    found = blocks.flatMap(sizes).reduceByKey(int.__add__).collectAsMap()
    if not found:
        return spark.createDataFrame([], "cid string, doc_id long, sent_idx int, score double, n long")

    def uses(those):
        out = np.zeros(n_terms, np.int32)
        for x in those:
            np.add.at(out, pickle.loads(x)[5], 1)
        yield out

    shared = blocks.mapPartitions(uses).treeReduce(np.add) > 1
    n_shared = int(shared.sum())
    number = context.broadcast(np.where(shared, np.cumsum(shared, dtype=np.int32) - 1, -1).astype(np.int32))
    place = {c: k for k, c in enumerate(sorted(found))}
    n_of, n_clusters = np.array([found[c] for c in place], float), len(place)

    def opened(x: bytes):
        """(cluster of each row, row and term of each weight of a shared term, weight, what a row's similarities sum to less than these: 1 less its other weights' squares)"""
        cids, code, _, _, each, t, tf = pickle.loads(x)
        row = np.repeat(np.arange(len(code)), each)
        raw = tf * words.value[1][t]
        norm = np.sqrt(np.bincount(row, raw * raw, len(code)))
        w, t = raw / norm[row], number.value[t]
        own = t < 0
        rest = (norm > 0) - np.bincount(row[own], w[own] ** 2, len(code))
        return np.array([place[c] for c in cids])[code], row[~own], t[~own], w[~own], rest

    def summed(pairs, mass):
        """The terms' sums over all rows, then the clusters' sums of what lies on rows without edges."""

        def part(those):
            out = np.zeros(n_shared + n_clusters)
            for x, state in those:
                k, row, t, w, _ = opened(x)
                linked, lone = mass(state, len(k))
                np.add.at(out, t, w * linked[row])
                out[n_shared:] += np.bincount(k, lone, n_clusters)
            yield out

        return context.broadcast(pairs.mapPartitions(part).treeReduce(np.add))  # few sums at once in the driver

    def spread_mass(state, _):
        total, p = state
        alone = total <= NOTHING
        return np.where(alone, 0.0, p / np.where(alone, 1.0, total)), np.where(alone, p, 0.0)

    def begin(x: bytes, sums):
        k, row, t, w, rest = opened(x)
        return np.bincount(row, w * sums.value[t], len(k)) - rest, 1 / n_of[k]

    def move(pair, sums):
        x, state = pair
        k, row, t, w, rest = opened(x)
        linked, _ = spread_mass(state, None)
        flow = np.bincount(row, w * sums.value[t], len(k)) - rest * linked
        return state[0], damp * (flow + sums.value[n_shared:][k] / n_of[k]) + (1 - damp) / n_of[k]

    first = summed(blocks.map(lambda x: (x, None)), lambda _, n: (np.ones(n), np.zeros(n)))
    state = blocks.map(lambda x: begin(x, first))._reserialize(single).persist(StorageLevel.MEMORY_AND_DISK)
    sums = summed(blocks.zip(state), spread_mass)
    for k in range(steps):
        last, state = state, blocks.zip(state).map(lambda pair, sums=sums: move(pair, sums))._reserialize(single).persist(StorageLevel.MEMORY_AND_DISK)
        used = sums
        if k < steps - 1:
            sums = summed(blocks.zip(state), spread_mass)
        else:
            state.count()
        last.unpersist()
        used.unpersist()  # a lost executor can still fetch it again

    def result(pair):
        cids, code, doc, sent, *_ = pickle.loads(pair[0])
        return (pickle.dumps((cids, code, doc, sent, pair[1][1], n_of[np.array([place[c] for c in cids])[code]].astype(np.int64))),)

    return spark.createDataFrame(blocks.zip(state).map(result), "block binary").mapInArrow(_unpacked, "cid string, doc_id long, sent_idx int, score double, n long")


def walked_whole(sents: DataFrame, vocabulary: DataFrame, damp: float = DAMP, steps: int = STEPS) -> DataFrame:
    """(cid, i, rank, score): ``stationary``, numbered in document order and ranked by multiples of an equal share, one task a cluster.

    The same walk over the same terms, but all steps of a cluster run where its sentences are: no sum leaves the task.  For
    clusters whose tokens fit in a worker, at 8 bytes each some four times over; ``stationary`` takes the others.
    """

    def walk(key: tuple, own: pa.Table, known: pa.Table) -> pa.Table:
        own = own.sort_by([("doc_id", "ascending"), ("sent_idx", "ascending")]) if own.num_rows else own
        n, h = own.num_rows, own.column("h").combine_chunks()
        row, h = np.repeat(np.arange(n, dtype=np.int32), pc.list_value_length(h).to_numpy(zero_copy_only=False)), h.flatten().to_numpy()
        first = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))  # a row's hashes are sorted
        tf, row = np.diff(np.append(first, len(h))), row[first]
        hashes, idf = known.column("h").to_numpy(), known.column("idf").to_numpy()
        order = np.argsort(hashes)
        hashes, idf = hashes[order], idf[order]
        if (hashes[1:] == hashes[:-1]).any():
            raise ValueError("two terms have one hash")
        t = np.searchsorted(hashes, h[first]).astype(np.int32)
        del h, first, own
        w = tf * idf[t]
        w /= np.sqrt(np.bincount(row, w * w, n))[row]
        back = lambda sums: np.bincount(row, w * sums[t], n)
        forth = lambda x: np.bincount(t, w * x[row], len(hashes))
        total = back(forth(np.ones(n))) - (np.bincount(row, minlength=n) > 0)
        alone = total <= NOTHING
        p, total = np.full(n, 1 / max(n, 1)), np.where(alone, 1.0, total)
        for _ in range(steps):
            linked = np.where(alone, 0.0, p / total)
            p = damp * (back(forth(linked)) - linked + p[alone].sum() / n) + (1 - damp) / n if n else p
        rank = np.empty(n, np.int32)
        rank[np.argsort(-np.round(p * n, 9), kind="stable")] = np.arange(1, n + 1)
        return pa.table({"cid": pa.array([key[0].as_py()] * n, pa.string()), "i": pa.array(np.arange(n, dtype=np.int32)), "rank": pa.array(rank), "score": pa.array(p)})

    ship(sents.sparkSession)
    rows = sents.select("cid", "doc_id", "sent_idx", F.array_sort(F.transform("terms", lambda t: F.xxhash64("cid", t))).alias("h"))
    known = vocabulary.select("cid", F.xxhash64("cid", "term").alias("h"), "idf")
    both = _own(rows, "cid", "doc_id", "sent_idx", "h").groupBy("cid").cogroup(_own(known, "cid", "h", "idf").groupBy("cid"))
    return both.applyInArrow(walk, "cid string, i int, rank int, score double")


def diverse_order(score: np.ndarray, p: np.ndarray, omega: float) -> tuple[list[int], list[float]]:
    """Picks the best again and again; each pick lowers every other by omega * p[other, pick] * the pick's first score."""
    left, now = np.ones(len(score), bool), score.astype(float).copy()
    order, at = [], []
    for _ in range(len(score)):
        best = np.where(left, np.round(now, 9), -np.inf)
        k = int(best.argmax())
        order.append(k)
        at.append(float(now[k]))
        left[k] = False
        now = now - np.where(left, omega * p[:, k] * score[k], 0.0)
    return order, at


def diversity_rank(scored: DataFrame, edges: DataFrame, omega: float) -> DataFrame:
    """(cid, i, rank, score): ranking with a penalty for similarity to what stands above; score as when picked.

    omega 0 is a plain ranking and stays in SQL.
    """
    if omega < 0:
        raise ValueError("omega is negative")
    if omega == 0:
        from .rank import ranked

        return ranked(scored.select("cid", "i", "score"), ties=("i",)).select("cid", "i", "rank", "score")

    return diversity_ranks(scored, edges, [omega]).drop("omega")


def diversity_ranks(scored: DataFrame, edges: DataFrame, omegas: list[float]) -> DataFrame:
    """(cid, omega, i, rank, score): the ranking of ``diversity_rank`` for each penalty; a cluster's matrix is made once."""
    if min(omegas, default=0) < 0:
        raise ValueError("omega is negative")

    def pick(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("i")
        score, m, i = own["score"].to_numpy(), _matrix(len(own), links), own["i"].to_numpy()
        out = []
        for omega in omegas:
            order, at = diverse_order(score, m, omega)
            out.append(pd.DataFrame({"cid": key[0], "omega": float(omega), "i": i[order], "rank": np.arange(1, len(order) + 1), "score": at}))
        return pd.concat(out)

    ship(scored.sparkSession)
    both = _own(scored, "cid", "i", "score").groupBy("cid").cogroup(_own(edges, "cid", "i", "j", "w").groupBy("cid"))
    return both.applyInPandas(pick, "cid string, omega double, i int, rank int, score double")
