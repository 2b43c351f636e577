"""Links of sentences that share a term, counted a sentence without listing the pairs.

A sentence's links are the union of its terms' postings.  Equal sets of terms are one set with a weight.  Unions of frequent
terms are bitmaps, kept along the common beginnings of sorted sets; the postings of rarer terms are looked up in them.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.shipping import ship

from .store import once

#: Sets in one block of bitmaps (64 KiB a term), the most terms with a bitmap, and postings looked up at once.
BLOCK, DENSE, AT_ONCE = 1 << 19, 1024, 1_000_000
#: A term has a bitmap if it is in more than one set of so many.
RARE = 1000
#: Sentences that a worker packs into one message, and most of a cluster that one task counts.
PACK, PART = 1 << 17, 1 << 19
#: Sums of so many terms meet in one row.
SLICE = 1 << 16
#: Common beginnings are sorted for so many frequent terms of a set.
SORTED = 6

NODE = "cid string, doc_id long, sent_idx int"


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x.astype(np.uint64)
    x += np.uint64(salt)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(31)
    return x


def _print(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set of numbers, whatever their order."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(values, salt), dtype=np.uint64)])
        ends = np.searchsorted(row, np.arange(n + 1))
        out.append(total[ends[1:]] - total[ends[:-1]])  # row is sorted; sums wrap
    return out[0], out[1]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each group, the group of each row) of rows with equal keys; the row is the group's first."""
    n = len(keys[0])
    order = np.lexsort(keys[::-1])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def _starts(lens: np.ndarray) -> np.ndarray:
    """Where each of the lists that follow each other begins, and where the last ends."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lens, dtype=np.int64)])


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(lens, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def distinct_sets(ptr: np.ndarray, codes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ptr, codes, weight, the number of each given set): equal sets as one, their weights summed."""
    n = len(ptr) - 1
    first, group = _groups(*_print(codes, np.repeat(np.arange(n), np.diff(ptr)), n))
    lens = np.diff(ptr)[first]
    return _starts(lens), codes[_ranges(ptr[first], lens)], np.bincount(group, weight, len(first)).astype(np.int64), group


def reach(ptr: np.ndarray, codes: np.ndarray, ptr2: np.ndarray, codes2: np.ndarray, weight2: np.ndarray) -> np.ndarray:
    """For each set of the first list the weight of those of the second that share a code with it. Codes ascend in a set, low ones are frequent."""
    n, m = len(ptr) - 1, len(ptr2) - 1
    out = np.zeros(n, np.int64)
    if not len(codes) or not len(codes2):
        return out
    order = np.argsort(-weight2, kind="stable")
    place = np.empty(m, np.int32)
    place[order] = np.arange(m, dtype=np.int32)
    weight = weight2[order]
    top = int(max(codes.max(), codes2.max())) + 1
    df = np.bincount(codes2, minlength=top)
    post = np.repeat(place, np.diff(ptr2))[np.argsort(codes2, kind="stable")]
    start = _starts(df)
    dense = min(int((df * RARE > m).sum()), DENSE)
    words = -(-m // 64)

    def bits(those):
        x = np.zeros(words * 64, bool)
        x[those] = True
        return np.packbits(x, bitorder="little").view(np.uint64)

    maps = [bits(post[start[c] : start[c + 1]]) for c in range(dense)]
    # sets of weight 1 are the last words; before them, a bit of the weight at a time
    single = int((weight > 1).sum()) // 64 + 1 if weight[0] > 1 else 0
    word, plane, value = [], [], []
    for k in range(int(weight[0]).bit_length() if single else 0):
        of = bits(np.flatnonzero((weight[: single * 64] >> k) & 1))[:single]
        word.append(np.flatnonzero(of))
        plane.append(of[word[-1]])
        value.append(np.full(len(word[-1]), 1 << k, np.int64))
    word, plane, value = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (word, plane, value))

    # sets by their frequent codes: those with the same are neighbours, and so are common beginnings
    row = np.repeat(np.arange(n), np.diff(ptr))
    frequent = codes < dense
    n_frequent = np.bincount(row[frequent], minlength=n)
    lead = np.full((SORTED, n), -1, np.int32)
    for k in range(SORTED):
        has = n_frequent > k
        lead[k, has] = codes[ptr[:-1][has] + k]
    prints = _print(codes[frequent], row[frequent], n)
    by = np.lexsort((*prints[::-1], *lead[::-1]))
    new = np.ones(n, bool)
    new[1:] = (prints[0][by][1:] != prints[0][by][:-1]) | (prints[1][by][1:] != prints[1][by][:-1])
    group_at = np.append(np.flatnonzero(new), n)
    # a rare code's postings, for all sets in that order
    n_rare = np.diff(ptr)[by] - n_frequent[by]
    rare = codes[_ranges(ptr[:-1][by] + n_frequent[by], n_rare)]
    each = df[rare]
    rare_at = _starts(n_rare)
    work = _starts(each)[rare_at]  # postings before each set

    stack, buffers = [], [np.zeros(words, np.uint64)]
    counted, reached = np.empty(words - min(single, words), np.uint8), 0

    def union(pref: list[int]) -> np.ndarray:
        same = 0
        for a, b in zip(stack, pref, strict=False):
            if a != b:
                break
            same += 1
        del stack[same:]
        for c in pref[same:]:
            stack.append(c)
            if len(buffers) <= len(stack):
                buffers.append(np.empty(words, np.uint64))
            np.bitwise_or(buffers[len(stack) - 1], maps[c], out=buffers[len(stack)])
        return buffers[len(stack)]

    def weighed(u: np.ndarray) -> int:
        total = int(np.bitwise_count(u[single:], out=counted).sum(dtype=np.uint32))
        return total + int(np.bitwise_count(u[word] & plane) @ value) if single else total

    g, groups = 0, len(group_at) - 1
    part_from = 0
    while part_from < n:
        # a part ends with a set; a group may go over several parts
        part_to = max(int(np.searchsorted(work, work[part_from] + AT_ONCE, "right")) - 1, part_from + 1)
        a, b = rare_at[part_from], rare_at[part_to]
        ids = post[_ranges(start[rare[a:b]], each[a:b])]
        own = np.repeat(np.repeat(np.arange(part_to - part_from), n_rare[part_from:part_to]), each[a:b])
        at, mask, covered = ids >> 3, np.left_shift(1, ids & 7).astype(np.uint8), np.empty(len(ids), np.uint8)
        base = np.empty(part_to - part_from, np.int64)
        offset = work[part_from]
        while g < groups and group_at[g] < part_to:
            lo, hi = max(int(group_at[g]), part_from), min(int(group_at[g + 1]), part_to)
            s = by[lo]
            if lo == group_at[g]:
                u = union(codes[ptr[s] : ptr[s] + n_frequent[s]].tolist())
                reached = weighed(u) if stack else 0
            base[lo - part_from : hi - part_from] = reached
            x, y = int(work[lo] - offset), int(work[hi] - offset)
            if y > x:
                if stack:
                    np.bitwise_and(u.view(np.uint8)[at[x:y]], mask[x:y], out=covered[x:y])
                else:
                    covered[x:y] = 0
            if group_at[g + 1] > part_to:
                break
            g += 1
        fresh = covered == 0
        key = np.sort(own[fresh] * m + ids[fresh])
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            base += np.bincount(key // m, weight[key % m], len(base)).astype(np.int64)
        out[by[part_from:part_to]] = base
        part_from = part_to
    return out


class Words:
    """The terms that several sentences of a cluster share: numbered in their cluster, frequent ones first, with their documents."""

    def __init__(self, counts: pa.Table):
        total = counts.filter(pc.is_null(counts["h"]))
        self.cids = total["cid"].to_pylist()
        self.documents, self.sentences = total["docs"].to_numpy(), total["sents"].to_numpy()
        self.place = {c: k for k, c in enumerate(self.cids)}
        known = counts.filter(pc.is_valid(counts["h"]))
        cluster = pc.index_in(known["cid"], value_set=pa.array(self.cids, pa.string())).to_numpy()
        h = known["h"].to_numpy()
        order = np.lexsort((h, -known["sents"].to_numpy(), cluster))
        #: where each cluster's terms begin, and their inverse document frequencies in that order
        self.starts = np.searchsorted(cluster[order], np.arange(len(self.cids) + 1))
        cluster, h = cluster[order], h[order]
        self.idf = self.inverse(cluster, known["docs"].to_numpy()[order])
        self.at = np.argsort(h).astype(np.int32)
        self.hashes = h[self.at]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms have one hash")

    def inverse(self, cluster: np.ndarray, df) -> np.ndarray:
        return np.log((1 + self.documents[cluster]) / (1 + df)) + 1

    def parts(self, cores: int) -> np.ndarray:
        """How many tasks count each cluster: by the square of its sentences, and enough for a worker."""
        n = self.sentences.astype(float)
        return np.maximum(np.ceil(2 * cores * n * n / max((n * n).sum(), 1)), np.ceil(n / PART)).astype(np.int64)


def _chunks(batches, most: int):
    """The documents in tables of about so many sentences: small batches are joined, large ones cut."""
    held, n = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("s")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, before + most - n, "right")), at + 1)
            held.append(batch.slice(at, to - at))
            n += int(ends[to - 1] - before)
            at = to
            if at < batch.num_rows or n >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _opened(rows: pa.Table):
    """(cids, cluster and document of each sentence, its number in the document; sentence, hash and count of each term in it)."""
    cid = rows["cid"].combine_chunks().dictionary_encode()
    cid = cid.combine_chunks() if isinstance(cid, pa.ChunkedArray) else cid
    s = rows["s"].combine_chunks()
    s = s.combine_chunks() if isinstance(s, pa.ChunkedArray) else s
    each = pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False)
    inner = s.flatten()
    lens = pc.list_value_length(inner).to_numpy(zero_copy_only=False)
    h = inner.flatten().to_numpy()
    sent = np.repeat(np.arange(len(inner), dtype=np.int32), lens)
    order = np.lexsort((h, sent))
    h, sent = h[order], sent[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (sent[1:] != sent[:-1])]))
    tf = np.diff(np.append(first, len(h)))
    doc = np.repeat(np.arange(len(each)), each)
    return cid.dictionary.to_pylist(), cid.indices.to_numpy()[doc], doc, _ranges(np.zeros(len(each), np.int64), each), sent[first], h[first], tf


def _counted(batches):
    for rows in _chunks(batches, PACK):
        cids, cluster, doc, _, sent, h, _ = _opened(rows)
        order = np.lexsort((sent, h))
        h, sent = h[order], sent[order]
        own = doc[sent]
        first = np.concatenate([np.ones(min(len(h), 1), bool), h[1:] != h[:-1]])
        new = first.copy()
        new[1:] |= own[1:] != own[:-1]
        at = np.flatnonzero(first)
        held = np.unique(doc)  # documents with a sentence
        of = np.full(held.max(initial=0) + 1, -1)
        of[doc] = cluster
        k = np.concatenate([cluster[sent[at]], np.arange(len(cids))])
        docs = np.concatenate([np.add.reduceat(new, at, dtype=np.int64) if len(at) else [], np.bincount(of[held], minlength=len(cids))])
        sents = np.concatenate([np.diff(np.append(at, len(h))), np.bincount(cluster, minlength=len(cids))])
        h = pa.concat_arrays([pa.array(h[at], pa.int64()), pa.nulls(len(cids), pa.int64())])
        cid = pa.DictionaryArray.from_arrays(pa.array(k.astype(np.int32)), pa.array(cids, pa.string())).cast(pa.string())
        yield pa.RecordBatch.from_arrays([cid, h, pa.array(docs.astype(np.int64)), pa.array(sents.astype(np.int64))], names=["cid", "h", "docs", "sents"])


def _squeezed(*arrays: np.ndarray) -> bytes:
    x = pickle.dumps(arrays)
    return len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True)


def _expanded(x: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _packed(batches, words: Words, parts: np.ndarray):
    """Blobs of sentences (kind 0: for one part of their cluster) and of their sets (kind 1: for all parts)."""
    for table in _chunks(batches, PACK):
        cids, cluster, doc, number, sent, h, tf = _opened(table)
        m = len(doc)
        cluster = np.array([words.place.get(c, -1) for c in cids], np.int64)[cluster]  # -1: no sentence is there
        if not m:
            continue
        at = np.minimum(np.searchsorted(words.hashes, h), max(len(words.hashes) - 1, 0))
        shared = words.hashes[at] == h if len(words.hashes) else np.zeros(len(h), bool)
        at = words.at[at[shared]]
        raw = np.repeat(words.inverse(np.arange(len(words.cids)), 1)[cluster], np.bincount(sent, minlength=m))  # a term of one sentence is in one document
        raw[shared] = words.idf[at]
        raw *= tf
        norm = np.sqrt(np.bincount(sent, raw * raw, m))
        alone = np.bincount(sent[~shared], minlength=m) > 0
        del raw, h
        sent, tf = sent[shared], tf[shared]
        codes = (at - words.starts[cluster[sent]]).astype(np.int32)
        order = np.lexsort((codes, sent))
        codes, tf, lens = codes[order], tf[order], np.bincount(sent, minlength=m)
        ptr = _starts(lens)
        part = (_print(codes, sent, m)[0] % parts[cluster].astype(np.uint64)).astype(np.int64)
        del order, at, sent
        column = table["doc_id"].combine_chunks()
        none = pc.is_null(column).to_numpy(zero_copy_only=False)[doc]
        ids = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)[doc]

        def row(k, p, kind, *arrays):
            return pa.RecordBatch.from_arrays([pa.array([words.cids[k]]), pa.array([p], pa.list_(pa.int32())), pa.array([kind], pa.int32()), pa.array([_squeezed(*arrays)], pa.binary())], names=["cid", "p", "kind", "blob"])

        by = np.lexsort((part, cluster))
        for those in np.split(by, np.flatnonzero((np.diff(cluster[by]) != 0) | (np.diff(part[by]) != 0)) + 1):
            t = _ranges(ptr[those], lens[those])
            own = none[those], ids[those], number[those].astype(np.int32), _small(lens[those]), codes[t], _small(tf[t]), alone[those], norm[those]
            yield row(cluster[those[0]], [int(part[those[0]])], 0, *own)
        for k in np.unique(cluster):
            those = np.flatnonzero((cluster == k) & (lens > 0))
            if len(those):
                p, c, weight, _ = distinct_sets(_starts(lens[those]), codes[_ranges(ptr[those], lens[those])], np.ones(len(those), np.int64))
                yield row(k, list(range(int(parts[k]))), 1, _small(np.diff(p)), c, _small(weight))


def _tile(key: tuple, given: pa.Table, idf: np.ndarray, sums: np.ndarray) -> pa.Table:
    """One part of a cluster's sentences against all of its sets. idf, sums: of the cluster's terms, and of their weights over its sentences."""
    kind, blob = given["kind"].to_numpy(), given["blob"]
    own = [_expanded(blob[int(k)].as_py()) for k in np.flatnonzero(kind == 0)]
    none, doc, number, lens, codes, tf, alone, norm = (np.concatenate(x) for x in zip(*own, strict=True)) if own else [np.empty(0, np.int64)] * 8
    order = np.lexsort((number, doc, none))
    ptr = _starts(lens)
    at = _ranges(ptr[order], lens[order])
    none, doc, number, lens, codes, tf, alone, norm = none[order].astype(bool), doc[order], number[order], lens[order], codes[at], tf[at], alone[order], norm[order]
    n = len(doc)
    ptr = _starts(lens)
    del at, order, own
    sent = np.repeat(np.arange(n, dtype=np.int32), lens)
    w = tf * idf[codes] / norm[sent]
    w = np.bincount(sent, w * (sums[codes] - w), n)  # a sentence with itself is no link
    p, c, _, group = distinct_sets(ptr, codes, np.ones(n, np.int64))
    total, held, size = np.zeros(len(p) - 1, np.int64), [], 0
    others = np.flatnonzero(kind == 1) if n else []
    for k, at in enumerate(others):
        held.append(_expanded(blob[int(at)].as_py()))
        size += len(held[-1][0])
        if size >= BLOCK or k == len(others) - 1:
            lens2, codes2, weight2 = (np.concatenate(x) for x in zip(*held, strict=True))
            blocks = distinct_sets(_starts(lens2), codes2, weight2)[:3]
            held, size = [], 0
            del lens2, codes2, weight2
            total += reach(p, c, *blocks)
    pairs = _print((codes.astype(np.uint64) << np.uint64(32)) | tf.astype(np.uint64), sent, n)
    first, copies = _groups(group, *pairs, np.where(alone, np.arange(n) + 1, 0))
    first = first[copies]
    links = np.where(lens > 0, total[group] - 1, 0) if n else total
    return pa.table({
        "cid": pa.array([key[0].as_py()] * n, pa.string()), "doc_id": pa.array(doc, pa.int64(), mask=none), "sent_idx": pa.array(number.astype(np.int32)),
        "c_doc": pa.array(doc[first], pa.int64(), mask=none[first]), "c_sent": pa.array(number[first].astype(np.int32)), "n_links": pa.array(links, pa.int64()), "w": pa.array(w, pa.float64()),
    })


def linked(docs: DataFrame, sentences) -> DataFrame:
    """(cid, doc_id, sent_idx, c_doc, c_sent, n_links, w): every sentence of each cluster, its class, and its links with all others.

    docs: (cid, doc_id, text), a row a document; sentences: its column of sentences' term arrays.  A class is the sentences
    with equal term counts, named by the first of them; n_links are the other sentences that share a term, copies among them; w
    the sum of the TF-IDF cosines with these, document frequencies counted over the cluster's documents (``scoring.document_idf``).
    Clusters that are null are in no result.  Terms are told apart by 64-bit hashes, equal sets by 128 bits.

    The terms that sentences share come to the driver, as in ``graph.stationary``; the sum of weights is linear in the tokens.
    The count is a union, which has no such form: each part of a large cluster meets all its sets, so bitmaps grow with the square.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    ship(spark)
    rows = docs.where("cid IS NOT NULL").select("cid", "doc_id", F.transform(sentences, lambda s: F.transform(s, lambda t: F.xxhash64("cid", t))).alias("s"))
    counts = rows.select("cid", "s").mapInArrow(_counted, "cid string, h long, docs long, sents long")
    counts = counts.groupBy("cid", "h").agg(F.sum("docs").alias("docs"), F.sum("sents").alias("sents"))
    words = Words(counts.where("h IS NULL OR sents > 1").toArrow())
    n_words, parts = len(words.idf), words.parts(context.defaultParallelism)
    known = context.broadcast((words.place, words.starts, words.idf))
    given = context.broadcast(words)
    blobs = once(rows.mapInArrow(lambda batches: _packed(batches, given.value, parts), "cid string, p array<int>, kind int, blob binary"))
    given.unpersist()

    def summed(batches):
        place, starts, idf = known.value
        out = np.zeros(n_words)
        for batch in batches:
            for cid, blob in zip(batch.column("cid").to_pylist(), batch.column("blob"), strict=True):
                *_, lens, codes, tf, _, norm = _expanded(blob.as_py())
                k = place[cid]
                w = tf * idf[starts[k] : starts[k + 1]][codes] / np.repeat(norm, lens)
                out[starts[k] : starts[k + 1]] += np.bincount(codes, w, starts[k + 1] - starts[k])
        for k in range(0, n_words, SLICE):
            if out[k : k + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([out[k : k + SLICE].tobytes()], pa.binary())], names=["k", "x"])

    def met(key: tuple, those: pa.Table) -> pa.Table:
        x = sum(np.frombuffer(v.as_py()) for v in those["x"])
        return pa.table({"k": [key[0].as_py()], "x": pa.array([x.tobytes()], pa.binary())})

    sums = np.zeros(n_words)
    found = blobs.where("kind = 0").select("cid", "blob").coalesce(context.defaultParallelism).mapInArrow(summed, "k long, x binary").groupBy("k").applyInArrow(met, "k long, x binary").toArrow()
    for k, x in zip(found["k"].to_pylist(), found["x"], strict=True):
        sums[k : k + SLICE] = np.frombuffer(x.as_py())
    sums = context.broadcast(sums)

    def tile(key: tuple, those: pa.Table) -> pa.Table:
        place, starts, idf = known.value
        own = slice(starts[place[key[0].as_py()]], starts[place[key[0].as_py()] + 1])
        return _tile(key, those, idf[own], sums.value[own])

    tiles = blobs.select("cid", F.explode("p").alias("p"), "kind", "blob")
    return tiles.groupBy("cid", "p").applyInArrow(tile, f"{NODE}, c_doc long, c_sent int, n_links long, w double")
