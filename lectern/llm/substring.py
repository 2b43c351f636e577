"""Substring deduplication over fixed-length word windows (operator 2).

Every window of ``width`` consecutive words has a Rabin-Karp hash; a window repeats if a document with a
smaller id has the same one.  Repeated windows merge into maximal removal intervals.

Counting every window in a shuffle would move many times the input, so windows are first ruled out by their
*anchor*: the shingle of ``shingle`` words with the smallest hash inside the window.  Equal windows have equal
anchors, so a window whose anchor occurs in one document only occurs once, and is counted as such where it
stands.  The rule is exact, no window is sampled away.  Windows that are left are counted by a 96-bit hash.

Both counts share one pattern.  A task resolves what it can see by itself: of equal keys in one slice of
documents only the smallest document's need an answer from elsewhere, so a key that fills the corpus still
sends one claim for each slice.  Claims are dealt by key, sorted on disk and read as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, rolling

WIDTH = 50
SHINGLE = 8
#: Words of a text that one vectorised step handles; positions in a step have 24 bits.
STEP = 1 << 22
CLAIM, WITNESS, KNOWN = 0, 1, 2

# sub tells rows with one doc_id and different texts apart; it takes no part in the order of documents
_ANCHORS = "k long, a long, doc_id long, sub long, begin int, n int, kind tinyint"
_CLAIMS = "k long, h long, c int, doc_id long, sub long, begin int, n int, gap int, kind tinyint"
_RANGES = "doc_id long, sub long, begin int, n int"
_RANGE = ("doc_id", "sub", "begin", "n")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _lengths(begin: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.concatenate((begin, [total])))


def _steps(hashes: np.ndarray, first: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes and text bounds cut so that every window of ``width`` lies whole in exactly one step."""
    total = len(hashes)
    for at in range(0, max(total, 1), STEP):
        to = min(total, at + STEP + width - 1)
        bounds = np.clip(first, at, to)
        # windows of the overlap that begin in the next step must not begin here
        yield hashes[at:to], bounds - at, at


def _identity(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and sub of each row; sub may be left out where all are 0."""
    doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
    return doc, batch.column("sub").to_numpy(zero_copy_only=False) if "sub" in batch.schema.names else np.zeros(len(doc), np.int64)


def _anchors(width: int, shingle: int):
    def step(batches):
        for batch in common.pieces(batches, "text"):
            batch = batch.filter(batch.column("doc_id").is_valid())
            doc, sub = _identity(batch)
            words = rolling.Words(batch.column("text"))
            for hashes, first, at in _steps(words.hashes(), words.first, width):
                begin, text = rolling.windows(hashes, first, width)
                if not len(begin):
                    continue
                grams = rolling.spans(hashes, *(np.arange(len(hashes) - shingle + 1) + d for d in (0, shingle)))
                a = grams[rolling.leftmost_minimum(grams, width - shingle + 1)[begin]].view(np.int64)
                run = _runs(a, text)
                n = _lengths(run, len(a)).astype(np.int32)
                a, text, begin = a[run], text[run], (begin[run] + at - words.first[text[run]]).astype(np.int32)
                yield _settle_anchors(a, doc[text], sub[text], begin, n)

    return step


def _settle_anchors(a, doc, sub, begin, n) -> pa.RecordBatch:
    """Claims of anchors that one document of the slice has; those of more are known to repeat, and leave a witness."""
    order = np.lexsort((doc, a))
    a, doc, sub, begin, n = a[order], doc[order], sub[order], begin[order], n[order]
    run = _runs(a)
    size = _lengths(run, len(a))
    shared = doc[run] != doc[run + size - 1]
    kind = np.where(np.repeat(shared, size), KNOWN, CLAIM).astype(np.int8)
    key = np.where(kind == KNOWN, rolling.mix(doc.view(np.uint64)).view(np.int64), a)
    w = run[shared]
    none = np.zeros(len(w), np.int32)
    return common.batch_of(
        k=np.concatenate((key, a[w])), a=np.concatenate((a, a[w])), doc_id=np.concatenate((doc, doc[w])), sub=np.concatenate((sub, sub[w])),
        begin=np.concatenate((begin, none)), n=np.concatenate((n, none)), kind=np.concatenate((kind, np.full(len(w), WITNESS, np.int8))),
    )


def _numpy(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {name: batch.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(batch.schema.names)}


def _ranges(doc, sub, begin, n) -> pa.RecordBatch:
    return common.batch_of(doc_id=doc.astype(np.int64), sub=sub.astype(np.int64), begin=begin.astype(np.int32), n=n.astype(np.int32))


def _repeated_anchors(batches):
    """Ranges whose anchor occurs in several documents. Rows come sorted by anchor and document.

    Of a witnessed anchor the slice that left the witness has two documents, so all claims of it hold.
    """
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        rows = _numpy(batch)
        known = rows["kind"] == KNOWN
        if known.any():
            yield _ranges(*(rows[c][known] for c in _RANGE))
            rows = {c: v[~known] for c, v in rows.items()}
        if not len(rows["a"]):
            continue
        if held is not None:
            rows = {c: np.concatenate((held[c], v)) for c, v in rows.items()}
        last = int(np.searchsorted(rows["a"], rows["a"][-1]))
        held = {c: v[last:] for c, v in rows.items()}
        yield from _shared({c: v[:last] for c, v in rows.items()})
    if held is not None:
        yield from _shared(held)


def _shared(rows):
    run = _runs(rows["a"])
    if not len(run):
        return
    size = _lengths(run, len(rows["a"]))
    witnessed = np.maximum.reduceat(rows["kind"], run) == WITNESS
    take = np.repeat(witnessed | (rows["doc_id"][run] != rows["doc_id"][run + size - 1]), size) & (rows["kind"] == CLAIM)
    if take.any():
        yield _ranges(*(rows[c][take] for c in _RANGE))


def _window_claims(width: int, column: str = "text", field: str | None = None):
    def step(batches):
        for batch in common.pieces(batches, column, field=field):
            batch = batch.filter(batch.column("marks").is_valid())
            if not batch.num_rows:
                continue
            doc, sub = _identity(batch)
            words = rolling.Words(common.child(batch, column, field))
            begin, text = _positions(batch.column("marks"))
            hashes = words.hashes()
            at = begin + words.first[text]
            h = np.empty(len(at), np.uint64)
            c = np.empty(len(at), np.int32)
            order = np.argsort(at, kind="stable")
            for k in range(0, len(order), STEP):
                own = order[k : k + STEP]
                base = at[own[0]]
                part = hashes[base : at[own[-1]] + width]
                h[own] = rolling.spans(part, at[own] - base, at[own] - base + width)
                c[own] = (rolling.spans(rolling.mix(part), at[own] - base, at[own] - base + width) >> np.uint64(33)).astype(np.int32)
            yield _settle_windows(h.view(np.int64), c, doc[text], sub[text], begin.astype(np.int32))

    return step


def _positions(marks: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Every position of the ranges (packed as begin << 32 | n) of each row, once, and the row of each."""
    packed = marks.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(marks)), marks.value_lengths().to_numpy(zero_copy_only=False))
    begin, n = packed >> 32, packed & 0xFFFFFFFF
    order = np.lexsort((begin, row))
    begin, n, row = begin[order], n[order], row[order]
    where = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    row = np.repeat(row, n)
    once = _runs(where, row)
    return where[once], row[once]


def _progressions(begin: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted begins of equal keys as arithmetic progressions: where each starts, its length and its gap.

    A text that says the same few words over and over has equal windows at equal distances; they are one claim.
    """
    total = len(begin)
    head = np.zeros(total, bool)
    head[_runs(*keys)] = True
    step = np.diff(begin, prepend=0)
    new = head.copy()
    new[1:] |= ~head[:-1] & (step[1:] != step[:-1])
    run = np.flatnonzero(new)
    n = _lengths(run, total)
    gap = np.ones(len(run), np.int32)
    gap[n > 1] = step[run[n > 1] + 1]
    return run, n.astype(np.int32), gap


def _settle_windows(h, c, doc, sub, begin) -> pa.RecordBatch:
    """Of equal windows in a slice, those of the smallest document are claims; the others are known to repeat."""
    order = np.lexsort((begin, sub, doc, c, h) if sub.any() else (begin, doc, c, h))
    h, c, doc, sub, begin = h[order], c[order], doc[order], sub[order], begin[order]
    run = _runs(h, c)
    known = doc != np.repeat(doc[run], _lengths(run, len(h)))
    kd, ks, kb = doc[known], sub[known], begin[known]
    order = np.lexsort((kb, ks, kd) if ks.any() else (kb, kd))
    kd, ks, kb = kd[order], ks[order], kb[order]
    run = _runs(kd, ks, kb - np.arange(len(kb)))
    kn = _lengths(run, len(kd)).astype(np.int32)
    kd, ks, kb = kd[run], ks[run], kb[run]
    h, c, doc, sub, begin = h[~known], c[~known], doc[~known], sub[~known], begin[~known]
    run, n, gap = _progressions(begin, h, c, doc, sub)
    h, c, doc, sub, begin = h[run], c[run], doc[run], sub[run], begin[run]
    return common.batch_of(
        k=np.concatenate((rolling.mix(kd.view(np.uint64)).view(np.int64), h)), h=np.concatenate((np.zeros(len(kd), np.int64), h)),
        c=np.concatenate((np.zeros(len(kd), np.int32), c)), doc_id=np.concatenate((kd, doc)), sub=np.concatenate((ks, sub)), begin=np.concatenate((kb, begin)),
        n=np.concatenate((kn, n)), gap=np.concatenate((np.ones(len(kd), np.int32), gap)), kind=np.repeat(np.array([KNOWN, CLAIM], np.int8), [len(kd), len(h)]),
    )


def _repeated_windows(batches):
    """Claims on a window that a smaller document has too. Rows come sorted by window and document."""
    last: tuple | None = None
    for batch in batches:
        rows = _numpy(batch)
        known = rows["kind"] == KNOWN
        if known.any():
            yield _ranges(*(rows[x][known] for x in _RANGE))  # of gap 1
            rows = {x: v[~known] for x, v in rows.items()}
        h, c, doc = rows["h"], rows["c"], rows["doc_id"]
        if not len(h):
            continue
        run = _runs(h, c)
        least = np.repeat(doc[run], _lengths(run, len(h)))
        if last is not None and (h[0], c[0]) == last[:2]:
            least[: run[1] if len(run) > 1 else len(h)] = last[2]
        last = (h[-1], c[-1], least[-1])
        again = doc != least
        if again.any():
            n, gap = rows["n"][again].astype(np.int64), rows["gap"][again]
            times = np.where(gap == 1, 1, n)
            place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            yield _ranges(np.repeat(doc[again], times), np.repeat(rows["sub"][again], times), np.repeat(rows["begin"][again], times) + np.repeat(gap, times) * place, np.repeat(np.where(gap == 1, n, 1), times))


def _merged(batches):
    """Maximal ranges of neighbouring positions. Rows come sorted by document and begin."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        rows = {c: v.astype(np.int64) for c, v in _numpy(batch).items()}
        if not len(rows["doc_id"]):
            continue
        if held is not None:
            rows = {c: np.concatenate((held[c], v)) for c, v in rows.items()}
        doc, sub, begin, end = rows["doc_id"], rows["sub"], rows["begin"], rows["begin"] + rows["n"]
        # a running maximum of the ends inside each document, by lifting every document above the one before
        lift = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])))) << 33
        reach = np.maximum.accumulate(end + lift)
        new = np.ones(len(doc), bool)
        new[1:] = (begin + lift)[1:] > reach[:-1]
        run = np.flatnonzero(new)
        to = reach[np.concatenate((run[1:] - 1, [len(doc) - 1]))] - lift[run]
        doc, sub, begin, n = doc[run], sub[run], begin[run], to - begin[run]
        held = {"doc_id": doc[-1:], "sub": sub[-1:], "begin": begin[-1:], "n": n[-1:]}
        if len(doc) > 1:
            yield _ranges(doc[:-1], sub[:-1], begin[:-1], n[:-1])
    if held is not None:
        yield _ranges(*(held[c] for c in _RANGE))


def _told_apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, sub, text, others), and the columns that name a row: doc_id, or also sub, a hash of the text, where some doc_id stands in several rows."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return (docs.withColumn("sub", F.xxhash64("text")), ["doc_id", "sub"]) if repeated else (docs.withColumn("sub", F.lit(0).cast("long")), ["doc_id"])


def _marked(docs: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """Rows (doc_id, sub, others) with ``marks``: the ranges of their documents, packed; null where there are none."""
    marks = ranges.groupBy(*key).agg(F.collect_list(F.shiftleft(F.col("begin").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))).alias("marks"))
    return docs.join(marks, key, "left")


def _ranges_of(docs: DataFrame, key: list[str], width: int, shingle: int, column: str = "text", field: str | None = None) -> DataFrame:
    """(doc_id, sub, begin, n) of rows (doc_id, sub, text), or (doc_id, sub, row) with the text in a field.

    The rows go whole into the join with the anchors' ranges, as they do into the last one, so that both read one shuffle.
    """
    if not 1 <= shingle <= width:
        raise ValueError("the shingle must fit in the window")
    n = common.partitions(docs.sparkSession)
    text = F.col(column) if field is None else F.col(column)[field]
    anchors = common.arrow_map(docs.select("doc_id", "sub", text.alias("text")), _anchors(width, shingle), _ANCHORS)
    anchors = anchors.repartition(n, "k").sortWithinPartitions("a", "doc_id")
    ranges = common.arrow_map(anchors, _repeated_anchors, _RANGES)
    claims = common.arrow_map(_marked(docs, ranges, key), _window_claims(width, column, field), _CLAIMS)
    claims = claims.repartition(n, "k").sortWithinPartitions("h", "c", "doc_id")
    again = common.arrow_map(claims, _repeated_windows, _RANGES)
    return common.arrow_map(again.repartition(n, *key).sortWithinPartitions("doc_id", "sub", "begin"), _merged, _RANGES)


def repeated_ranges(docs: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, begin, n): maximal runs of starts of windows that a document with a smaller id also has.

    Texts of fewer than ``width`` words and null texts have no window.  Rows without doc_id take no part.
    """
    rows, key = _told_apart(docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")))
    return _ranges_of(rows, key, width, shingle).drop("sub")


def _strip(width: int, emit, column: str = "text", field: str | None = None):
    """Cuts marked windows from each text; emit(batch, n_words, n_removed, kept text) makes the output."""

    def step(batches):
        for batch in common.pieces(batches, column, field=field):
            words = rolling.Words(common.child(batch, column, field))
            marks = batch.column("marks")
            held = np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False))
            total = len(words.start)
            cover = np.zeros(total + 1, np.int64)
            if len(held):
                own = marks.drop_null()
                packed = own.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(held, own.value_lengths().to_numpy(zero_copy_only=False))
                begin = words.first[row] + (packed >> 32)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + (packed & 0xFFFFFFFF) + width - 1, -1)
            keep = np.cumsum(cover[:total]) == 0
            gone = np.concatenate(([0], np.cumsum(~keep)))[words.first]
            data, at = words.kept(keep)
            text = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.string())
            yield emit(batch, np.diff(words.first).astype(np.int64), np.diff(gone).astype(np.int64), text)

    return step


def dedup_substrings(docs: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): every document without the words of repeated windows.

    Words are runs of bytes other than space and 0x09-0x0D, unchanged.  A word goes if a window of ``width``
    words over it also starts in a document with a smaller id; windows are judged on the input.  The first
    document keeps its words, also where a window repeats inside it.  Kept words are joined by one space.
    Null and empty texts give 0 words and the empty text; very long texts are judged whole.  Rows of one doc_id are not
    held against each other, and each loses what its own text shares with smaller ids.  Rows without doc_id lose nothing.
    Other columns, whatever their names, play no part; an empty table gives an empty table.
    """
    docs, key = _told_apart(docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")))

    def emit(batch, n_words, n_removed, text):
        return common.batch_of(doc_id=batch.column("doc_id"), n_words=n_words, n_removed=n_removed, kept_text=text)

    marked = _marked(docs, _ranges_of(docs, key, width, shingle), key)
    return common.arrow_map(marked, _strip(width, emit), "doc_id long, n_words long, n_removed long, kept_text string")


def strip_documents(docs: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """The documents, all rows and columns, with the words of repeated windows cut from ``text``.

    A text that loses nothing stays as it is, white space included; others are their kept words joined by one
    space, and ``n_chars``, where there is such a column, follows.  Otherwise as ``dedup_substrings``.
    """
    text_name = common.own_name(docs, "text")
    names = [f.name for f in docs.schema.fields]

    def emit(batch, n_words, n_removed, text):
        rows, cut = batch.column("row"), pa.array(n_removed > 0)
        out = []
        for name in names:
            own = pc.struct_field(rows, name)
            if name == text_name:
                own = pc.if_else(cut, text.cast(own.type), own)
            elif name.lower() == "n_chars":
                own = pc.if_else(cut, pc.utf8_length(text).cast(own.type), own)
            out.append(own)
        return common.batch_of(row=pa.StructArray.from_arrays(out, fields=list(rows.type)))

    rows, key = _told_apart(docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.struct("*").alias("row")))
    rows = rows.select("doc_id", "sub", "row")
    marked = _marked(rows, _ranges_of(rows, key, width, shingle, "row", text_name), key)
    return common.arrow_map(marked, _strip(width, emit, "row", text_name), docs.select(F.struct("*").alias("row")).schema).select("row.*")
