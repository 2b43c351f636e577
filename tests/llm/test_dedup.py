"""Exact, near and substring deduplication against brute force."""

import hashlib
import re
from collections import defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import components, exact, simhash, substring

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def texts_of(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


def smallest(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def removed_by_brute_force(texts, width):
    words = {d: WORD.findall((t or "").encode()) for d, t in texts.items()}
    first = {}
    for d in sorted(words):
        for k in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][k : k + width]), d)
    out = {}
    for d, ws in words.items():
        gone = set()
        for k in range(len(ws) - width + 1):
            if first[tuple(ws[k : k + width])] < d:
                gone.update(range(k, k + width))
        out[d] = (len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode())
    return out


def test_exact_duplicates(documents):
    groups = defaultdict(list)
    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in texts_of(documents).items()}
    for d, t in norm.items():
        groups[t].append(d)
    for r in exact.exact_duplicates(documents).collect():
        group = groups[norm[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(group), len(group), r["doc_id"] == min(group))
        assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()


def test_exact_copies_over_many_partitions(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same  text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = exact.exact_duplicates(rows)
    assert out.where("kept").count() == 1 + 3333
    assert out.where("keep_id = 0").agg(F.count("*"), F.min("group_size"), F.max("group_size")).first()[:] == (1667, 1667, 1667)


def test_exact_repeated_rows_and_missing_ids(spark):
    rows = spark.createDataFrame([(3, "a"), (3, "a"), (None, "a"), (None, "b"), (7, None), (8, "")], "doc_id long, text string")
    out = exact.exact_duplicates(rows).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"]) for r in out) == [(-1, -1, 1), (-1, 3, 3), (3, 3, 3), (3, 3, 3), (7, 7, 2), (8, 7, 2)]
    assert sum(r["kept"] for r in out) == 3


def test_simhash_matches_brute_force(documents):
    def fingerprint(text):
        ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
        grams = [b" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] if len(ws) > 2 else ([b" ".join(ws)] if ws else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {d: fingerprint(t) for d, t in texts_of(documents).items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = smallest(links, prints)
    out = simhash.near_duplicates(documents).select("*", simhash.hexadecimal(F.col("fp")).alias("hex")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert all(r["hex"] == f"{prints[r['doc_id']]:016x}" for r in out)


def test_close_pairs_miss_none(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    marks = set(base)
    for b in base:
        for n in (1, 2, 3):
            for _ in range(4):
                marks.add(b ^ sum(1 << k for k in rng.sample(range(64), n)))
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    found = {(r["u"], r["v"]) for r in simhash.close_pairs(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert found == want


@pytest.mark.parametrize(("width", "shingle"), [(50, 8), (5, 2), (3, 3), (1, 1)])
def test_substring_matches_brute_force(documents, width, shingle):
    want = removed_by_brute_force(texts_of(documents), width)
    out = substring.dedup_substrings(documents, width, shingle).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out} == want


def test_substring_in_small_steps(documents, monkeypatch):
    monkeypatch.setattr(substring, "STEP", 64)
    text = documents.select("doc_id", "text")
    batches = text.toArrow().combine_chunks().to_batches()
    whole = sum(int(b.column("n").to_numpy()[b.column("kind").to_numpy() != substring.WITNESS].sum()) for b in substring._anchors(50, 8)(iter(batches)))
    assert whole == sum(max(0, len(WORD.findall((t or "").encode())) - 49) for t in texts_of(documents).values())


def test_strip_documents_keeps_rows_and_columns(documents):
    before = {r["doc_id"]: r for r in documents.collect()}
    want = removed_by_brute_force(texts_of(documents), 50)
    out = substring.strip_documents(documents).collect()
    assert len(out) == len(before) and out[0].__fields__ == documents.columns
    for r in out:
        changed = want[r["doc_id"]][1] > 0
        assert r["text"] == (want[r["doc_id"]][2] if changed else before[r["doc_id"]]["text"])
        assert r["n_chars"] == (len(r["text"]) if changed else before[r["doc_id"]]["n_chars"])
        assert r["lang"] == before[r["doc_id"]]["lang"]


def test_rows_without_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = spark.createDataFrame([(None, text), (4, text), (9, text), (None, "lone words here"), (4, text)], "doc_id long, text string")
    cut = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring.dedup_substrings(rows).collect())
    assert cut == [(-1, 0), (-1, 0), (4, 0), (4, 0), (9, 60)]
    near = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_duplicates(rows).collect())
    assert near == [(-1, -1), (-1, 4), (4, 4), (4, 4), (9, 4)]


@pytest.mark.parametrize("operator", [exact.exact_duplicates, simhash.near_duplicates, substring.dedup_substrings, substring.strip_documents])
def test_empty_table(no_documents, operator):
    assert operator(no_documents).collect() == []


@pytest.mark.parametrize("operator", [exact.exact_duplicates, simhash.near_duplicates, substring.dedup_substrings])
def test_clashing_columns_do_not_matter(documents, operator):
    clash = documents.limit(30).cache()
    extra = ["marks", "fp", "component_id", "kept", "keep_id", "norm", "head", "rep", "k", "h"]
    wide = clash.select("*", *[F.lit("x").alias(c) for c in extra])
    assert sorted(map(str, operator(wide).collect())) == sorted(map(str, operator(clash).collect()))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    nodes = {n for link in links for n in link if link[0] != link[1]}
    want = smallest([x for x in links if x[0] != x[1]], nodes)
    found = components.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in found} == want and len(found) == len(want)


def test_components_of_a_long_path(spark):
    n = 300
    found = components.components(spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert found.count() == n + 1 and found.where("component <> 0").count() == 0
