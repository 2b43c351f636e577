"""Text rules on literal values."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import layouts, porter, tiling
from lectern.functions import text as T


def value(spark, column, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if v == [] or isinstance(v[0], str) else 'array<int>'}" for k, v in columns.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
        ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
        ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"),
        ("adjustment", "adjust"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("is", "is"),
    ],
)
def test_stems(word, want):
    assert porter.stem(word) == want


@pytest.mark.parametrize(
    ("text", "asked", "want"),
    [
        ("  The   CATS ", {"rm_stop": True}, "cats"), ("  The   CATS ", {}, "the cats"), ("", {}, None), (" \n ", {}, None), ("it is", {"rm_stop": True}, ""),
        ("he said ''no'' to it", {"rm_dialog": True}, None), ("he said ''no'' to it", {}, "he said ''no'' to it"), ("two words", {"rm_short": True}, None),
        ("three words now", {"rm_short": True}, "three words now"), ("'it is so' he says", {"rm_dialog": True}, "'it is so' he says"),
        ("'it is so' he says", {"rm_dialog": True, "quoted_reports": True}, None), ("Running dogs", {"stem": True}, "run dog"), (None, {}, None),
    ],
)
def test_normalise(spark, text, asked, want):
    assert value(spark, T.normalise(F.col("t"), **asked), t=text) == want


def test_sentences_and_paragraphs(spark):
    assert value(spark, T.split_sentences(F.col("t")), t="One. Two!  Three?\nFour 3.5 x") == ["One.", "Two!", "Three?", "Four 3.5 x"]
    assert value(spark, T.split_paragraphs(F.col("t")), t="a\nb\n\n c \n \n\nd") == ["a\nb", "c", "d"]


@pytest.mark.parametrize(("word", "want"), [("3.3", "N"), ("3,333", "NNNN"), ("1234567", "NNNNN"), ("12", "NN"), ("x1", "x1"), ("3.", "3."), ("1.2.3", "N")])
def test_digit_mask(spark, word, want):
    assert value(spark, T.digit_mask(F.col("t")), t=word) == want


def test_punct_split(spark):
    assert value(spark, T.punct_split(F.col("t")), t="Well-known a/b c\\d e:f g_h 12,000") == "well - known a / b c \\ d e : f g - h NNNNN".split()


def test_markers(spark):
    assert value(spark, T.before_marker(F.col("t")), t="what is it --T-- rest") == "what is it"
    assert value(spark, T.split_marked(F.col("t")), t="a <P> <P>b\n c") == ["a", "b c"]


def test_masks(spark):
    rows = spark.createDataFrame([(3, [2, 1]), (9, []), (0, [1])], "n int, l array<int>")
    assert [r[0] for r in rows.select(T.length_mask(F.col("n"), 5)).collect()] == [[1, 1, 1, 0, 0], [1] * 5, [0] * 5]
    assert rows.select(T.length_mask(F.col("n"), 5, 1)).first()[0] == [0, 1, 1, 1, 0]
    assert [r[0] for r in rows.select(T.running_masks(F.col("l"), 4)).collect()] == [[[1, 1, 0, 0], [0, 0, 1, 0]], [], [[1, 0, 0, 0]]]


def test_tiles():
    cats = "Cats chase mice. Mice fear cats. The cats sleep near mice in barns full of hay. " * 6
    stocks = "Stocks fell. Markets trade bonds. Traders sold shares as markets and stocks fell. " * 6
    found = tiling.tile(f"{cats}\n\n{stocks}")
    assert [t.split()[0] for t in found] == ["Cats", "Stocks"]
    assert tiling.tile("short text") == ["short text"] and tiling.tile(None) == [] and tiling.tile(" ") == []


def test_layouts(spark):
    rows = spark.createDataFrame([(["q1", "q2"], ["a", "b"], [["a", "b"], ["c"]])], "q array<string>, s array<string>, p array<array<string>>")
    pair = rows.select(layouts.pair(F.col("q"), F.col("s"), 9).alias("x")).first()["x"]
    assert pair["tokens"] == ["[CLS]", "q1", "q2", "[SEP]", "a", "b", "[SEP]", "[PAD]", "[PAD]"]
    assert pair["segments"] == [0, 0, 0, 0, 1, 1, 1, 0, 0] and pair["mask"] == [1.0] * 7 + [0.0] * 2
    one = rows.select(layouts.single(F.col("s"), 5).alias("x")).first()["x"]
    assert one["tokens"] == ["[CLS]", "a", "b", "[SEP]", "[PAD]"] and one["segments"] == [0] * 5
    whole = rows.select(layouts.passage(F.col("q"), F.col("p"), 10, count=3).alias("x")).first()["x"]
    assert whole["tokens"] == ["[CLS]", "q1", "q2", "[SEP]", "a", "b", "c", "[SEP]", "[PAD]", "[PAD]"]
    assert [tuple(s) for s in whole["spans"]] == [(4, 6), (6, 7), (-1, -1)]


def test_word_pieces(spark):
    rows = spark.createDataFrame([(["unwanted", "running", "xyz"],)], "w array<string>")
    pieces = layouts.word_pieces(F.col("w"), frozenset({"un", "##want", "##ed", "runn", "##ing"}))
    assert rows.select(pieces.alias("x")).first()["x"] == ["un", "##want", "##ed", "runn", "##ing", "[UNK]"]
