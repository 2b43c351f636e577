"""Token layouts in front of a model: ids, segments, masks and sentence offsets as array columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

START, BREAK, PAD = "[CLS]", "[SEP]", "[PAD]"
QUERY_TOKENS, SENTENCE_TOKENS, SEQUENCE, PASSAGE_SEQUENCE, PASSAGE_SENTENCES = 100, 70, 173, 503, 8


def _padded(items: Column, most: int, filler: Column) -> Column:
    items = F.slice(items, 1, most)
    return F.concat(items, F.array_repeat(filler, F.lit(most) - F.size(items)))


def pair(query: Column, sentence: Column, most: int = SEQUENCE, query_tokens: int = QUERY_TOKENS, sentence_tokens: int = SENTENCE_TOKENS) -> Column:
    """struct(tokens, segments, mask) of [CLS] query [SEP] sentence [SEP], clipped and padded."""
    q, s = F.slice(query, 1, query_tokens), F.slice(sentence, 1, sentence_tokens)
    left = F.concat(F.array(F.lit(START)), q, F.array(F.lit(BREAK)))
    right = F.concat(s, F.array(F.lit(BREAK)))
    segments = F.concat(F.array_repeat(F.lit(0), F.size(left)), F.array_repeat(F.lit(1), F.size(right)))
    return F.struct(
        _padded(F.concat(left, right), most, F.lit(PAD)).alias("tokens"), _padded(segments, most, F.lit(0)).alias("segments"),
        _padded(F.array_repeat(F.lit(1.0), F.size(left) + F.size(right)), most, F.lit(0.0)).alias("mask"),
    )


def single(text: Column, most: int = SEQUENCE) -> Column:
    """struct(tokens, segments, mask) of [CLS] text [SEP]."""
    body = F.concat(F.array(F.lit(START)), F.slice(text, 1, most - 2), F.array(F.lit(BREAK)))
    return F.struct(
        _padded(body, most, F.lit(PAD)).alias("tokens"), F.array_repeat(F.lit(0), most).alias("segments"),
        _padded(F.array_repeat(F.lit(1.0), F.size(body)), most, F.lit(0.0)).alias("mask"),
    )


def passage(query: Column, sentences: Column, most: int = PASSAGE_SEQUENCE, query_tokens: int = QUERY_TOKENS, sentence_tokens: int = 50, count: int = PASSAGE_SENTENCES) -> Column:
    """struct(tokens, segments, mask, spans) of [CLS] query [SEP] all sentences [SEP].

    spans: for each of ``count`` sentences its (s, e) token offsets, e exclusive; (-1, -1) for those that are not there.
    """
    q = F.slice(query, 1, query_tokens)
    own = F.transform(F.slice(sentences, 1, count), lambda s: F.slice(s, 1, sentence_tokens))
    begin = F.size(q) + 2
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1))), lambda k: F.aggregate(F.slice(own, F.lit(1), k), begin, lambda a, s: a + F.size(s)))
    spans = F.zip_with(own, ends, lambda s, e: F.struct((e - F.size(s)).alias("s"), e.alias("e")))
    spans = F.when(F.size(own) > 0, spans).otherwise(F.slice(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))), 1, 0))
    left = F.concat(F.array(F.lit(START)), q, F.array(F.lit(BREAK)))
    right = F.concat(F.flatten(own), F.array(F.lit(BREAK)))
    segments = F.concat(F.array_repeat(F.lit(0), F.size(left)), F.array_repeat(F.lit(1), F.size(right)))
    return F.struct(
        _padded(F.concat(left, right), most, F.lit(PAD)).alias("tokens"), _padded(segments, most, F.lit(0)).alias("segments"),
        _padded(F.array_repeat(F.lit(1.0), F.size(left) + F.size(right)), most, F.lit(0.0)).alias("mask"),
        _padded(spans, count, F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"))).alias("spans"),
    )


def word_pieces(words: Column, vocabulary: frozenset[str], unknown: str = "[UNK]") -> Column:
    """Greedy longest-match pieces of each word; later pieces begin with ##. A word that does not fit is unknown."""
    def cut(word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            for to in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:to]
                if piece in vocabulary:
                    out.append(piece)
                    at = to
                    break
            else:
                return [unknown]
        return out

    @F.pandas_udf(ArrayType(StringType()))
    def pieces(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ws: None if ws is None else [p for w in ws for p in cut(w)])

    return pieces(words)
