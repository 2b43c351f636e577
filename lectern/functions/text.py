"""Text as columns: segmentation, normalisation, predicates, tokens.

All but the stemmer and the tiler are built-in expressions.  Patterns avoid look-behind and ``\\s``, so that other
SQL engines read them alike.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lectern.shipping import ship

from .porter import stem as porter_stem
from .stopwords import ENGLISH

SPACE = "[ \\t\\n\\r]+"
TERM = "[\\p{L}\\p{N}_]{2,}"
WORD = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_ \\t\\n\\r]"
MIN_WORDS = 3


def collapse(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def split_sentences(text: Column) -> Column:
    """Raw sentences: ends at . ! or ? before white space, and at line ends."""
    return F.split(F.regexp_replace(text, "([.!?])[ \\t\\n\\r]+", "$1\n"), "\\n+")


def split_paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "\\n([ \\t\\r]*\\n)+"), lambda x: F.trim(x)), lambda x: x != "")


def terms(text: Column) -> Column:
    """Tokens of the vectors: runs of two or more word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def words(text: Column) -> Column:
    """Tokens of length budgets: words and single punctuation marks."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(words(text))


def without_stopwords(text: Column, stop=ENGLISH) -> Column:
    """The white-space tokens that are no stop words, joined; may be the empty string."""
    listed = F.array(*[F.lit(w) for w in stop])
    return F.array_join(F.filter(F.split(text, " "), lambda x: ~F.array_contains(listed, x)), " ")


def is_dialogue(text: Column, quoted_reports: bool = False) -> Column:
    """Holds a double-quote token pair; with quoted_reports also: begins with ' and reports speech."""
    found = F.contains(text, F.lit("''")) | F.contains(text, F.lit("``"))
    if quoted_reports:
        found = found | (F.startswith(text, F.lit("'")) & (F.contains(text, F.lit("says")) | F.contains(text, F.lit("said"))))
    return found


def is_short(text: Column, least: int = MIN_WORDS) -> Column:
    return n_words(text) < least


@F.pandas_udf(StringType())
def stemmed(text: pd.Series) -> pd.Series:
    """Each white-space token stemmed, re-joined by spaces."""
    return text.map(lambda s: None if s is None else " ".join(porter_stem(w) for w in s.split()))


@F.pandas_udf(ArrayType(StringType()))
def stemmed_each(texts: pd.Series) -> pd.Series:
    """As ``stemmed``, of each text of an array."""
    return texts.map(lambda ts: None if ts is None else [None if t is None else " ".join(porter_stem(w) for w in t.split()) for t in ts])


@F.pandas_udf(ArrayType(StringType()))
def stemmed_terms(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ws: None if ws is None else [porter_stem(w) for w in ws])


def normalise(text: Column, rm_short: bool = False, rm_dialog: bool = False, rm_stop: bool = False, stem: bool = False, quoted_reports: bool = False) -> Column:
    """The sentence in processed form; null if empty, short or dialogue where asked; may be '' after stop words went."""
    out = F.nullif(collapse(text), F.lit(""))
    base = out
    if rm_short:
        out = F.when(~is_short(base), out)
    if rm_dialog:
        out = F.when(~is_dialogue(base, quoted_reports), out)
    if rm_stop:
        out = without_stopwords(out)
    if stem:
        ship()
        return stemmed(out)
    return out


def digit_mask(word: Column) -> Column:
    """A numeric token becomes as many N as its integer part has digits (thousands' commas count), five at most."""
    whole = F.regexp_extract(F.regexp_replace(word, ",", ""), "^([0-9]+)", 1)
    return F.when(F.regexp_like(word, F.lit("^([0-9]+[.,])*[0-9]+$")), F.expr("'NNNNN'").substr(F.lit(1), F.least(F.length(whole), F.lit(5)))).otherwise(word)


def punct_split(text: Column) -> Column:
    """Lower-cased words with dashes, underscores, colons and slashes as tokens of their own, numbers masked."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(text), "[-—–_]", " - "), ":", " : ")
    spaced = F.regexp_replace(F.regexp_replace(spaced, "\\\\", " \\\\ "), "/", " / ")
    return F.transform(F.filter(F.split(spaced, SPACE), lambda x: x != ""), digit_mask)


def before_marker(text: Column, marker: str = "--T--") -> Column:
    """What stands before the first marker; the whole where there is none."""
    return F.trim(F.substring_index(text, marker, 1))


def split_marked(text: Column, marker: str = "<P>") -> Column:
    """Parts between markers, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, marker), lambda x: F.trim(F.regexp_replace(x, SPACE, " "))), lambda x: x != "")


def clip(tokens: Column, most: int) -> Column:
    return F.slice(tokens, 1, most)


def length_mask(n: Column, most: int, offset: int = 0) -> Column:
    """``offset`` zeros, a one for each of the first n places, zeros up to ``most`` places in all."""
    inside = F.least(n, F.lit(most - offset))
    return F.concat(F.array_repeat(F.lit(0), offset), F.array_repeat(F.lit(1), inside), F.array_repeat(F.lit(0), F.lit(most - offset) - inside))


def running_masks(lengths: Column, most: int) -> Column:
    """For each length a row of ``most`` places with ones where its items lie when all follow each other."""
    ends = F.transform(F.sequence(F.lit(1), F.size(lengths)), lambda k: F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(0), lambda a, x: a + x))
    places = F.sequence(F.lit(1), F.lit(most))
    return F.when(F.size(lengths) == 0, F.array().cast("array<array<int>>")).otherwise(
        F.zip_with(lengths, ends, lambda n, e: F.transform(places, lambda p: ((p > e - n) & (p <= e)).cast("int")))
    )
