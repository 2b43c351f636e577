"""Language profiles by loops: the letters' random vectors are the operator's, all that is done with them is not."""

import math
import zlib
from collections import Counter

import numpy as np

from lectern.llm import langid

DIM = langid.DIM


def vector(text):
    """The bundle of the text's letter trigrams as a unit vector; None without a letter."""
    symbols = [0]
    for c in (text or "").lower():
        s = int(langid._symbol_table()[ord(c)])
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    if len(symbols) < 2 or not any(symbols):
        return None
    one, two, three = langid._letters(DIM)
    out = np.zeros(DIM)
    for (a, b, c), n in Counter(zip(symbols, symbols[1:], symbols[2:], strict=False)).items():
        out += math.sqrt(n) * (one[a].astype(float) * two[b] * three[c])
    return out / np.linalg.norm(out)


def unit(x):
    return x / (np.linalg.norm(x) or 1)


def judged(rows):
    """rows (doc_id, text, lang) to {doc_id: (held_out, language, score, cosine with the best prototype)}."""
    vectors = {d: vector(t) for d, t, _ in rows}
    sums = {}
    for d, t, lang in rows:
        if zlib.crc32(str(d).encode()) % 5 and lang is not None and t is not None:
            sums[lang] = sums.get(lang, 0) + (vectors[d] if vectors[d] is not None else np.zeros(DIM))
    langs = sorted(sums)
    units = {k: unit(sums[k]) for k in langs}
    mean = sum(units.values()) / len(units) if len(units) > 1 else 0
    own = {k: unit(units[k] - mean) for k in langs}
    out = {}
    for d, _, _ in rows:
        held, v = zlib.crc32(str(d).encode()) % 5 == 0, vectors[d]
        if v is None or not langs:
            out[d] = (held, "und", 0.0, 0.0)
            continue
        cosine = [float(v @ own[k]) for k in langs]
        share = [math.exp(langid.SHARPNESS * (c - max(cosine))) for c in cosine]
        best = cosine.index(max(cosine))
        out[d] = (held, langs[best], max(share) / sum(share), max(float(v @ units[k]) for k in langs))
    return out


def accepted(rows):
    """ids of rows that the language stage keeps with its usual parameters."""
    found = judged(rows)
    return {d for d, t, _ in rows if found[d][1] != "und" and found[d][2] >= langid.LEAST_SCORE and (len(t) < langid.ENOUGH or found[d][3] >= langid.LEAST_COSINE)}
