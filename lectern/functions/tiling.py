"""Topic tiles of a text by lexical cohesion (after Hearst 1997)."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .stopwords import ENGLISH

WIDTH, BLOCK = 20, 10
_WORD = re.compile(r"[a-z'-]+")
_STOP = frozenset(ENGLISH)


def _cosine(a: Counter, b: Counter) -> float:
    norm = np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b[k] for k, v in a.items()) / norm if norm else 0.0


def tile(text: str | None, width: int = WIDTH, block: int = BLOCK) -> list[str]:
    """Cuts at paragraph breaks next to deep valleys of the similarity between neighbouring blocks of words.

    A text without paragraph breaks or too short for two blocks is one tile; null and blank texts have none.
    """
    if not text or not text.strip():
        return []
    breaks = [m.end() for m in re.finditer(r"\n[ \t\r\f\v]*\n\s*", text)]
    found = list(_WORD.finditer(text.lower()))
    rows = [Counter(m[0] for m in found[k : k + width] if m[0] not in _STOP) for k in range(0, len(found), width)]
    if not breaks or len(rows) < 4:
        return [text.strip()]
    gaps = []
    for k in range(1, len(rows)):
        reach = min(block, k, len(rows) - k)
        gaps.append(_cosine(sum(rows[k - reach : k], Counter()), sum(rows[k : k + reach], Counter())))
    score = np.convolve(np.pad(gaps, 1, mode="edge"), np.ones(3) / 3, "valid")
    depth = np.zeros(len(score))
    for k in range(len(score)):
        left = right = k
        while left > 0 and score[left - 1] >= score[left]:
            left -= 1
        while right + 1 < len(score) and score[right + 1] >= score[right]:
            right += 1
        depth[k] = score[left] + score[right] - 2 * score[k]
    least = max(0.0, depth.mean() - depth.std() / 2)
    cuts = set()
    for k in np.argsort(-depth, kind="stable"):
        if depth[k] > least:
            place = found[min((k + 1) * width, len(found) - 1)].start()
            cuts.add(min(breaks, key=lambda b: abs(b - place)))
    edges = [0, *sorted(cuts), len(text)]
    return [t for t in (text[a:b].strip() for a, b in zip(edges, edges[1:], strict=False)) if t]


@F.pandas_udf(ArrayType(StringType()))
def tiles(text: pd.Series) -> pd.Series:
    return text.map(tile)
