"""Pieces of DuckDB SQL that the oracle queries share. Each is the text of common table expressions."""

from __future__ import annotations

from lectern.functions.stopwords import ENGLISH

DOCS = "d AS (SELECT source AS cid, doc_id, text FROM documents)"
ENGLISH_DOCS = "d AS (SELECT source AS cid, doc_id, text FROM documents WHERE lang = 'en')"
SENTENCES = r"""sa AS (SELECT cid, doc_id, list_filter(list_transform(regexp_split_to_array(
    regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(10), 'g'), '\n+'),
    lambda x: trim(regexp_replace(lower(x), '[ \t\n\r]+', ' ', 'g'))), lambda x: x <> '') AS arr FROM d),
s AS (SELECT cid, doc_id, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS sent_idx, unnest(arr) AS sent FROM sa)"""
QUERY = "q AS (SELECT 'src' || item_id AS cid, text AS query FROM benchmark WHERE item_id < 20)"
REFERENCES = "ref AS (SELECT 'src' || (item_id % 20) AS cid, CAST(item_id // 20 + 1 AS INTEGER) AS ref_idx, text FROM benchmark WHERE item_id < 40)"
TERM = r"'[\p{L}\p{N}_]{2,}'"
WORD = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r]'"
COUNTS = rf"""st AS (SELECT cid, doc_id, sent_idx, term, count(*) AS tf FROM
    (SELECT cid, doc_id, sent_idx, unnest(regexp_extract_all(lower(sent), {TERM})) AS term FROM s) GROUP BY ALL),
qt AS (SELECT cid, term, count(*) AS tf FROM (SELECT cid, unnest(regexp_extract_all(lower(query), {TERM})) AS term FROM q) GROUP BY ALL)"""
SCORES = """sn AS (SELECT cid, doc_id, sent_idx, sqrt(sum(tf * tf)) AS norm FROM st GROUP BY ALL),
qn AS (SELECT cid, sqrt(sum(tf * tf)) AS norm FROM qt GROUP BY ALL),
dots AS (SELECT cid, doc_id, sent_idx, CAST(sum(st.tf * qt.tf) AS DOUBLE) AS dot FROM st JOIN qt USING (cid, term) GROUP BY ALL),
sc AS (SELECT s.cid, s.doc_id, s.sent_idx, s.sent, coalesce(dot / (sn.norm * qn.norm), 0.0) AS score FROM s JOIN q USING (cid)
    LEFT JOIN dots USING (cid, doc_id, sent_idx) LEFT JOIN sn USING (cid, doc_id, sent_idx) LEFT JOIN qn USING (cid))"""
BASE = ", ".join((DOCS, SENTENCES, QUERY, COUNTS, SCORES))
RANK = "CAST(row_number() OVER (PARTITION BY cid ORDER BY round(score, 9) DESC, doc_id, sent_idx) AS INTEGER) AS rank"


def top(k: int, source: str = "sc", name: str = "tk") -> str:
    """The k best rows with a positive score of each cluster."""
    return f"{name} AS (SELECT * FROM (SELECT *, {RANK} FROM {source} WHERE score > 1e-10) WHERE rank <= {k})"


def shares(source: str, name: str = "cu") -> str:
    """Rows with rank and the share of the scores that stand before them."""
    return f"""{name} AS (SELECT *, coalesce(round((cum - score) / nullif(total, 0), 9), 0) AS before FROM
    (SELECT *, {RANK}, sum(score) OVER (PARTITION BY cid ORDER BY round(score, 9) DESC, doc_id, sent_idx ROWS UNBOUNDED PRECEDING) AS cum,
     sum(score) OVER (PARTITION BY cid) AS total FROM {source}))"""


def without_stopwords(column: str) -> str:
    listed = ", ".join(f"'{w}'" for w in ENGLISH)
    return f"array_to_string(list_filter(string_split({column}, ' '), lambda w: NOT list_contains([{listed}], w)), ' ')"


def select(*parts: str, recursive: bool = False) -> str:
    """All but the last are table expressions; the last is the query."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts[:-1]) + "\n" + parts[-1]
