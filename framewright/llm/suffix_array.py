"""Substring dedup over an enhanced suffix array.

Each shard (see ``repeats``) sorts its suffixes and has the lengths of their common prefixes. The tree of
common-prefix intervals is scanned with a stack; an interval of at least ``width`` symbols whose
occurrences have two different symbols to their left (or an edge) is a maximal repeat, and all its
occurrences form a group (a string that two documents have counts as two occurrences). Every repeated window lies in the occurrences of a maximal repeat that has the
same set of documents, so marking the groups marks every window.

Defined results. Null text: empty. Texts under ``width`` bytes: nothing removed. Repeated rows and rows
with one doc_id count as one document: they never remove each other. A null doc_id comes after every other.
Very long texts: whole, in pieces that overlap. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Groups, Strings, Suffixes, Unit, dedup, maximal


def intervals(lcp: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All intervals of the common-prefix tree of ``width`` and more symbols: first place, end, length."""
    n = len(lcp)
    deep = lcp >= width
    lo = np.flatnonzero(deep & ~np.concatenate([[False], deep[:-1]])) if n else np.zeros(0, np.int64)
    hi = np.flatnonzero(deep & ~np.concatenate([deep[1:], [False]])) + 1 if n else np.zeros(0, np.int64)
    if not len(lo):
        return lo, hi, np.zeros(0, np.int64)
    cut = np.stack([lo, hi], 1).ravel()
    least = np.minimum.reduceat(np.append(lcp, 0), cut)[::2]
    most = np.maximum.reduceat(np.append(lcp, 0), cut)[::2]
    plain = least == most  # a leaf fan: the interval is the whole stretch
    fans = np.stack([lo[plain] - 1, hi[plain], least[plain]], 1)
    nested: list[tuple[int, int, int]] = []
    for a, b in zip(lo[~plain].tolist(), hi[~plain].tolist()):
        stack: list[tuple[int, int]] = []
        for i, h in enumerate([*lcp[a:b].tolist(), 0], a):
            start = i - 1
            while stack and stack[-1][1] > h:
                start, top = stack.pop()
                nested.append((start, i, top))
            if h >= width and (not stack or stack[-1][1] < h):
                stack.append((start, h))
    lo, hi, length = np.concatenate([fans, np.array(nested, np.int64).reshape(-1, 3)]).T
    return lo, hi, length


def maximal_repeats(strings: Strings) -> Iterator[tuple[Suffixes, Groups]]:
    """The suffix array of all strings, and the groups of all occurrences of each maximal repeat."""
    s = strings.sort(*strings.suffixes())
    yield s, maximal(s, *intervals(s.lcp, s.width))


def substring_dedup(docs: DataFrame, width: int = 50, with_text: bool = True, **columns: str) -> DataFrame:
    """doc_id, n_symbols, spans, kept, kept_sha256 of each row; bytes that repeat from smaller ids are removed."""
    return dedup(docs, Unit(words=False, width=width, gram=24 if width >= 48 else 8), maximal_repeats, 4, with_text=with_text, **columns)


#: The rule by itself, window by window.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
wins AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 48)) AS i FROM d)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM wins) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hits, range(50) AS r(j)),
bytes AS (SELECT doc_id, substr(h, 2 * p - 1, 2) AS b, p FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 + 1)) AS p FROM d)),
marked AS (SELECT doc_id, b, p, g.p IS NOT NULL AS gone FROM bytes LEFT JOIN gone AS g USING (doc_id, p)),
runs AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS begins FROM marked),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, coalesce(string_agg(b, '' ORDER BY p) FILTER (WHERE NOT gone), '') AS t FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    out = substring_dedup(docs, with_text=False)
    return out.select("doc_id", F.col("n_symbols").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
