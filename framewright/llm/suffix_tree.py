"""Substring dedup over prefix-partitioned suffix trees.

Between tasks, a window's anchor (a name of its content) or, where that is too common, its whole first ``width`` words choose the shard (see
``repeats``). Within a shard, variable-length prefixes split the suffixes into groups of at most ``memory`` suffixes, by counting words
before anything is sorted: a group too large at one prefix length is split by the next word, until it fits or is one repeat throughout. Each group
is ordered alone and becomes a suffix tree of its own; the internal nodes at ``width`` and more words that are left-diverse are
maximal repeats, and the leaves below are their occurrences (a string that two documents have counts as two).

Defined results. Null text: no words. Under ``width`` words: nothing removed. Repeated rows and rows with one
doc_id count as one document. A null doc_id comes after every other. Very long texts: whole. Empty
table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Groups, Strings, Suffixes, U, Unit, dedup, maximal

MEMORY = 50_000


def partitions(strings: Strings, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(string, offset, depth) of the prefix groups: suffixes that share a prefix of ``depth`` words, and as many prefixes as fit together.

    Prefixes are counted word by word, before anything is sorted: a group over ``memory`` is split by its next word, up to ``width`` words.
    """
    todo = [(*strings.suffixes(), 0)]
    while todo:
        string, offset, depth = todo.pop()
        if len(string) <= memory or depth >= strings.width:
            if len(string):
                yield string, offset, depth
            continue
        word = strings.flat[strings.base[string] + offset + depth]
        order = np.argsort(word, kind="stable")
        starts = np.flatnonzero(np.diff(word[order], prepend=U(0)))
        string, offset, ends = string[order], offset[order], np.append(starts[1:], len(order))
        start = 0
        for a, b in zip(starts.tolist(), ends.tolist()):  # small neighbours stay together: a group is a range of prefixes
            if b - a > memory:
                if a > start:
                    yield string[start:a], offset[start:a], depth
                todo.append((string[a:b], offset[a:b], depth + 1))
                start = b
            elif b - start > memory:
                yield string[start:a], offset[start:a], depth
                start = a
        if start < len(order):
            yield string[start:], offset[start:], depth


def deep_nodes(lcp: np.ndarray, width: int) -> np.ndarray:
    """Internal nodes of the suffix tree of one group, at ``width`` and deeper: (first leaf, end, depth).

    The tree is built by adding the sorted suffixes one by one along its right edge.
    """
    deep = np.flatnonzero(lcp[1:] >= width) + 1
    if not len(deep):
        return np.zeros((0, 3), np.int64)
    nodes: list[list[int]] = []  # first leaf, end, depth
    edge: list[int] = []  # the right edge, by node
    last = -1
    for i, h in zip(deep.tolist(), lcp[deep].tolist()):
        if i != last + 1:
            for v in edge:
                nodes[v][1] = last + 1
            edge = []
        first = i - 1
        while edge and nodes[edge[-1]][2] > h:
            v = edge.pop()
            nodes[v][1] = i
            first = nodes[v][0]
        if not edge or nodes[edge[-1]][2] < h:
            edge.append(len(nodes))
            nodes.append([first, 0, h])
        last = i
    for v in edge:
        nodes[v][1] = last + 1
    return np.array(nodes, np.int64)


def maximal_repeats(strings: Strings, memory: int = MEMORY) -> Iterator[tuple[Suffixes, Groups]]:
    """Group by group: the leaves of its suffix tree in order, and its left-diverse deep nodes."""
    for string, offset, depth in partitions(strings, memory):
        s = strings.sort(string, offset, depth)
        yield s, maximal(s, *deep_nodes(s.lcp, s.width).T)


def window_dedup(docs: DataFrame, width: int = 50, with_text: bool = True, **columns: str) -> DataFrame:
    """doc_id, n_symbols, spans, kept, kept_sha256 of each row; words of windows that repeat from smaller ids are removed."""
    return dedup(docs, Unit(words=True, width=width, gram=max(1, width // 3)), maximal_repeats, 2, with_text=with_text, **columns)


#: The rule by itself, window by window.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM wins) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hits, range(50) AS r(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(gone.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL), '') AS t FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def op4_suffix_tree_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return window_dedup(docs, with_text=False).select("doc_id", F.col("n_symbols").alias("n_words"), removed.alias("n_removed"), "kept_sha256")
