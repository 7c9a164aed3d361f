"""Benchmark decontamination by greedy string tiling.

Benchmark items are indexed by their token runs of ``min_match`` (the seeds). A document's tokens are
joined to the seeds; an item stays a candidate if its seeded tokens could reach the wanted coverage. For each
candidate, running Karp-Rabin greedy string tiling repeatedly marks the longest common runs that don't
overlap earlier tiles, whatever their order, down to ``min_match`` tokens. An item whose tokens are covered
to at least ``coverage`` is leaked, so reordered passages count too.

The benchmark is read in blocks of about ``block_bytes`` of text, at most twice that (one larger item is a block of its own), each of
which meets all documents in a pass without a shuffle. With several blocks each pass is written before the next
begins, and its block is dropped: driver and executors hold one block at a time, however large the benchmark is.

Defined results. Tokens are lower-cased runs of letters and digits. Null text or no tokens: clean. Items
without tokens never match; items shorter than ``min_match`` must occur whole. A null item_id is listed as
null. Repeated rows: a row each; equal items are listed as often as they are there. Ties of tiles: the first in the item, then in the text. Very long texts: whole. Empty benchmark: all clean. Empty table: empty
result. Columns named like the results are replaced; all others pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, unused

TOKEN = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
FOUND = "items array<bigint>, coverage double"


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of every ``n`` consecutive ids, modulo 2**64."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    x, out, done, power = ids.astype(np.uint64), np.zeros(m, np.uint64), 0, n
    # By doubling: the hash of 2k ids is that of the first k times BASE**k, plus that of the next k.
    block, size, factor = x.copy(), 1, BASE
    while power:
        if power & 1:
            out = out * factor + block[done : done + m]
            done += size
        power >>= 1
        if power:
            block = block[: len(block) - size] * factor + block[size:]
            size *= 2
            factor = np.uint64(int(factor) ** 2 % 2**64)
    return out


def tiles(test: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in test, place in text, length), longest first, none overlapping."""
    free_a, free_b = np.ones(len(test), bool), np.ones(len(text), bool)
    found: list[tuple[int, int, int]] = []
    search = max(min_match, min(len(test), 64))
    with np.errstate(over="ignore"):
        while True:
            longest, matches = search, []
            a, b = rolling(test, search), rolling(text, search)
            ok_a = np.flatnonzero(np.convolve(~free_a, np.ones(search, int), "valid") == 0) if len(a) else a.astype(int)
            ok_b = np.flatnonzero(np.convolve(~free_b, np.ones(search, int), "valid") == 0) if len(b) else b.astype(int)
            table: dict[int, list[int]] = {}
            if len(ok_a) and len(ok_b):
                ok_b = ok_b[np.isin(b[ok_b], a[ok_a])]
                for j in ok_b.tolist():
                    table.setdefault(int(b[j]), []).append(j)
            for i in ok_a.tolist() if table else []:
                for j in table.get(int(a[i]), ()):
                    if i and j and free_a[i - 1] and free_b[j - 1] and test[i - 1] == text[j - 1]:
                        continue  # inside a longer match
                    k = 0
                    while i + k < len(test) and j + k < len(text) and free_a[i + k] and free_b[j + k] and test[i + k] == text[j + k]:
                        k += 1
                    if k >= search:
                        matches.append((k, i, j))
                        longest = max(longest, k)
            if longest > 2 * search:
                search = longest
                continue
            again = False
            for k, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
                if free_a[i : i + k].all() and free_b[j : j + k].all():
                    free_a[i : i + k] = free_b[j : j + k] = False
                    found.append((i, j, k))
                else:
                    again = True  # what is left of it may still be long enough
            if again:
                continue
            if search <= min_match:
                return found
            search = max(min_match, search // 2)


@dataclass
class Index:
    """Seeds of a block of items."""

    items: list[tuple[int | None, str]]
    min_match: int = 5
    coverage: float = 0.8
    words: dict[str, int] = field(default_factory=dict)
    tokens: list[np.ndarray] = field(default_factory=list)
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self):
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in TOKEN.findall(text.lower())], np.int64)
            self.tokens.append(ids)
            if len(ids):
                n = min(self.min_match, len(ids))
                by_size.setdefault(n, []).append((rolling(ids, n), k))
        for n, rows in by_size.items():
            h = np.concatenate([r[0] for r in rows])
            item = np.concatenate([np.full(len(r[0]), r[1]) for r in rows])
            place = np.concatenate([np.arange(len(r[0])) for r in rows])
            order = np.argsort(h, kind="stable")
            self.seeds[n] = h[order], item[order], place[order]

    def leaks(self, text: str, times: list[int] | None = None) -> tuple[list[int | None], float]:
        """The items that a text leaks, and the largest coverage of any candidate (0 without one)."""
        get = self.words.get
        ids = np.array([get(w, 0) for w in TOKEN.findall(text.lower())], np.int64)
        most, out = 0.0, []
        for n, (h, item, place) in self.seeds.items():
            own = rolling(ids, n)
            lo = np.searchsorted(h, own, "left")
            hit = np.flatnonzero((h[np.minimum(lo, len(h) - 1)] == own) if len(own) else own)
            if not len(hit):
                continue
            u, lo = np.unique(own[hit], return_index=False), None
            lo, hi = np.searchsorted(h, u, "left"), np.searchsorted(h, u, "right")
            seeded: dict[int, np.ndarray] = {}
            for a, b in zip(lo.tolist(), hi.tolist()):
                for k, p in zip(item[a:b].tolist(), place[a:b].tolist()):
                    mask = seeded.get(k)
                    if mask is None:
                        mask = seeded[k] = np.zeros(len(self.tokens[k]), bool)
                    mask[p : p + n] = True
            near = None
            for k, mask in sorted(seeded.items()):
                size = len(mask)
                if mask.sum() < self.coverage * size:
                    continue
                if near is None:  # only seeded stretches of the text can hold tiles
                    keep = np.zeros(len(ids) + 1, np.int64)
                    np.add.at(keep, hit, 1)
                    np.add.at(keep, np.minimum(hit + n, len(ids)), -1)
                    near = np.where(np.cumsum(keep)[:-1] > 0, ids, 0)
                    cuts = np.flatnonzero((near != 0) | (np.append(0, near[:-1]) != 0))  # stretches, parted by one zero
                    near = near[cuts]
                covered = sum(t[2] for t in tiles(self.tokens[k], near, n)) / size
                most = max(most, covered)
                if covered >= self.coverage:
                    out += [self.items[k][0]] * (times[k] if times else 1)
        return out, most


def plan_blocks(rows: DataFrame, block_bytes: int) -> list[tuple[int, int]]:
    """(n, k): blocks of items whose hash modulo n is k, each of at most twice ``block_bytes`` or one item. A block that is too large is halved by its hash."""
    size, done = F.octet_length("text"), []
    n = max(1, -(-(rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) // block_bytes))
    large = None
    while large is None or large:
        some = rows if large is None else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n // 2)).isin(large))
        found = some.groupBy(F.pmod(F.xxhash64("id", "text"), F.lit(n)).alias("k")).agg(F.sum(size).alias("bytes"), F.count("*").alias("items")).collect()  # a row a block
        large = [r.k for r in found if r.bytes > 2 * block_bytes and r["items"] > 1]
        done += [(n, r.k) for r in found if r.k not in large]
        n *= 2
    return sorted(done)


def blocks(benchmark: DataFrame, block_bytes: int, text_col: str, id_col: str):
    """How many blocks, and then the benchmark's distinct (id, text) rows with how often each is there, block by block."""
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = rows.groupBy("id", "text").agg(F.count("*").alias("times"))
    plan = plan_blocks(rows, block_bytes)
    yield max(1, len(plan))
    for n, k in plan:
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield sorted(((r.id, r.text, r.times) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not plan:
        yield []


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.8, block_bytes: int = 16 << 20, text_col: str = "text", item_text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """``docs`` with leaked (array of item ids), coverage (largest of any candidate item) and contaminated."""
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    docs = docs.drop(*(c for c in ("leaked", "coverage", "contaminated") if c != text_col))
    names, text = docs.columns, unused(docs.columns, "text")
    told = unused([*names, text], "told")
    docs = docs.withColumn(text, F.coalesce(docs[text_col].cast("string"), F.lit("")))
    parts = blocks(benchmark, block_bytes, item_text, item_id)
    n = next(parts)
    for k, items in enumerate(parts):
        held = context.broadcast((Index([i[:2] for i in items], min_match, coverage), [i[2] for i in items]))

        @F.arrow_udf(FOUND)
        def leaks(texts, held=held):
            index, times = held.value
            rows = [index.leaks(t, times) for at in range(0, len(texts), 200) for t in texts.slice(at, 200).to_pylist()]
            return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.float64())], ["items", "coverage"])

        found = leaks(F.col(text))
        if k:
            one = unused([*names, text, told], "found")
            docs = docs.withColumn(one, found)
            found = F.struct(F.concat(F.col(told)["items"], F.col(one)["items"]).alias("items"), F.greatest(F.col(told)["coverage"], F.col(one)["coverage"]).alias("coverage"))
            docs = docs.withColumn(told, found).drop(one)
        else:
            docs = docs.withColumn(told, found)
        if n > 1:
            docs = stored(docs, "leaks")
            held.unpersist()
    leaked = F.col(told)["items"]
    return docs.select(*(F.col(f"`{c}`") for c in names), leaked.alias("leaked"), F.col(told)["coverage"].alias("coverage"), (F.size(leaked) > 0).alias("contaminated"))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "contaminated", F.array_sort("leaked").alias("item_ids"), "coverage")


def keep_clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak an item go."""
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.where("not contaminated").select(*docs.columns)
