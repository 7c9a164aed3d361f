"""What both substring-dedup operators share: windows of symbols, anchors, shards of strings, marks.

A *symbol* is a byte or a word; a *window* is ``width`` consecutive symbols of one document. The rule:
remove every symbol covered by a window that also starts in a document with a smaller id.

1. *Texts.* Each distinct text is sent to a chunk once a task, with the ids that have it; of a text that over a thousandth of all rows have, only
   the first row is sent. The least anchor of a text's first ``HEAD`` characters deals it, so that near copies mostly meet in a
   chunk, which then sends what they share once. A name with more bytes than twice an even chunk is split by the texts' digests. All of
   this follows from content and counts, never from the order of rows, so a task that is run again does the same.
2. *Anchors.* Each window is named by the least hash of its ``gram``-symbol substrings, so equal windows
   have equal anchors, and neighbours mostly share theirs. Chunks send the distinct anchors
   (4 bytes each); a shard of anchors answers which ones stand in two documents.
3. *Super-windows.* A run of windows with one shared anchor is one string, of at most
   ``width + RUN - 1`` symbols. A chunk sends the anchor's shard the hash of each distinct string with the least id
   that has it, and whether another document has it too. Where ``hot`` or more chunks share an anchor, its windows go to shards by
   their own content, each a string of ``width`` symbols: what can be equal still meets, and no shard holds more than its part. The shard asks
   one chunk for the symbols of each distinct string that isn't alone under its anchor or that two documents have.
4. *Suffixes.* So a shard has, once each, all distinct strings of which a window may be found again. The operator's method (``find``) orders
   their suffixes and gives the groups of equal prefixes; a string that two documents have counts as two occurrences (one that shares its anchor with no
   other can only repeat whole, so only its first suffix is ordered). A window is found again only if it lies in such a group, and the group's least id decides.
5. Each chunk gets a bit for each window of its strings, for the least id that has the string and for all others, marks its texts and removes the symbols.

Strings are told apart by their 64-bit XXH64 under the 32 bits of their anchor; the suffixes of each are compared symbol by symbol.
Each stage that reads a chunk handles its texts in blocks (``Block``), since array operations on one short text cost more than its bytes do; no window, run or span crosses from one text into the next.
All of it is one plan; the exchange of the texts by chunk is made once and reused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_count, cut, id_and_text, join_back, mix, slices, stored

#: Most windows in a super-window (its marks are one word), characters of texts that are handled together, and symbols at a time.
RUN, BLOCK, PIECE = 62, 1 << 16, 1 << 19
#: Characters whose anchor deals a text.
HEAD = 512
NO_ID = np.iinfo(np.int64).max
U = np.uint64


@dataclass
class Block:
    """Texts that are handled together, so that array operations aren't paid for text by text; their symbols are numbered on."""

    raw: bytes  #: all symbols (words joined by one space)
    begin: np.ndarray  #: each text's first symbol, and the end of the last
    starts: np.ndarray | None  #: where words start and end
    ends: np.ndarray | None

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the bytes of the symbols lo..hi (one at least) start and end."""
        return (lo, hi) if self.starts is None else (self.starts[lo], self.ends[hi - 1])

    def text(self, k: int) -> bytes:
        """The bytes of a text."""
        lo, hi = self.begin[k : k + 2].tolist()
        if self.starts is None:
            return self.raw[lo:hi]
        return self.raw[self.starts[lo] : self.ends[hi - 1]] if hi > lo else b""


@dataclass(frozen=True)
class Unit:
    """How a text falls into symbols."""

    words: bool
    width: int
    gram: int

    def block(self, texts: list[str]) -> Block:
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        if not self.words:
            return Block(b"".join(parts), np.cumsum([0, *map(len, parts)]), None, None)
        split = [p.split() for p in parts]
        raw = b" ".join([w for words in split for w in words])
        gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        starts, ends = (np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])) if raw else (gaps, gaps)
        return Block(raw, np.cumsum([0, *map(len, split)]), starts, ends)

    def blocks(self, texts: Iterable[str]) -> Iterator[Block]:
        """The texts in order, in blocks of ``BLOCK`` characters or of one longer text."""
        some: list[str] = []
        size = 0
        for t in texts:
            if some and size + len(t) > BLOCK:
                yield self.block(some)
                some, size = [], 0
            some.append(t)
            size += len(t)
        if some:
            yield self.block(some)

    def hashes(self, raw: bytes, starts: np.ndarray | None, ends: np.ndarray | None) -> np.ndarray:
        """A hash of each ``gram`` consecutive symbols, by content alone."""
        b = np.frombuffer(raw + bytes(8), np.uint8)
        n = len(starts) if self.words else len(raw)
        if not self.words:
            step, one = 8, np.ndarray((n,), "<u8", b, 0, (1,)).copy()
        else:
            size = (ends - starts).astype(U)
            load = np.ndarray((len(b) - 7,), "<u8", b, 0, (1,)).__getitem__
            part = lambda v, left: np.where(left >= 8, v, v & ((U(1) << (U(8) * np.minimum(left, U(7)))) - U(1)))
            one = part(load(starts), size) + size
            long = size > 8
            if long.any():
                s, z = starts[long], size[long]
                one[long] = mix(one[long]) + part(load(s + 8), z - U(8)) * U(0x9E3779B97F4A7C15) + load(ends[long] - 8) * U(0xC2B2AE3D27D4EB4F)
            step, one = 1, mix(one)
        m = n - self.gram + 1
        h = one[:m].copy()
        for j in range(step, self.gram, step):
            h *= U(0x9E3779B97F4A7C15)
            h += one[j : j + m]
        return mix(h)

    def runs(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, first window, windows, anchor) of the runs, piece by piece; windows are numbered as the block's symbols are."""
        n = int(block.begin[-1])
        windows = n - self.width + 1
        for at in range(0, max(windows, 0), PIECE):
            upto = min(n, at + PIECE + self.width - 1)
            if self.words:
                lo, hi = int(block.starts[at]), int(block.ends[upto - 1])
                least = self.hashes(block.raw[lo:hi], block.starts[at:upto] - lo, block.ends[at:upto] - lo)
            else:
                least = self.hashes(block.raw[at:upto], None, None)
            span, have = self.width - self.gram + 1, 1
            while 2 * have <= span:
                least = np.minimum(least[:-have], least[have:])
                have *= 2
            if have < span:
                least = np.minimum(least[: len(least) - span + have], least[span - have :])
            new = np.ones(len(least), bool)
            np.not_equal(least[1:], least[:-1], out=new[1:])
            for edge in (block.begin - at, block.begin - at - self.width + 1):  # windows over the end of a text are in runs of their own, which are left out
                new[edge[(edge >= 0) & (edge < len(new))]] = True
            first = np.flatnonzero(new)
            size = np.diff(first, append=len(least))
            anchor = least[first]
            first += at
            text = np.searchsorted(block.begin, first, side="right") - 1
            whole = first + self.width <= block.begin[text + 1]
            if not whole.all():
                text, first, size, anchor = text[whole], first[whole], size[whole], anchor[whole]
            if (size > RUN).any():
                pieces = -(-size // RUN)
                again = np.repeat(np.arange(len(first)), pieces)
                k = np.arange(len(again)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                text, first, size, anchor = text[again], first[again] + k * RUN, np.minimum(RUN, size[again] - k * RUN), anchor[again]
            yield text, first, size, anchor


# ---------------------------------------------------------------- suffixes of a shard


@dataclass
class Suffixes:
    """Sorted suffixes of a shard's strings, of at least ``width`` symbols each."""

    string: np.ndarray  #: which string
    offset: np.ndarray  #: where in it
    lcp: np.ndarray  #: symbols shared with the suffix before; 0 for the first
    left: np.ndarray  #: the symbol before, -1 at a string's edge
    length: np.ndarray  #: symbols
    twice: np.ndarray  #: whether two documents have the string
    width: int


@dataclass
class Groups:
    """Repeats: suffixes lo..hi (sorted places) share ``length`` symbols."""

    lo: np.ndarray
    hi: np.ndarray
    length: np.ndarray


class Strings:
    """A shard's strings, packed for comparison: ``q`` symbols to a word. ``symbols``: of all strings in turn, 1 and up."""

    def __init__(self, symbols: np.ndarray, size: np.ndarray, twice: np.ndarray, width: int, q: int, lone: np.ndarray | None = None):
        """``lone``: strings that share no window with another; only as a whole can they repeat, so only their first suffix is looked at."""
        self.size, self.twice, self.width, self.q, self.bits = size, twice, width, q, 64 // q
        self.lone = np.zeros(len(size), bool) if lone is None else lone
        # Strings lie apart by q zeros (symbols are 1 and up), so that a word never holds two strings.
        self.base = np.cumsum(size + q) - size - q
        self.flat = np.zeros(int((size + q).sum()) + q, symbols.dtype)
        inside = np.ones(len(self.flat), bool)
        inside[((self.base + size)[:, None] + np.arange(q)).ravel()] = False
        inside[len(inside) - q :] = False
        self.flat[inside] = symbols
        del inside
        self.packed = np.zeros(len(self.flat), U)
        for at in range(0, len(self.flat), BLOCK):  # slices, so that no copy of all symbols is as wide as a word
            word = self.packed[at : at + BLOCK]
            for j in range(q):
                part = self.flat[at + j : at + j + len(word)]
                word[: len(part)] |= part.astype(U) << U(64 - self.bits * (j + 1))

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """(string, offset) of all suffixes of ``width`` and more symbols."""
        count = np.maximum(self.size - self.width + 1, 0)
        count[self.lone] = np.minimum(count[self.lone], 1)
        string = np.repeat(np.arange(len(self.size)), count)
        return string, np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Leading symbols that two words share."""
        x, k = a ^ b, np.zeros(len(a), np.int64)
        for j in range(1, self.q + 1):
            k += (x >> U(64 - self.bits * j)) == 0
        return k

    def sort(self, string: np.ndarray, offset: np.ndarray, depth: int = 0) -> Suffixes:
        """Sort suffixes that share their first ``depth`` symbols, going on only where words tie."""
        start, end = self.base[string] + offset, (self.base + self.size)[string]
        order = np.argsort(self.packed[start + depth], kind="stable")
        word = self.packed[start[order] + depth]
        new, lcp = np.ones(len(order), bool), np.zeros(len(order), np.int64)
        if len(order) > 1:
            new[1:] = word[1:] != word[:-1]
            lcp[1:] = depth + self._same(word[1:], word[:-1])
        depth += self.q
        while True:
            tied = np.flatnonzero(~new | np.append(~new[1:], False)) if len(new) else new
            if not len(tied):
                break
            s = order[tied]
            here = start[s] + depth
            inside = here < end[s]
            if not inside.any():
                break
            word = np.where(inside, self.packed[np.minimum(here, len(self.packed) - 1)], U(0))
            group = np.cumsum(new)[tied]
            by = np.lexsort((word, group))
            order[tied], word = s[by], word[by]
            still = ~new[tied[1:]]  # within a group the places follow each other
            k = self._same(word[1:], word[:-1])
            lcp[tied[1:][still]] = depth + k[still]
            new[tied[1:][still & (word[1:] != word[:-1])]] = True
            depth += self.q
        string, offset, length = string[order], offset[order], (end - start)[order]
        if len(order) > 1:
            lcp[1:] = np.minimum(lcp[1:], np.minimum(length[1:], length[:-1]))
        before = np.where(offset > 0, self.flat[np.maximum(start[order] - 1, 0)].astype(np.int64), -1)
        return Suffixes(string, offset, lcp, before, length, self.twice[string], self.width)


#: The operator's method: a shard's strings -> sorted suffixes and the groups among them, once or part by part.
Find = Callable[[Strings], Iterator[tuple[Suffixes, Groups]]]


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, place) of every place of the groups."""
    n = hi - lo
    g = np.repeat(np.arange(len(n)), n)
    return g, np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def left_diverse(s: Suffixes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which groups can't be extended to the left as a whole: they have two left symbols, or a string's edge."""
    if not len(lo):
        return np.zeros(0, bool)
    g, at = expand(lo, hi)
    first = np.cumsum(hi - lo) - (hi - lo)
    x = s.left[at]
    least, most = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    return (least != most) | (least < 0)


def maximal(s: Suffixes, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> Groups:
    """The left-diverse ones of the given groups, and of the suffixes that occur twice as they are."""
    # A string that two documents have: each of its suffixes is a leaf of two occurrences; they differ to the left only at the edge.
    twice = np.flatnonzero(s.twice & (s.left < 0))
    lo, hi, length = np.concatenate([lo, twice]), np.concatenate([hi, twice + 1]), np.concatenate([length, s.length[twice]])
    keep = left_diverse(s, lo, hi)
    return Groups(lo[keep], hi[keep], length[keep])


def least_ids(strings: Strings, ids: np.ndarray, find: Find) -> np.ndarray:
    """For each window of each string, in order, the least id of the groups that it lies in; NO_ID where it lies in none."""
    width = strings.width
    count = np.maximum(strings.size - width + 1, 0)
    first = np.cumsum(count) - count
    least = np.full(count.sum(), NO_ID)
    for s, groups in find(strings):
        if not len(groups.lo):
            continue
        g, at = expand(groups.lo, groups.hi)
        of = np.minimum.reduceat(ids[s.string[at]], np.cumsum(groups.hi - groups.lo) - (groups.hi - groups.lo))[g]
        window, last = first[s.string[at]] + s.offset[at], groups.length[g] - width
        for j in range(int(last.max()) + 1):  # every window inside the repeat
            in_it = np.flatnonzero(last >= j)
            np.minimum.at(least, window[in_it] + j, of[in_it])
    return least


# ---------------------------------------------------------------- the plan


def _key(anchor: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    return ((anchor >> U(32)) % U(shards)).astype(np.int64), (anchor & U(0xFFFFFFFF)).astype(np.uint32)


def _by_shard(shard: np.ndarray, *columns: np.ndarray):
    """Columns cut by shard, in order."""
    order = np.lexsort((columns[0], shard)) if columns else np.argsort(shard)
    shard = shard[order]
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    cuts = [np.split(c[order], at[1:]) for c in columns]
    return zip(shard[at].tolist(), *cuts)


def _join(blobs, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(b, kind) for b in blobs]])


def _in(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the ascending ``a``."""
    return a[np.minimum(np.searchsorted(a, x), len(a) - 1)] == x if len(a) else np.zeros(len(x), bool)


class _Known:
    """A chunk's shared anchors, and those among them that are split by window."""

    def __init__(self, replies: pa.Table, shards: int):
        rows = [r for r in zip(*[replies.column(c).to_pylist() for c in ("shard", "a", "b")]) if r[0] >= 0]
        join = lambda k: np.sort(np.concatenate([np.zeros(0, U), *[(U(r[0]) << U(32)) | np.frombuffer(r[k], "<u4").astype(U) for r in rows]]))
        self.shared, self.hot, self.shards = join(1), join(2), shards

        # Most anchors aren't shared: one look into a table by their last bits tells so of seven in eight of these.
        self.last = U((1 << max(10, (8 * len(self.shared)).bit_length())) - 1)
        self.table = np.zeros(int(self.last) + 1, bool)
        self.table[(self.shared & self.last).astype(np.int64)] = True

    def test(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which anchors are shared; and of these, whether they are split by window, their shards and codes."""
        at = np.flatnonzero(self.table[(anchor & self.last).astype(np.int64)])
        shard, code = _key(anchor[at], self.shards)
        key = (shard.astype(U) << U(32)) | code
        there = _in(self.shared, key)
        return at[there], _in(self.hot, key[there]), shard[there], code[there]


@dataclass
class _Places:
    """The super-windows of a chunk's distinct texts, wherever they stand: a row a place."""

    text: np.ndarray  #: which text
    first: np.ndarray  #: the first window, by the block's numbers
    windows: np.ndarray
    shard: np.ndarray
    code: np.ndarray  #: names the anchor in its shard
    hash: np.ndarray
    blocks: list[Block]
    texts: np.ndarray  #: the first text of each block, and how many there are
    places: np.ndarray  #: the first place of each block, and how many there are

    @staticmethod
    def of(unit: Unit, known: _Known, texts: Iterable[str]) -> _Places:
        import xxhash

        digest, w = xxhash.xxh64_intdigest, unit.width
        rows: list[tuple[np.ndarray, ...]] = []
        blocks: list[Block] = []
        done, places = [0], [0]
        for block in unit.blocks(texts):
            here = 0
            for text, first, size, anchor in unit.runs(block) if len(known.shared) else ():
                found, hot, shard, code = known.test(anchor)
                if not len(found):
                    continue
                text, first, size = text[found], first[found], size[found]
                at, split = np.flatnonzero(~hot), np.flatnonzero(hot)
                of, window = expand(first[split], first[split] + size[split])
                t, f, m = np.concatenate([text[at], text[split][of]]), np.concatenate([first[at], window]), np.concatenate([size[at], np.ones(len(of), np.int64)])
                raw = block.raw
                lo, hi = block.bounds(f, f + m + w - 1)
                h = np.array([digest(raw[a:b]) for a, b in zip(lo.tolist(), hi.tolist())], U)
                own = mix(h[len(at) :])  # a window's own content deals it
                shard, code = np.concatenate([shard[at], (own % U(known.shards)).astype(np.int64)]), np.concatenate([code[at], (own >> U(32)).astype(np.uint32)])
                rows.append((t + done[-1], f, m, shard, code, h))
                here += len(f)
            blocks.append(block)
            done.append(done[-1] + len(block.begin) - 1)
            places.append(places[-1] + here)
        kinds = (np.int64, np.int64, np.int64, np.int64, np.uint32, U)
        return _Places(*[np.concatenate([np.zeros(0, t), *[r[i] for r in rows]]) for i, t in enumerate(kinds)], blocks, np.array(done), np.array(places))

    def strings(self, at: np.ndarray, width: int) -> list[bytes]:
        """The symbols of the given places, which ascend."""
        out: list[bytes] = []
        cuts = np.searchsorted(at, self.places).tolist()
        for block, a, b in zip(self.blocks, cuts, cuts[1:]):
            if b > a:
                p, raw = at[a:b], block.raw
                lo, hi = block.bounds(self.first[p], self.first[p] + self.windows[p] + width - 1)
                out += [raw[x:y] for x, y in zip(lo.tolist(), hi.tolist())]
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct strings by shard and hash: place of one, where each shard begins; and each place's string."""
        order = np.lexsort((self.hash, self.shard))
        s, h = self.shard[order], self.hash[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (h[1:] != h[:-1])]) if len(s) else np.zeros(0, bool)
        string = np.empty(len(order), np.int64)
        string[order] = np.cumsum(new) - 1
        one = order[new]
        begin = np.flatnonzero(np.concatenate([[True], self.shard[one][1:] != self.shard[one][:-1]])) if len(one) else np.zeros(0, np.int64)
        return one, begin, np.append(begin, len(one)), string


@dataclass
class _Text:
    """A distinct text of a chunk: the least id that has it, and whether another has it."""

    digest: bytes
    text: str
    first: int
    more: bool


def _texts(table: pa.Table, hot: dict[bytes, tuple[int, bool]]) -> list[_Text]:
    """A chunk's distinct texts in order of their digests."""
    found: dict[bytes, _Text] = {}
    for digest, doc, text in zip(*[table.column(c).to_pylist() for c in ("digest", "doc_id", "text")]):
        t = found.get(digest)
        if t is None:
            t = found[digest] = _Text(digest, None, doc, False)
        if text is not None:
            t.text = text
        t.more |= doc != t.first
        t.first = min(t.first, doc)
    for digest, (first, more) in hot.items():
        if digest in found:
            found[digest].first, found[digest].more = first, more
    return [found[d] for d in sorted(found)]


def _spans(text: np.ndarray, first: np.ndarray, marks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the spans of symbols under marked windows, in order. ``first``: of each place, numbered on from text to text."""
    some = np.flatnonzero(marks)
    text, first, marks = text[some], first[some], marks[some]
    ends = []
    for b in (marks & ~(marks << U(1)), marks & ~(marks >> U(1))):  # where runs of marks begin, and where they end
        bit = np.concatenate([np.zeros(0, np.int64), *[64 * k + np.flatnonzero(np.unpackbits(b[k : k + PIECE].view(np.uint8), bitorder="little")) for k in range(0, len(b), PIECE)]])
        at = first[bit >> 6] + (bit & 63)
        order = np.argsort(at, kind="stable")
        ends.append((text[bit[order] >> 6], at[order]))
    (text, start), (_, end) = ends
    end += width
    new = np.ones(len(start), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] > end[:-1])
    return text[new], start[new], end[np.append(new[1:], True)] if len(new) else end


def _kept(block: Block, k: int, spans: list[tuple[int, int]]) -> bytes:
    """What is left of a text without the spans."""
    if not spans:
        return block.text(k)
    at, n = block.begin[k : k + 2].tolist()
    parts, starts, ends = [], block.starts, block.ends
    for s, e in [*spans, (n, n)]:
        if s > at:
            parts.append(block.raw[at:s] if starts is None else block.raw[starts[at] : ends[s - 1]])
        at = e
    return (b"" if starts is None else b" ").join(parts)


def dedup(docs: DataFrame, unit: Unit, find: Find, q: int, hot: int = 64, chunk_bytes: int = 3 << 20, with_text: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_symbols, spans (removed symbols, [start, end)), kept (UTF-8), kept_sha256 of each row of ``docs``.

    ``kept`` is null unless ``with_text``.
    """
    shards = chunk_count(docs, chunk_bytes)
    width = unit.width
    names = ("chunk", "shard", "a", "b", "c")
    piece = pa.schema([("chunk", pa.int32()), ("shard", pa.int64()), *[(c, pa.binary()) for c in "abc"]])
    ddl = "chunk int, shard bigint, a binary, b binary, c binary"

    def table_of(rows: list[tuple]) -> pa.Table:
        return pa.table({c: [r[i] for r in rows] for i, c in enumerate(names)}, schema=piece)

    def rows_of(table: pa.Table):
        return list(zip(*[table.column(c).to_pylist() for c in names]))

    def names_of(heads: list[str], digests: list[bytes]) -> np.ndarray:
        """The least anchor of each head; of one without windows its digest."""
        none, found = U(np.iinfo(U).max), []
        for block in unit.blocks(heads):
            least = np.full(len(block.begin) - 1, none)
            for text, _, _, anchor in unit.runs(block):
                np.minimum.at(least, text, anchor)
            found.append(least)
        name = np.concatenate([np.zeros(0, U), *found])
        for k in np.flatnonzero(name == none).tolist():
            name[k] = int.from_bytes(digests[k][:8], "little")
        return (name & U(2**63 - 1)).astype(np.int64)

    def named(batches):
        for b in slices(batches, 2000):
            found = names_of(b.column("head").to_pylist(), b.column("digest").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), b.column("bytes"), pa.array(found, pa.int64())], ["doc_id", "digest", "bytes", "name"])

    rows = id_and_text(docs, text_col, id_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.substring(F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)), 1, 16).alias("digest"))
    prints = stored(rows.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("bytes"), F.substring("text", 1, HEAD).alias("head")).mapInArrow(named, "doc_id bigint, digest binary, bytes bigint, name bigint"), "prints")
    classes = cut(prints.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.min("name").alias("name"), F.min("bytes").alias("bytes")))
    total, size = classes.agg(F.sum("n"), F.sum("bytes")).first()
    copies = {bytes(r.digest): (r.first, r.last > r.first) for r in classes.where((F.col("n") * 1000 > (total or 0)) & (F.col("n") > 1)).collect()}  # under a thousand
    limit = max(1 << 18, 2 * (size or 0) // shards)
    crowded = stored(classes.groupBy("name").agg(F.sum("bytes").alias("all")).where(F.col("all") > limit).select(F.col("name").alias("crowd"), F.ceil(F.col("all") / limit).alias("parts")), "crowded")

    def sent(batches):
        """Each text once a task; of one with very many copies only the first row."""
        told: set[bytes] = set()
        for b in slices(batches, 2000):
            out, heads = [], []
            for doc, text, digest in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "digest")]):
                if digest in copies and doc != copies[digest][0]:
                    continue
                out.append((digest, doc, None if digest in told else text))
                heads.append(text[:HEAD])
                told.add(digest)
            columns = list(zip(*out)) or [(), (), ()]
            columns = [names_of(heads, columns[0]), *columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.string()))], ["name", "digest", "doc_id", "text"])

    def anchors(key, table):
        """To each shard of anchors: the chunk's, and those of two of its documents."""
        texts = _texts(table, copies)
        found, of, at = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
        for block in unit.blocks(t.text for t in texts):
            for text, _, _, anchor in unit.runs(block):
                shard, code = _key(anchor, shards)
                found.append((shard.astype(U) << U(32)) | code)
                of.append(text + at)
            at += len(block.begin) - 1
        name, of = np.concatenate(found), np.concatenate(of)
        if not len(name):
            return table_of([])
        order = np.argsort(name)
        name, of = name[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        more = np.array([t.more for t in texts])[of]
        twice = np.logical_or.reduceat(more, first) | (np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first))
        name = name[first]
        shard, code = name >> U(32), (name & U(0xFFFFFFFF)).astype("<u4")
        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])).tolist()
        return table_of([(key[0].as_py(), int(shard[a]), code[a:b].tobytes(), code[a:b][twice[a:b]].tobytes(), b"") for a, b in zip(cuts, cuts[1:])])

    def shared(key, table):
        """To each chunk: its anchors that stand in two documents, and those of them that are split."""
        rows = rows_of(table)
        code = np.sort(np.concatenate([_join([r[2] for r in rows], "<u4"), _join([r[3] for r in rows], "<u4")]))
        both, n = np.unique(code[1:][code[1:] == code[:-1]], return_counts=True)
        many = both[n + 1 >= hot]
        out = []
        for chunk, _, codes, _, _ in rows:
            mine = np.frombuffer(codes, "<u4")
            mine = mine[_in(both, mine)]
            if len(mine):
                out.append((chunk, key[0].as_py(), mine.tobytes(), mine[_in(many, mine)].tobytes(), b""))
        return table_of(out)

    def ids_of(texts: list[_Text], places: _Places, strings: int, string: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its id; of each distinct string the least id, and whether another document of the chunk has it."""
        first = np.array([t.first for t in texts], np.int64)
        last = np.array([NO_ID if t.more else t.first for t in texts], np.int64)
        low, high = np.full(strings, NO_ID), np.full(strings, -NO_ID)
        np.minimum.at(low, string, first[places.text])
        np.maximum.at(high, string, last[places.text])
        return first, low, high > low

    def hashes(key, left, right):
        """To each shard: anchor, hash, least id and whether there is another, of the chunk's distinct strings."""
        if not left.num_rows or not right.num_rows:
            return table_of([])
        texts = _texts(left, copies)
        s = _Places.of(unit, _Known(right, shards), (t.text for t in texts))
        one, begin, end, string = s.distinct()
        _, low, more = ids_of(texts, s, len(one), string)
        told = np.concatenate([low.view(np.uint8).reshape(-1, 8), more.astype(np.uint8)[:, None]], axis=1)
        rows = zip(s.shard[one[begin]].tolist(), begin.tolist(), end[1:].tolist())
        return table_of([(key[0].as_py(), k, s.code[one[a:b]].astype("<u4").tobytes(), s.hash[one[a:b]].tobytes(), told[a:b].tobytes()) for k, a, b in rows])

    def said_ids(rows) -> tuple[np.ndarray, np.ndarray]:
        told = _join([r[4] for r in rows], np.uint8).reshape(-1, 9)
        return told[:, :8].copy().view("<i8").ravel(), told[:, 8] > 0

    def settle(key, table):
        """To one chunk for each distinct string that isn't alone under its anchor or that two documents have: a wish for its symbols."""
        rows = rows_of(table)
        code, h = _join([r[2] for r in rows], "<u4"), _join([r[3] for r in rows], "<u8")
        low, more = said_ids(rows)
        row = np.repeat(np.arange(len(rows)), [len(r[3]) // 8 for r in rows])
        order = np.lexsort((row, h, code))
        code, h, row, low, more = code[order], h[order], row[order], low[order], more[order]
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (h[1:] != h[:-1])])
        first = np.flatnonzero(new)
        twice = np.logical_or.reduceat(more, first) | (np.minimum.reduceat(low, first) != np.maximum.reduceat(low, first))
        code, h, row = code[new], h[new], row[new]
        same = np.concatenate([[False], code[1:] == code[:-1]])
        ask = same | np.append(same[1:], False) | twice
        return table_of([(rows[r][0], -1 - key[0].as_py(), b"", b"", np.sort(x).tobytes()) for r, x in _by_shard(row[ask], h[ask])])

    def strings(key, left, right):
        """To each shard: the strings that it asked this chunk for, with their hashes."""
        if not left.num_rows or not right.num_rows:
            return table_of([])
        asked = {-1 - s: np.frombuffer(c, "<u8") for _, s, _, _, c in rows_of(right) if s < 0}
        if not asked:
            return table_of([])
        s = _Places.of(unit, _Known(right, shards), (t.text for t in _texts(left, copies)))
        one, begin, end, _ = s.distinct()
        of = {k: one[a:b] for k, a, b in zip(s.shard[one[begin]].tolist(), begin.tolist(), end[1:].tolist())}
        out = []
        for k, h in asked.items():
            at = np.sort(of[k][np.searchsorted(s.hash[of[k]], h)])
            x = s.strings(at, width)
            out.append((key[0].as_py(), k, b"".join(x), np.array([len(y) for y in x], "<u4").tobytes(), s.hash[at].tobytes()))
        return table_of(out)

    def marks(key, left, right):
        """To each chunk: a word of window marks for each of its distinct strings, in order, for their least ids; and for others where there are any."""
        rows = rows_of(left)
        h = _join([r[3] for r in rows], "<u8")
        ids, more = said_ids(rows)
        u, at = np.unique(h, return_inverse=True)
        least, most = np.full(len(u), NO_ID), np.full(len(u), -NO_ID)
        np.minimum.at(least, at, ids)
        np.maximum.at(most, at, np.where(more, NO_ID, ids))
        own, others = np.zeros(len(h), U), np.zeros(len(h), U)
        got = rows_of(right) if right is not None else []
        if got:
            size, mine = _join([r[3] for r in got], "<u4").astype(np.int64), _join([r[4] for r in got], "<u8")
            data = b"".join([r[2] for r in got])
            if unit.words:
                ends = np.cumsum(size).tolist()
                known: dict[bytes, int] = {}
                words = [data[a:b].split(b" ") for a, b in zip([0, *ends[:-1]], ends)]
                size = np.array([len(w) for w in words], np.int64)
                symbols = np.array([known.setdefault(w, len(known) + 1) for t in words for w in t], np.uint32)
                del words, known
            else:
                symbols = np.frombuffer(data, np.uint8).astype(np.uint16) + np.uint16(1)
            of = np.searchsorted(u, mine)  # the string of each row of symbols
            codes = np.empty(len(u), np.uint32)
            codes[at] = _join([r[2] for r in rows], "<u4")
            _, same, n = np.unique(codes[of], return_inverse=True, return_counts=True)
            packed = Strings(symbols, size, (most > least)[of], width, q, n[same] == 1)
            del data, symbols
            found = least_ids(packed, least[of], find)
            del packed
            count = size - width + 1
            first = np.cumsum(count) - count
            row = np.full(len(u), -1)
            row[of] = np.arange(len(of))
            here = np.flatnonzero(row[at] >= 0)
            r, limit = row[at[here]], ids[here]
            a, b = np.zeros(len(here), U), np.zeros(len(here), U)
            for j in range(int(count.max())):
                k = np.flatnonzero(count[r] > j)
                x = found[first[r[k]] + j]
                a[k] |= (x < limit[k]).astype(U) << U(j)
                b[k] |= ((x <= limit[k]) & (x < NO_ID)).astype(U) << U(j)
            own[here], others[here] = a, b
        cuts = np.cumsum([len(r[3]) // 8 for r in rows])[:-1]
        parts = zip(rows, np.split(own, cuts), np.split(others, cuts), np.split(more, cuts))
        return table_of([(r[0], -1 - key[0].as_py(), x[m].tobytes(), b"", o.tobytes()) for r, o, x, m in parts])

    def removed(key, left, right):
        """What is removed of each distinct text, for the least id that has it and for others."""
        texts = _texts(left, copies)
        s = _Places.of(unit, _Known(right, shards), (t.text for t in texts))
        one, begin, _, string = s.distinct()
        first, low, more = ids_of(texts, s, len(one), string)
        replies = {-1 - k: (a, c) for _, k, a, _, c in rows_of(right) if k < 0}
        shard_order = s.shard[one[begin]].tolist()
        own, others = _join([replies[k][1] for k in shard_order], "<u8"), np.zeros(len(one), U)
        others[more] = _join([replies[k][0] for k in shard_order], "<u8")
        all_windows = (U(1) << s.windows.astype(U)) - U(1)
        mine = np.where(low[string] < first[s.text], others[string], own[string]) & all_windows
        theirs = others[string] & all_windows
        out: dict = {c: [] for c in ("digest", "first", "n_symbols", *(f"{c}{k}" for k in (0, 1) for c in ("spans", "kept", "sha")))}
        for block, a, p, q in zip(s.blocks, s.texts.tolist(), s.places.tolist(), s.places[1:].tolist()):
            some = texts[a : a + len(block.begin) - 1]
            out["digest"] += [t.digest for t in some]
            out["first"] += [t.first for t in some]
            out["n_symbols"] += np.diff(block.begin).tolist()
            for which, mark in enumerate((mine[p:q], theirs[p:q])):
                of, start, end = _spans(s.text[p:q] - a, s.first[p:q], mark, width)
                spans = list(zip(start.tolist(), end.tolist()))
                cuts = np.searchsorted(of, np.arange(len(some) + 1)).tolist()
                for k, t in enumerate(some):
                    if which and not t.more:
                        for c in ("spans1", "kept1", "sha1"):
                            out[c].append(None)
                        continue
                    own, zero = spans[cuts[k] : cuts[k + 1]], int(block.begin[k])
                    kept = _kept(block, k, own)
                    out[f"spans{which}"].append([{"start": x - zero, "end": y - zero} for x, y in own])
                    out[f"kept{which}"].append(kept if with_text else None)
                    out[f"sha{which}"].append(hashlib.sha256(kept).hexdigest())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = {"digest": pa.binary(), "first": pa.int64(), "n_symbols": pa.int64()} | {f"{c}{k}": t for k in (0, 1) for c, t in (("spans", span), ("kept", pa.binary()), ("sha", pa.string()))}
        return pa.table(out, schema=pa.schema(list(kinds.items())))

    parts = F.coalesce("parts", F.lit(1).cast("bigint"))
    deal = F.pmod(F.xxhash64("name", F.pmod(F.xxhash64("digest"), parts)), F.lit(shards)).cast("int").alias("chunk")
    texts = rows.mapInArrow(sent, "name bigint, digest binary, doc_id bigint, text string").join(crowded, F.col("name") == F.col("crowd"), "left")
    by_chunk = texts.select(deal, "digest", "doc_id", "text").repartition("chunk").groupBy("chunk")
    known = by_chunk.applyInArrow(anchors, ddl).groupBy("shard").applyInArrow(shared, ddl)
    said = by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(hashes, ddl).groupBy("shard")
    asked = said.applyInArrow(settle, ddl)
    given = by_chunk.cogroup(known.unionByName(asked).groupBy("chunk")).applyInArrow(strings, ddl)
    marked = said.cogroup(given.groupBy("shard")).applyInArrow(marks, ddl)
    spans = "array<struct<start: bigint, end: bigint>>"
    out = "digest binary, first bigint, n_symbols bigint, " + ", ".join(f"spans{k} {spans}, kept{k} binary, sha{k} string" for k in (0, 1))
    told = stored(by_chunk.cogroup(known.unionByName(marked).groupBy("chunk")).applyInArrow(removed, out), "removed")
    back = join_back(prints.select("doc_id", "digest"), told, "digest", list(copies))
    pick = lambda c, name: F.when(F.col("doc_id") == F.col("first"), F.col(f"{c}0")).otherwise(F.col(f"{c}1")).alias(name)
    return back.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_symbols", pick("spans", "spans"), pick("kept", "kept"), pick("sha", "kept_sha256"))
