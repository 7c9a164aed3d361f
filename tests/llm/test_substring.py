"""Both substring dedups against brute force."""

import hashlib
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import repeats, suffix_array, suffix_tree
from framewright.llm.repeats import NO_ID, Groups, Strings, Unit, dedup, least_ids

from . import cases


def brute(rows, words, width):
    least, split = {}, []
    for i, t in rows:
        raw = (t or "").encode()
        s = raw.split() if words else [raw[k : k + 1] for k in range(len(raw))]
        i = NO_ID if i is None else i
        split.append((i, s))
        for k in range(len(s) - width + 1):
            w = tuple(s[k : k + width])
            least[w] = min(least.get(w, NO_ID), i)
    out = []
    for (real, _), (i, s) in zip(rows, split):
        gone = [False] * len(s)
        for k in range(len(s) - width + 1):
            if least[tuple(s[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = (b" " if words else b"").join(x for x, g in zip(s, gone) if not g)
        spans = sum(g and not b for g, b in zip(gone, [False, *gone]))
        out.append((real, len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def told(df):
    for r in df.collect():
        yield r.doc_id, r.n_symbols, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256


@pytest.mark.parametrize("hot", [64, 2])
@pytest.mark.parametrize("words", [False, True])
def test_awkward_rows(spark, words, hot):
    find = (suffix_tree if words else suffix_array).maximal_repeats
    unit = Unit(words, 50, 16 if words else 24)
    df = dedup(cases.table(spark), unit, find, 2 if words else 4, hot=hot)
    data = [r[:2] for r in cases.rows()]
    assert cases.want(told(df)) == cases.want(brute(data, words, 50))
    for r in df.collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("query,words", [(suffix_array.op2_suffix_array_dedup, False), (suffix_tree.op4_suffix_tree_dedup, True)])
def test_query(spark, sf, query, words):
    data = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = [r[:3] + r[4:] if words else r for r in brute(data, words, 50)]
    assert cases.want(map(tuple, query(spark, sf).collect())) == cases.want(expected)


@pytest.mark.parametrize("module,words", [(suffix_array, False), (suffix_tree, True)])
def test_sql_says_the_same(sf, module, words):
    data = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert cases.want(con.sql(module.ORACLE).fetchall()) == cases.want([r[:3] + r[4:] if words else r for r in brute(data, words, 50)])


@pytest.mark.parametrize("words", [False, True])
def test_empty(spark, words):
    assert (suffix_tree.window_dedup if words else suffix_array.substring_dedup)(cases.empty(spark)).collect() == []


def few(memory):
    return lambda strings: suffix_tree.maximal_repeats(strings, memory)


METHODS = (suffix_array.maximal_repeats, suffix_tree.maximal_repeats, few(2), few(5))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 2), min_size=4, max_size=25), min_size=1, max_size=8, unique_by=tuple), st.sampled_from([4, 6]), st.sampled_from([2, 4]), st.data())
def test_least_ids(strings, width, q, data):
    """The least id of the strings that have a window; none if it stands once, in a string of one document."""
    ids = np.array([data.draw(st.integers(0, 9)) for _ in strings])
    twice = np.array([data.draw(st.booleans()) for _ in strings])
    best: dict = {}
    count: dict = {}
    for s, i, t in zip(strings, ids, twice):
        for k in range(len(s) - width + 1):
            w = tuple(s[k : k + width])
            best[w] = min(best.get(w, NO_ID), i)
            count[w] = count.get(w, 0) + 1 + t
    windows = [tuple(s[k : k + width]) for s in strings for k in range(len(s) - width + 1)]
    flat, size = np.array([x for s in strings for x in s], np.uint64), np.array([len(s) for s in strings])
    for find in METHODS:
        assert least_ids(Strings(flat, size, twice, width, q), ids, find).tolist() == [best[w] if count[w] > 1 else NO_ID for w in windows]


def test_groups_hold_all_occurrences():
    texts = [b"xxabcdefyy", b"zzabcdefqq", b"abcdefyy", b"twiceas"]
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    strings = Strings(flat, np.array([len(t) for t in texts]), np.array([False, False, False, True]), 5, 4)
    for find in METHODS:
        found = set()
        for s, g in find(strings):
            found |= {(texts[s.string[lo]][s.offset[lo] : s.offset[lo] + n], tuple(sorted(zip(s.string[lo:hi].tolist(), s.offset[lo:hi].tolist())))) for lo, hi, n in zip(g.lo, g.hi, g.length)}
        assert found == {(b"abcdef", ((0, 2), (1, 2), (2, 0))), (b"abcdefyy", ((0, 2), (2, 0))), (b"twiceas", ((3, 0),))}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=5, max_size=40), min_size=1, max_size=10), st.integers(1, 30))
def test_prefix_groups_fit(strings, memory):
    """Every suffix is in one group; a group over the bound is one repeat of ``width`` symbols, and suffixes of one prefix stay together."""
    width = 5
    flat, size = np.array([x for s in strings for x in s], np.uint64), np.array([len(s) for s in strings])
    seen, group_of = [], {}
    for k, (string, offset, depth) in enumerate(suffix_tree.partitions(Strings(flat, size, np.zeros(len(size), bool), width, 2), memory)):
        prefixes = {tuple(strings[s][o : o + depth]) for s, o in zip(string.tolist(), offset.tolist())}
        assert len(prefixes) == 1 and (len(string) <= memory or depth == width)
        seen += zip(string.tolist(), offset.tolist())
        for s, o in zip(string.tolist(), offset.tolist()):
            assert group_of.setdefault(tuple(strings[s][o : o + width]), k) == k
    assert sorted(seen) == [(i, o) for i, s in enumerate(strings) for o in range(len(s) - width + 1)]


@pytest.mark.parametrize("words", [False, True])
def test_without_groups_nothing_is_removed(spark, sf, words):
    """All removals come from the suffix structures."""

    def none(strings):
        yield strings.sort(*strings.suffixes()), Groups(*[np.zeros(0, np.int64)] * 3)

    unit = Unit(words, 50, 16 if words else 24)
    assert all(not r.spans for r in dedup(spark.read.parquet(f"{sf}/documents.parquet"), unit, none, 2 if words else 4).collect())
    assert all(not r.spans for r in dedup(cases.table(spark), unit, none, 2 if words else 4, hot=2).collect())


@pytest.mark.parametrize("words", [False, True])
def test_hot_copies_and_a_crowded_name(spark, words):
    """A third of the rows are one text, another third near copies of one, over several chunks."""
    base = cases.passage(5, 400).split()
    rows = [(k, cases.passage(9, 80)) for k in range(40, 80)] + [(None, cases.passage(9, 80))] * 2
    for k in range(40):
        rows.append((100 + k if k else 3, " ".join([*base[: 150 + k], f"own{k}", *base[150 + k :]])))
    rows += [(300 + k, cases.passage(300 + k, 90)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    out = (suffix_tree.window_dedup if words else suffix_array.substring_dedup)(df, chunk_bytes=20_000)
    assert cases.want(told(out)) == cases.want(brute(rows, words, 50))


def replies(anchors):
    """What the shard of anchors tells a chunk: all of them stand in two documents."""
    return pa.table({"shard": [0], "a": [(anchors & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()], "b": [b""]})


@pytest.mark.parametrize("words", [False, True])
def test_short_texts_are_hashed_together(monkeypatch, words):
    """Array operations on each text alone cost a chunk of short texts more than its bytes do."""
    calls, hashes = [], Unit.hashes
    monkeypatch.setattr(Unit, "hashes", lambda *a: calls.append(1) or hashes(*a))
    known = repeats._Known(replies(np.arange(10, dtype=np.uint64)), 1)
    repeats._Places.of(Unit(words, 50, 16 if words else 24), known, [cases.passage(k, 80) for k in range(300)])
    assert 0 < len(calls) <= 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \xe9", max_size=40), max_size=12), st.booleans(), st.sampled_from([3, 30, 1 << 16]), st.sampled_from([5, 1 << 19]), st.integers(0, 2**32))
def test_blocks_change_no_window(texts, words, block, piece, seed):
    """Texts handled together have the windows, anchors, strings, spans and rests that each has alone."""
    unit = Unit(words, 3, 2) if words else Unit(words, 12, 8)
    split = [t.encode().split() if words else [bytes([x]) for x in t.encode()] for t in texts]
    glue = b" " if words else b""
    alone = {}
    for k, t in enumerate(texts):
        for _, first, size, anchor in unit.runs(unit.block([t])):
            alone |= {(k, f + j): a for f, m, a in zip(first.tolist(), size.tolist(), anchor.tolist()) for j in range(m)}
    assert alone.keys() == {(k, f) for k, s in enumerate(split) for f in range(len(s) - unit.width + 1)}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(repeats, "BLOCK", block)
        patch.setattr(repeats, "PIECE", piece)
        known = repeats._Known(replies(np.array(list(alone.values()), np.uint64)), 1)
        s = repeats._Places.of(unit, known, texts)
        r = np.random.default_rng(seed)
        marks = r.integers(0, 1 << 62, len(s.text), dtype=np.uint64) & ((np.uint64(1) << s.windows.astype(np.uint64)) - np.uint64(1))
        assert s.texts[-1] == len(texts) and s.places[-1] == len(s.text)
        seen = set()
        for b, a, p, q in zip(s.blocks, s.texts.tolist(), s.places.tolist(), s.places[1:].tolist()):
            of, start, end = repeats._spans(s.text[p:q] - a, s.first[p:q], marks[p:q], unit.width)
            for k in range(len(b.begin) - 1):
                zero, own = int(b.begin[k]), split[a + k]
                gone = [False] * len(own)
                for i in range(p, q):
                    if s.text[i] == a + k:
                        f, m = int(s.first[i]) - zero, int(s.windows[i])
                        assert int(s.code[i]) == alone[a + k, f] & 0xFFFFFFFF and s.strings(np.array([i]), unit.width) == [glue.join(own[f : f + m + unit.width - 1])]
                        for j in range(m):
                            assert (a + k, f + j) not in seen
                            seen.add((a + k, f + j))
                            if int(marks[i]) >> j & 1:
                                gone[f + j : f + j + unit.width] = [True] * unit.width
                spans = [(int(x), int(y)) for o, x, y in zip(of, start, end) if o == k]
                assert [g for g, before in zip(gone, [False, *gone]) if g and not before] == [True] * len(spans) and {x - zero for c, d in spans for x in range(c, d)} == {x for x, g in enumerate(gone) if g}
                assert b.text(k) == glue.join(own) and repeats._kept(b, k, spans) == glue.join(x for x, g in zip(own, gone) if not g)
        assert seen == set(alone)


@pytest.mark.parametrize("kind,q", [(np.uint16, 4), (np.uint32, 2)])
def test_a_shard_holds_its_symbols_narrow(kind, q):
    """What is held beside a word for each symbol, and what filling it takes, is less than another word."""
    size = np.full(20_000, 60)
    symbols = np.random.default_rng(1).integers(1, 257, size.sum()).astype(kind)
    tracemalloc.start()
    strings = Strings(symbols, size, np.zeros(len(size), bool), 50, q)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 * len(strings.packed)
    at = int(strings.base[7])
    assert strings.flat[at : at + 60].tolist() == symbols[420:480].tolist() and not strings.flat[at + 60 : at + 60 + q].any()
    assert int(strings.packed[at]) == sum(int(x) << 64 - 64 // q * (j + 1) for j, x in enumerate(symbols[420 : 420 + q]))
