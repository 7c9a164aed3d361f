"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a seed lexicon, of a lexicon learned from the labelled sample and
of lexicon words found only after undoing obfuscation; how near such words stand to second-person words;
rates of capitals, exclamation marks, other punctuation, digits, obfuscated words and stretched letters;
and the length. The learned lexicon holds words and stems (first letters of words) that stand in toxic texts
far oftener than in others by a likelihood-ratio test; as a test of significance it means the same for every size of sample.
Trees are histogram trees on quantile bins, fitted here to the logistic loss. The margin is calibrated on
out-of-fold margins by pool-adjacent-violators and read by interpolation. For those margins both the trees and the
lexicon are learned without the fold.

The classifier is fitted on at most ``max_train`` labelled rows (a hash sample of ids); everything else
covers all rows. Labels, lang, source and doc_id are never inputs of a score.

Defined results. Null text: as empty, and scored. Null doc_id: scored, never learned from, not held out.
Repeated rows: a row each; of rows with one doc_id the least text is learned from, once. A doc_id with several labels
counts as toxic if any is. Null labels are ignored. Ties: a score of exactly 0.5 is predicted toxic; equally
good splits take the first feature and the lowest cut. No labels of either class: the prior rate (0 without
labels) is every score. Very long texts: read whole, piece by piece. Empty table: empty result. Other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, ship, shuffle_partitions, slices, stored

MAX_TRAIN = 20_000
FOLDS = 3
#: Letters of a stem; the lexicon's size; the least likelihood ratio (one word in some millions passes by chance) and how much oftener in toxic texts.
STEMS = range(4, 9)
LEXICON, SIGNIFICANT, OFTENER = 300, 24.0, 10.0
#: Words that a task holds at a time.
HELD = 50_000
# Insults and threats of general English, the seed lexicon.
SEED_WORDS = (
    "bastard bitch clown coward creep cretin crap damn degenerate disgusting dumb dumbass dunce filth filthy fool fraud freak garbage gross "
    "hate idiot idiotic idiots ignorant imbecile jerk kill liar loser losers lunatic maggot moron moronic morons nasty nazi parasite pathetic "
    "pig psycho rat retard rubbish scum scumbag shame shut sick slut stupid stupidity suck sucks swine traitor trash trashy ugly useless vermin "
    "vile whore worthless wretched"
).split()
# Second-person words of the languages of the corpus.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
LEET = str.maketrans("01345$@!|7+8", "oieassaiittb")
WORDS = re.compile(r"[^\W\d_]+")
#: Where letters go on after marks or digits within a run without blanks.
MIXED = re.compile(r"[0-9@$!|+*.\-_](?<=[^\W\d_].)[0-9@$!|+*.\-_]*[^\W\d_]")
LEFT, RIGHT = re.compile(r"[^\W_]*\Z"), re.compile(r"\s|\Z")
STRETCH = re.compile(r"([^\W\d_])\1\1")
BLANK = re.compile(r"\s")
#: Characters read at a time.
PIECE = 1 << 18
PUNCT = np.array([c in b"\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in range(256)])
NAMES = ("seed", "learned", "hidden", "hits", "near", "nearest", "second", "capitals", "exclaim", "punct", "digits", "obfuscated", "stretched", "log_words")


class Lexicon(dict):
    """What a word is: 0, 1 (of the seed), 2 (learned: the word or one of its stems) or 3 (second person). Remembers words that it met."""

    def __init__(self, learned: frozenset):
        super().__init__()
        self.learned, self.seed = learned, frozenset(SEED_WORDS)
        self.sizes = sorted({len(w) for w in learned})

    def __missing__(self, word: str) -> int:
        if len(self) > HELD:
            self.clear()
        kind = 1 if word in self.seed else 3 if word in SECOND else 2 if any(word[:n] in self.learned for n in self.sizes) else 0
        self[word] = kind
        return kind

    def insult(self, word: str) -> bool:
        return self[word] in (1, 2)


def pieces(text: str, size: int = PIECE):
    """A text in pieces of about ``size`` characters, cut at blanks (within a run of that many characters without one, anywhere)."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            blank = BLANK.search(text, end, end + size)
            end = blank.start() if blank else end + size
        yield text[at:end]
        at = end


def obfuscated(low: str):
    """The runs without blanks, from a word on, in which letters, marks and letters follow each other."""
    at = 0
    while m := MIXED.search(low, at):
        end = RIGHT.search(low, m.end()).start()
        yield LEFT.search(low, max(at, m.start() - 40), m.start())[0] + low[m.start() : end]
        at = end


def stretches(low: str) -> int:
    """How many letters stand three times and more in a row."""
    x = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    same = x[1:] == x[:-1]
    return len(STRETCH.findall(low)) if (same[1:] & same[:-1]).any() else 0


def features(text: str, *lexicons: Lexicon) -> list[list[float]]:
    """The dense features of one whole text under each lexicon, in the order of NAMES. Memory is bounded by a piece, not by the text."""
    n = mixed = stretched = second = 0
    raw = np.zeros(256, np.int64)
    counts = [[0, 0, 0, 0, 10] for _ in lexicons]  # seed, learned, hidden, near, nearest
    kept: list[list[int]] = [[] for _ in lexicons]  # kinds of words whose surroundings aren't whole yet, after some that are
    told = 0  # how many of those have been looked at
    parts = [text] if len(text) <= PIECE else pieces(text)
    for piece in [*parts, ""]:
        low = piece.lower()
        words = WORDS.findall(low)
        n += len(words)
        stretched += stretches(low)
        raw += np.bincount(np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        odd = [(WORDS.findall(re.sub(r"[*.\-_]", "", m.translate(LEET))), WORDS.findall(m)) for m in obfuscated(low)]
        mixed += len(odd)
        for lexicon, count, k in zip(lexicons, counts, range(len(lexicons))):
            count[2] += sum(any(map(lexicon.insult, plain)) and not any(map(lexicon.insult, seen)) for plain, seen in odd)
            kinds = kept[k] + list(map(lexicon.__getitem__, words))
            end = max(told, len(kinds) - 6) if piece else len(kinds)
            if 1 in kinds or 2 in kinds:
                for i, kind in enumerate(kinds[told:end], told):
                    if kind == 1 or kind == 2:
                        count[kind - 1] += 1
                        gap = next((d for d in range(1, 7) if (i >= d and kinds[i - d] == 3) or (i + d < len(kinds) and kinds[i + d] == 3)), 10)
                        count[3] += gap <= 6
                        count[4] = min(count[4], gap)
            if k == 0:
                second += kinds[told:end].count(3)
            drop = max(0, end - 6)
            kept[k] = kinds[drop:]
        told = end - drop
    size, words = max(1, int(raw.sum())), max(1, n)
    rates = [raw[65:91].sum() / size, raw[33] / size, raw[PUNCT].sum() / size, raw[48:58].sum() / size, mixed / words, stretched / words, float(np.log1p(n))]
    return [
        [s / words, learned / words, hidden / words, float(min(s + learned + hidden, 20)), near / words, float(nearest), second / words if s + learned else 0.0, *rates]
        for s, learned, hidden, near, nearest in counts
    ]


@dataclass
class Booster:
    """Histogram gradient boosting for the logistic loss."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    penalty: float = 1.0
    least: float = 5.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        p = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.base = float(np.log(p / (1 - p)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        margin = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-margin))
            g, h = q - y, q * (1 - q)
            tree = self._grow(b, g, h)
            self.trees.append(tree)
            margin += self._leaf(tree, b)
        return self

    def _grow(self, b, g, h):
        size = 1 << self.depth
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(2 * size)
        node = np.ones(len(g), np.int64)
        for level in range(self.depth + 1):
            for k in range(1 << level, 2 << level):
                rows = np.flatnonzero(node == k)
                gs, hs = g[rows].sum(), h[rows].sum()
                value[k] = -self.rate * gs / (hs + self.penalty)
                if level == self.depth or len(rows) < 2 * self.least:
                    continue
                best = 1e-6
                for f in range(b.shape[1]):
                    c = b[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(c, w, self.bins + 1))[:-1] for w in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty)
                    gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
                    if gain.max() > best:
                        best, feature[k], cut[k] = gain.max(), f, int(gain.argmax())
                if feature[k] >= 0:
                    node[rows] = 2 * k + (b[rows, feature[k]] > cut[k])
        return feature, cut, value

    def _leaf(self, tree, b):
        feature, cut, value = tree
        node = np.ones(len(b), np.int64)
        for _ in range(self.depth):
            f = feature[np.minimum(node, len(feature) - 1)]
            go = (f >= 0) & (node < len(feature))
            right = b[np.arange(len(b)), np.maximum(f, 0)] > cut[np.minimum(node, len(cut) - 1)]
            node = np.where(go, 2 * node + right, node)
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        return self.base + sum(self._leaf(t, b) for t in self.trees)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the blocks' mean margins and their values, both ascending."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, mean margin, value
    ux, at = np.unique(x[order], return_index=True)
    for m, part in zip(ux, np.split(y[order], at[1:])):
        blocks.append([len(part), m, part.mean()])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            w, mx, v = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [p[0] + w, (p[0] * p[1] + w * mx) / (p[0] + w), (p[0] * p[2] + w * v) / (p[0] + w)]
    return np.array([b[1] for b in blocks]), np.array([b[2] for b in blocks])


@dataclass
class Model:
    learned: frozenset
    booster: Booster | None
    calibration: tuple[np.ndarray, np.ndarray] | None
    prior: float = 0.0

    def score(self, texts: list[str], lexicon: Lexicon | None = None) -> np.ndarray:
        if self.booster is None:
            return np.full(len(texts), self.prior)
        lexicon = lexicon or Lexicon(self.learned)
        x = np.array([features(t, lexicon)[0] for t in texts], float).reshape(-1, len(NAMES))
        return np.clip(np.interp(self.booster.margin(x), *self.calibration), 0, 1)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fold_of(doc_id: int) -> int:
    return (doc_id * 2654435761 >> 7) % FOLDS

def counted(batches):
    """For each word and stem, by fold: toxic texts, other texts, and marks of the words before it in toxic texts. Sums of parts, ``HELD`` words at a time."""
    found: dict[str, list[int]] = {}

    def flush():
        columns = list(zip(*found.values())) or [()] * 3 * FOLDS
        out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], ["w", *COUNTS])
        found.clear()
        return out

    for b in slices(batches, 50):
        for doc, y, text in zip(*[b.column(c).to_pylist() for c in ("doc_id", "y", "text")]):
            last = ""
            before: dict[str, str] = {}
            for piece in pieces(text):
                for w in WORDS.findall(piece.lower()):
                    if len(w) > 2:
                        before[w] = last
                    last = w
            once = {stem: c for w, c in before.items() for stem in {w, *(w[:k] for k in STEMS if k < len(w))}}
            at = fold_of(doc)
            for w, c in once.items():
                row = found.setdefault(w, [0] * 3 * FOLDS)
                if y:
                    row[at] += 1
                    row[2 * FOLDS + at] |= 1 << zlib.crc32(c.encode("utf-8", "surrogatepass")) % 63
                else:
                    row[FOLDS + at] += 1
        if len(found) > HELD:
            yield flush()
    yield flush()


COUNTS = [f"{c}{k}" for c in "tfm" for k in range(FOLDS)]


def lexicons(rows: DataFrame, size: list[tuple[int, int]]) -> list[frozenset]:
    """The words learned without each fold, and with all. ``rows``: doc_id, y, text; ``size``: toxic and other texts of each fold.

    A word counts as often as it follows different words (copies of one text don't count), up to all its toxic texts.
    """
    sums = [F.sum(c).alias(c) if c[0] != "m" else F.bit_or(c).alias(c) for c in COUNTS]
    stats = stored(rows.mapInArrow(counted, "w string, " + ", ".join(f"{c} bigint" for c in COUNTS)).groupBy("w").agg(*sums).where(" + ".join(f"t{k}" for k in range(FOLDS)) + " > 1"), "lexicon")
    out = []
    for left in [*range(FOLDS), None]:
        use = [k for k in range(FOLDS) if k != left]
        toxic, other = (sum(size[k][i] for k in use) for i in (0, 1))
        if not toxic or not other:
            out.append(frozenset())
            continue
        t, f = (sum((F.col(f"{c}{k}") for k in use), F.lit(0)).cast("double") for c in "tf")
        marks = F.col(f"m{use[0]}")
        for k in use[1:]:
            marks = marks.bitwiseOR(F.col(f"m{k}"))
        t = F.least(t, F.when(F.bit_count(marks) >= 40, t).otherwise(F.bit_count(marks)).cast("double"))
        share = F.lit(toxic / (toxic + other))
        both, least = F.greatest(t + f, F.lit(1e-9)), F.lit(1e-9)
        likely = 2 * (t * F.log(F.greatest(t, least) / (both * share)) + f * F.log(F.greatest(f, least) / (both * (1 - share))))
        oftener = (t + 0.5) / toxic / ((f + 0.5) / other)
        best = stats.select("w", likely.alias("g"), oftener.alias("r")).where((F.col("g") >= SIGNIFICANT) & (F.col("r") >= OFTENER))
        out.append(frozenset(r.w for r in best.orderBy(F.desc("g"), "w").limit(LEXICON).collect()))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most ``max_train`` labelled rows whose ids are not held out; no more are ever collected."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    labels = labels.groupBy(F.col("doc_id").cast("bigint").alias("l_id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    labels = labels.orderBy(F.xxhash64("l_id"), "l_id").limit(max_train)  # bounded by the parameter, so it may be broadcast
    some = id_and_text(docs).join(F.broadcast(labels), F.col("doc_id") == F.col("l_id"))
    rows = stored(some.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")).repartition(max(8, shuffle_partitions(docs.sparkSession))), "labelled")
    size = [(0, 0)] * FOLDS
    for r in rows.select("doc_id", "y").collect():
        t, f = size[fold_of(r.doc_id)]
        size[fold_of(r.doc_id)] = (t + r.y, f + 1 - r.y)
    toxic, total = sum(t for t, _ in size), sum(t + f for t, f in size)
    if not 0 < toxic < total:
        toxic, total = labels.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
        return Model(frozenset(), None, None, 0.0 if not total else toxic / total)
    learned = lexicons(rows, size)

    def dense(batches):
        """Features under the lexicon without each fold, and under that of all."""
        words = [Lexicon(w) for w in learned]
        for b in slices(batches):
            x = [features(t, *words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, pa.list_(pa.list_(pa.float64())))], ["doc_id", "y", "x"])

    got = sorted((r.doc_id, r.y, r.x) for r in rows.mapInArrow(dense, "doc_id bigint, y int, x array<array<double>>").collect())
    y, x = np.array([g[1] for g in got], float), np.array([g[2] for g in got], float)
    fold = np.array([fold_of(g[0]) for g in got])
    out = np.zeros(len(y))
    for k in range(FOLDS):
        part = fold == k
        if part.any() and not part.all():
            out[part] = Booster().fit(x[~part, k], y[~part]).margin(x[part, k])
    return Model(learned[FOLDS], Booster().fit(x[:, FOLDS], y), isotonic(out, y))


def toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted; columns of those names are replaced."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts):
        lexicon = Lexicon(held.value.learned)
        parts = [held.value.score(texts.slice(at, 200).to_pylist(), lexicon) for at in range(0, len(texts), 200)]
        return pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    docs = docs.drop("score", "predicted")
    scored = docs.withColumn("score", score(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are predicted toxic go."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model).where("predicted = 0").select(*docs.columns)
