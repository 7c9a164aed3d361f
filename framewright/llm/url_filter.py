"""URL filters: allow and block rules; otherwise segmented host words scored by naive Bayes.

Host labels are split at marks, and names that run words together are segmented by a unigram Viterbi
search. Its counts are those of all words of all pages, of which the ``max_words`` most frequent are kept; the words of the labelled names are known
besides. Path tokens are segmented alike. A multinomial naive Bayes model scores the words; a positive log-odds blocks. No table has
labels of urls, so it is trained on the names below: ``UNWANTED`` and ``ORDINARY``, 24 and 22 of them, and ``prior`` is a parameter.

Defined results. A null url or one without ``://``: empty host and path, no rule, and the score of no words
(the prior: allowed). Repeated rows: a row each. Ties: of rules of one length the one that stands last in ``rules``, of splits the one whose
last word is shortest, and a log-odds of zero allows. Very long urls: whole (Viterbi looks back at most the length of the
longest word). No pages: the labelled names and ``COMMON`` alone. Empty table: empty result. Columns named like the results are replaced, all others pass through.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, unused

# The rules, as (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# Names of unwanted and of ordinary sites, the training rows.
UNWANTED = (
    "spam farm|cheap pills|casino win|free bets|ads track|adult x|online casino bonus|buy cheap pills|win free cash|sports bets odds|poker jackpot|viagra discount|xxx adult video|"
    "hot sex cam|porn tube|payday loan fast|lottery win prize|click ads popup|track pixel banner|replica watches sale|weight loss pills|gambling slots|free spins bonus|crypto double money"
).split("|")
ORDINARY = (
    "news blog|www docs|wiki science|city library|health research|school history|music review|open source code|travel guide|weather report|public data|art museum|help forum|mobile app|m news|"
    "local sports news|book store|family recipe|online learning|university press|free software|garden shop"
).split("|")
# Further frequent English words, most frequent first, for the segmentation alone.
COMMON = (
    "the of and to in for is on that by this with you it not or be are from at as your all have new more an was we will home can us about if page my has search but our one other do no information time they "
    "site he up may what which their out use any there see only so his when contact here business who web also now get view first been would how were services some these its like service than"
).split()


MAX_WORDS = 20_000


RESULTS = ("host", "path", "rule", "verdict", "words", "score")


@dataclass
class Words:
    """Unigram log-probabilities by counts; an unknown piece of n letters costs as ten to the power -n."""

    counts: dict[str, float]
    cost: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        total = sum(self.counts.values())
        self.cost = {w: math.log(n / total) for w, n in self.counts.items()}
        self.longest = max(map(len, self.counts), default=1)

    def segment(self, name: str) -> list[str]:
        """Viterbi over two states: after a known word, and within a run of unknown letters, which is one piece."""
        letter, none = math.log(0.1), (-math.inf, 0, False)
        known, unknown = [(0.0, 0, False)], [none]  # score, where the piece starts, whether the one before is unknown
        for i in range(1, len(name) + 1):
            begun, going = known[i - 1][0] + letter - 2.0, unknown[i - 1][0] + letter
            unknown.append((going, unknown[i - 1][1], False) if going >= begun else (begun, i - 1, False))
            top = none
            for j in range(max(0, i - self.longest), i):
                cost = self.cost.get(name[j:i])
                if cost is not None:
                    after = unknown[j][0] > known[j][0]
                    score = (unknown if after else known)[j][0] + cost
                    if score >= top[0]:
                        top = score, j, after
            known.append(top)
        out, i = [], len(name)
        run = unknown[i][0] > known[i][0]
        while i:
            _, j, after = (unknown if run else known)[i]
            out.append(name[j:i])
            i, run = j, after
        return out[::-1]


@dataclass
class Bayes:
    """Multinomial naive Bayes with add-one smoothing; words that no class knows say nothing."""

    block: list[str]
    allow: list[str]
    prior: float = 0.3

    def __post_init__(self):
        rows = {k: [w for name in names for w in name.split()] for k, names in (("block", self.block), ("allow", self.allow))}
        words = set(rows["block"]) | set(rows["allow"])
        of = lambda k, w: (rows[k].count(w) + 1) / (len(rows[k]) + len(words))
        self.odds = {w: math.log(of("block", w) / of("allow", w)) for w in words}
        self.base = math.log(self.prior / (1 - self.prior))

    def score(self, words: list[str]) -> float:
        return self.base + sum(self.odds.get(w, 0.0) for w in words)


@dataclass
class Model:
    words: Words
    bayes: Bayes

    def __post_init__(self):
        self.split = functools.lru_cache(1 << 16)(self.words.segment)

    def __reduce__(self):
        return Model, (self.words, self.bayes)

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the labels and the path; a top-level domain says nothing and is left out."""
        labels = host.split(":")[0].split(".")
        names = re.findall(r"[a-z]+", " ".join(labels[:-1] if len(labels) > 1 else labels)) + re.findall(r"[a-z]+", path.lower())
        return [w for n in names for w in self.split(n)]


def word_counts(pages: DataFrame, max_words: int = MAX_WORDS, html_col: str = "html") -> dict[str, float]:
    """How often the most frequent words of all pages stand there: runs of 2 to 20 letters a-z outside of tags."""
    plain = F.regexp_replace(F.lower(pages[html_col].cast("string")), "<[^<>]*>", " ")
    words = pages.select(F.explode(F.split(plain, "[^a-z]+")).alias("w")).where(F.length("w").between(2, 20))
    # Written first: the most frequent of all are then settled on an executor, and no more than they come to the driver.
    top = stored(words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(max_words), "words")
    return {r.w: float(r["count"]) for r in top.collect()}


def fit(counts: dict[str, float] | None = None, block: list[str] = UNWANTED, allow: list[str] = ORDINARY, common: list[str] = COMMON, prior: float = 0.3) -> Model:
    """Train on labelled names, words parted by spaces, and on the counts of a corpus.

    The names' words and the ``common`` ones count as one in ten thousand at least, since a name that was labelled is a word.
    """
    counts = dict(counts or {})
    least = max(1.0, sum(counts.values()) / 10_000)
    for w in (*common, *(w for name in (*block, *allow) for w in name.split())):
        counts[w] = max(counts.get(w, 0.0), least)
    return Model(Words(counts), Bayes(list(block), list(allow), prior))


def parts(url):
    """(host, path) columns."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def url_filter(pages: DataFrame, model: Model | None = None, rules=RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, words, score and verdict."""
    ship(pages.sparkSession)
    pages = pages.drop(*[c for c in RESULTS if c != url_col])
    held = pages.sparkSession.sparkContext.broadcast(model or fit())

    @F.arrow_udf("words array<string>, score double")
    def judged(hosts, paths):
        m = held.value
        words = [m.tokens(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
        return pa.StructArray.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array([m.bayes.score(w) for w in words], pa.float64())], ["words", "score"])

    host, path = parts(pages[url_col])
    kept = [c for c in pages.columns if c not in RESULTS or c == url_col]
    told = unused(pages.columns, "judged")
    out = pages.withColumn("host", host).withColumn("path", path) if url_col not in ("host", "path") else pages.withColumn(told, pages[url_col]).withColumns(dict(zip(("host", "path"), parts(F.col(told)))))
    out = out.withColumn(told, judged("host", "path"))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col(told)["score"] > 0, "block").otherwise("allow")
    for say, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first, so it is put last
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, say).otherwise(verdict)
    results = [F.col("host"), F.col("path"), rule.alias("rule"), verdict.alias("verdict"), F.col(told)["words"].alias("words"), F.col(told)["score"].alias("score")]
    return out.select(*(F.col(f"`{c}`") for c in kept if c not in RESULTS), *results)


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    model = fit(word_counts(pages))
    return url_filter(pages.select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict", "words", F.round("score", 6).alias("score"))
