"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are lexicon densities, closeness of lexicon words to second-person words, rates of
capitals, of punctuation and of obfuscated words. Besides a short fixed word list, the lexicon holds words
and word beginnings learned from labelled rows. All learn from a bounded, hashed sample of the labelled
rows, cross-fitted (see fit); scoring is one pass over whole texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.llm.common import arrow_map, remainder, stored, table, utf8_rows

#: The bound of the labelled sample that the classifier is fitted on, and of the learned lexicon.
SAMPLE, LEXICON = 40_000, 20_000
THRESHOLD = 0.3
#: Hash values that the sample is a share of; many, so that the share of any number of labels is not rounded to nothing.
SHARES = 1 << 62
#: Insults, and second-person words of English, French, German and Spanish.
SEEDS = frozenset(
    "asshole bastard bitch bullshit clown coward creep crap cretin cunt damn degenerate disgrace disgusting dumb dumbass filth filthy fool freak fuck fucking garbage "
    "hate hideous idiot idiotic ignorant imbecile jerk kill liar loser lunatic maggot moron moronic parasite pathetic pig psycho rat retard ridiculous rotten scum "
    "scumbag shit shut sick slut stupid sucker swine trash ugly useless vermin vile weak whore worthless wretched "
    "arschloch blöd dreck dumm hurensohn idiota idiote imbécile connard crétin débile estúpido imbécil mierda nul pendejo schlampe tonto trottel verdammt".split()
)
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer ti tú usted ustedes vosotros vuestro".split())
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$!*#%]+[^\W\d_]+[\w@$!*]*")
_SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_* ]){3,}[^\W\d_](?!\w)")
_PLAIN = str.maketrans("013457@$!*#%", "oieastasi   ")
_UPPER, _PUNCTUATION = bytes(range(65, 91)), b"!?.,;:'\"()[]{}<>#*$%&|@~^_=+-/\\"
_SYMBOLS = b"#*$%&|<>@~^_="
_NEAR = 5
_PREFIXES = (5, 6, 7)
FEATURES = ("seeds", "grade1", "grade2", "grade3", "n_grade2", "n_grade3", "near", "capitals", "upper_words", "exclaim", "punctuation", "symbols", "mixed", "spelled", "hidden", "length", "distinct", "digits")


def units(word: str) -> list[str]:
    """A word and its beginnings, as the lexicon has them."""
    return [word, *(f"{word[:k]}*" for k in _PREFIXES if len(word) > k)]


class Features:
    """Turns texts into rows of FEATURES; remembers the grades of a bounded number of words."""

    def __init__(self, lexicon: dict[str, float], most: int = 1 << 19):
        self.lexicon, self.most, self.known = lexicon, most, {}

    def _grade(self, word: str) -> int:
        """0 to 3 by learned log odds; 4 for a fixed insult."""
        if word in SEEDS:
            return 4
        odds = max(self.lexicon.get(u, 0.0) for u in units(word))
        return int(odds > 0.7) + int(odds > 1.4) + int(odds > 2.5)

    def row(self, text: str) -> list[float]:
        data, low = text.encode(), text.lower()
        words = _WORD.findall(low)
        try:
            grades = list(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > self.most:
                self.known.clear()
            for w in words:
                if w not in self.known:
                    self.known[w] = self._grade(w)
            grades = list(map(self.known.__getitem__, words))
        n, size = max(1, len(words)), max(1, len(data))
        counts = [grades.count(g) for g in range(5)]
        near = 0.0
        if counts[3] + counts[4]:
            hits = np.flatnonzero(np.array(grades) >= 3)
            second = np.array([k for k, w in enumerate(words) if w in SECOND])
            if len(second):
                k = np.searchsorted(second, hits)
                gap = np.minimum(np.abs(hits - second[np.minimum(k, len(second) - 1)]), np.abs(hits - second[np.maximum(k - 1, 0)]))
                near = float((gap <= _NEAR).mean())
        mixed = _MIXED.findall(low) if data.translate(None, b"0123456789@$!*#%") != data else []
        spelled = _SPELLED.findall(low)
        plain = ["".join(c for c in x.translate(_PLAIN) if c.isalpha()) for x in (*mixed, *spelled)]
        hidden = sum(self._grade(x) >= 3 for x in plain)
        capitals = size - len(data.translate(None, _UPPER))
        upper = sum(map(str.isupper, text.split())) if capitals * 5 > size else 0
        exclaim = data.count(b"!") + data.count(b"?")
        digits = size - len(data.translate(None, b"0123456789"))
        strong = counts[3] + counts[4] + hidden
        return [
            counts[4] / n, (n - counts[0]) / n if words else 0.0, (counts[2] + counts[3] + counts[4]) / n, strong / n, float(counts[2]), float(strong), near,
            capitals / size, upper / n, exclaim / n, (size - len(data.translate(None, _PUNCTUATION))) / size, (size - len(data.translate(None, _SYMBOLS))) / size,
            len(mixed) / n, len(spelled) / n, float(hidden), float(np.log1p(n)), len(set(words)) / n, digits / size,
        ]

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.array([self.row(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


class Trees:
    """Gradient-boosted trees of fixed depth for the logistic loss, grown on histograms."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: float = 3.0):
        self.depth, self.edges, self.trees = depth, [], []
        prior = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(prior / (1 - prior)))
        if not len(y) or y.min() == y.max():
            return
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        codes = self._codes(x)
        margin = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(depth):
                feature, cut = self._best(codes, node, 1 << level, g, h, bins, l2, least)
                splits.append((feature, cut))
                node = 2 * node + (codes[np.arange(len(y)), feature[node]] > cut[node])
            leaf = np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + l2) * rate
            margin += leaf[node]
            self.trees.append((splits, leaf))

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.int64)

    @staticmethod
    def _best(codes, node, nodes, g, h, bins, l2, least):
        gain = np.full((nodes, codes.shape[1], bins), -1.0)
        for f in range(codes.shape[1]):
            key = node * bins + codes[:, f]
            gs = np.bincount(key, g, nodes * bins).reshape(nodes, bins).cumsum(1)
            hs = np.bincount(key, h, nodes * bins).reshape(nodes, bins).cumsum(1)
            gt, ht = gs[:, -1:], hs[:, -1:]
            score = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[:, f] = np.where((hs >= least) & (ht - hs >= least), score, -1.0)
        flat = gain.reshape(nodes, -1)
        best = flat.argmax(1)
        cut = np.where(flat[np.arange(nodes), best] > 0, best % bins, bins)  # no useful cut: all go left
        return best // bins, cut

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if not self.trees or not len(x):
            return out
        codes, rows = self._codes(x), np.arange(len(x))
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = 2 * node + (codes[rows, feature[node]] > cut[node])
            out += leaf[node]
        return out


class Isotonic:
    """A non-decreasing fit by pool-adjacent-violators, linear between the pools' centres; equal margins are one pool."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        at, tied, count = np.unique(margin, return_inverse=True, return_counts=True)
        mean = np.bincount(tied, y, len(at)) / count
        pools: list[list[float]] = []  # weight, mean label, mean margin
        for m, v, n in zip(at.tolist(), mean.tolist(), count.tolist(), strict=True):
            pools.append([float(n), v, m])
            while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
                w, v2, m2 = pools.pop()
                w0, v0, m0 = pools[-1]
                pools[-1] = [w + w0, (w * v2 + w0 * v0) / (w + w0), (w * m2 + w0 * m0) / (w + w0)]
        # a pool of few rows is drawn towards the margin's own probability
        self.x = np.array([p[2] for p in pools])
        self.y = np.maximum.accumulate(np.array([(p[0] * p[1] + 1 / (1 + np.exp(-p[2]))) / (p[0] + 1) for p in pools]))

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        own = 1 / (1 + np.exp(-margin))
        return np.interp(margin, self.x, self.y) if len(self.x) > 1 else own


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(half, unit, toxic texts, clean texts) of a task's (text, toxic, half)."""
    counts: dict[tuple[int, int], Counter] = defaultdict(Counter)
    for batch in batches:
        for t, y, k in zip(utf8_rows(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            counts[k, int(bool(y))].update({u for w in set(_WORD.findall(t.decode().lower())) for u in units(w)})
    for k in (0, 1):
        toxic, clean = counts[k, 1], counts[k, 0]
        found = list(toxic | clean)
        columns = [pa.array([k] * len(found), pa.int32()), pa.array(found, pa.string()), pa.array([toxic[u] for u in found], pa.int64()), pa.array([clean[u] for u in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["fold", "unit", "a", "b"])


def _learned(counts: DataFrame, totals: dict, but: int | None, most: int) -> dict[str, float]:
    """Units of the rows outside fold `but`, with the lower bounds of their log odds of a toxic text."""
    pos, neg = (sum(n for (fold, toxic), n in totals.items() if fold != but and toxic == y) for y in (1, 0))
    summed = (counts if but is None else counts.where(F.col("fold") != but)).groupBy("unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 3")
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.round(F.log(a / (pos + 1)) - F.log(b / (neg + 1)) - F.sqrt(1 / a + 1 / b), 6)
    return {r["unit"]: r["odds"] for r in summed.select("unit", odds.alias("odds")).where("odds > 0.7").orderBy(F.desc("odds"), "unit").limit(most).collect()}


def fit(labelled: DataFrame, lexicon: int = LEXICON, folds: int = 4) -> tuple[dict[str, float], Trees, Isotonic]:
    """Fit on labelled (doc_id, text, toxic), a bounded sample; see sampled_labels.

    Cross-fitted: a row's features use the lexicon of the other half, and the margins that the isotonic
    curve learns from come from trees grown on the other folds. Rows with a null label are left out.
    """
    rows = labelled.where("toxic is not null").select("text", F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2 * folds)).cast("int"))
    half = (F.col("fold") % 2).alias("half")
    counts = stored(rows.select("text", "toxic", half).transform(arrow_map, _count_units, "fold int, unit string, a long, b long").groupBy("fold", "unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "lexicon")
    totals = {(r["half"], r["toxic"]): r["count"] for r in rows.groupBy(half, "toxic").count().collect()}
    by_half = [_learned(counts, totals, k, lexicon) for k in (0, 1)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = [Features(x) for x in by_half]
        for batch in batches:
            x = [features[f % 2].row(t.decode()) for t, f in zip(utf8_rows(batch.column(0)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "fold", "x"])

    got = rows.transform(arrow_map, measure, "doc_id long, toxic int, fold int, x array<double>").collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    x = np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES))
    y = np.array([r["toxic"] for r in got], float)
    fold = np.array([r["fold"] // 2 for r in got], int)
    margin = np.zeros(len(y))
    for k in range(folds):
        margin[fold == k] = Trees(x[fold != k], y[fold != k]).margin(x[fold == k])
    return _learned(counts, totals, None, lexicon), Trees(x, y), Isotonic(margin, y)


def sampled_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs joined to at most about `sample` hashed label rows; that bound is why the labels may be broadcast. Of labels that repeat an id, the largest counts."""
    some = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = some.count()
    some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)) < int(SHARES * min(1.0, sample / max(n, 1))))
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def score(docs: DataFrame, model: tuple[dict[str, float], Trees, Isotonic], threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), predicted (1 if score >= threshold).

    Null text counts as empty and has the score of a text without words. Repeated rows give repeated
    results; other columns are ignored; an empty table gives an empty result.
    """
    learned, trees, curve = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(learned)
        for batch in batches:
            s = np.clip(curve(trees.margin(features([t.decode() for t in utf8_rows(batch.column(1))]))), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(arrow_map, run, "doc_id long, score double, predicted int")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(sampled_labels(docs, labels.where(remainder(F.col("doc_id"), 4) != 2)))
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
