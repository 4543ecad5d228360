"""Language identification by cross-parsing entropy.

Each language has a reference: whole labelled texts, letters in lower case with runs of anything else as
one gap. Its suffix automaton parses a text into the longest phrases that occur in the reference. Phrases
from a shorter reference are shorter by nature: their number is weighed by the bits that name a place in
the reference or a symbol, as whole phrases of the longest reference. The language that needs the fewest
wins. Texts are parsed in blocks, all blocks of a batch in step, by array operations. A phrase goes on
beyond its block, until it and its successors meet the phrases that the next block was parsed into by
itself: from a common beginning on, both are the same. So the count is that of the whole text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from covaria.llm.common import arrow_map, remainder, table, utf8_rows

#: The reference's bounds: labelled rows a language, and characters in all; whole texts are taken while they fit.
ROWS, CHARS = 64, 60_000
BLOCK = 1024
#: Entries of an automaton's table; one with more is kept as a sorted list of its transitions.
DENSE = 1 << 23
UNKNOWN = "und"


def reference_texts(docs: DataFrame, rows: int = ROWS, chars: int = CHARS) -> dict[str, str]:
    """lang -> reference text, of whole texts: those with the smallest id hashes that fit into `chars` together.

    A language whose texts are all longer than that has its shortest text as reference. Rows with a null
    lang, or a null or empty text, are left out; repeated rows may be taken more than once; ties go to the
    smaller doc_id. Without rows there are no references, and every text is `und`.
    """
    size = F.length("text")
    order = Window.partitionBy("lang").orderBy("beyond", "h", "doc_id")
    picked = (
        docs.where("lang is not null and text is not null and length(text) > 0")
        .select("lang", "doc_id", "text", F.xxhash64("doc_id").alias("h"), F.when(size > chars, size).otherwise(0).alias("beyond"))
        .withColumn("k", F.row_number().over(order))
        .where((F.col("k") <= rows) & ((F.col("beyond") == 0) | (F.col("k") == 1)))
    )
    found: dict[str, list[str]] = {}
    for lang, _, text in sorted((r["lang"], r["k"], r["text"]) for r in picked.select("lang", "k", "text").collect()):
        held = found.setdefault(lang, [])
        if not held or sum(map(len, held)) + len(text) <= chars:
            held.append(text)
    return {lang: "\n".join(texts) for lang, texts in found.items()}


class Automaton:
    """A suffix automaton over symbols 0..n-1, completed: a step gives the next state * 2 + (a phrase began).

    It has its own alphabet, the symbols that the reference has; any other symbol is a phrase by itself.
    Steps are one table, or for a large alphabet the sorted transitions of all states, found by bisection.
    """

    def __init__(self, symbols: np.ndarray, n: int, dense: int = DENSE):
        own = np.unique(symbols)
        self.local = np.zeros(n, np.int32)  # 0: not in the reference
        self.local[own] = np.arange(1, len(own) + 1)
        self.n = len(own) + 1
        nxt, link, size = [{}], [-1], [0]
        last = 0
        for c in self.local[symbols].tolist():
            cur = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if size[p] + 1 == size[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.restart = np.ones(self.n, np.int32)
        for c, s in nxt[0].items():
            self.restart[c] = 2 * s + 1
        self.steps = self.keys = None
        if len(nxt) * self.n <= dense:
            steps = np.tile(self.restart, (len(nxt), 1))
            for s, row in enumerate(nxt[1:], 1):
                for c, t in row.items():
                    steps[s, c] = 2 * t
            self.steps = steps.ravel()
        else:
            found = sorted((s * self.n + c, 2 * t) for s, row in enumerate(nxt[1:], 1) for c, t in row.items())
            self.keys, self.next = (np.array(x, np.int64) for x in zip(*found, strict=True))

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.n + symbols
        if self.steps is not None:
            return self.steps[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], self.restart[symbols])

    def phrases(self, rows: np.ndarray, lengths: np.ndarray, after: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The number of phrases that begin in each column of rows (symbols by step); lengths fall from left to right.

        after: for each column, the column that its text goes on in, or -1; place: where it stands among all blocks of the texts.
        """
        rows = self.local[rows]
        state = np.zeros(rows.shape[1], np.int64)
        began = np.zeros(rows.shape, bool)
        live = np.searchsorted(-lengths, -np.arange(1, len(rows) + 1), "right")
        for i, k in enumerate(live.tolist()):
            v = self.step(state[:k], rows[i, :k])
            began[i, :k] = v & 1
            state[:k] = v >> 1
        count = began.sum(0)
        left = np.flatnonzero(after >= 0)
        to, now = after[left], state[left]
        own, true = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)  # phrases of the column itself, and of the text, so far
        open_ = []  # columns that end before the two meet
        for i in range(len(rows)):
            on = lengths[to] > i
            if not on.all():
                open_ += zip(to[~on].tolist(), now[~on].tolist(), strict=True)
                count[to[~on]] += true[~on] - own[~on]
                to, now, own, true = to[on], now[on], own[on], true[on]
            if not len(to):
                break
            v = self.step(now, rows[i, to])
            new, same = (v & 1).astype(bool), began[i, to]
            meet = new & same
            count[to[meet]] += true[meet] - own[meet]
            go = ~meet
            to, now, own, true = to[go], v[go] >> 1, own[go] + same[go], true[go] + new[go]
        open_ += zip(to.tolist(), now.tolist(), strict=True)
        count[to] += true - own
        ends, done = dict(open_), -1  # columns whose text ends them in another state than the column by itself
        for column in sorted(ends, key=lambda c: place[c]):
            if place[column] > done:
                done = self._go_on(rows, lengths, after, place, began, count, ends, column)
        return count

    def _go_on(self, rows, lengths, after, place, began, count, ends: dict[int, int], column: int) -> int:
        """Phrases of the columns after `column`, one after the other; a column where the two meet ends in its own state again.
        Returns the place of the last column that this settled."""
        state = ends[column]
        while True:
            last, column = int(place[column]), int(after[column])
            if column < 0:
                return last
            true, met, size = 0, False, int(lengths[column])
            for i in range(size):
                v = int(self.step(np.array([state]), rows[i : i + 1, column])[0])
                if v & 1 and began[i, column]:
                    met = True
                    break
                true, state = true + (v & 1), v >> 1
            count[column] = true + int(began[i if met else size : size, column].sum())
            if met:
                last, column = int(place[column]), int(after[column])
                if column not in ends:
                    return last
                state = ends[column]


class Model:
    """References, each of its own length, and the alphabet that they share; a text without a letter is no reference."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(lang for lang, t in texts.items() if any(c.isalpha() for c in t))
        letters = sorted({c for lang in self.langs for c in texts[lang].lower() if c.isalpha() or unicodedata.combining(c)})
        self.symbols = {c: k + 1 for k, c in enumerate(letters)}  # 0: a gap
        self.n = len(letters) + 2  # the last: letters of no reference
        self.other = self.n - 1
        self.table = np.zeros(0x110000, np.int32)
        self.table[:] = -1
        parsed = [self.read([texts[lang]])[0] for lang in self.langs]
        self.automata = [Automaton(p, self.n) for p in parsed]
        bits = np.log2([self.n + len(p) for p in parsed])
        self.weights = bits / bits.max(initial=0)

    def _symbol(self, code: int) -> int:
        c = chr(code)
        return self.symbols.get(c.lower(), self.other) if c.isalpha() or unicodedata.combining(c) else 0

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, each with a gap at its end and no repeated gaps, and where each text begins (and the end)."""
        codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        new = np.unique(codes[self.table[codes] < 0])
        for c in new.tolist():
            self.table[c] = self._symbol(c)
        symbols = self.table[codes]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        begins = np.zeros(len(symbols) + 2, bool)
        begins[starts] = True
        gap = symbols == 0
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        keep &= ~(gap & begins[: len(gap)])
        at = np.concatenate([[0], np.cumsum(keep)])
        return symbols[keep], at[np.minimum(starts, len(symbols))]

    def predict(self, texts: list[str], block: int = BLOCK) -> tuple[list[str], list[float]]:
        """lang (und: no letter) and score: the runner-up's share of the two fewest weighed phrases, 1 without one."""
        symbols, at = self.read(texts)
        sizes = np.diff(at)
        blocks = -(-sizes // block)
        owner = np.repeat(np.arange(len(texts)), blocks)
        first = np.repeat(at[:-1], blocks) + block * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        lengths = np.minimum(block, at[1:][owner] - first)
        order = np.argsort(-lengths, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        after = np.where(np.append(owner[1:] == owner[:-1], False), np.append(place[1:], -1), -1)[order] if len(order) else place
        owner, first, lengths = owner[order], first[order], lengths[order]
        padded = np.concatenate([symbols, np.zeros(block, symbols.dtype)])
        rows = np.empty((int(lengths.max(initial=0)), len(first)), symbols.dtype)
        for k in range(len(rows)):
            rows[k] = padded[first + k]
        has = np.fromiter((n > 0 and any(map(str.isalpha, t)) for n, t in zip(sizes.tolist(), texts, strict=True)), bool, len(texts))
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        phrases = np.array([np.bincount(owner, a.phrases(rows, lengths, after, order), len(texts)) for a in self.automata])
        phrases = np.ceil(phrases * self.weights[:, None] - 1e-9)
        ranked = np.sort(phrases, axis=0)
        best = ranked[0]
        second = ranked[1] if len(ranked) > 1 else np.full_like(best, np.inf)
        with np.errstate(all="ignore"):
            score = np.where(np.isinf(second), 1.0, second / (best + second))
        won = phrases.argmin(axis=0)
        return [self.langs[k] if h else UNKNOWN for k, h in zip(won.tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0).tolist()


def identify(docs: DataFrame, references: dict[str, str], text: str = "text", batch_chars: int = 1_000_000) -> DataFrame:
    """docs and lang_pred, score: by mapInArrow, whole texts in runs of about batch_chars.

    A null text, or one with no letter, is `und` with score 0; ties go to the language that sorts first.
    Repeated rows give repeated results; other columns stay as they are, whatever their names; columns of
    docs named lang_pred or score are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    names = [*docs.columns, "lang_pred", "score"]
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or Model(references)
            langs, scores, some, size = [], [], [], 0
            for at in range(0, batch.num_rows, 256):
                for t in utf8_rows(batch.column(place).slice(at, 256)):
                    some.append(t.decode())
                    size += len(some[-1])
                    if size >= batch_chars:
                        a, b = model.predict(some)
                        langs, scores, some, size = langs + a, scores + b, [], 0
            if some:
                a, b = model.predict(some)
                langs, scores = langs + a, scores + b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    return docs.transform(arrow_map, run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 5) == 0
    references = reference_texts(docs.where(~held))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return identify(rows, references).select("doc_id", "held_out", "lang_pred", "score")
