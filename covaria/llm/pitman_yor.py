"""LM scoring by a hierarchical Pitman-Yor bigram model, trained on the whole corpus.

Each previous token has a context restaurant whose dishes are the next tokens; the tables of all context
restaurants are the customers of one parent restaurant over tokens, whose base is uniform over the
vocabulary and one unknown token. Seatings are sampled by Gibbs. What predictions need of a seating is
how many tables each dish has, so a step seats all customers of a dish anew at once: it draws the number
of tables from its full conditional, a product of a generalised Stirling number and of the
Chinese-restaurant weights of so many new tables, given the restaurant's other tables and the parent's
probability of the dish. Each kept sweep gives a predictive probability; these are averaged.

Work is laid out in blocks of whole documents and in parts of a hash space. A block asks each part about
its distinct bigrams, the part merges what all blocks counted, seats its restaurants and answers in the
order of the question; the same with words and the parent. What is shuffled are these packed questions
and answers, each distinct bigram once a block. A context with more than a quarter of a part's tokens is
divided by the word before it into restaurants of their own, so that no part holds more than its share.
Parts follow from the number of tokens, random numbers from the hashes of context, word and sweep: scores
do not depend on how the rows are spread over files, blocks or tasks.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.llm.common import WordHashes, arrow_map, mix64, multiple, power_of_two, remainder, removed, stored, table

#: Tokens of a block and of a part; parts are at most MOST_PARTS, which also bounds the list of divided contexts (four a part).
BLOCK_TOKENS, MOST_PARTS = 1 << 21, 1 << 19
THETA, SWEEPS, BURN_IN = 2.0, 5, 2
#: The questions about bigrams are asked in so many rounds, so that only one round's are on disk at once.
ROUNDS = 2
#: Contexts are seated against the corpus-wide frequencies of words above this share (there are no more than 1 / share of them) and one value for all rarer words.
SHARE = 1 / (1 << 16)
#: Stirling ratios are tabulated up to so many customers; beyond, they follow by their scaling law.
CUSTOMERS = 1024
_END = np.uint64(0x5851F42D4C957F2D)  # the hash of no word but by chance
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _squeeze(x: np.ndarray, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(x).tobytes())


def _expand(blob: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _sorted_bytes(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, first all first bytes, then all second ones, compressed."""
    return _squeeze(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _sorted_numbers(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_expand(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _short(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit logarithms in steps of 1/1024 of an octave (0.07 %); 0 is 0."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(65535 + 1024 * np.log2(p)), 1, 65535), 0).astype(np.uint16)


def _long(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, np.exp2((q.astype(np.float64) - 65535) / 1024), 0.0)


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(v, kinds[k]) for v, k in zip(columns, types, strict=True)], list(names))


def _batches(schema: str, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield from _table(schema, [row]).to_batches()


def _blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """One row per block: its documents, their tokens as places in the block's sorted vocabulary of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, read = TaskContext.get().partitionId() << 32, WordHashes()
        ids, held, sizes, hashes, total = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            vocab, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            n, out = np.concatenate(sizes), np.concatenate(held)
            train = int(n[~out].sum())
            columns = [
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([_squeeze(out.astype(np.uint8))], pa.binary()), pa.array([_squeeze(n)], pa.binary()),
                pa.array([_squeeze(tokens.astype(np.uint32), 6)], pa.binary()), pa.array([_sorted_bytes(vocab)], pa.binary()), pa.array([train], pa.int64()), pa.array([int(n.sum())], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "held", "sizes", "tokens", "vocab", "n_train", "n_tokens"])

        for batch in batches:
            h, n = read(batch.column(2))
            ids += batch.column(0).to_pylist()
            held.append(batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
            sizes.append(n + 1)
            hashes.append(np.insert(h, np.cumsum(n), _END))
            total += len(hashes[-1])
            if total >= block_tokens:
                yield row()
                number += 1
                ids, held, sizes, hashes, total = [], [], [], [], 0
        if ids:
            yield row()

    schema = "block long, doc_ids array<long>, held binary, sizes binary, tokens binary, vocab binary, n_train long, n_tokens long"
    return docs.select("doc_id", "held_out", "text").transform(arrow_map, run, schema, 256)


class Divided:
    """The contexts that are divided, by hash, and into how many restaurants (powers of two)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n_train: int, parts: int):
        hot = counts * 4 * parts > n_train
        self.words = words[hot]
        self.rooms = np.exp2(np.ceil(np.log2(np.maximum(2.0, counts[hot] * 4.0 * parts / max(1, n_train))))).astype(np.uint64)

    def of(self, words: np.ndarray) -> np.ndarray:
        """Into how many restaurants each context is divided; 1: not at all."""
        if not len(self.words):
            return np.ones(len(words), np.uint64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.rooms[at], np.uint64(1))


class Words:
    """A block's vocabulary, training counts, and which part each word belongs to."""

    def __init__(self, row: dict, parts: int):
        self.vocab = _sorted_numbers(row["vocab"])
        self.tokens = _expand(row["tokens"], np.uint32).view(np.int32)
        self.sizes = _expand(row["sizes"], np.int64)
        self.held = _expand(row["held"], np.uint8).astype(bool)
        self.train = ~np.repeat(self.held, self.sizes)
        self.edges = _edges(self.vocab, parts)

    def count(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=len(self.vocab))


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) * parts >> 24


def _edges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted hashes, and their end."""
    return np.searchsorted(_part(hashes, parts), np.arange(parts + 1))


class Block(Words):
    """A block's tokens and its distinct bigrams (context, word) in the order in which parts are asked about them."""

    def __init__(self, row: dict, parts: int, divided: Divided):
        super().__init__(row, parts)
        w, size = self.tokens, len(self.vocab)
        first = np.cumsum(self.sizes) - self.sizes
        context, before = np.empty_like(w), np.empty_like(w)
        end = w[first[0] + self.sizes[0] - 1]
        context[1:], before[2:] = w[:-1], w[:-2]
        context[first] = before[first] = end  # a document begins after two ends
        before[first[self.sizes > 1] + 1] = end
        rooms = divided.of(self.vocab)
        self.context_hash = self.vocab
        at = np.flatnonzero((rooms > 1)[context])
        if len(at):
            slot = (mix64(self.vocab[before[at]]) & (rooms[context[at]] - np.uint64(1))).astype(np.int64)
            own, place = np.unique(context[at].astype(np.int64) << 32 | slot, return_inverse=True)
            context[at] = size + place
            self.context_hash = np.concatenate([self.vocab, mix64(self.vocab[own >> 32] ^ mix64((own & 0xFFFFFFFF).astype(np.uint64) + _ODD))])
        keys = context.astype(np.int64) * size + w
        order = np.argsort(keys, kind="stable").astype(np.int32)
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        self.pair = np.empty(len(keys), np.int32)  # of each token, its bigram's place
        self.pair[order] = np.cumsum(new, dtype=np.int32) - 1
        pairs = keys[new]
        self.u, self.w = (pairs // size).astype(np.int32), (pairs % size).astype(np.int32)
        part = _part(self.context_hash, parts)[self.u]
        self.order = np.argsort(part, kind="stable").astype(np.int32)
        self.bigram_edges = np.searchsorted(part[self.order], np.arange(parts + 1))

    def runs(self, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a part's bigrams: their places, the contexts in order, and how many bigrams each has."""
        at = self.order[self.bigram_edges[part] : self.bigram_edges[part + 1]]
        u = self.u[at]
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.empty(0, np.int64)
        return at, u[first], np.diff(np.append(first, len(u)))


class Stirling:
    """t d S(c, t + 1) / S(c, t) of generalised Stirling numbers with discount d, which tends to a function of t / c^d."""

    def __init__(self, d: float, most: int = CUSTOMERS):
        self.d = d
        self.grid = np.unique(np.concatenate([np.arange(1, min(most, 64) + 1), np.round(np.geomspace(min(most, 64), most, 25)).astype(np.int64)]))
        self.rows = np.zeros((len(self.grid), most + 2))
        t = np.arange(1, most + 1)
        s = np.full(most, -np.inf)
        s[0] = 0.0
        k = 0
        for c in range(1, most + 1):
            if c > 1:  # S(c, t) = S(c - 1, t - 1) + (c - 1 - d t) S(c - 1, t)
                stay = np.log(np.maximum(c - 1 - d * t[:c], 1e-300)) + s[:c]
                s[1:c] = np.logaddexp(s[: c - 1], stay[1:])
                s[0] = stay[0]
            if k < len(self.grid) and self.grid[k] == c:
                self.rows[k, 1:c] = t[: c - 1] * d * np.exp(s[1:c] - s[: c - 1])
                self.rows[k, 0] = self.rows[k, 1] if c > 1 else 0.0
                k += 1

    def place(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tabulated row for c customers, and what t is to be multiplied by in it."""
        at = np.searchsorted(self.grid, c, "right") - 1
        return at, (self.grid[at] / c) ** self.d

    def ratio(self, at: np.ndarray, scale: np.ndarray, t: int) -> np.ndarray:
        """S(c, t + 1) / S(c, t)."""
        x = t * scale
        low = x.astype(np.int64)
        a, b = self.rows[at, low], self.rows[at, low + 1]
        return (a + (b - a) * (x - low)) / (self.d * t)


def tables(c: np.ndarray, others: np.ndarray, p0: np.ndarray, d: float, theta: float, stirling: Stirling, key: np.ndarray) -> np.ndarray:
    """For each dish the number of its tables, drawn from its full conditional.

    c: customers (2 or more); others: the restaurant's other tables; p0: the parent's probability; key: random bits.
    Weights go by t = 1, 2, ...; each replaces the choice so far with its share of the sum, until the rest is negligible.
    """
    t, rows = np.ones(len(c), np.int64), np.arange(len(c))
    at, scale = stirling.place(c)
    weight, total = np.ones(len(c)), np.ones(len(c))  # relative to the total's last rescaling
    k = 0
    while len(rows):
        k += 1
        r = (theta + d * (others + k)) * p0 * stirling.ratio(at, scale, k)
        live = (k < c) & (weight * r > 1e-12 * total * np.maximum(1e-3, 1 - r))
        if not live.all():
            rows, c, others, p0, key, at, scale, weight, total, r = (x[live] for x in (rows, c, others, p0, key, at, scale, weight, total, r))
        weight = weight * r
        total = total + weight
        weight, total = weight / total, np.ones(len(total))
        draw = (mix64(key + multiple(k, _ODD)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        t[rows[draw < weight]] = k + 1
    return t


def discount(c: np.ndarray) -> float:
    """From how many dishes have one and two customers; kept inside (0, 1)."""
    one, two = int((c == 1).sum()), int((c == 2).sum())
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


def seat(c: np.ndarray, room: np.ndarray, rooms: int, p0: np.ndarray, d: float, key: np.ndarray, share: float = 1.0, theta: float = THETA, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> list[np.ndarray]:
    """The numbers of tables of dishes with c customers in restaurants `room`, in each sweep after burn_in.

    A sweep takes half of the dishes, by their keys, then the other half, each given the tables that are there
    then. share: which part of each restaurant these dishes are.
    """
    t = np.ones(len(c), np.int64)
    many = np.flatnonzero(c > 1)
    stirling, kept = Stirling(d, min(CUSTOMERS, max(2, int(c.max(initial=2))))), []
    for sweep in range(sweeps):
        bits = mix64(key[many] + multiple(sweep + 1, 0xC2B2AE3D27D4EB4F))
        for half in (0, 1):
            some = many[(bits & np.uint64(1)) == half]
            full = np.bincount(room, t, rooms) / share
            t[some] = tables(c[some], full[room[some]] - t[some], p0[some], d, theta, stirling, bits[(bits & np.uint64(1)) == half])
        if sweep >= burn_in:
            kept.append(t.copy())
    return kept


_COUNTED = "part int, block long, a binary, b binary"
_FREQUENT = "words binary, counts binary, n_words long"


def _words(blocks: DataFrame, parts: int) -> DataFrame:
    """Each block's vocabulary and training counts, by part of the hash space."""

    def rows(row: dict) -> Iterator[tuple]:
        b = Words(row, parts)
        count = b.count().astype(np.uint32)
        for part in np.flatnonzero(np.diff(b.edges)).tolist():
            i, j = b.edges[part], b.edges[part + 1]
            yield part, row["block"], _sorted_bytes(b.vocab[i:j]), _squeeze(count[i:j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(_COUNTED, (x for row in batch.to_pylist() for x in rows(row)))

    return blocks.select("block", "held", "sizes", "tokens", "vocab").transform(arrow_map, run, _COUNTED, 1)


def _summed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The words of a part's questions, each question's places among them, the corpus' counts, and the questions' sizes."""
    hashes = [_sorted_numbers(r["a"]) for r in rows]
    words, of = np.unique(np.concatenate(hashes), return_inverse=True)
    c = np.bincount(of, np.concatenate([_expand(r["b"], np.uint32) for r in rows]), len(words)).astype(np.int64)
    return words, of, c, list(map(len, hashes))


def _frequent_part(asked: pa.Table, least: float) -> pa.Table:
    words, _, c, _ = _summed(asked.to_pylist())
    top = c > least
    return _table(_FREQUENT, [(words[top].tobytes(), c[top].tobytes(), int((c > 0).sum()))])


_ASKED = "part int, block long, u binary, runs binary, words binary, w binary, n binary"
_SEATED = "kind int, block long, part int, a binary, b binary"


def _ask(blocks: DataFrame, parts: int, divided: Divided, asked: range) -> DataFrame:
    def rows(row: dict) -> Iterator[tuple]:
        b = Block(row, parts, divided)
        n = np.bincount(b.pair[b.train], minlength=len(b.u)).astype(np.uint32)
        for part in np.flatnonzero(np.diff(b.bigram_edges)).tolist():
            if part in asked:
                at, u, runs = b.runs(part)
                words, w = np.unique(b.w[at], return_inverse=True)
                kind = np.uint16 if len(words) < 1 << 16 else np.uint32
                yield part, row["block"], _sorted_bytes(b.context_hash[u]), _squeeze(runs.astype(np.uint32)), _sorted_bytes(b.vocab[words]), _squeeze(w.astype(kind)), _squeeze(n[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(_ASKED, (x for row in batch.to_pylist() for x in rows(row)))

    return blocks.select("block", "held", "sizes", "tokens", "vocab").transform(arrow_map, run, _ASKED, 1)


def _seat_part(asked: pa.Table, parts: int, frequent: tuple[np.ndarray, np.ndarray, float]) -> pa.Table:
    """Kind 0: answers (averaged share of the seated, by bigram; averaged share of the parent, by context); 1: tables by word; 2: their sums. Both by kept sweep."""
    rows = asked.to_pylist()
    part = rows[0]["part"]
    us, runs, ws = [], [], []
    for r in rows:
        words = _sorted_numbers(r["words"])
        us.append(_sorted_numbers(r["u"]))
        runs.append(_expand(r["runs"], np.uint32))
        ws.append(words[_expand(r["w"], np.uint16 if len(words) < 1 << 16 else np.uint32)])
    w = np.concatenate(ws)
    n = np.concatenate([_expand(r["n"], np.uint32) for r in rows]).astype(np.int64)
    rooms, of = np.unique(np.concatenate(us), return_inverse=True)
    at = np.repeat(of, np.concatenate(runs))
    keys, first, dish = np.unique(mix64(rooms[at] + w * _ODD), return_index=True, return_inverse=True)
    c = np.bincount(dish, n, len(first)).astype(np.int64)
    room, word = at[first], w[first]
    seen = np.flatnonzero(c)
    words, share, rest = frequent
    p0 = np.full(len(seen), rest)
    if len(words):
        k = np.minimum(np.searchsorted(words, word[seen]), len(words) - 1)
        p0 = np.where(words[k] == word[seen], share[k], rest)
    d = discount(c)
    kept = seat(c[seen], room[seen], len(rooms), p0, d, keys[seen])
    customers = THETA + np.bincount(room, c, len(rooms))
    x, parent = np.zeros(len(c)), np.zeros(len(rooms))
    for t in kept:
        x[seen] += (c[seen] - d * t) / customers[room[seen]] / len(kept)
        parent += (THETA + d * np.bincount(room[seen], t, len(rooms))) / customers / len(kept)
    x, parent = _short(x), _short(parent)
    out, i, j = [], 0, 0
    for r, u, k in zip(rows, us, runs, strict=True):
        size = int(k.sum())
        out.append((0, r["block"], part, _squeeze(x[dish[i : i + size]]), _squeeze(parent[of[j : j + len(u)]])))
        i, j = i + size, j + len(u)
    some, place = np.unique(word[seen], return_inverse=True)
    by_word = np.stack([np.bincount(place, t, len(some)).astype(np.uint32) for t in kept])
    edges = _edges(some, parts)
    for k in np.flatnonzero(np.diff(edges)).tolist():
        out.append((1, -1, k, _sorted_bytes(some[edges[k] : edges[k + 1]]), _squeeze(by_word[:, edges[k] : edges[k + 1]])))
    out.append((2, -1, part, by_word.sum(1, dtype=np.int64).tobytes(), b""))
    return _table(_SEATED, out)


_PARENT = "block long, part int, c binary, x binary, tables binary"


def _parent_part(told: pa.Table, parts: int, n_words: int, customers: np.ndarray) -> pa.Table:
    """Answers to the blocks: exact counts of their words, and the averaged share of the words' customers in the parent; a row of its tables by kept sweep."""
    rows = told.to_pylist()
    asked = [r for r in rows if r["block"] >= 0]
    part, kept = rows[0]["part"], len(customers)
    words, of, c, sizes = _summed(asked)
    seated = np.zeros((kept, len(words)), np.int64)
    for r in rows:
        if r["block"] < 0:
            seated[:, np.searchsorted(words, _sorted_numbers(r["a"]))] += _expand(r["b"], np.uint32).reshape(kept, -1)
    x, sums, seen = np.zeros(len(words)), [], np.flatnonzero(seated[0])
    for k, own in enumerate(seated[:, seen]):
        d = discount(own)
        t = seat(own, np.zeros(len(own), np.int64), 1, np.full(len(own), 1.0 / (n_words + 1)), d, words[seen] + np.uint64(k), 1.0 / parts, sweeps=BURN_IN + 1)[0]
        x[seen] += (own - d * t) / (THETA + customers[k]) / kept
        sums.append(float(d * t.sum()))
    out, i = [], 0
    for r, size in zip(asked, sizes, strict=True):
        out.append((r["block"], part, _squeeze(c[of[i : i + size]]), _squeeze(x[of[i : i + size]]), None))
        i += size
    out.append((-1, part, None, None, np.array(sums).tobytes()))
    return _table(_PARENT, out)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_block(rows: pa.Table, answers: pa.Table, parts: int, divided: Divided, n_train: int, n_words: int, unknown: float) -> pa.Table:
    names = [x.split()[0] for x in _SCORED.split(", ")]
    kinds = (pa.int64(), pa.bool_(), *(pa.int64(),) * 3, pa.float64(), pa.float64())
    if not rows.num_rows:
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
    row = rows.to_pylist()[0]
    b = Block(row, parts, divided)
    c, parent = np.zeros(len(b.vocab), np.int64), np.zeros(len(b.vocab))
    x, share = np.zeros(len(b.u)), np.ones(len(b.context_hash))
    for r in answers.to_pylist():
        if r["kind"] == 3:
            i, j = b.edges[r["part"]], b.edges[r["part"] + 1]
            c[i:j], parent[i:j] = _expand(r["a"], np.int64), _expand(r["b"], np.float64)
        else:
            at, u, _ = b.runs(r["part"])
            x[at], share[u] = _long(_expand(r["a"], np.uint16)), _long(_expand(r["b"], np.uint16))
    p = x + share[b.u] * (parent + unknown)[b.w]
    first = np.concatenate([[0], np.cumsum(b.sizes)[:-1]])
    score = np.add.reduceat(np.log10(p)[b.pair], first)
    base = np.add.reduceat(np.log10((c + 1) / (n_train + n_words + 1))[b.tokens], first)
    known = np.add.reduceat((c > 0)[b.tokens].astype(np.int32), first).astype(np.int64)
    values = (row["doc_ids"], b.held, b.sizes, known, np.full(len(b.held), n_train), base, score)
    return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)


def _released(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, whose results are stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lm_scores(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, part_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs (doc_id, held_out, text): one row each: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows with held_out false are learned from. Null text is empty: its one token is the end. Repeated rows
    count and are scored each; a null doc_id stays null, a null held_out is false. An empty table gives an
    empty result. Contexts and words without training tokens have the parent's and the base's probabilities.
    A text longer than a block is a block of its own. Words, contexts and their pairs are told apart by 64
    bits of hash; probabilities travel as 16-bit logarithms. part_tokens sets the number of parts, and so
    which contexts are divided; block_tokens changes no result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    blocks = stored(_blocks(rows, block_tokens), "blocks")
    n_train, n_tokens = blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    parts = power_of_two(n_tokens / part_tokens, 1, MOST_PARTS)
    least = min(n_train * SHARE, n_train / (4 * parts))
    found = _words(blocks, parts).groupBy("part").applyInArrow(lambda t: _frequent_part(t, least), _FREQUENT).collect()
    n_words = sum(r["n_words"] for r in found)
    words = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["words"], np.uint64) for r in found)])
    counts = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in found)])
    words, counts = words[np.argsort(words)], counts[np.argsort(words)]
    rest = max(1.0, n_train - counts.sum()) / max(1, n_train) / max(1, n_words - len(words) + 1)
    frequent, divided = (words, counts / max(1, n_train), rest), Divided(words, counts, n_train, parts)
    seated = None
    for k in range(ROUNDS):
        asked = _ask(blocks, parts, divided, range(k * parts // ROUNDS, (k + 1) * parts // ROUNDS))
        new = stored(asked.groupBy("part").applyInArrow(lambda t: _seat_part(t, parts, frequent), _SEATED), "seated", by="kind")
        seated = new if seated is None else seated.union(new)
        del asked, new
        _released(spark)
    customers = sum((np.frombuffer(r["a"], np.int64) for r in seated.where("kind = 2").select("a").collect()), np.zeros(SWEEPS - BURN_IN, np.int64))
    told = seated.where("kind = 1").select("part", "block", "a", "b")
    parent = stored(_words(blocks, parts).union(told).groupBy("part").applyInArrow(lambda t: _parent_part(t, parts, n_words, customers), _PARENT), "parent")
    _released(spark)
    sums = sum((np.frombuffer(r["tables"]) for r in parent.where("block < 0").select("tables").collect()), np.zeros(SWEEPS - BURN_IN))
    unknown = float(((THETA + sums) / (THETA + customers)).mean() / (n_words + 1))
    removed(seated, folder="kind=1")
    answers = seated.where("kind = 0").select("block", "kind", "part", "a", "b").union(parent.where("block >= 0").select("block", F.lit(3), "part", F.col("c"), F.col("x")))
    left = blocks.select("block", "doc_ids", "held", "sizes", "tokens", "vocab").groupBy("block")
    return left.cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _score_block(a, b, parts, divided, n_train, n_words, unknown), _SCORED)


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, tokens, perplexity of the model and of the base, from lm_scores."""
    per_token = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), per_token("score").alias("perplexity"), per_token("base_score").alias("base_perplexity"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scores(docs.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "text"))
