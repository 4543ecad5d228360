"""N-gram Jaccard join: an exact T-occurrence search in DivideSkip's manner, spread over Spark.

Two sets of n-gram shingles link when 100 * intersection >= 80 * union, that is when they share at least
T = ceil(4 (n1 + n2) / 9) shingles. DivideSkip divides a query's inverted lists into short ones, which are
merged, and the L longest, which are only probed: what links occurs in at least T - L short lists. Here
all shingles have one order, rarest first (by counters whose number follows the input's bytes, up to a
bound, so that they can be broadcast; any consistent order is exact). With L = T - 2, a document's short
lists are those of its n - T + 2 first shingles. Only these are shuffled and merged, Spark bringing each
list together in sorted runs; pairs that occur in two of them, at places that still allow a link, are
probed: the rest of one document's shingles are searched for in the other's sorted set by bisection.

No list is paired out by its length. Equal sets become one node. In each list every node is first probed
against one leader only, the node in whose order that list comes earliest; in a group of near copies that
is the one with the fewest edits. What links becomes one component, and lists within one component are
done. Lists that still join components are merged pair by pair if they have at most SHORT entries. Longer
ones belong to a passage that documents share which do not link. Their members, by leader, are divided
anew: in such a group the shingles that the leader has too are its long lists and come last in the order,
so that the short lists are of what sets the members apart, and the shared passage is only probed. This
goes on until no long list is left, or until a division no longer halves the pairs that they stand for;
those pairs are then merged as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.llm.common import WordHashes, arrow_map, components, counter_rows, counter_table, mix64, power_of_two, removed, stored, table

WORDS = 5
#: Short lists that a pair must occur in: T - L.
OCCURRENCES = 2
#: Entries of a list that is merged pair by pair; longer lists are divided anew.
SHORT = 32
#: Bounds of the number of frequency counters (a byte each when broadcast) and of the bits of the filter of shared shingles.
SLOTS, BITS = (1 << 16, 1 << 23), (1 << 19, 1 << 26)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_ENTRIES = "g long, h long, id long, n int, pos int"


class Sets:
    """The sorted distinct 64-bit shingle hashes of each text of a column."""

    def __init__(self, words: int = WORDS):
        self.hashes, self.words = WordHashes(), words

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        h, n = self.hashes(column)
        k, out = self.words, []
        s = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            s += h[j : j + len(s)] * _ODD[j]
        s = mix64(s)
        at = 0
        for m in n.tolist():
            if m >= k:
                x = np.sort(s[at : at + m - k + 1])
                new = np.empty(len(x), bool)
                new[0] = True
                np.not_equal(x[1:], x[:-1], out=new[1:])
                out.append(x if new.all() else x[new])
            elif m:
                out.append(mix64((h[at : at + m] * _ODD[:m]).sum(dtype=np.uint64, keepdims=True) + np.uint64(m)))
            else:
                out.append(h[:0])
            at += m
        return out


def _prefix(n: int) -> int:
    """How many first shingles a set of n must show so that every partner shares OCCURRENCES of them: n - ceil(4n/5) + OCCURRENCES."""
    return min(n, n - -(-4 * n // 5) + OCCURRENCES) if n else 0


def _first(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The short lists of a sorted set: its first shingles in order of (rank, shingle)."""
    k = _prefix(len(s))
    if k < len(s):
        near = np.flatnonzero(rank <= np.partition(rank, k - 1)[k - 1])
        return s[near[np.argsort(rank[near], kind="stable")[:k]]]
    return s[np.argsort(rank, kind="stable")]


def _identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the whole set, as two signed 64-bit numbers."""
    a = int(s.sum(dtype=np.uint64)) & (1 << 64) - 1
    b = int(mix64(s ^ _ODD[5]).sum(dtype=np.uint64)) & (1 << 64) - 1
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _measure(docs: DataFrame, words: int, slots: int) -> DataFrame:
    """For each row doc_id, n, f1, f2 (the set's identity), and each task's frequency counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, counts = Sets(words), np.zeros(slots, np.uint32)
        names = ["doc_id", "n", "f1", "f2", "chunk_no", "counters"]
        for batch in batches:
            found = sets(batch.column(1))
            f = [_identity(s) for s in found]
            if found:
                np.add.at(counts, (np.concatenate(found) & np.uint64(slots - 1)).astype(np.int64), np.uint32(1))
            m = len(found)
            columns = (list(map(len, found)), [x[0] for x in f], [x[1] for x in f])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in columns), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        for k, blob in counter_rows(counts):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([k], pa.int32()), pa.array([blob], pa.binary())], names)

    return _rows(docs).transform(arrow_map, run, "doc_id long, n long, f1 long, f2 long, chunk_no int, counters binary")


def _lists(docs: DataFrame, words: int, counts: np.ndarray) -> DataFrame:
    """(h, f1): the sets in each short list; a task tells copies that it has seen lately only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen, mask = Sets(words), set(), np.uint64(len(counts) - 1)
        for batch in batches:
            hs, fs = [], []
            for doc_id, s in zip(batch.column(0).to_pylist(), sets(batch.column(1)), strict=True):
                f = _identity(s)[0] if len(s) and doc_id is not None else None
                if f is None or f in seen:
                    continue
                if len(seen) > 1 << 18:
                    seen.clear()
                seen.add(f)
                hs.append(_first(s, counts[(s & mask).astype(np.int64)]))
                fs.append(f)
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.repeat(fs, list(map(len, hs))))], ["h", "f1"])

    return _rows(docs).transform(arrow_map, run, "h long, f1 long")


def _entries(docs: DataFrame, words: int, counts: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """(h, doc_id, f1, n, pos): the entries of each set's short lists that the filter `wanted` (packed bits) may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, mask = Sets(words), np.uint64(len(counts) - 1)
        for batch in batches:
            rows = []
            for doc_id, s in zip(batch.column(0).to_pylist(), sets(batch.column(1)), strict=True):
                if len(s) and doc_id is not None:
                    h = _first(s, counts[(s & mask).astype(np.int64)])
                    pos = np.flatnonzero(_held(wanted, h, 20))
                    if len(pos):
                        rows.append((h[pos], pos, (doc_id, _identity(s)[0], len(s))))
            if rows:
                h, pos, one = zip(*rows, strict=True)
                doc_id, f, n = np.repeat(np.array(one, np.int64), list(map(len, h)), axis=0).T
                columns = [pa.array(np.concatenate(h).view(np.int64)), pa.array(doc_id), pa.array(f), pa.array(n.astype(np.int32)), pa.array(np.concatenate(pos).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "f1", "n", "pos"])

    return _rows(docs).transform(arrow_map, run, "h long, doc_id long, f1 long, n int, pos int")


def _held(bits: np.ndarray, keys: np.ndarray, shift: int) -> np.ndarray:
    slot = (keys >> np.uint64(shift)) & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bits(keys: DataFrame, shift: int, bits: int) -> np.ndarray:
    """A filter of so many bits that holds every key: the bit at (key >> shift) mod bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            slot = (k >> np.uint64(shift)) & np.uint64(bits - 1)
            np.bitwise_or.at(own, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        for k in range(0, len(own), 1 << 16):
            if own[k : k + (1 << 16)].any():
                yield pa.RecordBatch.from_arrays([pa.array([k >> 16], pa.int32()), pa.array([own[k : k + (1 << 16)].tobytes()], pa.binary())], ["chunk_no", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(blob, np.uint8)
                total[k] = total[k] | part if k in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk_no", "part"])

    schema = "chunk_no int, part binary"
    out = np.zeros(bits // 8, np.uint8)
    for k, part in keys.transform(arrow_map, run, schema, 1 << 16).repartition(max(1, bits >> 19), "chunk_no").transform(arrow_map, merge, schema).collect():
        out[k << 16 : (k << 16) + len(part)] |= np.frombuffer(part, np.uint8)
    return out


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, z): compressed words of the documents in pairs (a, b), stored; a filter picks them in the scan."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    wanted = _bits(ids.select(F.xxhash64("id").alias("k")), 7, power_of_two(16 * ids.count(), *BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            few = batch.filter(pa.array(_held(wanted, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64), 7)))
            yield pa.RecordBatch.from_arrays([few.column(0), pa.array([squeeze(b" ".join(t.lower().split())) for t in few.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["id", "z"])

    rows = _rows(docs).where("doc_id is not null and text is not null").withColumn("k", F.xxhash64("doc_id"))
    out = stored(rows.transform(arrow_map, run, "id long, z binary"), "texts")
    removed(ids)
    return out


def _with_texts(docs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (a, b, ...) with the texts za and zb, by two joins, which split hot ids; and the stored texts."""
    texts = _texts(docs, pairs)
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
    return with_b.join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").select(*pairs.columns, "za", "zb"), texts


def _opened(column: pa.Array, sets: Sets) -> list[np.ndarray]:
    """The sets of compressed texts; a run of one text is opened once."""
    import zstandard

    open_, blobs, of, last = zstandard.ZstdDecompressor().decompress, [], [], None
    for z in column.to_pylist():
        if z != last:
            blobs.append(open_(z))
            last = z
        of.append(len(blobs) - 1)
    found = sets(pa.array(blobs, pa.binary()))
    return [found[k] for k in of]


def _verified(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(words)
        for batch in batches:
            hit = list(map(linked, _opened(batch.column(2), sets), _opened(batch.column(3), sets)))
            yield batch.filter(pa.array(hit, pa.bool_())).select(["a", "b"])

    both, texts = _with_texts(docs, pairs)
    out = stored(both.transform(arrow_map, run, "a long, b long", 256).distinct(), "links")
    removed(texts)
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets share T elements: the smaller's are probed for in the larger by bisection."""
    if len(a) > len(b):
        a, b = b, a
    least = -(-4 * (len(a) + len(b)) // 9)
    if not len(a) or len(a) < least:
        return False
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) >= least


def _divided(docs: DataFrame, members: DataFrame, words: int, counts: np.ndarray) -> DataFrame:
    """members (g, leader, id): the short lists of each member in the order of its leader's group, which has what the leader lacks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, mask = Sets(words), np.uint64(len(counts) - 1)
        for batch in batches:
            hs, rows = [], []
            for g, i, s, top in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _opened(batch.column(4), sets), _opened(batch.column(3), sets), strict=True):
                both = top[np.minimum(np.searchsorted(top, s), len(top) - 1)] == s
                hs.append(_first(s, counts[(s & mask).astype(np.int64)] + 256 * both.astype(np.int32)))
                rows.append((g, i, len(s)))
            if hs:
                size = list(map(len, hs))
                g, i, n = np.repeat(np.array(rows, np.int64), size, axis=0).T
                pos = np.concatenate([np.arange(k) for k in size])
                columns = [pa.array(g), pa.array(np.concatenate(hs).view(np.int64)), pa.array(i), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["g", "h", "id", "n", "pos"])

    with_texts, texts = _with_texts(docs, members.select("g", F.col("leader").alias("a"), F.col("id").alias("b")))
    every = stored(with_texts.transform(arrow_map, run, _ENTRIES, 256), "divided")
    shared = every.groupBy("g", "h").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("g", "h")
    out = stored(every.join(shared, ["g", "h"], "left_semi"), "entries")
    removed(texts, every)
    return out


def _possible(a: str, b: str, before: int) -> Column:
    """Whether sizes allow a link, and so do the places of a shared shingle, if at most `before` were shared before it."""
    return F.expr(f"5 * least({a}n, {b}n) >= 4 * greatest({a}n, {b}n) and 9 * (least({a}n - {a}pos, {b}n - {b}pos) + {before}) >= 4 * ({a}n + {b}n)")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _stars(led: DataFrame, tried: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of each list's members and its leader that may link and have not been probed yet."""
    tops = led.where("id = leader").select("g", "h", F.col("n").alias("l_n"), F.col("pos").alias("l_pos"))
    out = led.where("id <> leader").join(tops, ["g", "h"]).where(_possible("", "l_", OCCURRENCES - 1)).select(*_pair("id", "leader")).distinct()
    return stored(out if tried is None else out.join(tried, ["a", "b"], "left_anti"), "stars")


def _merged(lists: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that occur in OCCURRENCES of the lists and have not been probed yet."""
    other = lists.select("g", "h", *(F.col(c).alias(f"o_{c}") for c in ("id", "n", "pos", "root", "minor")))
    pairs = lists.where("minor").join(other, ["g", "h"]).where("root <> o_root and (not o_minor or id < o_id)").where(_possible("", "o_", OCCURRENCES - 1))
    counted = pairs.select("g", *_pair("id", "o_id")).groupBy("g", "a", "b").agg(F.count("*").alias("k")).where(F.col("k") >= OCCURRENCES)
    return stored(counted.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")


_PLACE = (
    "cast(pos * 1000000L div n as decimal(10,0)) * cast('18446744073709551616' as decimal(20,0)) + (cast(id as decimal(20,0)) + cast('9223372036854775808' as decimal(20,0)))"
)
_LEADER = "cast(first % cast('18446744073709551616' as decimal(20,0)) - cast('9223372036854775808' as decimal(20,0)) as bigint)"


def search(docs: DataFrame, entries: DataFrame, words: int, counts: np.ndarray, short: int = SHORT) -> tuple[DataFrame, list[int]]:
    """(components (id, root) of documents with links, how many pairs each step probed)."""
    tried = links = last = None
    probed = []
    while True:
        leaders = entries.groupBy("g", "h").agg(F.min(F.expr(_PLACE)).alias("first")).select("g", "h", F.expr(_LEADER).alias("leader"))
        led = stored(entries.join(leaders, ["g", "h"]), "led")
        removed(entries)
        stars = _stars(led, tried)
        tried = stars if tried is None else tried.union(stars)
        found = _verified(docs, stars, words)
        links = found if links is None else links.union(found)
        roots = components(links, "roots")
        rooted = led.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        top = rooted.where("id = leader").select("g", "h", F.col("root").alias("l_root"))
        mixed = stored(rooted.join(top, ["g", "h"]).withColumn("minor", F.col("root") != F.col("l_root")).drop("l_root"), "mixed")
        removed(led)
        sizes = mixed.groupBy("g", "h").agg(F.sum(F.col("minor").cast("long")).alias("minors"), F.count("*").alias("size")).where("minors > 0")
        sizes = stored(sizes, "sizes")
        pairs = sizes.where(F.col("size") > short).agg(F.coalesce(F.sum(F.col("minors") * F.col("size")), F.lit(0))).first()[0]
        done = not pairs or last is not None and 2 * pairs > last
        some = mixed.join(sizes.where(F.lit(done) | (F.col("size") <= short)).select("g", "h"), ["g", "h"], "left_semi")
        more = _merged(some, tried)
        probed += [stars.count(), more.count()]
        if probed[-1]:
            found = _verified(docs, more, words)
            tried, links = tried.union(more), links.union(found)
        if done:
            if probed[-1] and not found.isEmpty():
                removed(roots)
                roots = components(links, "roots")
            removed(mixed, sizes, tried, links)
            return roots, probed
        last = pairs
        members = mixed.join(sizes.where(F.col("size") > short).select("g", "h"), ["g", "h"], "left_semi").where("id <> leader")
        members = stored(members.select(F.xxhash64("g", "leader").alias("g"), "leader", "id").distinct(), "members")
        entries = _divided(docs, members, words, counts)
        removed(mixed, sizes, members, roots)


def ngram_components(docs: DataFrame, words: int = WORDS, slots: int | None = None, bits: int | None = None, short: int = SHORT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Null and empty texts have no shingles and are linked with nothing, as are rows whose doc_id is null
    (component_id null). Texts with fewer than `words` words are one shingle, the whole sequence. Rows
    that share a doc_id are one document to the links. Other columns are ignored; an empty table gives
    an empty result. Ties in the order of shingles or leaders go to the smaller hash or id. Shingles are
    compared by 64-bit hashes, sets of equal texts by 128 bits. slots and bits fix the sizes of counters
    and filter, which otherwise follow the input; no size changes the result.
    """
    if slots is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        slots = power_of_two(size / 256, *SLOTS)
    measured = stored(_measure(docs, words, slots), "sets")
    sets = measured.where("chunk_no is null").select("doc_id", "n", "f1", "f2")
    counts = counter_table(measured.where("chunk_no is not null").select("chunk_no", "counters"), slots)
    nodes = stored(sets.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "nodes")

    shared = stored(_lists(docs, words, counts).groupBy("h").agg(F.min("f1").alias("x"), F.max("f1").alias("y")).where("x <> y").select("h"), "lists")
    wanted = _bits(shared, 20, bits or power_of_two(16 * shared.count(), *BITS))
    own = _entries(docs, words, counts, wanted).join(nodes.select(F.col("rep").alias("doc_id"), F.col("f1").alias("own")), "doc_id").where("f1 = own")
    entries = stored(own.join(shared, "h").select(F.lit(0).cast("long").alias("g"), "h", F.col("doc_id").alias("id"), "n", "pos"), "entries")
    removed(shared)
    roots, _ = search(docs, entries, words, counts, short)
    placed = nodes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.coalesce("root", "rep").alias("component"))
    out = sets.join(placed, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


#: The same by SQL: pairs are formed from shared shingles, so it is meant for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0) x
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, both_ways.b FROM reach JOIN both_ways ON reach.y = both_ways.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id
"""
