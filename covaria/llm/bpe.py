"""BPE encoding and decoding as streaming transducers with bounded lookahead.

Encoding. Let a text be cut anywhere. The greedy merges of the part before the cut differ from those of
the whole only behind a frontier. The frontier starts at the cut; a merge e+f of rank r can move it left
over e only if f starts with the symbol that the last move went over, and r is above that move's rank.
So the longest such chain of merges, weighed by the lengths of their left sides, bounds how far a later
symbol can act: that is the merge list's sufficient lookahead, which `Merges` computes by one pass in
rank order. The encoder keeps a window of symbols and emits the tokens that end before the lookahead.

Decoding. A state machine holds the bytes of a character that is not complete yet and emits the rest.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from covaria.llm.common import arrow_map, table, utf8_rows

_INF = 1 << 60
WINDOW = 256
#: Bytes of text that are held as tokens at once.
CHUNK = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class Merges:
    """A merge list over ids: ranks of pairs, results by rank, and the sufficient lookahead in symbols."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        self.rank, self.result = {}, []
        made: dict[str, list[str]] = defaultdict(list)  # left parts of each merged symbol
        far: dict[str, int] = {}  # the longest chain that ends with a merge of this left part
        self.lookahead = 1
        size = lambda x: len(x.removesuffix(suffix) if suffix else x)
        for r, (a, b) in enumerate(pairs):
            self.rank[vocab[a], vocab[b]] = r
            self.result.append(vocab[a + b])
            longest, todo = 0, [b]
            while todo:
                x = todo.pop()
                longest = max(longest, far.get(x, 0))
                todo += made[x]
            chain = size(a) + longest
            far[a] = max(far.get(a, 0), chain)
            self.lookahead = max(self.lookahead, chain)
            made[a + b].append(a)

    def apply(self, symbols: list[int]) -> list[int]:
        """The greedy merges of a list of symbols: always the lowest rank, then the leftmost place."""
        rank, result, s = self.rank.get, self.result, symbols
        near = [rank(p, _INF) for p in zip(s, s[1:])]
        while near and (least := min(near)) != _INF:
            i = near.index(least)
            s[i : i + 2] = [result[least]]
            del near[i]
            if i:
                near[i - 1] = rank((s[i - 1], s[i]), _INF)
            if i < len(near):
                near[i] = rank((s[i], s[i + 1]), _INF)
        return s


class Encoder:
    """Streams one pre-token's symbols in and its tokens out; holds window + lookahead symbols at most."""

    def __init__(self, merges: Merges, lengths: dict[int, int], window: int = WINDOW):
        self.merges, self.lengths, self.window = merges, lengths, window
        self.held: list[int] = []

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        for x in symbols:
            self.held.append(x)
            if len(self.held) >= self.window + self.merges.lookahead:
                stable, at = len(self.held) - self.merges.lookahead, 0
                for token in self.merges.apply(self.held[:]):
                    if at + self.lengths[token] > stable:
                        break
                    at += self.lengths[token]
                    yield token
                del self.held[:at]

    def end(self) -> list[int]:
        out, self.held = self.merges.apply(self.held), []
        return out


class Kinds(dict):
    """Stands for characters in str.translate by one of their kind: letter a, number 1, space, other !.

    The kinds of characters beyond Latin are those of the tokenizer's own Unicode tables, asked for once
    each; a character up to U+024F stands for itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        tokens = Tokenizer.from_file(path)
        self.split, self.normalizer = tokens.pre_tokenizer.pre_tokenize_str, tokens.normalizer

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if code <= 0x24F:
            kind = c
        elif len(self.split(f"a{c}a")) == 1:
            kind = "a"
        elif len(self.split(f"!{c}!")) == 1:
            kind = "!"
        else:
            kind = "1" if len(self.split(f"{c}a")) == 2 and self.split(f"1{c}")[-1][1] != (0, 1) else " "
        self[code] = kind
        return kind


class Tokens:
    """A tokenizer file's normalisation, pre-tokens, merges and decoder."""

    def __init__(self, path: str, window: int = WINDOW, most: int = 1 << 16):
        import regex

        self.kinds = Kinds(path)

        spec = json.load(open(path, encoding="utf-8"))
        model, self.vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.words = spec["normalizer"] is not None  # lower case, white space dropped
        self.byte_decoder = spec["decoder"] is not None
        chars = byte_symbols()
        self.base = [self.vocab[c] for c in chars]
        self.last = [self.vocab[c + self.suffix] for c in chars]
        self.merges = Merges(self.vocab, model["merges"], self.suffix)
        self.lengths = {i: len(t.removesuffix(self.suffix) if self.suffix else t) for t, i in self.vocab.items()}
        self.window, self.most = window, most
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)))
        #: The pre-token patterns of the two kinds of file.
        if self.words:
            self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        else:
            self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
        byte_of = {c: b for b, c in enumerate(chars)}
        special = {i: t for t, i in self.special.items()}
        self.bytes: dict[int, bytes] = {}
        for t, i in self.vocab.items():
            self.bytes[i] = bytes(map(byte_of.__getitem__, t)) if self.byte_decoder and i not in special else t.encode()
        self.bytes |= {i: t.encode() for i, t in special.items()}
        self.known: dict[str, bytes] = {}

    def _pretoken(self, word: str) -> bytes:
        """A pre-token's ids as little-endian uint32."""
        data = word.encode()
        symbols = [self.base[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        stream = Encoder(self.merges, self.lengths, self.window)
        return array("I", [*stream.feed(symbols), *stream.end()]).tobytes()

    def _plain(self, text: str) -> bytes:
        if text.isascii() and text.isalpha():  # one pre-token of either kind
            return self._known(text.lower() if self.words else text)
        beyond = bool(text) and max(text) > "\u024f"
        if self.words:
            text = self.kinds.normalizer.normalize_str(text) if beyond else unicodedata.normalize("NFC", text).lower()
        if beyond:
            found = [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.kinds))]
        else:
            found = self.pattern.findall(text)
        return b"".join(map(self._known, found))

    def _known(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self._pretoken(word)
            if len(word) <= 64:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian uint32; special strings become their ids."""
        out, at = [], 0
        for m in self.cut.finditer(text) if "<|" in text else ():
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        out.append(self._plain(text[at:]) if at else self._plain(text))
        return b"".join(out)

    def decoder(self) -> Decoder:
        return Decoder(self)


class Decoder:
    """Streams ids in and text out; its state is whether a token came before, and part of a character."""

    def __init__(self, tokens: Tokens):
        self.bytes, self.joint = tokens.bytes, b"" if tokens.byte_decoder else b" "
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        parts = self.joint.join(map(self.bytes.__getitem__, ids))
        if self.begun and parts:
            parts = self.joint + parts
        self.begun = self.begun or bool(parts)
        return self.machine.decode(parts)

    def end(self) -> str:
        return self.machine.decode(b"", True)


class Pieces:
    """ids and decoded bytes of texts; with a tokenizer that drops white space, by remembered pieces.

    White space bounds every token there, so both transducers are in the same state at each piece's
    start, and a piece's output can be used again. At most `most` short pieces are remembered.
    """

    def __init__(self, path: str, most: int = 1 << 19):
        self.tokens, self.most = Tokens(path), most
        self.ids: dict[bytes, bytes] = {}
        self.text: dict[bytes, bytes] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}

    def _word(self, word: str) -> tuple[bytes, bytes]:
        """ids and decoded bytes of one pre-token."""
        found = self.words.get(word)
        if found is None:
            ids, machine = self.tokens._known(word), self.tokens.decoder()
            found = ids, (machine.feed(array("I", ids)) + machine.end()).encode()
            if len(self.words) > self.most:
                self.words.clear()
            self.words[word] = found
        return found

    def _learn(self, piece: bytes) -> None:
        text = piece.decode()
        head = text.rstrip(".,;:!?")
        if head.isalpha() and max(head) <= "\u024f" and "\u0130" not in head:
            # Latin letters, composed as they are, and a run of marks: two pre-tokens
            found = [self._word(w) for w in (head.lower(), text[len(head) :]) if w]
            self.ids[piece], self.text[piece] = b"".join([f[0] for f in found]), b" ".join([f[1] for f in found])
            return
        ids, machine = self.tokens.encode(text), self.tokens.decoder()
        self.ids[piece], self.text[piece] = ids, (machine.feed(array("I", ids)) + machine.end()).encode()

    def stream(self, text: bytes, chunk: int = CHUNK) -> Iterator[tuple[bytes, bytes]]:
        """ids and decoded bytes, part by part. Where white space bounds every token, a part ends at the first white space
        after `chunk` bytes; a text of another tokenizer is one part of ids, decoded in runs of as many ids."""
        if not self.tokens.words:
            ids, machine = self.tokens.encode(text.decode()), self.tokens.decoder()
            for at in range(0, len(ids), 4 * chunk):
                part = ids[at : at + 4 * chunk]
                yield part, machine.feed(array("I", part)).encode()
            yield b"", machine.end().encode()
            return
        at, begun = 0, False
        while at < len(text):
            end = len(text)
            if at + chunk < end:
                found = _SPACE.search(text, at + chunk)
                end = found.start() if found else end
            ids, decoded = self._part(text[at:end])
            at = end
            yield ids, (b" " + decoded if begun and decoded else decoded)
            begun = begun or bool(decoded)

    def _part(self, text: bytes) -> tuple[bytes, bytes]:
        pieces = text.split()
        try:
            found = list(map(self.ids.__getitem__, pieces))
        except KeyError:
            if len(self.ids) > self.most:
                self.ids.clear()
                self.text.clear()
            for p in pieces:
                if p not in self.ids:
                    self._learn(p)
            found = list(map(self.ids.__getitem__, pieces))
        return b"".join(found), b" ".join(filter(None, map(self.text.__getitem__, pieces)))

    def __call__(self, text: bytes) -> tuple[bytes, bytes]:
        parts = list(self.stream(text))
        return b"".join(p[0] for p in parts), b"".join(p[1] for p in parts)


def bpe_round_trip(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; with texts, also ids and decoded.

    Null text counts as empty: no tokens, the hashes of nothing. Repeated rows give repeated results,
    a null doc_id stays null, other columns are ignored; an empty table gives an empty result. A text of
    any length is encoded, decoded and hashed part by part.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            rows = []
            for t in utf8_rows(batch.column(1)):
                n, a, b, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids, decoded in pieces.stream(t):
                    n += len(ids) // 4
                    a.update(ids)
                    b.update(decoded)
                    if texts:
                        kept.append((ids, decoded))
                row = (n, a.hexdigest(), b.hexdigest())
                rows.append((*row, list(array("I", b"".join(x for x, _ in kept))), b"".join(x for _, x in kept).decode()) if texts else row)
            if not rows:
                continue
            n, a, b, *more = zip(*rows, strict=True)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if texts:
                columns += [pa.array(more[0], pa.list_(pa.int64())), pa.array(more[1], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").transform(arrow_map, run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
