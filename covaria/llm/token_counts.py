"""Token counts: batch encoding in an Arrow function that returns lengths only.

White space is a safe boundary of this tokenizer: it is dropped, no token, special string or
normalisation reaches across it. So every text, however long, is split there, and pieces that a worker
has not counted yet are encoded in batches balanced by bytes. A bounded table keeps their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from covaria.llm.common import arrow_map, table, utf8_rows

LIMIT = 2048


class Counter:
    """Counts tokens of texts with one tokenizer file; holds at most `most` pieces and their lengths."""

    def __init__(self, path: str, most: int = 1 << 19, batch_bytes: int = 1 << 19):
        self.most, self.batch_bytes, self.known = most, batch_bytes, {}
        self.model = self.pieces = None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            self.tokens = Tokenizer.from_file(path)
            self.tokens.no_truncation()
            self.tokens.no_padding()
            #: only a tokenizer that drops white space may be split there
            self.splits = '"Replace"' in self.tokens.to_str()[:4000] and self.tokens.encode(" \n ", add_special_tokens=False).ids == []

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokens.encode_batch_fast(texts, add_special_tokens=False)]

    def _balanced(self, texts: list[str]) -> Iterator[list[str]]:
        """Runs of texts of about batch_bytes each."""
        run, size = [], 0
        for x in texts:
            run.append(x)
            size += len(x)
            if size >= self.batch_bytes:
                yield run
                run, size = [], 0
        if run:
            yield run

    def count(self, texts: list[bytes]) -> list[int]:
        if self.model is not None:
            return [len(x) for x in self.model.encode([t.decode() for t in texts], num_threads=1)]
        if not self.splits:
            return [n for run in self._balanced([t.decode() for t in texts]) for n in self._encode(run)]
        out = []
        for t in texts:
            words = t.split()
            try:
                out.append(sum(map(self.known.__getitem__, words)))
            except KeyError:
                if len(self.known) > self.most:
                    self.known.clear()
                new = list({w for w in words if w not in self.known})
                for run in self._balanced([w.decode() for w in new]):
                    self.known.update(zip([w.encode() for w in run], self._encode(run), strict=True))
                out.append(sum(map(self.known.__getitem__, words)))
        return out


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Null text counts as empty (0 bytes, 0 tokens); special strings inside texts are handled as the
    library does by default; nothing is truncated. Repeated rows give repeated results; other columns
    are ignored; an empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            texts = utf8_rows(batch.column(1))
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").transform(arrow_map, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
