"""Token counts: texts go to the tokenizer in Arrow batches, lengths come back.

A batch of rows is encoded in groups of about equal bytes; a text above
``PIECE_BYTES`` is cut where cutting cannot change its tokens and its pieces'
counts add up. For a sentencepiece model such a place is one space with a
non-space on either side: no piece of the vocabulary spans one (which is
checked), and the dummy space put before each text stands for the one cut off.
For a byte-level tokenizer no cut is used: its library takes whole texts.

Tasks are balanced by the scan, which deals files out by bytes.

Edge cases: null and empty texts have 0 tokens; repeated rows each give a row;
an empty table gives no rows; further columns are ignored; a text without a
safe place is encoded whole.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import bounded, tidy

PIECE_BYTES = 16 << 10
GROUP_BYTES = 256 << 10
_loaded: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Counts by a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        inner = any(mark in p.lstrip(mark) for p in map(self.model.id_to_piece, range(self.model.get_piece_size())))
        plain = self.model.encode("a", out_type=str)[:1] in ([mark + "a"], [mark]) and self.model.encode("a  b ", out_type=str) != self.model.encode("a b", out_type=str)
        self.cuts = not inner and plain  # else pieces may span a space, or runs of spaces collapse

    def pieces(self, text: str) -> list[str]:
        if not self.cuts or len(text) <= PIECE_BYTES:
            return [text]
        out, at = [], 0
        while len(text) - at > PIECE_BYTES:
            cut = text.rfind(" ", at + 1, at + PIECE_BYTES)
            while cut > at and (text[cut - 1] in " ▁" or text[cut + 1] in " ▁"):
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:  # none so far back: the next one after
                cut = text.find(" ", at + PIECE_BYTES)
                while 0 < cut < len(text) - 1 and (text[cut - 1] in " ▁" or text[cut + 1] in " ▁"):
                    cut = text.find(" ", cut + 1)
                if not 0 < cut < len(text) - 1:
                    break
            out.append(text[at:cut])
            at = cut + 1
        return [*out, text[at:]]

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


class ByteCounter:
    """Counts by a tokenizers file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def pieces(self, text: str) -> list[str]:
        return [text]

    def count(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]


def counter(path: str):
    if path not in _loaded:
        _loaded[path] = ByteCounter(path) if path.endswith(".json") else PieceCounter(path)
    return _loaded[path]


def _counter_of(name: str, path: str | None):
    def run(batches):
        c = counter(path or tokenizer_path(name))
        for b in batches:
            texts = b.column("text").to_pylist()
            total = [0] * len(texts)
            group, who, size = [], [], 0

            def flush():
                for i, n in zip(who, c.count(group), strict=True):
                    total[i] += n

            for i, text in enumerate(texts):
                for p in c.pieces(text) if text else ():
                    group.append(p)
                    who.append(i)
                    size += len(p) if p.isascii() else len(p.encode())
                    if size >= GROUP_BYTES:
                        flush()
                        group, who, size = [], [], 0
            if group:
                flush()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(total, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs(doc_id, text).

    ``path`` gives the file itself; else ``tokenizer`` is looked up on the executor.
    """
    bounded(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_counter_of(tokenizer, path)), "doc_id long, n_bytes long, n_tokens long")
