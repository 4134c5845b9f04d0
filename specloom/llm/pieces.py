"""SentencePiece encoding and decoding with a distinct-chunk table.

No piece of the vocabulary holds a white-space marker after another character (checked when the model is
read), so no merge crosses a marked word: each distinct marked word of a task is segmented once, its ids are
kept in the task's table of distinct words, and a text's ids are the words' ids joined by position. The table is bounded in bytes and
emptied when full. A table of all words of the corpus would cost a shuffle of every word's position twice; a task's own costs none and
segments a word again only once a task. A model whose pieces do cross markers is applied to whole texts.

Null text: as the empty text, which has the end id alone and decodes to the empty text. Words of any length
are segmented whole. Rows repeat as they come; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from specloom.llm.common import Memo, over_batches, small_batches

#: The white-space marker of the library.
MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Text to ids and back by distinct marked words; ``most`` bounds the table's bytes."""

    def __init__(self, model: bytes, most: int = 64 << 20):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.end = self.sp.eos_id()
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.whole = any(MARK in p.lstrip(MARK) for p in pieces) or self.sp.encode("a") != self.sp.encode("a", add_bos=False) or self.sp.id_to_piece(self.sp.encode(" a"))[0][0] != MARK
        self.rows = Memo(most)

    def row(self, chunk: str) -> tuple[str, str]:
        """chunk: a marked word without its first marker. Its ids as text, its decoded text."""
        found = self.rows.get(chunk)
        if found is None:
            ids = self.sp.encode(chunk) if chunk else [self.sp.piece_to_id(MARK)]
            found = self.rows.put(chunk, (" ".join(map(str, ids)), self.sp.decode(ids) if chunk else ""))
        return found

    def chunks(self, text: str) -> list[str]:
        """The marked words of a text that is not empty, each without its first marker."""
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [x[1:] for x in re.findall(" +[^ ]*", " " + text)]
        return text.split(" ")

    def encode(self, text: str) -> tuple[str, str]:
        """ids with the end id, joined by one space, and the decoded text."""
        if not text:
            return str(self.end), ""
        if self.whole:
            ids = self.sp.encode(text)
            return " ".join(map(str, [*ids, self.end])), self.sp.decode([*ids, self.end])
        known, row = self.rows.get, self.row
        both = [known(x) or row(x) for x in self.chunks(text)]
        return " ".join([x[0] for x in both]) + f" {self.end}", " ".join([x[1] for x in both])


def encode_documents(docs: DataFrame, model: str | None = None, digests_only: bool = False, most: int = 64 << 20) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), or with ``digests_only`` (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    proto = Path(model or default_model()).read_bytes()  # of fixed size; goes with the tasks
    rest = [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests_only else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *rest])

    def make():
        table = ChunkTable(proto, most)

        def step(batch: pa.RecordBatch) -> dict:
            both = [table.encode(x or "") for x in batch.column("text").to_pylist()]
            out = {"doc_id": batch.column("doc_id"), "n_tokens": [x.count(" ") + 1 for x, _ in both]}
            if digests_only:
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                return out | {"ids_sha256": [sha(x) for x, _ in both], "decoded_sha256": [sha(x) for _, x in both]}
            return out | {"ids": [np.fromstring(x, np.int32, sep=" ") for x, _ in both], "decoded": [x for _, x in both]}

        return step

    kinds = "ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded string"
    return small_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(over_batches(make, schema), f"doc_id bigint, n_tokens bigint, {kinds}")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests_only=True)
