"""SentencePiece encoding and decoding with a table of distinct whitespace-marked chunks.

No piece of the model has a whitespace marker after another character, so merges never cross from a word into the
next marker: the encoding of a text is the concatenation of the encodings of its chunks (a run of markers and the word
behind it).  Each task keeps a table of the distinct chunks met so far, segments a chunk when it is first seen, and joins
the ids back by position.  The table is bounded by entries and by bytes, and long chunks are kept for their own text only; when full it starts anew, which costs time and changes no result.
The table lives in the worker rather than in a shuffled relation, because one row for each word occurrence would move
several times the input.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from lanternfish.llm.frames import object_frame

TABLE_LIMIT, TABLE_BYTES = 600_000, 160 << 20
LONG = 64  # characters of a chunk that is segmented anew in each text rather than kept
MARKER = "▁"
_CHUNK = re.compile(r" *[^ ]+| +")


def check_marker_rule(model: sentencepiece.SentencePieceProcessor) -> None:
    """Raise if some piece carries a marker behind another character: chunks could then not be cut apart."""
    for i in range(model.get_piece_size()):
        if MARKER in model.id_to_piece(i).lstrip(MARKER):
            raise ValueError(f"piece {i} crosses a whitespace marker")


class ChunkTable:
    """Distinct chunks with their ids, as tuples of ints and as decimal text."""

    def __init__(self, model_file: str, limit: int = TABLE_LIMIT):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        check_marker_rule(self.model)
        self.limit = limit
        self.ids: dict[str, tuple[int, ...]] = {}
        self.size = 0  # bytes held, about

    def chunks(self, text: str) -> list[str]:
        """Chunks without their first marker, which the encoder adds in front of every input."""
        if MARKER in text:
            text = text.replace(MARKER, " ")
        if not text:
            return []
        if text[0] != " " and text[-1] != " " and "  " not in text:
            return text.split(" ")
        return [c[1:] for c in _CHUNK.findall(" " + text)]

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text; only chunks that are not in the table yet are segmented, each once."""
        for text in texts:
            parts = self.chunks(text)
            if len(self.ids) > self.limit or self.size > TABLE_BYTES:
                self.ids.clear()
                self.size = 0
            table, own = self.ids, {}
            new = [c for c in dict.fromkeys(parts) if c not in table]
            if new:
                for chunk, ids in zip(new, self.model.encode(new, num_threads=1)):
                    if len(chunk) > LONG:
                        own[chunk] = ids
                    else:
                        table[chunk] = tuple(ids)
                        self.size += 200 + 2 * len(chunk) + 36 * len(ids)
                if "" in new:  # a single marker: the encoder gives nothing for an empty input
                    table[""] = (self.model.piece_to_id(MARKER),)
            yield list(chain.from_iterable([own[c] if c in own else table[c] for c in parts] if own else map(table.__getitem__, parts)))

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


_TABLES: dict[str, ChunkTable] = {}


def table_for(model_file: str) -> ChunkTable:
    """The table of this Python worker, kept for the tasks that follow in it."""
    if model_file not in _TABLES:
        _TABLES[model_file] = ChunkTable(model_file)
    return _TABLES[model_file]


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row, as the library encodes without begin or end ids.

    A null or empty text gives an empty array.  Repeated rows are encoded each; other columns are ignored.
    """

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(x, dtype=np.int32) for x in table_for(model_file).encode(t or "" for t in texts)], dtype=object)

    return docs.select(F.col(id_col), encode(F.col(text_col)).alias("ids"))


def decode_pieces(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from arrays of ids; a null array gives an empty text."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        table = table_for(model_file)
        return pd.Series([table.decode([int(i) for i in x]) if x is not None and len(x) else "" for x in rows], dtype=object)

    return encoded.select(F.col(id_col), decode(F.col(ids_col)).alias("text"))


def piece_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, without shipping the ids to the JVM."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        table = table_for(model_file)
        rows = []
        for ids in table.encode(t or "" for t in texts):
            decoded = table.decode(ids) if ids else ""
            rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()))
        return object_frame(rows, ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), digest(F.col(text_col)).alias("d")).select(id_col, "d.*")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Digest of ids and of the decoded text of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
