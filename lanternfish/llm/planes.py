"""Token ids in files of compressed byte or bit planes, with a chunk index.

A shard file holds, in this order: the magic, the compressed planes of each chunk, and a footer that is found from the
last 16 bytes (its offset as an unsigned 64-bit integer, then the magic again).  A chunk is ``block`` ids, the last
one fewer.  Its unsigned 32-bit ids are transposed into 4 byte planes or 32 bit planes; each plane is compressed with
zstandard alone, and a plane of zeros takes no bytes.  The footer (JSON, zstandard) is the index: for each chunk the
offset, the number of ids and the length of every plane, and for the documents their ids and lengths, in file order.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lanternfish.llm.frames import object_frame, text_blocks
from lanternfish.plans.staging import fresh_path, parts_for, stage

MAGIC = b"LFPLANE1"
BLOCK = 1 << 17
_LEVEL = 1
SHARD_BYTES = 128 << 20  # of text behind one shard, at most about
TEXT_BYTES = 4 << 20  # of text encoded at a time
HELD_BYTES, LONG = 192 << 20, 64  # of known words, about; longer words are not kept


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """4 byte planes (least significant first) or 32 bit planes of unsigned 32-bit ids; a zero plane is empty."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        planes = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        planes = np.ascontiguousarray(octets.T)
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    width = (n + 7) // 8 if kind == "bit" else n
    rows = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(width, np.uint8) for p in planes])
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
        return np.ascontiguousarray(rows).view("<u4").reshape(-1)
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


class ShardWriter:
    """Streams documents into one shard; the file gets its name only when it is complete."""

    def __init__(self, path: str, kind: str = "byte", block: int = BLOCK):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.at, self.kind, self.block = len(MAGIC), kind, block
        self.pending, self.held = [], 0
        self.chunks, self.docs, self.lengths = [], [], []
        self.press = zstandard.ZstdCompressor(level=_LEVEL)

    def add(self, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
        """Documents with the number of ids of each, and all their ids as unsigned 32-bit integers."""
        self.docs += doc_ids
        self.lengths += lengths
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(self.held - self.held % self.block)

    def _flush(self, n: int) -> None:
        flat = np.concatenate(self.pending)
        for a in range(0, n, self.block):
            ids = flat[a : min(a + self.block, n)]
            planes = [self.press.compress(p) if p else b"" for p in to_planes(ids, self.kind)]
            self.chunks.append([self.at, len(ids), *map(len, planes)])
            for p in planes:
                self.out.write(p)
                self.at += len(p)
        self.pending, self.held = [flat[n:].copy()], len(flat) - n

    def close(self) -> int:
        """Writes the rest and the index; the number of ids in the shard."""
        if self.held:
            self._flush(self.held)
        footer = self.press.compress(json.dumps({"kind": self.kind, "chunks": self.chunks, "docs": self.docs, "lengths": self.lengths}).encode())
        self.out.write(footer + self.at.to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)
        return sum(self.lengths)


def read_shard(path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) in file order, chunk by chunk through the index."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    unpress = zstandard.ZstdDecompressor()
    with fs.open_input_file(at) as f:
        size = f.size()
        f.seek(size - 16)
        tail = f.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no plane file")
        start = int.from_bytes(tail[:8], "little")
        f.seek(start)
        index = json.loads(unpress.decompress(f.read(size - 16 - start)))
        chunks = iter(index["chunks"])
        held = np.zeros(0, dtype="<u4")
        for doc, n in zip(index["docs"], index["lengths"]):
            parts, have = [held], len(held)
            while have < n:
                where, count, *lengths = next(chunks)
                f.seek(where)
                planes = [unpress.decompress(f.read(k)) if k else b"" for k in lengths]
                parts.append(from_planes(planes, count, index["kind"]))
                have += count
            flat = np.concatenate(parts)
            yield doc, flat[:n]
            held = flat[n:]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable Latin-1 ones stand for
    themselves, the others follow from U+0100 on in ascending order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordIds:
    """Ids of whitespace-separated words by the tokenizers library, each distinct word of a block looked up once.

    The normaliser drops white space and no token spans it, so a text's ids are those of its words in order.  Plain
    Latin words (and their trailing marks) are lower-cased and go to the tokenizer's model at once, as the normaliser
    leaves them as they are; every other word goes through the whole tokenizer.  Ids of plain words are kept from block to block.
    """

    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*]*)")

    def __init__(self, tokenizer_file: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_file)
        self.model = self.whole.model
        self.letters = byte_letters()
        self.limit = limit
        self.lower: dict[str, bytes] = {}
        self.seen: dict[str, bytes] = {}  # words as they stand, case and marks with them
        self.size = 0  # bytes held, about
        self.marks: dict[str, bytes] = {"": b""}

    def _whole(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain(self, low: str) -> bytes:
        spelled = low if low.isascii() else "".join([self.letters[b] for b in low.encode()])
        ids = [t.id for t in self.model.tokenize(spelled)]
        return np.array(ids, dtype="<u4").tobytes() if len(ids) > 1 else ids[0].to_bytes(4, "little")

    def words(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        if len(self.lower) + len(self.seen) > self.limit or self.size > HELD_BYTES:
            self.lower.clear()
            self.seen.clear()
            self.size = 0
        out = []
        for w in words:
            ids = self.seen.get(w)
            if ids is None:
                ids = self._word(w)
                if len(w) <= LONG:
                    self.seen[w] = ids
                    self.size += 250 + len(w) + len(ids)
            out.append(ids)
        return out

    def _word(self, w: str) -> bytes:
        m = self.PLAIN.fullmatch(w)
        if not m:
            return self._whole(w) if w else b""
        core, mark = m.groups()
        low = core.lower()
        ids = self.lower.get(low)
        if ids is None:
            ids = self._plain(low)
            if len(low) <= LONG:
                self.lower[low] = ids
                self.size += 250 + len(low) + len(ids)
        if mark:
            if mark not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks = {"": b""}
                self.marks[mark] = self._whole(mark)
            ids += self.marks[mark]
        return ids

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts put together, and the number of ids of each, with ``end_id`` behind each if it is given."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        counts = np.diff(lists.offsets.to_numpy())
        known = self.words(words.dictionary.to_pylist())
        index = words.indices.to_numpy()
        text = np.repeat(np.arange(len(counts)), counts)
        if end_id is not None:
            known.append(int(end_id).to_bytes(4, "little"))
            all_index = np.full(len(index) + len(counts), len(known) - 1, dtype=np.int64)
            all_index[np.arange(len(index)) + text] = index  # one place is left behind each text
            index, text = all_index, np.repeat(np.arange(len(counts)), counts + 1)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        each = sizes[index]
        to = np.cumsum(each) - each
        flat = np.frombuffer(b"".join(known), dtype="<u4")[np.repeat(starts[index] - to, each) + np.arange(each.sum())]
        return flat, np.bincount(text, weights=each, minlength=len(counts)).astype(np.int64)


_WORDS: dict[str, WordIds] = {}


def words_for(tokenizer_file: str) -> WordIds:
    if tokenizer_file not in _WORDS:
        _WORDS[tokenizer_file] = WordIds(tokenizer_file)
    return _WORDS[tokenizer_file]


def write_token_planes(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                       kind: str = "byte", block: int = BLOCK) -> DataFrame:
    """Encode every text, add ``end_id``, and write shards whose names and contents run in ascending id order.

    Gives one row for each shard: shard, path, n_docs, n_tokens, start (ids of all shards before it).  Null texts count
    as empty; rows with equal ids stand next to each other, in order of their texts' hashes; null ids come first.
    """
    id = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(id, F.lit(-(2**63))).alias("id"), id.isNull().alias("none"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    parts = parts_for(docs.sparkSession, size, SHARD_BYTES)
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", F.xxhash64("body"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}.planes"
        writer = None
        words = words_for(tokenizer_file)
        for part in chain.from_iterable(text_blocks(b, "body", TEXT_BYTES) for b in batches):
            ids, lengths = words.encode(part.column("body"), end_id)
            names = [None if none else d for d, none in zip(part.column("id").to_pylist(), part.column("none").to_pylist())]
            writer = writer or ShardWriter(path, kind, block)
            writer.add(names, lengths.tolist(), ids)
        if writer:
            n = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(writer.docs)]), pa.array([n])], ["shard", "path", "n_docs", "n_tokens"])

    shards = stage(ordered.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "plane-shards")
    listed = sorted(map(tuple, shards.collect()))  # one short row a shard
    starts = np.cumsum([0] + [n for *_, n in listed]).tolist()
    return docs.sparkSession.createDataFrame([(*row, s) for row, s in zip(listed, starts)], "shard int, path string, n_docs long, n_tokens long, start long")


def read_token_planes(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files of ``write_token_planes``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"].tolist()):
                rows = []
                for doc, ids in read_shard(path):
                    rows.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids))))
                    start += len(ids)
                yield object_frame(rows, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(parts_for(shards.sparkSession, shards.count(), 1), "shard").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_target(spark: SparkSession, name: str) -> str:
    """A new folder beside the other shared tables, as a URI."""
    path = fresh_path(spark, name)
    return path if re.match(r"[a-z0-9]+:/", path) else f"file://{path}"


def op5_token_planes(spark, sf_dir: str) -> DataFrame:
    """Write the ids of every document as planes and report what is read back from the files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_planes(write_token_planes(docs, write_target(spark, "token-planes"), public_tokenizers.path("word_bpe_49k.json"), 2))
