import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, strategies as st
from lanternfish.llm import planes
from lanternfish.llm.frames import text_blocks
from tokenizers import Tokenizer

FILE = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    whole = Tokenizer.from_file(FILE)
    out, start = [], 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert sorted(map(tuple, planes.op5_token_planes(spark, small).collect())) == expected(docs)


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    shards = planes.write_token_planes(odd_docs, planes.write_target(spark, "t"), FILE, 2, kind="bit", block=1000)
    assert sorted(map(tuple, planes.read_token_planes(shards).collect())) == expected(odd_docs.collect())
    none = planes.write_token_planes(no_docs, planes.write_target(spark, "t"), FILE, 2)
    assert planes.read_token_planes(none).count() == 0


def test_null_ids_come_first(spark):
    docs = spark.createDataFrame([(2**62 + 1, "b c"), (None, "a"), (None, None)], "doc_id long, text string")
    shards = planes.write_token_planes(docs, planes.write_target(spark, "t"), FILE, 2)
    rows = sorted(planes.read_token_planes(shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 2**62 + 1] and sorted(r["n_tokens"] for r in rows) == [1, 2, 3]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@given(ids=st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_planes_round_trip(kind, ids):
    ids = np.array(ids, dtype="<u4")
    assert len(ids) == 0 or np.array_equal(planes.from_planes(planes.to_planes(ids, kind), len(ids), kind), ids)


WORDS = planes.WordIds(FILE, limit=40)  # so small that kept words are dropped again and again


@given(st.lists(st.text(alphabet=st.sampled_from("aBÉß.,;:!?#$%&*'s<|endoftext|>1 \t\n\x1c\x85 ́"), max_size=30), max_size=4))
def test_words_equal_whole_texts(texts):
    flat, lengths = WORDS.encode(pa.array(texts, pa.string()), 2)
    got = [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] if texts else []
    assert got == [WORDS.whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_every_latin_letter_and_mark():
    texts = [f"{chr(a)}{chr(b)}{m}" for a in range(0xC0, 0x180) for b in (0x61, 0xE9, 0x130) for m in ("", ".", "&&,")]
    flat, lengths = WORDS.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] == [WORDS.whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_blocks_hold_whole_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (0, 50, 3, 0, 9, 10, 200, 1)])], ["body"])
    parts = list(text_blocks(batch, "body", 10))
    assert pa.Table.from_batches(parts).column("body").to_pylist() == batch.column("body").to_pylist() and len(parts) > 3
    assert list(text_blocks(batch.slice(0, 0), "body", 10)) == []
