import hashlib

import public_tokenizers
import sentencepiece
from lanternfish.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def expected(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = []
    for r in rows:
        ids = model.encode(r["text"] or "")
        text = model.decode(ids) if ids else ""
        out.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def test_query_equals_the_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert sorted(map(tuple, pieces.op6_sentencepiece(spark, small).collect())) == expected(docs.collect())


def test_odd_rows_and_empty_table(odd_docs, no_docs):
    assert sorted(map(tuple, pieces.piece_digests(odd_docs, MODEL).collect())) == expected(odd_docs.collect())
    assert pieces.piece_digests(no_docs, MODEL).count() == 0


def test_round_trip(odd_docs):
    encoded = pieces.encode_pieces(odd_docs, MODEL)
    texts = {r["doc_id"]: r["text"] for r in pieces.decode_pieces(encoded, MODEL).collect()}
    for r in odd_docs.collect():
        assert texts[r["doc_id"]] == (r["text"] or "").replace("▁", " ")


def test_full_table_starts_anew():
    table = pieces.ChunkTable(MODEL, limit=2)
    texts = ["a b c d", "a b", "e f g a", " a  b "]
    assert list(table.encode(texts)) == table.model.encode(texts)


def test_texts_without_spaces_in_bounded_memory(monkeypatch):
    """Distinct long chunks are not kept, and short ones no further than the bound."""
    import random
    import tracemalloc

    rng = random.Random(4)
    long = ("".join(rng.choices("abcdefghij", k=3000)) for _ in range(1500))
    table = pieces.ChunkTable(MODEL)
    tracemalloc.start()
    n = sum(len(ids) for ids in table.encode(long))
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n > 1_000_000 and held < 5 << 20 and most < 40 << 20 and not table.ids
    monkeypatch.setattr(pieces, "TABLE_BYTES", 100_000)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(40)) for _ in range(60)]
    assert list(table.encode(texts)) == table.model.encode(texts)
    assert table.size < 130_000
