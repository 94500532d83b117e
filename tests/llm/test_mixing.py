import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from lanternfish.llm import mixing, text_contexts
from pyspark.sql import functions as F


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def base(rows):
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    counts = Counter(t for r in train for t in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    out = []
    for r in rows:
        ts = tokens(r["text"])
        out.append((r["doc_id"], len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)))
    return sorted(out)


def check(rows, found):
    got = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found)
    want = base(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-9, atol=1e-9)
    assert all(r["score"] < 0 for r in found)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    found = mixing.op10_context_mixing(spark, folder).collect()
    check(rows, found)
    held = [r for r in found if r["held_out"]]
    assert len(held) > 50 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in found)
    size = {r["doc_id"]: len((r["text"] or "").encode()) for r in rows}
    bits = -sum(r["score"] for r in held) / math.log10(2) / sum(size[r["doc_id"]] for r in held)
    print("bits a byte on held-out texts", bits, "base", -sum(r["base_score"] for r in held) / math.log10(2) / sum(size[r["doc_id"]] for r in held))
    assert bits < 2.6


def test_rare_words_take_the_join(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "COMMON", 50)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(docs.collect(), mixing.score_texts(docs, ~mixing.in_fold("doc_id")).collect())


def test_odd_rows(spark, odd_docs, no_docs):
    check(odd_docs.collect(), mixing.score_texts(odd_docs, ~mixing.in_fold("doc_id")).collect())
    assert mixing.score_texts(no_docs, ~mixing.in_fold("doc_id")).count() == 0
    none = mixing.score_texts(odd_docs.where("doc_id = 5"), F.lit(False)).collect()
    assert none and all(r["n_known"] == 0 and r["base_score"] == 0 for r in none)


def trained(segs):
    sizes = (*mixing.ORDER_BITS, 16)
    tables = [np.zeros((1 << b, 2)) for b in sizes]
    data, offsets, _ = next(mixing.pieces([s for s, _ in segs]))
    where, bits = mixing.cells(data, offsets, sizes)
    n = np.repeat([float(n) for _, n in segs], np.diff(offsets) * 8)
    for t, at in zip(tables, where):
        np.add.at(t.reshape(-1), 2 * at.reshape(-1) + bits.reshape(-1), n)
    return mixing.Model([mixing.packed_counts(t[:, 0], t[:, 1]) for t in tables], mixing.Mixer.fresh())


def test_probabilities_add_up():
    """Over all next bytes in a segment the model's probabilities sum to one."""
    model = trained([(s + b" ", 2) for s in b"abc abd abc xyz".split()])
    two = model.costs([b"ab"])[0]
    assert sum(10 ** (model.costs([b"ab" + bytes([c]) for c in range(256)]) - two)) == pytest.approx(1.0, abs=1e-6)


def slow_cost(model, seg):
    """A bit at a time, from counts found by the contexts' own bytes (no tables): what the hashed tables must give without collisions."""
    total = 0.0
    for at in range(0, len(seg), mixing.PIECE):
        piece = seg[at : at + mixing.PIECE]
        for i, byte in enumerate(piece):
            for j in range(8):
                x, seen = [], []
                for kind in range(mixing.KINDS):
                    past = piece[max(0, i - kind - 1) : i] if kind < mixing.KINDS - 1 else piece[:i]
                    zeros = ones = 0
                    for other, n in SEGS:
                        for k in range(len(other)):
                            theirs = other[max(0, k - kind - 1) : k] if kind < mixing.KINDS - 1 else other[:k]
                            whole = len(theirs) == len(past) if kind < mixing.KINDS - 1 else k == i
                            if whole and theirs == past and other[k] >> (8 - j) == byte >> (8 - j):
                                bit = other[k] >> (7 - j) & 1
                                ones, zeros = ones + n * bit, zeros + n * (1 - bit)
                    x.append(math.log(ones + 0.4) - math.log(zeros + 0.4))
                    seen.append(zeros + ones)
                gate = 4 * min(4, math.ceil(math.log2(seen[-1] + 1) / 2)) + min(3, math.ceil(math.log2(seen[-2] + 1) / 3))
                z = sum(w * v for w, v in zip(model.mixer.weights[gate], [*x, 1.0]))
                slot = min(max((z + 8) * 2, 0), 32 - 1e-6)
                low = int(slot)
                fine = model.mixer.refined[gate][low] * (1 - slot + low) + model.mixer.refined[gate][low + 1] * (slot - low)
                p = min(max(0.5 / (1 + math.exp(-z)) + 0.5 * fine, 1e-6), 1 - 1e-6)
                total += math.log10(p if byte >> (7 - j) & 1 else 1 - p)
    return total


SEGS = [(b"abc ", 3), (b"abd\xff", 2), (b"xyz ", 1), (b"abcabc ", 5), (b" ", 4)]


def test_costs_equal_a_slow_model():
    model = trained(SEGS)
    for seg in (b"abc ", b"abx ", b"q", b"abcabd\xff", b" "):
        assert model.costs([b"zz", seg])[1] == pytest.approx(slow_cost(model, seg), rel=1e-5)


def test_whole_scores_are_sums_of_costs(spark, small):
    """The query's score against every text's segments coded one by one with the same model."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    rows = docs.collect()
    kept = {}
    real = mixing.coded_segments

    def spy(segs, words, tables, mixer):
        kept["model"] = mixing.Model(tables.value.tables(), mixer)
        return real(segs, words, tables, mixer)

    mixing.coded_segments = spy
    try:
        found = {r["doc_id"]: r for r in mixing.score_texts(docs, ~mixing.in_fold("doc_id")).collect()}
    finally:
        mixing.coded_segments = real
    for r in rows:
        raw = (r["text"] or "").encode()
        segs = re.findall(rb"[^\x20\x09-\x0D\xff]*[\x20\x09-\x0D\xff]", raw + b"\xff")
        score = kept["model"].costs(segs).sum()
        assert found[r["doc_id"]]["score"] == pytest.approx(score, rel=1e-9)
        assert found[r["doc_id"]]["bits_per_byte"] == pytest.approx(-score / math.log10(2) / (len(raw) + 1), rel=1e-9)


def test_long_token_in_bounded_memory():
    import tracemalloc

    model = trained(SEGS)
    seg = b"abcd" * 1_000_000
    tracemalloc.start()
    cost = model.costs([seg])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cost < 0 and most < 300 << 20


def test_scores_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before, found = {k: spark.conf.get(k) for k in keys}, []
    try:
        for parts, rows in ((2, 50), (64, 2000)):
            for k, v in zip(keys, (parts, "false", rows)):
                spark.conf.set(k, v)
            found.append({r["doc_id"]: r["score"] for r in mixing.score_texts(docs.repartition(parts), ~mixing.in_fold("doc_id")).collect()})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0].keys() == found[1].keys()
    assert all(found[1][d] == pytest.approx(x, rel=1e-9) for d, x in found[0].items())


def test_texts_without_spaces_are_sent_by_bytes():
    """What a task holds of distinct long segments before it sends them on is bounded by bytes."""
    import pyarrow as pa

    rng = np.random.default_rng(1)

    class Frame:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def groupBy(self, *_):
            return self

        def agg(self, *_):
            return self.run

    run = mixing.count_segments(Frame())
    text = lambda: rng.integers(97, 123, 3_000, dtype=np.uint8).tobytes().decode()
    batch = lambda: pa.RecordBatch.from_pydict({"body": [text() for _ in range(1_000)], "learn": [True] * 1_000})
    sizes = [b.column("seg").nbytes for b in run(batch() for _ in range(60))]
    assert len(sizes) >= 3 and sum(sizes) > 170e6 and max(sizes) < 60e6


def running_contexts(text):
    """(contexts, byte) of every byte of one text, from the bytes themselves."""
    raw, word = text + b"\xff", 0
    for i, byte in enumerate(raw):
        yield (*(raw[max(0, i - order) : i] if i >= order else (raw[:i],) for order in text_contexts.ORDERS), raw[word:i]), byte
        word = i + 1 if byte in b" \t\n\v\f\r" else word


@pytest.mark.parametrize("stretch", [1 << 17, 13, 7])
def test_running_contexts(monkeypatch, stretch):
    """Contexts of whole texts reach over white space, never into the text before, and do not depend on where stretches end."""
    monkeypatch.setattr(text_contexts, "STRETCH", stretch)
    texts = [b"", b"a b  cc", b"abc " * 5 + b"x" * 40, b"a b  cc", "Größe\tist \n gut".encode(), b"b a  cc"]
    found = text_contexts.Events.joined(list(text_contexts.events(text_contexts.stream(texts))))
    wanted = [pair for t in texts for pair in running_contexts(t)]
    assert bytes(found.data) == b"".join(t + b"\xff" for t in texts)
    for k, hashes in enumerate(found.hashes()):
        pairs = {(contexts[k], h) for (contexts, _), h in zip(wanted, hashes.tolist())}
        assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
    pairs = set(zip(wanted, found.keys.tolist()))
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_counted_events_and_tables_are_whole():
    """Whatever places are lost, all occurrences are counted, and every one is in the tables."""
    texts = [b"to be or not to be", b"to be or not", b"", b"be to or to not"] * 3
    stream = text_contexts.stream(texts)
    whole = Counter(pair for t in texts for pair in running_contexts(t))
    for size in (20, 1 << 20):
        found = list(mixing.counted_events(text_contexts.events(stream), size))
        times = Counter()
        for some, n in found:
            for key, m in zip(some.keys.tolist(), n.tolist()):
                times[key] += m
        assert sorted(times.values()) == sorted(whole.values())
        every = text_contexts.Events.joined(list(text_contexts.events(stream)))
        where, bits = mixing.placed(every.hashes(), every.data, (16,) * 6)
        for k in range(6):
            table = np.zeros(2 << 16, np.uint32)
            for some, n in found:
                mixing.add_context(k, table, list(some.begins())[k], some.data, n)
            assert (table == np.bincount(2 * where[k].reshape(-1) + bits.reshape(-1), minlength=2 << 16)).all()


def test_order_of_words_counts(spark):
    """A text's score is that of its running text: words in another order score otherwise."""
    said = "the old man went to the sea and the sea was calm"
    other = " ".join(sorted(said.split(), key=lambda w: w[::-1]))
    rows = [(i, said) for i in range(40)] + [(100, other), (101, said)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.col("doc_id") < 100
    found = {r["doc_id"]: r for r in mixing.score_texts(docs, learn, running=True).collect()}
    assert len(found) == 42 and found[100]["base_score"] == pytest.approx(found[101]["base_score"], rel=1e-9)
    assert found[101]["score"] == pytest.approx(found[0]["score"], rel=1e-9)
    assert found[100]["score"] < 1.5 * found[101]["score"]


def test_query_reads_running_texts(spark, small):
    """The query's scores equal those of one model that codes every text byte by byte, none of them known before."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept, real = {}, mixing.fit_text_mixer

    def spy(texts, size, tables):
        kept["model"] = mixing.Model(tables.value.tables(), real(texts, size, tables))
        return kept["model"].mixer

    mixing.fit_text_mixer = spy
    try:
        found = {r["doc_id"]: r for r in mixing.op10_context_mixing(spark, str(small)).collect()}
    finally:
        mixing.fit_text_mixer = real
    rows = docs.collect()
    check(rows, found.values())
    for r in rows[:60]:
        raw = (r["text"] or "").encode()
        every = text_contexts.Events.joined(list(text_contexts.events(text_contexts.stream([raw]))))
        score = kept["model"].event_costs(every).sum()
        assert found[r["doc_id"]]["score"] == pytest.approx(score, rel=1e-9)
        assert found[r["doc_id"]]["bits_per_byte"] == pytest.approx(-score / math.log10(2) / (len(raw) + 1), rel=1e-9)


def test_running_scores_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before, found = {k: spark.conf.get(k) for k in keys}, []
    try:
        for parts, rows in ((2, 50), (64, 2000)):
            for k, v in zip(keys, (parts, "false", rows)):
                spark.conf.set(k, v)
            found.append({r["doc_id"]: r["score"] for r in mixing.score_texts(docs.repartition(parts), ~mixing.in_fold("doc_id"), running=True).collect()})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0].keys() == found[1].keys()
    assert all(found[1][d] == pytest.approx(x, rel=1e-9) for d, x in found[0].items())


def test_running_odd_rows(spark, odd_docs, no_docs):
    check(odd_docs.collect(), mixing.score_texts(odd_docs, ~mixing.in_fold("doc_id"), running=True).collect())
    assert mixing.score_texts(no_docs, ~mixing.in_fold("doc_id"), running=True).count() == 0
    none = mixing.score_texts(odd_docs.where("doc_id = 5"), F.lit(False), running=True).collect()
    assert none and all(r["n_known"] == 0 and r["base_score"] == 0 for r in none)


def test_tasks_let_go_of_tables_read_before(spark):
    """A worker that counts or fills again holds no tables and costs of the tables that it read for scores before."""
    import pyarrow as pa

    class Frame:
        def mapInArrow(self, run, schema):
            self.__dict__.setdefault("run", run)
            return self

        def coalesce(self, _):
            return self

        repartition = groupBy = agg = lambda self, *_: self

    count, fill = Frame(), Frame()
    mixing.count_segments(count)
    with pytest.raises(AttributeError):  # the stub cannot be staged, but has the tasks' function by then
        next(mixing.fill_text_tables(fill, 100, 100))
    text = pa.RecordBatch.from_pydict({"body": ["to be or not to be"], "learn": [True], "seg": [b"to be or not to be"]})
    for frame in (count, fill):
        mixing._UNPACKED["before"] = mixing._KNOWN["before"] = None
        next(frame.run(iter([text])))
        assert not mixing._UNPACKED and not mixing._KNOWN


def test_odds_leave_one_occurrence_out():
    """Log odds and gates of cells, whole and with one occurrence of the bit left out, against the counts themselves."""
    rng = np.random.default_rng(3)
    zeros, ones = rng.integers(1, 300, (6, 1 << 16)), rng.integers(1, 70000, (6, 1 << 16))
    ones[:, ::3] = 1
    tables = [mixing.packed_counts(z, o) for z, o in zip(zeros, ones)]
    where = [rng.integers(0, 1 << 16, (50, 8)) for _ in tables]
    bits = rng.integers(0, 2, (50, 8)).astype(np.uint8)
    flat = bits.reshape(-1)
    for own in (0, 1):
        x, gate = mixing.Odds.of(tables, own=bool(own)).inputs(where, bits)
        for k, (table, at) in enumerate(zip(tables, where)):
            pair = table[at.reshape(-1)]
            z, o = (pair >> 16) - own * (1 - flat.astype(int)), (pair & 0xFFFF) - own * flat.astype(int)
            assert np.allclose(x[k], np.log(o + 0.4) - np.log(z + 0.4), atol=3e-4 if own else 1e-5)
            seen = np.log2(z + o + 1.0)
            if k == 4:
                want = np.minimum(3, np.ceil(seen / 3))
            if k == 5:
                want = want + 4 * np.minimum(4, np.ceil(seen / 2))
        assert (x[-1] == 1).all() and (gate == want).all()
