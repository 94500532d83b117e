import re

import corpus_pipeline
from lanternfish.llm import secrets, simhash, toxicity
from pyspark.sql import functions as F
from test_secrets import base_slow
from test_suffix_dedup import slow as slow_dedup


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_one_by_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    texts = lambda frame: {r["doc_id"]: r["text"] for r in frame.collect()}
    before = texts(docs)

    clean = corpus_pipeline.drop_toxic(spark, docs, small).cache()
    assert clean.columns == columns
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.op8_toxicity(spark, small).collect()}
    assert texts(clean) == {i: t for i, t in before.items() if not scores[i]}

    kept = corpus_pipeline.drop_near_copies(spark, clean, small).cache()
    assert kept.columns == columns
    here, left = texts(clean), texts(kept)
    sets = {i: shingles(t) for i, t in here.items()}
    for i in here.keys() - left.keys():  # whatever goes is like another document
        assert max(len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for j in here if j != i) > 0.6 or not sets[i]
    alive = sorted(left)
    for a in alive:  # and what stays is not much like what stays
        for b in alive:
            assert a >= b or not sets[a] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.9

    cut = corpus_pipeline.cut_repeats(spark, kept, small).cache()
    want = {d: n - gone for d, n, gone, *_ in slow_dedup(kept.collect())}
    for r in cut.collect():
        assert want[r["doc_id"]] - len((r["text"] or "").encode()) in range(0, 7) and r["n_chars"] == len(r["text"])

    safe = corpus_pipeline.redact_secrets(spark, cut, small)
    assert safe.columns == columns
    found = texts(cut)
    for i, t in texts(safe).items():
        assert (t == found[i]) == (not base_slow(found[i]) and not secrets.scanner_for(secrets.RULES).scan([found[i]])[0])
        assert not base_slow(re.sub(r"\[\w+\]", "", t)) or "[" in t


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows) == len({(r["bucket"], r["batch"], r["slot"]) for r in rows})


def test_run_leaves_one_table(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr("lanternfish.plans.staging.shared_dir", lambda _: f"file://{tmp_path}")
    packed = corpus_pipeline.run(spark, small)
    left = [p.name for p in tmp_path.iterdir() if p.is_dir() and p.name.startswith(("pipeline-", "dedup-", "wide-", "simhash-", "near-", "toxicity-"))]
    assert len(left) == 1 and left[0].startswith("pipeline-secret_scans")
    assert packed.count() > 0


def test_near_copies(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(300)] for _ in range(30)]
    rows, want = [], set()
    for b, words in enumerate(base):
        rows.append((100 * b, " ".join(words)))
        want.add(100 * b)
        for c in range(1, 5):
            copy = list(words)
            copy[rng.randrange(300)] = word()
            rows.append((100 * b + c, " ".join(copy)))
    rows += [(None, "no id"), (9001, None), (9002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (32_768, 20):
        found = simhash.similar_components(docs, tile=tile).where(F.col("doc_id") < 9000).collect()
        assert {r["component_id"] for r in found} == want and all(r["component_id"] == r["doc_id"] // 100 * 100 for r in found)
    kept = [r["doc_id"] for r in simhash.without_near_copies(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted([*want, 9001]) and None in kept


def test_near_copies_are_exact(spark):
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    line = " ".join(word() for _ in range(10))
    rows = [(i, "\n".join([line] * 100) + "\n" + " ".join(word() for _ in range(300))) for i in (1, 2)]  # a frequent line only
    for k in range(150):  # 404 words, 400 shingles; a changed tail of 44 or 45 leaves 0.802 or 0.798
        words = [word() for _ in range(404)]
        rows += [(1000 + 2 * k, " ".join(words)), (1001 + 2 * k, " ".join(words[: 360 - k % 2] + [word() for _ in range(44 + k % 2)]))]
    chain = [word() for _ in range(240)]
    rows += [(5000 + k, " ".join(chain[4 * k : 4 * k + 100])) for k in range(30)]  # each like its next ones
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert {root[1], root[2]} == {1, 2} and sum(root[1001 + 2 * k] == 1000 + 2 * k for k in range(150)) == 75
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (1 << 20, 3000):
        found = simhash.similar_components(docs, bytes_a_part=part).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == root


def stages_on(spark, docs, folder):
    """The stages' results, each staged for the next one."""
    from lanternfish.plans.staging import stage

    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], folder), name))
    return out[1:]


def test_stages_on_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    *cleaned, packed = stages_on(spark, docs, small)
    assert all(c.columns == docs.columns and c.count() == 0 for c in cleaned) and packed.count() == 0 and "batch" in packed.columns


def test_stages_on_odd_rows(spark, odd_docs, small):
    """Null and empty texts, null ids, repeated rows, clashing column names, a long text: nothing crashes, columns stay."""
    docs = odd_docs.union(spark.createDataFrame([(None, "no id", "s", 1, "n"), (None, None, "s", 1, "n"), (700, "lone text here", None, None, None)], odd_docs.schema))
    *cleaned, packed = stages_on(spark, docs, small)
    toxic, near, cut, safe = cleaned
    assert all(c.columns == docs.columns for c in cleaned)
    assert toxic.count() == docs.count()
    kept = near.collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(None) == 2 and {700, 3} <= set(ids)  # rows with a null id stay
    assert sum(not (r["text"] or "").split() for r in kept if r["doc_id"] is not None) == 1  # texts without words are copies
    assert all(ids.count(i) == sum(r["doc_id"] == i for r in docs.collect()) for i in set(ids))
    assert cut.count() == safe.count() == packed.count() == len(ids)
    texts = [r["text"] for r in safe.collect()]
    assert None in texts and "lone text here" in texts and "no id" in texts


def test_a_very_long_text(spark, small):
    """Four megabytes without a space, and as many of words, beside short ones."""
    words = " ".join(f"w{i * 7919 % 100_003}" for i in range(600_000))
    docs = spark.createDataFrame([(1, "x" * 4_000_000), (2, words), (3, "short"), (4, words)], "doc_id long, text string")
    *cleaned, packed = stages_on(spark, docs, small)
    assert sorted(r["doc_id"] for r in packed.collect()) == [1, 2, 3]
    left = {r["doc_id"]: len(r["text"]) for r in cleaned[-1].collect()}
    assert left[1] == 1 and left[3] == 5  # every window but the first starts earlier too
