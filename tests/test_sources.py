"""Paged feeds with pushed filters and stream offsets, picture files, sitemap records and meta tags."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfish.operators import images
from lanternfish.sources import feeds, files, pages


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Three files of several row groups, in order of n."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("feed")
    for k in range(3):
        n = list(range(k * 100, k * 100 + 100))
        pq.write_table(pa.table({"n": n, "author": [x % 5 for x in n], "text": [f"t{x}" for x in n]}), f"{folder}/part-{k}.parquet", row_group_size=40)
    spark.dataSource.register(feeds.ParquetFeed)
    return str(folder)


def rows(df):
    return sorted((r["n"], r["author"], r["text"]) for r in df.collect())


def want(keep):
    return [(n, n % 5, f"t{n}") for n in range(300) if keep(n)]


def loaded(spark, feed, **more):
    return spark.read.format("parquet_feed").options(path=feed, actor="author", since="n", page=7, **more).load()


def test_pages_give_every_row_once(spark, feed):
    with feeds.pushing(spark):
        df = loaded(spark, feed)
        assert rows(df) == want(lambda n: True)
        assert df.rdd.getNumPartitions() == 9  # a partition for each row group


def test_filters_reach_the_pages(spark, feed):
    df = loaded(spark, feed).where("n >= 120 AND author IN (1, 3) AND text != 't121'")
    with feeds.pushing(spark):
        assert rows(df) == want(lambda n: n >= 120 and n % 5 in (1, 3) and n != 121)
        assert loaded(spark, feed).where("author IN (1, 3)").rdd.getNumPartitions() == 2  # one an actor: the filter has been pushed
    assert spark.conf.get(feeds.PUSHDOWN) == "false"
    reader = feeds._FeedReader(feeds.ParquetFeed({"path": feed, "actor": "author", "since": "n"}), df.schema)
    left = list(reader.pushFilters([feeds.EqualTo(("author",), 3), feeds.GreaterThanOrEqual(("n",), 250), feeds.EqualTo(("text",), "t253")]))
    assert left == [feeds.EqualTo(("text",), "t253")] and [p.actor for p in reader.partitions()] == [3]
    got = [n for b in reader.read(reader.partitions()[0]) for n in b.column("n").to_pylist()]
    assert got == [n for n in range(250, 300) if n % 5 == 3]


def test_a_stream_goes_on_from_its_offset(spark, feed, tmp_path):
    """New row groups are read once; those that have been there are not read again."""
    import shutil

    folder, out, state = tmp_path / "feed", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def drain():
        df = spark.readStream.format("parquet_feed").options(path=str(folder), actor="author", since="n").load()
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r["n"] for r in spark.read.parquet(out).collect())

    shutil.copy(f"{feed}/part-0.parquet", folder)
    assert drain() == list(range(100))
    shutil.copy(f"{feed}/part-1.parquet", folder)
    assert drain() == list(range(200))
    assert drain() == list(range(200))


def test_pictures_come_back_from_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    some = [rng.integers(0, 65536, (12, 20)).astype(float).ravel().tolist() for _ in range(12)]
    df = spark.createDataFrame([(k, p, 20) for k, p in enumerate(some + some[:2])], "id long, pixels array<double>, width int").repartition(4)
    folder = f"file://{tmp_path}/pictures"
    written = files.write_pictures(df, "id", "pixels", "width", folder).collect()
    assert sorted(files.write_pictures(df, "id", "pixels", "width", folder).collect()) == sorted(written)  # again: the same names
    found = [os.path.join(d, f) for d, _, names in os.walk(f"{tmp_path}/pictures") for f in names]
    assert len(found) == 12 and not [f for f in found if not f.endswith(".png")]
    digest = {r["id"]: r["sha1"] for r in written}
    assert digest[0] == digest[12] and len(set(digest.values())) == 12
    back = {r["sha1"]: (r["pixels"], r["width"]) for r in files.read_pictures(spark, folder).collect()}
    assert all(back[digest[k]] == (p, 20) for k, p in enumerate(some))
    prefix = digest[5][:2]
    assert {r["sha1"] for r in files.read_pictures(spark, folder, prefix).collect()} == {s for s in digest.values() if s.startswith(prefix)}
    with pytest.raises(ValueError):
        files.pixels_of(files.png(np.ones((2, 2)))[:-20] + b"\0" * 20)


def slow_hashes(g):
    """Perceptual and difference hash with plain sums: area means, cosine transform, medians."""
    def mean(rows, columns):
        h, w = g.shape
        out = np.zeros((rows, columns))
        for r in range(rows):
            for c in range(columns):
                total = area = 0.0
                for y in range(h):
                    for x in range(w):
                        part = max(0, min(y + 1, (r + 1) * h / rows) - max(y, r * h / rows)) * max(0, min(x + 1, (c + 1) * w / columns) - max(x, c * w / columns))
                        total, area = total + part * g[y, x], area + part
                out[r, c] = total / area
        return out

    small = mean(32, 32)
    low = np.array([[sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)])
    bits = lambda flags: int("".join("1" if f else "0" for f in flags), 2)
    eight = mean(8, 9)
    sure = np.abs(low - np.median(low)).ravel() > 1e-6 * np.abs(low).max()  # others lie at the median but for rounding
    return bits(low.ravel() > np.median(low)), bits(sure), bits([eight[r, c + 1] > eight[r, c] for r in range(8) for c in range(8)])


def test_whole_picture_hash_query(spark, small):
    """A few rows of the query against sums written out."""
    from lanternfish.plans import analytics

    found = {r["vec_id"]: r for r in analytics.picture_hash(spark, small).collect()}
    some = analytics.pictures(spark, small).orderBy("vec_id").limit(3).collect()
    assert len(found) == spark.read.parquet(f"{small}/embeddings.parquet").count()
    for r in some:
        p, sure, d = slow_hashes(np.array(r["pixels"]).reshape(-1, r["width"]))
        assert not (found[r["vec_id"]]["phash"] ^ p) & sure and sure.bit_count() >= 6
        assert found[r["vec_id"]]["dhash"] & (2**64 - 1) == d


SITEMAP = """<?xml version="1.0"?><urlset xmlns="s" xmlns:news="n" xmlns:image="i">
<url id="1"><loc> https://a/1 </loc><lastmod>2024-01-02</lastmod><news:news><news:publication_date>2024-01-03</news:publication_date><news:title lang="en">A &amp; B</news:title></news:news></url>
<url><loc>https://a/2</loc><news:news><news:title><![CDATA[<b>C & D</b>]]></news:title></news:news><image:image><image:loc>https://i/2.jpg</image:loc></image:image><image:image><image:loc>https://i/3.jpg</image:loc></image:image></url>
<url><loc>https://a/3</loc><lastmod>broken</url>
<url><loc>https://a/4</loc></url><url><lastmod>2024-01-05</lastmod></url></urlset>"""


def test_sitemap_records(spark):
    """Malformed, CDATA, attribute and name-space cases."""
    prefixed = SITEMAP.replace("<url>", "<sm:url>").replace("</url>", "</sm:url>").replace("<url ", "<sm:url ").replace("<loc>", "<sm:loc>").replace("</loc>", "</sm:loc>")
    for text in (SITEMAP, prefixed):
        got = pages.sitemap_records(spark.createDataFrame([(text,), (None,), ("",), ("<urlset/>",)], "xml string"), "xml").collect()
        whole = sorted((r["loc"], r["when"], r["title"], r["image_url"]) for r in got if r["corrupt"] is None)
        assert whole == [("https://a/1", "2024-01-03", "A & B", None), ("https://a/2", None, "<b>C & D</b>", "https://i/2.jpg"), ("https://a/4", None, None, None)]
        (bad,) = [r for r in got if r["corrupt"] is not None]
        assert "https://a/3" in bad["corrupt"] and bad["loc"] is None


def test_hashes_of_noise():
    """Pictures without equal frequencies: every bit."""
    g = np.random.default_rng(7).uniform(0, 255, (40, 50))
    p, sure, d = slow_hashes(g)
    assert sure == 2**64 - 1
    assert images.perceptual_hash(g) & sure == p and images.difference_hash(g) & sure == d


def test_finished_nodes_are_not_walked(spark):
    kids = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 5), (5, 6)], "parent long, child long")
    roots, done = spark.createDataFrame([(1,), (9,)], "node long"), spark.createDataFrame([(3,), (9,)], "node long")
    assert {(r["node"], r["depth"]) for r in pages.walk_tree(roots, kids, 4, done).collect()} == {(1, 0), (2, 1), (4, 2)}
    assert {r["node"] for r in pages.walk_tree(roots, kids, 4).collect()} == {1, 2, 3, 4, 5, 6, 9}
