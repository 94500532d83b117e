"""Queries of time joins, sessions, margins, sketches, table functions, feeds, files and streams in several batches, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish.functions import columns as C, tables
from lanternfish.operators import images as I, sketches as K, temporal as X
from lanternfish.plans.registering import registered
from lanternfish.plans.analytics import pictures
from lanternfish.plans.staging import fresh_path, stage
from lanternfish.plans.views import SIGHTINGS, sightings, table
from lanternfish.sources import feeds, files, pages as P
from lanternfish.streaming import micro, stateful

QUERIES, ORACLES, query = registered()

_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


# -- joins by time -----------------------------------------------------------------------------------------------------

@query("""SELECT event_id, o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS ordered FROM (SELECT event_id, user_id, ts FROM events) e
ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def asof_order(spark, d):
    """Every event with its customer's last order before it."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("who"), "ts")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("who"), "o_orderkey", "o_orderdate")
    found = X.asof_join(e, o, "who", "ts", "o_orderdate", "o_orderkey")
    return found.select("event_id", F.col("found.o_orderkey").alias("o_orderkey"), F.date_format("found.o_orderdate", "yyyy-MM-dd").alias("ordered"))


@query("""SELECT e.event_id, p.event_id AS purchase_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p
ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type <> 'purchase'""")
def asof_purchase(spark, d):
    """Every other event with its user's last purchase."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    found = X.asof_join(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), "user_id", "ts", "ts", "event_id")
    return found.select("event_id", F.col("found.event_id").alias("purchase_id"))


_OPEN = "i AS (SELECT o_orderkey AS id, o_custkey AS who, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS a, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 1 + o_orderkey % 200 AS b FROM orders)"


@query("SELECT x.id AS left_key, y.id AS right_key FROM i x JOIN i y ON x.who = y.who AND x.id < y.id AND x.a < y.b AND y.a < x.b", _OPEN)
def interval_overlap(spark, d):
    """Pairs of a customer's orders that are open at the same time (an order is open for up to 200 days)."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", day.alias("a"), (day + 1 + F.col("o_orderkey") % 200).alias("b"))
    return X.overlapping(o, o, "o_custkey", "o_orderkey", "a", "b").where("left_key < right_key")


_SESSIONS = """g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
ss AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) GROUP BY user_id, s)"""
_SESSION_ROW = "SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(stop, '%Y-%m-%d %H:%M:%S.%f') AS stop, n FROM ss"


def _shown(s):
    return s.select("user_id", F.date_format("start", _STAMP).alias("start"), F.date_format("stop", _STAMP).alias("stop"), "n")


@query(_SESSION_ROW, _SESSIONS)
def session_windows(spark, d):
    """Sessions of every user: no pause of more than six hours."""
    return _shown(X.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "6 hours"))


@query(f"{_SESSION_ROW} WHERE stop <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)", _SESSIONS)
def stream_sessions(spark, d):
    """The same sessions as a stream gives them: those that the watermark has passed."""
    e = micro.stream_of(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 days")
    return _shown(micro.drain(X.sessions(e, "user_id", "ts", "6 hours"), "sessions"))


# -- margins and sketches ----------------------------------------------------------------------------------------------

@query("""SELECT klass, source, month, count(*) AS n, CAST(sum(likes) AS BIGINT) AS likes, count(*) FILTER (WHERE query = 'name') AS named, CAST(GROUPING(klass, source, month) AS BIGINT) AS margin
FROM (SELECT *, strftime(posted_at, '%Y-%m-%W') AS month FROM s) GROUP BY CUBE (klass, source, month)""", SIGHTINGS)
def cube_margins(spark, d):
    """All margins of class, source and week in one pass; rows are counted for the finest cells before they are multiplied."""
    # weeks begin on Monday, and those of a year are counted from its first Monday on
    day = F.col("posted_at").cast("date")
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("int")
    s = sightings(spark, d).withColumn("month", F.concat(F.date_format("posted_at", "yyyy-MM-"), F.lpad(week.cast("string"), 2, "0")))
    cells = s.groupBy("klass", "source", "month").agg(F.count("*").alias("n"), F.sum("likes").alias("likes"), F.count_if(F.col("query") == "name").alias("named"))
    return cells.cube("klass", "source", "month").agg(F.sum("n").alias("n"), F.sum("likes").alias("likes"), F.sum("named").alias("named"), F.grouping_id().alias("margin"))


@query("""SELECT klass, source, NULL AS day, count(*) AS n FROM s GROUP BY klass, source UNION ALL SELECT klass, NULL, CAST(CAST(posted_at AS DATE) AS VARCHAR), count(*) FROM s GROUP BY klass, CAST(posted_at AS DATE) UNION ALL SELECT NULL, NULL, NULL, count(*) FROM s""", SIGHTINGS)
def grouping_sets(spark, d):
    """Class by source, class by day, and all, as grouping sets over the finest cells."""
    cells = sightings(spark, d).groupBy("klass", "source", F.col("posted_at").cast("date").cast("string").alias("day")).agg(F.count("*").alias("n"))
    k, s, day = F.col("klass"), F.col("source"), F.col("day")
    return cells.groupingSets([[k, s], [k, day], []], k, s, day).agg(F.sum("n").alias("n"))


@query("SELECT klass, '{' || string_agg('\"' || label || '\":' || n, ',' ORDER BY label) || '}' AS labels FROM (SELECT klass, label, count(*) AS n FROM s GROUP BY ALL) GROUP BY klass", SIGHTINGS)
def label_maps(spark, d):
    """A map of label counts for every class."""
    counts = sightings(spark, d).where("label IS NOT NULL").groupBy("klass", "label").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("label", "n")))  # one entry a label
    return counts.groupBy("klass").agg(F.to_json(F.map_from_entries(entries)).alias("labels"))


@query("""SELECT klass, half, n, exact, true AS close, true AS close_theta, true AS close_median FROM (SELECT event_type AS klass, CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS half, count(*) AS n, count(DISTINCT event_id) AS exact FROM events GROUP BY ALL)""")
def day_sketches(spark, d):
    """Distinct events and the median value of every class and half month, merged from sketches kept for days, against exact ones: counts
    within 2 %, the median within 2 % of the rows."""
    e = table(spark, d, "events").select(F.col("event_type").alias("klass"), "ts", "event_id", "value")
    days = stage(K.sketched(e, ["klass", F.col("ts").cast("date").alias("day")], "event_id", "value"), "day-sketches")
    half = lambda day: F.when(F.dayofmonth(day) <= 15, 1).otherwise(2).alias("half")
    found = K.estimates(K.merged(days, [F.col("klass").alias("k"), half("day").alias("h")]), {"median": 0.5}).drop("rows")
    exact = e.groupBy("klass", half("ts")).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("exact"))
    same = F.col("klass").eqNullSafe(F.col("k")) & (F.col("half") == F.col("h"))  # a null class is a class
    number = F.when(~F.isnan("value"), F.col("value"))  # others are in no sketch
    share = lambda holds: F.avg(holds.cast("int"))
    ranked = e.withColumn("half", half("ts")).join(found, same).groupBy(*found.columns).agg(
        share(number < F.col("median")).alias("under"), share(number <= F.col("median")).alias("upto"))
    near = lambda c: F.abs(F.col(c) - F.col("exact")) <= 0.02 * F.col("exact")
    middle = (F.col("under") <= 0.52) & (F.col("upto") >= 0.48)  # equal values share their ranks
    return exact.join(ranked, same).select(
        "klass", "half", "n", "exact", near("distinct").alias("close"), near("distinct_theta").alias("close_theta"), F.coalesce(middle, F.col("median").isNull()).alias("close_median"))


@query("""SELECT author, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, CAST(count(*) AS INTEGER) AS days FROM (SELECT author, day, day - CAST(row_number() OVER (PARTITION BY author ORDER BY day) AS INTEGER) AS run FROM (SELECT DISTINCT author, CAST(posted_at AS DATE) AS day FROM s)) GROUP BY author, run""", SIGHTINGS)
def day_runs(spark, d):
    """Runs of days on which an author posted, by a table function over ordered partitions."""
    tables.register(spark)
    s = sightings(spark, d).select("author", F.col("posted_at").cast("date").alias("day")).distinct()
    found = spark.sql("SELECT * FROM day_runs(TABLE(SELECT * FROM {s}) PARTITION BY author ORDER BY day)", s=s)
    return found.select("author", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "days")


# -- streams in several batches ----------------------------------------------------------------------------------------

@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(5 AS BIGINT) AS batches FROM events GROUP BY event_type")
def stream_rounds(spark, d):
    """Five files drained in five batches, stopped after the second and taken up again from the checkpoint."""
    folder = stateful.in_files(table(spark, d, "events"), "ts", 5)
    rows = stateful.by_file(spark, folder).select("event_id", "event_type", "user_id")
    out = stateful.drained_again(rows, "rounds", stop_after=2)
    batches = out.select(F.countDistinct("batch").alias("batches"))
    found = out.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return found.crossJoin(F.broadcast(batches))  # one row


@query("""SELECT user_id, n, round(total, 6) AS total, strftime(latest, '%Y-%m-%d %H:%M:%S.%f') AS latest FROM (SELECT user_id, count(*) AS n, sum(value) AS total, max(ts) AS latest FROM events GROUP BY user_id)""")
def stream_user_totals(spark, d):
    """Totals that each user's state holds after five batches with a restart in mid-stream."""
    folder = stateful.in_files(table(spark, d, "events"), "ts", 5)
    rows = stateful.by_file(spark, folder)
    out = stateful.drained_again(stateful.user_totals(rows), "totals", mode="update", stop_after=2)
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "total", "latest"), "n").alias("s"))
    return last.select("user_id", "s.n", F.round("s.total", 6).alias("total"), F.date_format(F.timestamp_micros("s.latest"), _STAMP).alias("latest"))


# -- feeds, files and pages --------------------------------------------------------------------------------------------

@query("SELECT user_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY user_id")
def author_feed(spark, d):
    """Every author's feed from a date on, read page by page by a Python source that takes the bound into its pages."""
    spark.dataSource.register(feeds.ParquetFeed)
    feed = spark.read.format("parquet_feed").options(path=f"{d}/events.parquet", actor="user_id", since="ts").load()
    with feeds.pushing(spark):
        rows = stage(feed.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).select("user_id", "event_id"), "author-feed")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("SELECT vec_id, true AS found, true AS same_hashes FROM embeddings")
def picture_rescan(spark, d):
    """Pictures written as files and read back: whether each is there, with the hashes that it had before."""
    p = pictures(spark, d).withColumn("pixels", files.rounded(F.col("pixels")))
    folder = micro.as_uri(fresh_path(spark, "pictures"))
    written = stage(files.write_pictures(p, "vec_id", "pixels", "width", folder), "picture-files")
    before = I.picture_hashes(p, "vec_id", "pixels", "width").join(written, "vec_id")
    scanned = files.read_pictures(spark, folder).withColumn("n", F.lit(0).cast("long"))
    after = I.picture_hashes(scanned.withColumn("n", F.conv(F.substring("sha1", 1, 15), 16, 10).cast("long")), "n", "pixels", "width").select("n", F.col("phash").alias("p2"), F.col("dhash").alias("d2"))
    both = before.withColumn("n", F.conv(F.substring("sha1", 1, 15), 16, 10).cast("long")).join(after, "n", "left")
    return both.select("vec_id", F.col("p2").isNotNull().alias("found"), F.coalesce((F.col("phash") == F.col("p2")) & (F.col("dhash") == F.col("d2")), F.lit(False)).alias("same_hashes"))


@query("""SELECT page_id, nullif(replace(url, '"', ''), '') AS og_image, 'Page ' || page_id || ' & more' AS og_title FROM pages""")
def meta_tags(spark, d):
    """og:image and og:title of every page, given tags in either order of their attributes, with entities resolved."""
    escaped = C.html_escape(F.replace(F.coalesce("url", F.lit("")), F.lit('"'), F.lit("")))
    title = F.concat(F.lit("Page "), F.col("page_id").cast("string"), F.lit(" &amp; more"))
    even = F.col("page_id") % 2 == 0
    image = F.when(even, F.concat(F.lit('<meta property="og:image" content="'), escaped, F.lit('">'))).otherwise(F.concat(F.lit('<meta content="'), escaped, F.lit('" property="og:image"/>')))
    named = F.when(even, F.concat(F.lit('<META content="'), title, F.lit('" name="og:title" >'))).otherwise(F.concat(F.lit('<meta name="og:title" content="'), title, F.lit('">')))
    page = F.concat(image, named, F.coalesce("html", F.lit("")))
    p = table(spark, d, "pages").select("page_id", page.alias("page"))
    read = lambda name: P.unescape(P.meta_content(F.col("page"), name))
    return p.select("page_id", read("og:image").alias("og_image"), read("og:title").alias("og_title"))


@query("SELECT page_id, coalesce(html, '') AS text FROM pages")
def unescaped(spark, d):
    """Every page's source, escaped and back again."""
    return table(spark, d, "pages").select("page_id", P.unescape(C.html_escape(F.coalesce("html", F.lit("")))).alias("text"))


@query("""SELECT node, min(depth) AS depth FROM t GROUP BY node""",
       "RECURSIVE done AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal < 0), kids AS (SELECT DISTINCT o_custkey // 10 AS parent, o_custkey AS child FROM orders WHERE o_custkey NOT IN (SELECT node FROM done)), "
       "t AS (SELECT r AS node, 0 AS depth FROM range(1, 10) x(r) WHERE r NOT IN (SELECT node FROM done) UNION SELECT child, depth + 1 FROM t JOIN kids ON node = parent WHERE depth < 4)")
def tree_walk_ledger(spark, d):
    """The same walk from nine roots where a ledger (customers in debt) holds nodes that are finished: they are not walked again."""
    kids = table(spark, d, "orders").select(F.floor(F.col("o_custkey") / 10).cast("long").alias("parent"), F.col("o_custkey").alias("child")).distinct()
    done = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("node"))
    return P.walk_tree(spark.range(1, 10).select(F.col("id").alias("node")), kids, 4, done)
