"""Queries of sources, catalogue writes, relational operators, scalar functions and text scores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lanternfish.functions import columns as C
from lanternfish.operators import relational as R
from lanternfish.plans.registering import registered
from lanternfish.plans.staging import fresh_path
from lanternfish.plans.views import HASHES, SIGHTINGS, choose, hashes, sightings, table
from lanternfish.sources import documents as D, pages as P
from lanternfish.sources.windows import day_tiles, event_windows

QUERIES, ORACLES, query = registered()


# -- sources -----------------------------------------------------------------------------------------------------------

@query("""SELECT low + (span * cell) // (1::BIGINT << level) AS start, low + (span * (cell + 1)) // (1::BIGINT << level) AS stop, CAST(coalesce(n, 0) AS BIGINT) AS n FROM
(SELECT 0 AS level, 0::BIGINT AS cell UNION ALL SELECT level + 1, 2 * cell + k FROM fullc, range(0, 2) r(k)) w JOIN b ON true LEFT JOIN cnt USING (level, cell) WHERE NOT EXISTS (SELECT 1 FROM fullc f WHERE f.level = w.level AND f.cell = w.cell)""",
       """s AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), b AS (SELECT min(t) AS low, max(t) + 1 - min(t) AS span FROM s), d AS (SELECT CAST(min(i) AS INTEGER) AS depth FROM range(0, 40) r(i), b WHERE 120 * (1::BIGINT << i) >= span),
edges AS (SELECT CAST(l AS INTEGER) AS level, c AS cell, low + (span * c) // (1::BIGINT << l) AS a, low + (span * (c + 1)) // (1::BIGINT << l) AS z FROM d, b, LATERAL (SELECT unnest(range(0, depth + 1)) AS l) x, LATERAL (SELECT unnest(range(0, 1::BIGINT << l)) AS c) y),
cnt AS (SELECT level, cell, count(*) AS n FROM edges JOIN s ON t >= a AND t < z GROUP BY 1, 2), fullc AS (SELECT cnt.level, cell FROM cnt, d WHERE n > 90 AND cnt.level < depth)""")
def window_bisect(spark: SparkSession, d: str) -> DataFrame:
    """The time range of all events in windows of at most 90 rows."""
    return event_windows(table(spark, d, "events"), 90, 120)


def _tiles(spark: SparkSession, d: str, days: int, newest: bool) -> DataFrame:
    span = table(spark, d, "events").groupBy((F.col("user_id") % 7).alias("worker")).agg(F.min("ts").cast("date").alias("since"), F.date_add(F.max("ts").cast("date"), 1).alias("until"))
    return span.select("worker", F.explode(day_tiles(F.col("since"), F.col("until"), days, newest)).alias("t")).select("worker", F.col("t.start").cast("string").alias("start"), F.col("t.stop").cast("string").alias("stop"))


@query("""SELECT worker, CAST(greatest(since, CAST(until - CAST(i + 1 AS INTEGER) AS DATE)) AS VARCHAR) AS start, CAST(until - CAST(i AS INTEGER) AS VARCHAR) AS stop
FROM span, range(0, 4000) r(i) WHERE i < date_diff('day', since, until)""",
       "span AS (SELECT user_id % 7 AS worker, CAST(min(ts) AS DATE) AS since, CAST(max(ts) AS DATE) + 1 AS until FROM events GROUP BY 1)")
def time_tiles(spark, d):
    """Days from the newest to the oldest, one a window."""
    return _tiles(spark, d, 1, True)


@query("""SELECT worker, CAST(since + CAST(4 * i AS INTEGER) AS VARCHAR) AS start, CAST(least(until, since + CAST(4 * (i + 1) AS INTEGER)) AS VARCHAR) AS stop
FROM span, range(0, 1000) r(i) WHERE 4 * i < date_diff('day', since, until)""",
       "span AS (SELECT user_id % 7 AS worker, CAST(min(ts) AS DATE) AS since, CAST(max(ts) AS DATE) + 1 AS until FROM events GROUP BY 1)")
def time_tiles_4d(spark, d):
    """Blocks of four days from the oldest on, the last clipped."""
    return _tiles(spark, d, 4, False)


@query(r"""SELECT event_id, regexp_replace(replace(props, '"k"', '"k\x"'), '\\([^"\\/bfnrtu])', '\\\\\1', 'g') AS fixed FROM events""")
def json_repair(spark, d):
    """Stray backslashes in JSON doubled, so that it parses."""
    e = table(spark, d, "events")
    return e.select("event_id", C.repair_json(F.replace("props", F.lit('"k"'), F.lit('"k\\x"'))).alias("fixed"))


@query("""SELECT node, min(depth) AS depth FROM t GROUP BY node""",
       "RECURSIVE kids AS (SELECT DISTINCT o_custkey // 10 AS parent, o_custkey AS child FROM orders), t AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT child, depth + 1 FROM t JOIN kids ON node = parent WHERE depth < 4)")
def tree_walk(spark, d):
    """Customers reached from the first one by appending a digit to the number, four steps at most."""
    kids = table(spark, d, "orders").select(F.floor(F.col("o_custkey") / 10).cast("long").alias("parent"), F.col("o_custkey").alias("child")).distinct()
    return P.walk_tree(spark.createDataFrame([(1,)], "node long"), kids, 4)


@query("SELECT page_id, url AS loc FROM pages WHERE url IS NOT NULL AND url <> ''")
def xml_extract(spark, d):
    """Locations of a sitemap made of every page's URL."""
    xml = F.concat(F.lit("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc>"), C.html_escape(F.col("url")), F.lit("</loc></url></urlset>"))
    return P.sitemap_entries(table(spark, d, "pages").select("page_id", xml.alias("xml")), "xml").select("page_id", "loc")


@query("""SELECT DISTINCT CASE id % 5 WHEN 3 THEN 'https://a.example/2004/07/09/item' || w ELSE 'https://a.example/item' || w END AS loc, CASE id % 5 WHEN 3 THEN '2004-07-09' ELSE strftime(od, '%Y-%m-%d') || 'T00:00:00Z' END AS published,
CASE WHEN id % 3 = 0 THEN 'A & "' || w || '"' END AS title, CASE WHEN id % 2 = 0 THEN 'https://i.example/' || w || '.jpg' END AS image_url FROM (SELECT o_orderkey AS id, translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'abcdefghij') AS w, o_orderdate AS od FROM orders)
WHERE id % 5 <> 2 AND CASE id % 5 WHEN 3 THEN true WHEN 4 THEN false ELSE od >= DATE '1994-01-01' AND od < DATE '2005-01-01' END""")
def sitemap_articles(spark, d):
    """Articles of sitemaps (one an order) within some years: dated by the news, by the last change, or by the URL; every fifth
    has no date and every fifth another path."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("day"))
    k, n = F.col("id") % 5, F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    some = lambda c, a, v, z: F.when(c, F.concat(F.lit(a), v, F.lit(z))).otherwise("")
    xml = F.concat(
        F.lit("<urlset xmlns:news='n' xmlns:image='i'><url>\n<loc> https://a.example/"), F.when(k == 3, "2004/07/09/").otherwise(""), F.when(k == 2, "other?x=item").otherwise("item"), n, F.lit(" </loc>"),
        some(k == 0, "<lastmod>1999-99-99</lastmod><news:news><news:publication_date>", F.col("day"), "</news:publication_date></news:news>"), some((k == 1) | (k == 2), "<lastmod>", F.col("day"), "</lastmod>"),
        some(k == 3, "<lastmod>", F.lit("soon"), "</lastmod>"), some(F.col("id") % 3 == 0, "<news:title><![CDATA[A &amp; &quot;", n, "&quot;]]></news:title>"),
        some(F.col("id") % 2 == 0, "<image:image><image:loc>https://i.example/", n, ".jpg</image:loc></image:image>"), F.lit("</url></urlset>"))
    return P.sitemap_articles(o.select(xml.alias("xml")), "xml", "1994-01-01", "2004-12-31", "item")


@query(r"""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(substr(html, 1, 300000), '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS title FROM pages""")
def html_title(spark, d):
    """Titles of the pages."""
    return table(spark, d, "pages").select("page_id", P.html_title(F.col("html")).alias("title"))


@query("""SELECT s.id, s.klass, s.source, c.c_mktsegment AS segment, n.n_name AS nation FROM s JOIN customer c ON CAST(s.author AS BIGINT) = c.c_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE s.posted_at >= TIMESTAMP '2024-01-05'""", SIGHTINGS)
def catalog_join(spark, d):
    """Sightings with two catalogue tables, from a start date on."""
    s = sightings(spark, d).where(F.col("posted_at") >= F.lit("2024-01-05").cast("timestamp_ntz"))
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return s.join(c, s["author"].cast("long") == c["c_custkey"]).join(n, n["n_nationkey"] == c["c_nationkey"]).select("id", "klass", "source", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))


# -- sinks and mutations -----------------------------------------------------------------------------------------------

_HALVES = "a AS (SELECT event_id AS id, user_id, event_type, value FROM events WHERE event_id % 3 = 0), b AS (SELECT event_id AS id, user_id, event_type, value FROM events WHERE event_id % 3 <> 0)"


def _halves(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value")
    return e.where("id % 3 = 0"), e.where("id % 3 <> 0")


@query("""SELECT id, user_id, event_type FROM (SELECT id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY id) AS p FROM a) WHERE p = 1
UNION ALL SELECT id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY id) AS p FROM b) b1 WHERE p = 1
AND NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b1.user_id AND a.event_type = b1.event_type))""", _HALVES)
def insert_ignore(spark, d):
    """A second batch into a catalogue with a unique key: the first writer of a key wins."""
    a, b = (x.drop("value") for x in _halves(spark, d))
    return R.insert_ignore(R.dedupe_first(a, ["user_id", "event_type"], ["id"]), b, ["user_id", "event_type"], ["id"])


@query("""SELECT user_id, arg_max(id, r) AS id, arg_max(event_type, r) AS event_type FROM (SELECT *, id + 10000000000 * w AS r FROM (SELECT *, 0 AS w FROM a UNION ALL SELECT *, 1 AS w FROM b)) GROUP BY user_id""", _HALVES)
def upsert_replace(spark, d):
    """A second batch over a catalogue: the last writer of a key wins."""
    a, b = (x.select("user_id", "id", "event_type") for x in _halves(spark, d))
    return R.upsert(R.dedupe_first(a, ["user_id"], [F.desc("id")]), b, ["user_id"], [F.desc("id")])


@query("""SELECT o.o_orderkey AS id, coalesce(CASE WHEN l.n > 4 THEN l.flag END, o.o_orderstatus) AS status FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_returnflag) AS flag, count(*) AS n FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey""")
def update_by_key(spark, d):
    """Order states replaced where the lines of an order give a new one."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    changes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_returnflag").alias("status"), F.count("*").alias("n")).where("n > 4")
    return R.update_by_key(o, changes.select("id", "status"), "id", ["status"])


@query("""SELECT s.id, coalesce(s.reposts, e.value2) AS reposts, e.id IS NOT NULL AS done FROM s LEFT JOIN (SELECT event_id AS id, CAST(floor(value) AS BIGINT) % 9 AS value2 FROM events WHERE event_id % 2 = 0) e ON e.id = s.id""", SIGHTINGS)
def fill_missing(spark, d):
    """Missing counters filled from a second look, which marks the rows it has seen."""
    s = sightings(spark, d).select("id", "reposts", F.lit(False).alias("done"))
    e = table(spark, d, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("id"), (F.floor("value").cast("long") % 9).alias("reposts"))
    return R.fill_missing(s, e, "id", ["reposts"], "done")


@query("""SELECT source, query, post_url, author, headline, domain, image_url FROM (SELECT *, row_number() OVER (PARTITION BY post_url, image_url ORDER BY old DESC, id) AS p FROM
(SELECT page_id AS id, 1 AS old, 'site' AS source, 'term' AS query, url AS post_url, 'old' AS author, CAST(NULL AS VARCHAR) AS headline, 'old' AS domain, 'i' || page_id % 50 AS image_url FROM pages WHERE page_id % 4 = 0
 UNION ALL SELECT page_id, 0, 'site', 'sitemap', url, 'outlet', substr(html, 1, 20), 'outlet', 'i' || page_id % 50 FROM pages WHERE page_id % 3 > 0)) WHERE p = 1""")
def insert_select(spark, d):
    """Articles that have a picture, queued as items with constants for what they lack; items that are there stay."""
    p = table(spark, d, "pages").withColumn("image_url", F.concat(F.lit("i"), (F.col("page_id") % 50).cast("string")))
    items = p.where("page_id % 4 = 0").select("page_id", F.lit("site").alias("source"), F.lit("term").alias("query"), F.col("url").alias("post_url"), F.lit("old").alias("author"), F.lit(None).cast("string").alias("headline"), F.lit("old").alias("domain"), "image_url")
    articles = p.select("page_id", "url", F.lit("outlet").alias("outlet"), F.substring("html", 1, 20).alias("title"), F.when(F.col("page_id") % 3 > 0, F.col("image_url")).alias("image_url"))
    queued = articles.where("image_url IS NOT NULL").select("page_id", F.lit("site").alias("source"), F.lit("sitemap").alias("query"), F.col("url").alias("post_url"), F.col("outlet").alias("author"), F.col("title").alias("headline"), F.col("outlet").alias("domain"), "image_url")
    keys = ["post_url", "image_url"]
    return R.insert_ignore(R.dedupe_first(items, keys, ["page_id"]), queued, keys, ["page_id"]).drop("page_id")


@query("SELECT klass, count(*) AS n, count(DISTINCT sha1) AS pictures, round(avg(likes), 6) AS mean_likes, count(*) FILTER (WHERE source = 'bsky') AS bsky, count(*) FILTER (WHERE source = 'site') AS site FROM s GROUP BY klass", SIGHTINGS)
def metrics_document(spark, d):
    """The classes' measures as one nested JSON document, written and read again."""
    path = fresh_path(spark, "metrics")
    per = sightings(spark, d).groupBy("klass").agg(F.count("*").alias("n"), F.countDistinct("sha1").alias("pictures"), F.round(F.avg("likes"), 6).alias("mean_likes"),
                                                   F.struct(F.count_if(F.col("source") == "bsky").alias("bsky"), F.count_if(F.col("source") == "site").alias("site")).alias("sources"))
    D.write_document(per.agg(F.array_sort(F.collect_list(F.struct("klass", "n", "pictures", "mean_likes", "sources"))).alias("classes"), F.sum("n").alias("rows")), path)  # one entry a class
    c = D.read_document(spark, path).select(F.explode("classes").alias("c"))
    return c.select("c.klass", "c.n", "c.pictures", "c.mean_likes", "c.sources.bsky", "c.sources.site")


@query("SELECT klass, s, d, a, src FROM (SELECT klass, sha1 AS s, strftime(posted_at, '%Y-%m-%d') AS d, author AS a, source AS src FROM s WHERE klass <> 'other')", SIGHTINGS)
def class_arrays(spark, d):
    """The wall of every class, newest first, as JSON lines in a folder of its own, written and read again."""
    path = fresh_path(spark, "walls")
    rows = sightings(spark, d).where("klass != 'other'").select("klass", F.col("sha1").alias("s"), F.date_format("posted_at", "yyyy-MM-dd").alias("d"), F.col("author").alias("a"), F.col("source").alias("src"), "id")
    D.write_arrays(rows, "klass", [F.desc("d"), F.col("id")], path)
    return spark.read.schema("s string, d string, a string, src string, klass string").json(path).select("klass", "s", "d", "a", "src")


# -- projection, filter, dedupe, join, order ---------------------------------------------------------------------------

@query("SELECT id, coalesce(likes, 0) + coalesce(reposts, 0) AS engagement FROM s", SIGHTINGS)
def engagement(spark, d):
    """Likes and reposts, nulls as zero."""
    return sightings(spark, d).select("id", C.null_sum(F.col("likes"), F.col("reposts")).cast("long").alias("engagement"))


@query("SELECT id, concat_ws(' ', nullif(query, ''), nullif(CASE WHEN label % 2 = 0 THEN '' ELSE klass END, '')) AS both FROM s", SIGHTINGS)
def concat_nonempty(spark, d):
    """Parts that are there, joined by a space."""
    return sightings(spark, d).select("id", C.join_parts(F.col("query"), F.when(F.col("label") % 2 == 0, "").otherwise(F.col("klass"))).alias("both"))


@query("SELECT doc_id, substr(CASE WHEN doc_id % 3 = 0 THEN coalesce(nullif(text, ''), nullif(lang, '')) ELSE coalesce(nullif(lang, ''), nullif(text, '')) END, 1, 280) AS shown FROM documents")
def display_text(spark, d):
    """Which of two texts is shown depends on the source; 280 characters of it."""
    t, h = F.col("text"), F.col("lang")
    return table(spark, d, "documents").select("doc_id", F.substring(F.when(F.col("doc_id") % 3 == 0, C.first_nonempty(t, h)).otherwise(C.first_nonempty(h, t)), 1, 280).alias("shown"))


@query("SELECT id, query FROM s WHERE query IS NULL OR query NOT IN ('name')", SIGHTINGS)
def null_safe_not_in(spark, d):
    """Rows of no name query; a null query is none."""
    return sightings(spark, d).where(C.not_in(F.col("query"), ["name"])).select("id", "query")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def anti_join_pending(spark, d):
    """Customers that no event has touched."""
    return R.pending(table(spark, d, "orders").select("o_custkey").distinct(), table(spark, d, "events").select(F.col("user_id").alias("o_custkey")).where("o_custkey IS NOT NULL"), ["o_custkey"])


@query("SELECT DISTINCT sha1 FROM s WHERE source = 'site' AND klass <> 'error' EXCEPT SELECT sha1 FROM s WHERE label = 1", SIGHTINGS)
def topic_skip(spark, d):
    """Pictures of one source of which no sighting is on the topic."""
    s = sightings(spark, d)
    wide = s.where((F.col("source") == "site") & (F.col("klass") != "error")).select("sha1").distinct()
    return wide.join(s.where("label = 1").select("sha1"), "sha1", "left_anti")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '(item|page|post|news|[0-9]+)')")
def slug_filter(spark, d):
    """Pages whose URL has one of the slugs, whatever its case."""
    return table(spark, d, "pages").where(F.col("url").rlike("(?i)(item|page|post|news|[0-9]+)")).select("page_id", "url")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\p{L}\p{N}_])(The|Of|And)($|[^\p{L}\p{N}_])')")
def names_subject(spark, d):
    """Texts that hold one of the names as a word, in this case."""
    return table(spark, d, "documents").where(F.col("text").rlike(f"{C.WORD_START}(The|Of|And){C.WORD_END}")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'that')")
def text_search(spark, d):
    """Texts that hold the needle."""
    return R.facets(table(spark, d, "documents"), needle="That").select("doc_id")


@query("SELECT id, klass FROM s ORDER BY md5('11-' || id), id LIMIT 50", SIGHTINGS)
def sample_k(spark, d):
    """Fifty rows at random, the same for the same seed."""
    return sightings(spark, d).orderBy(F.md5(F.concat(F.lit("11-"), F.col("id").cast("string")).cast("binary")), "id").limit(50).select("id", "klass")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, d):
    """One value out of a JSON column."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT author, sha1, id, klass FROM (SELECT *, row_number() OVER (PARTITION BY author, sha1 ORDER BY id) AS p FROM s) WHERE p = 1", SIGHTINGS)
def dedupe_first(spark, d):
    """The first sighting of each picture by each author."""
    return R.dedupe_first(sightings(spark, d), ["author", "sha1"], ["id"]).select("author", "sha1", "id", "klass")


@query("SELECT author, min(r) // 1000000000 AS part, min(r) % 1000000000 AS place FROM (SELECT author, id AS r FROM s WHERE klass = 'subject_left' UNION ALL SELECT author, 1000000000 + id AS r FROM s WHERE klass = 'subject_only') GROUP BY author", SIGHTINGS)
def union_distinct_ordered(spark, d):
    """Authors of two lists in order of first appearance."""
    s = sightings(spark, d)
    part = lambda k: s.where(F.col("klass") == k).select("author", F.col("id").alias("place"))
    return R.union_distinct_ordered([part("subject_left"), part("subject_only")], "author").select("author", F.col("part").cast("long").alias("part"), "place")


@query("SELECT id, CAST(CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 25, 8) AS BIGINT) % 7 AS BIGINT) AS shard FROM s", SIGHTINGS)
def hash_shard(spark, d):
    """Shard of every sighting."""
    return sightings(spark, d).select("id", C.hash_shard(F.col("id").cast("string"), 7).cast("long").alias("shard"))


@query("SELECT s.id, c.c_name AS name FROM s JOIN customer c ON CAST(s.author AS BIGINT) = c.c_custkey", SIGHTINGS)
def join_inner(spark, d):
    """Sightings with their authors' names."""
    s, c = sightings(spark, d), table(spark, d, "customer")
    return s.join(c, s["author"].cast("long") == c["c_custkey"]).select("id", F.col("c_name").alias("name"))


@query("SELECT DISTINCT author, domain FROM s", SIGHTINGS)
def distinct_rows(spark, d):
    """Authors with the domains they link to."""
    return sightings(spark, d).select("author", "domain").distinct()


@query("SELECT klass, count(*) AS n, count(DISTINCT sha1) AS pictures, count(DISTINCT author) AS authors FROM s GROUP BY klass", SIGHTINGS)
def counts_distinct(spark, d):
    """Sightings, pictures and authors of every class."""
    return sightings(spark, d).groupBy("klass").agg(F.count("*").alias("n"), F.countDistinct("sha1").alias("pictures"), F.countDistinct("author").alias("authors"))


@query("SELECT sha1, max(CASE WHEN query = 'name' THEN 1 ELSE 0 END) AS priority, max(posted_at) AS latest FROM s GROUP BY sha1", SIGHTINGS)
def priority_queue(spark, d):
    """Pictures to fetch, those of name queries first."""
    return R.priority_queue(sightings(spark, d), "sha1", F.col("query") == "name", "posted_at")


@query("""SELECT mode, CAST(place AS INTEGER) AS place, id, klass FROM (SELECT 'date' AS mode, row_number() OVER (ORDER BY posted_at DESC, id) AS place, id, klass FROM s UNION ALL SELECT 'likes', row_number() OVER (ORDER BY likes DESC, id), id, klass FROM s) WHERE place <= 200""", SIGHTINGS)
def sort_modes(spark, d):
    """The first two hundred rows by date and by likes with their places, each a top-k sort."""
    s = sightings(spark, d)

    def top(mode: str, *order):
        first = s.orderBy(*order).limit(200)  # the window below sees two hundred rows
        return first.select(F.lit(mode).alias("mode"), F.row_number().over(Window.orderBy(*order)).alias("place"), "id", "klass")

    return top("date", F.desc("posted_at"), F.col("id")).union(top("likes", F.desc("likes"), F.col("id")))


@query("SELECT sha1, id, likes FROM (SELECT *, row_number() OVER (PARTITION BY sha1 ORDER BY likes DESC, posted_at, id) AS p FROM s) WHERE p = 1 ORDER BY likes DESC, posted_at, id LIMIT 24", SIGHTINGS)
def topk_distinct(spark, d):
    """The 24 most liked distinct pictures."""
    return R.top_distinct(sightings(spark, d), "sha1", [F.desc("likes"), F.col("posted_at"), F.col("id")], 24).select("sha1", "id", "likes")


@query("SELECT domain, count(*) AS n FROM s GROUP BY domain ORDER BY n DESC, domain LIMIT 12", SIGHTINGS)
def topk_counter(spark, d):
    """The twelve commonest domains."""
    return sightings(spark, d).groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(12)


@query("SELECT id, klass FROM s ORDER BY posted_at DESC, id LIMIT 120 OFFSET 240", SIGHTINGS)
def page_offset(spark, d):
    """The third page of the wall."""
    return R.page(sightings(spark, d), [F.desc("posted_at"), F.col("id")], 2).select("id", "klass")


@query("SELECT id, label, klass FROM s WHERE strftime(posted_at, '%Y-%m-%d') LIKE '2024%' AND label IN (1, 4, 7) AND contains(lower(domain), 'site1')", SIGHTINGS)
def facet_query(spark, d):
    """A year, some labels and a needle."""
    s = sightings(spark, d).withColumn("date", F.date_format("posted_at", "yyyy-MM-dd"))
    return R.facets(s, "2024", [1, 4, 7], "Site1", text="domain").select("id", "label", "klass")


@query("SELECT s.id, f.id AS sibling, CAST(f.p AS INTEGER) AS place FROM s JOIN (SELECT * FROM (SELECT sha1, id, row_number() OVER (PARTITION BY sha1 ORDER BY posted_at, id) AS p FROM s) WHERE p <= 12) f ON f.sha1 = s.sha1", SIGHTINGS)
def siblings(spark, d):
    """For each sighting the first twelve of its picture."""
    return R.siblings(sightings(spark, d), "sha1", "id", [F.col("posted_at"), F.col("id")])


@query("SELECT sha1, id FROM (SELECT sha1, id, row_number() OVER (PARTITION BY sha1 ORDER BY posted_at DESC, id) AS p FROM s) WHERE p = 1", SIGHTINGS)
def fold_family(spark, d):
    """The newest sighting of each picture."""
    return R.fold(sightings(spark, d), "sha1", [F.desc("posted_at"), F.col("id")]).select("sha1", "id")


# -- scalar functions --------------------------------------------------------------------------------------------------

@query(r"SELECT page_id, coalesce(regexp_replace(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), ''), '^www\.', ''), 'none') AS domain FROM pages")
def url_domain(spark, d):
    """Domains of the pages."""
    return table(spark, d, "pages").select("page_id", C.url_domain(F.col("url"), F.lit("none")).alias("domain"))


@query("SELECT page_id, 'https://post.example/' || regexp_extract(url, '([^/]*)$', 1) AS link FROM pages")
def permalink(spark, d):
    """Permanent links built from the last part of the path."""
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("https://post.example/"), C.last_segment(F.col("url"))).alias("link"))


@query("SELECT page_id, regexp_extract(url, '//([a-z0-9-]+)\\.', 1) AS handle FROM pages")
def handle_extract(spark, d):
    """First label of the host."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"//([a-z0-9-]+)\.", 1).alias("handle"))


_URLS = """u0 AS (SELECT o_orderkey AS id, o_orderdate AS od, o_orderdate + INTERVAL 10 YEAR AS late FROM orders), u AS (SELECT id, od, late, 'https://a.example/' || CASE id % 11 WHEN 0 THEN strftime(late, '%Y/%m/%d') || '/x' WHEN 1 THEN 'map-' || strftime(late, '%Y-%m') || '.xml'
  WHEN 2 THEN 'sitemap-' || strftime(late, '%Y') || '.xml' WHEN 3 THEN '?yyyy=' || strftime(late, '%Y') || '&mm=' || strftime(late, '%m') WHEN 4 THEN '?yyyy=' || strftime(late, '%Y') || '&amp;mm=' || strftime(late, '%m') || '&amp;dd=' || strftime(late, '%d')
  WHEN 5 THEN 'sitemap-' || strftime(late, '%Y') || '.xml?mm=' || strftime(late, '%m') || '&dd=' || strftime(late, '%d') WHEN 6 THEN 'map' || strftime(late, '%Y%m') || '.xml' WHEN 7 THEN strftime(late, '%Y/%m%d') WHEN 8 THEN strftime(late, '%Y') || '-02-30'
  WHEN 9 THEN strftime(late, '%Y') || '-13.xml' ELSE strftime(od, '%Y/%m/%d') || '/x' END AS url FROM u0)"""


def _urls(spark, d):
    o = table(spark, d, "orders").withColumn("od", F.col("o_orderdate").cast("date")).withColumn("at", F.add_months("od", 120))
    day = lambda pattern, c="at": F.date_format(c, pattern)
    shapes = [
        F.concat(day("yyyy/MM/dd"), F.lit("/x")), F.concat(F.lit("map-"), day("yyyy-MM"), F.lit(".xml")), F.concat(F.lit("sitemap-"), day("yyyy"), F.lit(".xml")),
        F.concat(F.lit("?yyyy="), day("yyyy"), F.lit("&mm="), day("MM")), F.concat(F.lit("?yyyy="), day("yyyy"), F.lit("&amp;mm="), day("MM"), F.lit("&amp;dd="), day("dd")),
        F.concat(F.lit("sitemap-"), day("yyyy"), F.lit(".xml?mm="), day("MM"), F.lit("&dd="), day("dd")), F.concat(F.lit("map"), day("yyyyMM"), F.lit(".xml")), day("yyyy/MMdd"),
        F.concat(day("yyyy"), F.lit("-02-30")), F.concat(day("yyyy"), F.lit("-13.xml")), F.concat(day("yyyy/MM/dd", "od"), F.lit("/x"))]
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("https://a.example/"), choose(F.col("o_orderkey") % 11, dict(enumerate(shapes)))).alias("url"))


_SPAN = """sp AS (SELECT id, CASE WHEN id % 11 IN (0, 4, 5, 7) THEN CAST(late AS DATE) WHEN id % 11 IN (1, 3, 6) THEN CAST(date_trunc('month', late) AS DATE) WHEN id % 11 = 8 THEN make_date(year(late), 2, 1) WHEN id % 11 IN (2, 9) THEN make_date(year(late), 1, 1) WHEN year(od) >= 2000 THEN CAST(od AS DATE) END AS first_day,
  CASE WHEN id % 11 IN (0, 4, 5, 7) THEN CAST(late AS DATE) WHEN id % 11 IN (1, 3, 6) THEN last_day(late) WHEN id % 11 = 8 THEN last_day(make_date(year(late), 2, 1)) WHEN id % 11 IN (2, 9) THEN make_date(year(late), 12, 31) WHEN year(od) >= 2000 THEN CAST(od AS DATE) END AS last_day FROM u)"""


@query("SELECT id, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day FROM sp", f"{_URLS}, {_SPAN}")
def url_date_span(spark, d):
    """The days that a date in a URL stands for."""
    first, last = C.url_date_span(F.col("url"))
    return _urls(spark, d).select("id", first.cast("string").alias("first_day"), last.cast("string").alias("last_day"))


@query("SELECT id FROM sp WHERE NOT coalesce(last_day < DATE '2000-06-01' OR first_day > DATE '2006-06-30', false)", f"{_URLS}, {_SPAN}")
def span_overlap(spark, d):
    """URLs whose days may overlap the window; those without a date stay."""
    first, last = C.url_date_span(F.col("url"))
    keep = F.coalesce(C.spans_overlap(first, last, F.lit("2000-06-01").cast("date"), F.lit("2006-06-30").cast("date")), F.lit(True))
    return _urls(spark, d).where(keep).select("id")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def iso_compact(spark, d):
    """Compact stamps as ISO 8601."""
    return table(spark, d, "events").select("event_id", C.iso_from_compact(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).alias("iso"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def month_bucket(spark, d):
    """Month of every order."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2023-09-26')) / 86400e6, 6) AS days FROM events")
def epoch_days(spark, d):
    """Days since the start, with fractions."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2023-09-26 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.round(micros / 86400e6, 6).alias("days"))


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS safe FROM pages""")
def html_escape(spark, d):
    """Pages with their markup escaped."""
    return table(spark, d, "pages").select("page_id", C.html_escape(F.col("html")).alias("safe"))


@query("SELECT doc_id, sha1(text) AS sha1, md5(text) AS md5 FROM documents")
def content_hash(spark, d):
    """Digests of the texts."""
    return table(spark, d, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query("SELECT a.id, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM hv a JOIN hv b ON b.id = a.id + 1", HASHES)
def hamming(spark, d):
    """Differing bits of neighbours' hashes."""
    h = hashes(spark, d)
    return h.join(h.select((F.col("id") - 1).alias("id"), F.col("h").alias("g")), "id").select("id", C.hamming(F.col("h"), F.col("g")).cast("int").alias("distance"))


@query("""SELECT conv_id, turn, 't' || conv_id || '-' || k AS image_url, CAST(NULL AS VARCHAR) AS headline, CAST(NULL AS VARCHAR) AS link_url FROM conversations, range(1, 4) r(k) WHERE (turn % 4 = 0 OR turn % 4 = 2) AND k <= 1 + conv_id % 3
UNION ALL SELECT conv_id, turn, 'card' || turn, role, 'https://l.example/' || turn FROM conversations WHERE turn % 4 = 1 AND conv_id % 5 > 0""")
def embed_explode(spark, d):
    """Pictures in the nested embeds of posts: of their own, of a link's card, or of the media beside a quoted record."""
    c = table(spark, d, "conversations")
    url = lambda k: F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit(f"-{k}"))
    put = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    kind = lambda name: F.lit(f"app.bsky.embed.{name}").alias("$type")
    none = F.lit(None).cast("string")
    images = F.slice(F.array(put(thumb=url(1), fullsize=F.lit("f")), put(thumb=F.lit(""), fullsize=url(2)), put(thumb=url(3), fullsize=none)), 1, (1 + F.col("conv_id") % 3).cast("int"))
    pictures = F.struct(kind("images#view"), images.alias("images"))
    card = put(thumb=F.when(F.col("conv_id") % 5 > 0, F.concat(F.lit("card"), F.col("turn").cast("string"))), title=F.col("role"), uri=F.concat(F.lit("https://l.example/"), F.col("turn").cast("string")))
    way = F.col("turn") % 4
    embed = F.when(way == 0, F.to_json(pictures)).when(way == 1, F.to_json(F.struct(kind("external#view"), card.alias("external")))).when(way == 2, F.to_json(F.struct(kind("recordWithMedia#view"), pictures.alias("media"))))
    return c.select("conv_id", "turn", F.inline(D.embedded_pictures(embed)))


# -- alarm score -------------------------------------------------------------------------------------------------------

ALARM = ((3, rf"{C.WORD_START}(?:the|der|les)[a-z]*"), (2, rf"{C.WORD_START}(?:of|und|que){C.WORD_END}"), (1, rf"{C.WORD_START}(?:with|mit|that|then){C.WORD_END}"))
OPENER = rf"(?:The|Of|La){C.WORD_END}"
# in the SQL every character outside words is doubled, so that matches can take one on either side
_ALARM = r"""a AS (SELECT doc_id, text AS t, regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g') AS w FROM documents), b AS (SELECT doc_id, t, len(regexp_extract_all(t, '[A-Za-z'']+')) AS words,
  regexp_extract_all(w, '(?i)(?:^|[^\p{L}\p{N}_])((?:the|der|les)[a-z]*)', 1) AS c3, regexp_extract_all(w, '(?i)(?:^|[^\p{L}\p{N}_])(of|und|que)(?:$|[^\p{L}\p{N}_])', 1) AS c2, regexp_extract_all(w, '(?i)(?:^|[^\p{L}\p{N}_])(with|mit|that|then)(?:$|[^\p{L}\p{N}_])', 1) AS c1,
  regexp_matches(t, '(?i)^\s*(?:The|Of|La)(?:$|[^\p{L}\p{N}_])') AS starts,
  len(list_filter(regexp_extract_all(t, '[A-Za-z'']+'), lambda w: length(w) >= 4 AND w = upper(w) AND regexp_matches(w, '[A-Z]'))) >= 2 AS shouted FROM a)"""


def _alarm(spark, d):
    score, hits = C.alarm_score(F.col("text"), ALARM, OPENER)
    return table(spark, d, "documents").select("doc_id", score.alias("score"), hits.alias("hits"))


@query("""SELECT doc_id, CASE WHEN words > 0 THEN round((CASE WHEN starts THEN 2 ELSE 0 END + CASE WHEN shouted THEN 1 ELSE 0 END + 0.5e0 * least(length(t) - length(replace(t, '!', '')), 3)
  + 3 * len(c3) + 2 * len(c2) + len(c1)) / sqrt(words), 3) ELSE 0e0 END AS score FROM b""", _ALARM)
def alarm_score(spark, d):
    """Alarm score of every text."""
    return _alarm(spark, d).select("doc_id", "score")


@query("""SELECT doc_id, CAST(CASE WHEN words > 0 THEN len(c3) + len(c2) + len(c1) + CASE WHEN starts THEN 1 ELSE 0 END + CASE WHEN shouted THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS hits FROM b""", _ALARM)
def alarm_hits(spark, d):
    """Number of hits of every text."""
    return _alarm(spark, d).select("doc_id", F.size("hits").alias("hits"))


@query("""SELECT hit, count(*) AS n FROM (SELECT unnest(list_transform(c3 || c2 || c1, lambda x: lower(x))) AS hit FROM b WHERE words > 0) GROUP BY hit ORDER BY n DESC, hit LIMIT 25""", _ALARM)
def alarm_words(spark, d):
    """The 25 commonest hits."""
    return _alarm(spark, d).select(F.explode("hits").alias("hit")).where(~F.col("hit").isin("opener", "caps")).groupBy("hit").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hit").limit(25)
