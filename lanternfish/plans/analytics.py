"""Queries of embeddings, rules, aggregates, statistics, families, series and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish.functions import columns as C
from lanternfish.operators import embedding as E, hawkes, images as I, near as N, relational as R, series as S, statistics as T
from lanternfish.plans.registering import registered
from lanternfish.plans.views import HASHES, SIGHTINGS, hashes, sightings, table
from lanternfish.streaming import micro

QUERIES, ORACLES, query = registered()


# -- embeddings and rules ----------------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
UNITS = f"""e0 AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), e1 AS (SELECT *, sqrt({_DOT.format(a='e', b='e')}) + 1e-9 AS size FROM e0),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / size) AS v FROM e1)"""
SCORES = UNITS + f""", p AS (SELECT u.label AS prompt, u.v AS pv FROM u JOIN (SELECT label, min(vec_id) AS vec_id FROM u GROUP BY label) f ON f.vec_id = u.vec_id),
sc AS (SELECT vec_id, label, prompt, {_DOT.format(a='v', b='pv')} AS cos FROM u, p)"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def _prompts(spark, d):
    v = _vectors(spark, d)
    return R.dedupe_first(v, ["label"], ["vec_id"]).select(F.col("label").alias("prompt"), F.col("e").alias("pe"))


def _scored(spark, d):
    return E.nearest_reference(_vectors(spark, d), "e", _prompts(spark, d), "prompt", "pe")


@query("SELECT vec_id, round(v[1], 6) AS first, round(v[64], 6) AS last FROM u", UNITS)
def l2_normalize(spark, d):
    """Unit vectors."""
    u = C.unit(F.col("e"))
    return _vectors(spark, d).select("vec_id", F.round(u[0], 6).alias("first"), F.round(u[63], 6).alias("last"))


@query("SELECT vec_id, round(avg(cos), 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC) AS r FROM sc) WHERE r <= 5 GROUP BY vec_id", SCORES)
def topk_mean_cosine(spark, d):
    """Mean of the five largest cosines to the reference vectors."""
    return E.top_mean_cosine(_vectors(spark, d), "vec_id", "e", _prompts(spark, d), "pe")


@query("SELECT picture, vec_id, prompt, round(cos, 6) AS cos FROM (SELECT vec_id // 4 AS picture, *, row_number() OVER (PARTITION BY vec_id // 4 ORDER BY cos DESC, vec_id) AS r FROM sc) WHERE r = 1", SCORES)
def best_match(spark, d):
    """The best face of every picture."""
    s = _scored(spark, d).withColumn("picture", F.floor(F.col("vec_id") / 4))
    return E.best_match(s, "picture", "cos", "vec_id").select("picture", "vec_id", "prompt", F.round("cos", 6).alias("cos"))


@query("SELECT vec_id // 4 AS picture, round(max(CASE WHEN vec_id % 100 < 50 THEN cos END), 6) AS left_max, round(max(CASE WHEN vec_id % 100 >= 50 THEN cos END), 6) AS right_max FROM sc GROUP BY 1", SCORES)
def half_max(spark, d):
    """Best similarity on either half of every picture."""
    s = _scored(spark, d).select(F.floor(F.col("vec_id") / 4).alias("picture"), (F.col("vec_id") % 100 / 100.0).alias("cx"), "cos")
    h = E.half_maxima(s, "picture", "cx", "cos")
    return h.select("picture", F.round("left_max", 6).alias("left_max"), F.round("right_max", 6).alias("right_max"))


def _mean(rows: str) -> str:
    return f"(SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {rows}) GROUP BY i))"


def _unit_of(rows: str) -> str:
    return f"(SELECT list_transform(m, lambda x: x / size) AS c FROM (SELECT m, sqrt({_DOT.format(a='m', b='m')}) + 1e-9 AS size FROM {rows}))"


CENTROID = UNITS + f", m0 AS {_mean('u')}" + "".join(
    f", c{k} AS {_unit_of(f'm{k}')}, s{k} AS (SELECT v, {_DOT.format(a='v', b='c')} AS s FROM u, c{k}), k{k} AS (SELECT v FROM s{k} WHERE s >= (SELECT quantile_cont(s, 0.25) FROM s{k}) - 1e-12), m{k + 1} AS {_mean(f'k{k}')}"
    for k in range(3)) + f", c3 AS {_unit_of('m3')}"


@query("SELECT CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM (SELECT unnest(c) AS x, generate_subscripts(c, 1) AS i FROM c3)", CENTROID)
def trimmed_centroid(spark, d):
    """Centroid of all vectors after three rounds of trimming."""
    return E.trimmed_centroid(_vectors(spark, d), "e").select(F.posexplode("centroid").alias("i", "x")).select("i", F.round("x", 6).alias("x"))


@query(f"SELECT picture, vec_id, round(s, 6) AS s FROM (SELECT vec_id // 4 AS picture, vec_id, {_DOT.format(a='v', b='c')} AS s, row_number() OVER (PARTITION BY vec_id // 4 ORDER BY {_DOT.format(a='v', b='c')} DESC, vec_id) AS r FROM u, c3) WHERE r = 1 AND s >= 0.05e0", CENTROID)
def centroid_select(spark, d):
    """The vector of every picture that is nearest the centroid, if it is near enough."""
    v = _vectors(spark, d)
    s = E.nearest_reference(v, "e", E.trimmed_centroid(v, "e").select(F.lit(0).alias("ref"), "centroid"), "ref", "centroid").withColumn("picture", F.floor(F.col("vec_id") / 4))
    best = E.best_match(s, "picture", "cos", "vec_id").where(F.col("cos") >= 0.05)
    return best.select("picture", "vec_id", F.round("cos", 6).alias("s"))


@query("""SELECT vec_id, best_group, best_share, object_mass, best_cos, first FROM (SELECT vec_id, arg_max(g, share) FILTER (WHERE g <> 4) AS best_group, round(max(share) FILTER (WHERE g <> 4), 6) AS best_share,
round(1 - coalesce(sum(share) FILTER (WHERE g = 4), 0e0), 6) AS object_mass, round(max(cos) FILTER (WHERE g <> 4), 6) AS best_cos FROM gr GROUP BY vec_id) JOIN
(SELECT vec_id, string_agg(prompt, ',' ORDER BY r) AS first FROM (SELECT vec_id, prompt, row_number() OVER (PARTITION BY vec_id ORDER BY share DESC, prompt) AS r FROM sh) WHERE r <= 5 GROUP BY vec_id) USING (vec_id)""",
       SCORES + """, ex AS (SELECT vec_id, prompt, prompt % 5 AS g, cos, exp(5 * (cos - max(cos) OVER (PARTITION BY vec_id))) AS e FROM sc), sh AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS share FROM ex),
gr AS (SELECT vec_id, g, sum(share) AS share, max(cos) AS cos FROM sh GROUP BY vec_id, g)""")
def zero_shot_groups(spark, d):
    """Zero-shot label groups of every vector, and its first five prompts."""
    prompts = _prompts(spark, d).withColumn("g", F.col("prompt") % 5)
    z = E.zero_shot(_vectors(spark, d), "vec_id", "e", prompts, "prompt", "g", "pe", 4, heat=5.0)
    return z.select("vec_id", F.col("best_group").cast("int").alias("best_group"), "best_share", "object_mass", "best_cos", F.concat_ws(",", F.col("top.prompt").cast("array<string>")).alias("first"))


_LINES = "l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity / 5 AS q, l_discount AS disc, l_tax AS tax, l_linenumber / 8e0 AS cx FROM lineitem)"


def _lines(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") / 5).alias("q"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), (F.col("l_linenumber") / F.lit(8.0)).alias("cx"))


@query("SELECT k, n, q >= 5 AND 0.755e0 + tax * 3 >= 0.8e0 AND (disc * 8 >= 0.75e0 OR (0.755e0 + tax * 3 >= 0.95e0 AND disc * 8 >= 0.45e0)) AS seam FROM l", _LINES)
def seam_rule(spark, d):
    """Whether a seam holds."""
    x = F.col
    return _lines(spark, d).select("k", "n", E.seam_holds(x("q"), x("disc") * 8, F.lit(0.755) + x("tax") * 3).alias("seam"))


@query("""SELECT k, n, round(CASE WHEN n % 2 = 0 AND greatest(0.5e0, cx, q / 11) < 0.92e0 THEN greatest(0.5e0, cx, q / 11) WHEN n % 2 = 1 AND least(0.5e0, cx, q / 11) > 0.08e0 THEN 0e0 END, 6) AS x0,
round(CASE WHEN n % 2 = 0 AND greatest(0.5e0, cx, q / 11) < 0.92e0 THEN 1e0 WHEN n % 2 = 1 AND least(0.5e0, cx, q / 11) > 0.08e0 THEN least(0.5e0, cx, q / 11) END, 6) AS x1 FROM l""", _LINES)
def crop_bounds(spark, d):
    """Range of the width that shows the object."""
    a, b = E.side_crop(F.col("cx"), F.col("cx"), F.col("q") / 11, F.col("n") % 2 == 0)
    return _lines(spark, d).select("k", "n", F.round(a, 6).alias("x0"), F.round(b, 6).alias("x1"))


@query("""SELECT k, n, CASE WHEN su AND th AND cx < 0.5e0 THEN 'subject_left' WHEN su AND th THEN 'subject_right' WHEN su THEN 'subject_only' WHEN th THEN 'object_only' ELSE 'other' END AS klass
FROM (SELECT *, disc * 9.9e0 >= 0.5e0 AS su, tax * 12.3e0 >= 0.5e0 AND (disc * 9.9e0 >= 0.5e0 OR q / 21 >= 0.24e0) AS th FROM l)""", _LINES)
def classify_rule(spark, d):
    """Class of every picture."""
    x = F.col
    return _lines(spark, d).select("k", "n", E.classify(x("disc") * 9.9, x("tax") * 12.3, x("q") / 21, x("cx")).alias("klass"))


def _classes(spark, d, mass_least: float = 0.5):
    x = F.col
    return _lines(spark, d).select("k", "n", E.classify(x("disc") * 9.9, x("tax") * 12.3, x("q") / 21, x("cx"), mass_least=mass_least).alias("klass"))


def _classes_sql(mass_least: float) -> str:
    return f"""(SELECT k, n, CASE WHEN su AND th AND cx < 0.5e0 THEN 'subject_left' WHEN su AND th THEN 'subject_right' WHEN su THEN 'subject_only' WHEN th THEN 'object_only' ELSE 'other' END AS klass
FROM (SELECT *, disc * 9.9e0 >= 0.5e0 AS su, tax * 12.3e0 >= {mass_least}e0 AND (disc * 9.9e0 >= 0.5e0 OR q / 21 >= 0.24e0) AS th FROM l))"""


@query(f"SELECT k, n, klass, substr(sha1(k || '-' || n), 1, 2) AS folder FROM {_classes_sql(0.5)} WHERE klass <> 'other'", _LINES)
def retention(spark, d):
    """Pictures whose file is kept, with its folder: those of any class but the last."""
    name = F.concat(F.col("k").cast("string"), F.lit("-"), F.col("n").cast("string"))
    return _classes(spark, d).where("klass != 'other'").withColumn("folder", F.substring(F.sha1(name.cast("binary")), 1, 2))


@query(f"SELECT klass, count(*) AS n, count(*) FILTER (WHERE klass <> was) AS moved FROM {_classes_sql(0.6)} a JOIN (SELECT k, n, klass AS was FROM {_classes_sql(0.5)}) b USING (k, n) GROUP BY klass", _LINES)
def reclassify_counts(spark, d):
    """Classes after the rule has changed, and how many pictures each has gained: old verdicts are updated by key, then counted."""
    was = _classes(spark, d).withColumn("id", F.struct("k", "n")).withColumnRenamed("klass", "was")
    new = _classes(spark, d, 0.6).select(F.struct("k", "n").alias("id"), "klass")
    return was.join(new, "id").groupBy("klass").agg(F.count("*").alias("n"), F.count_if(F.col("klass") != F.col("was")).alias("moved"))


@query("SELECT DISTINCT sha1, false AS known FROM (SELECT sha1(text) AS sha1, doc_id FROM documents WHERE text IS NOT NULL) a WHERE doc_id % 3 = 0 AND sha1 NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 3 = 1 AND text IS NOT NULL)")
def score_new_only(spark, d):
    """Contents that the costly stage has yet to see: those scored before are only linked."""
    c = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"))
    return R.pending(c.where("doc_id % 3 = 0").select("sha1").distinct(), c.where("doc_id % 3 = 1").select("sha1"), ["sha1"]).withColumn("known", F.lit(False))


@query("""SELECT user_id, CAST(max(span) AS INTEGER) AS longest FROM (SELECT user_id, run, max(day) - min(day) + 1 AS span FROM (SELECT user_id, day, sum(fresh) OVER (PARTITION BY user_id ORDER BY day) AS run FROM
(SELECT user_id, day, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) <= 1 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events))) GROUP BY 1, 2) GROUP BY user_id""")
def longest_run(spark, d):
    """Longest run of days on which a user was seen."""
    e = table(spark, d, "events").select("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"))
    return R.longest_runs(e, ["user_id"], "day")


def pictures(spark, d):
    """Every vector as a small picture between flat borders whose widths its id chooses: its components as pixels, in 22 rows of
    changing contrast."""
    v = _vectors(spark, d)
    left, top = F.pmod("vec_id", F.lit(9)).cast("int"), F.pmod("vec_id", F.lit(3)).cast("int")
    flat = lambda n: F.array_repeat(F.lit(7.0), n)
    inner = lambda i: F.concat(flat(left), F.transform("e", lambda x: 128 + 80 * x * (2 + 3 * i % 7)), flat(16 - left))
    rows = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.when(i.between(top, top + 21), inner(i)).otherwise(flat(F.size("e") + 16)))
    return v.select("vec_id", F.flatten(rows).alias("pixels"), (F.size("e") + 16).alias("width"))


# The same pictures a pixel a row, and what hashes make of them: means over parts of the picture, cosine frequencies, bits.
PIXELS = """ed AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, vec_id % 9 AS l, vec_id % 3 AS t FROM embeddings), px AS (SELECT vec_id, i, j, len(e) + 16 AS width,
CASE WHEN i BETWEEN t AND t + 21 AND j BETWEEN l AND l + len(e) - 1 THEN 128 + 80 * e[j - l + 1] * (2 + 3 * i % 7) ELSE 7e0 END AS v FROM ed, range(0, 24) a(i), range(0, len(e) + 16) b(j))"""
_BOXES = PIXELS + """, rl AS (SELECT vec_id, i, stddev_pop(v) > 3 AS lively FROM px GROUP BY 1, 2), cl AS (SELECT vec_id, j, any_value(width) AS width, stddev_pop(v) > 3 AS lively FROM px GROUP BY 1, 2),
rb AS (SELECT vec_id, min(i) FILTER (WHERE lively) AS a, max(i) FILTER (WHERE lively) + 1 AS b, count(*) FILTER (WHERE lively) >= 16 AS enough FROM rl GROUP BY 1),
cb AS (SELECT vec_id, any_value(width) AS width, min(j) FILTER (WHERE lively) AS c, max(j) FILTER (WHERE lively) + 1 AS d, count(*) FILTER (WHERE lively) >= 16 AS enough FROM cl GROUP BY 1)"""
_SHARE = "greatest(0e0, least((part + 1) * n / parts, pos + 1) - greatest(part * n / parts, pos)) * parts / n"
_SHRUNK = PIXELS + f""", ax AS (SELECT parts, n, part, pos, {_SHARE} AS w FROM (SELECT CAST(parts AS DOUBLE) AS parts, CAST(n AS DOUBLE) AS n FROM (VALUES (8), (32), (9)) x(parts), (SELECT 24 AS n UNION SELECT DISTINCT width FROM px)) s, range(0, 32) p(part), range(0, CAST(n AS BIGINT)) a(pos) WHERE part < parts),
sh AS (SELECT vec_id, r.parts, r.part AS c, k.part AS d, sum(v * r.w * k.w) AS v FROM px JOIN ax r ON r.n = 24 AND r.pos = i AND r.w > 0 JOIN ax k ON k.n = width AND k.pos = j AND k.w > 0 AND (r.parts, k.parts) IN ((8, 9), (32, 32)) GROUP BY 1, 2, 3, 4),
half AS (SELECT vec_id, k, d, sum(v * cos(pi() * k * (2 * c + 1) / 64)) AS v FROM sh, range(0, 8) f(k) WHERE parts = 32 GROUP BY 1, 2, 3), low AS (SELECT vec_id, k, m, sum(v * cos(pi() * m * (2 * d + 1) / 64)) AS v FROM half, range(0, 8) f(m) GROUP BY 1, 2, 3),
ph AS (SELECT vec_id, 8 * k + m AS pos, v > median(v) OVER (PARTITION BY vec_id) AS bit FROM low), dh AS (SELECT vec_id, 8 * c + d AS pos, lead(v) OVER (PARTITION BY vec_id, c ORDER BY d) > v AS bit FROM sh WHERE parts = 8)"""
_WORD = "CAST(CASE WHEN {u} >= 9223372036854775808 THEN CAST({u} AS HUGEINT) - 18446744073709551616 ELSE {u} END AS BIGINT)"  # 64 bits as a signed number
_BITS = "sum(CASE WHEN bit THEN CAST(1 AS HUGEINT) << CAST(63 - pos AS INTEGER) ELSE 0 END)"


_pictures = pictures  # its earlier name


@query("SELECT vec_id, CAST(CASE WHEN ok THEN a ELSE 0 END AS INTEGER) AS top, CAST(CASE WHEN ok THEN b ELSE 24 END AS INTEGER) AS bottom, CAST(CASE WHEN ok THEN c ELSE 0 END AS INTEGER) AS \"left\", CAST(CASE WHEN ok THEN d ELSE width END AS INTEGER) AS \"right\" FROM (SELECT *, rb.enough AND cb.enough AS ok FROM rb JOIN cb USING (vec_id))", _BOXES)
def border_trim(spark, d):
    """Box of the varying part of every picture."""
    return I.trim_borders(pictures(spark, d), "vec_id", "pixels", "width")


@query()
def seam_find(spark, d):
    """The likeliest seam of every picture, with its band."""
    return I.find_seams(pictures(spark, d), "vec_id", "pixels", "width")


@query(f"SELECT vec_id, {_WORD.format(u='p.u')} AS phash, {_WORD.format(u='q.u')} AS dhash FROM (SELECT vec_id, {_BITS} AS u FROM ph GROUP BY 1) p JOIN (SELECT vec_id, {_BITS} AS u FROM dh WHERE bit IS NOT NULL GROUP BY 1) q USING (vec_id)", _SHRUNK)
def picture_hash(spark, d):
    """Perceptual and difference hash of every picture."""
    return I.picture_hashes(pictures(spark, d), "vec_id", "pixels", "width")


# -- aggregates --------------------------------------------------------------------------------------------------------

@query("SELECT klass, count(*) AS n, count(DISTINCT sha1) AS pictures, round(avg(likes), 6) AS mean_likes, round(avg(CASE WHEN likes > 0 THEN 1e0 ELSE 0e0 END), 6) AS nonzero, count(*) FILTER (WHERE source = 'bsky') AS bsky, count(*) FILTER (WHERE source = 'gdelt') AS gdelt, count(*) FILTER (WHERE source = 'site') AS site FROM s GROUP BY klass", SIGHTINGS)
def class_summary(spark, d):
    """Sightings, pictures, means and sources of every class."""
    by = [F.count_if(F.col("source") == x).alias(x) for x in ("bsky", "gdelt", "site")]
    return sightings(spark, d).groupBy("klass").agg(F.count("*").alias("n"), F.countDistinct("sha1").alias("pictures"), F.round(F.avg("likes"), 6).alias("mean_likes"), F.round(F.avg(F.when(F.col("likes") > 0, 1.0).otherwise(0.0)), 6).alias("nonzero"), *by)


_FIRST = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha1, domain ORDER BY id) AS p FROM s) WHERE p = 1)"


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE klass IN ('subject_left', 'subject_right', 'subject_only')) AS face, count(*) FILTER (WHERE klass = 'subject_left') AS lefts, count(*) FILTER (WHERE klass = 'subject_right') AS rights,
round(count(*) FILTER (WHERE klass = 'subject_left') / nullif(CAST(count(*) FILTER (WHERE klass IN ('subject_left', 'subject_right')) AS DOUBLE), 0), 6) AS left_share FROM f GROUP BY source""", f"{SIGHTINGS}, {_FIRST}")
def conditional_shares(spark, d):
    """Counts and shares over pictures counted once."""
    f = R.dedupe_first(sightings(spark, d), ["sha1", "domain"], ["id"])
    k = F.col("klass")
    left, right = F.count_if(k == "subject_left"), F.count_if(k == "subject_right")
    return f.groupBy("source").agg(F.count("*").alias("n"), F.count_if(k.isin("subject_left", "subject_right", "subject_only")).alias("face"), left.alias("lefts"), right.alias("rights"), F.round(F.try_divide(left, left + right), 6).alias("left_share"))


_MONTHS = """m0 AS (SELECT o_orderkey AS id, o_custkey AS author, strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS klass FROM orders JOIN customer ON o_custkey = c_custkey),
m1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY author, month ORDER BY id) AS p FROM m0) WHERE p = 1), m AS (SELECT month, count(*) AS n, count(*) FILTER (WHERE klass = 'F') AS k FROM m1 GROUP BY month)"""


def _months(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("klass"))
    return R.dedupe_first(rows, ["author", "month"], ["id"]).groupBy("month").agg(F.count("*").alias("n"), F.count_if(F.col("klass") == "F").alias("k"))


def _wilson_sql(k: str, n: str) -> str:
    mid, half = f"({k} / {n} + 1.9208e0 / {n}) / (1 + 3.8416e0 / {n})", f"1.96e0 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8416e0 / (4 * {n} * {n})) / (1 + 3.8416e0 / {n})"
    return f"round({mid} - {half}, 4) AS low, round({mid} + {half}, 4) AS high"


@query(f"SELECT month, n, k, round(k / CAST(n AS DOUBLE), 6) AS share, {_wilson_sql('CAST(k AS DOUBLE)', 'CAST(n AS DOUBLE)')} FROM m", _MONTHS)
def monthly_share(spark, d):
    """Share of one class in every month, each author once a month, with its interval."""
    low, high = C.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return _months(spark, d).select("month", "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("share"), low.alias("low"), high.alias("high"))


@query("SELECT domain, n, lefts FROM (SELECT domain, count(*) AS n, count(*) FILTER (WHERE klass = 'subject_left') AS lefts FROM s WHERE domain <> 'site0.example' GROUP BY domain) WHERE lefts > 0", SIGHTINGS)
def outlet_share(spark, d):
    """Outlets with lefts, but for one."""
    return sightings(spark, d).where("domain <> 'site0.example'").groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("klass") == "subject_left").alias("lefts")).where("lefts > 0").orderBy(F.desc("lefts"), "domain")


@query("""SELECT author, month, n, lefts, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(lefts) OVER (PARTITION BY author) AS total FROM (SELECT author, strftime(posted_at, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (WHERE klass = 'subject_left') AS lefts
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY author, sha1 ORDER BY id) AS p FROM s) WHERE p = 1) WHERE author IN (SELECT author FROM s WHERE query = 'name') GROUP BY 1, 2)) WHERE total >= 3""", SIGHTINGS)
def account_month(spark, d):
    """Months of accounts with three lefts or more, each picture once an account."""
    s = sightings(spark, d)
    kept = R.dedupe_first(s, ["author", "sha1"], ["id"]).join(s.where("query = 'name'").select("author").distinct(), "author", "left_semi")
    months = kept.groupBy("author", F.date_format("posted_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("klass") == "subject_left").alias("lefts"))
    totals = months.groupBy("author").agg(F.sum("lefts").alias("total")).where("total >= 3")
    return months.join(totals, "author").select("author", "month", "n", "lefts", "total")


@query("SELECT label, count(*) FILTER (WHERE klass = 'subject_left') AS subject_left, count(*) FILTER (WHERE klass = 'object_only') AS object_only FROM s GROUP BY label", SIGHTINGS)
def contingency(spark, d):
    """Labels against two classes."""
    return sightings(spark, d).groupBy("label").pivot("klass", ["subject_left", "object_only"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT klass, count(*) AS n, round(median(x), 6) AS median, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.99), 6) AS p99 FROM (SELECT klass, CAST(coalesce(likes, 0) + coalesce(reposts, 0) AS DOUBLE) AS x FROM s) GROUP BY klass", SIGHTINGS)
def engagement_stats(spark, d):
    """Exact median, mean and 99th percentile of engagement."""
    x = C.null_sum(F.col("likes"), F.col("reposts")).cast("double")
    s = sightings(spark, d).select("klass", x.alias("x"))
    means = s.groupBy("klass").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"))
    found = T.exact_quantiles(s, ["klass"], "x", {"median": 0.5, "p99": 0.99}).withColumnRenamed("klass", "k")
    return means.join(found, F.col("klass").eqNullSafe(F.col("k"))).select("klass", "n", F.round("median", 6).alias("median"), "mean", F.round("p99", 6).alias("p99"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM events GROUP BY event_type")
def position_stats(spark, d):
    """Mean and population deviation."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"))


@query("SELECT size, count(*) AS families FROM (SELECT sha1, count(*) AS size FROM s GROUP BY sha1) GROUP BY size", SIGHTINGS)
def family_sizes(spark, d):
    """How many families have which size."""
    return sightings(spark, d).groupBy("sha1").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("families"))


_DAYS = "dd AS (SELECT CAST(DATE '2023-12-20' + CAST(i AS INTEGER) AS DATE) AS day, i FROM range(0, 50) r(i))"
_DENSE = f"{SIGHTINGS}, {_DAYS}, de AS (SELECT k.klass, dd.day, dd.i, count(s.id) AS n FROM dd CROSS JOIN (SELECT DISTINCT klass FROM s) k LEFT JOIN s ON s.klass = k.klass AND CAST(s.posted_at AS DATE) = dd.day GROUP BY 1, 2, 3)"


def _dense(spark, d):
    return S.dense_daily(sightings(spark, d), F.col("posted_at").cast("date"), "2023-12-20", "2024-02-07", ["klass"])


@query("SELECT klass, CAST(day AS VARCHAR) AS day, n FROM de", _DENSE)
def daily_dense(spark, d):
    """Daily counts of every class with zeros."""
    return _dense(spark, d).select("klass", F.col("day").cast("string").alias("day"), "n")


@query("SELECT klass, CAST(i // 7 AS INTEGER) AS week, CAST(sum(n) AS BIGINT) AS n FROM de GROUP BY 1, 2", _DENSE)
def weekly_tumbling(spark, d):
    """Sums over blocks of seven days."""
    return S.weekly(_dense(spark, d), "2023-12-20", ["klass"])


# -- intervals, information, tests -------------------------------------------------------------------------------------

_LEFTS = "w AS (SELECT author, CAST(count(*) FILTER (WHERE klass = 'subject_left') AS BIGINT) AS k, CAST(count(*) FILTER (WHERE klass IN ('subject_left', 'subject_right')) AS BIGINT) AS n FROM s GROUP BY author)"


def _lefts(spark, d):
    k = F.col("klass")
    return sightings(spark, d).groupBy("author").agg(F.count_if(k == "subject_left").alias("k"), F.count_if(k.isin("subject_left", "subject_right")).alias("n"))


@query(f"SELECT author, k, n, {_wilson_sql('CAST(k AS DOUBLE)', 'nullif(CAST(n AS DOUBLE), 0)')} FROM w", f"{SIGHTINGS}, {_LEFTS}")
def wilson(spark, d):
    """Interval of every author's share of lefts."""
    low, high = C.wilson(F.col("k").cast("double"), F.nullif(F.col("n").cast("double"), F.lit(0.0)))
    return _lefts(spark, d).select("author", "k", "n", low.alias("low"), high.alias("high"))


def _engaged(spark, d):
    return sightings(spark, d).select("klass", C.null_sum(F.col("likes"), F.col("reposts")).cast("double").alias("x"))


@query()
def bootstrap_ci(spark, d):
    """Bootstrap interval of the median engagement of every class."""
    return T.bootstrap_interval(_engaged(spark, d), "klass", "x")


@query()
def bootstrap_mean(spark, d):
    """Bootstrap interval of the mean engagement of every class."""
    return T.bootstrap_interval(_engaged(spark, d), "klass", "x", "mean")


@query("SELECT CAST(n AS BIGINT) AS n, round((2 * w - (n + 1) * t) / (n * t), 4) AS gini FROM (SELECT count(*) AS n, sum(x) AS t, sum(x * r) AS w FROM (SELECT CAST(size AS DOUBLE) AS x, row_number() OVER (ORDER BY size) AS r FROM (SELECT author, count(*) AS size FROM s GROUP BY author)))", SIGHTINGS)
def gini(spark, d):
    """Inequality of authors' numbers of sightings."""
    return T.gini(sightings(spark, d).groupBy("author").agg(F.count("*").cast("double").alias("size")), "size")


_ENTROPY = "SELECT {k}CAST(sum(c) AS BIGINT) AS n, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS bits, round(pow(2, log2(sum(c)) - sum(c * log2(c)) / sum(c)), 6) AS effective, count(*) AS kinds FROM ({q}) {g}"


@query(_ENTROPY.format(k="klass, ", q="SELECT klass, label, count(*) AS c FROM s GROUP BY 1, 2", g="GROUP BY klass"), SIGHTINGS)
def entropy(spark, d):
    """Entropy of the labels of every class."""
    return T.entropy(sightings(spark, d), "label", ["klass"])


@query(_ENTROPY.format(k="month, ", q="SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS label, count(*) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2", g="GROUP BY month"))
def monthly_entropy(spark, d):
    """Entropy of the priorities of one state's orders in every month."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("label"))
    return T.entropy(o, "label", ["month"])


@query("""SELECT round(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 4) AS jsd FROM
(SELECT label, x / sum(x) OVER () AS p, y / sum(y) OVER () AS q FROM (SELECT label, CAST(count(*) FILTER (WHERE klass = 'subject_left') AS DOUBLE) AS x, CAST(count(*) FILTER (WHERE klass = 'object_only') AS DOUBLE) AS y FROM s WHERE klass IN ('subject_left', 'object_only') GROUP BY label))""", SIGHTINGS)
def jsd(spark, d):
    """Divergence of two classes' labels."""
    return T.jensen_shannon(sightings(spark, d), "klass", "label", "subject_left", "object_only")


@query("""SELECT xmin, round(alpha, 4) AS alpha, round(ks, 4) AS ks, CAST(tail AS BIGINT) AS tail FROM (SELECT xmin, alpha, tail, max(greatest(abs((upto - m + 1) / tail - mo), abs(upto / tail - mo))) AS ks FROM
(SELECT t.*, f.alpha, f.tail, sum(m) OVER (PARTITION BY t.xmin ORDER BY x) AS upto, 1 - pow(x / t.xmin, 1 - f.alpha) AS mo FROM t JOIN (SELECT xmin, sum(m) AS tail, 1 + sum(m) / sum(m * ln(x / (xmin - 0.5e0))) AS alpha FROM t GROUP BY xmin HAVING sum(m) >= 10) f ON f.xmin = t.xmin) GROUP BY 1, 2, 3)
ORDER BY round(ks, 9), xmin LIMIT 1""", SIGHTINGS + """, c AS (SELECT CAST(likes AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS m FROM s WHERE likes >= 1 GROUP BY 1), t AS (SELECT xmin, x, m FROM c, (SELECT x AS xmin FROM c ORDER BY x LIMIT 30) WHERE x >= xmin)""")
def powerlaw_fit(spark, d):
    """Power-law tail of the likes."""
    return T.power_law(sightings(spark, d), "likes")


@query("SELECT author, k, n, CASE WHEN n > 0 THEN round(least(1e0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2))) FROM range(0, 4000) r(j) WHERE j <= least(k, n - k))), 6) END AS p FROM w", f"{SIGHTINGS}, {_LEFTS}")
def binom_test(spark, d):
    """Exact two-sided test of every author's lefts against one half."""
    return _lefts(spark, d).select("author", "k", "n", T.binomial_test(F.col("k"), F.col("n")).alias("p"))


@query("SELECT author, k, n, CASE WHEN n > 0 THEN round((SELECT sum(exp(lgamma(n + 2) - lgamma(j + 1) - lgamma(n - j + 2) - (n + 1) * ln(2))) FROM range(0, 4000) r(j) WHERE j <= k), 6) END AS p FROM w", f"{SIGHTINGS}, {_LEFTS}")
def beta_posterior(spark, d):
    """Probability that an author's share of lefts is over one half."""
    return _lefts(spark, d).select("author", "k", "n", T.beta_posterior(F.col("k"), F.col("n")).alias("p"))


def _area(density: str, end: str) -> str:
    """SQL of the integral of a density of ``t`` from zero, by Simpson's rule."""
    return f"(SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({density})) * ({end}) / 6000 FROM (SELECT i, ({end}) * i / 2000e0 AS t FROM range(0, 2001) r(i)))"


_CHI2 = "exp((({dof}) / 2e0 - 1) * ln(greatest(t, 1e-300)) - t - lgamma(({dof}) / 2e0))"
_NORMAL = "exp(-t * t / 2) / sqrt(2 * pi())"
_STUDENT = "exp(lgamma((n - 1) / 2e0) - lgamma((n - 2) / 2e0) - (n - 1) / 2e0 * ln(1 + t * t / (n - 2))) / sqrt((n - 2) * pi())"


def _p(frame):
    return frame.withColumn("p", F.round("p", 5))


@query(f"""SELECT round(chi2, 6) AS chi2, dof, n, round(1 - {_area(_CHI2.format(dof="dof"), "chi2 / 2")}, 5) AS p FROM (SELECT sum(pow(x - ex, 2) / ex + pow(y - ey, 2) / ey) AS chi2, CAST(count(*) - 1 AS BIGINT) AS dof, CAST(max(n + m) AS BIGINT) AS n FROM (SELECT *, (x + y) * n / (n + m) AS ex, (x + y) * m / (n + m) AS ey FROM (SELECT *, sum(x) OVER () AS n, sum(y) OVER () AS m FROM
(SELECT label, CAST(count(*) FILTER (WHERE klass = 'subject_left') AS DOUBLE) AS x, CAST(count(*) FILTER (WHERE klass = 'object_only') AS DOUBLE) AS y FROM s WHERE klass IN ('subject_left', 'object_only') GROUP BY label))))""", SIGHTINGS)
def chi2_stat(spark, d):
    """Labels of two classes against each other."""
    return _p(T.chi_square(sightings(spark, d), "klass", "label", "subject_left", "object_only"))


_RANKS = "SELECT *, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY {x}) AS same FROM ({q})"


@query(f"SELECT n_a, n_b, round(u, 3) AS u, round(u / (n_a * n_b), 6) AS superiority, round(CASE WHEN z <= 0 THEN 1 ELSE 1 - 2 * {_area(_NORMAL, 'z')} END, 5) AS p FROM (SELECT *, (greatest(u, n_a * n_b - u) - n_a * n_b / 2e0 - 0.5e0) / sqrt(n_a * n_b / 12e0 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1e0)))) AS z FROM ("
       "SELECT *, ra - n_a * (n_a + 1) / 2e0 AS u FROM (SELECT count(*) FILTER (WHERE klass = 'subject_left') AS n_a, count(*) FILTER (WHERE klass <> 'subject_left') AS n_b, sum(r) FILTER (WHERE klass = 'subject_left') AS ra, sum(same * same - 1e0) AS ties FROM ("
       + _RANKS.format(x="likes", q="SELECT klass, likes FROM s WHERE klass IN ('subject_left', 'object_only') AND likes IS NOT NULL") + "))))", SIGHTINGS)
def mann_whitney_u(spark, d):
    """Likes of two classes against each other."""
    return _p(T.mann_whitney(sightings(spark, d), "klass", "likes", "subject_left", "object_only"))


@query(f"""SELECT round(h, 6) AS h, groups, n, round(1 - {_area(_CHI2.format(dof="groups - 1"), "h / 2")}, 5) AS p FROM (SELECT (12e0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, groups, CAST(n AS BIGINT) AS n FROM (SELECT CAST(sum(c) AS DOUBLE) AS n, count(*) AS groups, sum(rs * rs / c) AS s FROM (SELECT domain, count(*) AS c, sum(r) AS rs FROM ra GROUP BY domain)), (SELECT sum(pow(t, 3) - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM ra GROUP BY x)))""",
       SIGHTINGS + ", ra AS (" + _RANKS.format(x="x", q="SELECT domain, coalesce(likes, 0) + coalesce(reposts, 0) AS x FROM s") + ")")
def kruskal_h(spark, d):
    """Engagement of all domains against each other."""
    return _p(T.kruskal(sightings(spark, d).select("domain", C.null_sum(F.col("likes"), F.col("reposts")).cast("long").alias("x")), "domain", "x"))


@query(f"SELECT n, round(rho, 6) AS rho, round(1 - 2 * {_area(_STUDENT, 'abs(rho) * sqrt((n - 2) / (1 - rho * rho))')}, 5) AS p FROM (SELECT count(*) AS n, corr(ra, rb) AS rho FROM (SELECT rank() OVER (ORDER BY likes) + (count(*) OVER (PARTITION BY likes) - 1) / 2e0 AS ra, rank() OVER (ORDER BY reposts) + (count(*) OVER (PARTITION BY reposts) - 1) / 2e0 AS rb FROM s WHERE likes IS NOT NULL AND reposts IS NOT NULL))", SIGHTINGS)
def spearman(spark, d):
    """Rank correlation of likes and reposts."""
    return _p(T.spearman(sightings(spark, d), "likes", "reposts"))


@query("""SELECT klass, n, round(r, 6) AS r, round(z, 4) AS z, round(least(1e0, exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * pow(z, 3) - 9 * pow(z, 4)) / (288e0 * n * n))), 6) AS p, round(CASE WHEN pk < 0 THEN pk + 24 ELSE pk END, 4) AS peak_hour FROM
(SELECT klass, n, sqrt(c * c + s2 * s2) AS r, n * pow(sqrt(c * c + s2 * s2), 2) AS z, atan2(s2, c) * 24 / (2 * pi()) AS pk FROM (SELECT klass, count(*) AS n, avg(cos(a)) AS c, avg(sin(a)) AS s2 FROM (SELECT klass, (hour(posted_at) + minute(posted_at) / 60e0) * (2 * pi() / 24) AS a FROM s) GROUP BY klass))""", SIGHTINGS)
def rayleigh(spark, d):
    """Whether sightings of a class cluster at an hour of the day."""
    hour = F.hour("posted_at") + F.minute("posted_at") / 60.0
    return T.rayleigh(sightings(spark, d).select("klass", hour.alias("hour")), "hour", ["klass"])


@query("""SELECT months, round(sl, 6) AS slope, round(sqrt(sw / dd), 6) AS se, round(exp(12 * sl), 6) AS odds_year FROM (SELECT *, (sw * sxy - sx * sy) / dd AS sl FROM (SELECT *, sw * sxx - sx * sx AS dd FROM (SELECT count(*) AS months, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM
(SELECT x, n * p * (1 - p) AS w, ln(p / (1 - p)) AS y FROM (SELECT n, (k + 0.5e0) / (n + 1) AS p, CAST(row_number() OVER (ORDER BY month) - 1 AS DOUBLE) AS x FROM m WHERE n >= 20)))))""", _MONTHS)
def logit_trend(spark, d):
    """Trend of the monthly share."""
    return T.logit_trend(_months(spark, d), "k", "n", "month")


# -- families ----------------------------------------------------------------------------------------------------------

_HEX = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
_PAIRS = HASHES + ", dh AS (SELECT DISTINCT h FROM hv), pr AS (SELECT a.h AS a, b.h AS b, bit_count(xor(a.h, b.h)) AS distance FROM dh a JOIN dh b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= 8)"


@query("SELECT lower(printf('%016x', a)) AS a, lower(printf('%016x', b)) AS b, CAST(distance AS INTEGER) AS distance FROM pr", _PAIRS)
def hamming_pairs(spark, d):
    """Pairs of hashes within eight bits."""
    p = N.hamming_pairs(hashes(spark, d), "h", 8).select(_HEX("a").alias("x"), _HEX("b").alias("y"), "distance")
    return p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("distance").cast("int").alias("distance"))


@query("SELECT lower(printf('%016x', root)) AS family, count(*) AS hashes FROM (SELECT h, min(g) AS root FROM rc GROUP BY h) GROUP BY root",
       "RECURSIVE " + _PAIRS + ", ed AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), rc AS (SELECT h, h AS g FROM dh UNION SELECT rc.h, ed.b FROM rc JOIN ed ON ed.a = rc.g)")
def dup_families(spark, d):
    """Families of hashes by transitive closure, with their sizes."""
    f = N.families(hashes(spark, d), "h", 8)
    return f.groupBy("family").agg(F.min(_HEX("hash")).alias("least"), F.count("*").alias("hashes")).select(F.col("least").alias("family"), "hashes")


@query("SELECT id, leader FROM hv JOIN (SELECT f.h, max(g.key) AS leader FROM fh f JOIN ld ON bit_count(xor(f.h, ld.h)) <= 8 JOIN fh g ON g.h = ld.h GROUP BY f.h) w ON w.h = hv.h", HASHES + """, fh AS (SELECT h, max(id) AS key FROM hv GROUP BY h),
ld AS (SELECT unnest(list_reduce(list([h] ORDER BY key DESC), lambda led, x: CASE WHEN len(list_filter(led, lambda y: bit_count(xor(y, x[1])) <= 8)) = 0 THEN list_concat(led, x) ELSE led END)) AS h FROM fh)""")
def leader_fold(spark, d):
    """Leaders of the wall, newest first."""
    return N.leader_fold(hashes(spark, d).withColumn("at", -F.col("id")), "id", "h", "at", 8)


_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_VOTES = ", ".join(f"sum((g >> {63 - at}) & 1) AS b{at}" for at in range(64))
_MOST = " + ".join(f"CASE WHEN 2 * b{at} > n THEN CAST({1 << (63 - at)} AS HUGEINT) ELSE 0 END" for at in range(64))


@query(f"SELECT doc_id, {_WORD.format(u='coalesce(u, 0)')} AS h FROM documents LEFT JOIN (SELECT doc_id, {_MOST} AS u FROM vt) USING (doc_id)",
       f"wd AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 16) AS UBIGINT) AS g FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^{_SPACE}]+')) AS w FROM documents)), vt AS (SELECT doc_id, count(*) AS n, {_VOTES} FROM wd GROUP BY doc_id)")
def simhash64(spark, d):
    """Similarity hash of every text."""
    return N.text_simhash(table(spark, d, "documents"), "doc_id", "text")


# -- series ------------------------------------------------------------------------------------------------------------

# The search without pruning: the least cost up to each day, from all earlier ones, then the cuts from the last day back.
_CUTS = f"""RECURSIVE {_DENSE}, ys AS (SELECT klass, list(n ORDER BY i) AS y FROM de GROUP BY klass HAVING sum(n) >= 10),
cy AS (SELECT klass, len(y) AS days, 2 * ln(greatest(len(y), 2)) AS penalty, list_concat([0e0], list_transform(range(1, len(y) + 1), lambda t: CAST(list_sum(y[1:t]) AS DOUBLE))) AS upto FROM ys),
bs AS (SELECT klass, days, upto, list_reduce(list_transform(range(0, days + 1), lambda t: {{'best': [-penalty], 'back': [CAST(0 AS BIGINT)], 't': t}}), lambda a, x: list_transform([list_transform(range(0, x.t), lambda s: a.best[s + 1] + CASE WHEN upto[x.t + 1] > upto[s + 1] THEN -2 * ((upto[x.t + 1] - upto[s + 1]) * ln((upto[x.t + 1] - upto[s + 1]) / (x.t - s)) - (upto[x.t + 1] - upto[s + 1])) ELSE 0e0 END)],
lambda v: {{'best': list_append(a.best, list_min(v) + penalty), 'back': list_append(a.back, CAST(list_position(v, list_min(v)) - 1 AS BIGINT)), 't': x.t}})[1]) AS found FROM cy),
sg AS (SELECT klass, upto, found.back AS back, found.back[days + 1] AS start, CAST(days AS BIGINT) AS stop FROM bs UNION ALL SELECT klass, upto, back, back[start + 1], start FROM sg WHERE start > 0)"""


@query("SELECT klass, start, stop, round((upto[stop + 1] - upto[start + 1]) / (stop - start), 6) AS rate FROM sg", _CUTS)
def change_points(spark, d):
    """Segments of constant rate of every class."""
    return S.change_points(_dense(spark, d), "klass")


@query()
def hawkes_fit(spark, d):
    """Self-excitement of every author's sightings."""
    s = sightings(spark, d).select("author", (F.unix_micros(F.col("posted_at").cast("timestamp")) / 86400e6).alias("t"))
    return hawkes.hawkes_fit(s, "author", "t")


_TIMES = "t AS (SELECT user_id AS author, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query("""SELECT author, CAST(count(*) AS BIGINT) AS n, round(0.5e0 * max(t) + 0.4e0 / 3e0 * sum(1 - exp(-3e0 * (tm - t))) - sum(ln(0.5e0 + 0.4e0 * a)), 4) AS nll FROM (SELECT x.author, x.t, max(x.t) OVER (PARTITION BY x.author) AS tm, a FROM t x JOIN
(SELECT x.author, x.i, coalesce(sum(exp(-3e0 * (x.t - y.t))), 0e0) AS a FROM t x LEFT JOIN t y ON y.author = x.author AND y.i < x.i GROUP BY 1, 2) z ON z.author = x.author AND z.i = x.i) GROUP BY author""", _TIMES)
def hawkes_nll(spark, d):
    """Likelihood of every author's times at fixed parameters."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    e = table(spark, d, "events").select(F.col("user_id").alias("author"), (micros / 86400e6).alias("t"))
    return S.hawkes_likelihood(e, "author", "t", 0.5, 0.4, 3.0)


@query("""SELECT CAST(lag AS INTEGER) AS lag, round(avg(a.z * b.z), 6) AS r FROM (SELECT i, (x - avg(x) OVER ()) / (stddev_pop(x) OVER () + 1e-9) AS z FROM dx) a, (SELECT i, (y - avg(y) OVER ()) / (stddev_pop(y) OVER () + 1e-9) AS z FROM dx) b, range(-14, 15) r(lag) WHERE a.i = b.i + lag GROUP BY lag""",
       f"{_DENSE}, dx AS (SELECT i, CAST(sum(n) FILTER (WHERE klass = 'subject_left') AS DOUBLE) AS x, CAST(sum(n) FILTER (WHERE klass = 'object_only') AS DOUBLE) AS y FROM de GROUP BY i)")
def xcorr(spark, d):
    """Correlation of two classes' daily counts at lags of up to two weeks."""
    k = F.col("klass")
    wide = _dense(spark, d).groupBy("day").agg(F.sum(F.when(k == "subject_left", F.col("n"))).cast("double").alias("x"), F.sum(F.when(k == "object_only", F.col("n"))).cast("double").alias("y"))
    return S.lagged_correlation(wide, "x", "y")


@query("SELECT DISTINCT a AS author FROM (SELECT unnest([author, domain]) AS a FROM s WHERE klass = 'subject_left') WHERE a <> '' AND a <> '7'", SIGHTINGS)
def snowball(spark, d):
    """Authors of kept rows and the handles they link to."""
    return R.snowball(sightings(spark, d).where("klass = 'subject_left'"), "author", F.col("domain"), "7")


# -- streams -----------------------------------------------------------------------------------------------------------

@query("SELECT author, day FROM (SELECT a.author, CAST(dd.day AS VARCHAR) AS day FROM dd CROSS JOIN (SELECT DISTINCT author FROM s) a WHERE dd.day >= DATE '2024-01-01' AND dd.day < DATE '2024-01-31') x WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.author = x.author AND CAST(CAST(s.posted_at AS DATE) AS VARCHAR) = x.day)", f"{SIGHTINGS}, {_DAYS}")
def pending_windows(spark, d):
    """Days of every author that the ledger does not hold."""
    s = sightings(spark, d)
    days = F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date")).cast("array<string>")
    wanted = s.select("author").distinct().select("author", F.explode(days).alias("day"))
    return R.pending(wanted, s.select("author", F.col("posted_at").cast("date").cast("string").alias("day")).distinct(), ["author", "day"])


@query("SELECT CAST(day AS VARCHAR) AS day, event_type, n FROM (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
def stream_watermark(spark, d):
    """Daily counts as a stream gives them: days that the watermark has passed."""
    out = micro.drain(micro.daily_counts(micro.stream_of(spark, f"{d}/events.parquet")), "daily")
    return out.select(F.col("day").cast("string").alias("day"), "event_type", "n")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stream_available_now(spark, d):
    """Everything that is there, in one batch, then a batch query over the sink (``stream_rounds`` has several batches)."""
    out = micro.drain(micro.stream_of(spark, f"{d}/events.parquet").select("event_id", "event_type", "user_id"), "arrivals")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_id, event_type FROM events")
def stream_dedupe(spark, d):
    """Every event once, though all are delivered twice."""
    events = micro.stream_of(spark, f"{d}/events.parquet")
    twice = events.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again")
    return micro.drain(micro.first_deliveries(twice).select("event_id", "event_type"), "once").select("event_id", "event_type")

