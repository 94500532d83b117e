"""Scalar functions as Column expressions; no Python runs in them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def null_sum(*parts: Column) -> Column:
    """Sum that counts nulls as zero."""
    out = F.lit(0)
    for p in parts:
        out = out + F.coalesce(p, F.lit(0))
    return out


def join_parts(*parts: Column) -> Column:
    """Parts that are neither null nor empty, joined by one space."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def first_nonempty(*parts: Column) -> Column:
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts])


def not_in(value: Column, listed: Sequence) -> Column:
    """NOT IN for which a null value is in no list."""
    return F.coalesce(~value.isin(list(listed)), F.lit(True))


def url_domain(url: Column, default: Column | None = None) -> Column:
    """Authority of a URL without a leading ``www.``; the default where there is none."""
    host = F.regexp_replace(F.try_parse_url(url, F.lit("AUTHORITY")), r"^www\.", "")
    return F.coalesce(host, default if default is not None else F.lit(None).cast("string"))


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def iso_from_compact(stamp: Column) -> Column:
    """YYYYMMDDTHHMMSSZ as ISO 8601; null if it has not that shape."""
    s = lambda a, n: F.substring(stamp, a, n)
    iso = F.concat(s(1, 4), F.lit("-"), s(5, 2), F.lit("-"), s(7, 2), F.lit("T"), s(10, 2), F.lit(":"), s(12, 2), F.lit(":"), s(14, 2), F.lit("Z"))
    return F.when(stamp.rlike(r"^[0-9]{8}T[0-9]{6}Z$"), iso)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def repair_json(text: Column) -> Column:
    """Doubles every backslash that starts no JSON escape."""
    return F.regexp_replace(text, r'\\(?!["\\/bfnrtu])', r"\\\\")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_shard(key: Column, shards: int) -> Column:
    """Shard of a key from the low 32 bits of its MD5, the same on every engine."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 25, 8), 16, 10).cast("long"), F.lit(shards))


# Shapes of dates in URLs, tried in this order; groups are year, month, day.
DATE_SHAPES = (
    r"yyyy=(20[0-9]{2})&(?:amp;)?mm=([0-9]{2})(?:&(?:amp;)?dd=([0-9]{2}))?",
    r"(20[0-9]{2})[-/_]?([0-9]{2})[-/_]?([0-9]{2})(?![0-9])",
    r"(20[0-9]{2})[-/_]([0-9]{2})(?![0-9])",
    r"(20[0-9]{2})([0-9]{2})\.xml",
    r"sitemap-(20[0-9]{2})\.xml\?mm=([0-9]{2})&(?:amp;)?dd=([0-9]{2})",
    r"(20[0-9]{2})(?![0-9])",
)


def _digits_span(digits: Column) -> Column:
    """First and last day (a, b) of a year, month or day written without separators; null if it is none, or no such day."""
    year, month = F.substring(digits, 1, 4).cast("int"), F.substring(digits, 5, 2).cast("int")
    day, start = F.try_to_date(digits, "yyyyMMdd"), F.make_date(year, month, F.lit(1))
    put = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    return (F.when(F.length(digits) == 8, F.when(day.isNotNull(), put(day, day))).when((F.length(digits) == 6) & month.between(1, 12), put(start, F.last_day(start)))
            .when(F.length(digits) >= 4, put(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31)))))


def url_date_span(url: Column) -> tuple[Column, Column]:
    """First and last day that a URL's date stands for: a day, a month or a year; an impossible day tries the next shape,
    an impossible month without a day stands for its whole year.  A shape's parts have fixed widths, so its digits tell all."""
    digits = [F.regexp_replace(F.regexp_extract(url, shape, 0), "[^0-9]", "") for shape in DATE_SHAPES]
    best = F.get(F.filter(F.transform(F.array(*digits), _digits_span), lambda s: s.isNotNull()), F.lit(0))
    return best["a"], best["b"]


def spans_overlap(first: Column, last: Column, since: Column, until: Column) -> Column:
    return ~((last < since) | (first > until))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval of k out of n, to four places; null where n is 0."""
    p = k / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    safe = lambda x: F.when(n > 0, F.round(x, 4))
    return safe(mid - half), safe(mid + half)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often and however deep in array functions it is used."""
    return F.transform(F.array(value), use)[0]


def unit(v: Column) -> Column:
    """The vector divided by its length (plus a billionth, so that zero stays zero)."""
    return once(F.sqrt(dot(v, v)) + 1e-9, lambda size: F.transform(v, lambda x: x.cast("double") / size))


# What no word goes through, on either side.
WORD_START, WORD_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def alarm_score(text: Column, classes: Sequence[tuple[int, str]], opener: str) -> tuple[Column, Column]:
    """Score and hits of an alarm lexicon.

    ``classes`` are (weight, pattern) pairs.  Every match adds its weight; a text that begins with the opener gains two;
    two or more shouted words of four letters gain one; up to three exclamation marks gain a half each.  The sum is
    divided by the square root of the number of words and rounded to three places; no words: zero and no hits.
    Each pattern runs once: matches are extracted and counted by the size of their list.
    """
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit("[A-Za-z']+"), 0)
    words = F.size(found)
    starts = text.rlike(f"(?i)^\\s*(?:{opener})")
    shouted = F.size(F.filter(found, lambda w: (F.length(w) >= 4) & (w == F.upper(w)) & w.rlike("[A-Z]"))) >= 2
    marks = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), F.lit(3))
    lists = [F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), 0) for _, pattern in classes]
    total = F.when(starts, 2).otherwise(0) + F.when(shouted, 1).otherwise(0) + 0.5 * marks
    for (weight, _), matches in zip(classes, lists):
        total = total + weight * F.size(matches)
    empty = F.array().cast("array<string>")
    hits = F.concat(F.transform(F.concat(*lists), lambda h: F.lower(h)), F.when(starts, F.array(F.lit("opener"))).otherwise(empty), F.when(shouted, F.array(F.lit("caps"))).otherwise(empty))
    return F.when(words > 0, F.round(total / F.sqrt(words), 3)).otherwise(0.0), F.when(words > 0, hits).otherwise(empty)
