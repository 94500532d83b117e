"""Conversation structure repair by weighted CYK interval parsing.

The grammar of role initials, ``(s?(ua)+)?``, in Chomsky normal form has a nonterminal for each pair (p, q) of states before and after
a span, with the rules (p, q) -> (p, r) (r, q); states are start, after s, after u and after a.  The cell of a span holds,
for each nonterminal, the least (cost, audit): audits are the edits' initials, ties ASCII-least.  A row's cell is closed
under insertions on both sides, and so is every combination of closed cells.  Cells are combined bottom-up by span
length.  Every derivation passes some state between two rows, which the cells on both sides name, so one split of a span finds what
all splits would, and spans double in length.  The same makes long conversations parallel: a conversation that reaches over
tasks is a row of chunks, whose cells are combined like any others.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lanternfish.llm.frames import object_frame
from lanternfish.plans.staging import discard, parts_for, stage

START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5
CHUNK_ROWS, CHUNK_CHARS, FAN, PART_ROWS = 256, 1 << 18, 32, 1 << 17
BLANK, DUPLICATE, CUT, SOUND = "b", "d", "t", "."
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_NEXT = {"s": [(START, AFTER_S)], "u": [(START, AFTER_U), (AFTER_S, AFTER_U), (AFTER_A, AFTER_U)], "a": [(AFTER_U, AFTER_A)]}
Cell = tuple  # 16 entries (cost, audit) or None, at 4 * p + q


def combined(one: Cell, two: Cell) -> Cell:
    """The cell of two spans side by side."""
    out = [None] * 16
    for p in range(4):
        for r in range(4):
            if (a := one[4 * p + r]) is not None:
                for q in range(4):
                    if (b := two[4 * r + q]) is not None:
                        both = (a[0] + b[0], a[1] + b[1])
                        if (best := out[4 * p + q]) is None or both < best:
                            out[4 * p + q] = both
    return tuple(out)


def _cell(entries: dict[tuple[int, int], tuple[int, str]]) -> Cell:
    return tuple(entries.get(divmod(k, 4)) for k in range(16))


def _insertions() -> Cell:
    """The closure of the empty span: what insertions alone lead to."""
    one = _cell({(p, p): (0, "") for p in range(4)} | {step: (INSERT, "I") for initial in "ua" for step in _NEXT[initial]})
    while (more := combined(one, one)) != one:
        one = more
    return one


INSERTIONS = _insertions()


@lru_cache(maxsize=None)  # four initials, four faults
def row_cell(initial: str, fault: str) -> Cell:
    """The closed cell of one row: delete, keep or rerole, with insertions on both sides."""
    found = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        found |= {step: (REROLE + more, "R") for role in "ua" for step in _NEXT[role]}
        found |= {step: (KEEP + more, "K") for step in _NEXT.get(initial, ())}
    return combined(combined(INSERTIONS, _cell(found)), INSERTIONS)


@lru_cache(maxsize=4096)
def _known(rows: tuple[tuple[str, str], ...]) -> Cell:
    half = len(rows) // 2
    return row_cell(*rows[0]) if len(rows) == 1 else combined(_known(rows[:half]), _known(rows[half:]))


def span_cell(rows: list[tuple[str, str]]) -> Cell:
    """The cell of rows (initial, fault), bottom-up by doubling spans; spans of up to eight rows are kept for others alike."""
    cells = [_known(tuple(rows[k : k + 8])) for k in range(0, len(rows), 8)]
    while len(cells) > 1:
        cells = [combined(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0] if cells else INSERTIONS


def parsed(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) that leaves nothing or ends after an assistant."""
    return min(c for c in (cell[4 * START + START], cell[4 * START + AFTER_A]) if c is not None)


def replayed(audit: str, rows: list[tuple[str, str]], state: int) -> tuple[list[dict], int]:
    """The repaired lines (role, text) of ``rows`` after the edits, and the state they lead to."""
    lines, rows = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == AFTER_U else "user"
        lines.append({"role": role, "text": text})
        state = dict(_NEXT[role[0]])[state]
    return lines, state


def after(audit: str, initials: str, state: int) -> int:
    """The state that the edits lead to, from the initials of the rows alone."""
    return replayed(audit, [(i, "") for i in initials], state)[1]


def fault_of(text: str, seen: bool) -> str:
    """The first fault of a row: blank, a duplicate, truncated, or none."""
    bare = text.rstrip(_BLANKS)
    return BLANK if not bare else DUPLICATE if seen else SOUND if bare[-1] in ".!?" else CUT


class Span:
    """What a run of rows adds to its conversation: counts, turns, initials at the ends, and its cell."""

    NAMES = ("rows", "low", "high", "turns", "first", "last", "blank", "duplicate", "truncated", "illegal", "head", "tail", "cell")

    def __init__(self, values: list):
        (self.rows, self.low, self.high, self.turns, self.first, self.last, self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail, self.cell) = values

    @staticmethod
    def of(rows: list[tuple]) -> Span:
        """Of rows (turn, role, text, fault) in order."""
        turns = [r[0] for r in rows if r[0] is not None]
        initials = [r[1][:1] for r in rows]
        faults = [r[3] for r in rows]
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        return Span([len(rows), min(turns, default=None), max(turns, default=None), len(set(turns)), rows[0][0], rows[-1][0], faults.count(BLANK),
                     faults.count(DUPLICATE), faults.count(CUT), wrong, initials[0], initials[-1], span_cell(list(zip(initials, faults)))])

    def joined(self, other: Span) -> Span:
        """With the rows that follow."""
        least = lambda f, a, b: b if a is None else a if b is None else f(a, b)
        shared = self.last is not None and self.last == other.first
        return Span([self.rows + other.rows, least(min, self.low, other.low), least(max, self.high, other.high), self.turns + other.turns - shared, self.first,
                     other.last, self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated,
                     self.illegal + other.illegal + (self.tail + other.head not in ("su", "ua", "au")), self.head, other.tail, combined(self.cell, other.cell)])

    def dumped(self) -> str:
        return json.dumps([getattr(self, n) for n in self.NAMES])

    @staticmethod
    def loaded(data: str) -> Span:
        *values, cell = json.loads(data)
        return Span([*values, tuple(None if c is None else (c[0], c[1]) for c in cell)])

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *parsed(self.cell))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LINES = "array<struct<role string, text string>>"


def _pieces(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Rows that stand in order, as one piece for each conversation that a partition holds whole, which is parsed and repaired at once
    (``span`` null), or as chunks of the others, each with its span."""
    conv_type = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {conv_type}, ck string, pid int, seq int, {_COUNTS}, lines {_LINES}, faults string, span string"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        current, conv, held, chars, seq, seen, out = None, None, [], 0, 0, False, []
        names = ["conv", "ck", "pid", "seq", *COUNTS, "lines", "faults", "span"]

        def flush(whole: bool) -> None:
            nonlocal held, chars, seq
            if not held:
                return
            span, lines, left = Span.of(held), [(r[1], r[2]) for r in held], [None] * len(COUNTS)
            if whole:
                left = span.summary()
                lines = replayed(left[-1], lines, START)[0]
            else:
                lines = [{"role": a, "text": b} for a, b in lines]
            out.append((conv, current, pid, seq, *left, lines, "".join(r[3] for r in held), None if whole else span.dumped()))
            held, chars, seq = [], 0, seq + 1

        runs = 0
        for batch in batches:
            turns = [None if pd.isna(t) else int(t) for t in batch["turn"]]
            for c, ck, turn, role, text, mark in zip(batch["conv"], batch["ck"], turns, batch["role"], batch["text"], batch["mark"]):
                if ck != current:
                    flush(runs > 1 and seq == 0)  # the first may have begun, and the last may go on, in another partition
                    current, conv, seq, runs = ck, None if pd.isna(c) else c, 0, runs + 1
                if mark == 0:
                    seen = True
                    continue
                if len(held) >= chunk_rows or held and chars + len(text) > CHUNK_CHARS:
                    flush(False)
                held.append((turn, role, text, fault_of(text, seen)))
                chars, seen = chars + len(text), False
            if out:
                yield object_frame(out, names)
                out.clear()
        flush(False)
        if out:
            yield object_frame(out, names)

    return rows.select("conv", "ck", "turn", "role", "text", "mark").mapInPandas(cut, schema)


def _tops(chunks: DataFrame, parts: int) -> DataFrame:
    """(ck, conv, counts): the chunks' spans of each conversation, combined along a tree of partitions."""
    conv_type = chunks.schema["conv"].dataType.simpleString()
    level = chunks.select("conv", "ck", "pid", "seq", "span")
    width = 1
    while True:
        def join(batch: pd.DataFrame) -> pd.DataFrame:
            batch = batch.sort_values(["pid", "seq"])
            spans = [Span.loaded(s) for s in batch["span"]]
            while len(spans) > 1:
                spans = [spans[k].joined(spans[k + 1]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)]
            first = batch.iloc[0]
            conv = None if pd.isna(first["conv"]) else first["conv"]
            return object_frame([(conv, first["ck"], int(first["pid"]), 0, spans[0].dumped())], ["conv", "ck", "pid", "seq", "span"])

        level = level.groupBy("ck", F.floor(F.col("pid") / width).alias("under")).applyInPandas(join, f"conv {conv_type}, ck string, pid int, seq int, span string")
        if width >= parts:
            break
        width *= FAN

    @F.pandas_udf(_COUNTS)
    def counted(spans: pd.Series) -> pd.DataFrame:
        return object_frame([Span.loaded(s).summary() for s in spans], list(COUNTS))

    return level.select("conv", "ck", counted("span").alias("c")).select("conv", "ck", "c.*")


def _replayed_chunks(chunks: DataFrame, tops: DataFrame) -> DataFrame:
    """(ck, pid, seq, lines): every chunk's repaired lines, from its share of its conversation's audit."""
    initials = F.concat_ws("", F.transform("lines", lambda r: F.rpad(F.substring(r["role"], 1, 1), 1, " ")))
    lists = chunks.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("pid", "seq", initials.alias("initials")))).alias("chunks"))

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ck, audit, own in zip(batch["ck"], batch["audit"], batch["chunks"]):
                at, state = 0, START
                for k, c in enumerate(own):
                    to, left = at, len(c["initials"])
                    while to < len(audit) and (left or k + 1 == len(own)):
                        left -= audit[to] != "I"
                        to += 1
                    out.append((ck, c["pid"], c["seq"], audit[at:to], state))
                    state, at = after(audit[at:to], c["initials"], state), to
            if out:
                yield object_frame(out, ["ck", "pid", "seq", "part", "state"])

    shares = tops.select("ck", "audit").join(lists, "ck").mapInPandas(share, "ck string, pid int, seq int, part string, state int")

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [replayed(a, [(r["role"], r["text"]) for r in rows], s)[0] for a, rows, s in zip(batch["part"], batch["lines"], batch["state"])]
            yield batch[["ck", "pid", "seq"]].assign(lines=pd.Series(lines, index=batch.index, dtype=object))

    return chunks.select("ck", "pid", "seq", "lines").join(shares, ["ck", "pid", "seq"]).mapInPandas(replay, f"ck string, pid int, seq int, lines {_LINES}")


def repair(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation, and its cheapest repair.

    Two tables: (conv, ck, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation, and
    (ck, pid, seq, lines, whole), its repaired lines (role, text): one row where ``whole``, else rows in order of (pid, seq).
    ``ck`` stands for the conversation, null ones too.

    Rows stand in order of turn, null turns first; rows of one turn in order of a digest of role and text, so that
    repeated rows are neighbours.  A null role or text counts as one space.  A row's first fault counts: blank (no character but white
    space), duplicate (role and text seen earlier), truncated (does not end in . ! or ?).  Roles go by their first character;
    any but s, u and a must be reroled or deleted.  Other columns are ignored; an empty table gives empty results.
    A conversation is spread over tasks where it is long: no task holds more than a chunk of its texts, but an audit, one character an
    edit, is a string of one row.
    """
    spark = table.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = table.select(F.col(conv_col).alias("conv"), F.to_json(F.struct(F.col(conv_col).alias("c"))).alias("ck"), F.col(turn_col).cast("long").alias("turn"),
                         text(role_col).alias("role"), text(text_col).alias("text"))
    rows = stage(plain.withColumn("h", F.md5(F.concat_ws(":", F.length("role"), "role", "text"))).withColumn("tie", F.monotonically_increasing_id()), "repair-rows")
    parts = parts_for(spark, rows.count(), PART_ROWS)
    # a row that repeats an earlier one gets a mark before it, which travels with it; blank rows need none
    who = F.unhex(F.md5(F.concat_ws(":", "ck", "h")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "h", "tie")
    narrow = rows.where(F.length(F.trim(F.col("text"), F.lit(_BLANKS))) > 0).select(who.alias("who"), "conv", "ck", place.alias("place"))
    first = narrow.groupBy("who").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marks = narrow.join(first, "who").where(F.col("place") != F.col("first")).select("conv", "ck", "place.turn", F.lit("").alias("role"), F.lit("").alias("text"), "place.h", "place.tie", F.lit(0).alias("mark"))
    order = ["ck", F.col("turn").asc_nulls_first(), "h", "tie"]
    placed = rows.withColumn("mark", F.lit(1)).unionByName(marks).repartitionByRange(parts, *order).sortWithinPartitions(*order, "mark")
    pieces = stage(_pieces(placed, chunk_rows), "repair-pieces")
    discard(rows)
    chunks = pieces.where(F.col("span").isNotNull())
    whole = pieces.where(F.col("span").isNull())
    tops = stage(_tops(chunks, parts), "repair-tops")
    summary = whole.select("conv", "ck", *COUNTS).unionByName(tops)
    repaired = whole.select("ck", "pid", "seq", "lines", F.lit(True).alias("whole")).unionByName(
        _replayed_chunks(chunks, tops).withColumn("whole", F.lit(False)))
    return summary, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """(ck, repaired_sha256): digest of the newline-joined ``role:text`` lines; of long conversations chunk by chunk, in order."""
    joined = F.concat_ws("\n", F.transform("lines", lambda r: F.concat(r["role"], F.lit(":"), r["text"])))
    short = repaired.where("whole").select("ck", F.sha2(joined, 256).alias("repaired_sha256"))
    long = repaired.where("NOT whole").select("ck", "pid", "seq", F.size("lines").alias("n"), joined.alias("body")).repartition("ck").sortWithinPartitions("ck", "pid", "seq")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, running, begun = None, None, False
        for batch in batches:
            out = []
            for ck, n, body in zip(batch["ck"], batch["n"], batch["body"]):
                if ck != current:
                    if current is not None:
                        out.append((current, running.hexdigest()))
                    current, running, begun = ck, hashlib.sha256(), False
                if n:
                    running.update(("\n" * begun + body).encode("utf-8", "surrogatepass"))
                    begun = True
            if out:
                yield object_frame(out, ["ck", "repaired_sha256"])
        if current is not None:
            yield object_frame([(current, running.hexdigest())], ["ck", "repaired_sha256"])

    return short.unionByName(long.mapInPandas(digest, "ck string, repaired_sha256 string"))


def damaged(table: DataFrame) -> DataFrame:
    """``conversations`` with one row in twenty dropped, emptied, stripped of its full stops, repeated, and given to the user each."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return table.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_interval_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation: its faults after the damage, and the cheapest repair with its digest."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    summary, repaired = repair(damaged(table))
    ids = table.select("conv_id").distinct().withColumn("ck", F.to_json(F.struct(F.col("conv_id").alias("c"))))
    found = ids.join(summary.drop("conv"), "ck", "left").join(digests(repaired), "ck", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", *[F.coalesce(c, F.lit("") if c == "audit" else F.lit(0).cast("long")).alias(c) for c in COUNTS],
                        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


#: DuckDB has no crc32 and no CYK: checksums by folding bytes, repairs by the same least (cost, audit) row by row.
OP12_SQL = """
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM named, tab
), dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 0 THEN [] WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds
), num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text), copy) AS n FROM dam
), rows_ AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
      WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN '.' ELSE 't' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair FROM num
), steps(i, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)
), ins(p, q, c, e) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (3, 2, 5, 'I'), (2, 3, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')
), edits AS (
  SELECT i, f, p, q, c + CASE WHEN f = 't' THEN 5 ELSE 0 END AS c, e FROM (
    SELECT i, p, q, 0 AS c, 'K' AS e FROM steps
    UNION ALL SELECT o.i, p, q, 1, 'R' FROM steps s, (VALUES ('s'), ('u'), ('a'), ('')) o(i) WHERE s.i <> 's') k, (VALUES ('.'), ('t')) x(f)
  UNION ALL SELECT i, f, p, p, 2, 'D' FROM range(4) r(p), (VALUES ('s'), ('u'), ('a'), ('')) o(i), (VALUES ('.'), ('t'), ('b'), ('d')) x(f)
), moves AS MATERIALIZED (
  SELECT i, f, e.p, n.q, min({'c': e.c + n.c, 'e': e.e || n.e}) AS m FROM edits e JOIN ins n ON e.q = n.p GROUP BY ALL
), dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, q AS st, {'c': CAST(c AS BIGINT), 'a': e} AS best FROM (SELECT DISTINCT conv_id FROM rows_), ins WHERE p = 0
  UNION ALL
  SELECT d.conv_id, d.n + 1, m.q, min({'c': d.best.c + m.m.c, 'a': d.best.a || m.m.e})
  FROM dp d JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.n = d.n + 1
  JOIN moves m ON m.f = r.fault AND m.p = d.st AND m.i = CASE WHEN r.role[1] IN ('s', 'u', 'a') THEN r.role[1] ELSE '' END
  GROUP BY ALL
), won AS (
  SELECT d.conv_id, min(best) AS best FROM dp d JOIN (SELECT conv_id, max(n) AS n FROM rows_ GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM d.conv_id AND l.n = d.n
  WHERE st IN (0, 3) GROUP BY d.conv_id
), chars AS (
  SELECT conv_id, unnest(range(1, length(best.a) + 1)) AS pos, best.a[pos] AS e FROM won
), walk AS (
  SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS n, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS o FROM chars
), lined AS (
  SELECT w.conv_id, w.pos, w.e, w.o, r.role, r.text, max(CASE WHEN w.o = 1 AND w.e = 'K' AND r.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id) AS has_s
  FROM walk w LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n
), told AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS body
  FROM lined WHERE e <> 'D' GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
"""
