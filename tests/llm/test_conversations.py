import hashlib
import itertools
import random
import re
import zlib

import pytest

from lanternfish.llm import conversations as cv

WORD, BLANKS = re.compile(r"[^\x20\x09-\x0D]"), "\x20\x09\x0a\x0b\x0c\x0d"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    """Rows (conv, turn, role, text) after the damage."""
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, turn, "user" if kind == 4 else role, text


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        found = WORD.findall(text)
        out.append("b" if not found else "d" if (role, text) in seen else "." if found[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Left to right, not by spans: the least (cost, audit, lines) for each state, insertions relaxed after every row."""
    goes = lambda state, i: {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(i, {}).get(state)

    def relaxed(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if (to := goes(state, role[0])) is not None:
                        best[to] = min(best.get(to, (10**9, "", ())), (cost + 5, audit + "I", (*lines, f"{role}:")))
        return best

    best = relaxed({0: (0, "", ())})
    for (role, text), mark in zip(rows, marks):
        after = {}
        for state, (cost, audit, lines) in best.items():
            options = [(state, cost + 2, audit + "D", lines)]
            if mark not in "bd":
                more = 5 * (mark == "t")
                options += [(goes(state, r[0]), cost + more + (e == "R"), audit + e, (*lines, f"{r}:{text}"))
                            for e, r in (("K", role), ("R", "user"), ("R", "assistant")) if r]
            for to, *rest in options:
                if to is not None:
                    after[to] = min(after.get(to, (10**9, "", ())), tuple(rest))
        best = relaxed(after)
    return min(best[s] for s in (0, 3) if s in best)


def slow(rows, damaging=True):
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows}
    by = {}
    for conv, turn, role, text in damage(rows) if damaging else rows:
        by.setdefault(conv, []).append((turn, role, text))
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))  # rows of one turn: the tests have equal ones only
        pairs, turns = [r[1:] for r in own], [r[0] for r in own if r[0] is not None]
        marks = faults(pairs)
        cost, audit, lines = cheapest(pairs, marks)
        wrong = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(marks.count(m) for m in "bdt"), wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def collected(df):
    return {r["conv_id"]: (*(r[c] for c in cv.COUNTS), r["repaired_sha256"]) for r in df.collect()}


def repaired(df, chunk_rows):
    summary, lines = cv.repair(df, chunk_rows=chunk_rows)
    return {r["conv"]: (*(r[c] for c in cv.COUNTS), r["repaired_sha256"]) for r in summary.join(cv.digests(lines), "ck").collect()}


def test_query_equals_row_by_row_search(spark, small):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    assert collected(cv.op12_interval_repair(spark, small)) == slow(rows)


TEXTS = ["Hello.", "Yes!", "Why?", "no end", "", " \t", "Fine. ", "So it goes.", "Good.", "Bad.", "more\n"]


@pytest.mark.parametrize("chunk_rows", [256, 3])
def test_long_and_odd_conversations(spark, chunk_rows):
    """One conversation with most rows, reaching over tasks; null turns, gaps, odd roles, repeated rows, a conversation without an id."""
    rng = random.Random(9)
    row = lambda c, t: (c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", " "]), rng.choice(TEXTS) + rng.choice(["", f"{t}."]))
    rows = [row(7, t) for t in range(0, 900) if t % 11] + [row(c, t) for c in range(100, 130) for t in range(rng.randrange(1, 9))]
    rows += [(8, None, "user", "Alone."), (9, 5, "user", "Twice."), (9, 5, "user", "Twice."), (None, 1, "user", "No id."), (None, 2, "assistant", "None.")]
    rows += [(10, -3, "system", "Only."), (11, 1, "assistant", "x" * 300_000), (11, 2, "user", "y" * 300_000 + ".")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, ck string").repartition(6)
    assert repaired(table, chunk_rows) == slow(rows, damaging=False)


def test_damage_of_nulls_and_empty_table(spark, tmp_path):
    rows = [(c, t, r, x) for c in (None, 1, 2, 3) for t, r, x in [(None, None, None), (1, "user", None), (2, None, "Hm."), (3, "assistant", "Ok!"), (4, "user", "Bye.")]]
    schema = "conv_id long, turn long, role string, text string"
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        assert collected(cv.op12_interval_repair(spark, f"{tmp_path}/{name}")) == slow(data)


def test_cells_equal_trying_all_edits():
    """Every edit of up to three rows with up to two insertions, against the grammar itself."""
    for n in range(4):
        for rows in itertools.product([("s", "."), ("u", "."), ("a", "t"), ("x", "."), ("u", "b")], repeat=n):
            best = None
            for edits in itertools.product("DKRr", repeat=n):  # r: to assistant
                if any(f == "b" and e != "D" for (_, f), e in zip(rows, edits)):
                    continue
                cost = sum({"D": 2, "K": 0}.get(e, 1) + 5 * (f == "t" and e != "D") for (_, f), e in zip(rows, edits))
                for places in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(n + 1), k) for k in range(3)):
                    for put in itertools.product("ua", repeat=len(places)):
                        letters, audit = "", ""
                        for at in range(n + 1):
                            for p, i in zip(places, put):
                                if p == at:
                                    letters, audit = letters + i, audit + "I"
                            if at < n:
                                letters += {"D": "", "K": rows[at][0], "R": "u", "r": "a"}[edits[at]]
                                audit += edits[at].upper()
                        if GRAMMAR.fullmatch(letters) and (best is None or (cost + 5 * len(places), audit) < best):
                            best = (cost + 5 * len(places), audit)
            assert cv.parsed(cv.span_cell(list(rows))) == best
