"""Secret scans through a trigram inverted index.

Every rule is a regular expression.  Its mandatory trigrams give a Boolean query; each block of documents (an Arrow
batch of a task) is indexed for the trigrams asked for, postings are intersected, and only candidate texts are scanned
by the expression.  Rules without mandatory trigrams (long hexadecimal runs) scan every text.  The index stays
beside its block, so no text or posting crosses a shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lanternfish.llm.frames import object_frame, text_batches
from lanternfish.llm.trigrams import BlockIndex, trigram_query, trigrams_of


def either_case(word: str) -> str:
    """The expression of a plain word whose letters (A-Z only) may be in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and non-overlapping; those whose ``group`` is shorter than ``least`` are dropped afterwards."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    runs: str = ""  # the class of characters whose dotted runs a match is made of: such matches are found run by run


_KEYS = "|".join([either_case("password"), either_case("passwd"), either_case("secret"), either_case("token"),
                  either_case("api") + "_?" + either_case("key")])
BASE_RULES = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
# Publicly documented token shapes that the method adds to the base kinds.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("git_token", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", runs="[A-Za-z0-9_-]"),
    Rule("payment_key", r"sk_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES


def dotted_tokens(text: str, runs: re.Pattern, head: str = "eyJ", least: int = 8) -> list[tuple[int, int]]:
    """Matches of ``head`` run{8,} . ``head`` run{8,} . run{8,}, each run of characters read once.

    A match may begin inside a run, at the first head that enough characters follow; its second run begins with the head.
    """
    found, held = [], []
    for m in runs.finditer(text):
        a, b = m.span()
        held = [*held[-2:], (a, b)] if held and held[-1][1] + 1 == a and text[a - 1] == "." else [(a, b)]
        if len(held) == 3 and b - a >= least:
            (a1, b1), (a2, b2), _ = held
            start = text.find(head, a1, b1)
            if start >= 0 and b1 - start >= len(head) + least and text.startswith(head, a2) and b2 - a2 >= len(head) + least:
                found.append((start, b))
                held = []
    return found


class Scanner:
    """Compiled rules with their trigram queries."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        # a run of a class that must reach a length need not be tried where it is shorter: same matches, fewer of them
        self.compiled = [re.compile(r.pattern[:-1] + f"{{{r.least},}}" if re.fullmatch(r"\[[^\]]+\]\+", r.pattern) and r.least else r.pattern) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = BlockIndex(set().union(*map(trigrams_of, self.queries)))

    def spans(self, k: int, text: str) -> list[tuple[int, int]]:
        """(start, end) in code points of one rule's matches."""
        rule = self.rules[k]
        if rule.runs:
            return dotted_tokens(text, re.compile(rule.runs + "+"))
        return [m.span() for m in self.compiled[k].finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For every text of the block its spans (start, rule, end), in order of start and then rule."""
        posted = self.index.post([t.encode("utf-8", "surrogatepass") for t in texts])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, query in enumerate(self.queries):
            for d in self.index.candidates(query, posted).nonzero()[0].tolist():
                found[d] += [(a, k, b) for a, b in self.spans(k, texts[d])]
        return [sorted(f) for f in found]

    def shown(self, spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{self.rules[k].kind}:{a}:{b}" for a, k, b in spans)


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner_for(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every row, in order of start and then of the rules.

    A null text counts as empty and gives an empty array; repeated rows are scanned each; other columns are ignored.
    """

    @F.pandas_udf("array<struct<kind string, start long, end long>>")
    def scan(texts: pd.Series) -> pd.Series:
        scanner = scanner_for(rules)
        return pd.Series([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in spans]
                          for spans in scanner.scan([t or "" for t in texts])], dtype=object)

    return docs.select(F.col(id_col), scan(F.col(text_col)).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the text inside every span replaced by the kind in brackets; overlapping spans count as one."""

    text_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        scanner = scanner_for(rules)
        out = []
        for text, spans in zip(texts, scanner.scan([t or "" for t in texts])):
            parts, at = [], 0
            for a, k, b in spans:
                if a >= at:
                    parts += [text[at:a], f"[{rules[k].kind}]"]
                at = max(at, b)
            out.append(text if not spans else "".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, redact(F.col(text_col)))


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans)."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        scanner, base, rows = scanner_for(RULES), len(BASE_RULES), []
        for spans in scanner.scan([t or "" for t in texts]):
            own = [s for s in spans if s[1] < base]
            counts = [sum(s[1] == k for s in own) for k in range(base)]
            rows.append((*counts, hashlib.sha256(scanner.shown(own).encode()).hexdigest(), scanner.shown(spans)))
        return object_frame(rows, ["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col), digest(F.col(text_col)).alias("d")).select(id_col, "d.*")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets of every document."""
    return secret_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
