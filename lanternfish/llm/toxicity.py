"""Toxicity scores from Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from labelled documents: words that are commoner in toxic ones than chance allows.  Its trie is
intersected with Levenshtein automata by walking sets of (trie node, errors) along a word; the sets are made into a
deterministic automaton as they are met, so a word costs one table look-up a character.  A misspelled hit counts less than
an exact one, and a hit in a window with quotation marks or words of reporting counts less than one that is meant; by how
much is learned where the labelled documents have enough such hits and comes from the prior where they have few.  A logistic
regression with weights that are never negative gives the score, so each further hit can only raise it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lanternfish.llm.frames import object_frame, text_batches
from lanternfish.plans.staging import stage

SAMPLE = 20_000  # labelled documents that are learned from, at most
LEXICON = 400
MIN_DOCS = 3
CHANCE = 0.05  # of a word without bearing among all that are tried
WINDOW = 6
WORD = re.compile(r"[^\W_]+")
QUOTES = re.compile("[\"«»“”„‟]")
# Words of reporting that mark a hit as quoted rather than meant.
REPORTING = frozenset("said says wrote called calls quote quoted quoting word term slur phrase".split())
FEATURES = ("mass", "most", "kinds", "density")
FUZZY, QUOTED = (0.3, 0.5, 0.7, 0.9), (0.1, 0.25, 0.5, 0.8)  # what a hit keeps of its weight for each error, and if quoted
BANDS, ROWS = 16, 4  # of the signatures by which near copies in the sample are told
_MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def allowed_errors(length: int) -> int:
    """One edit from five letters on, two from nine on."""
    return 0 if length < 5 else 1 if length < 9 else 2


@dataclass(frozen=True)
class Term:
    text: str
    weight: float


class Matcher:
    """Deterministic automaton, made state by state, of the lexicon trie and the terms' Levenshtein automata.

    ``ordinary`` words are no misspellings of a term, however near they are.  States and known words are bounded; when
    there are more, the automaton is begun anew.
    """

    STATES, WORDS = 20_000, 150_000

    def __init__(self, terms: list[Term], ordinary: frozenset[str] = frozenset()):
        self.terms, self.ordinary = terms, ordinary
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach: list[int] = [0]  # most errors that a term below allows
        for t, term in enumerate(terms):
            node, errors = 0, allowed_errors(len(term.text))
            self.reach[0] = max(self.reach[0], errors)
            for ch in term.text:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][ch]
                self.reach[node] = max(self.reach[node], errors)
            self.ends[node].append(t)
        self.alphabet = {ch for kids in self.children for ch in kids}
        self.longest = max((len(t.text) + allowed_errors(len(t.text)) for t in terms), default=0)
        self._reset()

    def _reset(self) -> None:
        start = frozenset(self._skips({(0, 0)}))
        self.names = {start: 0}
        self.states = [start]
        self.steps: list[dict[str, int]] = [{}]
        self.found: dict[str, tuple[tuple[int, int], ...]] = {}

    def _skips(self, places: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """Also the places reached by leaving out letters of a term."""
        todo = list(places)
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.reach[child] and (child, e + 1) not in places:
                    places.add((child, e + 1))
                    todo.append((child, e + 1))
        return places

    def _step(self, state: int, ch: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            kids = self.children[node]
            if ch in kids:
                out.add((kids[ch], e))
            if e < self.reach[node]:
                out.add((node, e + 1))
            out.update((child, e + 1) for child in kids.values() if e < self.reach[child])
        # of two numbers of errors at a node only the smaller matters
        best: dict[int, int] = {}
        for node, e in self._skips(out):
            best[node] = min(e, best.get(node, e))
        key = frozenset(best.items())
        if key not in self.names:
            self.names[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.names[key]

    def hits(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, errors) of every lexicon term within its allowed distance of the word."""
        if len(word) > self.longest:
            return ()
        known = self.found.get(word)
        if known is not None:
            return known
        if len(self.states) > self.STATES or len(self.found) > self.WORDS:
            self._reset()
        at = 0
        for raw in word:
            ch = raw if raw in self.alphabet else ""
            to = self.steps[at].get(ch)
            if to is None:
                to = self.steps[at][ch] = self._step(at, ch)
            at = to
            if not self.states[at]:
                break
        out: dict[int, int] = {}
        for node, e in self.states[at]:
            for t in self.ends[node]:
                if e <= allowed_errors(len(self.terms[t].text)) and (e == 0 or word not in self.ordinary):
                    out[t] = min(e, out.get(t, e))
        self.found[word] = result = tuple(sorted(out.items()))
        return result


def found_hits(matcher: Matcher, text: str | None) -> tuple[int, Counter]:
    """The number of words of a text, and how often it has each (term, errors, quoted): the nearest term for each word."""
    low = (text or "").lower()
    words = WORD.findall(low)
    found = {w: h for w in set(words) if (h := matcher.hits(w))}
    out: Counter = Counter()
    if not found:
        return len(words), out
    spans = [m.span() for m in WORD.finditer(low)]
    for i, w in enumerate(words):
        if w not in found:
            continue
        t, errors = min(found[w], key=lambda h: (h[1], -matcher.terms[h[0]].weight))
        a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        opening = len(QUOTES.findall(low, spans[a][0], spans[i][0])) % 2 == 1 and QUOTES.search(low, spans[i][1], spans[b - 1][1] + 3)
        out[t, errors, bool(opening or REPORTING.intersection(words[a:i]))] += 1
    return len(words), out


def features(weights: list[float], n_words: int, hits: dict, fuzzy: float, quoted: float) -> list[float]:
    """Four measures of a text's hits, none of which falls if there are more hits, or better spelled or less quoted ones."""
    if not hits:
        return [0.0] * len(FEATURES)
    each = {h: fuzzy ** h[1] * (quoted if h[2] else 1.0) for h in hits}
    shares: dict[int, float] = {}
    for h, n in hits.items():
        shares[h[0]] = shares.get(h[0], 0.0) + n * each[h]
    mass = sum(weights[t] * s for t, s in shares.items())
    most = max(weights[h[0]] * e for h, e in each.items())
    return [math.log1p(mass), most, sum(min(1.0, s) for s in shares.values()), math.log1p(1000 * mass / n_words)]


@dataclass(frozen=True)
class Model:
    terms: list[Term] = field(default_factory=list)
    ordinary: frozenset[str] = frozenset()
    fuzzy: float = 0.5
    quoted: float = 0.25
    weights: tuple[float, ...] | None = None  # the last is the constant; None: nothing was learned, every score is 0

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(rows))
        z = rows @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps with weights of zero or more (the last, the constant, is free); the
    weights and the penalised log likelihood.  Measures whose weight would be negative are left out one by one."""
    scales = rows.std(axis=0)
    scales[scales == 0] = 1.0
    used = list(range(rows.shape[1]))
    while True:
        x = np.column_stack([rows[:, used] / scales[used], np.ones(len(rows))])
        w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.5)
        ridge[-1] = 1e-3
        for _ in range(40):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (labels - p) - ridge * w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        if len(used) == 0 or w[:-1].min() >= 0:
            break
        used.pop(int(np.argmin(w[:-1])))
    p = np.clip(1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    out = np.zeros(rows.shape[1] + 1)
    out[used] = w[:-1] / scales[used]
    out[-1] = w[-1]
    return out, float(np.log(np.where(labels == 1, p, 1 - p)).sum() - (ridge * w * w).sum() / 2)


def fit_model(terms: list[Term], ordinary: frozenset[str], found: list[tuple[int, dict]], labels: np.ndarray) -> Model:
    """The discounts of misspelled and quoted hits that fit best under a prior (modes 0.5 and 0.25), and the regression."""
    strengths = [t.weight for t in terms]
    best, model = -math.inf, Model()
    for fuzzy in FUZZY:
        for quoted in QUOTED:
            rows = np.array([features(strengths, n, hits, fuzzy, quoted) for n, hits in found])
            weights, likelihood = fit_logistic(rows, labels)
            likelihood += 2 * math.log(fuzzy * (1 - fuzzy)) + math.log(quoted) + 3 * math.log(1 - quoted)
            if likelihood > best:
                best, model = likelihood, Model(terms, ordinary, fuzzy, quoted, tuple(weights.tolist()))
    return model


def signature(text: str | None) -> list[int]:
    """Band keys of the text's three-word shingles: texts that share most shingles share a key."""
    words = WORD.findall((text or "").lower())
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
    least = np.array([(hashes * m).min() for m in _MULTIPLIERS]).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), b) >> 1 for b, row in enumerate(least)]


def without_copies(sample: DataFrame) -> DataFrame:
    """The rows of a bounded sample (id, body, toxic) that share no band key with one of smaller id, so that copies count once."""

    @F.pandas_udf("array<long>")
    def bands(texts: pd.Series) -> pd.Series:
        return pd.Series([signature(t) for t in texts], dtype=object)

    keys = stage(sample.select("id", F.explode(bands("body")).alias("band")), "toxicity-bands")
    first = keys.groupBy("band").agg(F.min("id").alias("first"))
    later = keys.join(first, "band").where("first < id").select("id").distinct()
    return sample.join(later, "id", "left_anti")


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents of each label that hold a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch["body"], batch["toxic"].tolist()):
                (toxic if label else clean).update(set(WORD.findall((text or "").lower())))
        yield object_frame([(t, toxic[t], clean[t]) for t in toxic.keys() | clean.keys()], ["term", "toxic", "clean"])

    counted = sample.mapInPandas(run, "term string, toxic long, clean long")
    return stage(counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-terms")


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> tuple[list[Term], frozenset[str]]:
    """At most ``size`` terms, those of largest log likelihood ratio, and the ordinary words that stand near them.

    A term must be so much commoner in toxic documents that by chance (``CHANCE``) none of all the words tried would be.
    Its weight is the smoothed log ratio of document shares.  Ordinary words are those of two clean documents or more.
    """
    n_toxic, n_clean = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n_toxic or not n_clean:
        return [], frozenset()
    counts = _term_counts(sample)
    tried = counts.where(F.col("toxic") >= MIN_DOCS)
    share = n_toxic / (n_toxic + n_clean)
    k, c = F.col("toxic"), F.col("clean")
    part = lambda x, p: F.when(x > 0, x * F.log(x / ((k + c) * p))).otherwise(0.0)
    ratio = F.log((k + 0.5) / (n_toxic + 1)) - F.log((c + 0.5) / (n_clean + 1))
    least = 2 * math.log(max(1, tried.count()) / CHANCE)
    rows = (
        tried.withColumn("gain", 2 * (part(k, share) + part(c, 1 - share))).withColumn("ratio", ratio)
        .where((k > (k + c) * share) & (F.col("gain") >= least) & (F.col("ratio") >= 1.0)).orderBy(F.desc("gain"), "term").limit(size).collect()
    )
    terms = [Term(r["term"], min(8.0, float(r["ratio"]))) for r in rows]
    named = {t.text for t in terms}

    @F.pandas_udf("boolean")
    def near(words: pd.Series) -> pd.Series:
        matcher = Matcher(terms)
        return pd.Series([w not in named and bool(matcher.hits(w)) for w in words], dtype=bool)

    ordinary = counts.where((c >= 2) & near("term")).select("term").collect() if terms else []  # words within two edits of a term
    return terms, frozenset(r["term"] for r in ordinary)


def train(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents (those of smallest id hash) for which ``use`` holds.

    ``use`` is a condition on the column ``id``.  Of near copies in the sample one counts.
    """
    text_batches(docs.sparkSession)
    marked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & use)
        .groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(F.broadcast(marked), "id")  # at most ``sample`` short rows
    rows = stage(without_copies(stage(rows, "toxicity-sample")), "toxicity-distinct")
    terms, ordinary = learn_lexicon(rows.select("body", "toxic"))
    if not terms:
        return Model()

    @F.pandas_udf("n int, hits array<struct<t int, e int, q boolean, n int>>")
    def measure(texts: pd.Series) -> pd.DataFrame:
        matcher = Matcher(terms, ordinary)
        found = [found_hits(matcher, t) for t in texts]
        return object_frame([(n, [(*h, k) for h, k in hits.items()]) for n, hits in found], ["n", "hits"])

    seen = rows.select(measure("body").alias("x"), "toxic").collect()  # a few numbers for each sampled document
    found = [(r["x"]["n"], {(h["t"], h["e"], h["q"]): h["n"] for h in r["x"]["hits"]}) for r in seen]
    return fit_model(terms, ordinary, found, np.array([r["toxic"] for r in seen], dtype=float))


_MATCHERS: dict[tuple, Matcher] = {}


def matcher_for(model: Model) -> Matcher:
    key = tuple(model.terms), model.ordinary
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(model.terms, model.ordinary)
    return _MATCHERS[key]


def score_text(model: Model, matcher: Matcher, texts: list[str | None]) -> np.ndarray:
    strengths = [t.weight for t in model.terms]
    rows = [features(strengths, *found_hits(matcher, t), model.fuzzy, model.quoted) for t in texts]
    return model.score(np.array(rows).reshape(-1, len(FEATURES)))


def toxicity(model: Model, text: Column) -> Column:
    """Score from 0 to 1 of every text; a null text counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_text(model, matcher_for(model), list(texts)), dtype=float)

    return score(text)


def held_out(id_col: str, folds: int = 5, fold: int = 0) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document; learning uses only rows that are not held out.

    Null and empty texts have no hits and get the score of that; without labelled rows of both kinds every score is 0.
    Repeated rows are scored each; labels of one id that disagree count as toxic; other columns are ignored.
    """
    model = train(docs, labels, ~held_out("id"), id_col, text_col)
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), toxicity(model, F.col(text_col)).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
