"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import md5_prefix, stored

# Seed words of the grammar's classes.
INSULTS = "idiot moron stupid pathetic loser scum trash worthless disgusting clown imbecile vermin filth idiota estúpido imbécil basura connard imbécile ordure salaud dummkopf abschaum arschloch".split()
THREATS = "kill hurt destroy beat shoot stab burn murder strangle matar golpear tuer frapper töten schlagen".split()
MODALS = "will shall going gonna must should voy vas wird werde vais vas".split()
TARGETS = "you your he she they them him her people tú usted ustedes vous tu toi du ihr sie".split()
#: Verbs that are hostile where a target is their object.
HOSTILE = "hate hates despise despises loathe detest hasse hassen verachte odio detesto déteste détestons".split()
CONTRASTS = "but however aber sondern mais pero sino".split()
NEGATIONS = "not never no isn't aren't don't won't nicht kein keine nie pas jamais nunca ningún".split()
REPORTS = "said says wrote called quoted reported claimed allegedly sagte schrieb dijo escribió dit écrit".split()

#: Most labelled rows that a model is trained from, and what makes a term.
SAMPLE = 8000
LEAST_DOCS, LEAST_ODDS = 5, 3.0
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")
_BREAK = re.compile(r"[.!?;]")
_QUOTES = "\"“”«»"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most about ``sample`` labelled rows that aren't held
    out, chosen by the hash of their id; each text counts once."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    n = max(1, usable.count())
    part = int(16**8 * min(1.0, sample / n))
    chosen = usable.filter(md5_prefix(F.concat_ws(":", F.lit("toxic"), F.col("doc_id")), 8) < part)
    # proven bound: the sample is a parameter
    return docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def learn_terms(rows: DataFrame) -> dict[str, float]:
    """Log-odds of the words that mark toxic rows.

    Documents with a word are counted by class.  Every word in ``LEAST_DOCS``
    toxic rows whose log-odds reach ``LEAST_ODDS`` is learned; their number is
    bounded by the training sample alone.
    """
    terms = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), 0)))
    sizes = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    toxic, clean = sizes["t"], sizes["n"] - sizes["t"]
    counts = rows.select("toxic", terms.alias("term")).groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).filter(F.col("t") >= LEAST_DOCS)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    return {r["term"]: r["odds"] for r in counts.withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS).collect()}


Arcs = dict[tuple[str, str], list[tuple[str, float]]]
SYMBOLS = ("insult", "threat", "hostile", "target", "modal", "negation", "contrast", "report", "quote", "other")
HITS = ("insult", "threat", "hostile")
#: Words over which a modal reaches a threat and a target a hit.
NEAR = 6


class Transducer(NamedTuple):
    """States with weighted arcs: (state, symbol) to the next states, each with
    the factor that a hit's weight gets there.  ``ends`` are the states in
    which a clause may end."""

    start: str
    arcs: Arcs
    ends: frozenset[str]


def threats() -> Transducer:
    """A threat counts only within ``NEAR`` words after a modal."""
    after = [f"after{k}" for k in range(1, NEAR + 1)]
    arcs: Arcs = {}
    for state, following in zip(["idle", *after], ["idle", *after[1:], "idle"], strict=True):
        for symbol in SYMBOLS:
            arcs[state, symbol] = [("after1" if symbol == "modal" else following, 0.0 if symbol == "threat" and state == "idle" else 1.0)]
    return Transducer("idle", arcs, frozenset(["idle", *after]))


def hostility() -> Transducer:
    """A hostile verb counts if a target follows within two words: such a path
    waits for it and can't end before; the other path gives the verb nothing."""
    arcs: Arcs = {}
    for symbol in SYMBOLS:
        hit = symbol == "hostile"
        arcs["calm", symbol] = [("calm", 0.0), ("wait2", 1.0)] if hit else [("calm", 1.0)]
        arcs["wait2", symbol] = [("calm", 1.0)] if symbol == "target" else [] if hit else [("wait1", 1.0)]
        arcs["wait1", symbol] = [("calm", 1.0)] if symbol == "target" else []
    return Transducer("calm", arcs, frozenset(["calm"]))


def targets(raised: float = 1.25) -> Transducer:
    """A target raises the hits of the ``NEAR`` words after it, and those before
    it in its clause: such a hit may go on owing a target, and a clause can't
    end in debt."""
    near = [f"near{k}" for k in range(1, NEAR + 1)]
    arcs: Arcs = {}
    for state, following in zip(["far", *near, "owing"], ["far", *near[1:], "far", "owing"], strict=True):
        for symbol in SYMBOLS:
            if symbol == "target":
                arcs[state, symbol] = [("near1", 1.0)]
            elif symbol not in HITS:
                arcs[state, symbol] = [(following, 1.0)]
            elif state == "far":
                arcs[state, symbol] = [("far", 1.0), ("owing", raised)]
            else:
                arcs[state, symbol] = [(following, raised)]
    return Transducer("far", arcs, frozenset(["far", *near]))


def negations(lowered: float = 0.25) -> Transducer:
    """A negation lowers all hits after it, up to a contrast or the clause's end."""
    arcs: Arcs = {}
    for state in ("free", "negated"):
        for symbol in SYMBOLS:
            to = "negated" if symbol == "negation" else "free" if symbol == "contrast" else state
            arcs[state, symbol] = [(to, lowered if state == "negated" and symbol in HITS else 1.0)]
    return Transducer("free", arcs, frozenset(["free", "negated"]))


def reports(lowered: float = 0.5) -> Transducer:
    """A verb of saying lowers all hits after it, up to a contrast or the
    clause's end; quotation marks lower those between them."""
    arcs: Arcs = {}
    for state in ("plain", "reported", "quoted", "both"):
        said, quoted = state in ("reported", "both"), state in ("quoted", "both")
        for symbol in SYMBOLS:
            now = (said or symbol == "report") and symbol != "contrast", quoted != (symbol == "quote")
            to = {(False, False): "plain", (True, False): "reported", (False, True): "quoted", (True, True): "both"}[now]
            arcs[state, symbol] = [(to, lowered if (said or quoted) and symbol in HITS else 1.0)]
    return Transducer("plain", arcs, frozenset(["plain", "reported", "quoted", "both"]))


def compose(*machines: Transducer) -> Transducer:
    """One transducer that runs all at once: its states are tuples of theirs, and
    factors multiply.  Only states that can be reached are built."""
    name = "|".join
    start = tuple(m.start for m in machines)
    arcs: Arcs = {}
    ends, known, open_states = set(), {start}, [start]
    while open_states:
        state = open_states.pop()
        if all(s in m.ends for s, m in zip(state, machines, strict=True)):
            ends.add(name(state))
        for symbol in SYMBOLS:
            out = []
            for choice in itertools.product(*(m.arcs[s, symbol] for s, m in zip(state, machines, strict=True))):
                to = tuple(c[0] for c in choice)
                out.append((name(to), math.prod(c[1] for c in choice)))
                if to not in known:
                    known.add(to)
                    open_states.append(to)
            arcs[name(state), symbol] = out
    return Transducer(name(start), arcs, frozenset(ends))


class Grammar:
    """Insults, threats, targets, negation and reported speech as weighted
    finite-state transducers, composed into one that reads a clause.

    A clause's score is its best path: the sum of the weights of its hits, each
    times the factors of the arcs that read it.
    """

    def __init__(self, terms: dict[str, float]) -> None:
        self.machine = compose(threats(), hostility(), targets(), negations(), reports())
        self.classes = {w: c for c, ws in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("modal", MODALS), ("contrast", CONTRASTS)) for w in ws} | dict.fromkeys(_QUOTES, "quote")
        self.hostile = frozenset(HOSTILE) - terms.keys()
        self.terms = {w: 2.5 for w in THREATS} | {w: 1.5 for w in (*INSULTS, *HOSTILE)} | {w: v for w, v in terms.items() if w not in self.classes}
        # a threat that was learned as a term counts without a modal too
        self.threats = frozenset(THREATS) - terms.keys()
        self.finder = ahocorasick.Automaton()
        for w in self.terms:
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()

    def hits(self, lower: str) -> list[int]:
        """Where whole words of the lexicon begin."""
        found = []
        for last, size in self.finder.iter(lower):
            first = last - size + 1
            if not (first and lower[first - 1].isalpha()) and not (last + 1 < len(lower) and lower[last + 1].isalpha()):
                found.append(first)
        return found

    def read(self, symbols: list[tuple[str, float]], quoted: bool = False) -> float:
        """The best path's weight for the (symbol, weight) pairs of a clause."""
        arcs, ends = self.machine.arcs, self.machine.ends
        best = {self.machine.arcs[self.machine.start, "quote"][0][0] if quoted else self.machine.start: 0.0}
        for symbol, weight in symbols:
            now: dict[str, float] = {}
            for state, value in best.items():
                for to, factor in arcs[state, symbol]:
                    reached = value + weight * factor
                    if reached > now.get(to, -1.0):
                        now[to] = reached
            best = now
        return max((v for s, v in best.items() if s in ends), default=0.0)

    def symbols(self, clause: str) -> list[tuple[str, float]]:
        out = []
        for word in _TOKEN.findall(clause):
            weight = self.terms.get(word, 0.0)
            out.append(("threat" if word in self.threats else "hostile" if word in self.hostile else "insult" if weight else self.classes.get(word, "other"), weight))
        return out

    def clauses(self, text: str) -> list[float]:
        """Scores of the clauses with a hit, which end at . ! ? or ;"""
        lower = text.lower()
        hits = self.hits(lower)
        if not hits:
            return []
        breaks = [-1, *(m.start() for m in _BREAK.finditer(lower)), len(lower)]
        scores, done, at, quoted = [], -1, 0, False
        for hit in sorted(hits):
            k = bisect.bisect_left(breaks, hit)
            if breaks[k] == done:
                continue
            first, done = breaks[k - 1] + 1, breaks[k]
            quoted ^= sum(lower.count(q, at, first) for q in _QUOTES) % 2 == 1
            at = first
            score = self.read(self.symbols(lower[first:done]), quoted)
            if score:
                scores.append(score)
        return scores

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Strongest clause, all clauses (damped), clauses with a hit (damped)."""
        found = self.clauses(text or "")
        return max(found, default=0.0), math.log1p(sum(found)), math.log1p(len(found))


def _features(df: DataFrame, grammar: Grammar, keep: list[str], text: str = "text") -> DataFrame:
    terms = grammar.terms

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Grammar(terms)
        for texts in parts:
            yield pd.Series([list(own.features(t)) for t in texts], dtype=object)

    return df.select(*keep, of(F.col(text)).alias("features"))


def calibrate(rows: list[tuple[tuple[float, ...], int]], steps: int = 30, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton steps: weights, the constant last.

    Classes count alike, so that the score is a likelihood ratio and not the
    share of toxic rows.  Without both classes a fixed rule stands in.
    """
    y = np.array([r[1] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return [1.0, 1.0, 0.5, -3.0]
    x = np.array([[*r[0], 1.0] for r in rows])
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.append(np.ones(len(w) - 1), 0.01)
        hessian = x.T @ (x * (share * p * (1 - p))[:, None]) + np.diag(penalty)
        w -= np.linalg.solve(hessian, x.T @ (share * (p - y)) + penalty * w)
    return [float(v) for v in w]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Grammar, list[float]]:
    """The grammar and its calibration from the training rows.

    At most ``SAMPLE`` rows of three numbers reach the driver.
    """
    rows = stored(training_rows(docs, labels))
    grammar = Grammar(learn_terms(rows))
    measured = _features(rows, grammar, ["toxic"]).collect()
    return grammar, calibrate([(tuple(r["features"]), int(r["toxic"])) for r in measured])


def score(df: DataFrame, model: tuple[Grammar, list[float]], keep: list[str], text: str = "text") -> DataFrame:
    """(*keep, score): 0 to 1, higher for likelier toxic texts.

    Defined results: null, empty and matchless texts get the score of no match;
    repeated rows get equal scores; an empty table stays empty.  No shuffle.
    """
    grammar, weights = model
    logit = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        logit = logit + F.get("features", F.lit(i)) * w
    return _features(df, grammar, keep, text).select(*keep, (1 / (1 + F.exp(-logit))).alias("score"))
