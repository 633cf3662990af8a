"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer rewrites words to classes with weights: insults, threats, targets,
negations and verbs of reported speech. It holds hand-written entries, and words and word
beginnings learned from labelled rows, as insults or, where they only count with a target
in their clause, as threats. A first machine reads a clause from the right and marks
insults and threats with a target after them. Three small transducers over the marked
classes, one for each kind of context (target, negation, reported speech), are composed
into one deterministic machine that reads the clause from the left and writes the context
of each insult and threat. A match pays its word's weight times the factor of its class and
context, so a clause without a match scores nothing whatever words it has: more with a
target near on either side, less under negation or in reported speech, a threat only with
a target before or after it in its clause.

A document's score is a logistic curve over the sum of its clauses, its density and its
largest clause, and over what each class in each context adds; the latter weights are
learned per class and context, and stay at nothing, so that the factors alone speak, for
contexts without labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.kernels import slices
from sparkloom.llm.labelled import sample
from sparkloom.llm.session import cut

INSULT, THREAT, AIMED_INSULT, AIMED_THREAT, TARGET, NEGATION, REPORT, OTHER, END = range(9)
#: AIMED_ classes are what the reading from the right makes of insults and threats with a target after them.
INSULTS, THREATS = (INSULT, AIMED_INSULT), (THREAT, AIMED_THREAT)
#: Words on each side of a target in which an insult is aimed at it; words after a negation that it reaches.
NEAR, NEGATION_REACH = 5, 3

#: Hand-written entries, by class.
LEXICON = {
    INSULT: "idiot idiots moron morons scum trash stupid worthless clown loser losers pathetic disgusting imbecile vermin filth dumb fool crétin connard imbécile ordure dummkopf abschaum trottel idiota imbécil escoria basura estúpido",
    THREAT: "kill hurt destroy burn beat strangle shoot stab töten vernichten verprügeln tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours u he she they them him her du dich dir ihr euch sie tu te toi vous il elle ils tú ti usted ustedes vosotros él ella ellos",
    NEGATION: "not no never neither nor without isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún sin",
    REPORT: "said says say wrote writes quoted quotes claimed claims reported reportedly called calls alleged sagte sagt schrieb behauptet dit écrit affirme dijo dice escribió afirma",
}
_TOKEN = re.compile(r"[^\W\d_][\w']*|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")
PREFIX_LENGTHS = range(4, 10)
_MEMO = 1 << 17


#: Bits of a context, and the factors that each pays on insults and on threats. A threat without a target pays nothing.
AIMED, NEGATED, REPORTED = 1, 2, 4
FACTORS = {INSULT: {AIMED: 1.5, NEGATED: 0.3, REPORTED: 0.6}, THREAT: {AIMED: 1.0, NEGATED: 0.3, REPORTED: 0.4}}
CONTEXTS = 8


def factor(kind: int, context: int) -> float:
    """What a match of this class pays in this context."""
    if kind == THREAT and not context & AIMED:
        return 0.0
    return math.prod(f for bit, f in FACTORS[kind].items() if context & bit)


@dataclass(frozen=True)
class Transducer:
    """Deterministic arcs (state, class) -> (state, context bits); a missing arc stays and writes none. State 0 is the start of a clause."""

    arcs: dict[tuple[int, int], tuple[int, int]]
    states: int

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (0, 0) if symbol == END else (state, 0))

    def compose(self, other: Transducer) -> Transducer:
        """Both machines read the same classes; a match has the contexts that either writes."""
        arcs = {}
        for a in range(self.states):
            for b in range(other.states):
                for symbol in range(END + 1):
                    (x, f), (y, g) = self.step(a, symbol), other.step(b, symbol)
                    arcs[a * other.states + b, symbol] = (x * other.states + y, f | g)
        return Transducer(arcs, self.states * other.states)


def _countdown(opens: int, reach: int, symbols: tuple[int, ...], context: int) -> dict:
    """After `opens`, the next `reach` words are in its scope, in which `symbols` have `context`."""
    arcs = {(s, opens): (reach, 0) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        for c in range(END):
            if c != opens:
                arcs[s, c] = (s - 1, context if c in symbols else 0)
    return arcs


def marking() -> list[list[tuple[int, int]]]:
    """The machine that reads from the right: (next state, class) by state and class. An insult is aimed with a target in the NEAR words after it, a threat with one later in its clause."""
    later = Transducer({(0, TARGET): (1, 0)}, 2)
    near = Transducer(_countdown(TARGET, NEAR, (), 0), NEAR + 1)
    both = later.compose(near)

    def mark(state: int, symbol: int) -> int:
        seen, left = divmod(state, near.states)
        return AIMED_INSULT if symbol == INSULT and left else AIMED_THREAT if symbol == THREAT and seen else symbol

    return [[(both.step(s, c)[0], mark(s, c)) for c in range(END + 1)] for s in range(both.states)]


def grammar() -> Transducer:
    """The composition of the context machines, over marked classes."""
    near = Transducer(_countdown(TARGET, NEAR, INSULTS, AIMED) | {(0, AIMED_INSULT): (0, AIMED)}, NEAR + 1)
    clause = Transducer({(0, TARGET): (1, 0), (0, AIMED_THREAT): (0, AIMED)} | {(1, c): (1, AIMED) for c in THREATS}, 2)
    negation = Transducer(_countdown(NEGATION, NEGATION_REACH, INSULTS + THREATS, NEGATED), NEGATION_REACH + 1)
    report = Transducer({(0, REPORT): (1, 0)} | {(1, c): (1, REPORTED) for c in INSULTS + THREATS}, 2)
    return near.compose(clause).compose(negation).compose(report)


@dataclass
class Model:
    """Learned entries (class, weight), and the logistic curve over a document's features."""

    words: dict[str, tuple[int, float]] = field(default_factory=dict)
    prefixes: dict[str, tuple[int, float]] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: [-4.0, 0.8, 0.0, 0.5, 0.5] + [0.0] * (2 * CONTEXTS))


class Scorer:
    """Applies a model to texts, within a task."""

    def __init__(self, model: Model):
        self.model = model
        self.classes = {w: (c, 2.0) for c, words in LEXICON.items() for w in words.split()}
        self.marking = marking()
        machine = grammar()
        self.table = [[machine.step(s, c) for c in range(END + 1)] for s in range(machine.states)]
        self.factors = [[factor(kind, context) for context in range(CONTEXTS)] for kind in (INSULT, THREAT)]
        self.memo: dict[str, tuple[int, float] | None] = {}

    def classify(self, word: str) -> tuple[int, float] | None:
        """Class and weight of a word; None for others. Hand-written entries keep their class, and the larger weight."""
        if word in _ENDS:
            return END, 0.0
        known = self.classes.get(word)
        if known is not None and known[0] > THREAT:
            return known
        model = self.model
        found = [e for e in (model.words.get(word), *(model.prefixes.get(word[:k]) for k in PREFIX_LENGTHS if len(word) >= k)) if e is not None]
        if known is not None:
            return known[0], max([known[1], *(w for c, w in found if c == known[0])])
        return max(found, key=lambda e: (e[1], -e[0])) if found else None

    def clauses(self, text: str | None) -> tuple[list[list[tuple[int, int, float]]], int]:
        """The matches (class, context, weight) of each clause that has any, and the number of words."""
        tokens = _TOKEN.findall(text.lower()) if text else []
        memo, distinct = self.memo, set(tokens)
        if len(memo) > _MEMO:
            memo.clear()
        any_match = False
        for w in distinct:
            if w not in memo:
                memo[w] = self.classify(w)
            any_match |= memo[w] is not None and memo[w][0] <= THREAT
        words = len(tokens) - sum(map(tokens.count, _ENDS & distinct))
        if not any_match:
            return [], words
        marks = [memo[w] for w in tokens]
        symbols, state = [], 0
        for m in reversed(marks):
            state, symbol = self.marking[state][OTHER if m is None else m[0]]
            symbols.append(symbol)
        out, state, clause = [], 0, []
        for m, symbol in zip(marks, reversed(symbols)):
            state, context = self.table[state][symbol]
            if symbol <= AIMED_THREAT:
                clause.append((INSULT if symbol in INSULTS else THREAT, context, m[1]))
            elif symbol == END and clause:
                out.append(clause)
                clause = []
        if clause:
            out.append(clause)
        return out, words

    def features(self, text: str | None) -> list[float]:
        """Of the clause scores: log of the sum, density and maximum; log of the number of words; and the log of the weights by class and context."""
        found, words = self.clauses(text)
        cells, scores = [0.0] * (2 * CONTEXTS), []
        for clause in found:
            scores.append(sum(w * self.factors[kind][context] for kind, context, w in clause))
            for kind, context, w in clause:
                cells[kind * CONTEXTS + context] += w * (self.factors[kind][context] > 0)
        total = sum(scores)
        return [1.0, math.log1p(total), math.log1p(words), 100 * total / (words + 20), max(scores, default=0.0), *map(math.log1p, cells)]

    def score(self, text: str | None) -> float:
        z = sum(c * x for c, x in zip(self.model.coefficients, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps, with a penalty for each column."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


_COUNTS = pa.schema([("kind", pa.int32()), ("entry", pa.string()), ("pos", pa.int64()), ("neg", pa.int64()), ("aimed_pos", pa.int64()), ("aimed_neg", pa.int64())])
_TARGETS = frozenset(LEXICON[TARGET].split())


def _entries(words: set[str]) -> set[tuple[int, str]]:
    words = {w for w in words if len(w) > 2}
    return {(0, w) for w in words} | {(1, w[:k]) for w in words for k in PREFIX_LENGTHS if len(w) > k}


def _count_entries(batches):
    """In how many documents of each label each word and word beginning stands, and in how many of those in a clause with a target."""
    for batch in batches:
        counts = [Counter() for _ in range(4)]
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            every, aimed, clause = set(), set(), set()
            for w in [*_TOKEN.findall((text or "").lower()), "."]:
                if w in _ENDS:
                    every |= clause
                    if clause & _TARGETS:
                        aimed |= clause
                    clause = set()
                else:
                    clause.add(w)
            counts[0 if label else 1].update(_entries(every))
            counts[2 if label else 3].update(_entries(aimed))
        keys = list(counts[0].keys() | counts[1].keys())
        for k in range(0, len(keys), 50000):
            part = keys[k : k + 50000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in part], pa.int32()), pa.array([e[1] for e in part], pa.string()), *[pa.array([c[e] for e in part], pa.int64()) for c in counts]], schema=_COUNTS
            )


class ToxicityGrammar:
    """Scores texts between 0 and 1; 0.5 and more means toxic.

    Learned from at most `fit_rows` labelled documents (all documents are scored). Only the
    text enters a score. Null and empty texts score as texts without words; repeated rows
    score alike; long texts are read whole. Without labelled rows of both kinds the
    hand-written entries and default coefficients are used. Further columns are ignored.
    """

    def __init__(self, fit_rows: int = 12000, entries: int = 300, folds: int = 5, held_out: int = 0):
        self.fit_rows, self.entries, self.folds, self.held_out = fit_rows, entries, folds, held_out

    def fit(self, docs: DataFrame, labels: DataFrame) -> Model:
        rows = cut(sample(docs, labels, "toxic", self.folds, self.held_out, self.fit_rows))
        total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(total) < 2:
            return Model()
        p, n = F.lit(float(total[1])), F.lit(float(total[0]))
        sums = [F.sum(c).alias(c) for c in ("pos", "neg", "aimed_pos", "aimed_neg")]
        counted = rows.repartition(max(2, self.fit_rows // 1000)).mapInArrow(_count_entries, "kind int, entry string, pos long, neg long, aimed_pos long, aimed_neg long").groupBy("kind", "entry").agg(*sums)
        odds = lambda pos, neg: F.log((pos + 0.5) / (p + 1)) - F.log((neg + 0.5) / (n + 1))
        alone = odds(F.col("pos") - F.col("aimed_pos"), F.col("neg") - F.col("aimed_neg"))
        scored = counted.where("pos >= 3").withColumns({"weight": odds(F.col("pos"), F.col("neg")), "aimed": odds(F.col("aimed_pos"), F.col("aimed_neg")), "alone": alone})
        scored = scored.withColumn("threat", (F.col("aimed_pos") >= 3) & (F.col("neg") - F.col("aimed_neg") >= 3) & (F.col("aimed") >= 1) & (F.col("alone") < 0.25))  # counts with a target, and not without one
        scored = scored.withColumn("weight", F.when(F.col("threat"), F.col("aimed")).otherwise(F.col("weight"))).where("weight >= 1").withColumn("gain", F.col("weight") * F.col("pos") / p)
        model = Model()
        for kind, into in ((0, model.words), (1, model.prefixes)):
            best = scored.where(F.col("kind") == kind).orderBy(F.desc("gain"), "entry").limit(self.entries).collect()
            into.update({r["entry"]: (THREAT if r["threat"] else INSULT, float(r["weight"])) for r in best})

        def measure(batches, model=model):
            scorer = Scorer(model)
            for batch in batches:
                x = [scorer.features(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

        seen = rows.mapInArrow(measure, "label int, x array<double>").collect()  # fit_rows short vectors at most
        y = np.array([r["label"] for r in seen], dtype=np.float64)
        ridge = np.array([1e-6, 1.0, 1.0, 1.0, 1.0] + [5.0] * (2 * CONTEXTS))
        model.coefficients = logistic_fit(np.array([r["x"] for r in seen]), y, ridge).tolist()
        return model

    def score(self, docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
        """(doc_id, score), and carried columns of docs as they are."""

        def run(batches):
            scorer = Scorer(model)
            for batch in batches:
                scores = pa.array([scorer.score(t) for part in slices(batch) for t in part.column("scored_text").to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(1, batch.num_columns)], scores], names=[*batch.schema.names[1:], "score"])

        own = docs.select(F.col("text").cast("string").alias("scored_text"), F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
        return own.mapInArrow(run, f"{fields}, score double").withColumnsRenamed({f"carried_{k}": c for k, c in enumerate(carry)})
