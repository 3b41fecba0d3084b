"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, threat, target, negation, reported speech, copula, intent, learned term,
other) through a lexicon: a small fixed one, and one learned from labelled rows. Small transducers then
rewrite and weigh the classes of a clause:

* insult: one with a target shortly before or behind it is aimed; one after a copula only weighs less,
  and one by itself so little that a second hit is needed;
* threat: one with a target behind it is aimed, and weighs in full after a word of intent; one without a
  target weighs next to nothing, so ``kill the process`` is none;
* target: strengthens a learned term shortly after it;
* negation and reported speech: damp what follows.

What looks ahead is a transducer that reads the clause from its end; the others are composed into one
machine that reads on from there. A clause's mass is what the best accepted hits weigh, and a text's score
combines the clauses, 1 - prod(1 - mass). Only clauses with a hit from the lexicon are tokenised; an
Aho-Corasick automaton finds them in the whole text.

Defined results: null and empty texts score 0; a text of any length is read whole; repeated rows repeat
their score; an id with several labels counts as toxic if one of them says so; null labels are left out;
with no labelled rows the fixed lexicon alone scores; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

CLASSES = OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, COPULA, INTENT, LEARNED, AIMED_INSULT, AIMED_THREAT = range(11)
HITS = (INSULT, THREAT, LEARNED, AIMED_INSULT, AIMED_THREAT)

# Base lexicon of the grammar.
BASE_INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile dumb filth vermin".split()
BASE_THREATS = "kill hurt destroy attack shoot stab beat burn hang strangle".split()
TARGETS = "you your yours you're he she they them him her these those people everyone du ihr sie tu vous ils ellos usted ustedes".split()
NEGATIONS = "not no never nor neither without isn't aren't wasn't don't nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says say called calls claimed wrote quoted according alleged reported sagte dit dijo".split()
COPULAS = "is are was were be am being bist ist sind est sont eres son".split()
INTENTS = "will shall gonna going wanna i'll we'll werde werden vais allons voy vamos".split()

#: Weight of a base insult or threat before any label is seen.
BASE_WEIGHT = 0.95
#: What one hit of full weight adds to its clause. An aimed insult alone passes the decision threshold, as
#: does an aimed threat after a word of intent; all else needs a second hit. A learned term weighs
#: LEARNED_PART of its probability at most.
HIT_MASS, LEARNED_PART = 0.75, 0.9
AIMED, COPULAR, ISOLATED = 1.1, 0.85, 0.66
UNINTENDED, AIMLESS = 0.75, 0.1
NEGATED, REPORTED, TARGETED = 0.45, 0.6, 1.15
THRESHOLD = 0.7
#: Learning: about SAMPLE_ROWS labelled rows (by a hash of the id); a term needs MIN_ROWS toxic rows and a
#: smoothed probability of MIN_PROBABILITY; stems have STEMS letters. A term is a threat if INTENDED of its
#: toxic rows have it behind a word of intent. All terms that pass are taken: the sample bounds them.
SAMPLE_ROWS, MIN_ROWS, MIN_PROBABILITY, STEMS = 30_000, 4, 0.8, (4, 5)
PRIOR_ROWS, INTENDED = 1.0, 0.5

_word = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_clause_end = re.compile(r"[.!?;:\n]")


@dataclass
class Transducer:
    """Weighted finite-state transducer over classes: (state, class) -> (state, class, weight).

    ``default`` applies to classes without an arc: same class out, weight 1, next state as given.
    """

    arcs: dict[tuple[int, int], tuple[int, int, float]]
    default: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol)) or (self.default.get(state, state), symbol, 1.0)


def compose(*machines: Transducer) -> Transducer:
    """One machine that feeds each machine's output to the next; states are numbered tuples."""
    start = (0,) * len(machines)
    number, queue, arcs = {start: 0}, [start], {}
    while queue:
        states = queue.pop()
        for symbol in CLASSES:
            out, weight, after = symbol, 1.0, []
            for machine, state in zip(machines, states, strict=True):
                state, out, w = machine.step(state, out)
                weight *= w
                after.append(state)
            if (key := tuple(after)) not in number:
                number[key] = len(number)
                queue.append(key)
            arcs[number[states], symbol] = (number[key], out, weight)
    return Transducer(arcs)


Rewriting = dict[int, tuple[int, float]]


def within(trigger: int, reach: int, then: Rewriting, otherwise: Rewriting | None = None) -> Transducer:
    """For ``reach`` words after a trigger classes are rewritten as ``then`` says, else as ``otherwise``."""
    arcs = {(s, trigger): (reach, trigger, 1.0) for s in range(reach + 1)}
    arcs |= {(s, c): (s - 1, out, w) for s in range(1, reach + 1) for c, (out, w) in then.items()}
    arcs |= {(0, c): (0, out, w) for c, (out, w) in (otherwise or {}).items()}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(reach + 1)})


def damped(factor: float) -> Rewriting:
    return {c: (c, factor) for c in HITS}


def ahead() -> Transducer:
    """Reads a clause from its end: what has a target behind it is aimed."""
    return within(TARGET, 3, {INSULT: (AIMED_INSULT, AIMED), THREAT: (AIMED_THREAT, AIMED)})


def grammar() -> Transducer:
    """Reads on from the start, over what ``ahead`` wrote."""
    aim = within(TARGET, 4, {INSULT: (AIMED_INSULT, AIMED), LEARNED: (LEARNED, TARGETED)})
    insult = within(COPULA, 3, {INSULT: (INSULT, COPULAR)}, {INSULT: (INSULT, ISOLATED)})
    threat = within(INTENT, 4, {THREAT: (THREAT, AIMLESS)}, {THREAT: (THREAT, AIMLESS), AIMED_THREAT: (AIMED_THREAT, UNINTENDED)})
    return compose(aim, insult, threat, within(NEGATION, 3, damped(NEGATED)), within(REPORT, 6, damped(REPORTED)))


def terms_of(text: str | None) -> dict[str, bool]:
    """The words and stems of a text, and whether one of them stands behind a word of intent in its clause."""
    found: dict[str, bool] = {}
    for clause in _clause_end.split((text or "").lower()):
        intended = False
        for word in _word.findall(clause):
            for term in (word, *(word[:k] + "*" for k in STEMS if len(word) > k)):
                found[term] = found.get(term, False) or intended
            intended = intended or word in INTENTS
    return found


def learn(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[str, tuple[float, bool]]:
    """Terms with their probability and whether they are threats; a stem is written with a trailing ``*``.

    ``training`` is a condition on ``labels``. Only those rows' ids and labels are read. Texts are
    sampled by a hash of the id down to about SAMPLE_ROWS rows; document counts of the terms are
    aggregated on the executors and only terms that pass the thresholds reach the driver.
    """
    marked = labels.where(training & labels[label_col].isNotNull()).select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("toxic"))
    rows = marked.groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = max(1, rows.count())
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < min(1.0, SAMPLE_ROWS / n) * (1 << 20))
    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(rows), "id").select("toxic", "text")  # SAMPLE_ROWS, about

    def make():
        def work(batch: dict) -> dict:
            found = [terms_of(t) for t in batch["text"]]
            return {"toxic": batch["toxic"], "terms": [[{"term": t, "intended": i} for t, i in f.items()] for f in found]}

        return work

    listed = map_texts(base, make, "toxic int, terms array<struct<term string, intended boolean>>", rows=64)
    terms = listed.select("toxic", F.explode("terms").alias("t")).select("toxic", "t.term", "t.intended")
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("rows"), F.sum(F.when(F.col("intended"), F.col("toxic")).otherwise(0)).alias("meant"))
    rate = rows.agg(F.avg("toxic")).first()[0] or 0.0
    probability = (F.col("bad") + PRIOR_ROWS * rate) / (F.col("rows") + PRIOR_ROWS)
    found = counts.where(F.col("bad") >= MIN_ROWS).select("term", probability.alias("p"), (F.col("meant") >= INTENDED * F.col("bad")).alias("threat")).where(F.col("p") >= MIN_PROBABILITY)
    return {r.term: (float(r.p), r.threat) for r in found.collect()}


class Scorer:
    def __init__(self, learned: dict[str, tuple[float, bool]]):
        import ahocorasick

        self.words: dict[str, tuple[int, float]] = {}
        for kind, terms in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (COPULA, COPULAS), (INTENT, INTENTS)):
            self.words |= dict.fromkeys(terms, (kind, 0.0))
        for kind, terms in ((INSULT, BASE_INSULTS), (THREAT, BASE_THREATS)):
            self.words |= dict.fromkeys(terms, (kind, BASE_WEIGHT))
        known = {t: (THREAT if threat else LEARNED, LEARNED_PART * p) for t, (p, threat) in learned.items()}
        self.words |= {t: x for t, x in known.items() if not t.endswith("*") and t not in self.words}
        self.stems = {t[:-1]: x for t, x in known.items() if t.endswith("*")}
        self.ahead, self.machine = ahead(), grammar()
        self.find = ahocorasick.Automaton()
        for t in [*(w for w, (kind, _) in self.words.items() if kind in HITS), *self.stems]:
            self.find.add_word(t, len(t))
        self.find.make_automaton()

    def kind(self, word: str) -> tuple[int, float]:
        if word in self.words:
            return self.words[word]
        stems = [self.stems[word[:k]] for k in STEMS if len(word) > k and word[:k] in self.stems]
        return max(stems, key=lambda x: x[1], default=(OTHER, 0.0))

    def clause(self, text: str) -> float:
        """Mass of one clause: the look-ahead machine from its end, then the composed one."""
        kinds = [self.kind(word) for word in _word.findall(text)]
        state, seen = 0, []
        for kind, weight in reversed(kinds):
            state, out, factor = self.ahead.step(state, kind)
            seen.append((out, weight * factor))
        state, rest = 0, 1.0
        for kind, weight in reversed(seen):
            state, out, factor = self.machine.arcs[state, kind]
            if out in HITS:
                rest *= 1 - HIT_MASS * min(1.0, weight * factor)
        return 1 - rest

    def spans(self, low: str) -> Iterator[tuple[int, int]]:
        """Bounds of the clauses that hold a lexicon entry at the start of a word."""
        done = 0
        for end, length in self.find.iter(low):
            begin = end - length + 1
            if begin < done or (begin and low[begin - 1].isalpha()):
                continue
            start = max(low.rfind(c, done, begin) for c in ".!?;:\n") + 1
            stop = m.start() if (m := _clause_end.search(low, end)) else len(low)
            yield max(start, done), stop
            done = stop

    def score(self, text: str | None) -> float:
        low, rest = (text or "").lower(), 1.0
        for begin, stop in self.spans(low):
            rest *= 1 - self.clause(low[begin:stop])
        return 1 - rest


def score_texts(docs: DataFrame, learned: dict[str, tuple[float, bool]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # terms of the bounded sample
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def make():
        scorer = Scorer(shared.value)
        return lambda batch: {"id": batch["id"], "score": list(map(scorer.score, batch["text"]))}

    return map_texts(narrow, make, f"id {narrow.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def filter_toxic(docs: DataFrame, learned: dict[str, tuple[float, bool]], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, all their columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield part.filter(pa.array([scorer.score(t) < threshold for t in part.column(at).to_pylist()], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
