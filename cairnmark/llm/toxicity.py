"""Toxicity by a weighted finite-state pattern grammar over the words of clauses.

Words are mapped to classes (insult, threat, target, negation, reporting verb, quote, filler, other). Small
transducers read the classes: one gives insults their weight and raises it near a target, one turns a threat verb
with a target into a match, one lets a negation that reaches an insult or a threat verb over fillers take its weight
away, one discounts what stands in quotes after a reporting verb. They are composed into one machine that scores each
clause with a match; a document's score joins those of its clauses, whose odds shrink as a long document grows longer.
Insults are a short seed list and the words and word beginnings that a bounded sample of labelled rows shows to be
toxic; the same rows weigh each pair of a threat verb and a target.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, table
from .shingles import arrow_rows, mixed, shingles

#: Labelled rows that the insult lexicon is learned from, at most about so many (chosen by hash of the id).
LABEL_ROWS = 20_000
PREFIXES = (4, 5, 6)
#: A learned unit's rows: toxic ones at least, significance at least, others at most (one, or this part).
MIN_TOXIC, MIN_Z, MAX_OTHER = 3, 6.0, 0.05

SEED_INSULTS = "idiot moron stupid pathetic worthless disgusting scum loser clown trash imbecile dumbass scumbag bastard asshole bitch retard cretin degenerate subhuman vermin".split()
SEED_WEIGHT, SEED_ROWS = 0.8, 2.0
#: Weight of a threat that labels say nothing of, and the rows that it counts as.
THREAT_WEIGHT, THREAT_ROWS = 0.7, 2.0
#: In a text of more characters than this the odds of each clause shrink in proportion.
LONG_TEXT = 1_500
THREATS = "kill hurt destroy strangle stab shoot murder beat crush smash burn hang slaughter".split()
TARGETS = "you your yours yourself u he him she her they them these those people everyone someone tu te toi vous du dich sie ihr usted ustedes".split()
NEGATIONS = "not never isn't aren't wasn't weren't don't doesn't didn't cannot can't won't hardly nicht kein keine jamais nunca".split()
REPORTS = "said says say called calls wrote writes claimed reported quoted yelled shouted sagte dit dijo".split()
FILLERS = "a an the is are was were be been very so such really truly too that any just un une eine ein el la le der die das".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")
CLAUSE = re.compile(r"[^.!?;\n]+")
THREAT_WORD = re.compile("|".join(THREATS))


class Transducer:
    """Deterministic: arcs[state][class] = (next state, output); classes without an arc go by the state's '*'."""

    def __init__(self, arcs: list[dict]):
        self.arcs = arcs

    def step(self, state: int, cls: str):
        arcs = self.arcs[state]
        return arcs.get(cls) or arcs["*"]


def compose(*machines: Transducer) -> Transducer:
    """The product machine: all read the same classes; its output is the tuple of theirs."""
    classes, states, arcs = "ITPNRQF*", {(0,) * len(machines): 0}, []
    todo = [(0,) * len(machines)]
    while todo:
        at, own = todo.pop(0), {}
        for c in classes:
            steps = [m.step(s, c) for m, s in zip(machines, at, strict=True)]
            to = tuple(s for s, _ in steps)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            own[c] = (states[to], tuple(o for _, o in steps))
        arcs.append(own)
    return Transducer(arcs)


def near(span: int, mark: str, on: str, near_out: float, far_out: float) -> Transducer:
    """On `on`: near_out if `mark` stood at most `span` words before, else far_out. Other words: nothing."""
    arcs = []
    for s in range(span + 1):
        nxt = max(0, s - 1)
        arcs.append({mark: (span, None), on: (nxt, near_out if s else far_out), "*": (nxt, None)})
    return Transducer(arcs)


AIMED = near(4, "P", "I", 0.5, 0.0)  # part of the doubt that a target takes away
THREAT = near(3, "T", "P", 1.0, 0.0)  # a target soon after a threat verb
NEGATED = Transducer([
    {"N": (1, None), "I": (0, 1.0), "P": (0, 1.0), "*": (0, None)},
    {"N": (1, None), "F": (1, None), "I": (0, 0.1), "T": (2, None), "P": (0, 1.0), "*": (0, None)},
    {"I": (2, 1.0), "P": (3, 0.1), "*": (2, None)},  # a negated threat verb; others may be joined to it
    {"N": (1, None), "I": (3, 1.0), "P": (3, 0.1), "T": (0, None), "*": (3, None)},  # its targets
])
REPORTED = Transducer([
    {"R": (1, 1.0), "*": (0, 1.0)},
    {"Q": (2, 1.0), "*": (1, 1.0)},
    {"Q": (0, 0.4), "*": (2, 0.4)},
])
GRAMMAR = compose(AIMED, THREAT, NEGATED, REPORTED)
WORD_CLASS = {w: c for c, ws in (("F", FILLERS), ("R", REPORTS), ("N", NEGATIONS), ("P", TARGETS), ("T", THREATS)) for w in ws} | dict.fromkeys('"“”«»', "Q")


class Model:
    """A lexicon {unit: weight}; a unit ending in * stands for words that begin so. base: score without a match.

    threats: weights of "verb target"; pairs that aren't there have THREAT_WEIGHT.
    """

    def __init__(self, lexicon: dict[str, float], base: float, threats: dict[str, float] | None = None):
        import ahocorasick

        self.lexicon, self.base, self.threats, self.auto = lexicon, base, threats or {}, ahocorasick.Automaton()
        for unit, w in lexicon.items():
            self.auto.add_word(unit.rstrip("*"), (unit, w))
        for w in THREATS:
            if w not in lexicon:
                self.auto.add_word(w, (w, 0.0))
        self.auto.make_automaton()

    def clause(self, words: list[str], weights: dict[str, float]) -> float:
        state, clean, verb = 0, 1.0, ""
        for w in words:
            own = weights.get(w, 0.0)
            cls = "I" if own else WORD_CLASS.get(w, "*")
            state, (aimed, threat, negated, reported) = GRAMMAR.arcs[state][cls]
            if cls == "T":
                verb = w
            if own:
                clean *= 1 - (1 - (1 - own) * (1 - aimed)) * negated * reported
            elif threat:
                clean *= 1 - threat * self.threats.get(f"{verb} {w}", THREAT_WEIGHT) * negated * reported
        return 1 - clean

    def score(self, text: str | None) -> float:
        """0 to 1; null and empty texts have the base score."""
        low = (text or "").lower()
        hits, weights, size = [], {}, len(low)
        for end, (unit, w) in self.auto.iter(low):
            start = end + 1 - len(unit.rstrip("*"))
            if start and low[start - 1].isalpha():
                continue
            stop = end + 1
            if unit[-1] == "*":
                while stop < size and low[stop].isalpha():
                    stop += 1
                if stop == end + 1:
                    continue
            elif stop < size and low[stop].isalpha():
                continue
            hits.append(start)
            word = low[start:stop]
            weights[word] = max(w, weights.get(word, 0.0))
        clean = 1 - self.base
        if hits:
            hits.sort()
            times = max(1.0, size / LONG_TEXT)  # as often is such a clause met by chance
            for m in CLAUSE.finditer(low):
                i = bisect.bisect_left(hits, m.start())
                if i < len(hits) and hits[i] < m.end():
                    p = self.clause(WORD.findall(m[0]), weights)
                    clean *= 1 - p / (p + (1 - p) * times)
        return 1 - clean


def _units(text: str) -> set[str]:
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


def _threats(text: str) -> set[str]:
    """The "verb target" of every threat that is neither negated nor reported, and "verb " and " " of them."""
    out = set()
    for m in CLAUSE.finditer(text.lower()):
        state, verb = 0, ""
        if not THREAT_WORD.search(m[0]):
            continue
        for w in WORD.findall(m[0]):
            cls = WORD_CLASS.get(w, "*")
            state, (_, threat, negated, reported) = GRAMMAR.arcs[state][cls]
            if cls == "T":
                verb = w
            if threat and negated == reported == 1.0:
                out |= {f"{verb} {w}", f"{verb} ", " "}
    return out


def threat_weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights of all pairs from counts (rows, toxic ones) of units of _threats: their labelled toxic share.

    A pair of few rows leans on the share of its verb and that on the share of all threats; what other pairs show can
    lower but never raise a pair that has no rows.
    """
    def share(unit, before):
        n, t = counts.get(unit, (0, 0))
        return (t + min(THREAT_WEIGHT, before) * THREAT_ROWS) / (n + THREAT_ROWS)

    every = share(" ", THREAT_WEIGHT)
    return {f"{v} {w}": share(f"{v} {w}", share(f"{v} ", every)) for v in THREATS for w in TARGETS}


def train(docs: DataFrame, labels: DataFrame, max_rows: int = LABEL_ROWS) -> Model:
    """The model learned from labelled rows whose crc32(doc_id as text) mod 5 isn't 0: at most about max_rows of them.

    The lexicon is all units of their texts that pass the test, so that it is bounded as they are. Of equal and nearly equal texts (by either of two MinHashes) one counts. Rows without id, label or text teach nothing; without labelled rows the seeds stay.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    part = min(1.0, max_rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(known), "doc_id").select("text", "toxic", F.md5(F.col("text").cast("binary")).alias("d"))

    @F.pandas_udf("array<long>")
    def least(texts: pd.Series) -> pd.Series:
        out = []
        for x in texts:
            h = shingles(x)
            out.append([int(v.min().view(np.int64)) if len(v) else 0 for v in (h, mixed(h * np.uint64(3)))])
        return pd.Series(out)

    rows = rows.withColumn("m", least(F.col("text").cast("binary")))
    for i in (0, 1):
        rows = rows.groupBy(F.col("m")[i].alias("_m")).agg(F.min_by(F.struct("text", "toxic", "d", "m"), F.struct("d", "toxic")).alias("r")).select("r.*")

    def count(batches):
        n, t = Counter(), Counter()
        for text, toxic in arrow_rows(batches, 0, 1):
            own = _units(text)
            own |= _threats(text)
            own.add("")  # rows
            n.update(own)
            if toxic:
                t.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([t[u] for u in n], pa.int64())], ["unit", "n", "t"])

    counts = rows.select("text", "toxic").mapInArrow(count, "unit string, n long, t long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    counts = materialize(counts, "units")
    # what labels say of seeds and threats counts, clean rows too; there are no more of them than lists allow
    always = (F.col("unit") == "") | F.col("unit").isin(SEED_INSULTS) | F.col("unit").contains(" ")
    n, t = (counts.filter("unit = ''").select("n", "t").first() or (0, 0))
    base = (t + 1) / (n + 10)
    z = (F.col("t") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    learned = (F.col("t") >= MIN_TOXIC) & (F.col("n") - F.col("t") <= F.greatest(F.lit(1.0), F.col("n") * MAX_OTHER)) & (z >= MIN_Z)
    got = {r["unit"]: (r["n"], r["t"]) for r in counts.filter(always | learned).collect()}
    got.pop("", None)
    lexicon = {}
    for unit in SEED_INSULTS:
        un, ut = got.pop(unit, (0, 0))
        lexicon[unit] = (ut + SEED_WEIGHT * SEED_ROWS) / (un + SEED_ROWS)
    threats = threat_weights({unit: got.pop(unit) for unit in list(got) if " " in unit})
    lexicon |= {unit: ut / (un + 1) for unit, (un, ut) in got.items()}
    return Model(lexicon, min(0.4, base / 4), threats)


def score_column(model: Model, spark: SparkSession, text: Column) -> Column:
    shared = spark.sparkContext.broadcast((model.lexicon, model.base, model.threats))
    held: dict = {}

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if "m" not in held:
            held["m"] = Model(*shared.value)
        return pd.Series(np.fromiter(map(held["m"].score, texts), float, len(texts)))

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5, else 0) to every row of docs.

    Only the text is scored: null and empty texts get the base score, below 0.5; repeated rows score alike; the other
    columns stay, except such as are named score or predicted.
    """
    model = model or train(docs, labels)
    kept = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    return kept.withColumn("score", score_column(model, docs.sparkSession, F.col("text"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below 0.5, with their columns.

    Null and empty texts score below 0.5 and stay, as do null ids; repeated rows go or stay together; texts of any length
    are scored whole; without labels the seeds alone decide; an empty table gives no rows.
    """
    model = train(docs, labels)
    return docs.filter(score_column(model, docs.sparkSession, F.col("text")) < 0.5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
