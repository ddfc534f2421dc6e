"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are first read by a lexical transducer: learned insult words and word beginnings, and fixed lists of threat verbs,
addressed targets, negations and verbs of speech, in the four languages of the corpus. A clause is a run of words between
stops; a second transducer walks over its word classes and gives each insult or threat a weight that depends on where it
stands: after a negation or inside reported speech it counts less, next to a target more. A document's score is a
logistic function of its clause weights, fitted on labelled documents. Clauses that hold no trigger are never walked.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, whole

LABELLED_ROWS = 40_000  # most labelled documents a fit reads, the ones whose ids hash lowest
LEXICON_ENTRIES = 5_000  # most learned words and beginnings, best first
MIN_DOCS = 5  # labelled documents an entry must occur in
MIN_LIFT = 2.0  # least log odds ratio of an entry
STEM_CHARS = 5  # length of learned word beginnings

# Closed word classes in English, German, French and Spanish.
THREATS = "kill hurt destroy beat stab shoot burn töten umbringen schlagen vernichten tuer frapper brûler détruire matar golpear quemar destruir".split()
TARGETS = "you your yours yourself they them these those people du dich dir dein ihr euch euer sie tu toi te ton vous votre ils tú ti tus usted ustedes vosotros ellos".split()
NEGATIONS = "not no never n't without nicht kein keine nie ohne pas jamais sans aucun nunca sin ningún".split()
REPORTS = "said says told wrote quoted called claimed sagte sagt schrieb zitierte behauptete dit écrit cité affirmé dijo dice escribió citó afirmó".split()

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_STOP = re.compile(r"[.!?;:\n\r]")
# What an arc multiplies a trigger's weight by, given the state it is read in.
ARCS = {"plain": 1.0, "targeted": 1.5, "negated": 0.5, "reported": 0.5, "negated_targeted": 0.7, "reported_targeted": 0.8}
MEMORY = 4  # words after which a negation or target no longer bears on a trigger


@dataclass
class Lexicon:
    """Learned triggers: whole words and word beginnings with their weights (log odds ratios)."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    @cached_property
    def machine(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for entry in {*self.words, *self.stems, *THREATS}:
            machine.add_word(entry, len(entry))
        machine.make_automaton()
        return machine

    def weight(self, word: str) -> float:
        known = self.words.get(word)
        return known if known is not None else self.stems.get(word[:STEM_CHARS], 0.0)


def walk(words: list[str], lexicon: Lexicon) -> list[tuple[str, float]]:
    """The pattern transducer over one clause: (pattern, weight) for each insult or threat in it.

    States say whether speech is being reported (to the end of the clause) and how many words ago a negation and a
    target were read. A threat only matches with a target on either side, an insult matches anyhow.
    """
    targets = [i for i, w in enumerate(words) if w in _TARGETS]
    reported, negation, out, seen_targets = False, -MEMORY - 1, [], 0
    for i, word in enumerate(words):
        if word in _REPORTS:
            reported = True
        elif word in _NEGATIONS or word.endswith("n't"):
            negation = i
        while seen_targets < len(targets) and targets[seen_targets] < i - MEMORY:
            seen_targets += 1
        targeted = seen_targets < len(targets) and abs(targets[seen_targets] - i) <= MEMORY
        insult = lexicon.weight(word)
        threat = word in _THREATS and targeted
        if not insult and not threat:
            continue
        state = "negated" if i - negation <= MEMORY else "reported" if reported else ""
        state = f"{state}_targeted" if state and targeted else state or ("targeted" if targeted else "plain")
        out.append((f"{'insult' if insult else 'threat'}:{state}", (insult or 1.0) * ARCS[state]))
    return out


_TARGETS, _NEGATIONS, _REPORTS, _THREATS = map(frozenset, (TARGETS, NEGATIONS, REPORTS, THREATS))


def matched(text: str, lexicon: Lexicon) -> list[tuple[str, float]]:
    """Patterns of all clauses of a text that hold a trigger."""
    low = text.lower()
    out: list[tuple[str, float]] = []
    done = 0  # end of the last clause walked
    for end, length in lexicon.machine.iter(low):
        start = end - length + 1
        if start < done or (start and (low[start - 1].isalpha() or low[start - 1] == "'")):
            continue
        a = max(low.rfind(stop, done, start) for stop in ".!?;:\n\r") + 1
        stop = _STOP.search(low, end)
        opened, done = done, stop.start() if stop else len(low)
        out += walk(_WORD.findall(low, max(a, opened), done), lexicon)
    return out


FEATURES = 4


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Sum, largest and damped number of clause weights, and their density in the text."""
    found = [w for _, w in matched(text, lexicon)]
    if not found:
        return [0.0] * FEATURES
    total = sum(found)
    return [math.log1p(total), max(found), math.log1p(len(found)), math.log1p(1000.0 * total / (len(text) + 200))]


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]
    bias: float

    def score(self, text: str) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, features(text, self.lexicon), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """Entries from (text, label): words and word beginnings that toxic documents use far more often.

    Documents are counted, not occurrences, and counts are added up before they are shuffled. What comes back to the
    driver is at most LEXICON_ENTRIES rows.
    """
    words = labelled.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where("word <> ''")
    n = labelled.groupBy().agg(F.sum("label").alias("pos"), F.count("*").alias("n")).first()
    pos, neg = int(n["pos"] or 0), int(n["n"]) - int(n["pos"] or 0)
    if not pos or not neg:
        return Lexicon()
    counts = words.groupBy("word").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    counts = stored(counts, "words")

    def best(df: DataFrame, column: str) -> dict[str, float]:
        odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("n") - F.col("pos") + 0.5) / (neg + 1.0))
        rows = df.where(F.col("pos") >= MIN_DOCS).withColumn("lift", odds).where(F.col("lift") >= MIN_LIFT).orderBy(F.desc(F.col("lift") * F.sqrt("pos")), column).limit(LEXICON_ENTRIES)
        return {r[column]: float(r["lift"]) for r in rows.select(column, "lift").collect()}

    # A beginning counts over all its words, so that one clean word that shares it speaks against it.
    stems = counts.where(F.length("word") >= STEM_CHARS).groupBy(F.substring("word", 1, STEM_CHARS).alias("stem")).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    return Lexicon(best(counts, "word"), best(stems, "stem"))


def logistic(x: np.ndarray, neg: np.ndarray, pos: np.ndarray, ridge: float = 1e-4, rounds: int = 60) -> tuple[list[float], float]:
    """Ridge logistic regression by Newton steps; each row of x was seen neg and pos times with labels 0 and 1."""
    a = np.hstack([x, np.ones((len(x), 1))])
    n, w = neg + pos, np.zeros(a.shape[1])
    penalty = ridge * n.sum() * np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (pos - n * p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = LABELLED_ROWS) -> Model:
    """A model from at most `rows` labelled documents, those whose ids hash lowest.

    Without labels of both kinds nothing can be learned: the model then scores every text with the share of label 1.
    """
    keyed = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = stored(keyed.orderBy(F.xxhash64("_id"), "_id").limit(rows), "chosen")
    labelled = stored(docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("text", "label"), "labelled")
    lexicon = learn_lexicon(labelled)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table: dict[tuple[float, ...], list[int]] = {}
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                cell = table.setdefault(tuple(round(v, 2) for v in features(text.as_py(), lexicon)), [0, 0])
                cell[label.as_py()] += 1
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in table], pa.list_(pa.float64())), pa.array([v[0] for v in table.values()], pa.int64()), pa.array([v[1] for v in table.values()], pa.int64())], names=["x", "neg", "pos"])

    cells = labelled.mapInArrow(measure, "x array<double>, neg long, pos long").groupBy("x").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).collect()
    neg, pos = sum(c["neg"] for c in cells), sum(c["pos"] for c in cells)
    if not neg or not pos:
        share = (pos + 0.5) / (neg + pos + 1)
        return Model(Lexicon(), [0.0] * FEATURES, math.log(share / (1 - share)) - (0.001 if share == 0.5 else 0.0))
    weights, bias = logistic(np.array([c["x"] for c in cells]), np.array([c["neg"] for c in cells], float), np.array([c["pos"] for c in cells], float))
    return Model(lexicon, weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from 0.5 on); a null text is scored as the empty one.

    Every text is read whole and on its own, so repeats, ties and row order change nothing; an empty table gives an
    empty result. Columns named score or predicted are replaced.
    """
    base = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    schema = base.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            scores = [model.score(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return base.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
