"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target, negation, report or other. Four transducers rewrite the
symbols of a clause, one after the other, and are composed into one machine: negation marks what it
denies, reported speech marks what is quoted, targets mark the insults and threats near them. What
the machine gives out, weighted, makes the features of a text; a logistic model weighs these.

Insults are learned: words and beginnings of words whose odds among labelled toxic texts are high by
their lower bound. The words of the other symbols are fixed. Learning sees at most about ``SAMPLE``
labelled texts, a fixed bound; the score sees the text alone, and all of it.

Defined results: null and empty texts score as texts without a match. Without labels of both kinds
nothing is learned and every score is 0. A text with several labels counts as toxic if one of them
says so; null labels are none. An id of null is not held out. Repeated rows score alike. Bytes that are no
UTF-8 count as replacement characters, which are in no word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import bounded

SAMPLE = 20_000
# Lengths of the beginnings of words that may be learned, and the lower bound of the log odds.
STEMS = (4, 5, 6)
LEAST_ODDS = 2.0

# The words of the other symbols.
TARGETS = "you your yours he him his she her they them their du dich ihr sie vous tu te il elle usted tú él ella".split()
NEGATIONS = "not no never neither nor without cannot isn aren wasn don doesn nicht kein keine nie pas jamais nunca".split()
REPORTS = "said says say told quote quoted quotes wrote writes claimed reported sagte schrieb dit écrit dijo escribió".split()
THREATS = (
    "kill hurt shoot stab burn destroy beat attack punch strangle hang drown "
    "töten umbringen erschießen erstechen verprügeln tuer frapper étrangler poignarder matar golpear disparar apuñalar"
).split()
SYMBOLS = (
    {w: "target" for w in TARGETS}
    | {w: "deny" for w in NEGATIONS}
    | {w: "report" for w in REPORTS}
    | {w: "threat" for w in THREATS}
)

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")

Machine = Callable[[int, str], tuple[int, str]]


def negation(state: int, symbol: str) -> tuple[int, str]:
    """Denies the insults and threats among the three words after a negation."""
    if symbol == "deny":
        return 3, "other"
    if state and symbol in ("insult", "threat"):
        return state - 1, f"denied {symbol}"
    return max(state - 1, 0), symbol


def reporting(state: int, symbol: str) -> tuple[int, str]:
    """Marks the insults and threats after a verb of speech, to the end of the clause."""
    if symbol == "report":
        return 1, "other"
    return state, f"reported {symbol}" if state and symbol in ("insult", "threat") else symbol


def targeting(state: int, symbol: str) -> tuple[int, str]:
    """Marks the insults and threats among the five words after a target."""
    if symbol == "target":
        return 5, "other"
    if state and symbol in ("insult", "threat"):
        return state - 1, f"aimed {symbol}"
    return max(state - 1, 0), symbol


def aiming(state: int, symbol: str) -> tuple[int, str]:
    """A threat without a target before it is none; several insults in a row are a chain."""
    if symbol in ("insult", "aimed insult"):
        return 2, "chained insult" if state else symbol
    return max(state - 1, 0), "other" if symbol == "threat" else symbol


MACHINES: tuple[Machine, ...] = (negation, reporting, targeting, aiming)
INPUTS = ("insult", "threat", "target", "deny", "report", "other")
OUTPUTS = ("insult", "aimed insult", "chained insult", "denied insult", "reported insult", "aimed threat")


def compose(machines: tuple[Machine, ...]) -> dict[tuple[int, ...], dict[str, tuple[tuple[int, ...], str]]]:
    """One machine that does what the given ones do one after the other, from its start state on."""
    start = (0,) * len(machines)
    table, todo = {}, [start]
    while todo:
        state = todo.pop()
        if state in table:
            continue
        table[state] = {}
        for symbol in INPUTS:
            out, after = symbol, []
            for machine, s in zip(machines, state, strict=True):
                s, out = machine(s, out)
                after.append(s)
            table[state][symbol] = tuple(after), out
            todo.append(tuple(after))
    return table


@dataclass
class Model:
    """The lexicon with its weights, and the weights of the features (the last one alone)."""

    lexicon: dict[str, float]
    weights: list[float]


def stems(word: str) -> list[str]:
    """The beginnings of a word that the lexicon may hold."""
    return [word[:k] + "*" for k in STEMS if len(word) > k]


class Reader:
    """Features and scores of texts."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.table = compose(MACHINES)
        self.start = (0,) * len(MACHINES)
        self.stems = {k: {t[:-1]: w for t, w in lexicon.items() if t[-1] == "*" and len(t) == k + 1} for k in STEMS}

    def weight(self, word: str) -> float:
        """The weight of an insult, else 0."""
        found = [self.lexicon.get(word, 0.0)]
        found += [stems.get(word[:k], 0.0) for k, stems in self.stems.items() if len(word) > k]
        return max(found)

    def features(self, text: str) -> list[float]:
        """Per output of the machine the summed weights, damped; then the weight of the heaviest clause."""
        text = text.lower()
        weights = {w: x for w in set(WORD.findall(text)) if (x := self.weight(w)) or SYMBOLS.get(w) == "threat"}
        sums, heaviest = dict.fromkeys(OUTPUTS, 0.0), 0.0
        if weights:
            for clause in CLAUSE.split(text):
                words = WORD.findall(clause)
                if weights.keys().isdisjoint(words):
                    continue
                state, total = self.start, 0.0
                for word in words:
                    weight = weights.get(word, 0.0)
                    state, out = self.table[state]["insult" if weight else SYMBOLS.get(word, "other")]
                    if out in sums:
                        sums[out] += weight or 1.0
                        total += weight if out in OUTPUTS[:3] else 0.0
                heaviest = max(heaviest, total)
        return [math.log1p(x) for x in sums.values()] + [math.log1p(heaviest)]


def held_out(doc_id: Column) -> Column:
    """Every fifth id by its checksum: never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``id``, ``text``, ``toxic`` of about ``most`` labelled documents, chosen by a hash of the id.

    Of equal texts with the same label only one counts: copies say nothing new of their words.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, most / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    named = docs.select(F.col("doc_id").alias("id"), F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text"))
    texts = named.join(F.broadcast(known.withColumnRenamed("doc_id", "id")), "id")  # bounded by ``most``
    whole = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    return cut(texts.groupBy(whole, "toxic").agg(F.min(F.struct("id", "text")).alias("one")).select("one.*", "toxic"))


def learn_terms(texts: DataFrame, terms: Callable[[str], list[str]]) -> dict[str, float]:
    """What ``terms`` makes of the words of ``texts``, with weights: the lower bounds of the log odds of
    standing in a toxic text, where these are high."""
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in bounded(batch):
                seen = Counter()
                for text, toxic in zip(small.column(0).to_pylist(), small.column(1).to_pylist(), strict=True):
                    words = set(WORD.findall(text.lower()))
                    seen.update((t, toxic) for t in {t for w in words for t in terms(w)})
                names, kinds = [k[0] for k in seen], [k[1] for k in seen]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(kinds), pa.array(seen.values())], schema=schema)

    texts = texts.select("text", (F.col("toxic") == 1).cast("long").alias("toxic"))
    sizes = dict(texts.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return {}
    counted = texts.mapInArrow(count, "term string, toxic long, n long").groupBy("term").agg(
        F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c")
    )
    odds = F.log((F.col("t") + 0.5) / (sizes[1] + 1)) - F.log((F.col("c") + 0.5) / (sizes[0] + 1))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    low = (odds - 1.645 * spread).alias("weight")
    return dict(counted.select("term", low).filter(F.col("weight") > LEAST_ODDS).collect())


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """Words, and beginnings of other words, with their weights."""
    words = learn_terms(texts, lambda w: [w])
    return learn_terms(texts, lambda w: [] if w in words else stems(w)) | words


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled documents that are not held out; None if they are of one kind."""
    texts = sample(docs, labels)
    lexicon = learn_lexicon(texts)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(lexicon)
        for pdf in batches:
            yield pd.DataFrame(
                {"id": pdf["id"].astype(str), "toxic": pdf["toxic"], "x": [reader.features(t or "") for t in pdf["text"]]}
            )

    rows = texts.mapInPandas(featured, "id string, toxic int, x array<double>").orderBy("id").collect()
    toxic = np.array([r.toxic == 1 for r in rows], float)
    if not 0 < toxic.sum() < len(toxic):
        return None
    return Model(lexicon, logistic(np.array([[*r.x, 1.0] for r in rows]), toxic).tolist())


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model with a small penalty, by Newton's method."""
    w = np.zeros(x.shape[1])
    damp = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + damp, x.T @ (y - p) - damp @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(text: Column, model: Model | None) -> Column:
    """The score of a text, 0 to 1."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader, weights = Reader(model.lexicon), np.array(model.weights)
        for texts in batches:
            x = np.array([[*reader.features(t or ""), 1.0] for t in texts]).reshape(len(texts), -1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))

    return scored(F.make_valid_utf8(text))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: id, ``held_out``, ``score`` and ``predicted``."""
    model = learn(docs, labels)
    scored = docs.select("doc_id", score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic, with all their columns."""
    return docs.filter(score(F.col("text"), learn(docs, labels)) < 0.5)
