"""Quality rules as weak supervision: rules vote or abstain, and a posterior decides.

Each rule looks at whole-text statistics and votes good, bad or nothing. How far its votes can be trusted
is not given but estimated, by expectation-maximisation of a latent class model in which votes are
independent given the class. Bad texts are bad in different ways, so there is one good class and, for
each rule, a bad class that is told from the others by starting, and being held by a prior of ``OWN_PRIOR``
of the documents, where that rule mostly says so. How often it does, how often the other rules agree there,
and how often any rule is wrong on good texts, comes from the data. The model needs only how often each pattern of
votes occurs, counted over all documents; there are at most ``3 ** rules`` patterns (and far fewer). A
document is kept if its posterior probability of good quality is at least one half and no base rule
failed.

Defined results: a null text has no words and fails the base rule on length; on a text without words all rules
vote bad. Documents on which all rules abstain get the estimated share of good ones. Repeated rows get
equal results. Bytes that are no UTF-8 count as a replacement character each. An empty table gives an empty
table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import map_batches

WINDOW = 8
SIGNS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + CAPITALS.lower() + bytes(range(128, 256))


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal ones alike."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in a window of ``window`` words that stands in the text twice or more."""
    if len(ids) <= window:
        return 0
    # names of ever longer windows by doubling: equal names, equal words
    named, size = ids, 1
    while size < window:
        step = min(size, window - size)
        pairs = named[: len(named) - step] * (int(named.max()) + 1) + named[step:]
        named = np.unique(pairs, return_inverse=True)[1]
        size += step
    # a word is in a repeated window if one starts at it or at one of the words before it
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(np.bincount(named)[named] > 1)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


STATISTICS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_distinct", "n_same", "n_letters", "n_upper", "n_calls", "word_bytes",
]


def measure(text: bytes) -> tuple[int, ...]:
    """``STATISTICS`` of a text in UTF-8: ``n_distinct`` different words, ``n_same`` that equal the word
    before, bytes of letters and other scripts, upper-case letters, exclamation marks, bytes of words."""
    words = text.split()  # of bytes: ASCII white space
    joined = b"".join(words)
    ids = numbered(words)
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return (
        len(words),
        len(joined.decode(errors="replace")),
        len(joined) - len(joined.translate(None, SIGNS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        int(ids.max(initial=-1)) + 1,
        int((ids[1:] == ids[:-1]).sum()),
        len(joined) - len(joined.translate(None, LETTERS)),
        len(joined) - len(joined.translate(None, CAPITALS)),
        joined.count(b"!"),
        len(joined),
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Id and the statistics of each text."""
    kept = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    schema = ", ".join([f"id {kept.schema['id'].dataType.simpleString()}", *(f"{n} long" for n in STATISTICS)])

    def make():
        def work(columns):
            found = [measure(t or b"") for t in columns["text"].to_pylist()]
            return {"id": columns["id"], **dict(zip(STATISTICS, zip(*found, strict=True), strict=True))}

        return work

    return map_batches(kept, make, schema)


def votes() -> dict[str, Column]:
    """The rules: 1 votes good, -1 bad, 0 abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1))

    def rule(good: Column, bad: Column) -> Column:
        vote = F.when(bad, -1).when(good, 1).otherwise(0)
        return F.when(F.col("n_words") > 0, vote).otherwise(-1).cast("int")

    mean, symbols, lines = F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_dup_lines") / words
    repeats, distinct, same = F.col("n_repeat_words") / words, F.col("n_distinct") / words, F.col("n_same") / words
    size = F.greatest(F.col("word_bytes"), F.lit(1))
    letters, upper, calls = F.col("n_letters") / size, F.col("n_upper") / size, F.col("n_calls") / words
    return {
        "length": rule(F.col("n_words") >= 50, F.col("n_words") < 20),
        "word_length": rule(mean.between(3, 9), (mean < 2) | (mean > 15)),
        "symbols": rule(symbols <= 0.02, symbols > 0.1),
        "letters": rule(letters > 0.93, letters < 0.87),
        "case": rule(upper <= 0.1, upper > 0.3),
        "calls": rule(calls <= 0.02, calls > 0.2),
        "lines": rule(lines == 0, lines > 0.1),
        "repeats": rule(repeats <= 0.02, repeats > 0.3),
        "same": rule(same <= 0.02, same > 0.2),
        # long texts repeat their words, so few different ones say something of short texts only
        "distinct": rule(distinct > 0.5, (distinct < 0.25) & (F.col("n_words") < 500)),
    }


@dataclass
class Model:
    """``share`` of each class, the good one first, and ``vote``: per rule, class and vote (-1, 0, 1), its
    probability."""

    share: np.ndarray
    vote: np.ndarray


# Before any document is seen: a rule's votes in the class of what it finds.
OWN = np.array([0.99, 0.009, 0.001])
# Before any document is seen: votes on good texts, and votes of other rules on bad ones.
ON_GOOD = np.array([0.005, 0.045, 0.95])
ON_BAD = np.array([0.2, 0.2, 0.6])
# The part of the documents as which these count.
PRIOR = 0.002
OWN_PRIOR = 0.02
BAD = 0.02


def as_seen(patterns: np.ndarray) -> np.ndarray:
    """Per pattern, rule and vote whether it is so."""
    return np.stack([(patterns == v) for v in (-1, 0, 1)], axis=-1).astype(float)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> Model:
    """The model of ``counts`` documents with the votes ``patterns``."""
    rules = patterns.shape[1]
    seen = as_seen(patterns)
    guess = np.tile(ON_BAD, (rules, 1 + rules, 1))
    guess[:, 0] = ON_GOOD
    own = np.arange(rules)
    guess[own, own + 1] = OWN
    strength = np.full((rules, 1 + rules, 1), PRIOR)
    strength[own, own + 1] = OWN_PRIOR
    shares = np.array([1 - rules * BAD] + [BAD] * rules)
    model = Model(shares, guess)
    for _ in range(rounds):
        weight = classes(seen, model) * counts[:, None]
        vote = np.einsum("pc,prv->rcv", weight, seen) + strength * counts.sum() * guess
        vote /= vote.sum(axis=-1, keepdims=True)
        share = weight.sum(axis=0) + PRIOR * counts.sum() * shares
        moved = np.abs(vote - model.vote).max()
        model = Model(share / share.sum(), vote)
        if moved < 1e-9:
            break
    return model


def classes(seen: np.ndarray, model: Model) -> np.ndarray:
    """The probability of each class of each pattern."""
    logs = np.einsum("prv,rcv->pc", seen, np.log(model.vote)) + np.log(model.share)
    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id, statistics, ``base_failed``, ``posterior`` and ``kept``."""
    rules = votes()
    voted = cut(measured(docs, id_col, text).withColumns(rules))
    counted = voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).orderBy(*rules).collect()  # 3 ** rules at most
    patterns = np.array([tuple(r)[:-1] for r in counted], int).reshape(-1, len(rules))
    counts = np.array([r.n for r in counted], float)
    good: list[float] = []
    if counted:
        good = classes(as_seen(patterns), estimate(patterns, counts))[:, 0].tolist()
    # the table of patterns is as bounded as their number
    known = {"".join(map(str, p)): g for p, g in zip(patterns.tolist(), good, strict=True)}
    pairs = [x for k, g in known.items() for x in (F.lit(k), F.lit(g))]
    pattern = F.concat(*[F.col(r).cast("string") for r in rules])
    posterior_good = F.element_at(F.create_map(*pairs), pattern) if pairs else F.lit(0.0)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        posterior_good.alias("posterior"),
        (~failed & (posterior_good >= 0.5)).alias("kept"),
    )
