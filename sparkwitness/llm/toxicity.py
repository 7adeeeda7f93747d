"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes by lexicons; insults are given words and roots learned from labelled
rows.  Five small transducers read a clause's classes: insult, threat, target, negation and reported
speech.  Their composition turns a clause into one matched pattern (a plain, targeted, negated or
reported insult, or a threat), and a document's score is a logistic sum of the patterns' weights, so a
word alone decides nothing.  The lexicon is counted in Spark; weights are fitted on the same bounded sample.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, filter_texts, held_out, labelled_sample, map_texts, slices, stored

by_value(__name__)

#: Labelled rows from which roots and weights are learned.
SAMPLE = 8192

# Seed lexicons, lower case.
INSULTS = frozenset("idiot idiots moron morons stupid dumb trash garbage scum loser losers pathetic worthless disgusting clown clowns vermin".split())
THREATS = frozenset("kill hurt destroy burn beat shoot stab hang smash töten tuer matar".split())
MODALS = frozenset("will gonna shall must should werde vais voy".split())
TARGETS = frozenset("you your you're youre u they them she he these those people du ihr vous toi tu ustedes".split())
NEGATIONS = frozenset("not never no isn't isnt aren't arent don't dont nicht kein keine nie ne pas jamais nunca sin".split())
REPORTS = frozenset("said says say called calls quoted wrote claimed reported sagte schrieb dit écrit dijo escribió".split())

CLAUSE = re.compile(r"[.!?;:\n]+(?:\s|$)|\n")
STEMS = (4, 5, 6, 7)
EDGE = " \t\r\n\v\f.,;:!?\"'()[]{}<>|*#%&$~`“”„«»–—-_/\\"
PATTERNS = ("insult", "targeted", "negated", "reported", "threat", "distinct", "density")


def class_of(word: str, roots: dict[str, float]) -> tuple[str, float]:
    """A letter (Insult, Hurt, Modal, Target, Negation, Report, or empty) and the weight of an insult."""
    w = word.strip(EDGE)
    if not w:
        return "", 0.0
    if w in INSULTS:
        return "I", 1.0
    weight = max([roots.get(w, 0.0), *[roots.get(w[:n] + "~", 0.0) for n in STEMS if len(w) > n]])
    if weight:
        return "I", weight
    for letter, words in (("H", THREATS), ("M", MODALS), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)):
        if w in words:
            return letter, 0.0
    return "", 0.0


# Transducers: state -> letter -> (next state, output).  A missing letter keeps the state and writes nothing.
#: Negation reaches an insult at most three words on; reported speech reaches to the clause's end.
NEGATION = {0: {"N": (3, "")}, 3: {"I": (0, "-"), "N": (3, ""), "*": (2, "")}, 2: {"I": (0, "-"), "N": (3, ""), "*": (1, "")}, 1: {"I": (0, "-"), "N": (3, ""), "*": (0, "")}}
REPORTED = {0: {"R": (1, "")}, 1: {"I": (1, "r"), "H": (1, "r")}}
TARGETED = {0: {"T": (4, "")}, **{k: {"I": (0, "t"), "T": (4, ""), "*": (k - 1, "")} for k in range(1, 5)}}
THREAT = {0: {"M": (3, ""), "T": (0, "")}, **{k: {"H": (5, ""), "M": (3, ""), "*": (k - 1, "")} for k in range(1, 4)}, 5: {"T": (0, "x"), "M": (3, ""), "*": (6, "")}, 6: {"T": (0, "x"), "*": (0, "")}}
INSULT = {0: {"I": (0, "i")}}
CHAIN = (INSULT, NEGATION, REPORTED, TARGETED, THREAT)


def clause_counts(classes: list[tuple[str, float]]) -> dict[str, float]:
    """Run the composed transducers over one clause; each insult gives its weight to one pattern."""
    state, out = [0] * len(CHAIN), {"insult": 0.0, "targeted": 0.0, "negated": 0.0, "reported": 0.0, "threat": 0.0}
    for letter, weight in classes:
        written = ""
        for i, machine in enumerate(CHAIN):
            arcs = machine[state[i]]
            arc = arcs.get(letter or "*", arcs.get("*"))
            if arc is not None:
                state[i] = arc[0]
                written += arc[1]
        if "i" in written:
            name = "negated" if "-" in written else "reported" if "r" in written else "targeted" if "t" in written else "insult"
            out[name] += weight
        if "x" in written:
            out["threat"] += 1.0
    return out


@dataclass
class Grammar:
    """Learned roots (whole words, or stems marked ``~``) with weights, and weights of ``PATTERNS`` with an intercept."""

    roots: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (4.5, 5.0, 1.0, 1.5, 3.0, 1.0, 0.0)
    intercept: float = -2.5
    cache: dict = field(default_factory=dict, repr=False)

    def features(self, text: str) -> list[float]:
        """Pattern weights of the whole text, as log(1 + sum)."""
        if len(self.cache) > 200_000:
            self.cache.clear()
        low, cache = text.lower(), self.cache
        words = low.split()
        found = False
        for w in set(words):
            known = cache.get(w)
            if known is None:
                known = cache[w] = class_of(w, self.roots)
            found = found or known[0] in ("I", "H")
        if not found:
            return [0.0] * len(PATTERNS)
        total = dict.fromkeys(PATTERNS[:5], 0.0)
        kinds: dict[str, float] = {}
        for clause in CLAUSE.split(low):
            classes = []
            for w in clause.split():
                known = cache.get(w)
                if known is None:
                    known = cache[w] = class_of(w, self.roots)
                if known[0] == "I":
                    kinds[w.strip(EDGE)] = known[1]
                classes.append(known)
            if any(letter in ("I", "H") for letter, _ in classes):
                for k, n in clause_counts(classes).items():
                    total[k] += n
        matched = sum(total.values())
        return [float(np.log1p(total[k])) for k in PATTERNS[:5]] + [float(np.log1p(sum(kinds.values()))), min(1.0, 20.0 * matched / max(len(words), 1))]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights) + self.intercept, -30, 30)))


def learn_roots(sample: DataFrame, least: int = 3, evidence: float = 24.0, purity: float = 0.6, most: int = 4096) -> dict[str, float]:
    """Words and stems that stand in toxic rows of (text, label) much more than in others, with weights up to 1.

    Different words of one stem in a row are evidence of their own, up to three.  Counts are added up per task, then
    in Spark; ``most`` bounds the lexicon, best evidence first.
    """

    def tally(batches):
        import pyarrow as pa

        counts: dict[str, list[int]] = {}
        for batch in slices(batches):
            for text, label in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = {w for w in (x.strip(EDGE) for x in text.lower().split()) if w}
                own: dict[str, int] = dict.fromkeys(words, 1)
                for w in words:
                    for n in STEMS:
                        if len(w) > n:
                            stem = w[:n] + "~"
                            own[stem] = min(3, own.get(stem, 0) + 1)
                for term, n in own.items():
                    c = counts.setdefault(term, [0, 0, 0])
                    c[0] += n * label
                    c[1] += n
                    c[2] += label
        terms = list(counts)
        for i in range(0, len(terms), 50_000):
            part = terms[i:i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), *[pa.array([counts[t][k] for t in part], type=pa.int64()) for k in range(3)]], names=["term", "a", "n", "rows"])

    size = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("a")).first()
    if not size["a"] or size["a"] == size["n"]:
        return {}
    base = size["a"] / size["n"]
    counts = (
        sample.select("text", F.col("label").cast("long")).mapInArrow(tally, "term string, a bigint, n bigint, rows bigint")
        .groupBy("term").agg(F.sum("a").alias("a"), F.sum("n").alias("n"), F.sum("rows").alias("rows")).where(F.col("rows") >= least)
    )
    share = F.col("a") / F.col("n")
    part = lambda x, p, q: F.when(x > 0, x * F.log(p / q)).otherwise(0.0)
    gain = 2 * (part(F.col("a"), share, F.lit(base)) + part(F.col("n") - F.col("a"), 1 - share, F.lit(1 - base)))
    best = counts.where((share >= purity) & (gain >= evidence)).orderBy(gain.desc(), "term").limit(most).collect()
    odds = lambda a, n: float(np.log((a + 0.5) / (n - a + 0.5)))
    return {r["term"]: min(1.0, max(0.1, (odds(r["a"], r["n"]) - odds(size["a"], size["n"])) / 6)) for r in best}


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Grammar:
    """Roots and pattern weights from at most ``sample`` labelled rows outside the held-out fold."""
    rows = stored(labelled_sample(documents, labels, label, sample), "toxicity-sample")
    grammar = Grammar(roots=learn_roots(rows))
    found = features(rows, grammar, keep=("label",)).orderBy("doc_id").toPandas()
    x, y = found[list(PATTERNS)].to_numpy(dtype=float), found["label"].to_numpy(dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return grammar
    # Logistic fit by projected gradient steps, drawn towards the given weights; a pattern can only speak for toxicity.
    design = np.hstack([x, np.ones((len(y), 1))])
    given = np.append(np.array(grammar.weights), grammar.intercept)
    ridge, beta, ahead, t = 0.05 / len(y), given.copy(), given.copy(), 1.0
    lipschitz = 0.25 * np.linalg.norm(design, 2) ** 2 / len(y) + ridge
    for _ in range(5000):
        p = 1 / (1 + np.exp(-np.clip(design @ ahead, -30, 30)))
        new = ahead - (design.T @ (p - y) / len(y) + ridge * (ahead - given)) / lipschitz
        new[:-1] = np.maximum(new[:-1], 0.0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, beta, t = new + (t - 1) / nt * (new - beta), new, nt
    return Grammar(grammar.roots, tuple(float(v) for v in beta[:-1]), float(beta[-1]))


def features(documents: DataFrame, grammar: Grammar, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, score, one column per pattern) of whole texts; null text counts as empty."""
    def compute(texts):
        x = np.array([grammar.features(t) for t in texts], dtype=float).reshape(len(texts), len(PATTERNS))
        return [grammar.score(x), *[x[:, i] for i in range(len(PATTERNS))]]

    return map_texts(documents, "text", ["doc_id", *keep], compute, ", ".join(["score double", *[f"{p} double" for p in PATTERNS]]))


def classify(documents: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    return features(documents, grammar).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def clean(documents: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """The rows of ``documents`` below the threshold, with all their columns, in one pass."""
    def accept(texts):
        x = np.array([grammar.features(t) for t in texts], dtype=float).reshape(len(texts), len(PATTERNS))
        return grammar.score(x) < threshold

    return filter_texts(documents, "text", accept)
