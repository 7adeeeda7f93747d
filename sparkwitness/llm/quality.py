"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are computed in Arrow batches.  Boosted trees of small depth are grown on
a bounded sample of labelled rows; every path from a root is a conjunctive rule; a lasso
logistic fit keeps a few of them; and those are compiled into Spark column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, held_out, labelled_sample, map_texts

by_value(__name__)

STATS = (
    "log_chars", "log_words", "word_length", "upper", "digit", "symbol", "pipe", "bang", "stop", "comma", "other_punct",
    "non_ascii", "newline", "distinct_words", "top_word", "short_words", "distinct_lines", "line_words", "capital_words",
)
#: Labelled rows from which the rules are learned.
SAMPLE = 8192


def _stats(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = max(len(raw), 1)
    words = raw.split()
    m = max(len(words), 1)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    at = lambda chars: float(count[list(chars)].sum()) / n
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(map(len, words)) / m,
        float(count[65:91].sum()) / n, float(count[48:58].sum()) / n, at(b"#$%&*@^~_=+<>"), at(b"|"), at(b"!"), at(b"."), at(b","),
        at(b";:?\"'()[]{}/\\-`"), float(count[128:].sum()) / n, at(b"\n"), len(tally) / m,
        max(tally.values(), default=0) / m, sum(1 for w in words if len(w) < 4) / m,
        len(set(lines)) / max(len(lines), 1), min(m / max(len(lines), 1), 1e6), sum(1 for w in words if w[:1].isupper()) / m,
    ]


def statistics(documents: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, one double per statistic); null text counts as empty, whole texts are read."""
    def compute(texts):
        values = np.array([_stats(t) for t in texts], dtype=float).reshape(len(texts), len(STATS))
        return [values[:, i] for i in range(len(STATS))]

    return map_texts(documents, text, [key, *keep], compute, ", ".join(f"s_{s} double" for s in STATS))


@dataclass
class Rules:
    """Conjunctions of (statistic, above?, threshold), their weights, and the intercept."""

    terms: list[list[tuple[str, bool, float]]]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as a column expression over ``s_`` columns."""
        total = F.lit(float(self.intercept))
        for term, weight in zip(self.terms, self.weights, strict=True):
            fits = F.lit(True)
            for name, above, edge in term:
                fits = fits & ((F.col(f"s_{name}") > F.lit(edge)) if above else (F.col(f"s_{name}") <= F.lit(edge)))
            total = total + F.when(fits, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _grow(x: np.ndarray, edges: list[np.ndarray], bins: np.ndarray, residual: np.ndarray, hessian: np.ndarray, depth: int):
    """One boosting tree on binned columns: its paths, and its prediction for every row."""
    paths, out = [], np.zeros(len(residual))
    stack = [(np.arange(len(residual)), [])]
    while stack:
        rows, path = stack.pop()
        g, h = residual[rows], hessian[rows]
        out[rows] = g.sum() / (h.sum() + 1.0)
        if path:
            paths.append(path)
        if len(path) >= depth or len(rows) < 10:
            continue
        best = (1e-6, None, None)
        base = g.sum() ** 2 / (h.sum() + 1.0)
        for j in range(x.shape[1]):
            if not len(edges[j]):
                continue
            k = len(edges[j]) + 1
            gs = np.cumsum(np.bincount(bins[rows, j], weights=g, minlength=k))[:-1]
            hs = np.cumsum(np.bincount(bins[rows, j], weights=h, minlength=k))[:-1]
            gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], j, i)
        if best[1] is None:
            continue
        _, j, i = best
        low = bins[rows, j] <= i
        stack.append((rows[low], [*path, (STATS[j], False, float(edges[j][i]))]))
        stack.append((rows[~low], [*path, (STATS[j], True, float(edges[j][i]))]))
    return paths, out


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, steps: int = 400) -> Rules:
    """Rules from rows of statistics ``x`` and labels ``y`` (0 or 1); a constant score without both labels."""
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else min(max(float(y.mean()), 0.01), 0.99)
        return Rules([], [], float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 34)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
    share = float(y.mean())
    margin = np.full(len(y), np.log(share / (1 - share)))
    terms: dict[tuple, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        paths, step = _grow(x, edges, bins, y - p, p * (1 - p), depth)
        margin += 0.3 * step
        for path in paths:
            terms.setdefault(tuple(sorted(set(path))))
    rules = list(terms)
    column = {name: j for j, name in enumerate(STATS)}
    hit = np.ones((len(y), len(rules)))
    for r, term in enumerate(rules):
        for name, above, edge in term:
            value = x[:, column[name]]
            hit[:, r] *= (value > edge) if above else (value <= edge)
    # Lasso logistic by accelerated proximal gradient; the intercept is not penalised.
    w, b, v, vb, t = np.zeros(len(rules)), np.log(share / (1 - share)), np.zeros(len(rules)), np.log(share / (1 - share)), 1.0
    lipschitz = 0.25 * (np.linalg.norm(hit, 2) ** 2 / len(y) + 1.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(hit @ v + vb, -30, 30)))
        moved = v - hit.T @ (p - y) / len(y) / lipschitz
        new = np.sign(moved) * np.maximum(np.abs(moved) - penalty / lipschitz, 0)
        nb = vb - (p - y).mean() / lipschitz
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    kept = [i for i in range(len(rules)) if w[i] != 0]
    return Rules([list(rules[i]) for i in kept], [float(w[i]) for i in kept], float(b))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Rules:
    """Fit on at most ``sample`` labelled rows; their statistics, not texts, reach the driver."""
    rows = statistics(labelled_sample(documents, labels, label, sample), keep=("label",))
    found = rows.orderBy("doc_id").toPandas()
    return fit_rules(found[[f"s_{s}" for s in STATS]].to_numpy(dtype=float), found["label"].to_numpy(dtype=float))


def classify(documents: DataFrame, rules: Rules, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; empty and null texts get the score of no words."""
    scored = statistics(documents).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), rules.score().alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
