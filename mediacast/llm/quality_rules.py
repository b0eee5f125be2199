"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Spark column expressions.

Statistics of every text are built-in column functions. On a bounded labelled sample small regression trees are boosted; every
path of a tree is a conjunction of thresholds, a rule. A lasso logistic fit keeps few rules and gives them weights. The score is
a plain column: the logistic of the sum of the weights of the rules that hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacast.llm.language import held_out
from mediacast.session import stage

#: Bound of the training sample, by the smallest hashes of the keys.
SAMPLE_ROWS = 20_000
TREES = 24
DEPTH = 3
LEAST_LEAF = 20
STEP = 0.3
PENALTY = 0.001
ROUNDS = 400
ACCEPTED = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a text; all are 0 for null and empty texts."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    words = F.filter(F.split(t, r"[\s]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    def of_class(pattern: str) -> Column:
        return share(F.regexp_count(t, F.lit(pattern)), chars)

    return {
        "n_chars": chars.cast("double"),
        "n_words": F.size(words).cast("double"),
        "word_length": share(chars, F.size(words)),
        "upper_share": of_class("[A-Z]"),
        "digit_share": of_class("[0-9]"),
        "symbol_share": of_class(r"[#$%&*@<>{}|~^=+_/\\!?]"),
        "stop_share": of_class("[.,;:]"),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
    }


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    limit: float


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class RuleEnsemble:
    features: tuple[str, ...]
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    base: float

    def score(self) -> Column:
        """The score as a column over the statistics."""
        total = F.lit(float(self.base))
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for c in rule:
                value = F.col(self.features[c.feature])
                holds = holds & (value > c.limit if c.above else value <= c.limit)
            total = total + F.when(holds, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= (x[:, c.feature] > c.limit) == c.above
    return out


def _grow(x: np.ndarray, target: np.ndarray, limits: list[np.ndarray], path: Rule, rules: list[Rule], fit: np.ndarray, rows: np.ndarray) -> None:
    """Split by the largest drop of squared error; add the path of every node below the root to the rules."""
    if path:
        rules.append(path)
    fit[rows] = target[rows].mean() if len(rows) else 0.0
    if len(path) == DEPTH or len(rows) < 2 * LEAST_LEAF:
        return
    y, best = target[rows], (1e-9, None)
    for feature, cuts in enumerate(limits):
        if not len(cuts):
            continue
        bins = np.searchsorted(cuts, x[rows, feature], "left")  # bin b: above cuts[b - 1], not above cuts[b]
        counts = np.bincount(bins, minlength=len(cuts) + 1)[:-1].cumsum()
        sums = np.bincount(bins, y, len(cuts) + 1)[:-1].cumsum()
        rest = len(rows) - counts
        ok = (counts >= LEAST_LEAF) & (rest >= LEAST_LEAF)
        gain = np.where(ok, sums**2 / np.maximum(counts, 1) + (y.sum() - sums) ** 2 / np.maximum(rest, 1) - y.sum() ** 2 / len(rows), -1)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], Condition(feature, True, float(cuts[i])))
    if best[1] is None:
        return
    above = x[rows, best[1].feature] > best[1].limit
    for side in (True, False):
        condition = Condition(best[1].feature, side, best[1].limit)
        _grow(x, target, limits, (*path, condition), rules, fit, rows[above == side])


def fit_rules(features: tuple[str, ...], x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """Boosted trees to rules, rules to a lasso logistic fit. One class only or no rows give a constant score."""
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return RuleEnsemble(features, (), (), base)
    random = np.random.default_rng(11)
    limits = [np.unique(np.quantile(x[:, i], np.linspace(0.02, 0.98, 40))) for i in range(x.shape[1])]
    raw, rules = np.full(len(y), base), []
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-raw))
        some = np.flatnonzero(random.random(len(y)) < 0.6)
        chosen = random.random(len(limits)) < 0.7
        fit = np.zeros(len(y))
        paths: list[Rule] = []
        _grow(x, residual, [c if k else c[:0] for c, k in zip(limits, chosen)], (), paths, fit, some)
        rules.extend(paths)
        leaves = [p for p in paths if not any(len(q) > len(p) and q[: len(p)] == p for q in paths)]
        for leaf in leaves:
            inside = holds(leaf, x)
            within = inside[some]
            if within.any():
                p = 1 / (1 + np.exp(-raw[some][within]))
                raw[inside] += STEP * residual[some][within].sum() / max((p * (1 - p)).sum(), 1e-3)
        raw = np.clip(raw, -8, 8)
    rules = list(dict.fromkeys(rules))
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    kept = np.flatnonzero((z.mean(axis=0) > 0.002) & (z.mean(axis=0) < 0.998))
    z = z[:, kept]
    weights, intercept = _lasso(z, y, base)
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleEnsemble(features, tuple(rules[kept[i]] for i in used), tuple(float(weights[i]) for i in used), float(intercept))


def _lasso(z: np.ndarray, y: np.ndarray, base: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the logistic loss with an absolute penalty on the weights, none on the constant."""
    n, k = z.shape
    if not k:
        return np.zeros(0), base
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    w, b = np.zeros(k), base
    ahead, ahead_b, pace = w, b, 1.0
    for _ in range(ROUNDS):
        error = 1 / (1 + np.exp(-(z @ ahead + ahead_b))) - y
        moved = ahead - step * (z.T @ error) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        new_b = ahead_b - step * error.mean()
        next_pace = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead, ahead_b = new + (pace - 1) / next_pace * (new - w), new_b + (pace - 1) / next_pace * (new_b - b)
        w, b, pace = new, new_b, next_pace
    return w, b


def learned(measured: DataFrame, labels: DataFrame, features: tuple[str, ...], key: str, label: str) -> RuleEnsemble:
    """Fit on at most ``SAMPLE_ROWS`` labelled rows that are not held out."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(key) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(label).alias("label"))
    rows = measured.join(known, "id").orderBy(F.xxhash64("id"), "label").limit(SAMPLE_ROWS)
    table = rows.select("label", *features).toArrow()
    x = np.stack([table.column(f).to_numpy().astype(np.float64) for f in features], axis=1)
    return fit_rules(features, x, table.column("label").to_numpy().astype(np.float64))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``(key, held_out, score, predicted)`` for every row, learned from the labelled rows that are not held out.

    Null and empty texts have statistics of 0 and are scored like others. Labels that are null or neither 0 nor 1 are not
    learned. Without labels the score is one half. Repeated rows are scored alike; other columns are not read.
    """
    columns = statistics(F.col(text))
    features = tuple(columns)
    measured = stage(docs.select(F.col(key).alias("id"), *[c.alias(name) for name, c in columns.items()]), "statistics")
    model = learned(measured, labels, features, key, label)
    scored = measured.select(F.col("id").alias(key), model.score().alias("score"))
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))
