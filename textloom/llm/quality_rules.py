"""Quality rules: a learned decision list over document statistics, applied as one Spark conditional expression.

Sequential covering. A rule for label 0 starts empty and grows the threshold condition with the best information gain
(FOIL) until it covers no document of label 1 or nothing helps, then drops conditions, whichever is missed least, as long as
that doesn't lower its value on a part of the rows kept for pruning. It is accepted if it stays right there; what it covers leaves the
rows, and the next rule starts. Texts that no rule covers are kept.

The rows to learn from are a bounded sample (``SAMPLE_ROWS``) outside a held-out fold; statistics and verdicts cover
every whole text. Null texts are empty: base_failed, as any text of fewer than ten words. Without labels there are no
rules and the base checks alone decide. Other columns of the input, whatever their names, don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats

SAMPLE_ROWS, FOLDS = 20_000, 5
CUTS, MOST_RULES, MOST_CONDITIONS, LEAST_COVER, LEAST_PRECISION = 64, 24, 4, 5, 0.95
MIN_WORDS, MOST_REPEATED = 10, 20


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def mask(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(stats.FEATURES).index(self.feature)]
        return v > self.cut if self.above else v <= self.cut

    def column(self, columns: dict[str, Column]) -> Column:
        return columns[self.feature] > F.lit(self.cut) if self.above else columns[self.feature] <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.mask(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    names = list(stats.FEATURES)
    while len(rule) < MOST_CONDITIONS:
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p or not n:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        xi, bi = x[inside], bad[inside]
        for f, name in enumerate(names):
            v = xi[:, f]
            cuts = np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, CUTS)), np.quantile(v[bi], np.linspace(0, 1, 16))]))
            pos, neg = np.sort(v[bi]), np.sort(v[~bi])
            low_p, low_n = np.searchsorted(pos, cuts, "right"), np.searchsorted(neg, cuts, "right")
            for above, kp, kn in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(kp > 0, kp * (np.log2(kp / (kp + kn)) - before), -1)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], Condition(name, above, float(cuts[i])))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].mask(x)
    return rule


def learn(x: np.ndarray, label: np.ndarray) -> list[Rule]:
    """Ordered rules that reject; x: features, label: 0 for documents to reject."""
    bad = label == 0
    prune = np.arange(len(x)) % 3 == 0
    left, rules = np.ones(len(x), bool), []

    def value(rule: Rule) -> tuple[float, int, int]:
        c = _covers(rule, x) & left & prune
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0, p, n

    while len(rules) < MOST_RULES and (bad & left & ~prune).sum() >= LEAST_COVER:
        use = left & ~prune
        rule = _grow(x[use], bad[use])
        while len(rule) > 1:
            shorter = max((rule[:i] + rule[i + 1 :] for i in range(len(rule) - 1, -1, -1)), key=lambda r: value(r)[0])
            if value(shorter)[0] < value(rule)[0]:
                break
            rule = shorter
        _, p, n = value(rule)
        whole = _covers(rule, x) & left
        if not rule or p + n == 0 or p / (p + n) < LEAST_PRECISION or (whole & bad).sum() < LEAST_COVER:
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: false where a rule rejects, else true."""
    columns = stats.feature_columns()
    out = F.lit(True)
    for rule in reversed(rules):
        test = rule[0].column(columns)
        for c in rule[1:]:
            test = test & c.column(columns)
        out = F.when(test, F.lit(False)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", ids: str = "doc_id", label: str = "quality") -> list[Rule]:
    counts, y = stats.labelled_sample(docs, labels, text, ids, label, SAMPLE_ROWS, FOLDS)
    return learn(stats.features(counts), y) if len(y) else []


def apply_rules(docs: DataFrame, rules: list[Rule], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, the counts, base_failed and kept."""
    counted = stats.with_counts(docs, text, keep or ["doc_id"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
