"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditional expressions.

Rules are conjunctions of thresholds on ratios of a text. Each is grown on two thirds of the labelled rows by the gain in
information about the bad class, pruned on the other third, and kept only if it is right there often enough; rows that it
covers go, and the next rule is grown on the rest. The base rule stands first in the list, so rows that it decides are not
learned from. Learning reads a bounded sample of labelled rows (``MAX_LABELLED``, chosen
by hash of the id over the whole label table); the statistics of every row, and the verdicts, are DataFrame expressions.

Defined cases: a null text has no words and fails the base rule; a null id is kept as it is and never labelled; ids that
stand several times in the labels, or in the documents, are learned from once each; without labels, or with one class only, the list is empty and the base
rule alone decides; an empty table gives an empty result; further columns pass through ``apply_rules``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import RATIOS, with_stats

#: About so many labelled rows are learned from, and never more than twice that.
MAX_LABELLED = 12_000


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _thresholds(rows: list[dict], feature: str, steps: int = 24) -> list[float]:
    """Midpoints between distinct values, at most about ``steps`` by rank."""
    values = sorted({r[feature] for r in rows})
    if len(values) < 2:
        return []
    picks = range(len(values) - 1) if len(values) <= steps else sorted({round(k * (len(values) - 2) / steps) for k in range(steps + 1)})
    return [(values[k] + values[k + 1]) / 2 for k in picks]


def _grow(rows: list[dict], features: tuple[str, ...], longest: int) -> Rule | None:
    chosen: list[Condition] = []
    inside = rows
    while len(chosen) < longest:
        bad, good = sum(r["bad"] for r in inside), sum(not r["bad"] for r in inside)
        if not good or not bad:
            break
        base, best = math.log2(bad / (bad + good)), (0.0, None)
        for f in features:
            by_value = sorted(((r[f], r["bad"]) for r in inside))
            total, k, p = len(by_value), 0, 0
            for t in _thresholds(inside, f):
                while k < total and by_value[k][0] <= t:
                    p += by_value[k][1]
                    k += 1
                for above, hit, n in ((False, p, k), (True, bad - p, total - k)):
                    if hit and hit * (math.log2(hit / n) - base) > best[0]:
                        best = (hit * (math.log2(hit / n) - base), Condition(f, above, t))
        if best[1] is None:
            break
        chosen.append(best[1])
        inside = [r for r in inside if best[1].holds(r)]
    return Rule(tuple(chosen)) if chosen else None


def _prune(rule: Rule, rows: list[dict]) -> tuple[Rule, float, int]:
    """The head of the rule that does best on rows that it was not grown on; its precision and hits."""
    best = (-2.0, rule, 0.0, 0)
    for n in range(len(rule.conditions), 0, -1):
        head = Rule(rule.conditions[:n])
        hit = [r["bad"] for r in rows if head.holds(r)]
        if hit and (worth := (2 * sum(hit) - len(hit)) / len(hit)) > best[0]:
            best = (worth, head, sum(hit) / len(hit), sum(hit))
    return best[1:]


def learn(rows: list[dict], features: tuple[str, ...] = RATIOS, most_rules: int = 12, longest: int = 3, precision: float = 0.97, support: int = 5) -> list[Rule]:
    """Rules that find rows with ``bad`` true, in order. ``rows``: features, bad, prune (true: not used for growing)."""
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < most_rules:
        rule = _grow([r for r in left if not r["prune"]], features, longest)
        if rule is None:
            break
        rule, right, hits = _prune(rule, [r for r in left if r["prune"]])
        if right < precision or hits < support:
            break
        rules.append(rule)
        left = [r for r in left if not rule.holds(r)]
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", where: Column | None = None) -> DataFrame:
    """Id, text and ``_label`` of documents with a label, one of each id, about ``most`` of them by hash of the id; never more than twice ``most``."""
    known = labels.select(F.col("doc_id").alias("_lid"), F.col(label_col).cast("int").alias("_label")).where("_lid is not null and _label in (0, 1)")
    known = known.where(where) if where is not None else known
    share = most / max(1, known.count())
    cut = int((min(1.0, share) - 0.5) * 2**64)
    picked = known.where(F.xxhash64("_lid") <= F.lit(min(cut, 2**63 - 1))).groupBy("_lid").agg(F.max("_label").alias("_label")).limit(2 * most)
    found = docs.join(F.broadcast(picked), F.col(id_col) == F.col("_lid"))
    # Of rows that repeat an id, the one with the least hash of its text is learned from: as many rows as ids reach the driver.
    key = F.struct(F.xxhash64(text_col).alias("_h"), *[F.col(c) for c in (id_col, text_col, "_label")])
    return found.groupBy("_lid").agg(F.min(key).alias("_k")).select(*[F.col(f"_k.{c}").alias(c) for c in (id_col, text_col, "_label")])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> list[Rule]:
    known = labelled_sample(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, most)
    keyed = known.select(F.struct("doc_id", "_label").alias("key"), "text")
    stats = with_stats(keyed, "key").select(F.col("doc_id")["doc_id"].alias("id"), F.col("doc_id")["_label"].alias("label"), base_failed().alias("failed"), *RATIOS)
    found = [r for r in stats.collect() if not r["failed"]]
    rows = [{f: float(r[f]) for f in RATIOS} | {"bad": r["label"] == 0, "prune": r["id"] % 3 == 0} for r in sorted(found, key=lambda r: (r["id"], r["label"]))]
    return learn(rows)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, number of the rule that decided: 0 the base rule, null none) as one ordered conditional expression each."""
    number = F.when(base_failed(), F.lit(0))
    for k, rule in enumerate(rules, 1):
        number = number.when(rule.column(), F.lit(k))
    return number.isNull(), number


def judged(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the statistics, base_failed, kept and the deciding rule."""
    kept, number = verdict(rules)
    return with_stats(docs, id_col, text_col).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"), number.alias("rule"))


def apply_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Rows carry themselves as the key: no join is needed."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    # A projection that is not deterministic keeps the filter above it; pushed below, it would repeat the statistics for each mention.
    told = with_stats(rows, "_row", "_text").select("doc_id", verdict(rules)[0].alias("_kept"), F.spark_partition_id().alias("_at"))
    return told.where("_kept and _at >= 0").select(*[F.col("doc_id")[c].alias(c) for c in names])
