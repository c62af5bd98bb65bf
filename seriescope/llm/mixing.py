"""Mixing sources to target weights by temperature.

The token share of each source is raised to an exponent between 0 (all sources alike) and 1 (as they are) and normalised.
The exponent is found by bisection, so that the entropy of the weights meets a target, or so that no source must be repeated
more than a limit allows; with both, the flatter mix that still keeps the limit's bound is taken. The budget is the least
at which every source gives each of its documents at least once, so nothing is lost.

A source's quota is realised by block permutations: its documents are dealt into blocks, and every pass over the source goes
through the blocks, and through the documents of a block, in an order of its own. Whole passes are taken while the quota lasts;
of the last one the blocks, then the documents of one block, that come first and fit the rest of the quota. A row's place
in its source's sequence, as a share of the source's budget, is its place in the mix (``mix_key``): read in that order, any
stretch of the mix has the sources at their weights.

Only DataFrame operations touch rows. The driver sees one row per source; with more than ``MAX_SOURCES`` of them it sees sums
only, one of each step of the bisection.

Defined cases: a null text is empty and has no tokens; a null source is a source of its own; sources without any token,
and sources that the plan does not name, are passed once; null and repeated ids are rows like any other (a row is known by a
number of its own); ties can't occur in the orders but by chance of a hash, and then the number decides; an empty table gives
an empty result; further columns pass through ``mixed``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialized, text_of, words_of

MAX_SOURCES = 100_000
#: About so many documents of a block; order within a block needs a sort of that block only.
BLOCK_DOCS = 2_000
#: Share of the way from the entropy of the sources as they are to that of equal weights; passes over a source at most.
TARGET, MAX_PASSES = 0.5, 4.0


@dataclass(frozen=True)
class Plan:
    """``passes`` of each source; none where there are too many sources, then they follow from the exponent and the largest source."""

    exponent: float
    weights: dict[str | None, float]
    passes: dict[str | None, float] | None
    largest: int = 0


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log2(w) for w in weights if w > 0)


def tempered(shares: list[float], exponent: float) -> list[float]:
    raised = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(raised)
    return [x / total for x in raised] if total else raised


def bisect(holds, steps: int = 60) -> float:
    """The least exponent in [0, 1] for which ``holds``, which is false below some point and true above; 1 if none is."""
    if holds(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def plan(tokens: dict[str | None, int], target: float = TARGET, max_passes: float = MAX_PASSES) -> Plan:
    """Weights and passes of each source from its tokens."""
    names = sorted((k for k, v in tokens.items() if v > 0), key=lambda k: (k is None, k or ""))
    if not names:
        return Plan(1.0, {}, dict.fromkeys(tokens, 1.0))
    total = sum(tokens[k] for k in names)
    shares = [tokens[k] / total for k in names]
    # Both conditions hold from some exponent on: less entropy and fewer passes come with a steeper mix.
    aim = entropy(shares) + target * (math.log2(len(names)) - entropy(shares))

    def passes(exponent: float) -> list[float]:
        per_share = [w / s for w, s in zip(tempered(shares, exponent), shares)]
        return [x / min(per_share) for x in per_share]

    exponent = max(bisect(lambda a: entropy(tempered(shares, a)) <= aim), bisect(lambda a: max(passes(a)) <= max_passes))
    return Plan(exponent, dict(zip(names, tempered(shares, exponent))), dict.fromkeys(tokens, 1.0) | dict(zip(names, passes(exponent))))


def _sums(docs: DataFrame, source_col: str, text_col: str) -> DataFrame:
    tokens = F.size(words_of(text_of(text_col))).cast("long")
    return docs.select(F.col(source_col).cast("string").alias("source"), tokens.alias("n")).groupBy("source").agg(F.sum("n").alias("n"))


def source_tokens(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> dict[str | None, int]:
    """Tokens of each source, for up to ``MAX_SOURCES`` sources."""
    found = _sums(docs, source_col, text_col).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: use plan_of")
    return {r["source"]: int(r["n"]) for r in found}


def plan_of(docs: DataFrame, target: float = TARGET, max_passes: float = MAX_PASSES, source_col: str = "source", text_col: str = "text") -> Plan:
    """The plan for the sources of ``docs``, however many there are."""
    sums = materialized(_sums(docs, source_col, text_col), "source-tokens")
    n = sums.count()
    if n <= MAX_SOURCES:
        out = plan({r["source"]: int(r["n"]) for r in sums.collect()}, target, max_passes)
    else:
        some = sums.where("n > 0")
        count, total, most, least = some.agg(F.count("*"), F.sum("n"), F.max("n"), F.min("n")).first()

        def bits(exponent: float) -> float:
            """Entropy of the tempered weights: log2 of the sum of powers, less their mean exponent."""
            raised = F.pow(F.col("n") / most, F.lit(exponent))
            z, mean = some.agg(F.sum(raised), F.sum(raised * F.log2(raised))).first()
            return math.log2(z) - mean / z

        if not count:
            out = Plan(1.0, {}, None, 0)
        else:
            now = bits(1.0)
            aim = now + target * (math.log2(count) - now)
            exponent = max(bisect(lambda a: bits(a) <= aim, 40), bisect(lambda a: (least / most) ** (a - 1) <= max_passes))
            out = Plan(exponent, {}, None, int(most))
    discard(sums)
    return out


def _numbered(docs: DataFrame, label: str) -> DataFrame:
    return materialized(docs.withColumn("nr", F.monotonically_increasing_id()), label)


def _schedule(slim: DataFrame, the_plan: Plan) -> DataFrame:
    """nr, source, tokens, epoch, epochs, block and mix_key of the rows (nr, source, tokens), each as often as it is passed."""
    spark = slim.sparkSession
    # What stands in these tables once for each source is broadcast if the number of sources is bounded.
    hinted = F.broadcast if the_plan.passes is not None else (lambda df: df)
    sizes = slim.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("total"))
    if the_plan.passes is not None:
        wanted = spark.createDataFrame([(k, float(p)) for k, p in the_plan.passes.items()], "name string, passes double")
        planned = sizes.join(hinted(wanted), F.col("source").eqNullSafe(F.col("name")), "left").withColumn("passes", F.coalesce("passes", F.lit(1.0)))
    else:
        planned = sizes.withColumn("passes", F.when(F.col("total") > 0, F.pow(F.col("total") / the_plan.largest, F.lit(the_plan.exponent - 1))).otherwise(1.0))
    whole = F.floor(F.col("passes") + 1e-9)
    rest = F.greatest(F.floor((F.col("passes") - whole) * F.col("total") + F.lit(1e-6)), F.lit(0)).cast("long")
    quota = planned.select(F.col("source").alias("name"), F.ceil(F.col("docs") / BLOCK_DOCS).alias("blocks"), whole.cast("int").alias("whole"), rest.alias("rest"), "total")
    quota = materialized(quota, "quotas")
    dealt = slim.join(hinted(quota), F.col("source").eqNullSafe(F.col("name"))).withColumn("block", F.pmod(F.xxhash64("nr", F.lit("block")), "blocks"))
    passes = F.col("whole") + F.when(F.col("rest") > 0, 1).otherwise(0) - 1
    each = dealt.withColumn("epoch", F.explode(F.sequence(F.lit(0), passes)))
    # The blocks of each pass in the order of that pass, and what stands before them.
    sums = dealt.groupBy("name", "block", "whole", "rest").agg(F.sum("tokens").alias("in_block")).withColumn("epoch", F.explode(F.sequence(F.lit(0), passes)))
    order = Window.partitionBy("name", "epoch").orderBy(F.xxhash64("name", "epoch", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("name").alias("b_name"), F.col("block").alias("b_block"), F.col("epoch").alias("b_epoch"), F.coalesce(F.sum("in_block").over(order), F.lit(0)).alias("before"))
    placed = each.join(before, F.col("name").eqNullSafe(F.col("b_name")) & (F.col("block") == F.col("b_block")) & (F.col("epoch") == F.col("b_epoch")))
    within = Window.partitionBy("name", "block", "epoch").orderBy(F.xxhash64("nr", "epoch"), "nr").rowsBetween(Window.unboundedPreceding, 0)
    told = placed.withColumn("through", F.col("before") + F.sum("tokens").over(within))
    taken = told.where((F.col("epoch") < F.col("whole")) | ((F.col("through") <= F.col("rest")) & (F.col("tokens") > 0)))
    budget = F.greatest(F.col("total") * F.col("whole") + F.col("rest"), F.lit(1))
    key = (F.col("epoch") * F.col("total") + F.col("through") - F.col("tokens")) / budget
    return taken.select("nr", "source", "tokens", "epoch", "block", key.alias("mix_key"))


def schedule(docs: DataFrame, the_plan: Plan, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` and pass: doc_id, source, tokens, epoch (from 0), block, mix_key (order by it; 0 to 1)."""
    tokens = F.size(words_of(text_of(text_col))).cast("long")
    slim = _numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), tokens.alias("tokens")), "mix-rows")
    ids = slim.select(F.col("nr").alias("_nr"), "doc_id")
    made = _schedule(slim.select("nr", "source", "tokens"), the_plan)
    return made.join(ids, F.col("nr") == F.col("_nr")).select("doc_id", "source", "tokens", "epoch", "block", "mix_key")


def mixed(docs: DataFrame, the_plan: Plan, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the plan asks, with all their columns."""
    names = docs.columns
    tokens = F.size(words_of(text_of(text_col))).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(source_col).cast("string").alias("source"), tokens.alias("tokens"))
    rows = _numbered(rows, "mix-documents")
    times = _schedule(rows.select("nr", "source", "tokens"), the_plan).groupBy(F.col("nr").alias("_nr")).agg(F.count("*").cast("int").alias("_times"))
    again = rows.join(times, F.col("nr") == F.col("_nr")).withColumn("_epoch", F.explode(F.sequence(F.lit(1), "_times")))
    return again.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
