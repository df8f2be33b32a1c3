"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.llm.tokens import TOKENIZER_PATH, counted
from skarn.plans.stage import write_stage

#: A record's draw is a hash of so many bits; the fraction of a source is cut within it, so many bits at a time.
DRAW_BITS, STEP_BITS = 24, 8


@dataclass(frozen=True)
class SourcePlan:
    """What is taken from one source: ``whole`` uses of each record, and one more of the records drawn below ``cut``."""

    source: str
    target_share: float
    max_repeats: int
    source_tokens: int
    planned_tokens: float
    whole: int
    cut: int


def water_fill(weights: dict[str, float], limits: dict[str, float], total: float) -> dict[str, float]:
    """Split ``total`` by weight; sources over their limit are clamped to it and their excess goes to the others in
    proportion to their weights, until none is over. If all are clamped, less than ``total`` is reached. Negative or
    zero weights get nothing.
    """
    filled: dict[str, float] = {s: 0.0 for s in weights}
    open_, left = {s for s, w in weights.items() if w > 0}, float(total)
    while open_:
        weight = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / weight >= limits[s]}
        if not over:
            for s in open_:
                filled[s] = left * weights[s] / weight
            break
        for s in over:
            filled[s] = limits[s]
            left -= limits[s]
        open_ -= over
    return filled


def largest_exact_total(weights: dict[str, float], limits: dict[str, float]) -> float:
    """The largest total at which every source with records reaches its weight without passing its limit."""
    usable = {s: w for s, w in weights.items() if w > 0 and limits[s] > 0}
    weight = sum(usable.values())
    return min((limits[s] * weight / w for s, w in usable.items()), default=0.0)


def _part_sums(records: DataFrame, prefixes: dict[str, int], bits: int) -> dict[str, list[int]]:
    """For each source, the tokens in each of the parts of the draws that begin with its prefix of ``bits`` bits. At most 2^STEP_BITS numbers for each source come to the driver."""
    at = records.sparkSession.createDataFrame(list(prefixes.items()), "source string, prefix long")
    shift = DRAW_BITS - bits - STEP_BITS
    inside = records.join(F.broadcast(at), "source").where(F.shiftright("draw", shift + STEP_BITS) == F.col("prefix"))
    part = F.shiftright("draw", shift).bitwiseAND(F.lit((1 << STEP_BITS) - 1))
    sums = {s: [0] * (1 << STEP_BITS) for s in prefixes}
    for source, i, n in inside.groupBy("source", part.alias("part")).agg(F.sum("n_tokens")).collect():
        sums[source][i] = n
    return sums


def plan_mix(records: DataFrame, targets: list[tuple[str, float, int]], total_tokens: float | None = None, of_available: float | None = None) -> list[SourcePlan]:
    """Plan the uses for a total: given in tokens, or as a multiple of what the sources have, or the largest exact one. ``records`` has (source, draw, n_tokens), one small row per source ``targets``.

    The fraction of a source is the records drawn first, up to the wanted number of tokens: the cut is narrowed by sums
    of ever smaller parts of the draws.
    """
    if not targets:
        return []
    wanted = records.where(F.col("source").isin([t[0] for t in targets]))
    sums = _part_sums(wanted, {t[0]: 0 for t in targets}, 0)
    weights, tokens = {t[0]: float(t[1]) for t in targets}, {s: sum(p) for s, p in sums.items()}
    limits = {t[0]: float(tokens[t[0]] * max(0, t[2])) for t in targets}
    total = total_tokens if total_tokens is not None else of_available * sum(tokens.values()) if of_available is not None else largest_exact_total(weights, limits)
    filled = water_fill(weights, limits, total)
    whole, rest, cut = {}, {}, {}
    for source, _, repeats in targets:
        uses, more = divmod(filled[source], tokens[source]) if tokens[source] else (0, 0.0)
        whole[source], rest[source] = (max(0, repeats), 0.0) if uses >= repeats else (int(uses), more)
        cut[source] = 0
    open_ = {s for s in rest if rest[s] > 0}
    for bits in range(0, DRAW_BITS, STEP_BITS):
        if bits:
            sums = _part_sums(wanted, {s: cut[s] for s in open_}, bits) if open_ else {}
        for source in sorted(open_):
            part = 0
            while part < (1 << STEP_BITS) - 1 and sums[source][part] <= rest[source]:
                rest[source] -= sums[source][part]
                part += 1
            cut[source] = cut[source] << STEP_BITS | part
            if bits + STEP_BITS == DRAW_BITS and sums[source][part] / 2 <= rest[source]:
                cut[source] += 1
    return [SourcePlan(s, float(share), int(repeats), tokens[s], filled[s], whole[s], cut[s]) for s, share, repeats in targets]


def mixed(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, of_available: float | None = None, seed: int = 7, tokenizer: str = TOKENIZER_PATH) -> tuple[DataFrame, DataFrame]:
    """The uses of each record, and the shares reached.

    ``docs`` has (doc_id, source, text), ``targets`` (source, target_share, max_repeats), one small row per source.
    The total is ``total_tokens``, or ``of_available`` times the tokens of all target sources, or, without either, the
    largest at which all targets can be met; a larger one clamps sources at their most repeats. Records are drawn by a hash of seed and doc_id, so a run can be repeated. Returns
    (doc_id, source, n_tokens, uses), with a row for each record of a target source, and one row per target
    source: (source, target_share, max_repeats, source_tokens, used_tokens, actual_share, epochs). Records without a
    source in targets are left out; sources without records get a share of 0; null texts have no tokens.
    """
    spark = docs.sparkSession
    limits = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").collect()}
    rows = sorted((s, *v) for s, v in limits.items())
    named = docs.where(F.col("source").isin([r[0] for r in rows]))
    tokens = write_stage(counted(named, ["doc_id", "source"], "text", tokenizer).withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << DRAW_BITS)).cast("long")), "tokens")
    plans = plan_mix(tokens, rows, total_tokens, of_available)
    table = spark.createDataFrame([(p.source, p.target_share, p.max_repeats, p.source_tokens, p.whole, p.cut) for p in plans], "source string, target_share double, max_repeats int, source_tokens long, whole int, cut int")
    uses = tokens.join(F.broadcast(table.select("source", "whole", "cut")), "source").select("doc_id", "source", "n_tokens", (F.col("whole") + (F.col("draw") < F.col("cut")).cast("int")).alias("uses"))
    sums = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"))
    # one row per target source
    total = F.sum("used_tokens").over(Window.partitionBy())
    shares = table.join(sums, "source", "left").select(
        "source", "target_share", "max_repeats", "source_tokens",
        F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.when(total > 0, F.coalesce("used_tokens", F.lit(0)) / total).otherwise(0.0).alias("actual_share"),
        F.when(F.col("source_tokens") > 0, F.coalesce("used_tokens", F.lit(0)) / F.col("source_tokens")).otherwise(0.0).alias("epochs"),
    )
    return uses, shares
