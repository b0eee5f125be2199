"""Budget allocation: best marginal return first, under campaign caps and channel bounds.

The rule is stepwise: give one step to the campaign with the highest marginal return. As returns
diminish, the same picks come out of sorting all steps once, as long as no limit shortens a step. A limit
(the total, or what is left of a channel) does nothing until less than a step is left of it; from then on it shortens the picks
of all campaigns below it that have more room. So the work goes in rounds: sort the picks whose amount is fixed, add
them up over range pieces, and take them up to the first place where a limit falls below a step, runs out, or where a
shortened pick would come first. That place is searched for with many probes at a time, and the shortened pick uses up its
limit. A round switches or ends one limit: rounds are bounded by channels, jobs never follow campaigns or steps, and
neither of these is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacast.contracts import HORIZONS, ContractError
from mediacast.functions.columns import marginal_revenue, response_revenue
from mediacast.session import stage

# Flags that keep a campaign from growing beyond its baseline.
GUARD_FLAGS = ["sparse_recent_history", "budget_extrapolation", "direct_model_category_oov_fallback"]
RELAXED_WEIGHT = 0.55
EPSILON = 1e-6
#: Places of the sorted picks that are looked at in one job.
PROBES = 64


@dataclass(frozen=True)
class AllocationRequest:
    horizon_days: int
    total_budget: float
    target_roas: float | None = None
    channel_minimums: tuple[tuple[str, float], ...] = ()
    channel_maximums: tuple[tuple[str, float], ...] = ()
    max_multiple: float = 2.0
    increments: int = 160

    @property
    def step(self) -> float:
        return max(100.0, round(self.total_budget / max(self.increments, 1) / 100.0) * 100.0)

    def check(self) -> "AllocationRequest":
        if self.horizon_days not in HORIZONS:
            raise ContractError(f"horizon_days must be one of {HORIZONS}")
        if self.total_budget <= 0 or self.max_multiple <= 0:
            raise ContractError("total_budget and max_multiple must be positive")
        low, high = dict(self.channel_minimums), dict(self.channel_maximums)
        if any(v < 0 for v in [*low.values(), *high.values()]):
            raise ContractError("channel bounds cannot be negative")
        if sum(low.values()) > self.total_budget + EPSILON:
            raise ContractError("infeasible: channel minimums exceed the total budget")
        crossed = sorted(c for c, v in low.items() if c in high and v > high[c])
        if crossed:
            raise ContractError(f"infeasible: minimum exceeds maximum for {crossed}")
        return self


@dataclass
class Allocation:
    plan: DataFrame
    target_status: str
    eligible_campaigns: int
    guarded_campaigns: int


def candidates(leaves: DataFrame, max_multiple: float = 2.0) -> DataFrame:
    """Active campaigns with response anchor, cap and nothing allocated yet."""
    guarded = F.coalesce(F.col("quality_flags").rlike("|".join(GUARD_FLAGS)), F.lit(False))
    base = F.greatest("planned_budget", F.lit(1.0))
    return leaves.where(F.col("planned_budget") > 0).select(
        "campaign_key",
        "channel",
        base.alias("base_budget"),
        F.greatest(F.col("predicted_revenue_p50") / base, F.lit(0.0)).alias("base_roas"),
        guarded.alias("guarded"),
        (F.col("planned_budget") * F.when(guarded, 1.0).otherwise(max_multiple)).alias("cap"),
        F.lit(0.0).alias("allocated"),
    )


def scored(rows: DataFrame, current: Column, addition: Column, target: float | None) -> DataFrame:
    """Marginal return of an addition; below the target it only counts in the relaxed phase."""
    base, roas = F.col("base_budget"), F.col("base_roas")
    after = response_revenue(base, roas, current + addition)
    slope = F.greatest(F.lit(0.0), (after - response_revenue(base, roas, current)) / F.greatest(addition, F.lit(1e-9)))
    marginal = F.least(slope, marginal_revenue(base, roas, current))
    if target is None:
        return rows.withColumns({"phase": F.lit(0), "score": marginal})
    met = after / F.greatest(current + addition, F.lit(1e-9)) >= target
    return rows.withColumns(
        {
            "phase": F.when(met, 0).otherwise(1),
            "score": F.when(met, marginal).otherwise(marginal * RELAXED_WEIGHT),
        }
    )


def _amounts(bounds: dict[str, float], missing: Column) -> Column:
    value = missing
    for channel, amount in bounds.items():
        value = F.when(F.col("channel") == channel, F.lit(float(amount))).otherwise(value)
    return value


def full_steps(state: DataFrame, step: float, room: Column, target: float | None) -> DataFrame:
    """Every step a campaign could still take, shortened only by its own cap."""
    count = F.ceil((room - EPSILON) / step).cast("int")
    steps = state.where(room > EPSILON).select(
        "*", F.explode(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).alias("nth")
    )
    start = F.col("allocated") + F.col("nth") * step
    addition = F.least(F.lit(step), F.col("cap") - start)
    return scored(steps.withColumn("addition", addition), start, addition, target)


@dataclass
class _Limits:
    """What is left of the total and of the channels that have a limit."""

    total: float
    channels: dict[str, float]

    def column(self) -> Column:
        return F.least(F.lit(self.total), _amounts(self.channels, F.lit(float("inf"))))

    def all(self) -> list[float]:
        return [self.total, *self.channels.values()]

    def less(self, spent: dict[str, float]) -> "_Limits":
        return _Limits(self.total - sum(spent.values()), {c: v - spent.get(c, 0.0) for c, v in self.channels.items()})


def _room() -> Column:
    return F.col("cap") - F.col("allocated")


def _order() -> list[Column]:
    return [F.col("phase"), F.desc("score"), F.desc("campaign_key"), F.col("nth")]


def _best() -> Column:
    """What makes a pick come first, as a struct whose largest value wins."""
    return F.struct((-F.col("phase")).alias("phase"), F.col("score").alias("score"), F.col("campaign_key").alias("campaign_key"))


def _fixed_picks(rows: DataFrame, limit: Column, step: float, target: float | None) -> DataFrame:
    """Picks that no limit shortens: whole schedules where a step is left, else the rest of campaigns with less room."""
    whole = limit >= step
    steps = rows.where(whole | (_room() < limit)).withColumn("room", F.when(whole, F.least(_room(), limit)).otherwise(_room()))
    return full_steps(steps, step, F.col("room"), target).drop("room")


def _ranked(picks: DataFrame) -> DataFrame:
    """Picks in order with ``rank`` and the inclusive totals ``until`` and ``channel_until``; no task sees more than a range piece."""
    pieces = stage(picks.repartitionByRange(*_order()).withColumn("piece", F.spark_partition_id()), "pieces")
    parts = pieces.groupBy("piece", "channel").agg(F.sum("addition").alias("part"), F.count("*").alias("picks"))
    # one row per piece and channel
    before = Window.partitionBy("channel").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    by_piece = parts.groupBy("piece").agg(F.sum("part").alias("part"), F.sum("picks").alias("picks")).select(
        "piece", F.coalesce(F.sum("part").over(earlier), F.lit(0.0)).alias("offset"), F.coalesce(F.sum("picks").over(earlier), F.lit(0)).alias("ranks")
    )
    by_channel = parts.select("piece", "channel", F.coalesce(F.sum("part").over(before), F.lit(0.0)).alias("channel_offset"))
    inside = Window.partitionBy("piece").orderBy(*_order())
    within = Window.partitionBy("piece", "channel").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        pieces.join(F.broadcast(by_piece), "piece")
        .join(F.broadcast(by_channel), ["piece", "channel"])
        .withColumn("channel_until", F.sum("addition").over(within) + F.col("channel_offset"))
        .withColumn("rank", F.row_number().over(inside) + F.col("ranks"))
        .withColumn("until", F.sum("addition").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("offset"))
    )
    return stage(ranked.drop("piece", "offset", "ranks", "channel_offset"), "ranked")


def _first_below(ranked: DataFrame, limits: _Limits, step: float) -> int | None:
    """Rank of the first pick after which a limit has less than a step left."""
    below = F.lit(limits.total >= step) & (F.lit(limits.total) - F.col("until") < step)
    for channel, left in limits.channels.items():
        if left >= step:
            below |= (F.col("channel") == channel) & (F.lit(left) - F.col("channel_until") < step)
    return ranked.where(below).agg(F.min("rank")).first()[0]


def _overtaken(rest: DataFrame, ranked: DataFrame, limits: _Limits, probes: list[int], target: float | None) -> list[int]:
    """Probes at which a shortened pick comes before the next fixed one, or a limit has run out.

    ``rest`` holds the campaigns of limits below a step, with the rank of their fixed pick if they have one.
    """
    number = F.size(F.filter(F.array(*[F.lit(p) for p in probes]), lambda p: p < F.col("rank")))
    sums = ranked.where(F.col("rank") <= probes[-1]).groupBy(number.alias("probe"), "channel").agg(F.sum("addition").alias("part")).collect()
    left = [limits.less({})] * len(probes)
    for i in range(len(probes)):
        spent: dict[str, float] = {}
        for r in sums:
            if r.probe <= i:
                spent[r.channel] = spent.get(r.channel, 0.0) + r.part
        left[i] = limits.less(spent)
    following = {
        r.rank - 1: (r.best.phase, r.best.score, r.best.campaign_key)
        for r in ranked.where(F.col("rank").isin([p + 1 for p in probes])).select("rank", _best().alias("best")).collect()
    }
    none = F.lit(None).cast("map<string,double>")
    states = [
        F.struct(
            F.lit(p).alias("probe"),
            F.lit(x.total).alias("total"),
            (F.create_map(*[F.lit(y) for pair in x.channels.items() for y in pair]) if x.channels else none).alias("channels"),
        )
        for p, x in zip(probes, left)
    ]
    rows = rest.withColumn("state", F.explode(F.array(*states))).where(F.col("rank").isNull() | (F.col("rank") > F.col("state.probe")))
    limit = F.least("state.total", F.coalesce(F.try_element_at("state.channels", F.col("channel")), F.lit(float("inf"))))
    shortened = rows.withColumn("addition", limit).where((F.col("addition") > EPSILON) & (_room() >= F.col("addition")))
    best = scored(shortened, F.col("allocated"), F.col("addition"), target).groupBy("state.probe").agg(F.max(_best()).alias("best"))
    first = {r.probe: (r.best.phase, r.best.score, r.best.campaign_key) for r in best.collect()}
    out = [p for p, x in zip(probes, left) if min(x.all()) <= EPSILON]
    return sorted({*out, *(p for p in probes if p in first and (p not in following or first[p] >= following[p]))})


def _first_overtaken(rows: DataFrame, ranked: DataFrame, limits: _Limits, limit: Column, step: float, end: int, target: float | None) -> int:
    """The smallest number of fixed picks after which a shortened pick comes first; ``end`` if there is none.

    With every fixed pick the shortened ones get shorter, so better, and the next fixed one gets worse: once true, it stays true.
    """
    wide = rows.where((limit < step) & (_room() >= limit)).withColumn("rank", F.lit(None).cast("long"))
    narrow = ranked.where(limit < step).select(*rows.columns, F.col("rank").cast("long"))
    rest = stage(wide.unionByName(narrow), "rest")
    low, high = 0, end
    while low < high:
        probes = sorted({low + (high - low) * i // PROBES for i in range(PROBES)})
        found = _overtaken(rest, ranked, limits, probes, target)
        if found:
            high = found[0]
            low = max((p + 1 for p in probes if p < high), default=low)
        else:
            low = probes[-1] + 1
    return low


def _pick(rows: DataFrame, limit: Column, step: float, target: float | None) -> object:
    """The single best next pick, shortened by whatever is about to run out."""
    rows = rows.withColumn("addition", F.least(F.lit(step), limit, _room())).where(F.col("addition") > EPSILON)
    best = F.max_by(F.struct("campaign_key", "channel", "addition", "phase"), _best())
    return scored(rows, F.col("allocated"), F.col("addition"), target).agg(best.alias("best")).first().best


def _fill(state: DataFrame, limits: _Limits, step: float, target: float | None) -> tuple[DataFrame, bool]:
    """Give until the limits are used up, and whether a pick below the target was needed.

    With an infinite total the channels' amounts are what is to be given.
    """
    relaxed, bounded = False, limits.total < float("inf")
    while limits.total > EPSILON and (bounded or max(limits.channels.values()) > EPSILON):
        limit = limits.column()
        rows = state.where((limit > EPSILON) & (_room() > EPSILON))
        if not bounded:
            rows = rows.where(F.col("channel").isin(sorted(limits.channels)))
        open_limits = _Limits(limits.total, {c: v for c, v in limits.channels.items() if v > EPSILON})
        ranked = _ranked(_fixed_picks(rows, limit, step, target))
        end = ranked.agg(F.max("rank")).first()[0] or 0
        cut = _first_below(ranked, open_limits, step)
        picks = cut is None
        end = end if picks else cut
        if min(open_limits.all()) < step:
            found = _first_overtaken(rows, ranked, open_limits, limit, step, end, target)
            picks, end = picks or found < end, found
        taken = ranked.where(F.col("rank") <= end)
        sums = taken.groupBy("channel").agg(F.sum("addition").alias("part"), F.max("phase").alias("phase")).collect()
        relaxed = relaxed or any(r.phase for r in sums)
        gained = taken.groupBy("campaign_key").agg(F.sum("addition").alias("gained"))
        state = state.join(gained, "campaign_key", "left").withColumn("allocated", F.col("allocated") + F.coalesce("gained", F.lit(0.0))).drop("gained")
        state = stage(state.select(*rows.columns), "allocation")
        limits = limits.less({r.channel: r.part for r in sums})
        if not picks or min(limits.total, *(limits.channels[c] for c in open_limits.channels), float("inf")) <= EPSILON:
            continue  # a limit changed what it does to the picks below it
        limit = limits.column()
        rows = state.where((limit > EPSILON) & (_room() > EPSILON))
        best = _pick(rows if bounded else rows.where(F.col("channel").isin(sorted(limits.channels))), limit, step, target)
        if best is None:
            what = "total budget exceeds all campaign and channel caps" if bounded else "channel minimum exceeds campaign support caps"
            raise ContractError(f"infeasible: {what}")
        relaxed = relaxed or best.phase == 1
        more = F.when(F.col("campaign_key") == best.campaign_key, F.col("allocated") + best.addition).otherwise(F.col("allocated"))
        state = stage(state.withColumn("allocated", more), "allocation")
        limits = limits.less({best.channel: best.addition})
    return state, relaxed


def allocate(leaves: DataFrame, request: AllocationRequest) -> Allocation:
    """Full allocation of one request over campaign-level baseline rows: channel minimums first, without the target, then the rest."""
    request.check()
    state = stage(candidates(leaves, request.max_multiple), "allocation")
    counts = state.agg(F.count("*").alias("n"), F.count_if("guarded").alias("guarded")).first()
    if not counts.n:
        raise ContractError("no active campaigns with a baseline budget")
    minimums, maximums = dict(request.channel_minimums), dict(request.channel_maximums)
    named = {*minimums, *maximums}
    if named:
        known = {r.channel for r in state.where(F.col("channel").isin(sorted(named))).select("channel").distinct().collect()}
        if named - known:
            raise ContractError(f"inactive or unknown channels: {sorted(named - known)}")
    if minimums:
        state, _ = _fill(state, _Limits(float("inf"), minimums), request.step, None)
    spent = {r.channel: r.spent for r in state.groupBy("channel").agg(F.sum("allocated").alias("spent")).collect()}
    state, relaxed = _fill(state, _Limits(request.total_budget, maximums).less(spent), request.step, request.target_roas)
    status = "not_requested" if request.target_roas is None else "marginal_target_relaxed" if relaxed else "marginal_target_met"
    return Allocation(state, status, counts.n - counts.guarded, counts.guarded)


def top_allocations(allocation: Allocation, k: int = 8) -> DataFrame:
    """The ``k`` largest budgets with their ``position``, ties by key; every task keeps ``k`` rows."""
    largest = allocation.plan.orderBy(F.desc("allocated"), "campaign_key").limit(k)
    order = Window.orderBy(F.desc("allocated"), "campaign_key")
    return largest.select(F.row_number().over(order).alias("position"), "campaign_key", "channel", "allocated")


def allocation_plan(allocation: Allocation, horizon_days: int, scenario_id: str = "allocation") -> DataFrame:
    """The chosen budgets as scenario overrides, to be forecast like any other plan."""
    return allocation.plan.select(
        F.lit(scenario_id).alias("scenario_id"),
        F.lit(horizon_days).alias("horizon_days"),
        F.col("campaign_key").alias("override_key"),
        F.col("allocated").alias("planned_budget"),
    )


def allocation_summary(forecast: DataFrame, allocation: Allocation, target: float | None) -> DataFrame:
    """One row: what the re-forecast of the chosen plan achieves."""
    return forecast.where(F.col("level") == "overall").select(
        "scenario_id",
        "horizon_days",
        F.lit("feasible").alias("status"),
        F.lit(allocation.target_status).alias("target_constraint_status"),
        F.col("predicted_roas_p50").alias("achieved_roas_p50"),
        F.lit(target).cast("double").alias("target_roas"),
        (F.col("predicted_roas_p50") - F.lit(target).cast("double")).alias("target_gap_p50"),
        F.lit(allocation.eligible_campaigns).alias("eligible_campaign_count"),
        F.lit(allocation.guarded_campaigns).alias("guardrailed_campaign_count"),
        F.lit("observational_association").alias("causal_status"),
    )
