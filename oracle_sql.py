"""Plain SQL with the results the registered queries have to reproduce.

Written for DuckDB over the sample tables. The statements share common table expressions, put
together by :func:`_with`; none of them is generated from the Spark side. Where money is rounded to
cents, 3e-6 is added first: sums of cents times per cents often end exactly between two cents.
"""

from __future__ import annotations

CANON = """
lines AS (
  SELECT *, CASE WHEN l_suppkey % 20 < 4 THEN 0 WHEN l_suppkey % 20 < 7 THEN 1 WHEN l_suppkey % 20 < 9 THEN 2
                 ELSE CAST(l_suppkey % 20 AS INTEGER) - 6 END AS b
  FROM lineitem
), kept AS (
  SELECT * EXCLUDE (b), CASE WHEN b = 13 AND l_shipdate >= TIMESTAMP '2001-04-05' THEN 0
                             WHEN b = 12 AND l_shipdate <  TIMESTAMP '2001-10-09' THEN 1 ELSE b END AS b
  FROM lines
), canon AS (
  SELECT CASE b % 3 WHEN 0 THEN 'google_ads' WHEN 1 THEN 'microsoft_ads' ELSE 'meta_ads' END AS source_system,
         lpad(CAST(b AS VARCHAR), 6, '0') AS source_campaign_id,
         CAST(l_shipdate AS DATE) AS date,
         CASE b % 3 WHEN 0 THEN CASE WHEN b % 2 = 0 THEN 'SEARCH' ELSE 'SHOPPING' END
                    WHEN 1 THEN 'MICROSOFT_ADS' ELSE 'META_ADS' END AS channel,
         CASE b % 3 WHEN 0 THEN CASE WHEN b % 2 = 0 THEN 'SEARCH' ELSE 'SHOPPING' END
                    WHEN 1 THEN CASE WHEN b % 2 = 0 THEN 'DISPLAY' ELSE 'PERFORMANCE_MAX' END
                    ELSE CASE WHEN b % 2 = 0 THEN 'META_PROSPECTING' ELSE 'META_REMARKETING' END END AS campaign_type,
         concat('Campaign ', lpad(CAST(b AS VARCHAR), 6, '0')) AS campaign_name,
         SUM(l_extendedprice * l_discount)             AS spend,
         SUM(l_extendedprice * (1 - l_discount) * 0.2) AS revenue,
         SUM(l_quantity)                               AS clicks,
         SUM(l_quantity) * 20                          AS impressions,
         CAST(COUNT(*) AS DOUBLE)                      AS conversions,
         CASE WHEN MAX(l_tax) = 0 THEN NULL ELSE SUM(l_extendedprice) * 0.06 END AS configured_budget,
         CAST('' AS VARCHAR) AS quality_flags,
         b
  FROM kept GROUP BY b, CAST(l_shipdate AS DATE)
), facts AS (
  SELECT *, source_system || ':' || source_campaign_id AS k FROM canon
)"""

LATEST = "slices AS (SELECT h, o FROM (VALUES (30), (60), (90)) t(h), (SELECT max(date) AS o FROM facts))"
FOLDS = (
    "folds AS (SELECT h, k AS fold, CAST((SELECT max(date) FROM facts) - CAST(h * k AS INTEGER) AS DATE) AS o "
    "FROM (VALUES (30), (60), (90)) t(h), range(1, 7) r(k)), slices AS (SELECT h, o FROM folds)"
)
# twelve last origins of the ninety-day grid, one horizon apart, that end with the data
CALIBRATION = """
bounds AS (SELECT min(date) AS lo, max(date) AS hi FROM facts),
grid AS (
  SELECT h, CAST(lo + CAST(90 + h * k AS INTEGER) AS DATE) AS o, k
  FROM (VALUES (30), (60), (90)) t(h), bounds, range(0, 400) r(k)
  WHERE lo + CAST(90 + h * k AS INTEGER) <= hi - CAST(h AS INTEGER)
),
slices AS (SELECT h, o FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY k DESC) AS rn FROM grid) WHERE rn <= 12)"""

ORIGINS = """
origins AS (SELECT DISTINCT o FROM slices),
stat AS (
  SELECT o, sum(revenue) / greatest(sum(spend), 1e-9) AS g,
         least(greatest(stddev_pop(ln(greatest(revenue / spend, 1e-5))), 0.20), 1.25) AS sg
  FROM origins JOIN facts ON date <= o WHERE spend > 0 AND revenue >= 0 GROUP BY o
),
mfac AS (
  SELECT o, month(date) AS m, least(greatest(sum(revenue) / greatest(sum(spend), 1e-9) / any_value(g), 0.55), 1.45) AS f
  FROM stat JOIN facts ON date <= o WHERE spend > 0 AND revenue >= 0 GROUP BY o, month(date)
),
future AS (
  SELECT h, o, CAST(o + CAST(i AS INTEGER) AS DATE) AS d, month(CAST(o + CAST(i AS INTEGER) AS DATE)) AS m
  FROM slices, range(1, 91) r(i) WHERE i <= h
),
season AS (SELECT h, o, sum(coalesce(f, 1.0)) / h AS sr FROM future LEFT JOIN mfac USING (o, m) GROUP BY h, o),
pdaily AS (SELECT date, sum(spend) AS sp FROM facts GROUP BY date),
mmean AS (SELECT o, month(date) AS m, avg(sp) AS a FROM origins JOIN pdaily ON date <= o GROUP BY o, month(date)),
rdaily AS (SELECT o, coalesce(sum(CASE WHEN date > o - 28 THEN sp END), 0) / 28.0 AS r FROM origins JOIN pdaily ON date <= o GROUP BY o),
mult AS (
  SELECT h, o, CASE WHEN h = 90 AND any_value(r) > 0
                    THEN least(greatest(sum(coalesce(a, r)) / h / any_value(r), 0.10), 2.00) ELSE 1.0 END AS bm
  FROM future JOIN rdaily USING (o) LEFT JOIN mmean USING (o, m) GROUP BY h, o
)"""

HISTORY = """
hist AS (
  SELECT o, k, any_value(source_campaign_id) AS id, any_value(channel) AS channel, any_value(campaign_type) AS campaign_type,
         any_value(campaign_name) AS campaign_name,
         coalesce(sum(CASE WHEN date > o - 28 THEN spend END), 0) AS rs, coalesce(sum(CASE WHEN date > o - 28 THEN revenue END), 0) AS rr,
         count(CASE WHEN date > o - 28 THEN 1 END) AS rd, sum(spend) AS hs, sum(revenue) AS hr, count(*) AS hd
  FROM origins JOIN facts ON date <= o GROUP BY o, k
),
prior AS (
  SELECT h, o, k, sum(spend) AS ps, count(*) AS pd
  FROM future JOIN facts ON date = CAST(d - INTERVAL 1 YEAR AS DATE) GROUP BY h, o, k
),
base AS (
  SELECT h, o, hist.* EXCLUDE (o), coalesce(ps, 0) AS ps, coalesce(pd, 0) AS pd, g, sg, sr, bm,
         CASE WHEN rs > 0 THEN rs / rd * h * bm ELSE 0 END AS rate
  FROM slices JOIN hist USING (o) LEFT JOIN prior USING (h, o, k) JOIN stat USING (o) JOIN season USING (h, o) JOIN mult USING (h, o)
),
budgets AS (
  SELECT *, CASE WHEN NOT rs > 0 THEN 0.0 WHEN CAST(pd AS DOUBLE) / h >= 0.8 AND ps > 0
                 THEN least(greatest(ps, 0.25 * rate), 4.0 * rate) ELSE rate END AS bb,
         CASE WHEN NOT rs > 0 THEN 'no_recent_delivery' WHEN CAST(pd AS DOUBLE) / h >= 0.8 AND ps > 0
              THEN 'calendar_matched_prior_year_budget' ELSE 'recent_run_rate_budget' END AS bmethod
  FROM base
)"""

SPEND = """
rolled AS (
  SELECT h, k, date, sum(spend) OVER w AS t, row_number() OVER (PARTITION BY h, k ORDER BY date) AS rn
  FROM (VALUES (30), (60), (90)) t(h), facts
  WINDOW w AS (PARTITION BY h, k ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
),
rolled_all AS (
  SELECT 30 AS h, k, date, sum(spend) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS t,
         row_number() OVER (PARTITION BY k ORDER BY date) AS rn FROM facts
  UNION ALL
  SELECT 60, k, date, sum(spend) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
         row_number() OVER (PARTITION BY k ORDER BY date) FROM facts
  UNION ALL
  SELECT 90, k, date, sum(spend) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW),
         row_number() OVER (PARTITION BY k ORDER BY date) FROM facts
),
totals AS (
  SELECT s.h, s.o, r.k, count(*) AS tn, avg(t) AS tm, stddev_pop(t) AS ts
  FROM slices s JOIN rolled_all r ON r.h = s.h AND r.date <= s.o AND r.rn >= r.h GROUP BY s.h, s.o, r.k
),
deliv AS (
  SELECT o, k, CASE WHEN count(*) >= 7 THEN median(least(greatest(spend / configured_budget, 0), 2)) END AS dl
  FROM origins JOIN facts ON date <= o WHERE configured_budget > 0 GROUP BY o, k
)"""
SPEND = SPEND[: SPEND.index("rolled AS (")] + SPEND[SPEND.index("rolled_all AS (") :]


def _leaf(plan: str = "", target: str = "4.0") -> str:
    """Statistical leaf forecasts; ``plan`` may name a table (h, k, ov) of overrides."""
    override = f"LEFT JOIN {plan} USING (h, k)" if plan else ""
    value = "ov" if plan else "CAST(NULL AS DOUBLE)"
    return f"""
planned AS (
  SELECT budgets.*, {value} AS ov, coalesce({value}, bb) AS pb,
         least(1.0, rd / 28.0) AS rel, {target} AS target
  FROM budgets {override} WHERE rs > 0
),
curve AS (
  SELECT *,
    (0.70 * (rel * (rr / greatest(rs, 1e-9)) + (1.0 - rel) * (hr / greatest(hs, 1e-9))) + 0.30 * g) * sr AS roas,
    pb > 1.5 * greatest(hs / hd * h, 1.0) AS extra,
    greatest(greatest(bb, 1.0) * 1.5, 1.0) AS sc
  FROM planned
),
point AS (
  SELECT *, sg * (1.0 + (1.0 - rel) + CASE WHEN extra THEN 0.55 ELSE 0.0 END) AS sigma,
    greatest(0.0, roas * sc * ln(1 + pb / sc) * (greatest(bb, 1.0) / (sc * ln(1 + greatest(bb, 1.0) / sc)))) AS p50
  FROM curve
),
leaf AS (
  SELECT point.*,
    CASE WHEN pb <= 0 THEN 0.0 ELSE p50 * exp(-1.28155 * sigma) END AS r10,
    CASE WHEN pb <= 0 THEN 0.0 ELSE p50 END AS r50,
    CASE WHEN pb <= 0 THEN 0.0 ELSE p50 * exp(1.28155 * sigma) END AS r90,
    CASE WHEN tn >= 3 AND tm > 0 THEN least(0.45, greatest(0.05, ts / tm)) ELSE 0.12 END AS cv,
    coalesce(least(1.25, greatest(0.55, dl)), 1.0) AS dv,
    CASE WHEN pb <= 0 THEN 0.0 ELSE least(greatest(0.0, pb * coalesce(least(1.25, greatest(0.55, dl)), 1.0) * (1.0 - 1.28155 * CASE WHEN tn >= 3 AND tm > 0 THEN least(0.45, greatest(0.05, ts / tm)) ELSE 0.12 END)), pb) END AS s10,
    greatest(pb, 0.0) AS s50,
    CASE WHEN pb <= 0 THEN 0.0 ELSE greatest(pb * coalesce(least(1.25, greatest(0.55, dl)), 1.0) * (1.0 + 1.28155 * CASE WHEN tn >= 3 AND tm > 0 THEN least(0.45, greatest(0.05, ts / tm)) ELSE 0.12 END), pb) END AS s90,
    concat_ws(';',
      CASE WHEN rd < 28 THEN 'sparse_recent_history' END,
      CASE WHEN extra THEN 'budget_extrapolation' END,
      CASE WHEN pb > 1.25 * bb THEN 'diminishing_returns' END,
      CASE WHEN ov IS NULL AND bmethod = 'calendar_matched_prior_year_budget' THEN 'calendar_matched_prior_year_budget' END,
      CASE WHEN ov IS NULL AND bmethod = 'recent_run_rate_budget' THEN 'recent_run_rate_baseline_budget' END,
      CASE WHEN ov IS NULL AND bm <> 1.0 THEN 'seasonally_adjusted_baseline_budget' END) AS flags
  FROM point LEFT JOIN totals USING (h, o, k) LEFT JOIN deliv USING (o, k)
)"""


LEAF = _leaf()
# the same under other names, next to leaves of a plan
_BASE_LEAF = LEAF
for _name in ("planned", "curve", "point", "leaf"):
    _BASE_LEAF = _BASE_LEAF.replace(f"{_name} AS", f"{_name}0 AS").replace(f"FROM {_name}", f"FROM {_name}0").replace(f"{_name}.*", f"{_name}0.*")


def _interp(p10: str, p50: str, p90: str) -> str:
    mid, high = f"greatest({p50}, {p10})", f"greatest({p90}, {p50}, {p10})"
    return (
        f"CASE WHEN {p10} <= 1e-9 AND {mid} <= 1e-9 AND {high} <= 1e-9 THEN 0.0 WHEN rk <= 10 THEN {p10} WHEN rk = 50 THEN {mid} WHEN rk >= 90 THEN {high} "
        f"WHEN rk < 50 AND {mid} <= {p10} + 1e-9 THEN {mid} "
        f"WHEN rk < 50 THEN exp((1 - (rk / 100.0 - 0.10) / 0.40) * ln({p10} + 1e-9) + (rk / 100.0 - 0.10) / 0.40 * ln({mid} + 1e-9)) - 1e-9 "
        f"WHEN {high} <= {mid} + 1e-9 THEN {high} "
        f"ELSE exp((1 - (rk / 100.0 - 0.50) / 0.40) * ln({mid} + 1e-9) + (rk / 100.0 - 0.50) / 0.40 * ln({high} + 1e-9)) - 1e-9 END"
    )


RANKS = """
ranks AS (
  SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY sha256('draw-order-1|campaign:' || k || '|' || CAST(i AS VARCHAR))) AS rk
  FROM (SELECT DISTINCT k FROM facts), range(0, 99) r(i)
)"""

DRAWS = f"""
draws AS (
  SELECT h, o, k, id, channel, campaign_type, campaign_name, i, pb, r50, flags, target,
         {_interp('r10', 'r50', 'r90')} AS r, {_interp('s10', 's50', 's90')} AS s
  FROM leaf JOIN ranks USING (k)
),
level_draws AS (
  SELECT h, o, 'campaign' AS level, channel, campaign_type, id, campaign_name, k, concat_ws(';', nullif(flags, ''), 'additive_p50_reconciled') AS flags, target, i, r, s, pb, r50 FROM draws
  UNION ALL
  SELECT h, o, CASE WHEN grouping(channel) = 1 THEN 'overall' WHEN grouping(campaign_type) = 1 THEN 'channel' ELSE 'campaign_type' END,
         coalesce(channel, 'ALL'), coalesce(campaign_type, 'ALL'), 'ALL', 'ALL', NULL,
         'independent_rank_rollup_fallback;additive_p50_reconciled', any_value(target), i, sum(r), sum(s), sum(pb), sum(r50)
  FROM draws GROUP BY GROUPING SETS ((h, o, channel, campaign_type, i), (h, o, channel, i), (h, o, i))
),
picked AS (
  SELECT h, o, level, channel, campaign_type, id, campaign_name, k, any_value(flags) AS flags, any_value(target) AS target, any_value(pb) AS pb, any_value(r50) AS p50,
         list_sort(list(r)) AS rl, list_sort(list(s)) AS sl, list_sort(list(r / greatest(s, 1e-9))) AS ql,
         avg(CASE WHEN r / greatest(s, 1e-9) >= target THEN 1.0 ELSE 0.0 END) AS share
  FROM level_draws GROUP BY h, o, level, channel, campaign_type, id, campaign_name, k
),
fc AS (
  SELECT h, o, level, channel, campaign_type, id, campaign_name, k, pb, least(rl[10], p50) AS r10, p50 AS r50, greatest(rl[90], p50) AS r90,
         sl[10] AS s10, sl[50] AS s50, sl[90] AS s90,
         least(ql[10], p50 / greatest(sl[50], 1e-9)) AS q10, p50 / greatest(sl[50], 1e-9) AS q50, greatest(ql[90], p50 / greatest(sl[50], 1e-9)) AS q90,
         round(share, 4) AS prob, flags, target
  FROM picked
),
forecast AS (
  SELECT *, least(100.0, round(100.0 * least(1.0, 0.55 * (1.0 - prob) + 0.25 * least((r90 - r10) / greatest(r50, 1e-9) / 3.0, 1.0)
         + CASE WHEN flags LIKE '%extrapolation%' THEN 0.20 ELSE 0.0 END), 1)) AS risk FROM fc
)"""

# the 21-day cut-offs of every campaign, or of the portfolio, with features and label
TRAINING = """
span AS (
  SELECT k, any_value(channel) AS channel, any_value(campaign_type) AS campaign_type, min(date) AS lo, max(date) AS hi FROM facts GROUP BY k
),
first AS (SELECT min(date) AS lo0 FROM facts),
cuts AS (
  SELECT 'own' AS cadence, k, channel, campaign_type, hi, CAST(lo + CAST(56 + 21 * n AS INTEGER) AS DATE) AS o
  FROM span, range(0, 200) r(n) WHERE lo + CAST(56 + 21 * n AS INTEGER) <= hi - 30
  UNION ALL
  SELECT 'shared', k, channel, campaign_type, hi, CAST(lo0 + CAST(56 + 21 * n AS INTEGER) AS DATE)
  FROM span, first, range(0, 200) r(n)
  WHERE lo0 + CAST(56 + 21 * n AS INTEGER) <= hi - 30 AND lo0 + CAST(56 + 21 * n AS INTEGER) >= lo + 56
),
slices AS (SELECT DISTINCT h, o FROM (VALUES (30), (60), (90)) t(h), cuts),
seen AS (
  SELECT c.cadence, c.k, c.channel, c.campaign_type, c.hi, c.o,
    coalesce(sum(CASE WHEN date <= o AND date > o - 28 THEN spend END), 0) AS rs, coalesce(sum(CASE WHEN date <= o AND date > o - 28 THEN revenue END), 0) AS rr,
    count(CASE WHEN date <= o AND date > o - 28 THEN 1 END) AS rd,
    coalesce(sum(CASE WHEN date <= o - 28 AND date > o - 56 THEN spend END), 0) AS pv,
    sum(CASE WHEN date <= o THEN spend END) AS hs, sum(CASE WHEN date <= o THEN revenue END) AS hr, count(CASE WHEN date <= o THEN 1 END) AS hd,
    sum(CASE WHEN date > o AND date <= o + 30 THEN spend END) AS t30, sum(CASE WHEN date > o AND date <= o + 30 THEN revenue END) AS v30,
    sum(CASE WHEN date > o AND date <= o + 60 THEN spend END) AS t60, sum(CASE WHEN date > o AND date <= o + 60 THEN revenue END) AS v60,
    sum(CASE WHEN date > o AND date <= o + 90 THEN spend END) AS t90, sum(CASE WHEN date > o AND date <= o + 90 THEN revenue END) AS v90
  FROM cuts c JOIN facts f ON f.k = c.k GROUP BY ALL
),
long AS (
  SELECT h, seen.*, CASE h WHEN 30 THEN t30 WHEN 60 THEN t60 ELSE t90 END AS fs, CASE h WHEN 30 THEN v30 WHEN 60 THEN v60 ELSE v90 END AS fr
  FROM seen, (VALUES (30), (60), (90)) t(h) WHERE o + CAST(h AS INTEGER) <= hi
),
future AS (SELECT DISTINCT h, o, CAST(o + CAST(i AS INTEGER) AS DATE) AS d, month(CAST(o + CAST(i AS INTEGER) AS DATE)) AS m FROM slices, range(1, 91) r(i) WHERE i <= h),
pdaily AS (SELECT date, sum(spend) AS sp FROM facts GROUP BY date),
origins AS (SELECT DISTINCT o FROM slices),
mmean AS (SELECT o, month(date) AS m, avg(sp) AS a FROM origins JOIN pdaily ON date <= o GROUP BY o, month(date)),
rdaily AS (SELECT o, coalesce(sum(CASE WHEN date > o - 28 THEN sp END), 0) / 28.0 AS r FROM origins JOIN pdaily ON date <= o GROUP BY o),
mult AS (
  SELECT h, o, CASE WHEN h = 90 AND any_value(r) > 0 THEN least(greatest(sum(coalesce(a, r)) / h / any_value(r), 0.10), 2.00) ELSE 1.0 END AS bm
  FROM future JOIN rdaily USING (o) LEFT JOIN mmean USING (o, m) GROUP BY h, o
),
prior AS (SELECT h, o, k, sum(spend) AS ps, count(*) AS pd FROM future JOIN facts ON date = CAST(d - INTERVAL 1 YEAR AS DATE) GROUP BY h, o, k),
sized AS (
  SELECT long.*, coalesce(ps, 0) AS ps, coalesce(pd, 0) AS pd, CASE WHEN rs > 0 THEN rs / rd * h * bm ELSE 0 END AS rate
  FROM long JOIN mult USING (h, o) LEFT JOIN prior USING (h, o, k) WHERE hd >= 28 AND fs > 0
),
modes AS (
  SELECT *, CASE WHEN cadence = 'own' THEN 'realized_future' ELSE 'shared_cutoffs' END AS mode, fs AS pb FROM sized
  UNION ALL
  SELECT *, 'inference_aligned', CASE WHEN NOT rs > 0 THEN 0.0 WHEN CAST(pd AS DOUBLE) / h >= 0.8 AND ps > 0
         THEN least(greatest(ps, 0.25 * rate), 4.0 * rate) ELSE rate END FROM sized WHERE cadence = 'own'
),
train AS (
  SELECT h, mode, k, channel, campaign_type, o AS cutoff, CAST(o + CAST(h AS INTEGER) AS DATE) AS target_end, pb,
    (SELECT min(date) FROM facts f WHERE f.k = modes.k AND f.date >= modes.o + CAST(modes.h AS INTEGER)) AS known_on,
    pb / greatest(hs / hd * h, 1.0) AS support,
    ln(1 + pb) AS x0, rr / greatest(rs, 1e-9) AS x1, hr / greatest(hs, 1e-9) AS x2, ln(1 + rs) AS x3, ln(1 + rr) AS x4,
    CAST(rd AS DOUBLE) AS x5, rs / greatest(pv, 1.0) AS x6,
    sin(2 * pi() * (month(o) + h / 60.0) / 12.0) AS x7, cos(2 * pi() * (month(o) + h / 60.0) / 12.0) AS x8,
    ln(1 + greatest(fr, 0.0)) AS y
  FROM modes WHERE pb > 0
)"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in (CANON, *parts)) + "\n" + select.strip()


def _recursive(*parts: str, select: str) -> str:
    return _with(*parts, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


def _greedy(limits: str = "SELECT '' AS channel, 0.0::DOUBLE AS low, 1e300::DOUBLE AS high", leaf: str = "leaf") -> str:
    """Allocation of nine tenths of the planned budgets, one pick per recursion: minimums of the channels by name, then the rest."""
    return f"""
cand AS (
  SELECT k, channel, greatest(pb, 1.0) AS bb1, greatest(r50 / greatest(pb, 1.0), 0.0) AS br,
    regexp_matches(flags, 'sparse_recent_history|budget_extrapolation') AS guarded,
    pb * CASE WHEN regexp_matches(flags, 'sparse_recent_history|budget_extrapolation') THEN 1.0 ELSE 2.0 END AS cap
  FROM {leaf} WHERE h = 30 AND pb > 0
),
req AS (SELECT total, greatest(100.0, round(total / 160 / 100.0) * 100.0) AS step FROM (SELECT round(0.9 * sum(pb), 2) AS total FROM {leaf} WHERE h = 30)),
limits AS ({limits}),
al AS (
  SELECT 0 AS i, cand.*, greatest(bb1 * 1.5, 1.0) AS sc, 0.0::DOUBLE AS given, total AS rest, step, coalesce(low, 0.0) AS need, coalesce(high, 1e300) AS free, 0 AS relaxed
  FROM cand LEFT JOIN limits ON limits.channel = cand.channel, req
  UNION ALL
  SELECT i + 1, k, channel, bb1, br, guarded, cap, sc, given + CASE WHEN k = best.k THEN best.a ELSE 0.0 END, rest - best.a, step,
    need - CASE WHEN channel = best.c THEN best.a ELSE 0.0 END, free - CASE WHEN channel = best.c THEN best.a ELSE 0.0 END, greatest(relaxed, -best.p)
  FROM (
    SELECT *, max(CASE WHEN a > 1e-6 AND given + 1e-6 < cap THEN {{'p': -phase, 's': CASE WHEN phase = 1 THEN 0.55 * m ELSE m END, 'k': k, 'c': channel, 'a': a}} END) OVER () AS best
    FROM (
      SELECT *, CASE WHEN first IS NULL AND after / (given + a) < 3.5 THEN 1 ELSE 0 END AS phase,
        least(greatest(0.0, (after - before) / greatest(a, 1e-9)), greatest(0.0, br * nm / (1 + given / sc))) AS m
      FROM (
        SELECT *, greatest(0.0, br * sc * ln(1 + given / sc) * nm) AS before, greatest(0.0, br * sc * ln(1 + (given + a) / sc) * nm) AS after
        FROM (
          SELECT *, bb1 / (sc * ln(1 + bb1 / sc)) AS nm,
            CASE WHEN first IS NULL THEN least(step, rest, cap - given, free) WHEN channel = first THEN least(step, need, cap - given) ELSE 0.0 END AS a
          FROM (SELECT *, min(CASE WHEN need > 1e-6 THEN channel END) OVER () AS first FROM al WHERE rest > 1e-6)
        )
      )
    )
  ) WHERE best IS NOT NULL
),
given AS (SELECT * FROM al WHERE i = (SELECT max(i) FROM al))"""


def _exports() -> dict[str, str]:
    numbers = "spend, revenue, clicks, impressions"
    named = "CASE WHEN b % 4 <> 3 THEN campaign_name ELSE source_campaign_id END AS campaign_name"
    end = "source_semantics_unreviewed"
    rounded = (
        "round(spend, 5) AS spend, round(revenue, 5) AS revenue, round(clicks + 3e-6, 2) AS clicks, round(impressions + 3e-6, 2) AS impressions, "
        "round(conversions, 5) AS conversions, round(configured_budget, 5) AS configured_budget"
    )
    head = "SELECT source_system, source_campaign_id, date, channel, campaign_type, campaign_name"
    google = f"""SELECT source_system, source_campaign_id, date, channel, campaign_type, {named}, {numbers}, conversions, configured_budget,
        'google_cost_micros_normalized;{end}' AS quality_flags FROM canon WHERE source_system = 'google_ads'"""
    microsoft = f"""SELECT source_system, source_campaign_id, date, channel,
        CASE b % 15 WHEN 1 THEN 'PERFORMANCE_MAX' WHEN 4 THEN 'DISPLAY' WHEN 7 THEN 'PERFORMANCE_MAX' WHEN 10 THEN 'SEARCH' ELSE 'BRAND_NEW_TYPE' END AS campaign_type,
        {named}, {numbers}, conversions, configured_budget,
        CASE WHEN b % 15 = 10 THEN 'microsoft_campaign_type_canonical' ELSE 'microsoft_campaign_type_normalized' END || ';{end}' AS quality_flags
        FROM canon WHERE source_system = 'microsoft_ads'"""
    meta = f"""SELECT source_system, source_campaign_id, date, channel,
        CASE b % 12 WHEN 2 THEN 'META_REMARKETING_DPA' WHEN 5 THEN 'META_REMARKETING' WHEN 8 THEN 'META_PROSPECTING' ELSE 'Generic' END AS campaign_type,
        CASE b % 12 WHEN 2 THEN 'Spring DPA push' WHEN 5 THEN 'Retarget visitors' WHEN 8 THEN 'Wide PROSPECTING video' ELSE source_campaign_id END AS campaign_name,
        {numbers}, revenue AS conversions, configured_budget,
        CASE WHEN b % 12 IN (2, 5, 8) THEN 'meta_campaign_type_inferred' ELSE 'meta_campaign_type_unknown' END
        || ';meta_campaign_type_taxonomy_unreviewed_fallback;meta_conversion_treated_as_attributed_revenue;{end}' AS quality_flags
        FROM canon WHERE source_system = 'meta_ads'"""
    out = {}
    for name, body in (("google", google), ("microsoft", microsoft), ("meta", meta)):
        out[f"canonicalize_{name}"] = _with(f"x AS ({body})", select=f"{head}, {rounded}, quality_flags FROM x")
    union = f"x AS ({google} UNION ALL {microsoft} UNION ALL {meta})"
    out["quality_rules"] = _with(
        union,
        select="""
SELECT 'missing_budget' AS rule, 'warning' AS severity, 'configured_budget' AS column_name, count(*) FILTER (configured_budget IS NULL) AS violations FROM x
UNION ALL SELECT 'taxonomy_unreviewed', 'warning', 'quality_flags', count(*) FILTER (source_system = 'meta_ads') FROM x
UNION ALL SELECT 'meta_revenue_unreviewed', 'warning', 'quality_flags', count(*) FILTER (source_system = 'meta_ads') FROM x
UNION ALL SELECT 'semantics_unreviewed', 'warning', 'quality_flags', count(*) FROM x""",
    )
    out["health_summary"] = _with(
        union,
        select="""
SELECT count(*) AS rows, count(DISTINCT source_system || source_campaign_id) AS campaigns, min(date) AS date_start, max(date) AS date_end,
  count(*) FILTER (source_system = 'meta_ads' AND campaign_type = 'Generic') AS meta_taxonomy_unknown_rows,
  'assumed_proxy' AS meta_revenue_semantics_status, count(*) FILTER (configured_budget IS NULL) AS missing_budget_rows, 'warning' AS status FROM x""",
    )
    return out


DAMAGED = """
k AS (SELECT *, (l_orderkey * 7 + l_linenumber) % 40 AS k FROM lineitem),
x AS (
  SELECT CASE k WHEN 3 THEN ' ' WHEN 23 THEN NULL ELSE 'google_ads' END AS source_system,
         CASE k WHEN 1 THEN NULL WHEN 2 THEN chr(9) || ' ' ELSE CAST(l_suppkey AS VARCHAR) END AS source_campaign_id,
         CASE WHEN k <> 0 THEN CAST(l_shipdate AS DATE) END AS date,
         CASE k WHEN 4 THEN '' ELSE 'SEARCH' END AS channel, CASE k WHEN 5 THEN chr(10) ELSE l_returnflag END AS campaign_type,
         CASE WHEN k <> 6 THEN 'line' END AS campaign_name,
         CASE k WHEN 7 THEN 'nan'::DOUBLE WHEN 8 THEN 'inf'::DOUBLE WHEN 9 THEN -1.5 ELSE l_extendedprice * l_discount END AS spend,
         CASE k WHEN 10 THEN 'nan'::DOUBLE WHEN 11 THEN 'inf'::DOUBLE WHEN 12 THEN -1.5 ELSE l_extendedprice END AS revenue,
         TRY_CAST(CASE k WHEN 13 THEN 'many' WHEN 14 THEN 'Infinity' WHEN 15 THEN '-2' ELSE CAST(l_quantity AS VARCHAR) END AS DOUBLE) AS clicks,
         CASE k WHEN 16 THEN 'nan'::DOUBLE WHEN 17 THEN 'inf'::DOUBLE WHEN 18 THEN -1.5 ELSE l_quantity END AS impressions,
         CASE k WHEN 19 THEN 'nan'::DOUBLE WHEN 20 THEN 'inf'::DOUBLE WHEN 21 THEN -1.5 ELSE 1.0 END AS conversions,
         CASE k WHEN 29 THEN 'nan'::DOUBLE WHEN 30 THEN 'inf'::DOUBLE WHEN 31 THEN -1.5 ELSE l_tax END AS configured_budget,
         CASE k WHEN 33 THEN 'Meta_Campaign_Type_Unknown' WHEN 34 THEN 'x|meta_conversion_treated_as_attributed_revenue'
                WHEN 35 THEN 'SOURCE_SEMANTICS_UNREVIEWED' WHEN 36 THEN NULL ELSE '' END AS quality_flags
  FROM k
)"""


def _damaged() -> str:
    def row(rule: str, severity: str, column: str, condition: str) -> str:
        return f"SELECT '{rule}' AS rule, '{severity}' AS severity, '{column}' AS column_name, count(*) FILTER ({condition}) AS violations FROM x"

    rows = ["SELECT 'no_rows' AS rule, 'blocker' AS severity, '*' AS column_name, CAST(count(*) = 0 AS BIGINT) AS violations FROM x"]
    rows += [row("null", "blocker", c, f"{c} IS NULL") for c in ("date", "source_campaign_id")]
    rows += [
        row("blank", "blocker", c, f"regexp_matches(coalesce({c}, ''), '^\\s*$')")
        for c in ("source_system", "source_campaign_id", "channel", "campaign_type", "campaign_name")
    ]
    for c in ("spend", "revenue", "clicks", "impressions", "conversions"):
        rows += [
            row("null_or_non_numeric", "blocker", c, f"{c} IS NULL OR isnan({c})"),
            row("non_finite", "blocker", c, f"isinf({c})"),
            row("negative", "blocker", c, f"{c} < 0"),
        ]
    b = "configured_budget"
    rows += [
        row("non_finite", "blocker", b, f"isinf({b})"),
        row("negative", "blocker", b, f"{b} < 0"),
        row("missing_budget", "warning", b, f"{b} IS NULL OR isnan({b})"),
        row("taxonomy_unreviewed", "warning", "quality_flags", "lower(quality_flags) = 'meta_campaign_type_unknown'"),
        row("meta_revenue_unreviewed", "warning", "quality_flags", "quality_flags LIKE 'x|%'"),
        row("semantics_unreviewed", "warning", "quality_flags", "quality_flags = 'SOURCE_SEMANTICS_UNREVIEWED'"),
        """SELECT 'duplicate_campaign_day', 'blocker', 'date', CAST(coalesce(sum(n), 0) AS BIGINT)
FROM (SELECT count(*) AS n FROM x GROUP BY source_system, source_campaign_id, date) WHERE n > 1""",
        """SELECT 'inconsistent_hierarchy', 'blocker', 'channel,campaign_type,campaign_name', count(*) FROM (
SELECT 1 FROM (SELECT DISTINCT source_system, source_campaign_id, channel, campaign_type, campaign_name FROM x)
GROUP BY source_system, source_campaign_id HAVING count(*) > 1)""",
    ]
    return f"WITH {DAMAGED}\n" + "\nUNION ALL ".join(rows)


PAYLOADS = """
p AS (
  SELECT o_orderkey AS request_id, CASE o_orderkey % 18
    WHEN 0 THEN '{"horizon_days": 30, "target_roas": 2.5}' WHEN 1 THEN '{"horizon_days": 45, "total_budget": 10}'
    WHEN 2 THEN '{"horizon_days": "30"}' WHEN 3 THEN '{"target_roas": -1}' WHEN 4 THEN '{"target_roas": true, "total_budget": 0}'
    WHEN 5 THEN '{"zeta": 1, "alpha": 2, "total_budget": 5}' WHEN 6 THEN '{"channel_budgets": [1], "channel_minimums": [1]}'
    WHEN 7 THEN '{"channel_budgets": {"SEARCH": -5}, "channel_maximums": {"SEARCH": -5}}'
    WHEN 8 THEN '{"channel_budgets": {" ": 5}, "channel_minimums": {" ": 5}}'
    WHEN 9 THEN '{"channel_budgets": {"SEARCH": "x"}, "channel_minimums": {"SEARCH": "x"}}'
    WHEN 10 THEN '{"campaign_budgets": 3, "total_budget": "5"}' WHEN 11 THEN 'not json' WHEN 12 THEN '[1, 2]'
    WHEN 13 THEN '{"horizon_days": null, "target_roas": 0, "campaign_budgets": {"a:b": null}, "other": {}}'
    WHEN 14 THEN '{}' WHEN 15 THEN '{"horizon_days": 60.0, "total_budget": 1e3}'
    WHEN 16 THEN format('{{"horizon_days": 90, "channel_budgets": {{"SEARCH": {0}}}, "total_budget": {0}}}', CAST(o_totalprice AS DECIMAL(18, 2)))
    END AS payload
  FROM orders
), j AS (
  SELECT request_id, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'OBJECT' THEN payload END END AS j FROM p
)"""


def _requests(fields: list[str], maps: list[str], total: bool) -> str:
    number = "json_type(j, '$.{0}') IN ('BIGINT', 'UBIGINT', 'DOUBLE')"
    value = "CASE WHEN " + number + " THEN CAST(json_extract_string(j, '$.{0}') AS DOUBLE) END"
    allowed = ", ".join(f"'{f}'" for f in fields)
    extra = f"list_sort(list_filter(json_keys(j), lambda f: NOT list_contains([{allowed}], f)))"
    rows = [
        "SELECT request_id, 'not_an_object' AS violation FROM j WHERE j IS NULL",
        f"SELECT request_id, 'unsupported_fields:' || array_to_string({extra}, ',') FROM j WHERE len({extra}) > 0",
        "SELECT request_id, 'horizon_days' FROM j WHERE json_type(j, '$.horizon_days') IS NOT NULL "
        f"AND NOT coalesce({value.format('horizon_days')} IN (30, 60, 90), false)",
        "SELECT request_id, 'target_roas' FROM j WHERE json_type(j, '$.target_roas') IS NOT NULL "
        f"AND NOT coalesce({value.format('target_roas')} > 0, false)",
    ]
    if total:
        rows.append(f"SELECT request_id, 'total_budget' FROM j WHERE j IS NOT NULL AND NOT coalesce({value.format('total_budget')} > 0, false)")
    for m in maps:
        rows.append(f"SELECT request_id, '{m}' FROM j WHERE json_type(j, '$.{m}') <> 'OBJECT'")
        rows.append(f"""SELECT DISTINCT request_id, '{m}' FROM (
  SELECT request_id, f, json_extract(json_extract(j, '$.{m}'), '$."' || f || '"') AS v
  FROM (SELECT request_id, j, unnest(json_keys(j, '$.{m}')) AS f FROM j WHERE json_type(j, '$.{m}') = 'OBJECT')
) WHERE trim(f) = '' OR coalesce(json_type(v), 'NULL') NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') OR TRY_CAST(CAST(v AS VARCHAR) AS DOUBLE) < 0""")
    return f"WITH {PAYLOADS}\n" + "\nUNION ALL ".join(rows)


def statements() -> dict[str, str]:
    sql = _exports()
    sql["damaged_line_quality"] = _damaged()
    sql["health_lists"] = f"""
WITH r AS ({_damaged()}),
e AS (
  SELECT CASE severity WHEN 'blocker' THEN 'blockers' ELSE 'warnings' END AS list, rule, column_name, violations FROM r WHERE violations > 0
  UNION ALL SELECT 'planning_defaults', rule, column_name, violations FROM r WHERE violations > 0 AND rule = 'missing_budget'
)
SELECT CASE WHEN (SELECT count(*) FROM e WHERE list = 'blockers') > 0 THEN 'blocked' WHEN (SELECT count(*) FROM e) > 0 THEN 'warning' ELSE 'healthy' END AS status,
  list, concat(rule, ' in ', column_name, ': ', violations) AS entry FROM e"""
    sql["forecast_request_violations"] = _requests(
        ["horizon_days", "target_roas", "channel_budgets", "campaign_budgets"], ["channel_budgets", "campaign_budgets"], False
    )
    sql["allocation_request_violations"] = _requests(
        ["horizon_days", "target_roas", "total_budget", "channel_minimums", "channel_maximums"], ["channel_minimums", "channel_maximums"], True
    )
    sql["canonical_campaign_days"] = _with(
        select="""SELECT source_system, source_campaign_id, date, channel, campaign_type, campaign_name, round(spend, 5) AS spend,
  round(revenue, 5) AS revenue, clicks, impressions, conversions, round(configured_budget, 5) AS configured_budget, quality_flags FROM canon"""
    )
    sql["delivery_line_quality"] = """
WITH x AS (SELECT CAST(l_suppkey AS VARCHAR) AS id, CAST(l_shipdate AS DATE) AS d, l_shipmode_like AS t, l_extendedprice * l_discount AS spend, l_tax
  FROM (SELECT *, l_returnflag AS l_shipmode_like FROM lineitem))
SELECT 'duplicate_campaign_day' AS rule, 'blocker' AS severity, 'date' AS column_name,
  (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM x GROUP BY id, d) WHERE n > 1) AS violations
UNION ALL
SELECT 'inconsistent_hierarchy', 'blocker', 'channel,campaign_type,campaign_name',
  (SELECT count(*) FROM (SELECT id FROM x GROUP BY id HAVING count(DISTINCT t) > 1))
UNION ALL
SELECT 'missing_budget', 'warning', 'configured_budget', (SELECT count(*) FROM x WHERE l_tax = 0)"""
    sql["data_provenance"] = _with(
        select="""SELECT count(*) AS canonical_rows, CAST(min(date) AS VARCHAR) AS canonical_date_start, CAST(max(date) AS VARCHAR) AS canonical_date_end,
  count(DISTINCT k) AS campaign_count, string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS source_systems FROM facts"""
    )
    cell = "coalesce({}, chr(1))"
    text = " || chr(31) || ".join(
        [cell.format(c) for c in ("source_system", "source_campaign_id", "CAST(date AS VARCHAR)", "channel", "campaign_type", "campaign_name")]
        + [f"coalesce(format('{{:.11e}}', {c}), chr(1))" for c in ("spend", "revenue", "clicks", "impressions", "conversions", "configured_budget")]
        + [cell.format("quality_flags")]
    )
    pieces = ", ".join(f"sum(CAST(CAST('0x' || substr(d, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)) AS p{i}" for i in range(4))
    sql["data_fingerprint"] = _with(
        f"d AS (SELECT sha256({text}) AS d FROM facts)",
        f"p AS (SELECT count(*) AS rows, {pieces} FROM d)",
        select="SELECT rows, sha256(concat_ws('|', rows, p0, p1, p2, p3)) AS fingerprint FROM p",
    )
    sql["recent_window"] = """
WITH x AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders)
SELECT o_orderkey, o_custkey, CAST(d AS VARCHAR) AS order_day, o_totalprice FROM x WHERE d >= (SELECT max(d) FROM x) - 89"""
    sql["statistical_components"] = _with(
        FOLDS,
        ORIGINS,
        select="""SELECT h AS horizon_days, o AS origin, round(g, 8) AS global_roas, round(sg, 8) AS global_log_sigma, round(sr, 8) AS seasonal_roas,
  round(bm, 8) AS budget_multiplier FROM slices JOIN stat USING (o) JOIN season USING (h, o) JOIN mult USING (h, o)""",
    )
    sql["month_roas_factors"] = _with(
        LATEST, ORIGINS, select="SELECT DISTINCT m AS month, round(f, 8) AS factor FROM mfac"
    )
    sql["baseline_budgets"] = _with(
        FOLDS,
        ORIGINS,
        HISTORY,
        select="""SELECT h AS horizon_days, o AS origin, k AS campaign_key, round(rs, 4) AS recent_spend, rd AS recent_days,
  CASE WHEN rs > 0 THEN CAST(pd AS DOUBLE) / h ELSE 0.0 END AS prior_coverage, round(ps, 4) AS prior_spend, round(bb + 3e-6, 2) AS baseline_budget, bmethod AS baseline_method FROM budgets""",
    )
    sql["spend_intervals"] = _with(
        FOLDS,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        select="""SELECT h AS horizon_days, o AS origin, k AS campaign_key, round(s10 + 3e-6, 2) AS predicted_spend_p10, round(s50 + 3e-6, 2) AS predicted_spend_p50,
  round(s90 + 3e-6, 2) AS predicted_spend_p90 FROM leaf""",
    )
    sql["statistical_leaves"] = _with(
        LATEST,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        select="""SELECT h AS horizon_days, o AS origin, k AS campaign_key, channel, campaign_type, round(pb + 3e-6, 2) AS planned_budget,
  round(r10 + 3e-6, 2) AS predicted_revenue_p10, round(r50 + 3e-6, 2) AS predicted_revenue_p50, round(r90 + 3e-6, 2) AS predicted_revenue_p90, flags AS quality_flags FROM leaf""",
    )
    sql["factor_paths"] = _with(
        RANKS, select="SELECT k AS campaign_key, i AS draw, rk AS rank FROM ranks"
    )
    columns = """h AS horizon_days, o AS origin, level, channel, campaign_type, id AS campaign_id, campaign_name, round(pb + 3e-6, 2) AS planned_budget,
  round(r10 + 3e-6, 2) AS predicted_revenue_p10, round(r50 + 3e-6, 2) AS predicted_revenue_p50, round(r90 + 3e-6, 2) AS predicted_revenue_p90,
  round(s10 + 3e-6, 2) AS predicted_spend_p10, round(s50 + 3e-6, 2) AS predicted_spend_p50, round(s90 + 3e-6, 2) AS predicted_spend_p90,
  round(q10, 6) AS predicted_roas_p10, round(q50, 6) AS predicted_roas_p50, round(q90, 6) AS predicted_roas_p90,
  prob AS probability_roas_above_target, risk AS risk_score, flags AS quality_flags"""
    sql["hierarchy_forecast"] = _with(LATEST, ORIGINS, HISTORY, SPEND, LEAF, RANKS, DRAWS, select=f"SELECT {columns} FROM forecast")
    sql["fold_forecasts"] = _with(
        FOLDS,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        RANKS,
        DRAWS,
        select="""SELECT h AS horizon_days, o AS origin, level, channel, campaign_type, id AS campaign_id,
  round(r10 + 3e-6, 2) AS predicted_revenue_p10, round(r50 + 3e-6, 2) AS predicted_revenue_p50, round(r90 + 3e-6, 2) AS predicted_revenue_p90,
  prob AS probability_roas_above_target, risk AS risk_score FROM forecast""",
    )
    plan = (
        "plan AS (SELECT h, k, CASE WHEN substr(k, -1) IN ('0', '4') THEN 0.0 ELSE bb * 2.5 END AS ov FROM budgets "
        "WHERE rs > 0 AND substr(k, -1) IN ('0', '1', '4', '5'))"
    )
    sql["budget_scenario"] = _with(
        LATEST, ORIGINS, HISTORY, SPEND, plan, _leaf("plan", "3.5"), RANKS, DRAWS, select=f"SELECT {columns} FROM forecast"
    )
    sql["scenario_delta"] = _with(
        LATEST,
        ORIGINS,
        HISTORY,
        SPEND,
        plan,
        _BASE_LEAF,
        _leaf("plan", "3.5"),
        "base0 AS (SELECT h, channel, sum(r50) AS b FROM leaf0 GROUP BY h, channel)",
        "scen AS (SELECT h, channel, sum(r50) AS s FROM leaf GROUP BY h, channel)",
        select="SELECT h AS horizon_days, channel, round(s + 3e-6, 2) AS predicted_revenue_p50, round(b + 3e-6, 2) AS baseline_revenue_p50, round(s - b + 3e-6, 2) AS revenue_p50_change FROM scen JOIN base0 USING (h, channel)",
    )
    sql["channel_budget_spread"] = _with(
        LATEST,
        ORIGINS,
        HISTORY,
        """spread AS (SELECT h, k, channel, bb, sum(bb) OVER (PARTITION BY h, channel) AS total FROM budgets WHERE rs > 0)""",
        select="SELECT h AS horizon_days, k AS override_key, round(100000.0 * h / 30 * (bb / greatest(total, 1e-9)) + 3e-6, 2) AS planned_budget FROM spread WHERE channel IN ('SEARCH', 'META_ADS')",
    )
    sql["top_channels"] = _with(
        LATEST,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        "c AS (SELECT h, channel, sum(r50) AS p FROM leaf GROUP BY h, channel)",
        "n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY p DESC, channel) AS position FROM c)",
        select="SELECT h AS horizon_days, position, channel, round(p + 3e-6, 2) AS expected_revenue FROM n WHERE position <= 3",
    )
    sql["top_campaigns"] = _with(
        LATEST,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        "n AS (SELECT h, k, r50, row_number() OVER (PARTITION BY h ORDER BY r50 DESC, channel, campaign_type, k) AS position FROM leaf)",
        select="SELECT h AS horizon_days, position, k AS campaign_key, round(r50 + 3e-6, 2) AS expected_revenue FROM n WHERE position <= 10",
    )
    sql["budget_plan_problems"] = _with(
        LATEST,
        ORIGINS,
        HISTORY,
        "active AS (SELECT DISTINCT id FROM budgets WHERE rs > 0 AND h = 30)",
        "named AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS override_key FROM supplier)",
        select="""SELECT 'baseline' AS scenario_id, 30 AS horizon_days, override_key, 'no_active_campaign' AS problem FROM named
  WHERE override_key NOT IN (SELECT id FROM active)""",
    )
    sql["decision_rows"] = _with(
        LATEST,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        RANKS,
        DRAWS,
        select="""SELECT h AS horizon_days, prob AS probability_roas_above_target, risk AS risk_score, (prob >= 0.7 AND risk < 45) AS model_guardrail_passed,
  'unavailable' AS posture, 'revise_or_test' AS decision FROM forecast WHERE level = 'overall'""",
    )
    for h in (30, 60, 90):
        sql[f"training_frame_{h}"] = _with(
            TRAINING,
            select=f"""SELECT mode, k AS campaign_key, channel, campaign_type, cutoff, target_end, known_on, round(pb + 3e-6, 2) AS planned_budget, round(support, 7) AS support_ratio,
  round(x0, 7) AS log_planned_budget, round(x1, 7) AS recent_roas, round(x2, 7) AS long_roas, round(x3, 7) AS log_recent_spend, round(x4, 7) AS log_recent_revenue,
  x5 AS recent_active_days, round(x6, 7) AS trend_ratio, round(x7, 7) AS month_sin, round(x8, 7) AS month_cos, round(y, 7) AS target_log_revenue
  FROM train WHERE h = {h}""",
        )
    sql["gram_cells"] = _with(
        TRAINING,
        select="""SELECT h AS horizon_days, mode, channel, campaign_type, count(*) AS n, round(sum(y), 5) AS sum_label, round(sum(x0 - 9), 5) AS sum_budget,
  round(sum((x0 - 9) * y), 4) AS budget_label, round(sum((x0 - 9) * (x3 - 9)), 4) AS budget_spend, round(sum((x5 - 28) * (x5 - 28)), 4) AS days_squared
  FROM train GROUP BY h, mode, channel, campaign_type""",
    )
    sql["ridge_normal_equations"] = _with(
        TRAINING,
        select="""SELECT h AS horizon_days, mode, count(*) AS sample_count, 0.0 AS largest_gradient FROM train
  WHERE mode <> 'shared_cutoffs' GROUP BY h, mode""",
    )
    splits = """
ends AS (SELECT max(date) AS o FROM facts),
inside AS (SELECT h, mode, cutoff, target_end, count(*) AS n FROM train, ends WHERE mode <> 'shared_cutoffs' AND known_on <= ends.o GROUP BY ALL),
ranked AS (SELECT h, mode, cutoff, row_number() OVER (PARTITION BY h, mode ORDER BY cutoff DESC) AS rn, count(*) OVER (PARTITION BY h, mode) AS c
  FROM (SELECT DISTINCT h, mode, cutoff FROM inside)),
cal AS (SELECT h, mode, cutoff AS cs FROM ranked WHERE rn = greatest(1, CAST(ceil(c * 0.2) AS BIGINT))),
pool AS (SELECT h, mode, cutoff, row_number() OVER (PARTITION BY h, mode ORDER BY cutoff DESC) AS rn, count(*) OVER (PARTITION BY h, mode) AS c
  FROM (SELECT DISTINCT h, mode, cutoff FROM inside JOIN cal USING (h, mode) WHERE target_end < cs)),
sel AS (SELECT h, mode, cutoff AS ss FROM pool WHERE rn = greatest(1, CAST(ceil(c * 0.2) AS BIGINT)))"""
    sql["purged_splits"] = _with(
        TRAINING,
        splits,
        select="""SELECT h AS horizon_days, mode, cs AS calibration_start, ss AS selection_start, CAST(sum(n) AS BIGINT) AS all_rows,
  CAST(sum(n) FILTER (target_end < cs) AS BIGINT) AS fit_rows, CAST(sum(n) FILTER (cutoff >= cs) AS BIGINT) AS calibration_rows,
  CAST(sum(n) FILTER (target_end < ss) AS BIGINT) AS selection_fit_rows, CAST(sum(n) FILTER (target_end < cs AND cutoff >= ss) AS BIGINT) AS selection_validation_rows
  FROM inside JOIN cal USING (h, mode) JOIN sel USING (h, mode) GROUP BY h, mode, cs, ss""",
    )
    # fits from the rows themselves: design rows, their products, and Gauss-Jordan elimination by recursion
    ready = """
sizes AS (SELECT h, mode, cs, ss, sum(n) AS every, sum(n) FILTER (target_end < cs) AS fitted, sum(n) FILTER (cutoff >= cs) AS held,
  coalesce(sum(n) FILTER (target_end < ss), 0) AS early, coalesce(sum(n) FILTER (target_end < cs AND cutoff >= ss), 0) AS shown
  FROM inside JOIN cal USING (h, mode) LEFT JOIN sel USING (h, mode) GROUP BY h, mode, cs, ss),
fits AS (
  SELECT h, mode, role, bound FROM (
    SELECT h, mode, 'final' AS role, CAST(NULL AS DATE) AS bound, true AS chosen, * EXCLUDE (h, mode) FROM sizes
    UNION ALL SELECT h, mode, 'calibration', cs, true, * EXCLUDE (h, mode) FROM sizes
    UNION ALL SELECT h, mode, 'selection', ss, early >= 40 AND shown >= 24, * EXCLUDE (h, mode) FROM sizes
  ) WHERE chosen AND every >= 80 AND fitted >= 40 AND held >= 20
)"""
    expanding = """
ends AS (SELECT max(date) AS o FROM facts),
bounds AS (SELECT DISTINCT h, mode, cutoff AS bound FROM train, ends WHERE mode = 'shared_cutoffs' AND known_on <= ends.o),
fits AS (
  SELECT b.h, b.mode, 'out_of_fold' AS role, bound FROM bounds b JOIN train t ON t.h = b.h AND t.mode = b.mode AND t.target_end < bound, ends
  WHERE t.known_on <= ends.o GROUP BY ALL HAVING count(*) >= 80
)"""
    x = [f"x{i}" for i in range(9)]
    solved = f"""
fr AS (
  SELECT f.role, f.bound, t.* FROM fits f JOIN train t ON t.h = f.h AND t.mode = f.mode, ends
  WHERE known_on <= ends.o AND (bound IS NULL OR target_end < bound)
),
mu AS (
  SELECT h, mode, role, bound, count(*) AS n, list_sort(list(DISTINCT channel)) AS cn, list_sort(list(DISTINCT campaign_type)) AS tn,
    [{", ".join(f"avg({c})" for c in x)}] AS m, [{", ".join(f"CASE WHEN stddev_pop({c}) < 1e-8 THEN 1.0 ELSE stddev_pop({c}) END" for c in x)}] AS s
  FROM fr GROUP BY h, mode, role, bound
),
z AS (
  SELECT fr.h, fr.mode, fr.role, fr.bound, y,
    [1.0::DOUBLE, {", ".join(f"({c} - m[{i}]) / s[{i}]" for i, c in enumerate(x, 1))}]
    || [CASE WHEN c = channel THEN 1.0::DOUBLE ELSE 0.0 END for c in cn] || [CASE WHEN c = campaign_type THEN 1.0::DOUBLE ELSE 0.0 END for c in tn] AS z
  FROM fr JOIN mu ON mu.h = fr.h AND mu.mode = fr.mode AND mu.role = fr.role AND mu.bound IS NOT DISTINCT FROM fr.bound
),
zi AS (SELECT *, unnest(range(1, len(z) + 1)) AS i FROM z),
zj AS (SELECT h, mode, role, bound, i, z[i] AS a, unnest(range(1, len(z) + 2)) AS j, z, y FROM zi),
products AS (
  SELECT h, mode, role, bound, i, j, sum(a * CASE WHEN j > len(z) THEN y ELSE z[j] END) + CASE WHEN i = j AND i > 1 THEN 4.0 ELSE 0.0 END AS v
  FROM zj GROUP BY h, mode, role, bound, i, j
),
matrix_rows AS (SELECT h, mode, role, bound, i, list(v ORDER BY j) AS v FROM products GROUP BY h, mode, role, bound, i),
el AS (
  SELECT h, mode, role, bound, 0 AS k, count(*)::INT AS size, list(v ORDER BY i) AS a FROM matrix_rows GROUP BY h, mode, role, bound
  UNION ALL
  SELECT h, mode, role, bound, k + 1, size,
    [CASE WHEN i = k + 1 THEN [v / a[k + 1][k + 1] for v in a[i]] ELSE [a[i][j] - a[i][k + 1] / a[k + 1][k + 1] * a[k + 1][j] for j in range(1, size + 2)] END
     for i in range(1, size + 1)]
  FROM el WHERE k < size
),
sol AS (
  SELECT el.h, el.mode, el.role, el.bound, n, m, s, cn, tn, [v[size + 1] for v in a] AS b FROM el JOIN mu
  ON mu.h = el.h AND mu.mode = el.mode AND mu.role = el.role AND mu.bound IS NOT DISTINCT FROM el.bound WHERE k = size
)"""
    names = ["log_planned_budget", "recent_roas", "long_roas", "log_recent_spend", "log_recent_revenue", "recent_active_days", "trend_ratio", "month_sin", "month_cos"]
    terms = f"""SELECT h AS horizon_days, mode, role, bound, CAST(n AS BIGINT) AS sample_count,
  unnest(['intercept', {", ".join(f"'{f}'" for f in names)}] || ['channels:' || c for c in cn] || ['types:' || c for c in tn]) AS term, round(unnest(b), 6) AS value FROM sol"""

    def predicted(fit: str, row: str) -> str:
        numbers = " + ".join(f"{fit}.b[{i + 1}] * ({row}.{c} - {fit}.m[{i}]) / {fit}.s[{i}]" for i, c in enumerate(x, 1))
        return (
            f"{fit}.b[1] + {numbers} + coalesce({fit}.b[10 + list_position({fit}.cn, {row}.channel)], 0.0) "
            f"+ coalesce({fit}.b[10 + len({fit}.cn) + list_position({fit}.tn, {row}.campaign_type)], 0.0)"
        )

    sql["ridge_coefficients"] = _recursive(TRAINING, splits, ready, solved, select=terms)
    sql["expanding_coefficients"] = _recursive(TRAINING, expanding, solved, select=terms)
    sql["out_of_fold_errors"] = _recursive(
        TRAINING,
        expanding,
        solved,
        select=f"""SELECT t.h AS horizon_days, cutoff, k AS campaign_key, round({predicted("sol", "t")}, 6) AS predicted, round(y - ({predicted("sol", "t")}), 6) AS residual
  FROM train t JOIN sol ON sol.h = t.h AND sol.mode = t.mode AND sol.bound = t.cutoff, ends WHERE known_on <= ends.o""",
    )
    held = f"""
held AS (
  SELECT t.h, t.mode, t.x5, t.support, y - ({predicted("sol", "t")}) AS e FROM train t JOIN cal ON cal.h = t.h AND cal.mode = t.mode
  JOIN sol ON sol.h = t.h AND sol.mode = t.mode AND sol.role = 'calibration', ends WHERE known_on <= ends.o AND cutoff >= cs
),
spans AS (
  SELECT h, mode, count(*) AS n, quantile_cont(e, 0.1) AS p10, quantile_cont(e, 0.5) AS p50, quantile_cont(e, 0.9) AS p90,
    CASE WHEN count(*) FILTER (x5 < 28) >= 12 THEN quantile_cont(e, 0.9) FILTER (x5 < 28) - quantile_cont(e, 0.1) FILTER (x5 < 28) END AS sparse,
    CASE WHEN count(*) FILTER (support > 1.5) >= 12 THEN quantile_cont(e, 0.9) FILTER (support > 1.5) - quantile_cont(e, 0.1) FILTER (support > 1.5) END AS wide
  FROM held GROUP BY h, mode
)"""
    wider = "CASE WHEN n >= 20 AND p90 - p10 > 1e-8 AND {0} IS NOT NULL THEN round(least(2.5, greatest(1.15, {0} / (p90 - p10))), 6) ELSE 1.0 END"
    sql["expert_profiles"] = _recursive(
        TRAINING,
        splits,
        ready,
        solved,
        held,
        select=f"""SELECT h AS horizon_days, mode, n AS calibration_sample_count, round(p10, 6) AS residual_p10, round(p50, 6) AS residual_p50, round(p90, 6) AS residual_p90,
  {wider.format("sparse")} AS sparse_multiplier, {wider.format("wide")} AS extrapolation_multiplier FROM spans""",
    )
    blend = f"""
shown AS (
  SELECT t.h, t.mode, t.k, t.cutoff, greatest(0.0, exp({predicted("sol", "t")}) - 1) AS r, greatest(0.0, exp(y) - 1) AS actual
  FROM train t JOIN cal ON cal.h = t.h AND cal.mode = t.mode JOIN sel ON sel.h = t.h AND sel.mode = t.mode
  JOIN sol ON sol.h = t.h AND sol.mode = t.mode AND sol.role = 'selection', ends WHERE known_on <= ends.o AND target_end < cs AND cutoff >= ss
),
pairs AS (
  SELECT a.h, a.r AS scenario, b.r AS aligned, a.actual FROM shown a JOIN shown b ON a.h = b.h AND a.k = b.k AND a.cutoff = b.cutoff
  WHERE a.mode = 'realized_future' AND b.mode = 'inference_aligned'
),
scores AS (
  SELECT h, w, count(*) AS n, sum(abs(actual)) AS total, sum(abs(actual - (w * scenario + (1 - w) * aligned))) / sum(abs(actual)) AS wape
  FROM pairs, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) g(w) GROUP BY h, w
)"""
    sql["expert_blend"] = _recursive(
        TRAINING,
        splits,
        ready,
        solved,
        blend,
        select="""SELECT h AS horizon_days, CAST(max(n) AS BIGINT) AS selection_sample_count,
  CASE WHEN max(n) < 24 OR max(total) <= 1e-9 THEN 1.0 ELSE arg_min(w, {'e': wape, 'w': w}) END AS scenario_weight FROM scores GROUP BY h""",
    )
    # dependence of a simple residual: label minus what the plan times four would earn
    residual = """
res AS (SELECT h, cutoff, k, channel, campaign_type, y, ln(1 + 4 * pb) AS p, y - ln(1 + 4 * pb) AS e FROM train WHERE mode = 'shared_cutoffs'),
blk AS (SELECT *, count(*) OVER (PARTITION BY h, cutoff) AS nb FROM res),
eff AS (SELECT *, avg(e) OVER (PARTITION BY h, cutoff) AS gm, avg(e) OVER (PARTITION BY h, cutoff, channel) AS cm, count(*) OVER (PARTITION BY h, cutoff, channel) AS cn,
  avg(e) OVER (PARTITION BY h, cutoff, channel, campaign_type) AS tm, count(*) OVER (PARTITION BY h, cutoff, channel, campaign_type) AS tn FROM blk WHERE nb >= 2),
parts AS (SELECT *, CASE WHEN cn >= 2 THEN cm - gm ELSE 0.0 END AS ce, CASE WHEN tn >= 2 THEN tm - cm ELSE 0.0 END AS te FROM eff),
v AS (SELECT h, count(*) AS n, count(DISTINCT cutoff) AS blocks, var_pop(gm) AS g, var_pop(ce) AS c, var_pop(te) AS t, var_pop(e - gm - ce - te) AS i FROM parts GROUP BY h),
w AS (SELECT *, least(0.85, (g + c + t) / (g + c + t + i)) AS common FROM v),
ww AS (SELECT h, n, blocks, round(common * g / (g + c + t), 8) AS wg, round(common * c / (g + c + t), 8) AS wc, round(common * t / (g + c + t), 8) AS wt FROM w)"""
    sql["residual_dependence_weights"] = _with(
        TRAINING,
        residual,
        select="""SELECT h AS horizon_days, 'hierarchical_residual_factor_copula_v1' AS dependence_method, n AS sample_count, blocks AS block_count,
  round(wg, 6) AS weight_global, round(wc, 6) AS weight_channel, round(wt, 6) AS weight_campaign_type, round(greatest(0.0, 1.0 - wg - wc - wt), 6) AS weight_idiosyncratic FROM ww""",
    )
    sql["block_portfolio_residuals"] = _with(
        TRAINING,
        residual,
        "bl AS (SELECT h, cutoff, ln(1 + sum(greatest(exp(y) - 1, 0))) - ln(1 + sum(greatest(exp(p) - 1, 0))) AS e FROM res GROUP BY h, cutoff)",
        select="""SELECT h AS horizon_days, count(*) AS block_count, round(quantile_cont(e, 0.1), 6) AS residual_p10, round(quantile_cont(e, 0.5), 6) AS residual_p50,
  round(quantile_cont(e, 0.9), 6) AS residual_p90 FROM bl GROUP BY h""",
    )
    sql["label_quantiles"] = _with(
        TRAINING,
        select="""SELECT h AS horizon_days, mode, count(*) AS n, round(quantile_cont(y, 0.1), 7) AS p10, round(quantile_cont(y, 0.5), 7) AS p50, round(quantile_cont(y, 0.9), 7) AS p90
  FROM train GROUP BY h, mode""",
    )
    matched = """
act AS (SELECT s.h, s.o, f.k, sum(revenue) AS actual, sum(spend) AS aspend FROM slices s JOIN facts f ON f.date > s.o AND f.date <= s.o + CAST(s.h AS INTEGER) GROUP BY s.h, s.o, f.k),
pairs AS (SELECT *, greatest(0.0, (ln(1 + r50) - ln(1 + actual)) / greatest(ln(1 + r50) - ln(1 + r10), 1e-12)) AS lo,
  greatest(0.0, (ln(1 + actual) - ln(1 + r50)) / greatest(ln(1 + r90) - ln(1 + r50), 1e-12)) AS up FROM leaf JOIN act USING (h, o, k) WHERE r50 > 0)"""
    sql["conformal_widths"] = _with(
        CALIBRATION,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        matched,
        """agg AS (SELECT h, count(*) AS n, count(DISTINCT o) AS origins, list_sort(list(lo)) AS ll, list_sort(list(up)) AS ul,
  avg(CASE WHEN actual >= r10 THEN 1.0 ELSE 0.0 END) AS bl, avg(CASE WHEN actual <= r90 THEN 1.0 ELSE 0.0 END) AS bu FROM pairs GROUP BY h)""",
        select="""SELECT h AS horizon_days, 'available' AS status, origins AS origin_count, n AS sample_count,
  round(least(4.0, greatest(1.0, ll[least(n, greatest(1, CAST(ceil((n + 1) * 0.9) AS BIGINT)))])), 6) AS lower_width_multiplier,
  round(least(4.0, greatest(1.0, ul[least(n, greatest(1, CAST(ceil((n + 1) * 0.9) AS BIGINT)))])), 6) AS upper_width_multiplier,
  round(bl, 6) AS base_lower_coverage, round(bu, 6) AS base_upper_coverage FROM agg""",
    )
    sql["conformal_order_statistics"] = _with(
        CALIBRATION,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        matched,
        "agg AS (SELECT h, count(*) AS n, list_sort(list(lo)) AS ll, list_sort(list(up)) AS ul FROM pairs GROUP BY h)",
        select="""SELECT h AS horizon_days, n, round(ll[least(n, greatest(1, CAST(ceil((n + 1) * 0.9) AS BIGINT)))], 6) AS lower_required,
  round(ul[least(n, greatest(1, CAST(ceil((n + 1) * 0.9) AS BIGINT)))], 6) AS upper_required FROM agg""",
    )
    sql["portfolio_residual_profile"] = _with(
        CALIBRATION,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        """tot AS (SELECT h, o, sum(r50) AS p FROM leaf GROUP BY h, o)""",
        """out AS (SELECT s.h, s.o, sum(revenue) AS a FROM slices s JOIN facts f ON f.date > s.o AND f.date <= s.o + CAST(s.h AS INTEGER) GROUP BY s.h, s.o)""",
        "e AS (SELECT h, ln(1 + a) - ln(1 + p) AS e FROM tot JOIN out USING (h, o))",
        select="""SELECT h AS horizon_days, count(*) AS origin_count, round(quantile_cont(e, 0.1), 6) AS residual_p10, round(quantile_cont(e, 0.5), 6) AS residual_p50,
  round(quantile_cont(e, 0.9), 6) AS residual_p90 FROM e GROUP BY h""",
    )
    scored = """
actual AS (
  SELECT h, o, CASE WHEN grouping(k) = 0 THEN 'campaign' WHEN grouping(campaign_type) = 0 THEN 'campaign_type' WHEN grouping(channel) = 0 THEN 'channel' ELSE 'overall' END AS level,
         coalesce(channel, 'ALL') AS channel, coalesce(campaign_type, 'ALL') AS campaign_type, coalesce(k, 'ALL') AS k, sum(revenue) AS ar, sum(spend) AS asp
  FROM (SELECT s.h, s.o, f.k, f.channel, f.campaign_type, f.revenue, f.spend FROM slices s JOIN facts f ON f.date > s.o AND f.date <= s.o + CAST(s.h AS INTEGER))
  GROUP BY GROUPING SETS ((h, o, k), (h, o, channel, campaign_type), (h, o, channel), (h, o))
),
pred AS (SELECT h, o, level, CASE WHEN level = 'campaign' THEN 'ALL' ELSE channel END AS channel, CASE WHEN level = 'campaign' THEN 'ALL' ELSE campaign_type END AS campaign_type,
  coalesce(k, 'ALL') AS k, r10, r90, q10, q90 FROM forecast),
rec AS (SELECT h, level, pred.r10 IS NOT NULL AS hf, actual.ar IS NOT NULL AS ha,
  CASE WHEN ar IS NOT NULL THEN coalesce(r10 <= ar AND ar <= r90, false) END AS rc,
  CASE WHEN asp > 0 THEN coalesce(q10 <= ar / asp AND ar / asp <= q90, false) END AS qc
  FROM pred FULL OUTER JOIN actual USING (h, o, level, channel, campaign_type, k)),
cnt AS (SELECT h, level, count(*) AS n, count(*) FILTER (hf AND ha) AS m, count(*) FILTER (NOT hf) AS mf, count(*) FILTER (NOT ha) AS ma,
  count(rc) AS rn, count(*) FILTER (rc) AS rh, count(qc) AS qn, count(*) FILTER (qc) AS qh FROM rec GROUP BY h, level)"""

    def wilson(hits: str, n: str, sign: str) -> str:
        p = f"(CAST({hits} AS DOUBLE) / {n})"
        body = f"(({p} + 3.8416 / (2.0 * {n})) {sign} 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n}))) / (1.0 + 3.8416 / {n})"
        bound = f"greatest(0.0, {body})" if sign == "-" else f"least(1.0, {body})"
        return f"CASE WHEN {n} > 0 THEN round({bound}, 4) END"

    sql["backtest_coverage"] = _with(
        FOLDS,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        RANKS,
        DRAWS,
        scored,
        select=f"""SELECT h AS horizon_days, level, n AS observations, m AS matched_observations, mf AS missing_forecast_observations, ma AS missing_actual_observations,
  rn AS revenue_coverage_observations, round(CAST(rh AS DOUBLE) / rn, 4) AS revenue_interval_coverage, {wilson('rh', 'rn', '-')} AS revenue_coverage_low, {wilson('rh', 'rn', '+')} AS revenue_coverage_high,
  qn AS roas_coverage_observations, n - qn AS roas_unscorable_observations, round(CAST(qh AS DOUBLE) / qn, 4) AS roas_interval_coverage,
  {wilson('qh', 'qn', '-')} AS roas_coverage_low, {wilson('qh', 'qn', '+')} AS roas_coverage_high FROM cnt""",
    )
    results = """
res AS (SELECT f.h, f.o, f.fold, a.ar, a.asp, a.ar / a.asp AS aq, p.r10, p.r50, p.r90, p.q10, p.q50, p.q90, p.prob, a.ar / a.asp >= 4.0 AS hit
  FROM folds f JOIN forecast p ON p.h = f.h AND p.o = f.o AND p.level = 'overall' JOIN actual a ON a.h = f.h AND a.o = f.o AND a.level = 'overall')"""
    sql["fold_results"] = _with(
        FOLDS,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        RANKS,
        DRAWS,
        scored,
        results,
        select="""SELECT h AS horizon_days, o AS origin, fold, round(ar, 4) AS actual_revenue, round(aq, 6) AS actual_roas, round(r10 + 3e-6, 2) AS predicted_revenue_p10,
  round(r50 + 3e-6, 2) AS predicted_revenue_p50, round(r90 + 3e-6, 2) AS predicted_revenue_p90, prob AS modeled_target_probability, hit AS actual_target_hit FROM res""",
    )
    sql["horizon_report"] = _with(
        FOLDS,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        RANKS,
        DRAWS,
        scored,
        results,
        """c AS (SELECT h, count(*) AS n, count(*) FILTER (ar BETWEEN r10 AND r90) AS rh, count(*) FILTER (aq BETWEEN q10 AND q90) AS qh,
  round(sum(abs(ar - r50)) / greatest(sum(abs(ar)), 1e-9), 4) AS wape FROM res GROUP BY h)""",
        select=f"""SELECT h AS horizon_days, n AS folds, round(CAST(rh AS DOUBLE) / n, 4) AS revenue_interval_coverage, {wilson('rh', 'n', '-')} AS revenue_coverage_low,
  {wilson('rh', 'n', '+')} AS revenue_coverage_high, round(CAST(qh AS DOUBLE) / n, 4) AS roas_interval_coverage, wape AS revenue_wape FROM c""",
    )
    sql["evaluation_document"] = f"SELECT *, 'available' AS status FROM ({sql['horizon_report']})"
    sql["target_reliability"] = _with(
        FOLDS,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        RANKS,
        DRAWS,
        scored,
        results,
        """ev AS (SELECT h, prob AS p, CASE WHEN hit THEN 1.0 ELSE 0.0 END AS y, CASE WHEN prob < 0.25 THEN 0 WHEN prob < 0.5 THEN 1 WHEN prob < 0.75 THEN 2 ELSE 3 END AS bin FROM res WHERE hit IS NOT NULL)""",
        "bins AS (SELECT h, bin, count(*) AS n, avg(p) AS mp, avg(y) AS my, sum((p - y) * (p - y)) AS se FROM ev GROUP BY h, bin)",
        select="""SELECT h AS horizon_days, CASE WHEN sum(n) >= 20 THEN 'evaluated' ELSE 'insufficient_evidence' END AS status, CAST(sum(n) AS BIGINT) AS observations,
  round(sum(se) / sum(n) + 1e-9, 4) AS brier_score, round(sum(n * abs(mp - my)) / sum(n) + 1e-9, 4) AS expected_calibration_error FROM bins GROUP BY h""",
    )
    # direct model served on a plan; the training tables have names of their own inside one expression
    training = ",\n".join(x.strip() for x in (TRAINING, splits, ready, solved, held, blend))
    wide_of = wider.format("wide")
    experts = f"""
ex AS (
  WITH RECURSIVE {training},
  w AS (SELECT h, CASE WHEN max(n) < 24 OR max(total) <= 1e-9 THEN 1.0 ELSE arg_min(w, {{'e': wape, 'w': w}}) END AS weight FROM scores GROUP BY h),
  p AS (SELECT h, mode, p10, p50, p90, {wider.format("sparse")} AS sparse_by, {wide_of} AS wide_by FROM spans)
  SELECT sol.h, sol.mode, m, s, cn, tn, b, p10, p50, p90, sparse_by, wide_by, coalesce(weight, 1.0) AS weight
  FROM sol JOIN p ON p.h = sol.h AND p.mode = sol.mode LEFT JOIN w ON w.h = sol.h WHERE sol.role = 'final'
),
before AS (SELECT k, sum(spend) AS pv FROM facts, (SELECT max(date) AS o FROM facts) e WHERE date <= o - 28 AND date > o - 56 GROUP BY k),
serve AS (
  SELECT leaf.*, ln(1 + pb) AS x0, rr / greatest(rs, 1e-9) AS x1, hr / greatest(hs, 1e-9) AS x2, ln(1 + rs) AS x3, ln(1 + rr) AS x4, CAST(rd AS DOUBLE) AS x5,
    rs / greatest(coalesce(pv, 0), 1.0) AS x6, sin(2 * pi() * (month(o) + h / 60.0) / 12.0) AS x7, cos(2 * pi() * (month(o) + h / 60.0) / 12.0) AS x8,
    pb / greatest(hs / hd * h, 1.0) AS support
  FROM leaf LEFT JOIN before USING (k)
),
one AS (
  SELECT t.*, ex.mode, ex.weight, ex.p10 AS e10, ex.p50 AS e50, ex.p90 AS e90, {predicted("ex", "t")} AS score,
    least(4.0, greatest(1.0, CASE WHEN rd < 28 AND sparse_by > 1 THEN least(sparse_by, 3.0) ELSE 1.0 END * CASE WHEN support > 1.5 AND wide_by > 1 THEN least(wide_by, 3.0) ELSE 1.0 END)) AS width
  FROM serve t JOIN ex ON ex.h = t.h
),
quant AS (
  SELECT *, greatest(0.0, exp(score + e50 + (e10 - e50) * width) - 1) AS d10, greatest(0.0, exp(score + e50) - 1) AS d50, greatest(0.0, exp(score + e50 + (e90 - e50) * width) - 1) AS d90 FROM one
),
both_of AS (
  SELECT h, k, any_value(channel) AS channel, any_value(pb) AS pb, any_value(p50) AS curve, any_value(g) AS g, any_value(flags) AS flags, any_value(weight) AS w,
    max(d10) FILTER (mode = 'realized_future') AS s10, max(d50) FILTER (mode = 'realized_future') AS s50, max(d90) FILTER (mode = 'realized_future') AS s90,
    max(d10) FILTER (mode = 'inference_aligned') AS a10, max(d50) FILTER (mode = 'inference_aligned') AS a50, max(d90) FILTER (mode = 'inference_aligned') AS a90
  FROM quant GROUP BY h, k
),
blended AS (
  SELECT *, w * s50 + (1 - w) * a50 AS mid, least(abs(s50 - a50), greatest(3 * (w * s50 + (1 - w) * a50), 1.0)) AS spread FROM both_of
),
direct AS (
  SELECT *, CASE WHEN w >= 1 THEN s10 WHEN w <= 0 THEN a10 ELSE least(greatest(0.0, w * s10 + (1 - w) * a10 - 0.25 * spread), mid) END AS r10,
    CASE WHEN w >= 1 THEN s50 WHEN w <= 0 THEN a50 ELSE mid END AS r50,
    CASE WHEN w >= 1 THEN s90 WHEN w <= 0 THEN a90 ELSE greatest(mid, w * s90 + (1 - w) * a90 + 0.25 * spread) END AS r90,
    greatest(curve * 2.0, pb * g * 2.0, 1.0) AS cap
  FROM blended
),
shown_direct AS (
  SELECT *, CASE WHEN pb <= 0 THEN 0.0 WHEN r50 > cap THEN cap / greatest(r50, 1e-9) ELSE 1.0 END AS shrink, pb > 0 AND r50 > cap AS capped FROM direct
)"""
    sql["direct_leaves"] = _recursive(
        LATEST,
        ORIGINS,
        HISTORY,
        SPEND,
        plan,
        _leaf("plan", "3.5"),
        experts,
        select="""SELECT h AS horizon_days, k AS campaign_key, round(pb + 3e-6, 2) AS planned_budget, round(r10 * shrink, 1) AS predicted_revenue_p10, round(r50 * shrink, 1) AS predicted_revenue_p50,
  round(r90 * shrink, 1) AS predicted_revenue_p90, concat_ws(';', nullif(flags, ''), CASE WHEN capped THEN 'direct_model_response_capped' END) AS quality_flags FROM shown_direct""",
    )
    given = """SELECT k AS campaign_key, channel, guarded, round(cap + 3e-6, 2) AS cap, round(given + 3e-6, 2) AS allocated FROM given"""
    sql["allocation"] = _recursive(LATEST, ORIGINS, HISTORY, SPEND, LEAF, _greedy(), select=given)
    limits = """SELECT channel, CASE channel WHEN 'META_ADS' THEN round(0.7 * sum(pb), 2) WHEN 'MICROSOFT_ADS' THEN round(0.4 * sum(pb), 2) END AS low,
  CASE channel WHEN 'SEARCH' THEN round(0.8 * sum(pb), 2) WHEN 'MICROSOFT_ADS' THEN round(1.1 * sum(pb), 2) END AS high FROM leaf WHERE h = 30 GROUP BY channel"""
    sql["allocation_limits"] = _recursive(LATEST, ORIGINS, HISTORY, SPEND, LEAF, _greedy(limits), select=given)
    sql["largest_allocations"] = _recursive(
        LATEST,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        _greedy(limits),
        "n AS (SELECT *, row_number() OVER (ORDER BY given DESC, k) AS position FROM given)",
        select="SELECT CAST(position AS INTEGER) AS position, k AS campaign_key, channel, round(given + 3e-6, 2) AS allocated FROM n WHERE position <= 8",
    )
    sql["ordered_levels"] = _with(
        LATEST,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        RANKS,
        DRAWS,
        "n AS (SELECT *, row_number() OVER (PARTITION BY h, level ORDER BY r50 DESC, channel, campaign_type, coalesce(k, '')) AS position FROM fc)",
        select="""SELECT h AS horizon_days, level, CAST(position AS INTEGER) AS position, channel, campaign_type, id AS campaign_id, round(r50 + 3e-6, 2) AS expected_revenue FROM n""",
    )
    sql["allocation_result"] = _recursive(
        LATEST,
        ORIGINS,
        HISTORY,
        SPEND,
        _BASE_LEAF,
        _greedy(leaf="leaf0"),
        "plan AS (SELECT 30 AS h, k, given AS ov FROM given)",
        _leaf("plan", "3.5"),
        RANKS,
        DRAWS,
        select="""SELECT 'allocation' AS scenario_id, h AS horizon_days, 'feasible' AS status,
  CASE WHEN (SELECT max(relaxed) FROM given) = 1 THEN 'marginal_target_relaxed' ELSE 'marginal_target_met' END AS target_constraint_status,
  round(q50, 4) AS achieved_roas_p50, 3.5::DOUBLE AS target_roas, round(q50 - 3.5, 4) AS target_gap_p50,
  (SELECT count(*) FROM given WHERE NOT guarded) AS eligible_campaign_count, (SELECT count(*) FROM given WHERE guarded) AS guardrailed_campaign_count,
  'observational_association' AS causal_status FROM fc WHERE level = 'overall' AND h = 30""",
    )
    # sorted fill of equal steps, the part of the allocation that SQL can say
    sql["allocation_steps"] = _with(
        LATEST,
        ORIGINS,
        HISTORY,
        SPEND,
        LEAF,
        """cand AS (SELECT k, channel, greatest(pb, 1.0) AS bb1, greatest(r50 / greatest(pb, 1.0), 0.0) AS br,
  pb * CASE WHEN regexp_matches(flags, 'sparse_recent_history|budget_extrapolation') THEN 1.0 ELSE 2.0 END AS cap FROM leaf WHERE h = 30 AND pb > 0)""",
        """st AS (SELECT *, n * 10000.0 AS cur, least(10000.0, cap - n * 10000.0) AS addn, greatest(bb1 * 1.5, 1.0) AS sc FROM cand, range(0, 400) r(n) WHERE n * 10000.0 + 1e-6 < cap)""",
        """rev AS (SELECT *, bb1 / (sc * ln(1 + bb1 / sc)) AS nm FROM st)""",
        """mar AS (SELECT *, greatest(0.0, br * sc * ln(1 + cur / sc) * nm) AS before, greatest(0.0, br * sc * ln(1 + (cur + addn) / sc) * nm) AS after, greatest(0.0, br * nm / (1 + cur / sc)) AS slope FROM rev)""",
        """sc2 AS (SELECT *, least(greatest(0.0, (after - before) / addn), slope) AS m, after / (cur + addn) >= 3.5 AS met FROM mar)""",
        select="SELECT k AS campaign_key, n AS nth, round(addn + 3e-6, 2) AS addition, CASE WHEN met THEN 0 ELSE 1 END AS phase, round(CASE WHEN met THEN m ELSE 0.55 * m END, 6) AS score FROM sc2",
    )
    return sql
