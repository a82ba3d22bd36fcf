"""Features of broker fills joined with what ticks did at the same price.

Prices are joined as whole hundredths, never as floating numbers. A fill's quantity is split by its price's shares.
"""

from __future__ import annotations

from tidemark.plans.brokers import B
from tidemark.plans.feature import Feature
from tidemark.plans.ticks import BY_DAY, T, c0

CENTS = "CAST(round({} * 100) AS BIGINT)"
LADDER = (
    "ladder",
    f"""SELECT StockId, Date, {CENTS.format('p')} AS cents, sum(q) AS vol, sum(buy) AS buy, sum(sell) AS sell, sum(CASE WHEN sec <= 34200 THEN q ELSE 0 END) AS morning,
       avg(CASE WHEN f = 0 AND pp > 0 THEN abs(dp) / pp END) AS down FROM t GROUP BY StockId, Date, {CENTS.format('p')}""",
)
#: Estimated active and morning volumes of each broker's day; rank is the share of brokers up to its size.
ESTIMATES = (
    "est",
    f"""SELECT *, row_number() OVER (PARTITION BY StockId, Date ORDER BY buy + sell, BrokerId) * 1.0 / count(*) OVER (PARTITION BY StockId, Date) AS rank,
       sum(active_buy) OVER (PARTITION BY StockId, Date) AS day_buy, sum(active_sell) OVER (PARTITION BY StockId, Date) AS day_sell
FROM (SELECT f.StockId, f.Date, f.BrokerId, sum(f.BuyQtm) AS buy, sum(f.SellQtm) AS sell,
             sum(f.BuyQtm * coalesce(1.0 * l.buy / nullif(l.buy + l.sell, 0), 0.5)) AS active_buy, sum(f.SellQtm * coalesce(1.0 * l.sell / nullif(l.buy + l.sell, 0), 0.5)) AS active_sell,
             sum(f.SellQtm * 1.0 * l.morning / l.vol) AS morning_sell
      FROM {{brokers}} AS f JOIN ladder AS l ON f.StockId = l.StockId AND f.Date = l.Date AND {CENTS.format('f.Price')} = l.cents
      GROUP BY f.StockId, f.Date, f.BrokerId) AS own""",
)


def ladder(name: str, description: str, queries: tuple, steps: tuple) -> Feature:
    return Feature(name, "cross_broker_tick", description, (T, LADDER, ESTIMATES, *queries), steps, ("brokers", "ticks"))


FEATURES = [
    ladder("f_acellular_gap_formation", "running sum of leading net selling times the spread of falls", (
        ("s", f"SELECT StockId, Date, coalesce(avg(down), 0.0) AS down FROM ladder {BY_DAY}"),
        ("n", f"SELECT StockId, Date, 1.0 * sum(CASE WHEN rank >= 0.9 THEN sell - buy ELSE 0 END) / (sum(buy + sell) + 1) AS sold FROM est {BY_DAY}"),
        ("d", "SELECT n.StockId, n.Date, sold * down AS y FROM n JOIN s ON n.StockId = s.StockId AND n.Date = s.Date")), (("x", "cumulative", "y"), ("z", "zscore", "x", 42, 21), *c0("z"))),
    ladder("f_aggressor_concentration_zscore", "concentration of active buying less that of active selling", (
        ("d", f"SELECT StockId, Date, sum(power(active_buy / coalesce(nullif(day_buy, 0), 1), 2)) - sum(power(active_sell / coalesce(nullif(day_sell, 0), 1), 2)) AS x FROM est {BY_DAY}"),), (("z", "zscore", "x", 20, 5, 1e-9), *c0("z"))),
    ladder("f_morning_retail_panic", "morning selling of the smaller brokers", (
        ("d", f"SELECT StockId, Date, sum(CASE WHEN rank < 0.8 THEN morning_sell ELSE 0 END) / (sum(buy + sell) + 1) AS x FROM est {BY_DAY}"),), c0("x")),
    # Pairs (large brokers' direction, next day's ticks) of the 20 days before: counts over a window instead of loops.
    Feature("f_it_causal_kelly_growth", "cross_broker_tick", "growth by betting on the direction of large brokers", (
        B, ("q", "SELECT *, QUANTILE(vol, 0.8) OVER (PARTITION BY StockId, Date) AS least FROM b WHERE vol > 0"),
        ("n", f"SELECT StockId, Date, CASE WHEN sum(net) > 0 THEN 1 ELSE 0 END AS big FROM q WHERE vol >= least {BY_DAY}"),
        ("u", f"SELECT StockId, Date, CASE WHEN sum(CASE WHEN f = 1 THEN 1 ELSE 0 END) * 1.0 / count(*) > 0.5 THEN 1 ELSE 0 END AS up FROM {{ticks}} {BY_DAY}"),
        ("p", "SELECT u.StockId, u.Date, coalesce(big, 0) AS big, up, lag(coalesce(big, 0)) OVER (PARTITION BY u.StockId ORDER BY u.Date) AS big1 FROM u LEFT JOIN n ON u.StockId = n.StockId AND u.Date = n.Date"),
        ("w", """SELECT StockId, Date, big, count(*) OVER d20 AS days, sum(big) OVER d20 AS bigs, avg(1.0 * up) OVER d19 AS base,
                 sum(CASE WHEN big1 = 1 THEN 1 ELSE 0 END) OVER d19 AS n1, sum(CASE WHEN big1 = 1 THEN up ELSE 0 END) OVER d19 AS u1,
                 sum(CASE WHEN big1 = 0 THEN 1 ELSE 0 END) OVER d19 AS n0, sum(CASE WHEN big1 = 0 THEN up ELSE 0 END) OVER d19 AS u0
              FROM p
              WINDOW d20 AS (PARTITION BY StockId ORDER BY Date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), d19 AS (PARTITION BY StockId ORDER BY Date ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)"""),
        ("d", "SELECT StockId, Date, days, bigs, greatest(0.025, least(0.975, base)) AS base, CASE WHEN big = 1 THEN n1 ELSE n0 END AS seen, CASE WHEN big = 1 THEN u1 ELSE u0 END AS rose FROM w")), (
        ("cond", "sql", "CASE WHEN seen < 2 THEN base ELSE greatest(0.025, least(0.975, (rose + 0.025) / (seen + 0.05))) END"),
        ("x", "sql", "CASE WHEN days = 20 AND bigs BETWEEN 2 AND 18 THEN 2 * (cond - base) END")), ("brokers", "ticks")),
]
