"""The inputs as SQL: {lineitem} is the driver's table, {ticks} the result of TICKS. Spark and DuckDB both run it."""

from __future__ import annotations

import re

_DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


def doubles(text: str) -> str:
    """Numbers with a point are decimals to either engine; all here are meant as doubles."""
    return _DECIMAL.sub(r"\1e0", text)


#: A thousand parts are a stock, so that stocks grow in number with the table; a month's trades are one day's ticks. Ties in the order are rows that are equal in all that is used.
TICKS = doubles("""
SELECT StockId, Date, sec, p, q, f, broker, mix, p - 1.0 - 0.5 * ((sec + q) % 3) AS bid, p + 1.0 + 0.5 * (sec % 4) AS ask, 10.0 + (Date / 100 % 80) * 1.0 AS ref,
       CAST(sum(q) OVER w AS BIGINT) AS total_qty, row_number() OVER w - 1 AS pos
FROM (SELECT concat('S', CAST(floor(l_partkey / 1000) AS BIGINT)) AS StockId,
             CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + 1 AS BIGINT) AS Date,
             32400 + (l_orderkey * 31 + l_linenumber * 7919 + l_partkey * 131 + l_suppkey * 17) % 16200 AS sec,
             10.0 + CAST(round(100 * l_extendedprice / l_quantity) AS BIGINT) % 90 AS p,
             CAST(l_quantity AS BIGINT) AS q,
             CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 ELSE 2 END AS f,
             concat('B', 1000 + l_suppkey) AS broker,
             (l_orderkey * 7 + l_linenumber * 3 + l_suppkey) % 3 AS mix
      FROM {lineitem}) AS trade
WINDOW w AS (PARTITION BY StockId, Date ORDER BY sec, p, q, f, broker, mix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")

#: The same with a quarter's trades as one day's: days of a thousand ticks, for what needs many bins of a day.
QUARTERS = TICKS.replace("month(l_shipdate) * 100", "(floor((month(l_shipdate) - 1) / 3) * 3 + 1) * 100")

#: Daily bars of the same ticks; the columns that ticks do not give are mixes of the keys, with nulls.
DAILY = doubles("""
SELECT StockId, Date, open, high, low, close, volume_k, 9000.0 + 500.0 * (Date % 7) AS shares_out_k,
       CASE WHEN m % 11 = 0 THEN NULL ELSE 1.0 * (m % 60) END AS daytrade_pct, 100.0 * (close - open) / open AS ret_pct,
       volume_k * 1000.0 * (open + close) / 2 AS turnover_value,
       CASE WHEN m % 6 = 0 THEN NULL ELSE 40.0 + m % 70 END AS short_balance_k, CASE WHEN m % 8 = 0 THEN NULL ELSE 300.0 + m % 200 END AS margin_balance_k,
       CASE WHEN m % 10 = 0 THEN NULL ELSE 1.0 * (m % 35) END AS lending_short_k, CASE WHEN m % 4 = 0 THEN NULL ELSE m % 90 - 45.0 END AS inst_foreign,
       CASE WHEN m % 5 = 0 THEN NULL ELSE m % 50 - 25.0 END AS inst_trust, m % 20 - 10.0 AS inst_dealer_self, m % 16 - 8.0 AS inst_dealer_hedge,
       CASE WHEN m % 7 = 0 THEN NULL ELSE 5000.0 + m END AS holder_lt400_count, CASE WHEN m % 9 = 0 THEN NULL ELSE 1000.0 + 3 * m END AS rev_m1_k, 900.0 + 2 * (m % 300) AS rev_m13_k,
       CASE WHEN m % 3 = 0 THEN NULL ELSE 20.0 + m % 50 END AS holder_gt1000_pct,
       CASE WHEN m % 13 = 0 THEN NULL ELSE 5.0 + m % 30 END AS pe, 1.0 + (m % 40) / 10.0 AS pb, 0.5 + (m % 25) / 10.0 AS ps, (m % 9) * 1.0 AS div_yield
FROM (SELECT StockId, Date, min_by(p, pos) AS open, max(p) AS high, min(p) AS low, max_by(p, pos) AS close, CAST(sum(q) AS DOUBLE) AS volume_k,
             CAST((sum(sec) + sum(q) * 7) % 997 AS BIGINT) AS m
      FROM {ticks} GROUP BY StockId, Date) AS bar
""")

#: Broker fills by price: two of three trades count as bought, two of three as sold.
BROKERS = """
SELECT StockId, Date, broker AS BrokerId, p AS Price, CAST(sum(CASE WHEN mix <> 0 THEN q ELSE 0 END) AS BIGINT) AS BuyQtm,
       CAST(sum(CASE WHEN mix <> 1 THEN q ELSE 0 END) AS BIGINT) AS SellQtm
FROM {ticks} GROUP BY StockId, Date, broker, p
"""
