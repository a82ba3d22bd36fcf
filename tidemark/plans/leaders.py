"""Broker features of a stock's days as a whole: chains of states, symmetry of flows, popular against expert brokers."""

from __future__ import annotations

from tidemark.plans.brokers import B, Z20, Z20_FINE, second
from tidemark.plans.dynamics import settled
from tidemark.plans.feature import Feature
from tidemark.plans.ticks import BY_DAY, c5
from tidemark.plans.wide import S

#: Stocks of fewer than five days have no value.
ENOUGH = ("d", "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY StockId) AS days FROM own) AS counted WHERE days >= 5")


def flow(side: str, way: str) -> str:
    """What the five largest brokers, or the others, bought or sold net, and one."""
    return f"1.0 + sum(CASE WHEN by_vol {'<=' if side == 'large' else '>'} 5 THEN greatest({'net' if way == 'in' else '-net'}, 0) ELSE 0 END)"


SYMMETRY = (
    ("flows", f"SELECT StockId, Date, sum(fills) AS entries, {flow('large', 'in')} AS a, {flow('large', 'out')} AS b, {flow('rest', 'in')} AS c, {flow('rest', 'out')} AS e, CASE WHEN sum(fills) > 5 THEN sign(1.0 * sum(CASE WHEN by_buy > 5 THEN buy ELSE 0 END)) ELSE 0.0 END AS tail FROM b {BY_DAY}"),
    ("own", "SELECT StockId, Date, tail, CASE WHEN entries < 3 THEN 0.0 ELSE (a + e + sqrt(power(a - e, 2) + 4 * b * c)) / 2 / (a + b + c + e) END AS value FROM flows"),
    ENOUGH,
)

#: Days as net bought or not; pairs of days in a row as four states; steps between them in frames of 20 states.
FRAME = f"OVER ({S} ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)"
AVALANCHE = (
    ("own", f"SELECT StockId, Date, CASE WHEN sum(fills) >= 3 AND sum(net) > 0 THEN 1 ELSE 0 END AS up FROM b {BY_DAY}"),
    ENOUGH,
    ("pairs", f"SELECT StockId, Date, row_number() OVER ({S}) - 1 AS day, coalesce(2 * lag(up) OVER ({S}) + up, 0) AS s FROM d"),
    ("steps", f"SELECT *, lag(s) OVER ({S}) AS s0 FROM pairs"),
    ("counts", "SELECT StockId, Date, day, " + ", ".join(f"1.0 + count(CASE WHEN s0 = {i} AND s = {j} THEN 1 END) {FRAME} AS k{i}{j}" for i in range(4) for j in range(4)) + " FROM steps"),
    ("chain", "SELECT StockId, Date, day, " + ", ".join(f"k{i}{j} / (k{i}0 + k{i}1 + k{i}2 + k{i}3) AS p{i}{j}" for i in range(4) for j in range(4)) + " FROM counts"),
    ("settled", f"SELECT StockId, Date, CASE WHEN day >= 4 THEN {settled([-1.0, -0.5, 0.5, 1.0])} ELSE 0.0 END AS x FROM chain"),
)

#: A broker's days, each going on until its next one or for 60 days: its volume of 5 days and net buying of 60 by running frames.
#: A row for each broker and day that it goes on: up to 60 for a trade, so this way is only the other engine's.
NUMBERED = ("numbered", "SELECT StockId, Date, BrokerId, net, vol, dense_rank() OVER (PARTITION BY StockId ORDER BY Date) AS day FROM b")
SPANS = ("spans", """SELECT *, max(day) OVER (PARTITION BY StockId) AS last_day, lead(day) OVER (PARTITION BY StockId, BrokerId ORDER BY day) - 1 AS next_day, CASE WHEN day = min(day) OVER (PARTITION BY StockId, BrokerId) THEN 1 ELSE 0 END AS begins FROM numbered""")
EVER = ("ever", "SELECT *, least(coalesce(next_day, last_day), day + 59, last_day) AS until, sum(begins) OVER (PARTITION BY StockId) AS brokers_ FROM spans")
PANEL = ("panel", "SELECT StockId, Date, BrokerId, day, upon, brokers_, CASE WHEN upon = day THEN net ELSE 0 END AS net, CASE WHEN upon = day THEN vol ELSE 0 END AS vol FROM (SELECT *, unnest(range(day, until + 1)) AS upon FROM ever) AS long")
SUMS = ("sums", "SELECT *, sum(vol) OVER (PARTITION BY StockId, BrokerId ORDER BY upon RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS vol5, sum(net) OVER (PARTITION BY StockId, BrokerId ORDER BY upon RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS net60 FROM panel")
POPULAR = ("popular", "SELECT *, row_number() OVER (PARTITION BY StockId, upon ORDER BY vol5 DESC, BrokerId) AS by_vol5, brokers_ - count(*) OVER (PARTITION BY StockId, upon) AS away FROM sums")
EXPERT = ("expert", "SELECT *, row_number() OVER (PARTITION BY StockId, upon, CASE WHEN by_vol5 <= 3 THEN 0 ELSE 1 END ORDER BY net60 DESC, BrokerId) AS by_net60 FROM popular")
#: Brokers without a trade in 60 days have a sum of zero: they come before those that sold.
AGAINST = ("sides", "SELECT StockId, upon, max(CASE WHEN upon = day THEN Date END) AS Date, 1.0 * sum(CASE WHEN by_vol5 <= 3 THEN net ELSE 0 END) AS popular, 1.0 * sum(CASE WHEN by_vol5 > 3 AND by_net60 + CASE WHEN net60 < 0 THEN away ELSE 0 END <= 3 THEN net ELSE 0 END) AS expert FROM expert GROUP BY StockId, upon")


def rows(names: list[str], *values: list[str]) -> str:
    """Several rows made of each row."""
    return f"LATERAL VIEW inline(array({', '.join('struct(' + ', '.join(f'{v} AS {n}' for n, v in zip(names, row)) + ')' for row in values)})) AS {', '.join(names)}"


#: The same in Spark without a row for each day that a broker goes on. A broker's sums change at its trades, and 5 and 60 days after
#: them; in between it has spells of the same sums. A spell is covered by two pieces of a power of two of days, whose second counts from
#: where the first ends. The six best of the pieces that have the same days are all that can be among a day's six best, and so among its three
#: best after the popular: only these become rows of days. Dealt by stock once: all windows are of a stock's rows. Null quantities are none.
DEALT = ("dealt", """SELECT StockId, Date, BrokerId, coalesce(net, 0) AS net, coalesce(vol, 0) AS vol, dense_rank() OVER w AS day, CASE WHEN lag(Date) OVER w = Date THEN 0 ELSE 1 END AS opens,
    count(CASE WHEN vol > 0 THEN 1 END) OVER (PARTITION BY StockId ORDER BY Date RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS busy
    FROM (SELECT /*+ REPARTITION({parts}, StockId) */ StockId, Date, BrokerId, net, vol FROM b) AS own WINDOW w AS (PARTITION BY StockId ORDER BY Date)""")
#: If on all days of a stock three brokers trade, and none less than nothing, those without volume in five days are never popular.
CROWD = ("crowd", "SELECT *, max(day) OVER s AS last_day, min(CASE WHEN vol < 0 THEN 0 ELSE busy END) OVER s AS least FROM dealt WINDOW s AS (PARTITION BY StockId)")
MARKS = ("marks", f"""SELECT StockId, Date, BrokerId, opens, last_day, least, upon, event, more_net, more_vol, more_held FROM crowd
    {rows(['upon', 'event', 'more_net', 'more_vol', 'more_held'], ['day', '1', 'net', 'vol', '1'], ['day + 5', '0', '0L', '-vol', '0'], ['day + 60', '0', '-net', '0L', '-1'])}
    WHERE upon <= last_day""")
#: Sums to six digits after the point: what was added and taken away again leaves nothing, in doubles too.
SPELLS = ("spells", """SELECT StockId, BrokerId, least, upon, more_held, CASE WHEN event = 1 AND opens = 1 THEN Date END AS opened, CASE WHEN event = 1 THEN more_net ELSE 0 END AS net,
    round(sum(more_vol) OVER r, 6) AS vol5, round(sum(more_net) OVER r, 6) AS net60, sum(more_held) OVER r AS held, coalesce(lead(upon) OVER r - 1, last_day) AS until,
    CASE WHEN more_held <> 0 THEN coalesce(lead(CASE WHEN more_held <> 0 THEN upon END IGNORE NULLS) OVER r - 1, last_day) END AS until60, CASE WHEN lag(upon) OVER r IS NULL THEN 1 ELSE 0 END AS begins
    FROM marks WINDOW r AS (PARTITION BY BrokerId, StockId ORDER BY upon, event)""")
WIDTHS = ("widths", """SELECT *, shiftleft(1, length(bin(until - upon + 1)) - 1) AS wide, shiftleft(1, length(bin(until60 - upon + 1)) - 1) AS wide60,
    CASE WHEN more_held = 1 AND held = 1 THEN 1 WHEN more_held = -1 AND held = 0 THEN -1 ELSE 0 END AS comes FROM spells""")
#: Kind 0: volume of 5 days; 1: net buying of 60; 2: a day's date, and how many brokers come to trade or have not for 60 days.
PIECES = ("pieces", f"""SELECT StockId, CASE WHEN kind < 2 THEN BrokerId END AS BrokerId, upon, net, opened, comes, begins, kind, (start * 64 + width) * 4 + kind AS same, fresh, start + width - 1 AS through, value FROM widths
    {rows(['kind', 'start', 'width', 'fresh', 'value'], *([k, *at, v] for k, v, w, u in (('0', 'vol5', 'wide', 'until'), ('1', 'net60', 'wide60', 'until60')) for at in (('upon', w, 'upon'), (f'{u} - {w} + 1', w, f'upon + {w}'))), ['2', 'upon', '1', 'upon', '0L'])}
    WHERE CASE WHEN kind = 2 THEN opened IS NOT NULL OR comes <> 0 WHEN kind = 1 THEN held > 0 AND until60 >= upon AND fresh <= until60 ELSE held > 0 AND until >= upon AND fresh <= until AND (vol5 > 0 OR least < 3) END""")
#: Rows of kind 2 are all first.
BEST = ("best", "SELECT * FROM (SELECT *, rank() OVER (PARTITION BY same, StockId ORDER BY value DESC, BrokerId) AS place FROM pieces) AS placed WHERE place <= 6 AND place <= 3 + 3 * kind")
LONG = ("long", "SELECT StockId, BrokerId, opened, comes, begins, kind, value, day, CASE WHEN day = upon THEN net ELSE 0 END AS net FROM best LATERAL VIEW explode(sequence(fresh, through)) AS day")
RANKED = ("ranked", "SELECT *, row_number() OVER (PARTITION BY day, StockId, kind ORDER BY value DESC, BrokerId) AS place FROM long")
LEADERS = ("leaders", """SELECT *, array_contains(collect_list(CASE WHEN kind = 0 THEN struct(BrokerId) END) OVER (PARTITION BY day, StockId), struct(BrokerId)) AS is_popular
    FROM ranked WHERE kind = 2 OR place <= 3 + 3 * kind""")
NET60 = ("net60", "SELECT *, sum(CASE WHEN kind = 1 AND NOT is_popular THEN 1 ELSE 0 END) OVER (PARTITION BY day, StockId ORDER BY kind, value DESC, BrokerId ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS by_net60 FROM leaders")
BY_SIDE = ("by_side", f"""SELECT StockId, day, max(CASE WHEN kind = 2 THEN opened END) AS Date, sum(CASE WHEN kind = 2 THEN comes ELSE 0 END) AS comes, sum(CASE WHEN kind = 2 THEN begins ELSE 0 END) AS begins, sum(CASE WHEN kind = 0 THEN net ELSE 0 END) AS popular,
    sum(CASE WHEN kind = 1 AND NOT is_popular AND by_net60 <= 3 AND value >= 0 THEN net ELSE 0 END) AS gathered,
    {', '.join(f'sum(CASE WHEN kind = 1 AND NOT is_popular AND by_net60 = {k} AND value < 0 THEN net ELSE 0 END) AS sold{k}' for k in (1, 2, 3))} FROM net60 GROUP BY StockId, day""")
AWAY = ("away", "SELECT *, sum(begins) OVER (PARTITION BY StockId ORDER BY Date RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - sum(comes) OVER w AS away FROM by_side WINDOW w AS (PARTITION BY StockId ORDER BY Date)")
#: Brokers without a trade in 60 days have a sum of zero: they come before those that sold.
SIDES = ("sides", f"SELECT StockId, Date, 1.0 * popular AS popular, 1.0 * (gathered + {' + '.join(f'CASE WHEN {k} + away <= 3 THEN sold{k} ELSE 0 END' for k in (1, 2, 3))}) AS expert FROM away")

DIVERGED = ("d", "SELECT StockId, Date, CASE WHEN popular > 0 AND expert < 0 THEN abs(popular - expert) ELSE 0.0 END AS x FROM sides")

FEATURES = [
    Feature("f_nld_symmetry_restoring_eigen", "broker_only", "curvature of the leading eigenvalue of large and small brokers' flows", (B, *SYMMETRY), (
        *second("value"), ("x", "sql", "coalesce(d2 * max_by(tail, Date) OVER (PARTITION BY StockId), 0.0)"), *Z20_FINE, *c5("z")), ("brokers",)),
    Feature("f_nld_avalanche_markov_eigen_proj", "broker_only", "where 20 days' pairs of net bought and sold days settle", (B, *AVALANCHE), (*Z20_FINE, *c5("z")), ("brokers",)),
    Feature("f_gt_expert_vs_popular_divergence", "single_stock_broker", "popular brokers buy while those that gathered most sell", (B, DEALT, CROWD, MARKS, SPELLS, WIDTHS, PIECES, BEST, LONG, RANKED, LEADERS, NET60, BY_SIDE, AWAY, SIDES, DIVERGED),
        (*Z20, *c5("z")), ("brokers",), (B, NUMBERED, SPANS, EVER, PANEL, SUMS, POPULAR, EXPERT, AGAINST, DIVERGED)),
]
