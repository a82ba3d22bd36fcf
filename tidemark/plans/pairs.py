"""Sets of brokers and of seconds, compared; columns of ticks with daily bars; slopes of daily series."""

from __future__ import annotations

from tidemark.plans.brokers import B
from tidemark.plans.columns import csum
from tidemark.plans.feature import Columns, Feature
from tidemark.plans.ladder import CENTS
from tidemark.plans.ticks import BY_DAY, IN_DAY, T
from tidemark.plans.wide import D, S

#: The five leading net buyers of a day, the prices of their fills, and the seconds at which ticks had those prices.
FIVE = (
    ("five", f"SELECT StockId, Date, BrokerId, row_number() OVER (PARTITION BY StockId, Date ORDER BY net DESC, buy DESC, BrokerId) AS rank, count(*) OVER {D} AS traders FROM b"),
    ("prices", f"SELECT DISTINCT f.StockId, f.Date, rank, {CENTS.format('f.Price')} AS cents FROM {{brokers}} AS f JOIN five AS v ON f.StockId = v.StockId AND f.Date = v.Date AND f.BrokerId = v.BrokerId WHERE rank <= 5 AND traders >= 5"),
    ("seconds", f"SELECT DISTINCT StockId, Date, {CENTS.format('p')} AS cents, sec FROM t"),
    ("held", "SELECT DISTINCT a.StockId, a.Date, sec, rank FROM prices AS a JOIN seconds AS s ON a.StockId = s.StockId AND a.Date = s.Date AND a.cents = s.cents"),
    # A second's set of brokers as bits: pairs are counted over seconds, never written out.
    ("bits", "SELECT StockId, Date, sec, CAST(sum(CASE rank WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 8 ELSE 16 END) AS BIGINT) AS bits FROM held GROUP BY StockId, Date, sec"),
)
PAIRS = [((1 << a) | (1 << b)) for a in range(5) for b in range(a)]
SHARED = ("sync", f"SELECT StockId, Date, {', '.join(f'1.0 * count(CASE WHEN (bits & {m}) = {m} THEN 1 END) / nullif(count(CASE WHEN (bits & {m}) <> 0 THEN 1 END), 0) AS j{k}' for k, m in enumerate(PAIRS))} FROM bits {BY_DAY}")
MEAN = f"({' + '.join(f'coalesce(j{k}, 0.0)' for k in range(10))}) / nullif({' + '.join(f'CASE WHEN j{k} IS NULL THEN 0 ELSE 1 END' for k in range(10))}, 0)"
WORK = (
    ("minutes", "SELECT StockId, Date, floor(sec / 60) AS minute, max_by(p, pos) AS last FROM t GROUP BY StockId, Date, floor(sec / 60)"),
    ("steps", "SELECT *, abs(last / nullif(lag(last) OVER (PARTITION BY StockId, Date ORDER BY minute), 0) - 1) AS step FROM minutes"),
    ("path", f"SELECT StockId, Date, coalesce(sum(step), 0.0) AS way FROM steps {BY_DAY}"),
    ("bought", f"SELECT StockId, Date, 1.0 * sum(CASE WHEN rank <= 5 THEN greatest(net, 0) ELSE 0 END) AS five FROM (SELECT b.*, row_number() OVER (PARTITION BY StockId, Date ORDER BY net DESC, buy DESC, BrokerId) AS rank FROM b) AS own {BY_DAY}"),
    ("j", "SELECT x.StockId, x.Date, sync.*EXCEPT, five, coalesce(way, 0.0) AS way FROM bought AS x LEFT JOIN path ON x.StockId = path.StockId AND x.Date = path.Date LEFT JOIN sync ON x.StockId = sync.StockId AND x.Date = sync.Date".replace("sync.*EXCEPT", ", ".join(f"j{k}" for k in range(10)))),
)
SYNC = Columns("raw_sync_columns", "how far leading buyers trade in the same seconds, and what they buy for the price's way", (B, T, *FIVE, SHARED, *WORK), (
    ("raw_broker_sync_intensity", MEAN), ("raw_eth_conservative_work_divergence", "five / (way * 1000.0 + 0.00001)"),
), "j", ("brokers", "ticks"), False)

#: Ticks with the day's open; crossings of the vwap, from below or above, and from below both vwap and open to above both.
OPENED = ("o", "SELECT t.*, open FROM t LEFT JOIN {daily} AS a ON t.StockId = a.StockId AND t.Date = a.Date")
CROSSING = (
    ("x", f"SELECT *, CASE WHEN p >= vwap THEN 1 ELSE 0 END AS above, coalesce(lag(CASE WHEN p >= vwap THEN 1 ELSE 0 END) {IN_DAY}, 0) AS above1, CASE WHEN f = 1 AND pp < least(vwap, open) AND p > greatest(vwap, open) THEN q ELSE 0 END AS both_q FROM o"),
    ("levels", f"SELECT StockId, Date, p, sum(q) AS vol FROM t GROUP BY StockId, Date, p"),
    ("modal", f"SELECT *, first_value(p) OVER (PARTITION BY StockId, Date ORDER BY vol DESC, p) AS mode, max(vol) OVER {D} AS most FROM levels"),
    ("patch", f"SELECT StockId, Date, max(mode) AS mode, 1.0 * max(most) / (sum(vol) + 0.00000001) AS share, 1.0 * {csum('p >= mode * 0.995 AND p <= mode * 1.005', 'vol')} / (sum(vol) + 0.00000001) AS patch FROM modal {BY_DAY}"),
    ("crossed", f"SELECT StockId, Date, count(CASE WHEN above <> above1 THEN 1 END) AS crossings, {csum('above <> above1')} AS crossing_q, sum(both_q) AS both_q, max(vwap) AS vwap FROM x {BY_DAY}"),
    # Whole bins only: 200 ticks for garbled falls, 50 for streams against the spread's opening.
    ("w200", "SELECT StockId, Date, floor(pos / 200) AS bin, sum(p * q) / sum(q) AS mean, count(CASE WHEN f = 1 THEN 1 END) AS buys, count(CASE WHEN f = 0 THEN 1 END) AS sells, sum(q) AS vol FROM t WHERE pos < floor(n / 200) * 200 GROUP BY StockId, Date, floor(pos / 200)"),
    ("g200", "SELECT *, lag(mean) OVER (PARTITION BY StockId, Date ORDER BY bin) AS mean1 FROM w200"),
    ("garbled", f"SELECT StockId, Date, sum(CASE WHEN mean < mean1 THEN vol / (abs(buys - sells) + 0.00001) ELSE 0.0 END) AS garbled FROM g200 {BY_DAY}"),
    ("w50", "SELECT StockId, Date, floor(pos / 50) AS bin, (max(CASE WHEN pos % 50 = 4 THEN ask - bid END) - max(CASE WHEN pos % 50 = 0 THEN ask - bid END)) / 4 * sum(buy - sell) * greatest(max_by(p, pos) - min_by(p, pos), 0) AS stream FROM t WHERE n >= 10 AND pos < floor(n / 50) * 50 GROUP BY StockId, Date, floor(pos / 50)"),
    ("streams", f"SELECT StockId, Date, sum(stream) AS stream FROM w50 {BY_DAY}"),
)
#: Runs of rising days by stock: their length so far and mean volume.
RISES = (
    ("up0", f"SELECT StockId, Date, volume_k, CASE WHEN close > lag(close) OVER ({S}) THEN 1 ELSE 0 END AS up FROM {{daily}}"),
    ("up1", f"SELECT *, sum(1 - up) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM up0"),
    ("up2", "SELECT StockId, Date, up * sum(up) OVER w AS days, CASE WHEN up = 1 THEN 1000.0 * sum(up * volume_k) OVER w / sum(up) OVER w ELSE 0.0 END AS vol FROM up1 WINDOW w AS (PARTITION BY StockId, run ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    ("j", "SELECT a.StockId, a.Date, days, u.vol AS up_vol, crossings, crossing_q, both_q, vwap, mode, share, patch, garbled, stream FROM {daily} AS a JOIN up2 AS u ON a.StockId = u.StockId AND a.Date = u.Date " + " ".join(f"LEFT JOIN {t} ON a.StockId = {t}.StockId AND a.Date = {t}.Date" for t in ("crossed", "patch", "garbled", "streams"))),
)
TICK_DAILY = Columns("raw_tick_daily_columns", "crossings, modal price and bins of ticks, with runs of daily bars", (T, OPENED, *CROSSING, *RISES), (
    ("raw_cross_count", "coalesce(crossings, 0)"), ("raw_cross_vol", "coalesce(crossing_q, 0)"), ("raw_cross_both_vol", "coalesce(both_q, 0)"), ("raw_mode_price", "coalesce(mode, vwap)"), ("raw_patch_thickness", "coalesce(patch, 0.0)"), ("raw_mode_volume_share", "coalesce(share, 0.0)"),
    ("raw_consecutive_up_days", "days"), ("raw_consecutive_up_vol", "up_vol"), ("raw_bin200_garbling_dumping", "coalesce(garbled, 0.0)"), ("raw_riverbend_val", "coalesce(stream, 0.0)"),
), "j", ("ticks", "daily"), False)

#: Net buying of the ten largest buyers, and a day's return, as slopes of the days before.
LEADERS = ("d", f"SELECT StockId, Date, 1.0 * sum(CASE WHEN by_lead <= 10 THEN net ELSE 0 END) AS x FROM (SELECT *, row_number() OVER (PARTITION BY StockId, Date ORDER BY buy DESC, net DESC, BrokerId) AS by_lead FROM b) AS k {BY_DAY}")
RETURNS = ("d", f"SELECT StockId, Date, (max_by(p, pos) - min_by(p, pos)) / (min_by(p, pos) + 0.000000001) AS x FROM {{ticks}} {BY_DAY}")


def slopes(name: str, text: str, queries: tuple, reads: tuple[str, ...]) -> list[Feature]:
    return [Feature(f"raw_{name}_slope_{w}d", "transform", f"slope of {text} over the {w} days before", queries, (("s", "rolling_slope", "x", w), ("late", "shift", "s"), ("value", "filled", "late")), reads) for w in (5, 20)]


FEATURES = slopes("top10_net_buy", "leading net buying", (B, LEADERS), ("brokers",)) + slopes("ret", "returns", (RETURNS,), ("ticks",))

#: A stock's leading brokers of five days: of today's five leading fills by net, how many were among those of the days before.
TOP = (
    ("r", "SELECT StockId, Date, BrokerId, Price, BuyQtm - SellQtm AS net FROM {brokers}"),
    ("k", "SELECT StockId, Date, BrokerId, row_number() OVER (PARTITION BY StockId, Date ORDER BY net DESC, BrokerId, Price) AS rank FROM r"),
    ("top", "SELECT DISTINCT StockId, Date, BrokerId FROM k WHERE rank <= 5"),
    ("o", "SELECT *, dense_rank() OVER (PARTITION BY StockId ORDER BY Date) AS day FROM top"),
    ("hits", "SELECT StockId, Date, day, BrokerId, count(*) OVER (PARTITION BY StockId, BrokerId ORDER BY day RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) AS hits FROM o"),
    ("day_sets", f"SELECT StockId, Date, max(day) AS day, count(*) AS now, sum(hits) AS hits FROM hits {BY_DAY}"),
)
CONSISTENT = Columns("raw_consistency_columns", "leading brokers that led on the five days before", TOP, (("raw_top5_consistency", "CASE WHEN day > 5 THEN hits / 5.0 / now END"),), "day_sets", ("brokers",), False)
#: Today's five largest buyers against all of the four days before. A broker of those days counts once: by its last day before today.
BUYERS = (
    ("lead", "SELECT StockId, Date, BrokerId, dense_rank() OVER (PARTITION BY StockId ORDER BY Date) AS day FROM b WHERE by_buy <= 5"),
    ("around", "SELECT *, lead(day) OVER (PARTITION BY StockId, BrokerId ORDER BY day) AS again, lag(day) OVER (PARTITION BY StockId, BrokerId ORDER BY day) AS before FROM lead"),
    ("past", "SELECT StockId, upon AS day, count(*) AS past FROM (SELECT StockId, explode(sequence(day + 1, least(coalesce(again, day + 4), day + 4))) AS upon FROM around) AS long GROUP BY StockId, upon",
     "SELECT StockId, upon AS day, count(*) AS past FROM (SELECT StockId, unnest(range(day + 1, least(coalesce(again, day + 4), day + 4) + 1)) AS upon FROM around) AS long GROUP BY StockId, upon"),
    ("now", f"SELECT StockId, Date, max(day) AS day, count(*) AS now, count(CASE WHEN day - before <= 4 THEN 1 END) AS hits FROM around {BY_DAY}"),
    ("sets", "SELECT now.StockId, now.Date, now.day, now, hits, coalesce(past, 0) AS past FROM now LEFT JOIN past ON now.StockId = past.StockId AND now.day = past.day"),
)
JACCARD = Columns("raw_jaccard_columns", "leading buyers against those of the four days before", (B, *BUYERS), (("raw_top5_jaccard", "CASE WHEN day > 4 THEN 1.0 * hits / (now + past - hits) END"),), "sets", ("brokers",), False)
CONVICTION = Columns("raw_conviction_columns", "leading buyers' and sellers' quantities", (B, ("k", f"SELECT *, row_number() OVER (PARTITION BY StockId, Date ORDER BY sell DESC, BrokerId) AS by_sell FROM b")), (
    ("_conviction_buyer", csum("by_buy <= 5", "buy")), ("_conviction_seller", csum("by_sell <= 5", "sell")),
), "k", ("brokers",))

TABLES = (SYNC, TICK_DAILY, CONSISTENT, JACCARD, CONVICTION)
