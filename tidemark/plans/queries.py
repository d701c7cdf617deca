"""The engine's queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeline import DAY, MICROS, utc_date
from tidemark.operators import coverage, detect, evaluate, journal, outcomes, paper
from tidemark.sources import market, wire
from tidemark.sources.store import shared_table

WINDOW = 6 * 3600
HORIZON, LAG, TARGET = 6 * 3600, 2 * 3600, 1.0
MULTIPLES, RATES, THRESHOLDS, WALL = [2.0, 3.0], [1.5, 2.0], [0.4, 0.8], 50_000.0
TUNING_END, VALIDATION_START = "2024-01-16", "2024-01-17"
START = 1_705_449_600 * MICROS  # 2024-01-17
END = START + 14 * DAY * MICROS
ROUND_TRIP, SEED, ITERATIONS, COOLDOWN = 0.16, 42, 10_000, 4 * 3600

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# ---- SQL shared by the oracles: plain windows over whole markets, as if there were no blocks
_T = """t AS (SELECT event_type AS market, epoch_us(ts) AS ts, event_id AS seq, value AS price, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
  CAST(value AS DECIMAL(18,2)) AS notional FROM events)"""
_B = """sides AS (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'N') AS ask, sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_returnflag <> 'N') AS bid,
  coalesce(max(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), 0.0::DOUBLE) AS ask_wall, coalesce(max(l_extendedprice) FILTER (WHERE l_returnflag <> 'N'), 0.0::DOUBLE) AS bid_wall FROM lineitem GROUP BY 1),
b AS (SELECT o_orderpriority AS market, epoch_us(o_orderdate) AS ts, o_orderkey AS seq, CAST(coalesce(ask, 0) AS DOUBLE) AS ask, CAST(coalesce(bid, 0) AS DOUBLE) AS bid, ask_wall, bid_wall
  FROM orders LEFT JOIN sides ON o_orderkey = l_orderkey)"""
_PW = f"""pw AS (SELECT t.*, count(*) OVER r - count(*) OVER p + count(*) OVER e AS n,
  CAST(coalesce(sum(notional) OVER r, 0) - coalesce(sum(notional) OVER p, 0) + coalesce(sum(notional) OVER e, 0) AS DECIMAL(38,2)) AS total FROM t
  WINDOW r AS (PARTITION BY market ORDER BY ts RANGE BETWEEN {WINDOW * MICROS} PRECEDING AND CURRENT ROW), p AS (PARTITION BY market, ts),
  e AS (PARTITION BY market, ts ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pb AS (SELECT *, CAST(total AS DOUBLE) / greatest(n, 1) AS baseline FROM pw)"""


def _rules(kind: str, values: list[float]) -> str:
    return ", ".join(f"('{kind}-{v:g}', {v!r}::DOUBLE)" for v in values)


def _fires(name: str, source: str, kind: str, values: list[float], active: str) -> str:
    return f"""{name}_a AS (SELECT *, coalesce({active}, false) AS active FROM {source}, (VALUES {_rules(kind, values)}) r(rule_id, lim)),
{name}_f AS (SELECT * FROM (SELECT *, lag(active, 1, false) OVER (PARTITION BY market, rule_id ORDER BY ts, seq) AS was FROM {name}_a) WHERE active AND NOT was)"""


_LARGE = _fires("large", "pb", "large", MULTIPLES, "n >= 5 AND CAST(notional AS DOUBLE) > baseline * lim") + """,
large AS (SELECT market, ts, seq, 'large_aggressive_trade' AS signal_type, rule_id, side AS direction, CAST(notional AS DOUBLE) AS feature_value, baseline FROM large_f)"""
_RATE = _fires("rate", "pb", "rate", RATES, f"n >= 5 AND n / {float(WINDOW)!r}::DOUBLE > ({5 / WINDOW!r}::DOUBLE * lim)") + f""",
rate AS (SELECT market, ts, seq, 'trade_rate_acceleration' AS signal_type, rule_id, side AS direction, n / {float(WINDOW)!r}::DOUBLE AS feature_value, {5 / WINDOW!r}::DOUBLE AS baseline FROM rate_f)"""
_IMB = "bi AS (SELECT *, CASE WHEN ask + bid > 0 THEN (bid - ask) / (bid + ask) END AS im FROM b),\n" + _fires("imb", "bi", "imbalance", THRESHOLDS, "abs(im) >= lim") + """,
imb AS (SELECT market, ts, seq, 'orderbook_imbalance' AS signal_type, rule_id, CASE WHEN im > 0 THEN 'buy' ELSE 'sell' END AS direction, im AS feature_value, 0.0::DOUBLE AS baseline FROM imb_f)"""
_WALL = f"""bw AS (SELECT *, CASE WHEN ask_wall IS NULL THEN NULL ELSE greatest(ask_wall, bid_wall) END AS wall, CASE WHEN ask_wall > bid_wall THEN 'sell' ELSE 'buy' END AS wall_side FROM b),
bl AS (SELECT *, lag(wall) OVER w AS old, lag(wall_side) OVER w AS old_side FROM bw WINDOW w AS (PARTITION BY market ORDER BY ts, seq)),
wall AS (SELECT market, ts, seq, 'wall_disappearance' AS signal_type, 'wall-drop' AS rule_id, old_side AS direction, wall AS feature_value, old AS baseline FROM bl WHERE old >= {WALL!r} AND wall < old * 0.2::DOUBLE)"""
_S = f"{_T},\n{_PW},\n{_LARGE},\n{_RATE},\nsig AS (SELECT * FROM large UNION ALL SELECT * FROM rate)"


def _outcome(name: str, source: str, at: str = "ts") -> str:
    """Outcome columns of ``source`` rows (market, direction) at the time ``at``."""
    return f"""{name}_x AS (SELECT *, {at} AS at0, {at} + {HORIZON * MICROS} AS at1, row_number() OVER () AS rid FROM {source}),
ft AS MATERIALIZED (SELECT market, ts, min_by(price, seq) AS price FROM t GROUP BY 1, 2),
{name}_e AS (SELECT x.*, f.ts AS e_ts, CASE WHEN f.ts <= at0 + {LAG * MICROS} THEN f.price END AS entry_price FROM {name}_x x ASOF LEFT JOIN ft f ON x.market = f.market AND f.ts >= x.at0),
{name}_h AS (SELECT x.*, f.ts AS exit_ts, f.price AS horizon_price FROM {name}_e x ASOF LEFT JOIN ft f ON x.market = f.market AND f.ts >= x.at1),
{name}_r AS (SELECT rid, min(t.price) AS low, max(t.price) AS high FROM {name}_h x JOIN t ON x.market = t.market AND t.ts BETWEEN x.e_ts AND x.at1 WHERE entry_price IS NOT NULL GROUP BY 1),
{name} AS (SELECT x.*, entry_price IS NOT NULL AND horizon_price IS NOT NULL AS complete, CASE WHEN entry_price IS NOT NULL AND horizon_price IS NOT NULL THEN
  coalesce(CASE WHEN direction = 'buy' THEN (high / entry_price - 1) * 100 >= {TARGET} ELSE (entry_price / low - 1) * 100 >= {TARGET} END, false) END AS reached_target
  FROM {name}_h x LEFT JOIN {name}_r USING (rid))"""


def _dates(sql: str) -> str:
    return f"(SELECT DISTINCT CAST(make_timestamp(ts) AS DATE) AS date FROM ({sql}))"


def _draw(size: str, *parts: str) -> str:
    return f"(CAST('0x' || md5(concat_ws('|', {', '.join(parts)}))[1:15] AS BIGINT) % ({size}))"


_O = f"{_S},\n{_outcome('o', 'sig')}"
_POOL = f"""lt AS (SELECT market, max(ts) AS last_ts FROM t GROUP BY 1),
pool AS (SELECT market, CAST(make_timestamp(ts) AS DATE) AS date, count(*) AS pool_n FROM t JOIN lt USING (market) WHERE ts <= last_ts - {HORIZON * MICROS} GROUP BY 1, 2)"""
_PAIRS = f"""{_O},
{_POOL},
nt AS (SELECT market, CAST(make_timestamp(ts) AS DATE) AS date, ts AS control_ts, row_number() OVER (PARTITION BY market, CAST(make_timestamp(ts) AS DATE) ORDER BY ts, seq) - 1 AS nth FROM t),
drawn AS (SELECT o.market, o.ts, o.seq, o.signal_type, o.rule_id, o.direction, o.reached_target AS hit, pool.date, {_draw('pool_n', str(SEED), f"CASE WHEN pool.date <= DATE '{TUNING_END}' THEN 'train' ELSE 'validation' END", "signal_type || ':' || rule_id", 'o.market', 'o.ts', 'o.seq')} AS nth
  FROM o JOIN pool ON o.market = pool.market AND CAST(make_timestamp(o.ts) AS DATE) = pool.date WHERE complete),
cs AS (SELECT drawn.*, control_ts FROM drawn JOIN nt USING (market, date, nth)),
{_outcome('c', 'cs', 'control_ts').replace('ft AS MATERIALIZED (SELECT market, ts, min_by(price, seq) AS price FROM t GROUP BY 1, 2),', '')},
pairs AS (SELECT market, ts, seq, signal_type, rule_id, date, hit, coalesce(reached_target, false) AS control, signal_type || ':' || rule_id AS rule_key FROM c)"""
_CAND = f"""{_PAIRS},
tr AS (SELECT rule_key, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE control) AS control_hits FROM pairs WHERE date <= DATE '{TUNING_END}' GROUP BY 1),
cand AS (SELECT signal_type, k.rule_key, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, coalesce(control_hits, 0) AS control_hits, coalesce(hits, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS hit_rate,
  coalesce(control_hits, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS control_rate FROM (SELECT DISTINCT signal_type, signal_type || ':' || rule_id AS rule_key FROM sig) k LEFT JOIN tr ON k.rule_key = tr.rule_key),
candl AS (SELECT *, hit_rate - control_rate AS lift FROM cand),
sel AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY signal_type ORDER BY lift DESC, n DESC, rule_key) AS place FROM candl) WHERE place = 1)"""
_GATE = f"""{_CAND},
vp AS MATERIALIZED (SELECT p.*, CAST(hit AS INT) - CAST(control AS INT) AS d FROM pairs p JOIN (SELECT rule_key FROM sel) USING (rule_key) WHERE date >= DATE '{VALIDATION_START}'),
st AS MATERIALIZED (SELECT *, count(*) OVER () AS family FROM (SELECT rule_key, count(*) AS val_n, avg(CAST(hit AS INT)) AS val_rate, avg(CAST(control AS INT)) AS val_control, count(*) FILTER (WHERE d = 1) AS plus, count(*) FILTER (WHERE d = -1) AS minus FROM vp GROUP BY 1)),
tri AS (SELECT *, val_n - plus - minus AS rest, val_n - x - y AS z FROM (SELECT *, unnest(range(val_n - x + 1)) AS y FROM (SELECT rule_key, val_n, plus, minus, unnest(range(val_n + 1)) AS x FROM st))),
pm AS (SELECT rule_key, x - y AS d, sum(exp(lgamma(val_n + 1) - lgamma(x + 1) - lgamma(y + 1) - lgamma(z + 1) + CASE WHEN x = 0 THEN 0 ELSE x * ln(plus / val_n) END + CASE WHEN y = 0 THEN 0 ELSE y * ln(minus / val_n) END + CASE WHEN z = 0 THEN 0 ELSE z * ln(rest / val_n) END)) AS mass
  FROM tri WHERE (x = 0 OR plus > 0) AND (y = 0 OR minus > 0) AND (z = 0 OR rest > 0) GROUP BY 1, 2),
cd AS (SELECT rule_key, v, min(d) AS d FROM (SELECT rule_key, d, sum(mass) OVER (PARTITION BY rule_key ORDER BY d) / sum(mass) OVER (PARTITION BY rule_key) AS v FROM pm) GROUP BY 1, 2),
dr AS (SELECT rule_key, val_n, b, ({_draw('1152921504606846976', str(SEED), "'bootstrap'", 'rule_key', 'b')} + 0.5::DOUBLE) / 1152921504606846976::DOUBLE AS u FROM (SELECT rule_key, val_n, unnest(range({ITERATIONS})) AS b FROM st)),
bs AS (SELECT dr.rule_key, b, cd.d / CAST(val_n AS DOUBLE) AS stat FROM dr ASOF JOIN cd ON dr.rule_key = cd.rule_key AND dr.u <= cd.v),
bo AS (SELECT *, row_number() OVER (PARTITION BY rule_key ORDER BY stat, b) - 1 AS k FROM bs),
ci AS (SELECT rule_key, max(stat) FILTER (WHERE k = floor({ITERATIONS - 1} * (0.025::DOUBLE / family))) AS ci_low, max(stat) FILTER (WHERE k = floor({ITERATIONS - 1} * (1 - 0.025::DOUBLE / family))) AS ci_high FROM bo JOIN st USING (rule_key) GROUP BY 1),
gt AS (SELECT signal_type, sel.rule_key, coalesce(val_n, 0) AS val_n, coalesce(val_rate, 0) AS val_rate, coalesce(val_control, 0) AS val_control,
  CASE WHEN hit_rate > 0 THEN coalesce(val_rate, 0) / hit_rate ELSE 0 END AS retention, coalesce(ci_low, 0) AS ci_low, coalesce(ci_high, 0) AS ci_high FROM sel LEFT JOIN st USING (rule_key) LEFT JOIN ci USING (rule_key))"""
_COOL = f"""{_S.replace('WITH ', '')},
cr AS (SELECT *, row_number() OVER (PARTITION BY market, rule_id ORDER BY ts, seq) AS k FROM sig),
cf AS (SELECT cr.*, ts AS last, true AS emitted FROM cr WHERE k = 1 UNION ALL
  SELECT cr.*, CASE WHEN cr.ts >= cf.last + {COOLDOWN * MICROS} THEN cr.ts ELSE cf.last END, cr.ts >= cf.last + {COOLDOWN * MICROS} FROM cf JOIN cr ON cr.market = cf.market AND cr.rule_id = cf.rule_id AND cr.k = cf.k + 1)"""
_PAPER = f"""{_O},
po AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ts, signal_type, rule_id, seq) AS k FROM o WHERE ts >= {START} AND ts < {END}),
pf AS (SELECT po.*, CASE WHEN complete THEN exit_ts END AS busy, CASE WHEN complete THEN 'filled' ELSE 'incomplete' END AS state FROM po WHERE k = 1 UNION ALL
  SELECT po.*, CASE WHEN po.ts < coalesce(pf.busy, po.ts) OR NOT po.complete THEN pf.busy ELSE po.exit_ts END, CASE WHEN po.ts < coalesce(pf.busy, po.ts) THEN 'skipped' WHEN NOT po.complete THEN 'incomplete' ELSE 'filled' END
  FROM pf JOIN po ON po.market = pf.market AND po.k = pf.k + 1),
pt AS (SELECT market, ts, signal_type, rule_id, seq, direction, entry_price, horizon_price, complete, exit_ts, state, CASE WHEN state = 'filled' THEN CASE WHEN direction = 'buy' THEN (horizon_price / entry_price - 1) * 100 ELSE (entry_price / horizon_price - 1) * 100 END - {ROUND_TRIP} END AS net_pct FROM pf)"""
_TALLY = """count(*) FILTER (WHERE state = 'filled') AS trades, count(*) FILTER (WHERE state = 'skipped') AS skipped, count(*) FILTER (WHERE state = 'incomplete') AS incomplete,
  count(*) FILTER (WHERE state = 'filled' AND net_pct > 0) AS wins, coalesce(round(avg(net_pct), 6), 0) AS mean_net_pct, coalesce(round((product(1 + net_pct / 100) - 1) * 100, 6), 0) AS return_pct"""
_HOLD = f"""hd AS (SELECT market, first_price, last_price, round((last_price / first_price - 1) * 100 - {ROUND_TRIP}, 6) AS hold_pct FROM (SELECT market, arg_min(price, (ts, seq)) AS first_price, arg_max(price, (ts, seq)) AS last_price
  FROM t WHERE ts >= {START} AND ts < {END} GROUP BY 1)),
bm AS (SELECT hd.*, coalesce(trades, 0) AS trades, coalesce(skipped, 0) AS skipped, coalesce(incomplete, 0) AS incomplete, coalesce(wins, 0) AS wins, coalesce(mean_net_pct, 0) AS mean_net_pct, coalesce(return_pct, 0) AS return_pct
  FROM hd LEFT JOIN (SELECT market, {_TALLY} FROM pt GROUP BY 1) USING (market)),
bx AS (SELECT *, round(return_pct - hold_pct, 6) AS excess_pct FROM bm)"""


def _query(sql: str, recursive: bool = False, date: str = ""):
    """Register a query and its SQL; a ``date`` column is returned as text by both."""

    def add(f: Query) -> Query:
        whole = sql if sql.lstrip().upper().startswith(("WITH", "SELECT")) else f"WITH {'RECURSIVE ' * recursive}{sql}"
        QUERIES[f.__name__] = (lambda spark, sf: f(spark, sf).withColumn(date, F.col(date).cast("string"))) if date else f
        ORACLES[f.__name__] = f"SELECT * REPLACE (CAST({date} AS VARCHAR) AS {date}) FROM ({whole})" if date else whole
        return f

    return add


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    large, rate = detect.trade_signals(market.trades(spark, sf), MULTIPLES, RATES, WINDOW)
    return shared_table(large.unionByName(rate).select(detect.SIGNAL), "signals")


def _books(spark: SparkSession, sf: str) -> DataFrame:
    """Books joined once, for what reads them several times."""
    return shared_table(market.books(spark, sf), "books")


def _done(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.outcomes(_signals(spark, sf), market.trades(spark, sf), HORIZON, LAG, TARGET)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return shared_table(evaluate.control_pairs(_done(spark, sf), market.trades(spark, sf), HORIZON, LAG, TARGET, SEED, TUNING_END), "pairs")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return shared_table(evaluate.candidates(_signals(spark, sf), _pairs(spark, sf), TUNING_END), "candidates")


#: Every event as a row of the connection journal; its market's name gives the state.
STATES = {"error": "disconnected", "click": "connected", "view": "stalled"}


def _connections(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    state = F.coalesce(F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))[F.col("event_type")], F.lit("reconnect"))
    return events.select(F.lit("ALL").alias("market"), market.micros("ts").alias("ts"), state.alias("state"), (F.col("event_id") % 997).alias("gap_ms"))


_CONN = f"""conn AS (SELECT epoch_us(ts) AS ts, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items())} ELSE 'reconnect' END AS state, event_id % 997 AS gap_ms FROM events)"""


@_query(f"""{_S}, {_B}, {_CONN}, u AS (SELECT ts, 'trade' AS kind, market, NULL AS state, NULL::BIGINT AS gap_ms FROM t UNION ALL SELECT ts, 'book', market, NULL, NULL FROM b UNION ALL SELECT ts, 'signal', market, NULL, NULL FROM sig
 UNION ALL SELECT ts, 'event', 'ALL', state, gap_ms FROM conn)
SELECT CAST(make_timestamp(ts) AS DATE) AS date, count(*) FILTER (WHERE kind = 'trade') AS trades, count(*) FILTER (WHERE kind = 'book') AS books, count(*) FILTER (WHERE kind = 'signal') AS signals,
 count(DISTINCT market) FILTER (WHERE kind IN ('trade', 'book')) AS markets, count(*) FILTER (WHERE state = 'disconnected') AS disconnected, count(*) FILTER (WHERE state = 'stalled') AS stalled, CAST(coalesce(sum(gap_ms) FILTER (WHERE state = 'connected'), 0) AS BIGINT) AS gap_ms,
 coalesce(max(gap_ms) FILTER (WHERE state = 'connected'), 0) AS max_gap_ms FROM u GROUP BY 1""", date="date")
def coverage_daily(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.daily(market.trades(spark, sf), market.books(spark, sf), _signals(spark, sf), _connections(spark, sf))


@_query(f"{_T}, {_B} SELECT count(DISTINCT ts // {MICROS}) AS observed_seconds FROM (SELECT ts FROM t UNION ALL SELECT ts FROM b)")
def observed_seconds(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.observed_seconds(market.trades(spark, sf), market.books(spark, sf))


_PRESENT = f"""{_T}, {_B}, present AS {_dates("SELECT ts FROM t UNION ALL SELECT ts FROM b")}, req AS (SELECT CAST(unnest(generate_series(max(date) - INTERVAL 399 DAY, max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM present)"""


def _present(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.dates(market.trades(spark, sf), market.books(spark, sf))


@_query(f"{_PRESENT} SELECT 400 AS required, max(req.date) AS end_date, count(p.date) AS present, count(*) - count(p.date) AS missing FROM req LEFT JOIN present p USING (date)", date="end_date")
def date_status(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.date_status(_present(spark, sf), 400)


@_query(f"{_PRESENT} SELECT date FROM req ANTI JOIN present USING (date)", date="date")
def missing_dates(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.missing_dates(_present(spark, sf), 400)


@_query("WITH v AS (SELECT event_type AS market, sum(CAST(value AS DECIMAL(18,2))) AS volume, min(event_id) AS ordinal FROM events GROUP BY 1) SELECT market, CAST(volume AS DOUBLE) AS volume, ordinal FROM v WHERE market LIKE '%e%' ORDER BY volume DESC, ordinal LIMIT 3")
def universe_topk(spark: SparkSession, sf: str) -> DataFrame:
    t = market.trades(spark, sf).groupBy("market").agg(F.sum("notional").cast("double").alias("volume"), F.min("seq").alias("ordinal"))
    return wire.universe(t.where(F.col("market").contains("e")), 3)


STALL, CONNECTION = 1_200, 3 * DAY
_EPOCHS = f"""ar AS (SELECT epoch_us(ts) AS ts, epoch_us(ts) // {CONNECTION * MICROS} AS epoch FROM events),
ep AS (SELECT *, lag(last) OVER w AS before, lead(first) OVER w AS after FROM (SELECT epoch, min(ts) AS first, max(ts) AS last FROM ar GROUP BY 1) WINDOW w AS (ORDER BY epoch))"""


@_query(f"""{_EPOCHS} SELECT first AS ts, epoch, 'connected' AS state, (first - before) // 1000 AS gap_ms FROM ep UNION ALL SELECT last, epoch, 'disconnected', NULL FROM ep WHERE after IS NOT NULL
 UNION ALL SELECT before + {STALL * MICROS}, epoch, 'stalled', NULL FROM (SELECT *, lag(ts) OVER (PARTITION BY epoch ORDER BY ts) AS before FROM ar) WHERE ts - before >= {STALL * MICROS}""")
def connection_journal(spark: SparkSession, sf: str) -> DataFrame:
    arrivals = market.trades(spark, sf).select("ts", F.floor(F.col("ts") / (CONNECTION * MICROS)).alias("epoch"))
    return journal.connections(arrivals, STALL)


_DAILY = f"""{_T}, dv AS (SELECT CAST(make_timestamp(ts) AS DATE) AS date, market, CAST(sum(notional) AS DOUBLE) AS volume FROM t GROUP BY 1, 2),
du AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, market) AS place FROM dv) WHERE place <= 3)"""


@_query(f"{_DAILY} SELECT * FROM du", date="date")
def universe_daily(spark: SparkSession, sf: str) -> DataFrame:
    return journal.daily_universe(market.trades(spark, sf), 3)


@_query(f"""{_DAILY}, dd AS (SELECT * FROM (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM du)) WHERE before IS NOT NULL)
SELECT dd.date, du.market, 'joined' AS change FROM dd JOIN du USING (date) WHERE NOT EXISTS (FROM du o WHERE o.date = dd.before AND o.market = du.market)
UNION ALL SELECT dd.date, du.market, 'left' FROM dd JOIN du ON du.date = dd.before WHERE NOT EXISTS (FROM du o WHERE o.date = dd.date AND o.market = du.market)""", date="date")
def universe_changes(spark: SparkSession, sf: str) -> DataFrame:
    return journal.universe_changes(shared_table(journal.daily_universe(market.trades(spark, sf), 3), "universes"))


@_query(f"{_T},\n{_PW} SELECT market, ts, seq, n, CAST(total AS DOUBLE) AS total, baseline FROM pb")
def prior_window_stats(spark: SparkSession, sf: str) -> DataFrame:
    return detect.prior_window(market.trades(spark, sf), WINDOW).select("market", "ts", "seq", "n", F.col("total").cast("double").alias("total"), "baseline")


@_query(f"{_T},\n{_PW},\n{_LARGE} SELECT * FROM large")
def signals_large(spark: SparkSession, sf: str) -> DataFrame:
    return detect.large_trades(market.trades(spark, sf), MULTIPLES, WINDOW).select(detect.SIGNAL)


@_query(f"{_T},\n{_PW},\n{_RATE} SELECT * FROM rate")
def signals_rate(spark: SparkSession, sf: str) -> DataFrame:
    return detect.trade_rate(market.trades(spark, sf), RATES, WINDOW).select(detect.SIGNAL)


@_query(f"{_B},\n{_IMB} SELECT * FROM imb")
def signals_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    return detect.imbalance(_books(spark, sf), THRESHOLDS).select(detect.SIGNAL)


@_query(f"{_B},\n{_WALL} SELECT * FROM wall")
def signals_wall(spark: SparkSession, sf: str) -> DataFrame:
    return detect.wall_drop(_books(spark, sf), WALL).select(detect.SIGNAL)


@_query(f"{_S},\n{_B},\n{_IMB},\n{_WALL} SELECT *, 0 AS is_trade, 0 AS rule_no FROM imb UNION ALL SELECT *, 0, 1 FROM wall UNION ALL SELECT *, 1, 0 FROM large UNION ALL SELECT *, 1, 1 FROM rate")
def signals_merged(spark: SparkSession, sf: str) -> DataFrame:
    t, b = market.trades(spark, sf), _books(spark, sf)
    return detect.merged(detect.trade_signals(t, MULTIPLES, RATES, WINDOW), [detect.imbalance(b, THRESHOLDS), detect.wall_drop(b, WALL)]).drop("evidence")


@_query(f"""{_S},\n{_B},\n{_IMB},\n{_WALL} SELECT market, ts, seq, rule_id, 'trade' AS source, price AS trigger_price, n AS trade_count, CASE WHEN signal_type LIKE 'large%' THEN CAST(total AS DOUBLE) END AS notional_sum, NULL::DOUBLE AS bid_size, NULL::DOUBLE AS previous_wall, feature_value AS feature
 FROM sig JOIN pb USING (market, ts, seq) UNION ALL SELECT market, ts, seq, rule_id, 'orderbook', NULL, NULL, NULL, bid, NULL, feature_value FROM imb JOIN b USING (market, ts, seq)
 UNION ALL SELECT market, ts, seq, rule_id, 'orderbook', NULL, NULL, NULL, bid, wall.baseline, feature_value FROM wall JOIN b USING (market, ts, seq)""".replace("sig JOIN pb USING (market, ts, seq)", "sig JOIN (SELECT market, ts, seq, price, n, total FROM pb) USING (market, ts, seq)"))
def signal_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What each signal saw, read back from its market snapshot."""
    t, b = market.trades(spark, sf), _books(spark, sf)
    parts = [*detect.trade_signals(t, MULTIPLES, RATES, WINDOW), detect.imbalance(b, THRESHOLDS), detect.wall_drop(b, WALL)]
    both = detect.snapshot(reduce(DataFrame.unionByName, parts))
    at = lambda path, kind="double": F.get_json_object("market_snapshot", f"$.{path}").cast(kind)
    return both.select(
        "market", "ts", "seq", "rule_id", at("evidence.source", "string").alias("source"), at("evidence.trigger.price").alias("trigger_price"), at("evidence.rolling_trade_count", "bigint").alias("trade_count"),
        at("evidence.rolling_notional_sum").alias("notional_sum"), at("evidence.total_bid_size").alias("bid_size"), at("evidence.previous_wall_krw").alias("previous_wall"), at("feature").alias("feature"),
    )


@_query(f"""{_T}, s AS (SELECT *, ts // {DAY * MICROS} AS epoch, CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 7 = 0 THEN seq - 40 WHEN seq % 5 = 0 THEN seq - 5 ELSE seq END AS sequential_id FROM t),
m AS (SELECT *, max(sequential_id) OVER (PARTITION BY market, epoch ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s)
SELECT market, epoch, seq, sequential_id, CASE WHEN sequential_id = top THEN 'integrity_duplicate' WHEN sequential_id < top THEN 'integrity_out_of_order' ELSE 'ok' END AS integrity FROM m""")
def sequence_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.col("seq")
    sid = F.when(seq % 11 == 0, None).when(seq % 7 == 0, seq - 40).when(seq % 5 == 0, seq - 5).otherwise(seq)
    t = market.trades(spark, sf).withColumns({"epoch": F.floor(F.col("ts") / (DAY * MICROS)), "sequential_id": sid})
    return detect.sequence_check(t, ["ts", "seq"]).select("market", "epoch", "seq", "sequential_id", "integrity")


@_query(f"{_S}, ft AS (SELECT market, ts, min_by(price, seq) AS price FROM t GROUP BY 1, 2) SELECT s.market, s.ts, s.seq, s.rule_id, f.ts AS entry_ts, f.price AS entry_price FROM sig s ASOF LEFT JOIN ft f ON s.market = f.market AND f.ts >= s.ts + 1")
def asof_entry(spark: SparkSession, sf: str) -> DataFrame:
    probes = _signals(spark, sf).withColumn("at", F.col("ts") + 1)
    found = outcomes.first_at_or_after(probes, market.trades(spark, sf), "at", "entry")
    return found.select("market", "ts", "seq", "rule_id", F.col("entry.ts").alias("entry_ts"), F.col("entry.price").alias("entry_price"))


@_query(f"{_O} SELECT market, ts, seq, signal_type, rule_id, direction, feature_value, baseline, entry_price, horizon_price, complete, reached_target, exit_ts FROM o")
def signal_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _done(spark, sf)


@_query(f"{_T},\n{_POOL} SELECT * FROM pool", date="date")
def control_pool(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.control_pool(market.trades(spark, sf), HORIZON)


@_query(f"{_PAIRS} SELECT * EXCLUDE (rule_key) FROM pairs", date="date")
def control_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf)


@_query(f"{_CAND} SELECT * FROM candl")
def candidate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf)


@_query(f"{_CAND} SELECT * FROM sel")
def rule_selection(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.select_rules(_candidates(spark, sf))


@_query(f"{_GATE} SELECT *, val_n >= 50 AND ci_low > 0 AND retention >= 0.8::DOUBLE AS passed FROM gt")
def rule_gate(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    selected = shared_table(evaluate.select_rules(evaluate.candidates(_signals(spark, sf), pairs, TUNING_END)), "selected")
    return evaluate.gate(selected, pairs.where(F.col("date") >= F.lit(VALIDATION_START).cast("date")), ITERATIONS, SEED, 50)


@_query(f"{_COOL} SELECT market, ts, seq, signal_type, rule_id, direction, feature_value, baseline, emitted FROM cf", recursive=True)
def alert_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    return paper.cooldown(_signals(spark, sf), ["market", "rule_id"], COOLDOWN, ["ts", "seq"])


def _paper(spark: SparkSession, sf: str) -> DataFrame:
    return shared_table(paper.paper_trades(_done(spark, sf), START, END, ROUND_TRIP), "paper")


def _held(spark: SparkSession, sf: str) -> DataFrame:
    return paper.hold(market.trades(spark, sf), START, END, ROUND_TRIP)


@_query(f"{_PAPER} SELECT * FROM pt", recursive=True)
def paper_trades(spark: SparkSession, sf: str) -> DataFrame:
    return _paper(spark, sf)


@_query(f"{_PAPER},\n{_HOLD} SELECT * FROM bx", recursive=True)
def paper_by_market(spark: SparkSession, sf: str) -> DataFrame:
    return paper.by_market(paper.tallies(_paper(spark, sf)), _held(spark, sf))


@_query(f"{_PAPER} SELECT * EXCLUDE (return_pct) FROM (SELECT signal_type || ':' || rule_id AS rule_key, {_TALLY} FROM pt GROUP BY 1)", recursive=True)
def paper_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    return paper.by_rule(paper.tallies(_paper(spark, sf))).drop("return_pct")


@_query(f"{_PAPER},\n{_HOLD} SELECT * FROM hd", recursive=True)
def hold_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return _held(spark, sf)


@_query(f"""{_PAPER},\n{_HOLD}, g AS (SELECT *, exp(sum(ln(1 + net_pct / 100)) OVER (PARTITION BY market ORDER BY exit_ts, ts, signal_type, rule_id ROWS UNBOUNDED PRECEDING)) AS sleeve FROM pt WHERE state = 'filled'),
dl AS (SELECT *, sleeve - lag(sleeve, 1, 1.0::DOUBLE) OVER (PARTITION BY market ORDER BY exit_ts, ts, signal_type, rule_id) AS delta FROM g),
vl AS (SELECT *, 1 + sum(delta / (SELECT count(*) FROM hd)) OVER w AS value FROM dl WINDOW w AS (ORDER BY exit_ts, market, ts, signal_type, rule_id ROWS UNBOUNDED PRECEDING)),
pk AS (SELECT value, greatest(1.0::DOUBLE, max(value) OVER (ORDER BY exit_ts, market, ts, signal_type, rule_id ROWS UNBOUNDED PRECEDING)) AS peak FROM vl)
SELECT round(least(0.0::DOUBLE, coalesce(min((value - peak) / peak * 100), 0)), 6) AS max_drawdown_pct FROM pk""", recursive=True)
def equity_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return paper.drawdown(_paper(spark, sf), _held(spark, sf))


@_query(f"""{_PAPER},\n{_HOLD}, tt AS (SELECT count(*) AS markets, coalesce(round(avg(return_pct), 6), 0) AS strategy_pct, coalesce(round(avg(hold_pct), 6), 0) AS hold_pct, coalesce(round(avg(excess_pct), 6), 0) AS excess_pct FROM bx),
cc AS (SELECT count(*) FILTER (WHERE state = 'filled') AS trades, count(*) FILTER (WHERE state = 'skipped') AS skipped, count(*) FILTER (WHERE state = 'incomplete') AS incomplete, count(*) FILTER (WHERE net_pct > 0) AS wins FROM pt)
SELECT *, CASE WHEN round(excess_pct, 3) > 0 THEN 'STRATEGY' WHEN round(excess_pct, 3) < 0 THEN 'HOLD' ELSE 'TIE' END AS verdict FROM tt, cc""", recursive=True)
def paper_summary(spark: SparkSession, sf: str) -> DataFrame:
    return paper.summary(paper.tallies(_paper(spark, sf)), _held(spark, sf))


@_query("SELECT event_id, event_type AS market, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, epoch_us(ts) // 1000 AS ts_ms FROM events")
def normalize_json(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    ms = F.floor(market.micros("ts") / 1000)
    frame = F.to_json(F.struct(F.lit("trade").alias("type"), F.col("event_type").alias("code"), ms.alias("timestamp"), F.from_json("props", "k double").getField("k").alias("trade_price"), F.lit(1.0).alias("trade_volume"), F.when(F.col("event_id") % 2 == 0, "BID").otherwise("ASK").alias("ask_bid"), F.col("event_id").alias("sequential_id")))
    good = wire.trades(wire.normalize(events.select(frame.alias("frame"))))
    return good.select(F.col("sequential_id").cast("bigint").alias("event_id"), "market", F.col("price").alias("k"), "side", F.col("ts_ms"))


@_query(f"{_T} SELECT market, ts, seq, price, volume, side, CAST(make_timestamp(ts) AS DATE) AS date FROM (SELECT *, 1.0::DOUBLE AS volume FROM t)", date="date")
def payload_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = market.trades(spark, sf).drop("notional")
    packed = rows.select(utc_date().alias("date"), F.to_json(F.struct(*rows.columns)).alias("payload"))
    return wire.unpack(packed, rows.schema, required=["market", "ts", "price"])
