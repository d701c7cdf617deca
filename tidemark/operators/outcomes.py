"""As-of and range joins of signals with later trades, and their outcomes.

Trades of a market are put in leaves of LEAF consecutive ones, and leaves in a tree of LEAF children each
that holds their least and greatest prices. All times that a signal asks about are merged with the trades in
one sort, which tells how many trades are ahead of each. The rest is looking up: a trade by its place, and a
range by the few nodes that cover it, however many trades lie in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import quotient
from tidemark.functions.timeline import MICROS, block_of, dealt, fitting_block, fitting_parts
from tidemark.sources.store import discard, shared_table

#: Trades of a leaf and children of a node: what one request reads at most.
LEAF = 64


def _merged(marks: DataFrame, trades: DataFrame, block: int, parts: int | None = None) -> DataFrame:
    """One row per leaf of trades, and one per LEAF marks, of each (market, block), from one sort of both.

    ``marks`` has market, at, which, after (whether trades of the time itself count as ahead) and row. A
    block's groups of either kind have at most LEAF members, so no row grows with a busy time."""
    kind = F.when(F.col("after"), 2).otherwise(0)
    both = marks.select("market", "at", kind.alias("kind"), F.struct("which", "row").alias("mark"))
    own = trades.select("market", F.col("ts").alias("at"), F.lit(1).alias("kind"), "seq", "price")
    both = both.unionByName(own, allowMissingColumns=True).withColumn("block", block_of("at", block))
    both = dealt(both, parts, "market", "block")
    before = Window.partitionBy("market", "block").orderBy("at", "kind", "seq").rowsBetween(Window.unboundedPreceding, -1)
    is_trade = F.col("kind") == 1
    ahead = F.coalesce(F.sum(is_trade.cast("int")).over(before), F.lit(0)).cast("int")
    marked = F.coalesce(F.sum((~is_trade).cast("int")).over(before), F.lit(0)).cast("int")
    both = both.withColumns({"ahead": ahead, "marked": marked})
    group = F.floor(F.when(is_trade, F.col("ahead")).otherwise(F.col("marked")) / LEAF).cast("int")
    trade = F.when(is_trade, F.struct((F.col("ahead") % LEAF).alias("place"), F.col("at").alias("ts"), "seq", "price"))
    return both.groupBy("market", "block", is_trade.alias("leaf"), group.alias("nth")).agg(
        F.sort_array(F.collect_list(trade)).alias("trades"),
        F.collect_list(F.when(~is_trade, F.struct("ahead", (F.col("kind") == 2).alias("after"), "mark"))).alias("marks"),
        F.min("price").alias("low"), F.max("price").alias("high"),
    )


def _levels(leaves: DataFrame, levels: int) -> DataFrame:
    """(market, level, node, times, seqs, lows, highs): the leaves at level 0, whose prices are lows alone, and above
    them nodes of LEAF children until one node of a market is left."""
    of = lambda field: F.transform("trades", lambda t: t[field])
    out = leaves.select("market", F.lit(0).alias("level"), "node", of("ts").alias("times"), of("seq").alias("seqs"), of("price").alias("lows"))
    below = leaves.select("market", "node", "low", "high")
    for level in range(1, levels + 1):
        child = F.struct("node", "low", "high")
        nodes = below.groupBy("market", F.floor(F.col("node") / LEAF).alias("node")).agg(F.sort_array(F.collect_list(child)).alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))
        held = nodes.select("market", F.lit(level).alias("level"), "node", F.transform("c", lambda x: x["low"]).alias("lows"), F.transform("c", lambda x: x["high"]).alias("highs"))
        out, below = out.unionByName(held, allowMissingColumns=True), nodes.select("market", "node", "low", "high")
    return out


def levels_above(most: int) -> int:
    """Levels above the leaves of a market whose last leaf is number ``most``."""
    level = 1
    while most >= LEAF**level:
        level += 1
    return level


def _spot(number: Column) -> Column:
    """A trade's number as its leaf and the place in it."""
    return F.struct(F.floor(number / LEAF).alias("node"), F.pmod(number, F.lit(LEAF)).cast("int").alias("place"))


def _request(name: int, level: int, node: Column, first: Column, last: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(level).alias("level"), node.cast("bigint").alias("node"), first.cast("int").alias("first"), last.cast("int").alias("last"))


def _cover(name: int, start: Column, end: Column, levels: int) -> list[Column]:
    """Requests for the nodes that cover the places from ``start`` to ``end`` (structs node, place), two a
    level at most; null where there is nothing to ask."""
    out, level = [], 0
    a, i, b, j = start["node"], start["place"], end["node"], end["place"]
    some = (a < b) | ((a == b) & (i <= j))
    while True:
        one = a == b
        out.append(F.when(some, F.when(one, _request(name, level, a, i, j)).otherwise(_request(name, level, a, i, F.lit(LEAF - 1)))))
        out.append(F.when(some & ~one, _request(name, level, b, F.lit(0), j)))
        if level == levels:
            return out
        # the children in between, by their parents
        some = some & (a + 1 <= b - 1)
        first, last, level = a + 1, b - 1, level + 1
        a, i, b, j = F.floor(first / LEAF), F.pmod(first, F.lit(LEAF)), F.floor(last / LEAF), F.pmod(last, F.lit(LEAF))


def look_up(probes: DataFrame, trades: DataFrame, first: dict[str, str], ranges: dict[str, tuple[str, str]], block: int | None = None) -> DataFrame:
    """``probes`` with, for each name of ``first``, the market's first trade at or after the time in that
    column, as a struct (ts, seq, price), however late, and for each name of ``ranges`` the struct (low,
    high) of prices from one column's time to another's, both included; null if there is none.

    Trades are read, shuffled and sorted once for all of them. Every probe then asks for one leaf per trade and two
    nodes a level per range, so the work is linear in probes and trades whatever a range holds. Meanwhile a probe is
    but its number in a table that is written first. Rows that repeat stay."""
    columns, parts = probes.columns, fitting_parts(trades)
    block = block or fitting_block(trades, ["market"])
    probes = shared_table(probes.withColumn("_probe", F.monotonically_increasing_id()), "probes")
    per_probe = fitting_parts(probes)
    marks = sorted({(c, False) for c in first.values()} | {(a, False) for a, _ in ranges.values()} | {(b, True) for _, b in ranges.values()})
    named = [F.struct(F.lit(k).alias("which"), F.col(c).alias("at"), F.lit(after).alias("after")) for k, (c, after) in enumerate(marks)]
    asked = probes.select("market", F.col("_probe").alias("row"), F.explode(F.array(*named)).alias("m")).select("market", "row", "m.*")
    merged = shared_table(_merged(asked.where("at is not null"), trades, block, parts), "merged")
    # leaves are numbered through a market by counts of its blocks
    sizes = merged.groupBy("market", "block").agg(F.count(F.when(F.col("leaf"), 1)).alias("leaves"), F.coalesce(F.sum(F.when(F.col("leaf"), F.size("trades"))), F.lit(0)).alias("size"))
    earlier = Window.partitionBy("market").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shared_table(sizes.withColumn("offset", F.coalesce(F.sum("leaves").over(earlier), F.lit(0))), "block-sizes")
    numbered = merged.join(sizes, ["market", "block"])
    leaves = numbered.where("leaf").select("market", (F.col("offset") + F.col("nth")).alias("node"), "trades", "low", "high")
    levels = levels_above(sizes.agg(F.max(F.col("offset") + F.col("leaves") - 1)).first()[0] or 0)
    nodes = dealt(_levels(leaves, levels), parts, "market", "level", "node")
    # the trade right after a mark, or for marks after their time the last one ahead of it; both may be in another
    # block. A trade's number is its leaf's times LEAF and its place
    begin, ahead = F.col("offset") * LEAF, F.col("m.ahead")
    following = F.when(ahead < F.col("size"), begin + ahead).otherwise((F.col("offset") + F.col("leaves")) * LEAF)
    spots = numbered.where("not leaf").select("market", "offset", "leaves", "size", F.explode("marks").alias("m"))
    spots = spots.select("market", F.col("m.mark.row").alias("row"), F.col("m.mark.which").alias("which"), F.when(F.col("m.after"), begin + ahead - 1).otherwise(following).alias("spot"))
    found = dealt(spots, per_probe, "row").groupBy("market", "row").agg(*(F.max(F.when(F.col("which") == k, F.col("spot"))).alias(f"spot{k}") for k in range(len(marks))))
    at = {m: F.when(F.col(f"spot{k}").isNotNull(), _spot(F.col(f"spot{k}"))) for k, m in enumerate(marks)}
    names = {n: k for k, n in enumerate([*first, *ranges])}
    requests = [F.when(at[c, False].isNotNull(), _request(names[n], 0, at[c, False]["node"], at[c, False]["place"], at[c, False]["place"])) for n, c in first.items()]
    for n, (a, b) in ranges.items():
        requests += _cover(names[n], at[a, False], at[b, True], levels)
    asked = found.select("market", "row", F.explode(F.array_compact(F.array(*requests))).alias("r")).select("market", "row", "r.*")
    hits = dealt(asked, parts, "market", "level", "node").join(nodes, ["market", "level", "node"])
    # what a probe wants of a node, before anything is sorted or kept by probes
    part = lambda values: F.slice(values, F.col("first") + 1, F.col("last") - F.col("first") + 1)
    one = lambda values: F.when(F.size(values) > F.col("first"), F.element_at(values, F.col("first") + 1))
    is_range = F.col("name") >= len(first)
    hits = hits.select(
        "row", "name", F.when(~is_range, one("times")).alias("ts"), F.when(~is_range, one("seqs")).alias("seq"),
        F.when(is_range, F.array_min(part("lows"))).otherwise(one("lows")).alias("low"), F.when(is_range, F.array_max(part(F.coalesce("highs", "lows")))).alias("high"),
    )
    of = lambda n, c, kind: kind(F.when(F.col("name") == names[n], F.col(c)))
    values = [of(n, c, F.max).alias(f"{c}_{names[n]}") for n in first for c in ("ts", "seq", "low")]
    values += [x for n in ranges for x in (of(n, "low", F.min).alias(f"low_{names[n]}"), of(n, "high", F.max).alias(f"high_{names[n]}"))]
    answers = dealt(hits.withColumnRenamed("row", "_probe"), per_probe, "_probe").groupBy("_probe").agg(*values)
    got = lambda n, c: F.col(f"_a.{c}_{names[n]}")
    out = [F.when(got(n, "ts").isNotNull(), F.struct(got(n, "ts").alias("ts"), got(n, "seq").alias("seq"), got(n, "low").alias("price"))).alias(n) for n in first]
    out += [F.when(got(n, "low").isNotNull(), F.struct(got(n, "low").alias("low"), got(n, "high").alias("high"))).alias(n) for n in ranges]
    whole = dealt(probes, per_probe, "_probe").alias("_p").join(answers.alias("_a"), F.col("_p._probe") == F.col("_a._probe"), "left")
    result = shared_table(whole.select(*(F.col(f"_p.`{c}`") for c in columns), *out), "looked-up")
    discard(probes, merged, sizes)
    return result


def first_at_or_after(probes: DataFrame, trades: DataFrame, at: str, name: str, block: int | None = None) -> DataFrame:
    """``probes`` with the struct ``name`` (ts, seq, price) of the market's first trade at or after
    ``at``, however late; null if there is none."""
    return look_up(probes, trades, {name: at}, {}, block)


def outcomes(signals: DataFrame, trades: DataFrame, horizon: int, max_lag: int, target_pct: float, block: int | None = None) -> DataFrame:
    """Signals with entry_price (first trade within ``max_lag`` seconds), horizon_price (first trade
    ``horizon`` seconds later or after), complete, and reached_target: whether any trade from entry
    to horizon moves ``target_pct`` percent the signal's way; null, not false, when incomplete."""
    df = signals.withColumn("_end", F.col("ts") + horizon * MICROS)
    df = look_up(df, trades, {"_entry": "ts", "_exit": "_end"}, {"_range": ("ts", "_end")}, block)
    # no trade lies between the signal and its entry, so their ranges are one
    entry = F.when(F.col("_entry.ts") <= F.col("ts") + max_lag * MICROS, F.col("_entry.price"))
    complete = entry.isNotNull() & F.col("_exit").isNotNull()
    # a price of 0 is infinitely far from any other
    up = (quotient(F.col("_range.high"), entry) - 1) * 100 >= target_pct
    down = (quotient(entry, F.col("_range.low")) - 1) * 100 >= target_pct
    hit = F.coalesce(F.when(F.col("direction") == "buy", up).otherwise(down), F.lit(False))
    return df.select(*signals.columns, entry.alias("entry_price"), F.col("_exit.price").alias("horizon_price"), complete.alias("complete"), F.when(complete, hit).alias("reached_target"), F.col("_exit.ts").alias("exit_ts"))
