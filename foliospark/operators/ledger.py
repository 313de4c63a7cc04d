"""The event log folded into positions, cash and equity by running aggregates.

Per symbol, units, price and notional are running aggregates; a portfolio's equity is the running sum of the
changes in cash and notional, so the work is one row per event, not events times positions. Running aggregates are windows
over a portfolio's symbol and then over the portfolio: two shuffles of the log. A portfolio or symbol with more events than
one task should take is found by a count and cut in pieces of equal counts (functions/scan.py).

A log may start from a given state: with_initial() adds it as marked rows that come before the first event. They count
as no event and are in no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.scan import hot_keys, scan
from foliospark.functions.scratch import stash

ORDER = ("ts", "event_id")
SYMBOL, PORTFOLIO = ["portfolio_id", "symbol"], ["portfolio_id"]
INITIAL, OPENING, INSTANT = "INITIAL_STATE", "INITIAL_POSITION", "INSTANT"
#: Columns of the marked rows, and the type of each.
GIVEN = {"_cash0": "double", "_equity0": "double", "_ts0": "timestamp", "_sequence0": "long", "_pnl0": "double", "_margin0": "double", "_weight0": "double"}


def is_kind(*kinds: str) -> Column:
    return F.coalesce(F.col("event_type").isin(*kinds), F.lit(False))


def with_initial(log: DataFrame, positions: DataFrame | None = None, starts: DataFrame | None = None) -> DataFrame:
    """The log with the state before its first event.

    positions: portfolio_id, symbol, units, price and, where given, weight and accrued_yield. starts: portfolio_id, cash
    and, where given, equity, ts, event_sequence, unrealized_pnl, margin_used. Given equity and weights hold until an
    event revalues them; equity that is not given is cash and positions. A portfolio without a start has the initial
    cash of the call, one without events has no rows in results over events."""
    out = log
    optional = lambda df, name, of: (F.col(of) if of in df.columns else F.lit(None)).cast(GIVEN[name]).alias(name)
    if positions is not None:
        accrued = (F.col("accrued_yield") if "accrued_yield" in positions.columns else F.lit(0.0)).alias("amount")
        rows = positions.select("portfolio_id", F.lit(OPENING).alias("event_type"), "symbol", "units", "price", accrued, optional(positions, "_weight0", "weight"))
        out = out.unionByName(rows, allowMissingColumns=True)
    if starts is not None:
        names = {"_cash0": "cash", "_equity0": "equity", "_ts0": "ts", "_sequence0": "event_sequence", "_pnl0": "unrealized_pnl", "_margin0": "margin_used"}
        rows = starts.select("portfolio_id", F.lit(INITIAL).alias("event_type"), *[optional(starts, n, of) for n, of in names.items()])
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def given(log: DataFrame) -> DataFrame:
    """The log with all columns of the marked rows."""
    return log.withColumns({n: F.lit(None).cast(kind) for n, kind in GIVEN.items() if n not in log.columns})


def signed_units() -> Column:
    return F.when(is_kind("ORDER_EXECUTED"), F.when(F.col("side") == "BUY", F.col("units")).otherwise(-F.col("units"))).when(is_kind(OPENING), F.col("units")).otherwise(0.0)


def cash_change(initial_cash: float) -> Column:
    order = -signed_units() * F.col("price") - F.coalesce("fee", F.lit(0.0))
    return F.when(is_kind("ORDER_EXECUTED"), order).when(is_kind("YIELD_ACCRUED"), F.col("amount")).when(is_kind(INITIAL), F.coalesce(F.col("_cash0") - initial_cash, F.lit(0.0))).otherwise(0.0)


def held(log: DataFrame, order: list[str], hot: DataFrame | None) -> DataFrame:
    """Adds _has (1 once the event's symbol is held), position_units and position_price, and each before the event. The last price is that of an
    order or tick; once a position exists no earlier tick can be the last of them."""
    makes = is_kind("ORDER_EXECUTED", OPENING)
    priced = is_kind("ORDER_EXECUTED", "MARKET_TICK", OPENING)
    return scan(
        log, SYMBOL, order, hot, sums={"position_units": signed_units()}, maxima={"_has": makes.cast("int")},
        lasts={"position_price": F.when(priced, F.col("price"))} | ({"_w0": F.col("_weight0")} if "_weight0" in log.columns else {}),
        before=("_has", "position_units", "position_price"),
    )


def accrued(rows: DataFrame, order: list[str], hot: DataFrame | None) -> DataFrame:
    """Adds accrued_yield to rows of held(): yields count from the symbol's first order on. The same windows, so no shuffle."""
    accrues = (is_kind("YIELD_ACCRUED") & (F.col("_has") == 1)) | is_kind(OPENING)
    read = rows if hot is None else stash(rows, "held")
    return scan(read, SYMBOL, order, hot, sums={"accrued_yield": F.when(accrues, F.col("amount")).otherwise(0.0)})


def position_ledger(log: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Position of each event's symbol after it; only once an order, or the initial state, has made the position."""
    by = list(order)
    moved = log.where(is_kind("ORDER_EXECUTED", "MARKET_TICK", "YIELD_ACCRUED", OPENING))
    (hot,) = hot_keys(moved, by, SYMBOL)
    rows = accrued(held(moved, by, hot), by, hot)
    out = rows.where((F.col("_has") == 1) & ~is_kind(OPENING)).drop("_has", "_has_before", "position_units_before", "position_price_before", "_w0", *[c for c in GIVEN if c in log.columns])
    return out.withColumn("notional", F.col("position_units") * F.col("position_price"))


def portfolio_state(log: DataFrame, initial_cash: float, order: tuple[str, ...] = ORDER) -> DataFrame:
    """After every event: cash, equity, event_sequence, as_of (the largest timestamp so far), unrealized_pnl and margin_used
    (as they were given), and the initial_equity of the portfolio."""
    by, rows = list(order), given(log)
    rows = valued(rows, initial_cash, by, *hot_keys(rows, by, SYMBOL, PORTFOLIO))
    return rows.where(~is_kind(INITIAL, OPENING)).select(*log.columns, "cash", "equity", "event_sequence", "as_of", "unrealized_pnl", "margin_used", "initial_equity").drop(*GIVEN)


def valued(log: DataFrame, initial_cash: float, by: list[str], hot_symbols: DataFrame | None, hot_portfolios: DataFrame | None, yields: bool = False) -> DataFrame:
    """All rows of a log with given(): those of held(), with accrued_yield if asked for, and the portfolio's values after each."""
    notional = lambda x: F.when(F.col(f"_has{x}") == 1, F.col(f"position_units{x}") * F.col(f"position_price{x}")).otherwise(0.0)
    rows = held(log, by, hot_symbols)
    if yields:
        rows = accrued(rows, by, hot_symbols)
    rows = rows.withColumns({"_dn": notional("") - notional("_before"), "_dc": cash_change(initial_cash)})
    marked = is_kind(INITIAL, OPENING)
    both, counted = F.col("_dc") + F.col("_dn"), F.when(marked | is_kind(INSTANT), 0).otherwise(1)
    read = rows if hot_portfolios is None else stash(rows, "held")
    rows = scan(
        read, PORTFOLIO, by, hot_portfolios,
        sums={"_cash": F.col("_dc"), "_equity": both, "_opened": F.when(marked, both).otherwise(0.0), "_n": counted},
        maxima={"as_of": F.coalesce("_ts0", by[0]), "_valued": is_kind("ORDER_EXECUTED", "MARKET_TICK", "YIELD_ACCRUED").cast("int")},
        lasts={"_e0": F.col("_equity0"), "_s0": F.col("_sequence0"), "unrealized_pnl": F.col("_pnl0"), "margin_used": F.col("_margin0")},
        since={"_sequence": F.when(F.col("sequence") > 0, F.col("sequence"))}, step=counted,
    )
    opened = F.coalesce(F.col("_e0"), initial_cash + F.col("_opened"))
    return rows.withColumns({
        "cash": initial_cash + F.col("_cash"), "equity": F.when(F.col("_valued") == 1, initial_cash + F.col("_equity")).otherwise(opened), "initial_equity": opened,
        "event_sequence": F.coalesce(F.col("_sequence"), F.coalesce("_s0", F.lit(0)) + F.col("_n")).cast("long"), "unrealized_pnl": F.coalesce("unrealized_pnl", F.lit(0.0)), "margin_used": F.coalesce("margin_used", F.lit(0.0)),
    })


def state_at(log: DataFrame, initial_cash: float, cut=None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Positions of every portfolio after all events up to the cut, with weights as of the last tick or order
    (later yields move cash, not weights). Aggregates only; no running window over the log: one grouping by symbol, one
    of it by portfolio, and one of the yields, the only events that can come after the last tick or order."""
    at = F.struct(*order)
    rows = given(log)
    rows = rows if cut is None else rows.where((F.col("ts") <= F.lit(cut)) | is_kind(INITIAL, OPENING))
    rows = rows.where(is_kind("ORDER_EXECUTED", "MARKET_TICK", "YIELD_ACCRUED", INITIAL, OPENING))
    makes, marks = is_kind("ORDER_EXECUTED", OPENING), is_kind("ORDER_EXECUTED", "MARKET_TICK")
    per_symbol = rows.groupBy("portfolio_id", "symbol").agg(
        F.sum(signed_units()).alias("units"), F.max_by("price", F.when(marks | is_kind(OPENING), at)).alias("price"), F.min(F.when(makes, at)).alias("_first"), F.max(F.when(marks, at)).alias("_mark"),
        F.sum(cash_change(initial_cash)).alias("_c"), F.max("_weight0").alias("_w0"), F.sum(F.when(is_kind(OPENING), F.col("amount"))).alias("_a0"), F.max("_equity0").alias("_e0"),
    ).withColumn("notional", F.when(F.col("_first").isNotNull(), F.col("units") * F.col("price")))
    totals = per_symbol.groupBy("portfolio_id").agg(F.max("_mark").alias("_mark"), (initial_cash + F.sum("_c")).alias("cash"), F.coalesce(F.sum("notional"), F.lit(0.0)).alias("_n"), F.max("_e0").alias("_e0"))
    paid = rows.where(is_kind("YIELD_ACCRUED")).select("portfolio_id", "symbol", at.alias("_at"), "amount")
    paid = paid.join(per_symbol.select("portfolio_id", "symbol", "_first"), ["portfolio_id", "symbol"]).join(totals.select("portfolio_id", "_mark"), "portfolio_id")
    yields = paid.groupBy("portfolio_id", "symbol").agg(F.sum(F.when(F.col("_at") >= F.col("_first"), F.col("amount"))).alias("_y"), F.sum(F.when(F.col("_at") > F.col("_mark"), F.col("amount"))).alias("_late"), F.count("*").alias("_k"))
    late = yields.groupBy("portfolio_id").agg(F.coalesce(F.sum("_late"), F.lit(0.0)).alias("_late"), F.sum("_k").alias("_k"))
    out = per_symbol.where("_first IS NOT NULL").select("portfolio_id", "symbol", "units", "price", "notional", "_w0", "_a0").join(yields.select("portfolio_id", "symbol", "_y"), ["portfolio_id", "symbol"], "left")
    out = out.join(totals, "portfolio_id").join(late, "portfolio_id", "left")
    marked = F.col("cash") - F.coalesce("_late", F.lit(0.0)) + F.col("_n")
    weight = F.when(marked > 0, F.col("notional") / marked).otherwise(0.0)
    untouched = F.col("_mark").isNull()
    equity = F.when(untouched & F.col("_k").isNull(), F.coalesce(F.col("_e0"), F.col("cash") + F.col("_n"))).otherwise(F.col("cash") + F.col("_n"))
    out = out.withColumn("accrued_yield", F.coalesce("_a0", F.lit(0.0)) + F.coalesce("_y", F.lit(0.0))).withColumn("weight", F.when(untouched & F.col("_w0").isNotNull(), F.col("_w0")).otherwise(weight))
    return out.withColumn("equity", equity).select("portfolio_id", "symbol", "units", "price", "accrued_yield", "notional", "cash", "weight", "equity")


def position_weights(log: DataFrame, initial_cash: float, cut=None, order: tuple[str, ...] = ORDER) -> DataFrame:
    return state_at(log, initial_cash, cut, order).select("portfolio_id", "symbol", "notional", "weight")


def at_instants(log: DataFrame, initial_cash: float, instants: list | DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The state of every portfolio's symbols at each instant, events of that time included: columns as of states_at(), and
    held (has an order, or the initial state, made the position). Instants are rows of the log that come last of their time
    and change nothing, so one pass gives all of them. A symbol is listed from the start of the log, at every instant."""
    if order[0] != "ts":
        raise ValueError("instants are times: the order has to begin with ts")
    by = ["ts", "_mark", *order[1:]]
    rows = given(log).where(is_kind("ORDER_EXECUTED", "MARKET_TICK", "YIELD_ACCRUED", INITIAL, OPENING)).withColumn("_mark", F.lit(0))
    symbols = rows.groupBy(*SYMBOL).agg(F.count("*").alias("_n")).drop("_n")
    if isinstance(instants, DataFrame):
        asked = instants.select("portfolio_id", F.col("ts").cast(log.schema["ts"].dataType).alias("ts")).distinct()
        markers = symbols.join(asked, "portfolio_id")
    else:
        markers = symbols.withColumn("ts", F.explode(F.array(*[F.lit(t).cast(log.schema["ts"].dataType) for t in sorted(set(instants))])))
    marked = rows.unionByName(markers.withColumns({"event_type": F.lit(INSTANT), "_mark": F.lit(1)}), allowMissingColumns=True)
    hot_symbols, hot = hot_keys(marked, by, SYMBOL, PORTFOLIO)
    states = valued(marked, initial_cash, by, hot_symbols, hot, yields=True)
    read = states if hot is None else stash(states, "valued")
    last_mark = F.when(is_kind("ORDER_EXECUTED", "MARKET_TICK"), initial_cash + F.col("_equity"))
    out = scan(read, PORTFOLIO, by, hot, lasts={"_marked": last_mark}).where(is_kind(INSTANT))
    whole = F.coalesce("_marked", initial_cash + F.col("_equity"))
    notional = F.col("position_units") * F.col("position_price")
    weight = F.when(F.col("_marked").isNull() & F.col("_w0").isNotNull(), F.col("_w0")).otherwise(F.when(whole > 0, notional / whole).otherwise(0.0))
    return out.select(
        *SYMBOL, F.col("ts").alias("as_of"), F.col("position_units").alias("units"), F.col("position_price").alias("price"), "accrued_yield", notional.alias("notional"), "cash", weight.alias("weight"), "equity",
        F.coalesce(F.col("_has") == 1, F.lit(False)).alias("held"),
    )


def states_at(log: DataFrame, initial_cash: float, instants: list | DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """state_at() for many instants at once: a list of times, or a table (portfolio_id, ts). portfolio_id, symbol, as_of, ..."""
    return at_instants(log, initial_cash, instants, order).where("held").drop("held")


def snapshot(log: DataFrame, initial_cash: float, instant, order: tuple[str, ...] = ORDER) -> tuple[DataFrame, DataFrame]:
    """Positions and starts at an instant, written, for with_initial(): the state goes on from them over later events alone,
    so that the events before are not read again."""
    states = stash(at_instants(log, initial_cash, [instant], order), "snapshot")
    positions = states.where("held").select(*SYMBOL, "units", "price", "weight", "accrued_yield")
    starts = states.groupBy("portfolio_id").agg(F.max("cash").alias("cash"), F.max("equity").alias("equity"), F.max("as_of").alias("ts"))
    return positions, starts


def start_of(states: DataFrame, initial_cash: float) -> Column:
    return F.col("initial_equity") if "initial_equity" in states.columns else F.lit(initial_cash)


#: Hot keys that are still to be counted.
UNKNOWN = "unknown"


def hot_portfolios(states: DataFrame, order: tuple[str, ...], hot: DataFrame | None | str = UNKNOWN) -> DataFrame | None:
    return hot_keys(states, list(order), PORTFOLIO)[0] if isinstance(hot, str) else hot


def daily_equity(states: DataFrame, initial_cash: float, order: tuple[str, ...] = ORDER, hot: DataFrame | None | str = UNKNOWN) -> DataFrame:
    """The initial equity, then the equity at each snapshot: sequence % 6 = 5, or the number of events less 1."""
    counts = states.groupBy("portfolio_id").agg(F.count("*").alias("_n"), F.max(start_of(states, initial_cash)).alias("_start"))
    marked = states.select("portfolio_id", *order, "sequence", "equity").join(counts, "portfolio_id").where((F.col("sequence") % 6 == 5) | (F.col("sequence") == F.col("_n") - 1))
    numbered = scan(marked, PORTFOLIO, list(order), hot_portfolios(states, order, hot), sums={"snapshot": F.lit(1).cast("long")})
    start = counts.select("portfolio_id", F.lit(0).cast("long").alias("snapshot"), F.col("_start").alias("equity"))
    return start.unionByName(numbered.select("portfolio_id", "snapshot", "equity"))


def daily_returns(daily: DataFrame, hot: DataFrame | None | str = UNKNOWN) -> DataFrame:
    """hot: None if no portfolio has many snapshots, by default counted."""
    rows = scan(daily, PORTFOLIO, ["snapshot"], hot_portfolios(daily, ("snapshot",), hot), lags={"_b0": F.col("equity")})
    out = rows.withColumn("ret", F.when(F.col("_b0") != 0, F.col("equity") / F.col("_b0") - 1))
    return out.where(F.col("ret").isNotNull()).drop("_b0")


def drawdown(states: DataFrame, initial_cash: float, order: tuple[str, ...] = ORDER, hot: DataFrame | None | str = UNKNOWN) -> DataFrame:
    rows = scan(states, PORTFOLIO, list(order), hot_portfolios(states, order, hot), maxima={"_peak": F.col("equity")})
    peak = F.greatest(start_of(states, initial_cash), F.col("_peak"))
    return rows.withColumn("drawdown", (F.col("equity") - peak) / peak).drop("_peak")


def backtest_summary(states: DataFrame, initial_cash: float, start_ts: float | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Return, volatility, Sharpe ratio and drawdown per portfolio. start_ts: epoch seconds from which days are
    counted; by default the first event's."""
    at = F.struct(*order)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    hot = hot_portfolios(states, order)
    curve = drawdown(states, initial_cash, order, hot).groupBy("portfolio_id").agg(
        F.max_by("equity", at).alias("final_equity"), F.min(seconds).alias("_t0"), F.max(seconds).alias("_t1"), F.least(F.lit(0.0), F.min("drawdown")).alias("_dd"), F.count("*").alias("n_events"),
        F.max(start_of(states, initial_cash)).alias("_start"),
    )
    daily = daily_equity(states, initial_cash, order, hot)
    vol = daily_returns(daily, None if hot is None else UNKNOWN).groupBy("portfolio_id").agg((F.stddev_samp("ret") * F.sqrt(F.lit(365.0))).alias("_vol"))
    rows = curve.join(vol, "portfolio_id", "left").withColumn("_vol", F.coalesce("_vol", F.lit(0.0)))
    total = F.when(F.col("_start") > 0, (F.col("final_equity") - F.col("_start")) / F.col("_start")).otherwise(0.0)
    first = F.lit(float(start_ts)) if start_ts is not None else F.col("_t0")
    days = F.greatest(F.lit(1.0), (F.col("_t1") - first) / 86400)
    rows = rows.withColumn("_total", total).withColumn("_ann", F.when(F.col("_total") > -1, F.pow(1 + F.col("_total"), 365 / days) - 1).otherwise(-1.0))
    return rows.select(
        "portfolio_id", "n_events", "final_equity", (F.col("_total") * 100).alias("total_return_pct"), (F.col("_ann") * 100).alias("annualized_return_pct"), (F.col("_vol") * 100).alias("annualized_volatility_pct"),
        F.when(F.col("_vol") > 1e-6, F.col("_ann") / F.col("_vol")).otherwise(0.0).alias("sharpe_ratio"), (F.col("_dd") * 100).alias("max_drawdown_pct"),
    )
