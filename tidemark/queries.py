"""One query per operator, on the shared tables, with the same result as DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import market as M
from tidemark import model_sql as S
from tidemark.functions import numeric as N
from tidemark.operators import book, decay, events, models, sampled, signals, trades
from tidemark.operators.scan import DAY_US, span_for
from tidemark.plans import autodiff, stateful
from tidemark.plans.graph import Callset, Definition, Output, OutputSpec, SignalGraph
from tidemark.sources import derived
from tidemark.sources.market import depth_messages, number_rows, trade_messages
from tidemark.sources.scratch import materialize

SECOND = 1_000_000
GAP, IDLE, HORIZON, HALF_LIFE = 3600 * SECOND, 7200 * SECOND, 6 * 3600 * SECOND, DAY_US
SIZE_WEIGHT, DISTANCE_WEIGHT, SCALE, RATIO, GROUPS = 1e-4, 100.0, 0.1, 0.01, 4
#: Blocks of running values: a month, so that a key's rows spread over as many tasks as it has months.
BLOCK = 30 * DAY_US

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _value(name: str) -> float:
    """A fixed small value for each name of a parameter."""
    return ((sum(map(ord, name)) * 37) % 100) / 200.0 + 0.05


def _parameter(name: str) -> Column:
    return F.lit(_value(name))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _with(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([derived.SQL, *ctes]) + "\n" + body


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three centred inputs of lineitem rows."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("a"), (F.col("l_discount") * 100 - 5).cast("int").cast("double").alias("b"), (F.col("l_tax") - 0.04).alias("c"))


_ITEMS = "items as (select l_orderkey, l_linenumber, l_quantity - 25 as a, cast(trunc(l_discount * 100 - 5) as double) as b, l_tax - 0.04 as c from lineitem)"
_KEYS = ["l_orderkey", "l_linenumber"]


# -- streams
@query(_with("select source, seq, ts_us, sym, max(ts_us) over (partition by source, sym order by seq) as key_us from log", "log as (select 0 as source, seq, ts_us - (seq % 5) * 400000000 as ts_us, sym from trades union all select 1, seq, ts_us, sym from depth)"))
def collate_streams(spark, sf_dir):
    late = derived.trades(spark, sf_dir).withColumn("ts_us", F.col("ts_us") - (F.col("seq") % 5) * 400000000).select("seq", "ts_us", "sym")
    return events.collate([late, derived.depth(spark, sf_dir).select("seq", "ts_us", "sym")], ["sym"]).select("source", "seq", "ts_us", "sym", "key_us")


@query(_with("select t.seq, t.sym, t.ts_us, case when d.size > 0 then d.price end as level_price from trades t asof left join depth d on t.sym = d.sym and t.ts_us >= d.ts_us"))
def latch_levels_on_trades(spark, sf_dir):
    """A deletion writes the price as invalid, which replaces the older valid one."""
    t, d = derived.trades(spark, sf_dir).select("seq", "ts_us", "sym"), derived.depth(spark, sf_dir).select("seq", "ts_us", "sym", "price", "size")
    log = d.withColumn("source", F.lit(0)).unionByName(t.withColumn("source", F.lit(1)), allowMissingColumns=True).withColumn("key_us", F.col("ts_us"))
    held = events.latch(log, ["sym"], {"level_price": (F.when(F.col("size") > 0, F.col("price")), F.col("source") == 0)}, block_us=BLOCK)
    return held.where("source = 1").select("seq", "sym", "ts_us", "level_price")


@query(_with("select t.seq, t.sym, d.price as depth_price, d.size as depth_size from trades t asof left join depth d on t.sym = d.sym and t.ts_us >= d.ts_us"))
def as_of_depth(spark, sf_dir):
    t, d = derived.trades(spark, sf_dir), derived.depth(spark, sf_dir)
    return events.as_of(t.select("seq", "ts_us", "sym"), d.withColumnsRenamed({"price": "depth_price", "size": "depth_size"}), ["sym"], ["depth_price", "depth_size"], block_us=BLOCK).select("seq", "sym", "depth_price", "depth_size")


_FUTURE = f"""due as (select t.*, ts_us + {HORIZON} as due from trades t join (select sym, max(ts_us) as last from trades group by sym) e using (sym) where ts_us + {HORIZON} < last)"""


@query(_with("select d.seq, d.sym, d.price, f.price as future from due d asof join trades f on d.sym = f.sym and d.due >= f.ts_us", _FUTURE))
def future_target(spark, sf_dir):
    t = derived.trades(spark, sf_dir)
    return events.future_value(t.select("seq", "ts_us", "sym", "price"), t, ["sym"], "price", HORIZON, "future", block_us=BLOCK).select("seq", "sym", "price", "future")


_SAMPLED = "numbered as (select *, row_number() over (partition by sym order by ts_us, seq) as n from trades)"


@query(_with("select s.seq, s.sym, s.price, q.price as level_price, f.price as future from (select * from due where seq in (select seq from numbered where n % 10 = 0)) s asof join trades f on s.sym = f.sym and s.due >= f.ts_us asof left join depth q on s.sym = q.sym and s.ts_us >= q.ts_us", _FUTURE, _SAMPLED))
def sampled_targets(spark, sf_dir):
    """Every tenth trade of a symbol with the latest level and the price six hours on."""
    t, d = derived.trades(spark, sf_dir), derived.depth(spark, sf_dir).withColumnRenamed("price", "level_price")
    chosen = trades.bucket_sample(t, ["sym"], block_us=BLOCK).where("should_sample").select("seq", "ts_us", "sym", "price")
    seen = events.as_of(chosen, d, ["sym"], ["level_price"], block_us=BLOCK)
    return events.future_value(seen, t, ["sym"], "price", HORIZON, "future", block_us=BLOCK).select("seq", "sym", "price", "level_price", "future")


@query(_with("select a.seq, a.sym, b.price as lead_price from trades a asof left join (select * from trades where sym = 's0') b on a.ts_us >= b.ts_us where a.sym <> 's0'"))
def cross_market_lead(spark, sf_dir):
    """Other symbols read the leader's last price."""
    t = derived.trades(spark, sf_dir)
    lead = t.where("sym = 's0'").select("seq", "ts_us", F.col("price").alias("lead_price"))
    return events.as_of(t.where("sym <> 's0'").select("seq", "ts_us", "sym"), lead, [], ["lead_price"], block_us=BLOCK).select("seq", "sym", "lead_price")


@query("select event_id as seq, cast(event_id as double) as price, value as size, epoch_us(ts) // 1000 * 1000 as exchange_time_us, event_type <> 'click' as buy from events")
def normalize_trades(spark, sf_dir):
    raw = derived.events(spark, sf_dir).select(F.col("ts_us").alias("local_time_us"), "seq", F.to_json(F.struct(F.floor(F.col("ts_us") / 1000).alias("T"), F.col("seq").cast("string").alias("p"), F.col("value").cast("string").alias("q"), (F.col("event_type") == "click").alias("m"))).alias("message"))
    return trade_messages(raw).select("seq", "trade.price", "trade.size", "trade.exchange_time_us", "trade.buy")


@query("select event_id as seq, 'B' as side, cast(event_id as double) as price, value as size from events union all select event_id, 'S', event_id + 1.0, value from events where event_id % 2 = 0")
def normalize_depth(spark, sf_dir):
    pair = lambda p: F.array(p.cast("string"), F.col("value").cast("string"))
    some = F.when(F.col("seq") % 2 == 0, F.array(pair(F.col("seq") + 1))).otherwise(F.array().cast("array<array<string>>"))
    raw = derived.events(spark, sf_dir).select(F.col("ts_us").alias("local_time_us"), "seq", F.to_json(F.struct(F.lit(0).alias("E"), F.array(pair(F.col("seq"))).alias("b"), some.alias("a"))).alias("message"))
    return book.explode_messages(depth_messages(raw).select("seq", "depth.bids", "depth.asks")).select("seq", "side", "price", "size")


# -- scalar algebra
@query(f"with {_ITEMS} select l_orderkey, l_linenumber, round(a + b, 6) as add_, round(a - b, 6) as sub_, round(a * c, 6) + 0 as mul_, case when b <> 0 then round(a / b, 6) + 0 end as div_, case when b = 0 then case when a = 0 then 'nan' when a > 0 then 'inf' else '-inf' end end as div_by_zero, least(a, b) as min_, greatest(a, b) as max_, a < b as lt_, a <= b as le_, a > b as gt_, a >= b as ge_, a = b as eq_ from items")
def scalar_binary(spark, sf_dir):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    q = N.div(a, b)
    odd = F.when(F.isnan(q), "nan").when(q == N.INF, "inf").when(q == -N.INF, "-inf")
    return _items(spark, sf_dir).select(*_KEYS, r6(N.add(a, b)).alias("add_"), r6(N.sub(a, b)).alias("sub_"), (r6(N.mul(a, c)) + 0.0).alias("mul_"), (r6(F.when(odd.isNull(), q)) + 0.0).alias("div_"), odd.alias("div_by_zero"), N.minimum(a, b).alias("min_"), N.maximum(a, b).alias("max_"), N.lt(a, b).alias("lt_"), N.le(a, b).alias("le_"), N.gt(a, b).alias("gt_"), N.ge(a, b).alias("ge_"), N.eq(a, b).alias("eq_"))


@query(f"with {_ITEMS} select l_orderkey, l_linenumber, abs(a) as abs_, round(exp(b), 6) as exp_, case when a > 0 then round(ln(a), 6) end as log_, case when a = 0 then '-inf' when a < 0 then 'nan' end as log_odd, -a as neg_, case when a >= 0 then round(sqrt(a), 6) end as sqrt_, round(pow(1.1, -b), 6) as power_ from items")
def scalar_unary(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    g, s = N.log(a), N.sqrt(a)
    odd = F.when(F.isnan(g), "nan").when(g == -N.INF, "-inf")
    return _items(spark, sf_dir).select(*_KEYS, N.absolute(a).alias("abs_"), r6(N.exp(b)).alias("exp_"), r6(F.when(odd.isNull(), g)).alias("log_"), odd.alias("log_odd"), N.neg(a).alias("neg_"), r6(F.when(~F.isnan(s), s)).alias("sqrt_"), r6(N.power(1.1, b)).alias("power_"))


@query(f"with {_ITEMS}, n as (select *, case when b <> 0 then a end as x, case when a > 0 then b > 0 end as choose from items) select l_orderkey, l_linenumber, case when choose then x when not choose then c end as chosen, x + c as strict_sum, case when x is not null and b is not null then least(x, b) end as strict_min, coalesce(x, 0) as with_default from n")
def select_gate(spark, sf_dir):
    """Validity: only the chosen side must be valid; algebra is strict; defaults fill in."""
    df = _items(spark, sf_dir).withColumns({"x": F.when(F.col("b") != 0, F.col("a")), "choose": F.when(F.col("a") > 0, F.col("b") > 0)})
    x, c = F.col("x"), F.col("c")
    return df.select(*_KEYS, N.select(x, c, F.col("choose")).alias("chosen"), N.add(x, c).alias("strict_sum"), N.minimum(x, F.col("b")).alias("strict_min"), events.with_default(x, 0.0).alias("with_default"))


@query(f"with {_ITEMS} select l_orderkey, l_linenumber, least(3, greatest(-3, a)) as clamped, case when a <= 0 then a - greatest(a, least(b, 0)) else a - least(a, greatest(b, 0)) end as discounted, case when b > 0 then 2.5 end as triggered, [a, b, c][2] as second from items")
def clamp_discount(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _items(spark, sf_dir).select(*_KEYS, N.clamp(a, 3).alias("clamped"), N.discount_by(a, b).alias("discounted"), N.triggered_constant(2.5, F.when(b > 0, b)).alias("triggered"), N.index(F.array("a", "b", "c"), 1).alias("second"))


@query(f"with {_ITEMS} select l_orderkey, l_linenumber, round(1 / (1 + exp(-b)), 6) as sigmoid, round(2 / (1 + exp(-b)) - 1, 6) as tanh_half, greatest(0, a) as relu, a as linear from items")
def activations(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _items(spark, sf_dir).select(*_KEYS, r6(N.sigmoid(b)).alias("sigmoid"), r6(N.tanh_half(b)).alias("tanh_half"), N.relu(a).alias("relu"), N.linear(a).alias("linear"))


@query(f"with {_ITEMS} select l_orderkey, l_linenumber, round((a + b) + (c + a * b) + b * c, 6) as tree_sum, least(a, b, c) as tree_min, greatest(a, b, c) as tree_max, (case when b > 0 then a else 0 end) + (case when a > 0 then b else 0 end) as slot_sum from items")
def tree_reduce(spark, sf_dir):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return _items(spark, sf_dir).select(*_KEYS, r6(N.tree_sum([a, b, c, a * b, b * c])).alias("tree_sum"), N.tree_min([a, b, c]).alias("tree_min"), N.tree_max([a, b, c]).alias("tree_max"), N.ephemeral_sum([F.when(b > 0, a), F.when(a > 0, b)]).alias("slot_sum"))


@query(_with("select seq, not buy as other, case when buy then least(price, 100.0) else greatest(price, 100.0) end as deepest, case when buy then greatest(price, 100.0) else least(price, 100.0) end as most_aggressive, case when buy then price < 100 else price > 100 end as deeper, case when buy then -size else size end as signed, ts_us // 1000 as ms from trades"))
def side_helpers(spark, sf_dir):
    buy, p = F.col("buy"), F.col("price")
    return derived.trades(spark, sf_dir).select("seq", M.other_side(buy).alias("other"), M.deepest(buy, p, F.lit(100.0)).alias("deepest"), M.most_aggressive(buy, p, F.lit(100.0)).alias("most_aggressive"), M.deeper(buy, p, F.lit(100.0)).alias("deeper"), M.flip_sign_if_buy(buy, F.col("size")).alias("signed"), M.ns_to_us(F.col("ts_us")).alias("ms"))


# -- order book
_UPDATES = "lagged as (select *, coalesce(lag(size) over (partition by sym, side, price order by ts_us, seq), 0) as previous_size from depth), updates as (select * from lagged where not (size = 0 and previous_size = 0))"
_FAIR = f"""sums as (select *, sum(case when side = 'B' then (size - previous_size) * exp({SCALE} * (price - 100)) else 0 end) over w as b,
  sum(case when side = 'S' then (size - previous_size) * exp(-{SCALE} * (price - 100)) else 0 end) over w as a,
  sum(case when side <> 'B' then 0 when size > 0 and previous_size = 0 then 1 when size = 0 then -1 else 0 end) over w as nb,
  sum(case when side <> 'S' then 0 when size > 0 and previous_size = 0 then 1 when size = 0 then -1 else 0 end) over w as na
  from updates window w as (partition by sym order by ts_us, seq rows unbounded preceding)
), fairs as (select *, case when nb > 0 and na > 0 and a > 0 and b > 0 then 100 + ln(b / a) / (2 * {SCALE}) end as fair from sums)"""


def _updates(spark, sf_dir) -> DataFrame:
    return book.level_updates(derived.depth(spark, sf_dir), ["sym"], block_us=BLOCK)


@query(_with("select seq, sym, side, price, previous_size, size from updates", _UPDATES))
def level_updates(spark, sf_dir):
    return _updates(spark, sf_dir).select("seq", "sym", "side", "price", "previous_size", "size")


def _fair(spark, sf_dir) -> DataFrame:
    return book.book_fair(materialize(_updates(spark, sf_dir), "updates"), ["sym"], SCALE, 100.0, block_us=BLOCK)


@query(_with("select seq, sym, round(fair, 6) as fair from fairs", _UPDATES, _FAIR))
def book_fair(spark, sf_dir):
    return _fair(spark, sf_dir).select("seq", "sym", r6("fair").alias("fair"))


SHARE_SCALE = 25.0
_RELATIVE = f"""shares as (select *, sum(case when side = 'B' then (size - previous_size) * exp({SHARE_SCALE} * (price - 100) / 100) else 0 end) over w as sb,
  sum(case when side = 'S' then (size - previous_size) * exp(-{SHARE_SCALE} * (price - 100) / 100) else 0 end) over w as sa
  from sums window w as (partition by sym order by ts_us, seq rows unbounded preceding))"""


@query(_with(f"select seq, sym, round(case when nb > 0 and na > 0 and sa > 0 and sb > 0 then 100 + 100 * ln(sb / sa) / (2 * {SHARE_SCALE}) end, 6) as fair from shares", _UPDATES, _FAIR, _RELATIVE))
def relative_fair(spark, sf_dir):
    """Book fair price with distances as shares of the reference price."""
    return book.relative_book_fair(materialize(_updates(spark, sf_dir), "updates"), ["sym"], SHARE_SCALE, 100.0, block_us=BLOCK).select("seq", "sym", r6("fair").alias("fair"))


WALK, MOVE = 3000, 5 * DAY_US
#: Depth whose prices jump by 3,000, three hundred times 1 / SCALE, again and again.
_WALK = f"""walk as (select seq, ts_us, sym, side, price + {WALK} * ((seq // 700) % 5) as price, size from depth),
walk_lags as (select *, coalesce(lag(size) over (partition by sym, side, price order by ts_us, seq), 0) as previous_size from walk),
walk_updates as (select * from walk_lags where not (size = 0 and previous_size = 0)),
walk_lives as (select *, lead(seq) over (partition by sym, side, price order by ts_us, seq) as until from walk)"""


def _log_sums(updates: str, lives: str, scale: str) -> str:
    """Tables ``log_sums`` (sym, seq, lb, la) from the levels alive after each update, by definition."""
    return f"""parts as (select u.sym, u.seq, a.side, (case when a.side = 'B' then 1 else -1 end) * ({scale}) * a.price + ln(a.size) as l
  from {updates} u join {lives} a on a.sym = u.sym and a.seq <= u.seq and (a.until is null or a.until > u.seq) and a.size > 0),
tops as (select sym, seq, side, max(l) as m from parts group by sym, seq, side),
sums_of as (select sym, seq, side, m + ln(sum(exp(l - m))) as total from parts join tops using (sym, seq, side) group by sym, seq, side, m),
log_sums as (select sym, seq, max(total) filter (side = 'B') as lb, max(total) filter (side = 'S') as la from sums_of group by sym, seq)"""


@query(_with(f"select u.seq, u.sym, round((lb - la) / (2 * {SCALE}), 6) as fair from walk_updates u left join log_sums using (sym, seq)", _WALK, _log_sums("walk_updates", "walk_lives", str(SCALE))))
def walking_fair(spark, sf_dir):
    """Fair prices of a market that walks by hundreds of times 1 / scale and back."""
    walk = derived.depth(spark, sf_dir).withColumn("price", F.col("price") + WALK * (F.floor(F.col("seq") / 700) % 5))
    updates = materialize(book.level_updates(walk, ["sym"], block_us=BLOCK), "updates")
    return book.book_fair(updates, ["sym"], SCALE, block_us=MOVE).select("seq", "sym", r6("fair").alias("fair"))


_MOVING = f"""ends_of as (select sym, ts_us // {MOVE} as block, arg_min(price, (ts_us, seq)) as opened, arg_max(price, (ts_us, seq)) as closed from updates group by all),
references_of as (select sym, block, coalesce(lag(closed) over (partition by sym order by block), opened) as reference from ends_of),
based as (select u.*, r.reference from updates u join references_of r on u.sym = r.sym and u.ts_us // {MOVE} = r.block),
lives as (select *, lead(seq) over (partition by sym, side, price order by ts_us, seq) as until from depth)"""


@query(_with(f"select b.seq, b.sym, reference, round(reference * (lb - la) / (2 * {SHARE_SCALE}), 6) as fair from based b left join log_sums using (sym, seq)", _UPDATES, _MOVING, _log_sums("based", "lives", f"{SHARE_SCALE} / u.reference")))
def moving_reference_fair(spark, sf_dir):
    """Book fair price with distances as shares of a reference price that is moved every five days."""
    return book.relative_book_fair(materialize(_updates(spark, sf_dir), "updates"), ["sym"], SHARE_SCALE, block_us=MOVE).select("seq", "sym", "reference", r6("fair").alias("fair"))


_FRESH = f"""block_starts as (select distinct sym, ts_us // {MOVE} as block from updates),
lasts_of as (select b.sym, b.block, u.side, u.price, arg_max(u.size, (u.ts_us, u.seq)) as size from block_starts b join updates u on u.sym = b.sym and u.ts_us // {MOVE} < b.block group by all)"""


@query(_with(f"select sym, block, side, floor({SCALE} * price / {book.BIN})::bigint as bin, round(sum(size * exp((case when side = 'B' then 1 else -1 end) * ({SCALE} * price - floor({SCALE} * price / {book.BIN}) * {book.BIN}))), 4) as fresh, false as drifted from lasts_of where size > 0 group by all", _UPDATES, _FRESH))
def impulse_drift(spark, sf_dir):
    """Impulse sums carried between blocks against those built afresh when a block begins."""
    found = book.drift(materialize(_updates(spark, sf_dir), "updates"), ["sym"], SCALE, block_us=MOVE)
    return found.where("fresh > 0").select("sym", "block", "side", "bin", F.round("fresh", 4).alias("fresh"), "drifted")


@query(_with(f"select seq, sym, round(case when side = 'B' then (size - previous_size) * exp({SCALE} * (price - fair)) else 0 end, 6) as bid_impulse, round(case when side = 'S' then (size - previous_size) * exp(-{SCALE} * (price - fair)) else 0 end, 6) as ask_impulse from fairs where fair is not null", _UPDATES, _FAIR))
def sided_impulse(spark, sf_dir):
    df = _fair(spark, sf_dir).where("fair is not null")
    bid, ask = book.sided_impulse(F.col("price"), F.col("previous_size"), F.col("size"), F.col("side") == "B", F.col("fair"), SCALE)
    return df.select("seq", "sym", r6(bid).alias("bid_impulse"), r6(ask).alias("ask_impulse"))


_MESSAGE = f"messages as (select *, ts_us // {6 * 3600 * SECOND} as message from fairs), lasts as (select sym, message, arg_max(fair, (ts_us, seq)) as last_fair from messages group by sym, message having last_fair is not null)"


@query(_with(f"select sym, message, round(coalesce(sum(case when side = 'B' then (size - previous_size) * exp({SCALE} * (price - last_fair)) end), 0), 6) as bid_impulse, round(coalesce(sum(case when side = 'S' then (size - previous_size) * exp(-{SCALE} * (price - last_fair)) end), 0), 6) as ask_impulse from messages join lasts using (sym, message) group by sym, message", _UPDATES, _FAIR, _MESSAGE))
def message_impulse(spark, sf_dir):
    """Impulses of all updates of a message (here: of six hours) around the fair price after it."""
    step = F.struct("ts_us", "seq", "price", "previous_size", F.col("size").alias("current_size"))
    sides = {s: F.array_sort(F.collect_list(F.when(F.col("side") == s, step))).alias(s) for s in "BS"}
    # arg_max leaves NULLs out: the last fair price that is there.
    fair = F.max_by("fair", F.when(F.col("fair").isNotNull(), F.struct("ts_us", "seq"))).alias("fair")
    messages = _fair(spark, sf_dir).groupBy("sym", F.floor(F.col("ts_us") / (6 * 3600 * SECOND)).alias("message")).agg(fair, *sides.values()).where("fair is not null")
    return messages.select("sym", "message", r6(book.message_impulse(F.col("B"), F.col("fair"), SCALE, 1.0)).alias("bid_impulse"), r6(book.message_impulse(F.col("S"), F.col("fair"), SCALE, -1.0)).alias("ask_impulse"))


_LIVE = """alive as (select sym, side, price, size, ts_us, seq, lead(seq) over (partition by sym, side, price order by ts_us, seq) as until from depth),
levels as (select d.sym, d.seq, d.ts_us, a.side, a.price, a.size from depth d join alive a on d.sym = a.sym and a.seq <= d.seq and (a.until is null or a.until > d.seq) and a.size > 0),
sides as (select d.sym, d.seq, d.ts_us, max(l.price) filter (where l.side = 'B') as bid, min(l.price) filter (where l.side = 'S') as ask,
  arg_max(l.size, l.price) filter (where l.side = 'B') as bid_size, arg_min(l.size, l.price) filter (where l.side = 'S') as ask_size
  from depth d left join levels l on d.sym = l.sym and d.seq = l.seq group by d.sym, d.seq, d.ts_us)"""


def _books(spark, sf_dir, most: int | None = None) -> DataFrame:
    depth = derived.depth(spark, sf_dir)
    return book.quotes(depth, ["sym"], most, block_us=5 * DAY_US) if most else book.snapshots(depth, ["sym"], block_us=5 * DAY_US)


@query(_with("select sym, seq, case when ask is not null then bid end as bid, case when bid is not null then ask end as ask, (bid + ask) / 2 as mid from sides", _LIVE))
def bbo_series(spark, sf_dir):
    q = _books(spark, sf_dir, 1).select("sym", "seq", book.bbo(F.col("bids"), F.col("asks")).alias("bbo"))
    return q.select("sym", "seq", M.bbo_bid_price(F.col("bbo")).alias("bid"), M.bbo_ask_price(F.col("bbo")).alias("ask"), M.bbo_mid(F.col("bbo")).alias("mid"))


@query(_with("select sym, seq, round((bid * ask_size + ask * bid_size) / (bid_size + ask_size), 6) as wmid from sides", _LIVE))
def wmid_series(spark, sf_dir):
    return _books(spark, sf_dir, 1).select("sym", "seq", r6(M.bbo_wmid(book.bbo(F.col("bids"), F.col("asks")))).alias("wmid"))


@query(_with("select sym, seq, side, row_number() over (partition by sym, seq, side order by case when side = 'B' then -price else price end) as depth, price, size from levels qualify depth <= 3", _LIVE))
def top_levels(spark, sf_dir):
    """Best three levels of each side after each message."""
    snaps = _books(spark, sf_dir, 3)
    parts = [snaps.select("sym", "seq", F.lit(s).alias("side"), F.posexplode(c).alias("at", "x")) for s, c in (("B", "bids"), ("S", "asks"))]
    return parts[0].unionByName(parts[1]).select("sym", "seq", "side", (F.col("at") + 1).cast("long").alias("depth"), "x.price", "x.size")


#: Greedy groups in SQL: a recursion over each side's levels, best first.
_GROUPED = f"""ranked as (select sym, seq, side, price, size, row_number() over (partition by sym, seq, side order by case when side = 'B' then -price else price end) as n from levels),
walk as (select sym, seq, side, n, price as start, 0 as g, price, size from ranked where n = 1
  union all select r.sym, r.seq, r.side, r.n, case when w.g > 0 and abs(r.price / w.start - 1) <= {RATIO} then w.start else r.price end,
    case when w.g > 0 and abs(r.price / w.start - 1) <= {RATIO} then w.g else w.g + 1 end, r.price, r.size
  from walk w join ranked r on w.sym = r.sym and w.seq = r.seq and w.side = r.side and r.n = w.n + 1)"""


@query(_with(f"select sym, seq, side, cast(g as int) as level, round(sum(price * size) / sum(size), 6) as price, round(sum(size), 6) as size from walk where g < {GROUPS} group by sym, seq, side, g", _LIVE, _GROUPED).replace("with ", "with recursive ", 1))
def book_aggregate(spark, sf_dir):
    """Groups of both sides after each message."""
    return _groups(materialize(_books(spark, sf_dir), "books"))


def _groups(snaps: DataFrame) -> DataFrame:
    parts = [snaps.select("sym", "seq", F.lit(s).alias("side"), F.posexplode(book.aggregate_levels(F.col(c), RATIO, GROUPS)).alias("level", "x")) for s, c in (("B", "bids"), ("S", "asks"))]
    return parts[0].unionByName(parts[1]).select("sym", "seq", "side", "level", r6("x.price").alias("price"), r6("x.size").alias("size"))


@query(SQL["book_aggregate"])
def book_aggregate_whole(spark, sf_dir):
    """The same under its older name; tested against brute force."""
    return book_aggregate(spark, sf_dir)


@query(_with(f"""select s.sym, s.seq, round((ln(t.b / t.a) / (2 * {SCALE / 100}) + 1) * mid / 10000, 6) as fair
  from (select *, (bid + ask) / 2 as mid from sides where bid is not null and ask is not null) s join lateral (
    select sum(case when side = 'B' then sqrt(size) * exp(10000 * (price - mid) / mid * {SCALE / 100}) end) as b, sum(case when side = 'S' then sqrt(size) * exp(10000 * (price - mid) / mid * {SCALE / 100}) end) as a
    from levels l where l.sym = s.sym and l.seq = s.seq and l.price in (s.bid, s.ask)) t on true""", _LIVE))
def static_fair(spark, sf_dir):
    q = _books(spark, sf_dir, 1).select("sym", "seq", book.bbo(F.col("bids"), F.col("asks")).alias("q")).where("q is not null")
    fair = book.static_fair([(F.col("q.bid.price"), F.col("q.bid.size"))], [(F.col("q.ask.price"), F.col("q.ask.size"))], M.bbo_mid(F.col("q")), SCALE / 100)
    return q.select("sym", "seq", r6(fair).alias("fair"))


RATIOS, SCALES = (RATIO / 2, RATIO, 2 * RATIO), (1e-3, 3e-3, 1e-2)


def _static_sql() -> tuple[list[str], list[str], str]:
    """Tables ``projected`` (r0..r8 and the projection) for the recursive WITH."""
    tables = ["ranked as (select sym, seq, side, price, size, row_number() over (partition by sym, seq, side order by case when side = 'B' then -price else price end) as n from levels)"]
    tables.append("quoted as (select sym, seq, ts_us, (bid + ask) / 2 as mid from sides where bid is not null and ask is not null)")
    names, joins = [], []
    for i, ratio in enumerate(RATIOS):
        near = f"w.g > 0 and abs(r.price / w.start - 1) <= {ratio!r}"
        tables.append(f"""walk{i} as (select sym, seq, side, n, price as start, 0 as g, price, size from ranked where n = 1
  union all select r.sym, r.seq, r.side, r.n, case when {near} then w.start else r.price end, case when {near} then w.g else w.g + 1 end, r.price, r.size
  from walk{i} w join ranked r on w.sym = r.sym and w.seq = r.seq and w.side = r.side and r.n = w.n + 1)""")
        tables.append(f"group{i} as (select sym, seq, side, sum(price * size) / sum(size) as price, sum(size) as size from walk{i} where g < {GROUPS} group by sym, seq, side, g)")
        fairs = []
        for j, scale in enumerate(SCALES):
            side = lambda s, sign: f"sum(case when side = '{s}' then sqrt(size) * exp(10000.0 * (price - mid) / mid * {sign * scale!r}) end)"  # noqa: B023, E731
            names.append(f"r{len(SCALES) * i + j}")
            fairs.append(f"((any_value(mid) * (1.0 + ln({side('B', 1)} / {side('S', -1)}) / (2.0 * {scale!r}) / 10000.0)) - any_value(mid)) / any_value(mid) as {names[-1]}")
        tables.append(f"return{i} as (select g.sym, g.seq, {', '.join(fairs)} from group{i} g join quoted q on g.sym = q.sym and g.seq = q.seq group by g.sym, g.seq)")
        joins.append(f"join return{i} using (sym, seq)")
    tables.append(f"returned as (select * from quoted {' '.join(joins)})")
    steps = S.Steps()
    out = S.cascade(steps, "static", names, _value, ("m", "d"))
    tables.append(f"projected as ({steps.select('*', 'returned, (select avg(r0) as m, stddev_samp(r0) as d from returned)')})")
    return tables, names, out


_STATIC, _STATIC_NAMES, _STATIC_OUT = _static_sql()


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


def _static_projection(spark, sf_dir) -> DataFrame:
    """sym, seq, ts_us, mid, the returns r0..r8 of static fair prices over aggregated books (three ratios, three scales)
    and what a cascade over them, normalised by the first, makes of them."""
    snaps = materialize(_books(spark, sf_dir).where("size(bids) > 0 and size(asks) > 0"), "books")
    mid = M.bbo_mid(book.bbo(F.col("bids"), F.col("asks")))
    made = models.staged(snaps, lambda: dict(zip(_STATIC_NAMES, signals.static_book_returns(F.col("bids"), F.col("asks"), mid, RATIOS, SCALES))))
    returns = materialize(made.select("sym", "seq", "ts_us", mid.alias("mid"), *_STATIC_NAMES), "returns")
    first = models.Normalizer(*sampled.summarize(returns, ["r0"])["r0"])
    return models.staged(returns, lambda: {"static": models.cascade([F.col(n) for n in _STATIC_NAMES], _parameter, "static", normalizer=first)})


@query(_recursive(_with(f"select sym, seq, {', '.join(f'round({n}, 6) + 0 as {n}' for n in _STATIC_NAMES)}, round({_STATIC_OUT} * mid + mid, 5) as projected from projected", _LIVE, *_STATIC)))
def static_book_combo(spark, sf_dir):
    """Static fair returns over aggregated books for three ratios and three scales, and the price they project."""
    got = _static_projection(spark, sf_dir)
    return got.select("sym", "seq", *[(r6(n) + 0.0).alias(n) for n in _STATIC_NAMES], F.round(F.col("static") * F.col("mid") + F.col("mid"), 5).alias("projected"))


# -- trades
_ISLANDS = f"""was as (select *, lag(buy) over w as was_buy, ts_us - lag(ts_us) over w as gap from trades window w as (partition by sym order by ts_us, seq)),
islands as (select *, sum(case when was_buy is null or buy <> was_buy or gap > {GAP} or gap >= {IDLE} then 1 else 0 end) over (partition by sym order by ts_us, seq rows unbounded preceding) as island from was)"""


def _islands(spark, sf_dir) -> DataFrame:
    return trades.tick_islands(derived.trades(spark, sf_dir), ["sym"], GAP, IDLE, block_us=BLOCK)


@query(_with("select seq, sym, cast(island as bigint) as island from islands", _ISLANDS))
def tick_islands(spark, sf_dir):
    return _islands(spark, sf_dir).select("seq", "sym", "island")


_IMPULSE = f"""joined as (select i.*, f.fair from islands i asof left join fairs f on i.sym = f.sym and i.ts_us >= f.ts_us),
parts as (select *, sum(price * size) over w as ps, case when buy then min(price) over w else max(price) over w end as deepest from joined window w as (partition by sym, island order by ts_us, seq rows unbounded preceding)),
raw as (select *, (case when buy then 1 else -1 end) * (1 - exp(-{SIZE_WEIGHT} * ps)) * exp(-greatest(-3, {DISTANCE_WEIGHT} * (case when buy then -1 else 1 end) * (deepest / fair - 1))) + 0 * fair as impulse from parts),
runs as (select *, last_value(impulse ignore nulls) over (partition by sym, island order by ts_us, seq rows unbounded preceding) as running from raw)"""


def _impulses(spark, sf_dir) -> DataFrame:
    """A scan reads its input twice, so a chain of scans is cut by tables lest the plan double at each."""
    fair = materialize(_fair(spark, sf_dir).select("sym", "ts_us", "seq", "fair"), "fair")
    return trades.tick_impulse(events.as_of(materialize(_islands(spark, sf_dir), "islands"), fair, ["sym"], ["fair"], block_us=BLOCK), ["sym"], SIZE_WEIGHT, DISTANCE_WEIGHT)


@query(_with("select seq, sym, cast(island as bigint) as island, round(running, 6) + 0 as running from runs", _UPDATES, _FAIR, _ISLANDS, _IMPULSE))
def tick_impulse(spark, sf_dir):
    return _impulses(spark, sf_dir).select("seq", "sym", "island", (r6("running") + 0.0).alias("running"))


_EMIT = "ends as (select sym, island, arg_max(running, seq) as tick from runs group by sym, island), begins as (select sym, island - 1 as island, min(ts_us) as ts_us, min(seq) as seq from runs group by sym, island), emitted as (select e.sym, e.island, b.ts_us, b.seq, e.tick from ends e join begins b using (sym, island))"


@query(_with("select sym, cast(island as bigint) as island, seq, round(tick, 6) + 0 as tick from emitted", _UPDATES, _FAIR, _ISLANDS, _IMPULSE, _EMIT))
def tick_emit(spark, sf_dir):
    return trades.tick_emit(_impulses(spark, sf_dir), ["sym"]).select("sym", "island", "seq", (r6("tick") + 0.0).alias("tick"))


@query(_with("select seq, sym, floor(n * 0.3) > floor((n - 1) * 0.3) as should_sample from numbered", _SAMPLED))
def bucket_sample(spark, sf_dir):
    return trades.bucket_sample(derived.trades(spark, sf_dir), ["sym"], 3.0, 10.0, block_us=BLOCK).select("seq", "sym", "should_sample")


_BUCKET = (3.0, 7.0, 2.0)
_LEVELS = f"""levels as (select 0 as k, {_BUCKET[1]} as level, false as full
  union all select k + 1, greatest({_BUCKET[2]}, level - {_BUCKET[0]} + case when level - {_BUCKET[0]} <= 0 then {_BUCKET[1]} else 0 end), level - {_BUCKET[0]} <= 0 from levels where k < (select max(n) from numbered))"""


@query(_recursive(_with("select seq, sym, l.full as should_sample from numbered join levels l on k = n", _SAMPLED, _LEVELS)))
def bucket_sample_least(spark, sf_dir):
    """A bucket that is never less full than its least level."""
    return trades.bucket_sample(derived.trades(spark, sf_dir), ["sym"], _BUCKET[0], _BUCKET[1], block_us=BLOCK, least=_BUCKET[2]).select("seq", "sym", "should_sample")


# -- decay
_STEP, _D = decay.step_us(HALF_LIFE), decay.factor(HALF_LIFE)
_GRID = f"span as (select sym, min(ts_us) as t0, max(ts_us) as t1 from trades group by sym), grid as (select sym, t0, k, t0 + k * {_STEP} as ts_us from span, lateral (select unnest(generate_series(0, (t1 - t0) // {_STEP})) as k))"


@query(_with(f"select sym, k, ts_us, case when k = 0 then 0 else {_D!r} end as decay from grid", _GRID))
def decay_grid(spark, sf_dir):
    return decay.decay_grid(derived.trades(spark, sf_dir), ["sym"], HALF_LIFE)


@query(_with(f"select g.sym, g.k, g.ts_us, round(coalesce(sum(t.size * pow({_D!r}, g.k - t.k)), 0), 4) as running_sum from grid g left join (select s.sym, s.size, cast(ceil((s.ts_us - p.t0) / {_STEP}.0) as bigint) as k from trades s join span p using (sym)) t on g.sym = t.sym and t.k <= g.k group by g.sym, g.k, g.ts_us", _GRID))
def running_sum_decay(spark, sf_dir):
    t = derived.trades(spark, sf_dir)
    return decay.running_sum(t, t, ["sym"], "size", HALF_LIFE).select("sym", "k", "ts_us", F.round("running_sum", 4).alias("running_sum"))


TICK_DECAY = 0.98
_MIXED = f"""steps as (select sym, ts_us, 0 as kind, k as seq, case when k = 0 then 1 else {_D!r} end as decay, 0.0::double as tick from grid
  union all select sym, ts_us, 1, seq, {TICK_DECAY}, coalesce(tick, 0) from emitted),
upto as (select *, row_number() over w as n, sum(ln(decay)) over w as log from steps window w as (partition by sym order by ts_us, kind, seq)),
pressure as (select a.sym, a.ts_us, a.n, sum(b.tick * exp(a.log - b.log)) as pressure from upto a join upto b on a.sym = b.sym and b.n <= a.n group by a.sym, a.ts_us, a.n)"""


def _pressure(spark, sf_dir, ticks: DataFrame) -> DataFrame:
    """Sum of the emitted ticks, decayed on the grid and by each emitted tick: sym, ts_us, seq (the number), pressure."""
    grid = decay.decay_grid(derived.trades(spark, sf_dir), ["sym"], HALF_LIFE).select("sym", "ts_us", F.lit(0).alias("kind"), F.col("k").alias("seq"), "decay", F.lit(0.0).alias("tick"))
    log = materialize(grid.unionByName(trades.tick_emit(ticks, ["sym"]).select("sym", "ts_us", F.lit(1).alias("kind"), "seq", F.lit(TICK_DECAY).alias("decay"), "tick")), "pressure-log")
    order = ["ts_us", "kind", "seq"]
    numbered = materialize(events.scan(log, ["sym"], order, {"n": ("count", F.lit(1))}, block_us=BLOCK).withColumn("n", F.col("n") - 1), "pressure-steps")
    summed = decay.running_sum_mixed(numbered, ["sym"], order, F.col("decay"), F.col("tick"), "pressure")
    return summed.select("sym", "ts_us", (F.col("n") + 1).alias("seq"), "pressure")


@query(_with("select sym, ts_us, cast(n as bigint) as n, round(pressure, 6) + 0 as pressure from pressure", _UPDATES, _FAIR, _ISLANDS, _IMPULSE, _EMIT, _GRID, _MIXED))
def running_sum_mixed(spark, sf_dir):
    """Ticks decayed on a timer grid and at each emitted tick."""
    got = _pressure(spark, sf_dir, materialize(_impulses(spark, sf_dir), "ticks"))
    return got.select("sym", "ts_us", F.col("seq").alias("n"), (r6("pressure") + 0.0).alias("pressure"))


_SIGNAL = f"read_ as (select g.sym, g.k, g.ts_us, t.price from (select *, ts_us - 1 as before from grid) g asof left join trades t on g.sym = t.sym and g.before >= t.ts_us), firsts as (select sym, min(k) as k0 from read_ where price is not null group by sym), averages as (select r.sym, r.k, r.ts_us, any_value(r.price) as price, sum(case when q.k = f.k0 then q.price else (1 - {_D!r}) * q.price end * pow({_D!r}, r.k - q.k)) as ewma from read_ r left join firsts f on r.sym = f.sym left join read_ q on r.sym = q.sym and q.k <= r.k and q.price is not null group by r.sym, r.k, r.ts_us)"


def _ewma(spark, sf_dir) -> DataFrame:
    return decay.ewma(derived.trades(spark, sf_dir), ["sym"], "price", HALF_LIFE, block_us=BLOCK)


@query(_with("select sym, k, ts_us, price, round(ewma, 6) as ewma from averages", _GRID, _SIGNAL))
def ewma_grid(spark, sf_dir):
    return _ewma(spark, sf_dir).select("sym", "k", "ts_us", "price", r6("ewma").alias("ewma"))


@query(_with("select sym, k, round(least(0.01, greatest(-0.01, (price - ewma) / price)), 6) + 0 as ret, round(price - ewma, 6) + 0 as difference from averages", _GRID, _SIGNAL).replace("least(0.01, greatest(-0.01, (price - ewma) / price))", "case when ewma is not null then least(0.01, greatest(-0.01, (price - ewma) / price)) end"))
def returns_vs_ewma(spark, sf_dir):
    p, e = F.col("price"), F.col("ewma")
    return _ewma(spark, sf_dir).select("sym", "k", (r6(decay.returns_against(p, e, 0.01)) + 0.0).alias("ret"), (r6(decay.difference_to(p, e)) + 0.0).alias("difference"))


@query(_with("select sym, k, round(((price - 0.5) - greatest(ewma - 0.5, price - 0.5)) / (price - 0.5) + ((price + 0.5) - least(ewma + 0.5, price + 0.5)) / (price + 0.5), 6) + 0 as sided from averages where ewma is not null", _GRID, _SIGNAL))
def sided_returns(spark, sf_dir):
    p, e, h = F.col("price"), F.col("ewma"), F.lit(0.5)
    return _ewma(spark, sf_dir).where("ewma is not null").select("sym", "k", (r6(decay.sided_returns(p - h, p + h, e - h, e + h)) + 0.0).alias("sided"))


def _move_sql() -> str:
    steps = S.Steps()
    ret = lambda x, a: S.clamp(f"({x} - {a}) / {x}", 0.01)
    xs = [steps.let("m0", ret("price", "ewma")), steps.let("m1", ret("(price + 0.25)", "ewma"))]
    xs.append(steps.let("m2", "((price - 0.5) - greatest(ewma - 0.5, price - 0.5)) / (price - 0.5) + ((price + 0.5) - least(ewma + 0.5, price + 0.5)) / (price + 0.5)"))
    S.cascade(steps, "decay", xs, _value)
    return f"moves as ({steps.select('*', 'averages')} where ewma is not null)"


_MOVE = _move_sql()


def _moves(averages: DataFrame) -> DataFrame:
    """``averages`` with the combined returns of two signals and of quotes half a point apart against their averages."""
    p, e, h = F.col("price"), F.col("ewma"), F.lit(0.5)
    return models.staged(averages, lambda: {"move": signals.decay_move([(p, e), (p + 0.25, e)], (p - h, p + h), (e - h, e + h), _parameter)})


@query(_with("select sym, k, round(decay, 6) + 0 as move from moves", _GRID, _SIGNAL, _MOVE))
def decay_move(spark, sf_dir):
    averages = materialize(_ewma(spark, sf_dir).where("ewma is not null"), "averages")
    return _moves(averages).select("sym", "k", (r6("move") + 0.0).alias("move"))


# -- sampling periods
_PERIODS = f"""vals as (select seq, ts_us, sym, case when seq % 97 <> 0 then price end as v from trades),
before as (select *, lag(v) over w as wv, lag(ts_us) over w as wt, row_number() over w as n from vals window w as (partition by sym order by ts_us, seq)),
periods as (select sym, ts_us // {DAY_US} * {DAY_US} as period_us, count(*) as n,
  case when max(case when v is null or (n > 1 and wv is null) then 1 else 0 end) = 0 and sum((ts_us - wt) // 10000) > 0 then sum(wv * ((ts_us - wt) // 10000)) / sum((ts_us - wt) // 10000) end as mean,
  min(least(v, wv)) as min, max(greatest(v, wv)) as max, case when count(*) = count(v) then sum(v) end as sum from before group by sym, ts_us // {DAY_US})"""


def _periods(spark, sf_dir) -> DataFrame:
    t = derived.trades(spark, sf_dir).withColumn("v", F.when(F.col("seq") % 97 != 0, F.col("price")))
    return sampled.sampled(t, ["sym"], "v", DAY_US, block_us=BLOCK)


@query(_with("select sym, period_us, round(mean, 6) as mean from periods", _PERIODS))
def sampled_mean_1d(spark, sf_dir):
    return _periods(spark, sf_dir).select("sym", "period_us", r6("mean").alias("mean"))


@query(_with("select sym, period_us, min, max from periods", _PERIODS))
def sampled_minmax_1d(spark, sf_dir):
    return _periods(spark, sf_dir).select("sym", "period_us", "min", "max")


@query(_with("select sym, period_us, n, round(sum, 6) as sum from periods", _PERIODS))
def sampled_sum_1d(spark, sf_dir):
    return _periods(spark, sf_dir).select("sym", "period_us", "n", r6("sum").alias("sum"))


_CUT = f"""cuts as (select sym, ts_us, seq from depth where size = 0),
log_of as (select sym, ts_us, 0 as source, seq, null::double as v from cuts union all select sym, ts_us, 1, seq, v from vals),
numbered_log as (select *, count(*) filter (source = 0) over w as period, max(case when source = 0 then ts_us end) over w as start_us from log_of window w as (partition by sym order by ts_us, source, seq rows unbounded preceding)),
cut_rows as (select n.*, b.wv, b.wt, b.n as place from numbered_log n join before b on n.sym = b.sym and n.seq = b.seq where n.source = 1)"""


@query(_with("""select sym, period, coalesce(start_us, -1) as start_us, count(*) as n,
  case when max(case when v is null or (place > 1 and wv is null) then 1 else 0 end) = 0 and sum((ts_us - wt) // 10000) > 0 then round(sum(wv * ((ts_us - wt) // 10000)) / sum((ts_us - wt) // 10000), 6) end as mean,
  min(least(v, wv)) as min, max(greatest(v, wv)) as max, case when count(*) = count(v) then round(sum(v), 6) end as sum from cut_rows group by sym, period, start_us""", _PERIODS, _CUT))
def sampled_between(spark, sf_dir):
    """Periods of a symbol's trades that deletions in its book begin."""
    t = derived.trades(spark, sf_dir).withColumn("v", F.when(F.col("seq") % 97 != 0, F.col("price")))
    cuts = derived.depth(spark, sf_dir).where("size = 0").select("sym", "ts_us", "seq")
    got = sampled.sampled_between(t, cuts, ["sym"], "v", block_us=BLOCK)
    return got.select("sym", "period", F.coalesce("start_us", F.lit(-1)).alias("start_us"), "n", r6("mean").alias("mean"), "min", "max", r6("sum").alias("sum"))


# -- models
_W = [0.5, -0.25, 2.0]


@query(f"with {_ITEMS}, s as (select avg(a) as m, stddev_samp(a) as d from items) select l_orderkey, l_linenumber, round((a - m) / d, 6) as normalized, round((a - m) / d * d + m, 6) as back from items, s")
def normalizer(spark, sf_dir):
    df = _items(spark, sf_dir)
    n = models.Normalizer(*sampled.summarize(df, ["a"])["a"])
    x = n.normalize(F.col("a"))
    return df.select(*_KEYS, r6(x).alias("normalized"), r6(n.denormalize(x)).alias("back"))


@query(f"with {_ITEMS} select l_orderkey, l_linenumber, round(a * {_W[0]} + b * {_W[1]} + c * {_W[2]} + 0.125, 6) as y from items")
def linreg(spark, sf_dir):
    return _items(spark, sf_dir).select(*_KEYS, r6(models.linreg([F.col(c) for c in "abc"], _W, 0.125)).alias("y"))


@query(f"with {_ITEMS} select l_orderkey, l_linenumber, round(greatest(least(a, b, c), least(greatest(a, b, c), a * {_W[0]} + b * {_W[1]} + c * {_W[2]})), 6) as y from items")
def bounded_sum(spark, sf_dir):
    return _items(spark, sf_dir).select(*_KEYS, r6(models.bounded_sum([F.col(c) for c in "abc"], _W)).alias("y"))


@query(f"with {_ITEMS}, w as (select *, exp(0.1 * (0.5 * abs(a))) as wa, exp(0.2 * (0.5 * abs(b))) as wb, exp(0.3 * (0.5 * abs(c))) as wc from items) select l_orderkey, l_linenumber, round((wa * a * 1.0 + wb * b * 0.5 + wc * c * 0.25) / (wa + wb + wc), 6) as y from w")
def soft_bounded_sum(spark, sf_dir):
    return _items(spark, sf_dir).select(*_KEYS, r6(models.soft_bounded_sum([F.col(c) for c in "abc"], [0.1, 0.2, 0.3], F.lit(0.5), [1.0, 0.5, 0.25])).alias("y"))


_DISC = lambda v, o: f"case when {v} <= 0 then {v} - greatest({v}, least(0.8 * {o}, 0)) else {v} - least({v}, greatest(0.8 * {o}, 0)) end"


@query(f"with {_ITEMS}, d as (select *, {_DISC('a', 'b')} as da, {_DISC('b', 'a')} as db from items), w as (select *, exp(0.1 * (0.05 * abs(da))) as wa, exp(0.2 * (0.05 * abs(db))) as wb from d) select l_orderkey, l_linenumber, round((wa * da * 0.9 + wb * db * 0.7) / (wa + wb), 6) as y from w")
def symmetric_move(spark, sf_dir):
    def moved():
        return {"y": r6(models.symmetric_move([F.col("a"), F.col("b")], [[0.1, 0.4], [0.3, 0.2]], F.lit(0.05), [[0.9, 0.8], [0.8, 0.7]]))}

    return models.staged(_items(spark, sf_dir), moved).select(*_KEYS, "y")


@query(f"with {_ITEMS} select l_orderkey, l_linenumber, round(greatest(0, 0.5 * a - 0.25 * b + 0.1), 6) as y0, round(greatest(0, 0.125 * a + 2 * b - 0.2), 6) as y1 from items")
def matmul_layer(spark, sf_dir):
    values = {"l_w_0_0": 0.5, "l_w_0_1": -0.25, "l_w_1_0": 0.125, "l_w_1_1": 2.0, "l_b_0": 0.1, "l_b_1": -0.2}
    y = models.mlp([F.col("a"), F.col("b")], [models.Layer("l", 2, 2, N.relu, lambda p: F.lit(values[p]))])
    return _items(spark, sf_dir).select(*_KEYS, r6(y[0]).alias("y0"), r6(y[1]).alias("y1"))


@query(f"with {_ITEMS}, h as (select *, 2 / (1 + exp(-(0.1 * a + 0.2 * b))) - 1 as h0, 2 / (1 + exp(-(0.3 * b - 0.1 * c + 0.5))) - 1 as h1 from items) select l_orderkey, l_linenumber, round(greatest(0, h0 - h1 + 0.25), 6) as y from h")
def mlp_forward(spark, sf_dir):
    y = models.wide_mlp(F.array("a", "b", "c"), [[[0.1, 0.2, 0.0], [0.0, 0.3, -0.1]], [[1.0, -1.0]]], [[0.0, 0.5], [0.25]], [N.tanh_half, N.relu])
    return _items(spark, sf_dir).select(*_KEYS, r6(F.get(y, F.lit(0))).alias("y"))


def _combo_sql() -> str:
    steps = S.Steps()
    xs = [steps.let("x0", "a / 25"), steps.let("x1", "b / 5"), steps.let("x2", "c * 10")]
    S.cascade(steps, "cascade", xs, _value, ("0.1::double", "2.0::double"))
    outs = S.small_mlp(steps, xs[:2], _value)
    rounded = ", ".join(f"round({x}, 6) + 0 as m{i}" for i, x in enumerate(outs))
    return f"with {_ITEMS}, computed as ({steps.select('*', 'items')}) select l_orderkey, l_linenumber, round(cascade, 6) + 0 as y, {rounded} from computed"


@query(_combo_sql())
def cascade_combo(spark, sf_dir):
    def combined():
        xs = [F.col("a") / 25, F.col("b") / 5, F.col("c") * 10]
        y = models.cascade(xs, _parameter, normalizer=models.Normalizer(F.lit(0.1), F.lit(2.0)))
        return {"y": r6(y) + 0.0} | {f"m{i}": r6(v) + 0.0 for i, v in enumerate(models.small_mlp(xs[:2], _parameter))}

    return models.staged(_items(spark, sf_dir), combined).drop("a", "b", "c")


@query(f"with {_ITEMS} select count(*) as n, round(avg((2 * b - a) * (2 * b - a)), 4) as mse, round(1 - sum((2 * b - a) * (2 * b - a)) / (var_pop(a) * count(a)), 6) as r2 from items")
def mse_r2(spark, sf_dir):
    return sampled.goodness(_items(spark, sf_dir).withColumn("p", 2 * F.col("b")), "p", "a").select("n", F.round("mse", 4).alias("mse"), r6("r2").alias("r2"))


@query(_with("select seq, cast(row_number() over (order by ts_us, seq) - 1 as bigint) as n, (row_number() over (order by ts_us, seq) - 1) * 5 < 4 * count(*) over () as is_train from trades"))
def train_split(spark, sf_dir):
    """Ordered 80/20 split; rows are numbered in time order without a global sort in one task."""
    t = number_rows(derived.trades(spark, sf_dir).select("seq", "ts_us"), F.col("ts_us"), ties=["seq"])
    total = t.count()
    return t.select("seq", "n", (F.col("n") * 5 < 4 * total).alias("is_train"))


def _linear_graph() -> autodiff.Graph:
    g = SignalGraph()
    x, y = g.get_external("a"), g.get_external("b")
    return autodiff.Graph.discover(x * g.make_parameter("w_a") + y * g.make_parameter("w_b"))


@query(f"with {_ITEMS}, e as (select a, b, 0.5 * a - 1.0 * b - 10 * c as err from items) select round(avg(err * err), 4) as loss, round(avg(2 * err * a), 4) as w_a, round(avg(2 * err * b), 4) as w_b from e")
def grad_linreg(spark, sf_dir):
    df = _items(spark, sf_dir)
    graph = _linear_graph()
    loss, grads = graph.gradients(df, {k: F.col(k[-1]) for k in graph.edges()}, {"w_a": 0.5, "w_b": -1.0}, autodiff.squared_error(10 * F.col("c")))
    return spark.createDataFrame([(round(loss, 4), round(grads["w_a"], 4), round(grads["w_b"], 4))], "loss double, w_a double, w_b double")


#: Least squares of the same rows in closed form.
_LEAST_SQUARES = """rows_of as (select a / 25 as a, b / 5 as b, 2 * (a / 25) - 0.4 * (b / 5) as z from items),
sums_of as (select sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * z) as az, sum(b * z) as bz from rows_of)"""


@query(f"with {_ITEMS}, {_LEAST_SQUARES} select round((az * bb - bz * ab) / (aa * bb - ab * ab), 3) as w_a, round((bz * aa - az * ab) / (aa * bb - ab * ab), 3) as w_b from sums_of")
def fit_linreg(spark, sf_dir):
    """Recover z = 2 a - 0.4 b by gradient descent, one aggregate an epoch."""
    df = materialize(_items(spark, sf_dir).select((F.col("a") / 25).alias("a"), (F.col("b") / 5).alias("b")), "fit-rows")
    graph = _linear_graph()
    got = autodiff.fit(graph, df, {k: F.col(k[-1]) for k in graph.edges()}, 2 * F.col("a") - 0.4 * F.col("b"), autodiff.Sgd(0.9), 60, {"w_a": 0.0, "w_b": 0.0}, stop_below=1e-12)
    return spark.createDataFrame([(round(got.params["w_a"], 3), round(got.params["w_b"], 3))], "w_a double, w_b double")


@query(f"with {_ITEMS} select l_orderkey, l_linenumber, round(case when a > b then a * c else 0.5 * (a - b) end + (a - (select avg(a) from items)) / (select stddev_samp(a) from items), 6) as y from items")
def graph_lowering(spark, sf_dir):
    """A signal graph with shared components and summaries, lowered to columns."""
    g = SignalGraph()
    a, b, c = (g.get_external(x) for x in "abc")
    y = g.op("select", a * c, (a - b) * 0.5, a > b) + (a - g.summarize(a, "mean")) / g.summarize(a, "std")
    return g.evaluate(_items(spark, sf_dir), {"y": y}).select(*_KEYS, r6("y").alias("y"))


# -- flagship
def _market_sql() -> str:
    steps = S.Steps()
    xs = [steps.let("x0", S.div("(fair - price)", "price")), steps.let("x1", "running / 100"), steps.let("x2", "pressure / 100"), steps.let("x3", S.clamp("(price - ewma) / price", 0.01)), steps.let("x4", "move"), steps.let("x5", "static")]
    steps.made[3] = ("x3", f"case when ewma is not null then {steps.made[3][1]} end")
    S.cascade(steps, "market", xs, _value)
    body = f"""with chosen as (select r.*, row_number() over (partition by sym order by ts_us, seq) as n from runs r),
    seen as (select c.seq, c.sym, c.ts_us, c.price, c.fair, c.running, p.pressure, a.ewma, v.decay as move, q.static, c.ts_us + {HORIZON} as due from (select * from chosen where n % 10 = 0) c
      asof left join pressures p on c.sym = p.sym and c.ts_us >= p.ts_us asof left join averages a on c.sym = a.sym and c.ts_us >= a.ts_us
      asof left join moves v on c.sym = v.sym and c.ts_us >= v.ts_us asof left join projected q on c.sym = q.sym and c.ts_us >= q.ts_us),
    computed as ({steps.select('*', 'seen')})
    select d.seq, d.sym, d.price, round(c.market, 6) + 0 as pred, f.price as future from due d join computed c using (seq) asof join trades f on d.sym = f.sym and d.due >= f.ts_us"""
    last = "pressures as (select sym, ts_us, arg_max(pressure, n) as pressure from pressure group by sym, ts_us)"
    return _recursive(_with(f"select * from ({body})", _LIVE, *_STATIC, _UPDATES, _FAIR, _ISLANDS, _IMPULSE, _EMIT, _GRID, _MIXED, last, _SIGNAL, _MOVE, _FUTURE))


@query(_market_sql())
def market_pred(spark, sf_dir):
    """A market's prediction at every tenth trade: tick impulse, book fair, ticks decayed on the grid and by each
    other, returns against averages, the decay move and the static book's projection, combined, with the price six
    hours on."""
    t = derived.trades(spark, sf_dir)
    ticks = materialize(_impulses(spark, sf_dir), "ticks")
    averages = materialize(_ewma(spark, sf_dir).withColumn("seq", F.col("k")), "averages")
    series = {
        "pressure": _pressure(spark, sf_dir, ticks),
        "ewma": averages.select("sym", "ts_us", "seq", "ewma"),
        "move": _moves(averages.where("ewma is not null")).select("sym", "ts_us", "seq", "move"),
        "static": _static_projection(spark, sf_dir).select("sym", "ts_us", "seq", "static"),
    }
    seen = trades.bucket_sample(ticks, ["sym"], block_us=BLOCK).where("should_sample").select("seq", "ts_us", "sym", "price", "fair", "running")
    for column, rows in series.items():
        seen = materialize(events.as_of(seen, materialize(rows, column), ["sym"], [column], block_us=BLOCK), "seen")
    p = F.col("price")
    xs = [N.div(F.col("fair") - p, p), F.col("running") / 100, F.col("pressure") / 100, decay.returns_against(p, F.col("ewma"), 0.01), F.col("move"), F.col("static")]
    names = [f"x{i}" for i in range(len(xs))]
    inputs = materialize(seen.withColumns(dict(zip(names, xs))), "inputs")
    predicted = models.staged(inputs, lambda: {"pred": models.cascade([F.col(n) for n in names], _parameter, "market")})
    return events.future_value(predicted, t, ["sym"], "price", HORIZON, "future", block_us=BLOCK).select("seq", "sym", "price", (r6("pred") + 0.0).alias("pred"), "future")


def _cascade_definition() -> Definition:
    """models.cascade as a component; its parameters' values are given by the function ``of`` among its settings."""

    def lower(i, g, p):
        normalizer = models.Normalizer(i["mean"], i["deviation"]) if "mean" in i else None
        return models.cascade(i["xs"], _parameter, p["prefix"], normalizer=normalizer)

    every = frozenset({"xs", "mean", "deviation"})
    return Definition("cascade", ("xs", "mean", "deviation"), {"out": OutputSpec()}, lower, arrays=frozenset({"xs"}), optional=frozenset({"mean", "deviation"}), generic=Callset(frozenset(), every), costly=True, strict=True)


def _returns_definition() -> Definition:
    """Returns of static fair prices over aggregated books, and the mid; invalid unless both sides have a level."""

    def lower(i, g, p):
        quoted = (F.size(i["bids"]) > 0) & (F.size(i["asks"]) > 0)
        bids, asks = (F.when(quoted, i[k]) for k in ("bids", "asks"))
        mid = M.bbo_mid(book.bbo(bids, asks))
        return dict(zip(_STATIC_NAMES, signals.static_book_returns(bids, asks, mid, RATIOS, SCALES)))

    gone = OutputSpec(ephemeral=True, assume_invalid=True)
    return Definition("static_returns", ("bids", "asks"), {n: gone for n in _STATIC_NAMES}, lower, generic=Callset(frozenset(), frozenset({"bids", "asks"})), costly=True)


def _move_definition() -> Definition:
    """The combined move of a signal and its quotes, half a point apart, against its average."""

    def lower(i, g, p):
        x, e, h = i["signal"], i["ewma"], F.lit(0.5)
        move = signals.decay_move([(x, e), (x + 0.25, e)], (x - h, x + h), (e - h, e + h), _parameter)
        return F.when(e.isNotNull(), move)

    return Definition("decay_move", ("signal", "ewma"), {"out": OutputSpec()}, lower, generic=Callset(frozenset(), frozenset({"signal", "ewma"})), costly=True)


def _market_graph() -> tuple[SignalGraph, dict[str, Output]]:
    """The market of ``market_pred`` as one graph of components over trades, depth and a timer."""
    extra = (_cascade_definition(), _returns_definition(), _move_definition())
    g = SignalGraph(stateful.stateful_definitions() | {d.name: d for d in extra})
    price, size, buy = g.get_external("price"), g.get_external("size"), g.get_external("buy", "bool")
    level = {"side": g.get_external("side", "string"), "price": g.get_external("level_price"), "size": g.get_external("level_size")}
    g.add_call_struct("depth", {"side": "string", "price": "double", "size": "double"})
    g.add_call_struct("trade", {"price": "double", "size": "double", "buy": "bool"})
    g.add_call_group("depth", "depth", {"side": "side", "price": "level_price", "size": "level_size"})
    g.add_call_group("trade", "trade", {"price": "price", "size": "size", "buy": "buy"})
    fair = g.make_component("book_fair", level, params={"scale": SCALE}).output("fair")
    tick = g.make_component("tick_detector", {"buy": buy}, params={"gap_us": GAP, "idle_us": IDLE}).output("tick")
    ticks = g.make_component("tick_aggregator", {"price": price, "size": size, "buy": buy, "fair": fair, "tick": tick}, params={"size_weight": SIZE_WEIGHT, "distance_weight": DISTANCE_WEIGHT})
    fires = g.make_component("exp_decay_source", params={"half_life_us": HALF_LIFE, "on": "trade"}).output("decay")
    emitted = ticks.output("tick")
    pressure = g.make_component("running_sum", {"tick": emitted, "decay": [fires, g.make_triggered_constant(TICK_DECAY, emitted)]}).output("running_sum")
    ewma = g.make_component("ewma", {"signal": price, "decay": [fires]}).output("ewma")
    move = g.op("hold", g.op("decay_move", price, ewma), fires)
    books = g.make_component("book_updater", level)
    returns = g.make_component("static_returns", {"bids": books.output("bids"), "asks": books.output("asks")})
    first = returns.output("r0")
    static = g.make_component("cascade", {"xs": [returns.output(n) for n in _STATIC_NAMES], "mean": g.summarize(first, "mean"), "deviation": g.summarize(first, "std")}, params={"prefix": "static"}).output()
    static = g.make_component("valid", {"value": static}).output()
    sample = g.make_component("bucket_sampler", {"trade": price}).output("should_sample")
    change = (price - ewma) / price
    inputs = [(fair - price) / price, ticks.output("running") / 100.0, pressure / 100.0, g.op("min", g.op("max", change, g.make_constant(-0.01)), g.make_constant(0.01)), move, static]
    pred = g.make_component("cascade", {"xs": inputs}, params={"prefix": "market"}, name="overall_pred").output()
    return g, {"price": price, "pred": pred, "sampled": sample}


@query(SQL["market_pred"])
def market_graph(spark, sf_dir):
    """``market_pred`` from a graph with stateful components, compiled to stages over one log."""
    t, d = derived.trades(spark, sf_dir), derived.depth(spark, sf_dir)
    log = t.withColumn("trigger", F.lit("trade")).unionByName(d.withColumnsRenamed({"price": "level_price", "size": "level_size"}).withColumn("trigger", F.lit("depth")), allowMissingColumns=True)
    graph, outputs = _market_graph()
    block_us = span_for(log, ["sym"], BLOCK)
    seen = materialize(stateful.run(graph, log, ["sym"], outputs, ["trade"], block_us=block_us, only=outputs["sampled"]), "seen")
    return events.future_value(seen, t, ["sym"], "price", HORIZON, "future", block_us=block_us).select("seq", "sym", "price", (r6("pred") + 0.0).alias("pred"), "future")
