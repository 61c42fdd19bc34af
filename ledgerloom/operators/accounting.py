"""Average-cost accounting by action group, exact in text of up to 108 digits.

One exchange deals entries out by transaction.  There one aggregate makes a row per group
and asset, and windows count what stands in its group and transaction.  What stands against
a row is then priced at the row's time, multiplied in 64-bit cells and summed over the group,
less the row's own.  Those rows, one per group and asset, are folded in order by a stream over
sorted partitions that holds five numbers, however long a history.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import wide
from ..sources.staging import stored
from . import pricing

#: Types of action and entry.
LP_ACTIONS, STAKE_ACTIONS = ["LP_ADD", "LP_REMOVE"], ["HEX_STAKE_START", "HEX_STAKE_END", "HEX_STAKE_LOCK"]
ACQUIRED, DISPOSED = ["RECEIVE", "SWAP_IN"], ["SEND", "SWAP_OUT"]


def _nonzero(entries: DataFrame) -> Column:
    q = F.col("quantity")
    return ~q.rlike(r"^[+-]?0*\.?0*$") if entries.schema["quantity"].dataType.typeName() == "string" else q != 0


def _group_assets(entries: DataFrame, tx: list[str], dealt: bool) -> DataFrame:
    """A row per group and asset: its sums, what it is, and counts over its group and transaction.

    The group's first entry and action are found before the aggregate and are among its keys, so
    that all it keeps are numbers, which Spark adds up in place.
    """
    group, of = [*tx, "group_id"], F.col
    is_in = (of("direction") == "IN") & of("entry_type").isin(ACQUIRED)
    is_out = (of("direction") == "OUT") & of("entry_type").isin(DISPOSED)
    is_fee, moves = of("entry_type") == "FEE", ~of("entry_type").isin("FEE", "INTERNAL_TRANSFER")
    live = (of("entry_type") != "FEE") & _nonzero(entries)
    side = lambda d: of("direction") == d
    known, only = of("occurred_at").isNotNull(), lambda c: F.when(c, 1)
    at = lambda c: F.when(F.count_if(c & ~known) == 0, F.min(F.when(c, of("occurred_at"))))
    w_group = Window.partitionBy(*group)
    first = {"first": F.min(F.struct("occurred_at", "id")).over(w_group), "action": F.min("action_type").over(w_group)}
    got = wide.summed(
        (entries if dealt else entries.repartition(*tx)).withColumns(first), [*group, "asset", "first", "action"],
        {"moved": ("quantity", only(is_in | is_out | is_fee)), "s_out": ("quantity", only(moves & side("OUT"))), "s_in": ("quantity", only(moves & side("IN"))), "paid": ("quantity", only(is_fee & side("OUT")))},
        F.bool_and(of("entry_type") == "INTERNAL_TRANSFER").alias("internal"),
        F.count_if(is_in).alias("n_in"), F.count_if(is_out).alias("n_out"), F.count_if(is_fee).alias("n_fee"), at(is_in).alias("at_in"), at(is_out).alias("at_out"),
        *(F.max(F.when(live & side(d), 1).otherwise(0)).alias(f"live_{d}") for d in ("IN", "OUT")),
    )
    blocked = F.when(of("action").isin(LP_ACTIONS), "UNSUPPORTED_LP_ACTION").when(of("action").isin(STAKE_ACTIONS), "UNSUPPORTED_STAKE_ACTION")
    acquire, dispose = (of("n_in") > 0) & (of("n_out") == 0) & (of("n_fee") == 0), (of("n_out") > 0) & (of("n_in") == 0)
    kind = F.when(blocked.isNotNull() | of("internal"), F.lit(None)).when(acquire, "acquire").when(dispose, "dispose")
    got = got.withColumn("blocked", blocked).withColumn("kind", kind)
    got = got.withColumn("at", F.when(of("kind") == "acquire", of("at_in")).when(of("kind") == "dispose", of("at_out")))
    # counts by group come before those by transaction, which the same order serves
    count = lambda by, w: {f"{by}_{d}": F.sum(f"live_{d}").over(w) for d in ("IN", "OUT")}
    got = got.withColumns(count("asset", Window.partitionBy(*tx, "asset")))
    got = got.withColumns(count("group", w_group) | {"times": F.sort_array(F.collect_set("at").over(w_group))})
    got = got.withColumns(count("tx", Window.partitionBy(*tx)))
    # others of the transaction less those of the group and of the asset, which both leave out the row itself
    return got.withColumns({f"others_{d}": of(f"tx_{d}") - of(f"group_{d}") - of(f"asset_{d}") + of(f"live_{d}") for d in ("IN", "OUT")})


def group_steps(entries: DataFrame, prices_at, dealt: bool = False) -> DataFrame:
    """``wallet, asset, group_id, first_at, first_id, kind, quantity, value, fees, code``: a row per group and asset it moves.

    ``entries``: ``wallet, asset, group_id, tx, id, action_type, entry_type, direction,
    quantity (text or number), occurred_at``, and ``chain_id`` if there are several; a group's
    entries are of one transaction and action.  ``prices_at(legs)`` adds ``price`` to distinct
    rows of ``asset, at`` (and ``chain_id``).  ``kind`` is ``acquire``, ``dispose`` or null;
    ``code`` says why a group has no effect, but for INSUFFICIENT_COST_BASIS, which the fold
    finds.  Numbers are exact, as text.  ``dealt``: entries are dealt out by ``tx`` already and need
    not travel for it.
    """
    tx = [*(["chain_id"] if "chain_id" in entries.columns else []), "wallet", "tx"]
    key = [c for c in tx if c == "chain_id"] + ["asset", "at"]
    own = _group_assets(entries, tx, dealt)
    own = stored(own.select(*tx, "group_id", "asset", "first", "action", "moved", "s_out", "s_in", "paid", "internal", "blocked", "kind", "at", "times", "others_IN", "others_OUT"), "group-assets")
    # a row for each time at which its group asks for prices: one, as a transaction has one time
    each = own.where("blocked is not null or kind is not null or not internal or size(times) > 0")
    each = each.withColumnRenamed("at", "own_at").select("*", F.posexplode_outer("times").alias("place", "at"))
    parts = {"out": ("s_out", F.col("s_out").isNotNull()), "in": ("s_in", F.col("s_in").isNotNull()), "fee": ("paid", F.col("paid").isNotNull())}
    asked = each.where("at is not null and (s_out is not null or s_in is not null or paid is not null)").select(*key).distinct()
    price = prices_at(asked)
    price = stored(price.withColumn("price", F.col("price").cast("string")), "leg-prices")
    priced = each.join(price, key, "left").repartition(*tx).sortWithinPartitions(*tx, "group_id", "at")
    w = Window.partitionBy(*tx, "group_id", "at")
    priced = wide.product_cells(priced, {f"w_{n}": (column, "price") for n, (column, _) in parts.items()})
    sums = {}
    for name, (_, there) in parts.items():
        lacks = there & F.col("price").isNull()
        sums |= {f"c_{name}": F.count_if(there).over(w) - there.cast("long"), f"gap_{name}": F.count_if(lacks).over(w) - lacks.cast("long")}
        sums |= {f"v_{name}_{k}": F.sum(f"w_{name}_{k}").over(w) for k in range(wide.CELLS)}
    step = priced.withColumns(sums).where("case when kind is null then place is null or place = 0 else at = own_at end and not (internal and blocked is null)")
    by_kind = lambda a, b: F.when(F.col("kind") == "acquire", a).when(F.col("kind") == "dispose", b)
    sources, gaps = by_kind(F.col("c_out"), F.col("c_in")), by_kind(F.col("gap_out"), F.col("gap_in")) + F.col("gap_fee")
    higher = F.col("action").isin("SWAP", *LP_ACTIONS, *STAKE_ACTIONS)
    sibling = by_kind(F.col("others_OUT"), F.col("others_IN")) > 0
    code = (
        F.when(F.col("blocked").isNotNull(), F.col("blocked")).when(F.col("kind").isNull(), "UNSUPPORTED_ACTION_GROUP")
        .when((sources == 0) & ~higher & sibling, "UNRESOLVED_ECONOMIC_COUPLING").when(gaps > 0, "COUNTER_ASSET_PRICE_UNAVAILABLE")
    )
    # the sums of the group less the row's own
    less = lambda n, k: f"coalesce(v_{n}_{k}, 0L) - coalesce(w_{n}_{k}, 0L)"
    step = step.withColumns({f"side_{k}": F.expr(f"if(kind = 'acquire', {less('out', k)}, {less('in', k)})") for k in range(wide.CELLS)} | {f"fees_{k}": F.expr(less("fee", k)) for k in range(wide.CELLS)} | {"sources": sources})
    money = lambda c, n: wide.expr(f"case when kind is null or {n} = 0 then '0' else {wide.cells_text([f'{c}_{k}' for k in range(wide.CELLS)])} end")
    # what comes in where a row acquires, what goes out and fees where it disposes: it has no others
    quantity = F.when(F.col("kind").isNotNull(), F.col("moved"))
    return step.select("wallet", "asset", "group_id", F.col("first.occurred_at").alias("first_at"), F.col("first.id").alias("first_id"), "kind", quantity.alias("quantity"), money("side", "sources").alias("value"), money("fees", "c_fee").alias("fees"), code.alias("code"))


_NUMBERS = ["holdings", "average_cost", "realized", "acquired", "disposed"]
_RESULT = "wallet {w}, asset {a}, " + ", ".join(f"{c} string" for c in _NUMBERS) + ", codes array<string>, cost string, last_at {t}, last_id {i}"
#: 40 significant digits, halves up.
_EXACT = Context(prec=40, rounding=ROUND_HALF_UP)


def plain(x: Decimal) -> str:
    """A decimal as text without an exponent and without needless zeros."""
    text = f"{x:f}"
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Steps of one key after the other, each in order; a row of kind ``state`` is where a key goes on."""
    exact = _EXACT
    key, state, last, out = None, None, None, []
    columns = ["wallet", "asset", *_NUMBERS, "codes", "cost", "last_at", "last_id"]
    fields = ["wallet", "asset", "kind", "quantity", "value", "fees", "code", "first_at", "first_id", "held"]

    def close():
        h, cost, realized, got, gone, codes = state
        mean = exact.divide(cost, h) if h else Decimal(0)
        out.append((*key, *map(plain, (h, mean, realized, got, gone)), sorted(codes), plain(cost), *last))

    for frame in frames:
        for wallet, asset, kind, q, value, fees, code, at, step, held in zip(*(frame[c] for c in fields), strict=True):
            if (wallet, asset) != key:
                if key is not None:
                    close()
                key, state = (wallet, asset), [*[Decimal(0)] * 5, set()]
            last = at, step
            if kind == "state":
                *numbers, codes = held.split("|")
                state = [*map(Decimal, numbers), set(filter(None, codes.split(",")))]
                continue
            q = Decimal(q) if q is not None else None
            if kind == "dispose" and q > state[0]:
                state[5].add("INSUFFICIENT_COST_BASIS")
            elif code is not None:
                state[5].add(code)
            elif kind == "acquire":
                state[0], state[1], state[3] = exact.add(state[0], q), exact.add(exact.add(state[1], Decimal(value)), Decimal(fees)), exact.add(state[3], q)
            else:
                cost = exact.multiply(exact.divide(state[1], state[0]) if state[0] else Decimal(0), q)
                state[0], state[1], state[4] = exact.subtract(state[0], q), exact.subtract(state[1], cost), exact.add(state[4], q)
                state[2] = exact.add(state[2], exact.subtract(exact.subtract(Decimal(value), Decimal(fees)), cost))
        if out:
            yield pd.DataFrame(out, columns=columns)
            out.clear()
    if key is not None:
        close()
        yield pd.DataFrame(out, columns=columns)


_STEP = ["wallet", "asset", "first_at", "first_id", "kind", "quantity", "value", "fees", "code"]


def states(steps: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """What :func:`folded` gives, with the total cost and the last step's time and id; ``held`` are states to go on from."""
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema.fields}
    rows = steps.select(*_STEP, F.lit(1).alias("turn"), F.lit(None).cast("string").alias("held"))
    if held is not None:
        none = [F.lit(None).cast(kinds[c]).alias(c) for c in ("quantity", "value", "fees", "code")]
        numbers = F.concat_ws("|", "holdings", "cost", "realized", "acquired", "disposed", F.array_join("codes", ","))  # as text: arrays are slow on the way to Python
        rows = rows.unionByName(held.select("wallet", "asset", F.col("last_at").alias("first_at"), F.col("last_id").alias("first_id"), F.lit("state").alias("kind"), *none, F.lit(0).alias("turn"), numbers.alias("held")))
    ordered = rows.repartition("wallet", "asset").sortWithinPartitions("wallet", "asset", "turn", "first_at", "first_id")
    return ordered.mapInPandas(_fold, _RESULT.format(w=kinds["wallet"], a=kinds["asset"], t=kinds["first_at"], i=kinds["first_id"]))


def folded(steps: DataFrame) -> DataFrame:
    """Holdings, average cost, realised profit, totals (text) and warning codes per wallet and asset.

    A key's steps depend on each other, so one task folds them; it reads them as a stream
    sorted by Spark, so memory does not grow with the key.
    """
    return states(steps).drop("cost", "last_at", "last_id")


def resumed(held: DataFrame, history: DataFrame, steps: DataFrame) -> DataFrame:
    """States after new ``steps``: the same as folding ``history`` and them from the start.

    ``held`` are the states after ``history``.  Keys whose new steps all stand after their last
    one go on from their state and read nothing else; a key with a step that comes late is
    folded again from ``history``; keys without new steps keep their state.
    """
    key, place = ["wallet", "asset"], F.struct("first_at", "first_id")
    touched = steps.select(*key).distinct()
    late = steps.join(held.select(*key, "last_at", "last_id"), key).where(place <= F.struct(F.col("last_at").alias("first_at"), F.col("last_id").alias("first_id"))).select(*key).distinct()
    again = history.select(*_STEP).join(late, key, "left_semi")
    going = held.join(touched, key, "left_semi").join(late, key, "left_anti")
    return states(steps.select(*_STEP).unionByName(again), going).unionByName(held.join(touched, key, "left_anti").select("wallet", "asset", *_NUMBERS, "codes", "cost", "last_at", "last_id"))


@F.pandas_udf(StringType())
def _gain(mark: pd.Series, cost: pd.Series, holdings: pd.Series) -> pd.Series:
    """What holdings would bring at a price above their average cost."""
    one = lambda m, c, h: None if m is None else plain(_EXACT.multiply(_EXACT.subtract(Decimal(m), Decimal(c)), Decimal(h)))
    return pd.Series([one(*row) for row in zip(mark, cost, holdings, strict=True)], dtype=object)


def marked(positions: DataFrame, marks: DataFrame) -> DataFrame:
    """With the price of today: unrealised profit, null without a price, and its warning."""
    got = positions.join(marks.select("asset", F.col("price").cast("string").alias("mark")), "asset", "left")
    codes = F.when(F.col("mark").isNull(), F.array_append("codes", F.lit("MARK_PRICE_UNAVAILABLE"))).otherwise(F.col("codes"))
    return got.select("wallet", "asset", "holdings", "average_cost", "realized", _gain("mark", "average_cost", "holdings").alias("unrealized"), "mark", "acquired", "disposed", codes.alias("codes"))


def profit(entries: DataFrame, prices_at, marks: DataFrame) -> DataFrame:
    return marked(folded(group_steps(entries, prices_at)), marks)


def priced_profit(entries: DataFrame, prices: DataFrame, now: Column, quote: str, least: float = 0.5, own_quote: str | None = None, width_s: int = 86_400, dealt: bool = False) -> DataFrame:
    """Profit with every leg and mark priced from stored observations ``chain_id, asset, quote, ...`` in one quote.

    Entries carry ``chain_id``.  A price that is disabled, assumed, stale or unsure at a leg's
    time does not count; a group that lacks one has no effect and leaves its code.
    """
    by = ("chain_id", "asset")
    prices_at = pricing.resolver(prices, quote, least, own_quote, by, width_s)
    positions = folded(group_steps(entries, prices_at, dealt))
    assets = entries.select("chain_id", "asset").distinct().withColumn("at", now)
    return marked(positions, prices_at(assets).groupBy("asset").agg(F.max("price").alias("price")))
