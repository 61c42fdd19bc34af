"""Exact arithmetic on decimal numbers that outgrow Spark's 38 digits, in SQL expressions.

A number is text such as ``-12.5`` or ``1e21``; results are plain text without needless
zeros.  Inside, a number times ``10**places`` is cut into limbs, each a number of ``WIDTH``
digits with the number's sign.  Sums add limb by limb, which Spark combines before the
shuffle, and one pass at the end carries what a limb holds too much.  No doubles, no Python.

Functions take and give SQL text, so an expression of hundreds of nodes is one call to Spark:
``expr(plus("a", "b"))``.  What a body needs twice is bound once, by :func:`_let`.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, IntegralType

#: Digits of a limb, limbs of a number, and decimal places of quantities: 90 digits before the point, 18 after it.
WIDTH, LIMBS, PLACES = 18, 6, 18
#: Products use limbs of half the width, as two of them multiply within 64 bits; a product has this many limbs of full width.
_HALF, PRODUCT = WIDTH // 2, 9
_NUMBER = r"r'^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,4})?$'"
_PARTS = r"r'^[+-]?([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$'"
_BASE = f"cast(1{'0' * WIDTH} as decimal(19,0))"
_names = itertools.count()


def expr(sql: str) -> Column:
    return F.expr(sql)


def _let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a value that is worked out once, however often it stands there."""
    v = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def _each(cells: str, body: Callable[[str], str]) -> str:
    v = f"v{next(_names)}"
    return f"transform({cells}, {v} -> {body(v)})"


def _whole(x: str) -> str:
    return f"cast({x} as decimal(38,0))"


def scaled(text: str, places: int = PLACES) -> str:
    """The number times ``10**places`` as a signed digit string; null if the text is no number.

    More decimal places than ``places`` are an error unless they are zeros: nothing is rounded.
    """

    def shifted(x: str) -> str:
        end = f"(length({x}.w) + {x}.e + {places})"
        kept = f"case when {end} <= 0 then '' else rpad(substring({x}.d, 1, {end}), {end}, '0') end"
        lost = f"trim(trailing '0' from substring({x}.d, greatest({end}, 0) + 1))"
        body = f"case when {lost} <> '' then raise_error(concat('more than {places} decimal places: ', {x}.t)) else trim(leading '0' from {kept}) end"
        return _let(body, lambda b: f"case when {b} = '' then '0' when {x}.t like '-%' then concat('-', {b}) else {b} end")

    def read(t: str) -> str:
        part = lambda k: f"regexp_extract({t}, {_PARTS}, {k})"
        fields = f"named_struct('w', {part(1)}, 'd', concat({part(1)}, {part(2)}), 'e', coalesce(cast(nullif({part(3)}, '') as int), 0), 't', {t})"
        return f"case when {t} rlike {_NUMBER} then {_let(fields, shifted)} end"

    return _let(text, read)


def _cut(digits: str, width: int, count: int) -> str:
    """Array of the limbs of a signed digit string, the lowest first."""
    whole = width * count

    def cells(d: str) -> str:
        body = f"trim(leading '-' from {d})"
        body = f"case when length({body}) > {whole} then raise_error(concat('more than {whole} digits: ', {d})) else lpad({body}, {whole}, '0') end"
        sign = f"if({d} like '-%', -1, 1)"
        return _let(body, lambda x: f"array({', '.join(f'cast(substring({x}, {whole - width * (k + 1) + 1}, {width}) as bigint) * {sign}' for k in range(count))})")

    return _let(digits, lambda d: f"case when {d} is not null then {cells(d)} end")


def _zeros(kind: str, n: int) -> str:
    return ", ".join([f"cast(0 as {kind})"] * n)


def _split(number: str) -> list[str]:
    """Limbs of a decimal of 18 places; the second holds all that stands before the point."""
    part = f"cast(pmod({number}, cast(1 as decimal(1,0))) as decimal(18,18))"
    return [f"cast({part} * {_BASE} as decimal(28,0))", f"cast(floor({number}) as decimal(28,0))"]


def _narrow(text: str) -> str:
    """The number as a decimal of 18 places where it is one, exactly; else null."""
    plain = f"length({text}) <= 38 and (instr({text}, '.') = 0 or length({text}) - instr({text}, '.') <= {PLACES}) and instr(lower({text}), 'e') = 0"
    return f"case when {plain} then try_cast({text} as decimal(38,18)) end"


def limb_count(kind: DataType, places: int = PLACES) -> int:
    """Limbs that numbers of a type fill: two for those of at most 20 digits before the point."""
    small = isinstance(kind, IntegralType) or isinstance(kind, DecimalType) and kind.scale <= WIDTH and kind.precision - kind.scale <= 20
    return 2 if places == WIDTH and small else LIMBS


def limbs(number: str, kind: DataType, places: int = PLACES) -> str:
    """Array of ``limb_count`` limbs of text, decimals, integers or doubles; null for null."""
    fill = lambda low: f"array({', '.join(low)}, {_zeros('decimal(28,0)', LIMBS - len(low))})"
    wide = lambda t: _each(_cut(scaled(t, places), WIDTH, LIMBS), lambda c: f"cast({c} as decimal(28,0))")

    def found(x: str) -> str:
        if limb_count(kind, places) == 2:
            cells = ["cast(0 as decimal(28,0))", f"cast({x} as decimal(28,0))"] if isinstance(kind, IntegralType) else _split(f"cast({x} as decimal(38,18))")
            return f"array({', '.join(cells)})"
        if places == WIDTH and isinstance(kind, DoubleType | FloatType):
            narrow = _let(f"cast(cast({x} as double) as decimal(38,18))", lambda d: fill(_split(d)))
            return f"case when abs({x}) < 1e18 then {narrow} else {wide(f'cast({x} as string)')} end"
        if places == WIDTH:
            return _let(f"cast({x} as string)", lambda t: _let(_narrow(t), lambda d: f"case when {d} is not null then {fill(_split(d))} else {wide(t)} end"))
        return wide(f"cast({x} as string)")

    return f"case when {number} is not null then {found(number) if number.startswith('`') else _let(number, found)} end"


def signed(cells: str, sign: str) -> str:
    """Limbs times a sign: 1, -1 or 0; null for a null sign."""
    return _let(sign, lambda s: _each(cells, lambda c: f"case when {s} > 0 then {c} when {s} < 0 then cast(-{c} as decimal(28,0)) when {s} = 0 then cast(0 as decimal(28,0)) end"))


def _carried(cells: str) -> str:
    """``low``: the cells as digits of base ``10**WIDTH``, none negative; ``above``: what is left above them, -1 if the number is negative."""
    acc, c = f"v{next(_names)}", f"v{next(_names)}"
    step = _let(
        _whole(f"{_whole(c)} + {acc}.above"),
        lambda x: _let(_whole(f"pmod({x}, {_BASE})"), lambda d: f"named_struct('low', concat({acc}.low, array({d})), 'above', {_whole(f'{_whole(f"{x} - {d}")} / {_BASE}')})"),
    )
    return f"aggregate({cells}, named_struct('low', cast(array() as array<decimal(38,0)>), 'above', {_whole('0')}), ({acc}, {c}) -> {step})"


def _small(known: str, count: int, places: int) -> str:
    """Text of a number whose limbs are near their digits, none of the upper ones in use, worked out without carrying; else null."""
    n = places // WIDTH
    near = [f"abs({known}[{k}]) < 8 * {_BASE}" for k in range(n + 1)] + [f"{known}[{k}] = 0" for k in range(n + 1, count)]
    low = _whole(f"{known}[0]") if n == 1 else _whole(f"{known}[0] + {_whole(f'{known}[1] * {_BASE}')}")
    one = f"cast(1{'0' * places} as decimal({places + 1},0))"

    def text(low: str) -> str:
        def made(part: str) -> str:
            whole = _whole(f"{known}[{n}] + {_whole(f'{_whole(f"{low} - {part}")} / {one}')}")
            shown_part = f"trim(trailing '0' from lpad(cast({part} as string), {places}, '0'))"
            return _let(whole, lambda w: _let(shown_part, lambda p: f"case when {w} >= 0 then concat(cast({w} as string), if({p} = '', '', '.'), {p}) end"))

        return _let(_whole(f"pmod({low}, {one})"), made)

    return f"case when {' and '.join(near)} then {_let(low, text)} end"


def shown(cells: str, count: int = LIMBS, places: int = PLACES) -> str:
    """Text of the number that an array of ``count`` limbs of any size and sign makes; null if the lowest is null."""
    at = WIDTH * count - places

    def text(found: str, sign: str) -> str:
        body = f"array_join({_each(f'reverse({found}.low)', lambda d: f"lpad(cast({d} as string), {WIDTH}, '0')")}, '')"
        body = f"case when {found}.above <> 0 then raise_error('more than {WIDTH * count} digits') else {body} end"

        def trimmed(b: str) -> str:
            part = f"trim(trailing '0' from substring({b}, {at + 1}, {places}))"
            whole = f"trim(leading '0' from substring({b}, 1, {at}))"
            return _let(part, lambda p: _let(whole, lambda w: f"concat('{sign}', if({w} = '', '0', {w}), if({p} = '', '', '.'), {p})"))

        return _let(body, trimmed)

    def general(known: str) -> str:
        flipped = _each(known, lambda c: f"-{c}")
        return _let(_carried(known), lambda c: f"case when {c}.above < 0 then {_let(_carried(flipped), lambda f: text(f, '-'))} else {text(c, '')} end")

    quick = lambda k: f"coalesce({_small(k, count, places)}, {general(k)})" if places in (WIDTH, 2 * WIDTH) and count > places // WIDTH else general(k)
    return _let(cells, lambda k: f"case when {k}[0] is not null then {quick(k)} end")


def filled(cells: str, count: int, kind: str = "decimal(28,0)") -> str:
    """Limbs with zeros above them, ``LIMBS`` in all."""
    return cells if count == LIMBS else f"concat({cells}, array({_zeros(kind, LIMBS - count)}))"


def text(number: str, kind: DataType, sign: str | None = None) -> str:
    """A number of any type, times a sign, as plain text."""
    cells = limbs(number, kind)
    return shown(filled(cells if sign is None else signed(cells, sign), limb_count(kind)))


#: Sums add cells of half a limb's width as 64-bit integers, exact over some 9 * 10^9 rows; more is an error, not a wrong sum.
_CELL = f"{10**_HALF}L"
#: Texts that are cut without a lambda: up to 36 digits before the point.
_SHORT, _SHORT_WHOLE = r"r'^-?[0-9]{1,36}([.][0-9]{1,18})?$'", 36


def _fraction(text: str, width: int) -> str:
    return f"rpad(if(instr({text}, '.') = 0, '', substring_index({text}, '.', -1)), {width}, '0')"


def _cells(rows: DataFrame, name: str, kind: DataType, places: int) -> tuple[DataFrame, list[str]]:
    """``rows`` with helper columns, and SQL of the cells of the column ``name``, lowest first; null for null."""
    x = f"`{name}`"
    if isinstance(kind, IntegralType) and places == PLACES:
        zero = f"if({x} is null, null, 0L)"
        return rows, [zero, zero, f"cast({x} as bigint) % {_CELL}", f"cast({x} as bigint) div {_CELL} % {_CELL}", f"cast({x} as bigint) div {_CELL} div {_CELL}"]
    if limb_count(kind, places) == 2 or (isinstance(kind, DoubleType | FloatType) and places == PLACES):
        near = f"abs({x}) < 1e18" if isinstance(kind, DoubleType | FloatType) else "true"
        rows = rows.withColumn(f"{name}_d", expr(f"case when {near} then cast(cast({x} as double) as decimal(38,18)) end" if near != "true" else f"cast({x} as decimal(38,18))"))
        d = f"`{name}_d`"
        rows = rows.withColumn(f"{name}_w", expr(f"case when abs({d}) < {_BASE} then cast({d} as bigint) end"))
        rows = rows.withColumn(f"{name}_f", expr(f"case when `{name}_w` is not null then cast(cast({d} % cast(1 as decimal(1,0)) as decimal(18,18)) * {_BASE} as bigint) end"))
        f, w = f"`{name}_f`", f"`{name}_w`"
        found = [f"{f} % {_CELL}", f"{f} div {_CELL}", f"{w} % {_CELL}", f"{w} div {_CELL}", "0L"]
        rows = rows.withColumn(f"{name}_x", expr(f"case when {x} is not null and {w} is null then {_cut(scaled(f'cast({x} as string)', places), _HALF, 2 * LIMBS)} end"))
        slow = lambda k: f"`{name}_x`[{k}]"
        count = len(found) if near == "true" else 2 * LIMBS
        return rows, [f"case when {w} is not null then {found[k]} else {slow(k)} end" if k < len(found) else slow(k) for k in range(count)]
    rows = rows.withColumn(f"{name}_t", expr(f"cast({x} as string)"))
    t, p, q = f"`{name}_t`", f"`{name}_p`", f"`{name}_q`"
    fits = f"{t} rlike {_SHORT}" if places == PLACES else "false"
    rows = rows.withColumn(f"{name}_p", expr(f"case when {fits} then lpad(trim(leading '-' from substring_index({t}, '.', 1)), {_SHORT_WHOLE}, '0') end"))
    slow = _cut(scaled(t, places), _HALF, 2 * LIMBS)
    rows = rows.withColumns({f"{name}_q": expr(f"case when {p} is not null then {_fraction(t, PLACES)} end"), f"{name}_x": expr(f"case when {t} is not null and {p} is null then {slow} end")})
    cell = lambda text, at: f"cast(substring({text}, {at}, {_HALF}) as bigint) * if({t} like '-%', -1, 1)"
    short = [cell(q, 1 + _HALF), cell(q, 1), *(cell(p, _SHORT_WHOLE - _HALF * (k + 1) + 1) for k in range(4))]
    return rows, [f"case when {p} is not null then {short[k]} else `{name}_x`[{k}] end" if k < len(short) else f"`{name}_x`[{k}]" for k in range(2 * LIMBS)]


def _short_text(cells: list[str]) -> str:
    """Text of a number of 18 places whose four to six cells decimals of 38 digits can hold; each cell stands in it a few times only."""
    ten = lambda k: f"cast(1{'0' * k} as decimal({k + 1},0))"
    part = _whole(f"cast({cells[0]} as decimal(20,0)) + cast({cells[1]} as decimal(20,0)) * {ten(_HALF)}")
    above = [_whole(f"cast({c} as decimal({9 if k == 3 else 20},0)) * {ten(_HALF * k)}") if k else _whole(c) for k, c in enumerate(cells[2:])]
    low = f"pmod({part}, {ten(WIDTH)})"
    whole = _whole(f"{' + '.join(above)} + {_whole(f'({part} - {low}) / {ten(WIDTH)}')}")
    shown_part = lambda x: f"trim(trailing '0' from lpad(cast({x} as string), {WIDTH}, '0'))"
    under = f"concat(if({whole} = -1, '-0', cast({whole} + 1 as string)), '.', {shown_part(_whole(f'{ten(WIDTH)} - {low}'))})"
    return f"case when {low} = 0 then cast({whole} as string) when {whole} >= 0 then concat(cast({whole} as string), '.', {shown_part(low)}) else {under} end"


def _near_text(cells: list[str]) -> str:
    """Text of a number of 18 places whose first four cells 64-bit numbers can hold, whatever their signs."""
    down = lambda x: f"(({x}) + {4 * 10**WIDTH}L) div {_CELL} - {4 * 10**_HALF}L"  # noqa: E731  rounded down
    upper = f"{cells[1]} + {down(cells[0])}"
    part, whole = f"(pmod({upper}, {_CELL}) * {_CELL} + pmod({cells[0]}, {_CELL}))", f"({cells[3]} * {_CELL} + {cells[2]} + {down(upper)})"
    shown_part = lambda p: f"trim(trailing '0' from lpad(cast({p} as string), {WIDTH}, '0'))"
    under = f"concat('-', cast(-1L - {whole} as string), '.', {shown_part(f'({10**WIDTH}L - {part})')})"
    return f"case when {whole} >= 0 then trim(trailing '.' from concat(cast({whole} as string), '.', {shown_part(part)})) when {part} = 0 then cast({whole} as string) else {under} end"


def _paired(cells: list[str]) -> str:
    """Array of limbs of full width from cells of half of it."""
    limb = lambda k: _whole(f"cast(coalesce({cells[2 * k]}, 0L) as decimal(38,0)) + cast(coalesce({cells[2 * k + 1]}, 0L) as decimal(20,0)) * cast({10**_HALF} as decimal(10,0))")
    return f"array({', '.join(limb(k) for k in range(len(cells) // 2))})"


def summed(rows: DataFrame, by: list[str], amounts: dict[str, Column | str | tuple[Column | str, Column]], *others: Column, places: int = PLACES) -> DataFrame:
    """``rows`` grouped by ``by``: the exact sum of each of ``amounts`` as text, and ``others``, which are aggregates.

    An amount may come with its sign, a column of 1, -1 or 0.  A sum is null where no amount
    of the group is known.
    """
    pairs = {n: c if isinstance(c, tuple) else (c, None) for n, c in amounts.items()}
    named = rows.withColumns({f"_{n}": F.col(c) if isinstance(c, str) else c for n, (c, _) in pairs.items()} | {f"_{n}_sign": F.signum(s.cast("int")).cast("long") for n, (_, s) in pairs.items() if s is not None})
    cells, first = {}, {}
    for n, (c, _) in pairs.items():
        if isinstance(c, str) and c in first:  # a column that several amounts take is cut once
            cells[n] = cells[first[c]]
            continue
        named, cells[n] = _cells(named, f"_{n}", named.schema[f"_{n}"].dataType, places)
        if isinstance(c, str):
            first[c] = n
            if [x for x, _ in pairs.values() if isinstance(x, str)].count(c) > 1:
                named = named.withColumns({f"_{n}_c{k}": expr(x) for k, x in enumerate(cells[n])})
                cells[n] = [f"`_{n}_c{k}`" for k in range(len(cells[n]))]
    times = lambda n: "" if pairs[n][1] is None else f" * `_{n}_sign`"
    got = named.groupBy(*by).agg(*(expr(f"sum(({c}){times(n)})").alias(f"_{n}_{k}") for n, found in cells.items() for k, c in enumerate(found)), *others)
    rest = [c for c in got.columns if c not in {*by, *(f"_{n}_{k}" for n in amounts for k in range(len(cells[n])))}]
    sums = {n: [f"`_{n}_{k}`" for k in range(len(c))] for n, c in cells.items()}

    def shows(n: str) -> str:
        """What has no digits in the upper cells is read off in generated code, most of it from 64-bit numbers."""
        x = [f"coalesce({c}, 0L)" for c in sums[n]]
        above = lambda k: [f"{c} = 0" for c in x[k:]]
        found = ["case", f"when {sums[n][0]} is null then null"]
        if places == PLACES:
            found.append(f"when {' and '.join([*(f'abs({c}) < {10**WIDTH}L' for c in x[:3]), f'abs({x[3]}) < {8 * 10**_HALF}L', *above(4)])} then {_near_text(x)}")
            if len(x) > 5:
                found.append(f"when {' and '.join([f'abs({x[5]}) < 100000000', *above(6)])} then {_short_text(x[:6])}")
        return " ".join([*found, f"else {shown(_paired([*sums[n], *['null'] * (2 * LIMBS - len(x))]), LIMBS, places)} end"])

    return got.select(*by, *(expr(shows(n)).alias(n) for n in amounts), *rest)


_STRING = DecimalType(38, 0)  # any type that takes the lane of text


def _text_limbs(a: str, places: int) -> str:
    return limbs(a, _STRING, places)


def plus(a: str, b: str, places: int = PLACES) -> str:
    """Exact sum of two texts; null if either is."""
    x, y = f"v{next(_names)}", f"v{next(_names)}"
    return shown(f"zip_with({_text_limbs(a, places)}, {_text_limbs(b, places)}, ({x}, {y}) -> {x} + {y})", LIMBS, places)


def negated(a: str) -> str:
    return _let(a, lambda x: f"case when {x} = '0' then {x} when {x} like '-%' then substring({x}, 2) else concat('-', {x}) end")


def minus(a: str, b: str, places: int = PLACES) -> str:
    return plus(a, negated(b), places)


def product_limbs(a: str, b: str) -> str:
    """Array of ``PRODUCT`` limbs of the product of two texts of ``PLACES`` places, twice as many after the point; sums of them over rows are exact too.

    ``a`` has up to 108 digits and ``b`` up to 54, those after the point included.
    """
    n, m, kind = 2 * LIMBS, LIMBS, "decimal(34,0)"

    def wide(x: str, y: str) -> str:
        cell = lambda k: " + ".join(f"{x}[{i}] * {y}[{k - i}]" for i in range(n) if 0 <= k - i < m) or "0"
        pair = lambda k: f"cast(cast({cell(2 * k)} as decimal(28,0)) + cast({cell(2 * k + 1)} as decimal(20,0)) * cast(1{'0' * _HALF} as decimal(10,0)) as {kind})"
        return f"array({', '.join(map(pair, range(PRODUCT)))})"

    def narrow(x: str, y: str) -> str:
        """Two limbs each, of up to 18 digits: four products, each cut in two again."""
        by = lambda i, j: _whole(f"cast({x}[{i}] as decimal(19,0)) * cast({y}[{j}] as decimal(19,0))")
        parts = f"array({by(0, 0)}, {_whole(f'{by(0, 1)} + {by(1, 0)}')}, {by(1, 1)})"
        cut = _each(parts, lambda p: _let(f"pmod({p}, {_BASE})", lambda r: f"named_struct('low', {r}, 'high', cast({_whole(f'{p} - {r}')} / {_BASE} as decimal(28,0)))"))
        cells = lambda c: [f"{c}[0].low", f"{c}[0].high + {c}[1].low", f"{c}[1].high + {c}[2].low", f"{c}[2].high"]
        return _let(cut, lambda c: f"array({', '.join(f'cast({x} as {kind})' for x in cells(c))}, {_zeros(kind, PRODUCT - 4)})")

    def made(p: str) -> str:
        fits = lambda d: f"{d} >= 0 and {d} < {_BASE}"
        quick = _let(f"array({', '.join(_split(f'{p}.x'))})", lambda x: _let(f"array({', '.join(_split(f'{p}.y'))})", lambda y: narrow(x, y)))
        slow = _let(_cut(scaled(f"{p}.a"), _HALF, n), lambda x: _let(_cut(scaled(f"{p}.b"), _HALF, m), lambda y: wide(x, y)))
        return f"case when {p}.a is null or {p}.b is null then null when {fits(f'{p}.x')} and {fits(f'{p}.y')} then {quick} else {slow} end"

    return f"case when {a} is not null and {b} is not null then " + _let(f"named_struct('a', {a}, 'b', {b})", lambda p: _let(f"named_struct('a', {p}.a, 'b', {p}.b, 'x', {_narrow(f'{p}.a')}, 'y', {_narrow(f'{p}.b')})", made)) + " end"


def times(a: str, b: str) -> str:
    """Exact product of two texts."""
    return shown(product_limbs(a, b), PRODUCT, 2 * PLACES)


#: Cells of half a limb's width in a product, and texts that are cut into two 64-bit numbers for it.
CELLS = 2 * PRODUCT
_NEAR = r"r'^-?[0-9]{1,18}([.][0-9]{1,18})?$'"


def product_cells(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with the exact products of pairs of text columns, each as ``CELLS`` 64-bit cells ``name_0``, ``name_1``, ..., the lowest first.

    Cells are null where a factor is; the upper ones are null too where they are not needed.
    Sums of cells over some 10^9 rows are exact; :func:`cells_text` reads them off.  Factors of up
    to 18 digits before the point take generated code, others the digits of :func:`product_limbs`.
    """
    kept = rows.columns
    factors = {c: f"`_{c}_w`" for pair in pairs.values() for c in pair}
    rows = rows.withColumns({f"_{c}_w": expr(f"case when `{c}` rlike {_NEAR} then cast(substring_index(`{c}`, '.', 1) as bigint) end") for c in factors})
    rows = rows.withColumns({f"_{c}_f": expr(f"case when {w} is not null then cast({_fraction(f'`{c}`', PLACES)} as bigint) * if(`{c}` like '-%', -1L, 1L) end") for c, w in factors.items()})
    part = lambda c, k: f"`_{c}_{'ffww'[k]}` {('%', 'div')[k % 2]} {_CELL}"
    rows = rows.withColumns({f"_{c}_h{k}": expr(part(c, k)) for c in factors for k in range(4)})
    column = lambda a, b, k: " + ".join(f"`_{a}_h{i}` * `_{b}_h{k - i}`" for i in range(4) if 0 <= k - i < 4)
    rows = rows.withColumns({f"_{n}_s{k}": expr(column(a, b, k)) for n, (a, b) in pairs.items() for k in range(7)})
    # what a cell holds above its width goes to the next one
    split = lambda at, n, k: " + ".join([*([f"{at(k - 1)} div {_CELL}"] if k else []), *([f"{at(k)} % {_CELL}"] if k < n else [])])

    def slow(a: str, b: str) -> str:
        n, m = 2 * LIMBS, LIMBS
        sums = lambda x, y: f"array({', '.join(' + '.join(f'{x}[{i}] * {y}[{k - i}]' for i in range(n) if 0 <= k - i < m) for k in range(n + m - 1))})"
        cells = lambda c: f"array({', '.join(split(lambda k: f'{c}[{k}]', n + m - 1, k) for k in range(CELLS))})"
        return _let(_cut(scaled(a), _HALF, n), lambda x: _let(_cut(scaled(b), _HALF, m), lambda y: _let(sums(x, y), cells)))

    rows = rows.withColumns({f"_{n}_x": expr(f"case when `_{n}_s0` is null and `{a}` is not null and `{b}` is not null then {slow(f'`{a}`', f'`{b}`')} end") for n, (a, b) in pairs.items()})
    # lambdas also keep Spark from fusing this with what comes before and after into one method too long for the JVM to compile
    cell = lambda n, k: _let(f"`_{n}_x`", lambda x: f"{x}[{k}]")
    near = lambda n, k: f"case when `_{n}_s0` is not null then {split(lambda j: f'`_{n}_s{j}`', 7, k) if k < 8 else 'null'} when `_{n}_x` is not null then {cell(n, k)} end"
    return rows.select(*kept, *(expr(near(n, k)).alias(f"{n}_{k}") for n in pairs for k in range(CELLS)))


def cells_text(cells: list[str]) -> str:
    """Text of the number of twice ``PLACES`` places that ``CELLS`` columns of cells make, none of them null."""
    above, digits = cells[0], []
    for k in range(4):
        digits.append(f"({above}) % {_CELL}")
        above = f"{cells[k + 1]} + ({above}) div {_CELL}"
    pair = lambda k: f"lpad(cast({digits[k + 1]} * {_CELL} + {digits[k]} as string), {WIDTH}, '0')"
    part = f"trim(trailing '0' from concat({pair(2)}, {pair(0)}))"
    quick = f"trim(trailing '.' from concat(cast({cells[5]} * {_CELL} + {above} as string), '.', {part}))"
    near = " and ".join([*(f"{c} between 0 and {10**WIDTH}L" for c in cells[:5]), f"{cells[5]} between 0 and {8 * 10**_HALF}L", *(f"{c} = 0" for c in cells[6:])])
    return f"case when {near} then {quick} else {shown(_paired(cells), PRODUCT, 2 * PLACES)} end"


def less(a: str, b: str, places: int = PLACES) -> str:
    return f"{minus(a, b, places)} like '-%'"
