"""Order-insensitive content hashes built from Spark expressions.

A row hash is 64 bits wide. The fingerprint of a table is the exact sum of its
row hashes as a ``decimal(38,0)``, so it does not depend on row order or
partitioning and counts duplicates. A bigint sum would overflow, and an xor
would lose pairs of equal rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F, types as T

from tablekeep.functions.times import epoch_micros_sql

_PORTABLE_TEXT = (
    T.StringType,
    T.BooleanType,
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.DecimalType,
)
_PORTABLE_TIME = (T.TimestampNTZType, T.TimestampType)
_PORTABLE = (
    *_PORTABLE_TEXT, *_PORTABLE_TIME, T.DateType, T.FloatType, T.DoubleType, T.BinaryType
)

# A double is brought to below 2 ** 60 by a power of 2 ** 100, which loses no bit; its whole part
# and 100 bits of its fraction are then three whole numbers.
DOUBLE_STEP, DOUBLE_STEPS, DOUBLE_ROOM, DOUBLE_BITS = 100, 10, 60, 50
DOUBLE_CENTS = 40  # whole hundredths below two to this are written as such


def quoted(name: str) -> str:
    """A column name as SQL, dots and back quotes included."""
    return "`" + name.replace("`", "``") + "`"


def column_of(name: str) -> Column:
    """Column by exact name."""
    return F.col(quoted(name))


def free_name(taken: Iterable[str], name: str) -> str:
    """A column name none of the taken ones equals, whatever its case."""
    low = {t.lower() for t in taken}
    name = f"__{name}"
    while name in low:
        name += "_"
    return name


def _flat(data_type: T.DataType) -> bool:
    return not isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def _nested(value: Column, data_type: T.DataType) -> Column:
    """A form of a nested value whose hash tells NULLs and boundaries apart.

    ``xxhash64`` skips NULLs and chains over elements, so [1, NULL] and
    [NULL, 1], or [1], [2, 3] and [1, 2], [3], would otherwise hash alike.
    """
    if isinstance(data_type, T.ArrayType):
        size = F.coalesce(F.size(value), F.lit(-1))
        if _flat(data_type.elementType):
            # Not spared where the schema rules out NULLs: a copy read back may
            # allow them and must hash the same.
            gaps = F.transform(value, lambda e: e.isNull())
            return F.struct(size, gaps, value)
        return F.struct(
            size, F.transform(value, lambda e: _nested(e, data_type.elementType))
        )
    if isinstance(data_type, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(
                F.xxhash64(_nested(e["key"], data_type.keyType)).alias("k"),
                F.xxhash64(_nested(e["value"], data_type.valueType)).alias("v"),
            ),
        )
        return F.struct(F.coalesce(F.size(value), F.lit(-1)), F.array_sort(entries))
    if isinstance(data_type, T.StructType):
        return F.struct(
            value.isNull(),
            *[_nested(value.getField(f.name), f.dataType) for f in data_type.fields],
        )
    if isinstance(data_type, T.VariantType):
        value = F.to_json(value)
    return F.struct(value.isNull(), value)


def row_hash(schema: T.StructType, salt: int | None = None) -> Column:
    """64-bit hash of a whole row; NULL positions count.

    Hashes with different salts are independent of each other.
    """
    flat = [quoted(f.name) for f in schema.fields if _flat(f.dataType)]
    parts = _bit_masks([f"{value} IS NULL" for value in flat])
    parts += [] if salt is None else [str(salt)]
    if len(flat) == len(schema.fields):  # as one text, which the driver hands over at once
        return F.expr(f"xxhash64({', '.join(parts + flat)})")
    columns = [
        column_of(f.name) if _flat(f.dataType) else _nested(column_of(f.name), f.dataType)
        for f in schema.fields
    ]
    return F.xxhash64(*map(F.expr, parts), *columns)


def _bit_masks(flags: list[str]) -> list[str]:
    """The flags as bits of as few bigints as hold them."""
    width = 62
    masks = []
    for start in range(0, len(flags), width):
        bits = [f"shiftleft(CAST({flag} AS BIGINT), {bit})" for bit, flag in enumerate(flags[start : start + width])]
        masks.append(" + ".join(["0L", *bits]))
    return masks


def portable_columns(schema: T.StructType) -> list[str]:
    """Columns whose text form is the same in every SQL engine: all but maps, structs and such."""
    return [f.name for f in schema.fields if _is_portable(f.dataType)]


def _is_portable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _is_portable(data_type.elementType)
    return isinstance(data_type, _PORTABLE)


def _double(value: float) -> str:
    return f"{value!r}D"


def _bound(value: str, name: str, use: str) -> str:
    """What is made of a value that is computed once and then called by a name."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _parts_text(power: str, scaled: str) -> str:
    one = f"CAST({scaled} AS BIGINT)"
    rest = f"(({scaled} - {one}) * {_double(2.0**DOUBLE_BITS)})"
    two = f"CAST({rest} AS BIGINT)"
    three = f"CAST(({rest} - {two}) * {_double(2.0**DOUBLE_BITS)} AS BIGINT)"
    return f"concat_ws('/', {power}, {one}, {two}, {three})"


def _scaled_text(value: str) -> str:
    """A finite double as whole numbers: the power it was scaled by, then its parts."""
    power, factor = [], []
    for step in range(-DOUBLE_STEPS, DOUBLE_STEPS):
        below = f"WHEN abs({value}) < {_double(2.0 ** (DOUBLE_STEP * step + DOUBLE_ROOM))} THEN"
        power.append(f"{below} {step}")
        factor.append(f"{below} {_double(2.0 ** (-DOUBLE_STEP * step))}")
    power.append(f"ELSE {DOUBLE_STEPS}")
    factor.append(f"ELSE {_double(2.0 ** (-DOUBLE_STEP * DOUBLE_STEPS))}")
    scaled = f"{value} * CASE {' '.join(factor)} END"
    both = f"named_struct('power', CASE {' '.join(power)} END, 'scaled', {scaled})"
    return _bound(both, "both", _parts_text("both.power", "both.scaled"))


def _double_text(value: str) -> str:
    """A double as text: ``c`` and hundredths if it is exactly those, else whole numbers.

    The plain cases come first and are short; the rest is bound, which keeps the expression small.
    """
    size, cents = f"abs({value})", f"floor({value} * 100 + 0.5D)"
    room, least = _double(2.0**DOUBLE_ROOM), _double(2.0 ** (DOUBLE_ROOM - DOUBLE_STEP))
    return (
        f"CASE WHEN {value} IS NULL THEN NULL"
        f" WHEN {size} < {_double(2.0**DOUBLE_CENTS)} AND CAST({cents} AS DOUBLE) / 100 = {value}"
        f" THEN concat('c', {cents})"
        f" WHEN {size} < {room} AND {size} >= {least} THEN {_parts_text('0', value)}"
        f" WHEN isnan({value}) THEN 'nan'"
        f" WHEN {size} = CAST('Infinity' AS DOUBLE) THEN CASE WHEN {value} > 0 THEN 'inf' ELSE '-inf' END"
        f" ELSE {_bound(value, 'whole', _scaled_text('whole'))} END"
    )


def _marked(text: str) -> str:
    """``<length>:<text>``, or ``N`` for NULL."""
    return f"coalesce(concat(CAST(length({text}) AS STRING), ':', {text}), 'N')"


def _portable_text(value: str, data_type: T.DataType, depth: int = 0) -> str:
    """A value as text; NULL stays NULL.

    Written as SQL, which the driver hands over at once: made of single columns it took seconds per table.
    """
    if isinstance(data_type, T.ArrayType):
        each, text = f"each{depth}", f"text{depth}"
        texts = f"transform({value}, {each} -> {_portable_text(each, data_type.elementType, depth + 1)})"
        parts = f"transform({texts}, {text} -> {_marked(text)})"
        return f"concat(CAST(size({value}) AS STRING), '[', array_join({parts}, ''))"
    if isinstance(data_type, _PORTABLE_TIME):
        return f"CAST({epoch_micros_sql(value)} AS STRING)"
    if isinstance(data_type, T.DateType):
        return f"CAST(unix_date({value}) AS STRING)"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return _double_text(value if isinstance(data_type, T.DoubleType) else f"CAST({value} AS DOUBLE)")
    if isinstance(data_type, T.BinaryType):
        return f"hex({value})"
    return f"CAST({value} AS STRING)"


def portable_row_hash(schema: T.StructType, columns: list[str] | None = None) -> Column:
    """First 64 bits of the md5 of a text form any SQL engine can rebuild.

    Each value is written as ``<length>:<text>`` and NULL as ``N``, elements of
    arrays too, so no two rows share a text. Times are written as microseconds
    since the epoch, dates as days, doubles exactly as whole numbers, bytes in
    hexadecimal, arrays as their size and their elements.
    Without ``columns`` every column has to have such a form.
    """
    names = columns or [f.name for f in schema.fields]
    digest = F.md5(portable_key_text(schema, names))
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint")


def portable_key_text(schema: T.StructType, names: list[str]) -> Column:
    """The text that :func:`portable_row_hash` hashes; different for different values."""
    unknown = set(names) - set(portable_columns(schema))
    if unknown:
        raise ValueError(f"no portable text form for columns {sorted(unknown)}")
    parts = [_marked(_portable_text(quoted(name), schema[name].dataType)) for name in names]
    return F.expr(f"concat({', '.join(parts)})") if parts else F.lit("")


def fingerprint_parts(hash64: Column) -> list[Column]:
    """Aggregates ``row_count`` and ``fingerprint`` over row hashes."""
    total = F.sum(hash64.cast("decimal(28,0)"))
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(total, F.lit(0).cast("decimal(38,0)")).alias("fingerprint"),
    ]
