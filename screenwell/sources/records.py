"""Decode fixed-layout little-endian binary records with built-in expressions."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col
from ..schemas import LAYOUTS

_WIDTH = {"u8": 1, "bool": 1, "u16": 2, "u32": 4, "f32": 4, "u64": 8, "i64": 8}


def width_of(kind: str) -> int:
    if kind in _WIDTH:
        return _WIDTH[kind]
    if kind.startswith("enum"):
        return 1
    count = int(re.search(r"\d+$", kind).group())
    return count * 32 if kind.startswith("keys") else count


def offsets(layout) -> dict[str, tuple[int, str]]:
    """Byte offset and type of every field, counted after the 8-byte tag."""
    at, out = 8, {}
    for name, kind in layout:
        out[name] = (at, kind)
        at += width_of(kind)
    return out


def record_length(layout) -> int:
    return 8 + sum(width_of(kind) for _, kind in layout)


def _bytes(data: Column, at: int, n: int) -> Column:
    return F.substring(data, at + 1, n)


def _big_endian_hex(data: Column, at: int, n: int) -> Column:
    return F.concat(*[F.hex(_bytes(data, at + i, 1)) for i in reversed(range(n))])


def unsigned(data: Column, at: int, n: int) -> Column:
    """Unsigned integer; eight bytes need a decimal, as they may exceed a long."""
    text = F.conv(_big_endian_hex(data, at, n), 16, 10)
    return text.cast("decimal(20,0)") if n == 8 else text.cast("int" if n < 4 else "long")


def signed64(data: Column, at: int) -> Column:
    # conv with a negative base reads the 64 bits as two's complement
    return F.conv(_big_endian_hex(data, at, 8), 16, -10).cast("long")


def float32(data: Column, at: int) -> Column:
    """IEEE 754 single: sign, exponent and fraction put together exactly as a double."""
    bits = F.conv(_big_endian_hex(data, at, 4), 16, 10).cast("long")
    sign = F.when(bits.bitwiseAND(F.lit(1 << 31)) != 0, -1.0).otherwise(1.0)
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
    fraction = bits.bitwiseAND(F.lit((1 << 23) - 1))
    normal = (1 + fraction / float(1 << 23)) * F.pow(F.lit(2.0), exponent - 127)
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    small = fraction * float(2.0 ** -149)
    return (sign * F.when(exponent == 255, special).when(exponent == 0, small).otherwise(normal)).cast("float")


def field(data: Column, at: int, kind: str) -> Column:
    if kind.startswith("enum"):
        names = kind[4:].split("|")
        return F.get(F.array(*[F.lit(n) for n in names]), unsigned(data, at, 1))
    if kind == "bool":
        return unsigned(data, at, 1) != 0
    if kind == "f32":
        return float32(data, at)
    if kind == "i64":
        return signed64(data, at)
    if kind.startswith("keys"):
        return F.array(*[_bytes(data, at + 32 * i, 32) for i in range(int(kind[4:]))])
    if kind.startswith("bytes"):
        return _bytes(data, at, int(kind[5:]))
    return unsigned(data, at, width_of(kind))


def decode_records(df: DataFrame, data: str, layout, tag: bytes | None = None, keep=()) -> DataFrame:
    """Rows whose bytes carry `tag` and are long enough, one column per field.

    `layout` is a list of (name, type) or the name of a known record. The filter reads raw bytes,
    so other records are never decoded.
    """
    spec = LAYOUTS[layout] if isinstance(layout, str) else layout
    raw = F.col(data)
    tests = [F.octet_length(raw) >= record_length(spec)]
    if tag is not None:
        tests.append(_bytes(raw, 0, 8) == F.lit(tag))
    rows = df.filter(functools.reduce(lambda a, b: a & b, tests))
    fields = {name: field(raw, at, kind) for name, (at, kind) in offsets(spec).items()}
    if "smiles" in fields and "smiles_len" in fields:
        at = offsets(spec)["smiles"][0]
        fields["smiles"] = F.decode(F.substring(raw, F.lit(at + 1), fields["smiles_len"]), "UTF-8")
    return rows.select(*keep, *[c.alias(n) for n, c in fields.items()])


def encode_unsigned(value, n: int) -> Column:
    """The `n` little-endian bytes of a non-negative integer."""
    wide = F.lpad(F.hex(col(value).cast("long")), 2 * n, "0")
    return F.unhex(F.concat(*[F.substring(wide, 2 * i + 1, 2) for i in reversed(range(n))]))
