"""Look-ups in small constant tables, and values named once, and folds along arrays, inside column expressions."""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Values that `scan` appends one by one; longer results are appended in blocks, so the copies stay short.
BLOCK = 64


def scan(items: Column, start: Column, step, emit, kind: str) -> Column:
    """`emit(state)` after each item as an array of `kind`, the state going from `start` by `step(state, item)`."""
    def pair(state, path) -> Column:
        return F.struct(state.alias("s"), path.alias("path"))

    none = F.array().cast(f"array<{kind}>")

    def one(acc, item):
        return let(step(acc["s"], item), lambda s: pair(s, F.concat(acc["path"], F.array(emit(s)))))

    def several(acc, block):
        return let(F.aggregate(block, pair(acc["s"], none), one), lambda d: pair(d["s"], F.concat(acc["path"], F.array(d["path"]))))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / BLOCK), F.lit(0)).cast("int")),
                         lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))
    return F.aggregate(blocks, pair(start, F.array().cast(f"array<array<{kind}>>")), several, lambda acc: F.flatten(acc["path"]))


def code_of(values: Sequence[str]):
    """A function of a text column: the place (from 1) of its value in `values`, 0 for others and null.

    The table is one constant, hashed by checksum, so a look-up compares a
    handful of values whatever their number. Callers check that number.
    """
    slots = max(1, 1 << max(len(values) - 1, 0).bit_length())
    texts: list[list[str]] = [[] for _ in range(slots)]
    codes: list[list[int]] = [[] for _ in range(slots)]
    for i, v in enumerate(values, 1):
        slot = zlib.crc32(v.encode()) % slots
        texts[slot].append(v)
        codes[slot].append(i)
    table = F.from_json(F.lit(json.dumps({"texts": texts, "codes": codes})), "texts array<array<string>>, codes array<array<int>>")

    def code(column: Column) -> Column:
        slot = (F.crc32(column) % slots).cast("int")
        place = F.array_position(F.get(table["texts"], slot), column)
        found = F.get(F.get(table["codes"], slot), (place - 1).cast("int"))
        return F.when(place > 0, found).otherwise(0)

    return code
