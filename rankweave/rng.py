"""Counter-based pseudo-random integers from 64-bit integer arithmetic only.

A draw is a pure function of (seed, counters): every retry, partitioning and SQL engine
gives the same number, and no state passes between tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

# A public 32-bit integer mixing function (xor-shift and multiply, twice).
MULTIPLIER = 73244475
MASK = 4294967295
SPAN = 4294967296.0


def mix(x: int) -> int:
    """The mixing function on a Python integer."""
    x &= MASK
    x = ((x ^ (x >> 16)) * MULTIPLIER) & MASK
    x = ((x ^ (x >> 16)) * MULTIPLIER) & MASK
    return x ^ (x >> 16)


def mix_array(x: np.ndarray) -> np.ndarray:
    """The mixing function on an integer array."""
    mask, factor, shift = np.int64(MASK), np.int64(MULTIPLIER), np.int64(16)
    x = x & mask
    x = ((x ^ (x >> shift)) * factor) & mask
    x = ((x ^ (x >> shift)) * factor) & mask
    return x ^ (x >> shift)


def absorb_array(state, counter) -> np.ndarray:
    """Fold one counter into the state, as ``with_random`` does per column."""
    counter = np.asarray(counter, dtype=np.int64)
    return mix_array(state + (counter & np.int64(MASK)) + (counter >> np.int64(32)))


def with_random(df: DataFrame, name: str, seed: int, *counters: Column | str) -> DataFrame:
    """Add ``name``: an integer in [0, 2^32) determined by the seed and counters."""
    return with_randoms(df, {name: seed}, *counters)


def with_randoms(df: DataFrame, seeds: dict[str, int], *counters: Column | str) -> DataFrame:
    """Add one draw per entry of ``seeds`` (name to seed), all for the same counters.

    Built in stages, because each stage uses the one before twice; one projection per stage
    serves all names.
    """
    kept = [f"`{c}`" for c in df.columns if c not in seeds]
    made = {f"_counter_{i}": c for i, c in enumerate(counters) if not isinstance(c, str)}
    if made:
        df = df.select(*kept, *[c.cast("long").alias(n) for n, c in made.items()])
    carried = [*kept, *made]
    states = {name: f"{mix(seed)}L" for name, seed in seeds.items()}
    for i, counter in enumerate(counters):
        value = f"CAST(`{counter}` AS BIGINT)" if isinstance(counter, str) else f"_counter_{i}"
        folded = f"({value} & {MASK}L) + shiftrightunsigned({value}, 32)"
        df = df.selectExpr(*carried, *[f"({state} + {folded}) & {MASK}L AS `_x_{n}`" for n, state in states.items()])
        for _ in range(2):
            df = df.selectExpr(*carried, *[
                f"((`_x_{n}` ^ shiftright(`_x_{n}`, 16)) * {MULTIPLIER}L) & {MASK}L AS `_x_{n}`" for n in states])
        states = {n: f"(`_x_{n}` ^ shiftright(`_x_{n}`, 16))" for n in states}
    # Never null: otherwise a join on a draw would add a null check that Catalyst pushes
    # below the stages, writing the whole hash out many times over.
    return df.selectExpr(*kept, *[f"coalesce({state}, 0L) AS `{n}`" for n, state in states.items()])


def random_sql(name: str, seed: int, *counters: str) -> str:
    """The same draw as DuckDB select items (each may use the ones before it)."""
    state, items = f"CAST({mix(seed)} AS BIGINT)", []
    for index, counter in enumerate(counters):
        a, b, c, d = (f"{name}_{index}_{part}" for part in range(4))
        value = f"CAST({counter} AS BIGINT)"
        items.append(f"(({state} + ({value} & {MASK}) + ({value} >> 32)) & {MASK}) AS {a}")
        items.append(f"((xor({a}, {a} >> 16) * {MULTIPLIER}) & {MASK}) AS {b}")
        items.append(f"((xor({b}, {b} >> 16) * {MULTIPLIER}) & {MASK}) AS {c}")
        items.append(f"xor({c}, {c} >> 16) AS {d}")
        state = d
    items.append(f"{state} AS {name}")
    return ", ".join(items)
