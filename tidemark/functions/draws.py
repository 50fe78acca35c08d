"""The linear congruential generator s' = (1664525 s + 1013904223) mod 2**32 with jumps ahead, and the shuffles and samples drawn from it.

A step is an affine map, and so is any number of steps; its powers of two give the n-th state of a seed as one column
expression, so that no draw waits for the one before it. Shuffles and samples come out as the generator's sequential users
draw them, without carrying a shuffled list along: only the places asked for are traced back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FACTOR, STEP, WORD = 1664525, 1013904223, 1 << 32  # fixed values


def _powers() -> list[tuple[int, int]]:
    """The affine maps of 1, 2, 4, ... 2**31 steps."""
    out, a, b = [], FACTOR, STEP
    for _ in range(32):
        out.append((a, b))
        a, b = a * a % WORD, (a * b + b) % WORD
    return out


def nth_of(n: int, seed: int) -> int:
    for k, (a, b) in enumerate(_powers()):
        if n >> k & 1:
            seed = (a * seed + b) % WORD
    return seed % WORD


def nth(n: Column | str, seed: Column | int) -> Column:
    """The state after ``n`` steps from ``seed``. Products are split so that they fit in 63 bits."""
    n = F.col(n) if isinstance(n, str) else n
    state = F.pmod(seed if isinstance(seed, Column) else F.lit(seed), F.lit(WORD)).cast("long")
    steps = F.transform(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(_powers()))), lambda m: m)
    steps = F.filter(steps, lambda m: F.call_function("shiftright", n.cast("long"), m["k"]).bitwiseAND(F.lit(1)) == 1)

    def step(s: Column, m: Column) -> Column:
        high, low = F.shiftright(m["a"], 16), m["a"].bitwiseAND(F.lit(0xFFFF))
        return (high * s % 65536 * 65536 + low * s + m["b"]) % WORD

    return F.aggregate(steps, state, step)


def states(seeds: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` states of each seed, a row each."""
    a = np.cumprod(np.full(n, FACTOR, np.uint32), dtype=np.uint32)
    ones = np.cumsum(np.concatenate([np.ones(1, np.uint32), a[:-1]]), dtype=np.uint32) * np.uint32(STEP) if n else a
    return seeds.astype(np.uint32)[:, None] * a[None, :] + ones[None, :]


def shuffle_sources(n: int, seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which item stands at ``places`` after a shuffle of n items that swaps places n - 1, ..., 1 with a drawn place at or before them.

    A row for each seed. The item at a place was put there by the step of that place, out of the drawn place; what lay in that
    one came from the last step before that had drawn it, and so on back to a place that no step had drawn yet.
    """
    seeds, places = np.asarray(seeds), np.asarray(places, np.int64)
    if n < 2:
        return np.zeros((len(seeds), len(places)), np.int64)
    drawn = np.zeros((len(seeds), n), np.int64)
    drawn[:, 1:] = (states(seeds, n - 1) % np.arange(n, 1, -1, dtype=np.uint32))[:, ::-1]  # of step i in column i
    row = np.arange(len(seeds))[:, None]
    keys = (row * n + drawn)[:, 1:].ravel() * n + np.tile(np.arange(1, n), len(seeds))  # (row, drawn place, step) in one number
    keys.sort()
    rows = np.repeat(row, len(places), 1).ravel()
    at_step = np.tile(places, len(seeds))
    place = np.where(at_step > 0, drawn[rows, at_step], 0)
    todo = np.arange(len(rows))
    while len(todo):
        prefix = (rows[todo] * n + place[todo]) * n
        k = np.searchsorted(keys, prefix + at_step[todo], side="right")
        found = (k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] // n == prefix // n)
        todo, k = todo[found], k[found]
        at_step[todo] = place[todo] = keys[k] % n
    return place.reshape(len(seeds), len(places))


def sampled(n: Column, count: int, seed: Column) -> Column:
    """``count`` distinct numbers below n (all, if fewer), as drawn one after another out of what is left, in order of drawing."""

    def draw(left: Column, k: Column) -> Column:
        # The chosen numbers in ascending order and in order of drawing; the p-th number left is p plus the chosen ones at or below it.
        at = (nth(k, seed) % (n - k + 1)).cast("int")
        number = F.aggregate(left["sorted"], at, lambda x, s: F.when(s <= x, x + 1).otherwise(x))
        return F.struct(F.array_sort(F.array_append(left["sorted"], number)).alias("sorted"), F.array_append(left["drawn"], number).alias("drawn"))

    none = F.array().cast("array<int>")
    steps = F.when(n > 0, F.sequence(F.lit(1), F.least(F.lit(count), n.cast("int")))).otherwise(none)
    return F.aggregate(steps, F.struct(none.alias("sorted"), none.alias("drawn")), draw, lambda x: x["drawn"])
