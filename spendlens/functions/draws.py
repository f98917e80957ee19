"""Counter-based random draws as integer column arithmetic.

A draw depends only on (key, replicate), never on row order, partitioning or
task retries, so a lost executor recomputes the very same numbers. Words are 32
bits held in a bigint, hence no product below leaves the signed 64-bit range.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
# Odd multipliers of the mixer and of the two counters.
MIX = 73244475
REPLICATE_STEP = 2654435769
INDEX_STEP = 2246822519


def key_word(key: Column, word: int) -> Column:
    """32-bit word number ``word`` of the md5 of a text key."""
    return F.conv(F.substring(F.md5(key), 1 + 8 * word, 8), 16, 10).cast("bigint")


def mixed(df, source: Column, out: str):
    """Add ``out`` = two-round multiplicative mix of ``source``.

    Each round is its own projection so that a value used twice is computed once.
    """
    df = df.withColumn(out, source.bitwiseAND(F.lit(MASK)))
    fold = f"({out} ^ shiftright({out}, 16))"
    for _ in range(2):
        df = df.withColumn(out, F.expr(f"({fold} * {MIX}L) & {MASK}L"))
    return df.withColumn(out, F.expr(fold))


def poisson_ladder() -> list[int]:
    """Cumulative Poisson(1) probabilities on the 32-bit scale."""
    total, steps = 0.0, []
    for k in range(12):
        total += math.exp(-1.0) / math.factorial(k)
        steps.append(int(total * 2**32))
    return steps


def poisson_weight(draw: str) -> Column:
    """Poisson(1) count for a column of uniform 32-bit draws."""
    return F.expr(" + ".join(f"CAST({draw} >= {step}L AS INT)" for step in poisson_ladder()))


def mix_words(x: np.ndarray) -> np.ndarray:
    """The mix of ``mixed`` for an array of 64-bit integers."""
    x = x & MASK
    for _ in range(2):
        x = ((x ^ (x >> 16)) * MIX) & MASK
    return x ^ (x >> 16)


class PoissonCounts:
    """The same Poisson(1) counts for blocks of rows of key words, as arrays of rows x replicates.

    Products of 32-bit words wrap as the mask does. All blocks, of ``rows`` rows at most,
    are made in the same arrays, which a core's cache can hold, and a call overwrites
    what the one before gave.
    """

    def __init__(self, b: np.ndarray, rows: int):
        self.at = (b.astype(np.int64) * REPLICATE_STEP & MASK).astype(np.uint32)
        shape = (rows, len(b))
        self.words, self.spare = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
        self.counts, self.reached = np.empty(shape, np.uint8), np.empty(shape, bool)
        self.ladder = [np.uint32(step) for step in poisson_ladder()]

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        n = len(h1)
        u, spare, counts, reached = self.words[:n], self.spare[:n], self.counts[:n], self.reached[:n]

        def mix():
            for _ in range(2):
                np.right_shift(u, np.uint32(16), out=spare)
                np.bitwise_xor(u, spare, out=u)
                np.multiply(u, np.uint32(MIX), out=u)
            np.right_shift(u, np.uint32(16), out=spare)
            np.bitwise_xor(u, spare, out=u)

        np.add(h1.astype(np.uint32)[:, None], self.at[None, :], out=u)
        mix()
        np.add(u, h2.astype(np.uint32)[:, None], out=u)
        mix()
        np.greater_equal(u, self.ladder[0], out=counts.view(bool))
        for step in self.ladder[1:]:
            np.greater_equal(u, step, out=reached)
            np.add(counts, reached.view(np.uint8), out=counts)
        return counts


def poisson_counts(h1: np.ndarray, h2: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``PoissonCounts`` of a few rows as an array of replicates x rows."""
    return PoissonCounts(b, len(h1))(h1, h2).T


def picks(h: int, b: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """Positions below ``k`` that draws ``i`` of replicates ``b`` pick, as replicates x draws."""
    start = mix_words(h + b.astype(np.int64) * REPLICATE_STEP)
    return mix_words(start[:, None] + i[None, :].astype(np.int64) * INDEX_STEP) % k


def first_draws(h: int, b: np.ndarray) -> np.ndarray:
    """Where the draws of each replicate begin on the circle of ``draw_numbers``."""
    return (mix_words(h + b.astype(np.int64) * REPLICATE_STEP) * pow(INDEX_STEP, -1, 2**32)) & MASK


def draw_numbers(words: np.ndarray) -> np.ndarray:
    """The places on a circle of 2^32 draws that give these 32-bit words.

    The mix and the step are invertible, so each word is given by one place, and the
    draws 0, 1, ... of a replicate are neighbours from ``first_draws`` on.
    """
    back, x = np.uint32(pow(MIX, -1, 2**32)), words.astype(np.uint32)
    x ^= x >> np.uint32(16)
    for _ in range(2):
        x *= back
        x ^= x >> np.uint32(16)
    x *= np.uint32(pow(INDEX_STEP, -1, 2**32))
    return x
