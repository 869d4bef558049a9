"""A counter-based, splittable generator: Threefry-2x32 with 20 rounds, as columns and over numpy arrays.

A key is a struct ``k0, k1`` of two 32-bit words held as longs.  Words depend on key and counter alone, so any row of any
table can be drawn anywhere, in any order; ``split`` makes keys of keys, so every grid, rule or request of a table has a
stream of its own without a number being drawn twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions.rules import let
from cellweave.functions.seeds import check_density

#: Fixed values of the published generator: rotations of eight successive rounds, and the word that makes the third key word.
ROTATIONS = (13, 15, 26, 6, 17, 29, 16, 24)
PARITY = 0x1BD11BDA
ROUNDS = 20
WORD = (1 << 32) - 1
#: Uniform numbers have this many bits, those of a single-precision mantissa.
UNIFORM_BITS = 23


def words(k0: np.ndarray, k1: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two words of each counter (c0, c1) under each key, as uint32 arrays that broadcast."""
    k0, k1, a, b = (np.asarray(x).astype(np.uint32) for x in (k0, k1, c0, c1))
    keys = (k0, k1, k0 ^ k1 ^ np.uint32(PARITY))
    with np.errstate(over="ignore"):
        a, b = a + keys[0], b + keys[1]
        for i in range(ROUNDS):
            r = np.uint32(ROTATIONS[i % 8])
            a = a + b
            b = (b << r | b >> (np.uint32(32) - r)) ^ a
            if i % 4 == 3:
                n = i // 4 + 1
                a, b = a + keys[n % 3], b + keys[(n + 1) % 3] + np.uint32(n)
    return a, b


def word_pair(k0: Column, k1: Column, c0: Column, c1: Column) -> Column:
    """The same as a struct ``k0, k1`` of longs: a fold over the rounds, so that the expression stays small."""
    mask = F.lit(WORD).cast("long")
    cut = lambda x: x.bitwiseAND(mask)
    rounds = F.array(*[F.struct(F.lit(ROTATIONS[i % 8]).alias("r"), F.lit(i // 4 + 1 if i % 4 == 3 else 0).alias("n")) for i in range(ROUNDS)])

    def fold(keys: Column, start: Column) -> Column:
        key = lambda n: F.get(keys, F.pmod(n, F.lit(3)))

        def step(held: Column, at: Column) -> Column:
            a = cut(held["k0"] + held["k1"])
            turned = F.call_function("shiftleft", held["k1"], at["r"]).bitwiseOR(F.call_function("shiftright", held["k1"], F.lit(32) - at["r"]))

            def mixed(a: Column) -> Column:
                b = cut(turned).bitwiseXOR(a)
                return F.when(at["n"] > 0, F.struct(cut(a + key(at["n"])).alias("k0"), cut(b + key(at["n"] + 1) + at["n"]).alias("k1"))).otherwise(F.struct(a.alias("k0"), b.alias("k1")))

            return let(a, mixed)

        return F.aggregate(rounds, start, step)

    # Keys and counters are bound first: the rounds name them many times, and they may be pairs of their own.
    given = F.struct(k0.alias("k0"), k1.alias("k1"), c0.alias("c0"), c1.alias("c1"))
    start = lambda g: F.struct(cut(g["c0"] + g["k0"]).alias("k0"), cut(g["c1"] + g["k1"]).alias("k1"))
    words_of = lambda g: F.array(g["k0"], g["k1"], g["k0"].bitwiseXOR(g["k1"]).bitwiseXOR(F.lit(PARITY).cast("long")))
    return let(given, lambda g: let(words_of(g), lambda keys: fold(keys, start(g))))


def key_from_seed(seed: Column) -> Column:
    """The key of a long: its high and its low word."""
    seed = seed.cast("long")
    return F.struct(F.call_function("shiftrightunsigned", seed, F.lit(32)).alias("k0"), seed.bitwiseAND(F.lit(WORD).cast("long")).alias("k1"))


def split(key: Column, index: Column) -> Column:
    """The ``index``-th key made of a key."""
    return let(key, lambda k: word_pair(k["k0"], k["k1"], *_counter(index)))


def _counter(index: Column) -> tuple[Column, Column]:
    index = index.cast("long")
    return F.call_function("shiftrightunsigned", index, F.lit(32)), index.bitwiseAND(F.lit(WORD).cast("long"))


def draw(key: Column, index: Column) -> Column:
    """The 32-bit word of a key at an index."""
    return let(split(key, index), lambda p: p["k0"].bitwiseXOR(p["k1"]))


def rule_bits(key: Column, dims: int) -> Column:
    """A rule code of fair bits: 18 in 2D, 54 in 3D."""

    def code(k: Column) -> Column:
        low = draw(k, F.lit(0))
        if dims == 2:
            return low.bitwiseAND(F.lit((1 << 18) - 1).cast("long"))
        return low + draw(k, F.lit(1)).bitwiseAND(F.lit((1 << 22) - 1).cast("long")) * F.lit(1 << 32).cast("long")

    return let(key, code)


def alive(k0: np.ndarray, k1: np.ndarray, cells: int, density: float) -> np.ndarray:
    """A row of ``cells`` cells for each key, alive with probability ``density``; exact at 0 and 1."""
    index = np.arange(cells, dtype=np.int64)
    a, b = words(k0[:, None], k1[:, None], index >> 32, index & WORD)
    uniform = ((a ^ b) >> np.uint32(32 - UNIFORM_BITS)).astype(np.float64) / (1 << UNIFORM_BITS)
    return (uniform < check_density(density)).astype(np.int8)
