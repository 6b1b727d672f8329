"""A 32-bit xorshift stream as column expressions.

The step is linear over bits, so any draw can be reached without the ones before it: the matrix of
2^k steps is 32 column values, and a seed's state jumps by the bits of the draw's number. Long
streams are therefore cut into chunks that tasks generate independently.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
# Fixed values of the generator: seed mixing and shifts.
MIX_ADD, MIX_A, MIX_B = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35
SHIFTS = (13, 17, 5)
DEFAULT_SEED = 239
CHUNK = 64


def _u32(x: int) -> Column:
    return F.lit(x).cast("long")


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _times(x: Column, c: int) -> Column:
    """Product modulo 2^32; halves keep every partial product within 64 bits."""
    low = x.bitwiseAND(_u32(0xFFFF)) * _u32(c)
    high = (F.shiftright(x, 16) * _u32(c)).bitwiseAND(_u32(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(_u32(MASK))


def _bind(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def mix_seed(seed: Column) -> Column:
    """Initial state of a seed (its low 32 bits)."""
    x = (seed.cast("long").bitwiseAND(_u32(MASK)) + _u32(MIX_ADD)).bitwiseAND(_u32(MASK))
    x = _bind(x, lambda v: _xor(v, F.shiftright(v, 16)))
    x = _bind(x, lambda v: _times(v, MIX_A))
    x = _bind(x, lambda v: _xor(v, F.shiftright(v, 13)))
    x = _bind(x, lambda v: _times(v, MIX_B))
    return _bind(x, lambda v: _xor(v, F.shiftright(v, 16)))


def step(x: Column) -> Column:
    """Next state, which is also the next draw."""
    a, b, c = SHIFTS
    x = _bind(x, lambda v: _xor(v, F.shiftleft(v, a).bitwiseAND(_u32(MASK))))
    x = _bind(x, lambda v: _xor(v, F.shiftright(v, b)))
    return _bind(x, lambda v: _xor(v, F.shiftleft(v, c).bitwiseAND(_u32(MASK))))


def step_int(x: int) -> int:
    a, b, c = SHIFTS
    x ^= (x << a) & MASK
    x ^= x >> b
    return x ^ (x << c) & MASK


@lru_cache(maxsize=40)
def _jump(k: int) -> tuple[int, ...]:
    """Images of the 32 unit states under 2^k steps."""
    if k == 0:
        return tuple(step_int(1 << b) for b in range(32))
    half = _jump(k - 1)

    def twice(x: int) -> int:
        out = 0
        for b in range(32):
            if x >> b & 1:
                out ^= half[b]
        return out

    return tuple(twice(x) for x in half)


def skip(state: Column, steps: Column, most_bits: int = 32) -> Column:
    """State after a number of steps (below 2^most_bits), by one matrix for each bit of that number."""
    tables = F.array(*[F.array(*[_u32(v) for v in _jump(k)]) for k in range(most_bits)])
    start = F.struct(state.alias("s"), steps.cast("long").alias("n"))

    def moved(s: Column, columns: Column) -> Column:
        walked = F.aggregate(columns, F.struct(_u32(0).alias("x"), s.alias("r")), lambda a, v: F.struct(_xor(a["x"], v * a["r"].bitwiseAND(_u32(1))).alias("x"), F.shiftright(a["r"], 1).alias("r")))
        return walked["x"]

    def bit(a: Column, columns: Column) -> Column:
        on = a["n"].bitwiseAND(_u32(1)) == 1
        return F.struct(F.when(on, moved(a["s"], columns)).otherwise(a["s"]).alias("s"), F.shiftright(a["n"], 1).alias("n"))

    return F.aggregate(tables, start, bit)["s"]


def draws(state: Column, n: int) -> Column:
    """The next ``n`` draws as an array."""
    first = F.struct(F.array().cast("array<bigint>").alias("out"), state.alias("s"))


    def more(a: Column, _: Column) -> Column:
        return _bind(step(a["s"]), lambda s: F.struct(F.concat(a["out"], F.array(s)).alias("out"), s.alias("s")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), first, more)["out"]


def stream(seeds: DataFrame, seed: str, n: int) -> DataFrame:
    """All columns of ``seeds`` with (i, u32): ``n`` draws of each seed, i from 0."""
    chunks = -(-n // CHUNK)
    base = seeds.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))) if chunks > 1 else seeds.withColumn("__c", F.lit(0))
    start = mix_seed(F.col(seed))
    if chunks > 1:
        start = skip(start, F.col("__c").cast("long") * CHUNK, max(1, (chunks * CHUNK).bit_length()))
    got = base.withColumn("__d", draws(start, min(n, CHUNK)))
    got = got.select(*seeds.columns, "__c", F.posexplode("__d").alias("__p", "u32"))
    return got.withColumn("i", (F.col("__c") * CHUNK + F.col("__p")).cast("int")).filter(F.col("i") < n).select(*seeds.columns, "i", "u32")


def as_int(u: Column) -> Column:
    """A draw as a signed 32-bit number."""
    return F.when(u > 0x7FFFFFFF, u - _u32(1 << 32)).otherwise(u).cast("int")


def int_between(u: Column, lo: int, hi: int) -> Column:
    """A draw on lo..hi, both ends included; ends may come in either order, the full range is the signed draw."""
    lo, hi = min(lo, hi), max(lo, hi)
    span = (hi - lo + 1) & MASK
    if span == 0:
        return as_int(u)
    high = F.shiftright(u, 16) * _u32(span)
    low = u.bitwiseAND(_u32(0xFFFF)) * _u32(span)
    top = F.shiftright(high + F.shiftright(low, 16), 16)
    return (top + _u32(lo)).cast("int")


def unit_float(u: Column) -> Column:
    """A draw on [0, 1) from its 24 high bits."""
    return F.shiftright(u, 8).cast("double") / F.lit(16777216.0)


def float_between(u: Column, lo: float, hi: float) -> Column:
    lo, hi = min(lo, hi), max(lo, hi)
    return F.lit(lo) + F.lit(hi - lo) * unit_float(u)


class Random:
    """The same stream on the driver or inside a kernel."""

    def __init__(self, seed: int = DEFAULT_SEED):
        x = (seed + MIX_ADD) & MASK
        x = ((x ^ x >> 16) * MIX_A) & MASK
        x = ((x ^ x >> 13) * MIX_B) & MASK
        self.state = x ^ x >> 16

    def u32(self) -> int:
        self.state = step_int(self.state)
        return self.state
