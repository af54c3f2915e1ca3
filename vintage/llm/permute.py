"""Pseudorandom permutations of [0, n) as column expressions.

A Feistel network over pairs of Z_a, a = ceil(sqrt n), permutes [0, a*a);
walking along its cycle until a value below n turns up restricts it to
[0, n) (Black and Rogaway 2002). Only bigint arithmetic is used, so the
expressions stay in the JVM and mean the same in any SQL engine.
``n`` must be below 2**61."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus and multipliers of the round function; squares stay below 2**62.
PRIME = 2_147_483_647
MULTIPLIERS = (48_271, 69_621, 39_373, 16_807)
#: From this n on, a walk of MANY steps ends but with a chance below 1e-28.
SMALL, MANY = 1024, 24


def round_value(r: int, key: int, i: int) -> int:
    """The round function on plain integers (for tests and small tables)."""
    x = (r % PRIME + key * (i + 1) + 12_345) % PRIME
    x = x * MULTIPLIERS[i] % PRIME
    x = (x * x + key) % PRIME
    return x * MULTIPLIERS[-1 - i] % PRIME


def permute_int(x: int, n: int, key: int) -> int:
    """Plain-integer twin of :func:`permute`."""
    a = 1
    while a * a < n:
        a += 1
    while True:
        left, right = divmod(x, a)
        for i in range(4):
            left, right = right, (left + round_value(right, key, i)) % a
        x = left * a + right
        if x < n:
            return x


def _encipher(x: Column, a: Column, key: Column) -> Column:
    p = F.lit(PRIME).cast("long")

    def turn(pair: Column, c: Column) -> Column:
        y = (pair["right"] % p + key * c["step"] + F.lit(12_345)) % p * c["first"] % p
        y = (y * y + key) % p * c["last"] % p
        return F.struct(pair["right"].alias("left"), ((pair["left"] + y) % a).alias("right"))

    turns = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("step"), F.lit(MULTIPLIERS[i]).cast("long").alias("first"),
                               F.lit(MULTIPLIERS[-1 - i]).cast("long").alias("last")) for i in range(4)])
    halves = F.struct(F.call_function("div", x, a).alias("left"), (x % a).alias("right"))
    return F.aggregate(turns, halves, turn, lambda pair: pair["left"] * a + pair["right"])


def root(n: Column) -> Column:
    """ceil(sqrt n) in whole numbers, at least 1."""
    r = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    r = F.when((r - 1) * (r - 1) >= n, r - 1).when(r * r < n, r + 1).otherwise(r)
    return F.greatest(r, F.lit(1).cast("long"))


def permute(x: Column, n: Column, key: Column) -> Column:
    """The image of x in [0, n) under the permutation that ``key`` (a bigint
    in [0, 2**31)) names. x, n and key are bigints; null if one is null.

    A small n gets as many steps as any walk can take (a*a - n + 1), a large
    one MANY: beyond SMALL a step fails with a chance of at most 2/a. A walk that
    isn't done then is an error, not a wrong number."""
    a = root(n)
    steps = F.when(n <= SMALL, 2 * a + 2).otherwise(F.lit(MANY).cast("long"))
    late = F.raise_error(F.lit("a cycle walk was not done")).cast("long")
    return F.aggregate(F.sequence(F.lit(1).cast("long"), steps), _encipher(x, a, key),
                       lambda y, _: F.when(y < n, y).otherwise(_encipher(y, a, key)),
                       lambda y: F.when(y >= n, late).otherwise(y))
