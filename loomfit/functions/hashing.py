"""Salted hashes of ids, and the partitions of a rotation, in plain columns.

The hash uses each intermediate value several times. Every step is therefore a projection of its own, which Catalyst keeps
apart, so the expression stays small and runs inside generated code.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The multipliers of the public 64-bit finalizer (MurmurHash3).
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53
#: Salts of the right ids' permutations start here; those of left ids are the epochs.
RIGHT_SALT = 1 << 30


def _multiply(x: Column, factor: int) -> Column:
    """``x * factor`` modulo 2**64 on BIGINT. Plain multiplication would overflow, which is an error in ANSI mode.

    Both numbers are cut into limbs of 22, 22 and 20 bits, so all partial sums stay far below 2**63.
    """
    mask = (1 << 22) - 1
    x0, x1, x2 = (F.shiftrightunsigned(x, 22 * k).bitwiseAND(F.lit(mask)) for k in range(3))
    c0, c1, c2 = (F.lit(factor >> 22 * k & mask) for k in range(3))
    low = x0 * c0
    middle = x0 * c1 + x1 * c0 + F.shiftrightunsigned(low, 22)
    high = x0 * c2 + x1 * c1 + x2 * c0 + F.shiftrightunsigned(middle, 22)
    return low.bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(middle.bitwiseAND(F.lit(mask)), 22)).bitwiseOR(F.shiftleft(high, 44))


def _fold(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, 33))


def hashed(df: DataFrame, wanted: dict[str, tuple[Column, int | Column, int]]) -> DataFrame:
    """Adds a column per entry ``name: (id, salt, n)``: a number in ``[0, n)``, null for a null id.

    The id's 32-bit hash (its halves combined by exclusive or, so ``i`` and ``~i`` agree) is put above the salt's 32 bits, and
    the 64-bit finalizer mixes them; the result is its absolute value modulo ``n``. A negative salt is refused: its sign would
    cover the id's bits.
    """
    keep = df.columns
    cols = {}
    for name, (x, salt, _) in wanted.items():
        if isinstance(salt, int) and not 0 <= salt < 1 << 31:
            raise ValueError("a salt must be in [0, 2**31)")
        x = x.cast("bigint")
        half = x.bitwiseXOR(F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        salt = F.lit(salt) if isinstance(salt, int) else salt
        cols[name] = F.shiftleft(half, 32).bitwiseOR(salt.cast("bigint"))
    out = df.select(*keep, *[c.alias(name) for name, c in cols.items()])
    for step in (_fold, lambda x: _multiply(x, MIX_1), _fold, lambda x: _multiply(x, MIX_2), _fold):
        out = out.select(*keep, *[step(F.col(name)).alias(name) for name in wanted])
    lowest = F.lit(-(1 << 63)).cast("bigint")  # the one value without a positive counterpart
    last = lambda x, n: (F.when(x == lowest, F.lit(0).cast("bigint")).otherwise(F.abs(x)) % F.lit(n)).cast("int")
    return out.select(*keep, *[last(F.col(name), n).alias(name) for name, (_, _, n) in wanted.items()])


def units(n: int) -> list[int]:
    """The numbers below ``n`` that have no divisor in common with it."""
    return [a for a in range(1, n + 1) if gcd(a, n) == 1]


def partitions(df: DataFrame, epoch: int, rotation: int | Column, n: int, left: str | None = None, right: str | None = None) -> DataFrame:
    """Adds ``left_part`` and ``right_part``, the partitions of the named id columns in a rotation.

    A left id keeps its partition for an epoch. A right id follows an affine permutation of the rotations, drawn per id and
    epoch: over an epoch it meets every partition exactly once, so each pair is owned by exactly one rotation, without a
    table to broadcast.
    """
    u = units(n)
    wanted = {}
    if left:
        wanted["left_part"] = (F.col(left), epoch, n)
    if right:
        wanted |= {"step_": (F.col(right), RIGHT_SALT + 2 * epoch, len(u)), "shift_": (F.col(right), RIGHT_SALT + 2 * epoch + 1, n)}
    out = hashed(df, wanted)
    if right:
        rotation = F.lit(rotation) if isinstance(rotation, int) else rotation
        step = F.get(F.array(*[F.lit(a) for a in u]), F.col("step_"))
        out = out.withColumn("right_part", ((step.cast("bigint") * rotation.cast("bigint") + F.col("shift_")) % n).cast("int")).drop("step_", "shift_")
    return out


def owners(df: DataFrame, epoch: int, n: int, left: str, right: str) -> DataFrame:
    """Adds ``rotation`` and ``part``: the one rotation of an epoch, and the partition, in which a pair's ids meet.

    It solves the right id's permutation for its left id's partition, so all rotations' pairs come from one scan.
    """
    u = units(n)
    wanted = {"part": (F.col(left), epoch, n), "step_": (F.col(right), RIGHT_SALT + 2 * epoch, len(u)), "shift_": (F.col(right), RIGHT_SALT + 2 * epoch + 1, n)}
    back = F.get(F.array(*[F.lit(pow(a, -1, n)) for a in u]), F.col("step_"))
    out = hashed(df, wanted).withColumn("rotation", F.pmod(back.cast("bigint") * (F.col("part") - F.col("shift_")), F.lit(n)).cast("int"))
    return out.select(*df.columns, "rotation", "part")


def uniform(seed: Column | int, *key: Column) -> Column:
    """A reproducible number in [0, 1) for a key."""
    bits = F.xxhash64(F.lit(seed) if isinstance(seed, int) else seed, *key)
    return F.shiftrightunsigned(bits, 11).cast("double") / F.lit(float(1 << 53))
