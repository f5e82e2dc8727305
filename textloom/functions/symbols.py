"""Column functions on symbols, integers and UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def popcount(x: Column) -> Column:
    return F.bit_count(x).cast("long")


def blog(x: Column) -> Column:
    """Floor of the binary logarithm; -1 for 0, null for negative numbers. Exact for 64 bits: the length of the binary form."""
    return F.when(x > 0, F.length(F.bin(x)) - 1).when(x == 0, F.lit(-1)).cast("long")


def bit_at(x: Column, i: Column | int, width: int = 64) -> Column:
    """Bit i of a word, counted from the most significant."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.getbit(x, F.lit(width - 1) - i).cast("long")


def with_bit(x: Column, i: Column | int, bit: Column | int, width: int = 64) -> Column:
    """The word with bit i, counted from the most significant, set to 0 or 1."""
    i = F.lit(i) if isinstance(i, int) else i
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(width - 1) - i).cast("int"))
    return F.when((F.lit(bit) if isinstance(bit, int) else bit) == 1, x.bitwiseOR(mask)).otherwise(x.bitwiseAND(F.bitwise_not(mask)))


def as_little_endian(x: Column, width: int) -> Column:
    """The low ``width`` bytes of an integer, least first."""
    digits = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(width)]))


def from_little_endian(x: Column, width: int) -> Column:
    """The integer of ``width`` bytes, least first."""
    digits = F.hex(x)
    return F.conv(F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(width, 0, -1)]), 16, 10).cast("long")


def as_dna(text: Column) -> Column:
    """Letters folded onto acgt, for texts that aren't sequences."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), letters, ("acgt" * 7)[:26])


def dna_codes(text: Column) -> Column:
    """a, c, g, t in any case as 0 to 3; null if the text holds anything else."""
    return F.when(text.rlike("^[acgtACGT]*$"), F.translate(F.lower(text), "acgt", "0123"))


def dna2_codes(text: Column) -> Column:
    """$ and N as 0, a, c, g, t in any case as 1 to 4; null if the text holds anything else (a small n too)."""
    return F.when(text.rlike("^[$NacgtACGT]*$"), F.translate(text, "$NacgtACGT", "0012341234"))


def bit_codes(text: Column) -> Column:
    return F.when(text.rlike("^[01]*$"), text)


def from_code_point(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def byte_class(byte: Column) -> Column:
    """'head' for a byte that begins a character, 'tail' for a continuation byte."""
    return F.when(byte.bitwiseAND(0xC0) == 0x80, "tail").otherwise("head")
