"""Checksums of account and tax numbers, as native Column functions that give false for anything of another shape."""

from __future__ import annotations

from string import ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import account, let, text

#: Digits that a step of the remainder takes: with two of the remainder before them, they fit a long.
DIGITS = 9


def remainder_97(digits: Column) -> Column:
    """A number of any length, given as digits, modulo 97."""
    starts = lambda d: F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1)), F.lit(DIGITS))
    return let(digits, lambda d: F.aggregate(starts(d), F.lit(0).cast("long"), lambda r, i: F.concat(r.cast("string"), F.substr(d, i, F.lit(DIGITS))).cast("long") % 97))


def portuguese_iban(x: Column) -> Column:
    moved = lambda value: F.concat(F.substr(value, F.lit(5)), F.lit("252950"))
    return let(account(x), lambda value: F.when(F.regexp_like(value, F.lit(r"^PT50[0-9]{21}$")), remainder_97(moved(value)) == 1).otherwise(False))


def portuguese_nib(x: Column) -> Column:
    return F.when(F.regexp_like(text(x), F.lit(r"^[0-9]{21}$")), portuguese_iban(F.concat(F.lit("PT50"), text(x)))).otherwise(False)


def portuguese_tax_id(x: Column) -> Column:
    def holds(value: Column) -> Column:
        digit = lambda i: F.substr(value, F.lit(i + 1), F.lit(1)).cast("int")
        total = digit(0) * 9
        for i in range(1, 8):
            total = total + digit(i) * (9 - i)
        check = (11 - total % 11) % 11 % 10  # 10 and 11 are 0
        return F.when(F.regexp_like(value, F.lit(r"^[0-9]{9}$")), check == digit(8)).otherwise(False)

    return let(text(x), holds)


def any_iban(compact: Column) -> Column:
    """Whether the check digits hold; the value is upper-case letters and digits."""
    digits = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    for letter in ascii_uppercase:
        digits = F.replace(digits, F.lit(letter), F.lit(str(ord(letter) - 55)))
    return F.when(F.regexp_like(compact, F.lit("[^A-Z0-9]")), False).otherwise(remainder_97(digits) == 1)
