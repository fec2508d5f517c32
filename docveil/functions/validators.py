"""Checksum and structure tests of identifiers, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Assigned two-digit prefixes of ABA routing numbers, as ranges.
ABA_PREFIXES = ((0, 12), (21, 32), (61, 72), (80, 80))
# Employer id prefixes that are assigned to no campus.
EIN_UNASSIGNED = (0, 7, 8, 9, 17, 18, 19, 28, 29, 49, 69, 70, 78, 79, 89, 96, 97)


def only_digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _let(v: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that it may use often and that is evaluated once."""
    return F.get(F.transform(F.array(v), f), F.lit(0))


def luhn_valid(v: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    return _let(only_digits(v), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))


def aba_valid(v: Column) -> Column:
    """Nine digits with an assigned prefix and weights 3, 7, 1 summing to a multiple of ten."""
    return _let(only_digits(v), _aba)


def _aba(d: Column) -> Column:
    at = lambda i: F.substring(d, i, 1).cast("int")
    total = sum((at(i) * (3, 7, 1)[(i - 1) % 3] for i in range(2, 10)), at(1) * 3)
    prefix = F.substring(d, 1, 2).cast("int")
    assigned = F.lit(False)
    for low, high in ABA_PREFIXES:
        assigned = assigned | prefix.between(low, high)
    return F.when(F.length(d) == 9, assigned & (total % 10 == 0)).otherwise(False)


def ssn_valid(v: Column) -> Column:
    """Nine digits whose area, group and serial can have been issued."""
    area, group, serial = (lambda d, i=i, n=n: F.substring(d, i, n) for i, n in ((1, 3), (4, 2), (6, 4)))
    issued = lambda d: ~area(d).isin("000", "666") & (area(d) < "900") & (group(d) != "00") & (serial(d) != "0000")
    return _let(only_digits(v), lambda d: (F.length(d) == 9) & issued(d))


def ein_valid(v: Column) -> Column:
    """Nine digits with an assigned prefix."""
    prefixes = [f"{p:02d}" for p in EIN_UNASSIGNED]
    return _let(only_digits(v), lambda d: (F.length(d) == 9) & ~F.substring(d, 1, 2).isin(*prefixes))


def iban_valid(v: Column) -> Column:
    """Two letters, two check digits, 11 to 30 more characters, and 1 modulo 97 when turned."""
    s = F.upper(F.regexp_replace(v, r"\s", ""))
    turned = F.concat(F.substring(s, 5, 30), F.substring(s, 1, 4))
    digit = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + digit(c)) % 97
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1)


def ip_valid(v: Column) -> Column:
    """Four dotted parts of at most 255."""
    parts = F.split(v, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,3}$") & (F.lpad(p, 3, "0") <= "255"))
