"""IP addresses as numbers: long for version 4, 16 bytes for version 6."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secflow.functions.columns import once

OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


def ipv4(address: Column) -> Column:
    """The number of a version 4 address, null for any other text."""
    parts = F.split(address, r"\.")
    number = sum((parts[i].cast("long") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(address.rlike(IPV4), number)


def hex4(address: Column) -> Column:
    """The eight hex digits of a version 4 address, null for any other text."""
    return F.lower(F.lpad(F.hex(ipv4(address)), 8, "0"))


def hex6(address: Column) -> Column:
    """The 32 hex digits of a version 6 address, null for any other text. A dotted tail is its last two groups."""
    plain = F.lower(address)
    tail = F.substring_index(plain, ":", -1)
    dotted = F.concat(F.substr(plain, F.lit(1), F.length(plain) - F.length(tail)), F.substring(hex4(tail), 1, 4), F.lit(":"), F.substring(hex4(tail), 5, 4))
    halves = F.split(F.when(tail.contains("."), dotted).otherwise(plain), "::")

    def groups(h: Column) -> Column:
        own = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))
        left, right = own(h[0]), F.when(F.size(h) == 2, own(F.get(h, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        missing = 8 - F.size(left) - F.size(right)
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        fits = F.when(F.size(h) == 2, missing >= 1).otherwise((F.size(h) == 1) & (missing == 0))
        return F.when(fits & F.forall(whole, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(whole, lambda x: F.lpad(x, 4, "0")), ""))

    return F.when(plain.contains(":"), once(halves, groups))


def first_bits(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits of hex digits, as text: whole digits, then one that is cut short."""
    whole, rest = F.floor(bits / 4).cast("int"), F.pmod(bits, F.lit(4))
    last = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    size = F.element_at(F.array(*map(F.lit, (1, 8, 4, 2))), rest + 1)  # addresses that share a digit cut to 0, 1, 2, 3 bits
    cut = F.lower(F.hex((F.floor(last / size) * size).cast("long")))
    return F.concat(F.substr(digits, F.lit(1), whole), F.when(rest == 0, F.lit("")).otherwise(cut))


@F.pandas_udf(T.BinaryType())
def ipv6(address: pd.Series) -> pd.Series:
    """The 16 bytes of a version 6 address, null for any other text."""

    def packed(text: str | None) -> bytes | None:
        try:
            found = ipaddress.ip_address(text)
        except ValueError:
            return None
        return found.packed if found.version == 6 else None

    return address.map(packed)
