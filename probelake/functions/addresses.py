"""Bytes, base64 and network addresses as column expressions.

Addresses are BINARY: 4 bytes (IPv4) or 16, with IPv4 mapped into IPv6 for keys. Only
the compressed text of an IPv6 address needs Python.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAPPED = "00000000000000000000FFFF"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_TEXT = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def base64_bytes(text: Column) -> Column:
    """Decoded base64; other characters are skipped, missing padding is added, a lone last character is dropped."""
    clean = F.regexp_replace(F.substring_index(text, "=", 1), "[^A-Za-z0-9+/]", "")
    odd = F.length(clean) % 4
    whole = F.when(odd == 1, clean.substr(F.lit(1), F.length(clean) - 1)).otherwise(clean)
    return F.unbase64(F.concat(whole, F.when(odd == 2, "==").when(odd == 3, "=").otherwise("")))


def u16(data: Column, at: int) -> Column:
    """Big-endian 16 bits at a zero-based place; null beyond the end."""
    part = F.substring(data, at + 1, 2)
    return F.when(F.length(part) == 2, F.conv(F.hex(part), 16, 10).cast("int"))


def v4_bytes(text: Column) -> Column:
    """Four bytes of dotted decimal text, else null."""
    octets = F.transform(F.split(text, r"\."), lambda x: F.lpad(F.hex(x.try_cast("int")), 2, "0"))
    return F.when(text.rlike(V4_TEXT), F.unhex(F.array_join(octets, "")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; plain nesting would repeat its expression wherever it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def v6_bytes(text: Column) -> Column:
    """Sixteen bytes of IPv6 text (with ``::`` and a dotted tail), else null."""
    tail = F.regexp_extract(text, r"([0-9]+\.[0-9.]+)$", 1)
    dotted = lambda four: F.concat(F.regexp_replace(text, r"[0-9]+\.[0-9.]+$", ""), F.substring(four, 1, 4), F.lit(":"), F.substring(four, 5, 4))
    plain = F.when(tail == "", text).otherwise(let(F.hex(v4_bytes(tail)), dotted))
    groups = lambda s: F.filter(F.split(s, ":", -1), lambda x: x != "")

    def of_halves(halves: Column) -> Column:
        right = F.coalesce(groups(F.try_element_at(halves, F.lit(2))), F.array().cast("array<string>"))
        return let(F.struct(groups(F.element_at(halves, 1)).alias("left"), right.alias("right"), F.size(halves).alias("n")), of_groups)

    def of_groups(g: Column) -> Column:
        missing = F.lit(8) - F.size(g.left) - F.size(g.right)
        zeros = F.array_repeat(F.lit("0"), F.when(g.n == 2, missing).otherwise(0))
        fits = F.when(g.n == 2, missing >= 1).otherwise((g.n == 1) & (missing == 0))
        return F.when(fits, F.unhex(F.array_join(F.transform(F.concat(g.left, zeros, g.right), lambda x: F.lpad(x, 4, "0")), "")))

    shape = r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?(?:::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)?$"
    return let(plain, lambda p: F.when(p.contains(":") & p.rlike(shape), let(F.split(p, "::", -1), of_halves)))


def mapped(four: Column) -> Column:
    """An IPv4 address as the IPv4-mapped IPv6 address."""
    return F.concat(F.unhex(F.lit(MAPPED)), four)


def address_bytes(text: Column) -> Column:
    """Sixteen bytes of an address literal (IPv6 if it has a colon), else null."""
    return F.when(text.contains(":"), v6_bytes(text)).otherwise(mapped(v4_bytes(text)))


def given(addr: Column) -> Column:
    """An address that is there: null for one of zeros only (0.0.0.0 or ::), which stands for none."""
    return F.when((addr != F.unhex(F.lit("00" * 4))) & (addr != F.unhex(F.lit("00" * 16))), addr)


def is_mapped(addr: Column) -> Column:
    return (F.length(addr) == 16) & (F.hex(F.substring(addr, 1, 12)) == MAPPED)


def v4_number(four: Column) -> Column:
    return F.conv(F.hex(four), 16, 10).cast("long")


def number_v4(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def v4_text(four: Column) -> Column:
    return F.when(F.length(four) == 4, F.concat_ws(".", *[F.conv(F.hex(F.substring(four, k, 1)), 16, 10) for k in (1, 2, 3, 4)]))


@F.pandas_udf(StringType())
def _v6_text(addr: pd.Series) -> pd.Series:
    return addr.map(lambda b: None if b is None or len(b) != 16 else ipaddress.IPv6Address(bytes(b)).compressed)


def address_text(addr: Column) -> Column:
    """Dotted decimal for 4 bytes and mapped addresses, IPv6 text for others."""
    return F.when(F.length(addr) == 4, v4_text(addr)).when(is_mapped(addr), v4_text(F.substring(addr, 13, 4))).otherwise(_v6_text(addr))


def trailing_number(text: Column) -> Column:
    """The integer after the last '/', 0 if there is none."""
    return F.coalesce(F.regexp_extract(F.substring_index(text, "/", -1), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def network_v6(addr: Column, masklen: Column) -> Column:
    """The network of a 16-byte address at a prefix length: whole bytes, one masked byte, zeros."""
    whole, bits = F.floor(masklen / 8).cast("int"), masklen % 8
    value = F.conv(F.hex(F.substring(addr, whole + 1, F.lit(1))), 16, 10).cast("int")
    step = F.element_at(F.array(*[F.lit(1 << (8 - b)) for b in range(8)]), bits + 1)  # what one unit of the masked bits is worth
    masked = F.when(whole < 16, F.unhex(F.lpad(F.hex(value - value % step), 2, "0"))).otherwise(F.unhex(F.lit("")))
    zeros = F.substring(F.unhex(F.lit("00" * 16)), F.lit(1), F.greatest(F.lit(15) - whole, F.lit(0)))
    return F.when(F.length(addr) == 16, F.concat(F.substring(addr, F.lit(1), whole), masked, zeros))


def after_v6(first: Column, masklen: Column) -> Column:
    """The first 16-byte address after a prefix; null if the prefix reaches the end of the address space."""
    number = lambda at: F.conv(F.hex(F.substring(first, at, 8)), 16, 10).cast("decimal(20,0)")
    power = F.array(*[F.lit(str(1 << k)).cast("decimal(20,0)") for k in range(65)])
    whole = F.lit(str(1 << 64)).cast("decimal(20,0)")
    text = lambda n: F.lpad(F.conv(n.cast("string"), 10, 16), 16, "0")
    # Upper and lower half: the end is a carry in the lower half only for lengths over 64.
    low = number(9) + F.when(masklen > 64, F.element_at(power, F.lit(129) - masklen)).otherwise(F.lit(0))
    high = number(1) + F.when(masklen <= 64, F.element_at(power, F.lit(65) - masklen)).when(low >= whole, F.lit(1)).otherwise(F.lit(0))
    return F.when(high < whole, F.unhex(F.concat(text(high), text(F.when(low >= whole, low - whole).otherwise(low)))))


def prefix_end(first: Column, masklen: Column, width: int = 32) -> Column:
    """First number after an IPv4 prefix: first + 2^(width - masklen)."""
    return first + F.pow(F.lit(2.0), F.lit(width) - masklen).cast("long")
