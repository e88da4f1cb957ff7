"""Capability values of a state, and the internal / forwarding / external classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from probelake.functions import schema as S
from probelake.functions.addresses import given

INTERNAL, FORWARDING, EXTERNAL = 1, 2, 3


def probe_asn(v4: Column, v6: Column) -> Column:
    return F.when(v4 > 0, v4).when(v6 > 0, v6).otherwise(-1)


def auth_asn(g: Column, a: Column, six: Column) -> Column:
    """The first positive one; 0 if any was looked up in vain; else -1."""
    return F.when(g > 0, g).when(a > 0, a).when(six > 0, six).when((g == 0) | (a == 0) | (six == 0), 0).otherwise(-1)


def _matches(zs: list[Column], xs: list[Column]) -> list[tuple[Column, Column, Column]]:
    return [((z > 0) & (z == x), z, x) for z in zs for x in xs]


def _case(cases: list[tuple[Column, Column]], other: Column) -> Column:
    (test, value), *rest = cases
    return reduce(lambda out, c: out.when(*c), rest, F.when(test, value)).otherwise(other)


def origin_class(x4: Column, x6: Column, y: Column, g: Column, a: Column, six: Column) -> Column:
    """0 unknown, 1 internal, 2 forwarding, 3 external."""
    zs = [g, a, six]
    cases = [(t, F.lit(INTERNAL)) for t, _, _ in _matches(zs, [x4, x6])] + [(t, F.lit(EXTERNAL)) for t, _, _ in _matches(zs, [y])]
    return F.when(F.greatest(*zs) > 0, _case(cases, F.lit(FORWARDING))).otherwise(S.UNKNOWN)


def attributed(x4: Column, x6: Column, y: Column, g: Column, a: Column, six: Column) -> dict[str, Column]:
    """ASNs that a row counts for: of the probe, the resolver and the authoritative side."""
    x = probe_asn(x4, x6)
    resolver = F.when(y == 0, x).otherwise(y)
    zs = [g, a, six]
    inside, outside = _matches(zs, [x4, x6]), _matches(zs, [resolver])
    seen = F.greatest(*zs) > 0
    by_probe = _case([(t, own) for t, _, own in inside] + [(t, x) for t, _, _ in outside], F.when((x4 == resolver) | (x6 == resolver), resolver).otherwise(x))
    by_auth = _case([(t, z) for t, z, _ in inside + outside], auth_asn(*zs))
    return {"probe": F.when(seen, by_probe).otherwise(x), "resolver": resolver, "auth": F.when(seen, by_auth).otherwise(auth_asn(*zs))}


def capability_values(origin: Column | None = None) -> dict[str, Column]:
    """Capability key to its value (0 to 3), over the columns of a snapshot."""
    flag = lambda test: F.when(test, S.CAN).otherwise(S.UNKNOWN)
    return {
        "ipv6": flag(given(F.col("whoami_6")).isNotNull()),
        "tcp": F.col("tcp_ipv4"),
        "tcp6": F.col("tcp_ipv6"),
        "ecs": flag((F.col("ecs_mask") != 0) | (F.col("ecs_mask6") != 0)),
        "flagday": F.col("does_flagday"),
        "qnamemin": F.col("qnamemin"),
        "nxdomain": F.col("nxdomain"),
        "ta_19036": F.col("has_ta_19036"),
        "ta_20326": F.col("has_ta_20326"),
        **{p.split("_", 1)[1]: F.col(f"{p}_result") for p in S.PAIRS},
        "int_ext": origin if origin is not None else F.lit(S.UNKNOWN),
    }
