"""The capability rules: what a decoded answer assigns, and the states that depend on order.

Rules come in two kinds. Most assign a value that stands until the next assignment.
The rest look at other states as they are at that moment: a secure and a bogus probe
decide a pair together, and the trust-anchor sentinels read a pair and each other. All
are columns over one window, so a whole state costs one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions import schema as S
from probelake.functions import wire
from probelake.functions.addresses import trailing_number, v4_bytes, v6_bytes

CONTROL_HEX = "".join(f"{int(x):02X}" for x in S.CONTROL_ADDRESS.split("."))


def _first(m: Column, kind: int) -> Column:
    """Data of the first answer if there is no error and it is of that type."""
    record = F.try_element_at(m["answers"], F.lit(1))
    return F.when((m["rcode"] == wire.NOERROR) & (record["type"] == kind), record["rdata"])


def _address(m: Column, kind: int, size: int) -> Column:
    """The first answer's data if they are an address of exactly ``size`` bytes."""
    data = _first(m, kind)
    return F.when(F.length(data) == size, data)


def control_answer(m: Column) -> Column:
    """Do the first answer's data begin with the control address? Never null."""
    return F.coalesce(F.hex(F.substring(_first(m, wire.A), 1, 4)) == CONTROL_HEX, F.lit(False))


def _text(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def assignments(m: Column, msm: Column) -> dict[str, Column]:
    """For each assigned state the value that the answer ``m`` of measurement ``msm`` gives it, null for none."""
    on = lambda *ids: msm.isin(*ids)
    good = m["rcode"] == wire.NOERROR
    texts = F.coalesce(F.when(good, m["texts"]), F.array().cast("array<array<binary>>"))
    strings = F.transform(F.flatten(texts), _text)
    subnet = "edns0-client-subnet "
    is_subnet = lambda x: x.startswith(subnet) & (F.length(x) > 20)
    mask = F.coalesce(_last(F.transform(F.filter(strings, is_subnet), trailing_number)), F.lit(0))
    plain = F.filter(strings, lambda x: ~is_subnet(x) & (F.length(x) <= 79))
    g4 = _last(F.filter(F.transform(F.filter(plain, lambda x: ~x.contains(":")), v4_bytes), lambda x: x.isNotNull()))
    g6 = _last(F.filter(F.transform(F.filter(plain, lambda x: x.contains(":")), v6_bytes), lambda x: x.isNotNull()))
    a4, a6 = _address(m, wire.A, 4), _address(m, wire.AAAA, 16)
    verdict = lambda x: F.when(x.startswith("HOORAY "), S.CAN).when(x.startswith("NO "), S.CANNOT)
    by_record = F.transform(texts, lambda r: F.try_element_at(F.filter(F.transform(r, lambda b: verdict(_text(b))), lambda v: v.isNotNull()), F.lit(1)))
    empty = m["rcode"].isin(wire.NOERROR, wire.NXDOMAIN) & (m["ancount"] == 0)
    addresses = F.transform(F.slice(F.filter(m["answers"], lambda r: (r["type"] == wire.A) & (F.length(r["rdata"]) >= 4)), 1, 4), lambda r: F.substring(r["rdata"], 1, 4))
    rewritten = good & (F.size(addresses) > 0)
    ok = control_answer(m)
    decoded = m.isNotNull()
    nx = on(S.NXDOMAIN) & decoded
    return {
        "whoami_g": F.when(on(S.WHOAMI_G), g4),
        "whoami_a": F.when(on(S.WHOAMI_A, S.TCP4), a4),
        "whoami_6": F.when(on(S.WHOAMI_6, S.TCP6), a6).when(on(S.WHOAMI_G), g6),
        "ecs_mask": F.when(on(S.WHOAMI_G), F.when(mask <= 32, mask).otherwise(0)),
        "ecs_mask6": F.when(on(S.WHOAMI_G), F.when(mask > 32, mask).otherwise(0)),
        "qnamemin": F.when(on(S.QNAMEMIN), _last(F.filter(by_record, lambda v: v.isNotNull()))),
        "tcp_ipv4": F.when(on(S.TCP4), F.when(a4.isNotNull(), S.CAN).otherwise(S.CANNOT)),
        "tcp_ipv6": F.when(on(S.TCP6), F.when(a6.isNotNull(), S.CAN).otherwise(S.CANNOT)),
        "nxdomain": F.when(nx & empty, S.CANNOT).when(nx & rewritten, S.CAN).when(on(S.NXDOMAIN), S.BROKEN),
        "hijacked": F.when(nx & empty, F.array().cast("array<binary>")).when(nx & rewritten, addresses),
        "not_ta_19036": F.when(on(S.NOT_TA_19036), F.when(ok, S.CAN).otherwise(S.CANNOT)),
        "not_ta_20326": F.when(on(S.NOT_TA_20326), F.when(ok, S.CAN).otherwise(S.CANNOT)),
        "does_flagday": F.when(on(*S.FLAGDAY), F.when(ok, S.CANNOT).otherwise(S.CAN)),  # the control answer means strict
    }


def pair_result(secure_now: Column, bogus_now: Column, secure: Column, bogus: Column) -> Column:
    """What an observation decides for a pair: ``*_now`` is what it says (null: nothing), the others the states with it.

    A bogus answer after a failed secure one decides nothing; the other way round it is broken.
    """
    return (
        F.when((secure_now == S.CAN) & (bogus == S.CANNOT), S.CAN)
        .when((secure_now == S.CAN) & (bogus == S.CAN), S.CANNOT)
        .when((secure_now == S.CANNOT) & (bogus != S.UNKNOWN), S.BROKEN)
        .when((bogus_now == S.CAN) & (secure == S.CAN), S.CANNOT)
        .when((bogus_now == S.CANNOT) & (secure == S.CAN), S.CAN)
    )


def running(value: Column, window: Window, initial: Column | int | None = S.UNKNOWN) -> Column:
    """The last assignment up to each row."""
    last = F.last(value, ignorenulls=True).over(window)
    if initial is None:
        return last
    return F.coalesce(last, F.lit(initial) if isinstance(initial, int) else initial)


def resolve_pairs(rows: DataFrame, window: Window, pairs: list[str]) -> DataFrame:
    """``<pair>_s`` and ``<pair>_b`` (what a row says of the probes) to the running ``<pair>_secure``, ``_bogus``, ``_result``.

    A row's ``<pair>_r`` (a carried result, else null) counts as decided there.
    """
    rows = rows.withColumns({f"{p}_{k}": running(F.col(f"{p}_{k[0]}"), window) for p in pairs for k in ("secure", "bogus")})
    rows = rows.withColumns({f"{p}_said": F.coalesce(F.col(f"{p}_r"), pair_result(F.col(f"{p}_s"), F.col(f"{p}_b"), F.col(f"{p}_secure"), F.col(f"{p}_bogus"))) for p in pairs})
    return rows.withColumns({f"{p}_result": running(F.col(f"{p}_said"), window) for p in pairs}).drop(*[f"{p}_said" for p in pairs])


def resolve_anchors(rows: DataFrame, window: Window, now_19036: Column, now_20326: Column, validates: Column, carried_19036: Column, carried_20326: Column) -> DataFrame:
    """Adds running ``has_ta_20326`` and ``has_ta_19036`` from what a row says of the sentinels (null: nothing)."""
    said = F.coalesce(F.when(now_20326 == S.CAN, S.UNKNOWN).when(now_20326 == S.CANNOT, F.when(validates == S.CAN, S.CAN).otherwise(S.UNKNOWN)), carried_20326)
    rows = rows.withColumn("has_ta_20326", running(said, window))
    has = F.col("has_ta_20326") == S.CAN
    said = F.coalesce(F.when(now_19036 == S.CAN, F.when(has, S.CANNOT).otherwise(S.UNKNOWN)).when(now_19036 == S.CANNOT, F.when(has, S.CAN).otherwise(S.UNKNOWN)), carried_19036)
    return rows.withColumn("has_ta_19036", running(said, window))
