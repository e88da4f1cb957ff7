"""Types, enumerations and registries of the data model."""

from __future__ import annotations

# States of a capability.
UNKNOWN, CAN, CANNOT, BROKEN = 0, 1, 2, 3

# DNSSEC algorithms by index, as (name, algorithm number).
DNSKEY_ALGORITHMS = [
    ("rsamd5", 1), ("dsa", 3), ("rsasha1", 5), ("dsansec3", 6), ("rsansec3", 7), ("rsasha256", 8),
    ("rsasha512", 10), ("eccgost", 12), ("ecdsa256", 13), ("ecdsa384", 14), ("ed25519", 15), ("ed448", 16),
]
DS_ALGORITHMS = ["gost", "sha384"]

# Measurements by what they test.
WHOAMI_G, WHOAMI_A, WHOAMI_6 = 8310237, 8310245, 8310366
QNAMEMIN, TCP4, TCP6, NXDOMAIN = 8310250, 8310360, 8310364, 8311777
NOT_TA_19036, NOT_TA_20326, IS_TA_20326 = 15283670, 15283671, 16430285
FLAGDAY = [19185448, 19256455]
DNSKEY_SECURE = [8926853 + 2 * i for i in range(12)]
DNSKEY_BOGUS = [8926854 + 2 * i for i in range(12)]
DS_SECURE = [8926887, 8926911]
DS_BOGUS = [8926888, 8926912]
KNOWN = sorted([WHOAMI_G, WHOAMI_A, WHOAMI_6, QNAMEMIN, TCP4, TCP6, NXDOMAIN, NOT_TA_19036, NOT_TA_20326, IS_TA_20326, *FLAGDAY, *DNSKEY_SECURE, *DNSKEY_BOGUS, *DS_SECURE, *DS_BOGUS])
# The control address; seconds and days of the state rules.
CONTROL_ADDRESS = "145.97.20.17"
LATE, QUIET, KEEP_DAYS = 3600, 3600, 10

#: State columns: last assignment wins.
ASSIGNED = ["whoami_g", "whoami_a", "whoami_6", "ecs_mask", "ecs_mask6", "qnamemin", "tcp_ipv4", "tcp_ipv6", "nxdomain", "hijacked", "not_ta_19036", "not_ta_20326", "does_flagday"]
PAIRS = [f"dnskey_{name}" for name, _ in DNSKEY_ALGORITHMS] + [f"ds_{name}" for name in DS_ALGORITHMS]
#: The pair that the trust-anchor sentinels read.
RSASHA256 = "dnskey_rsasha256"


def pair_measurements() -> list[tuple[str, int, int]]:
    """(pair, measurement of the secure probe, measurement of the bogus probe)."""
    return list(zip(PAIRS, DNSKEY_SECURE + DS_SECURE, DNSKEY_BOGUS + DS_BOGUS, strict=True))


def _verbs(name: str, *verbs: str) -> list[str]:
    return [f"{v}_{name}" for v in verbs]


#: The 24 capabilities in order: (key, names of the reported values 1, 2, ...).
CAPABILITIES: list[tuple[str, list[str]]] = [
    ("ipv6", ["can_ipv6"]),
    ("tcp", ["can_tcp"]),
    ("tcp6", ["can_tcp6"]),
    ("ecs", ["does_ecs"]),
    ("flagday", ["does_flagday"]),
    ("qnamemin", _verbs("qnamemin", "does", "doesnt")),
    ("nxdomain", _verbs("nxdomain", "does", "doesnt")),
    ("ta_19036", _verbs("ta_19036", "has", "hasnt")),
    ("ta_20326", _verbs("ta_20326", "has", "hasnt")),
    *[(name, _verbs(name, "can", "cannot", "broken")) for name, _ in DNSKEY_ALGORITHMS],
    *[(name, _verbs(name, "can", "cannot", "broken")) for name in DS_ALGORITHMS],
    ("int_ext", ["is_internal", "is_forwarding", "is_external"]),
]
VALUES = [name for _, names in CAPABILITIES for name in names]

RAW_SCHEMA  = "prb_id long, resultset array<struct<time: long, dst_addr: string, dst_name: string, error: string, result: struct<rt: float, abuf: string>>>"
OBSERVATION_SCHEMA  = "msm_id int, day date, seq long, time timestamp, rt float, prb_id long, addr binary, is_error boolean, msg binary"
PREFIX_SCHEMA  = "prefix string, masklen int, asn string"
PROBE_SCHEMA  = "id long, asn_v4 int, asn_v6 int, latitude double, longitude double, country_code string"
