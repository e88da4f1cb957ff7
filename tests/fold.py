"""A plain fold of the state rules, written apart from the Spark code."""

import ipaddress

from probelake.functions import schema as S


def new():
    s = {k: 0 for k in ("ecs_mask", "ecs_mask6", "qnamemin", "tcp_ipv4", "tcp_ipv6", "nxdomain", "not_ta_19036", "not_ta_20326", "has_ta_19036", "has_ta_20326", "does_flagday", "updated", "logged")}
    s |= {"whoami_g": None, "whoami_a": None, "whoami_6": None, "hijacked": []}
    return s | {f"{p}_{k}": 0 for p in S.PAIRS for k in ("secure", "bogus", "result")}


def apply(s, msm, m):
    """``m``: rcode, ancount, answers as (type, data), texts."""
    def first(kind, size):
        if m["rcode"] == 0 and m["answers"] and m["answers"][0][0] == kind and len(m["answers"][0][1]) == size:
            return m["answers"][0][1]

    ok = m["rcode"] == 0 and bool(m["answers"]) and m["answers"][0][0] == 1 and m["answers"][0][1][:4] == ipaddress.ip_address(S.CONTROL_ADDRESS).packed
    if msm == S.WHOAMI_G:
        mask = 0
        for text in [t for r in (m["texts"] if m["rcode"] == 0 else []) for t in r]:
            t = text.decode("latin-1")
            if len(t) > 20 and t.startswith("edns0-client-subnet "):
                mask = int(t.rsplit("/", 1)[1])
            else:
                try:
                    ip = ipaddress.ip_address(t)
                except ValueError:
                    continue
                s["whoami_6" if ip.version == 6 else "whoami_g"] = ip.packed
        s["ecs_mask"], s["ecs_mask6"] = (mask, 0) if mask <= 32 else (0, mask)
    elif msm in (S.WHOAMI_A, S.TCP4):
        s["whoami_a"] = first(1, 4) or s["whoami_a"]
        if msm == S.TCP4:
            s["tcp_ipv4"] = 1 if first(1, 4) else 2
    elif msm in (S.WHOAMI_6, S.TCP6):
        s["whoami_6"] = first(28, 16) or s["whoami_6"]
        if msm == S.TCP6:
            s["tcp_ipv6"] = 1 if first(28, 16) else 2
    elif msm == S.QNAMEMIN:
        for r in m["texts"] if m["rcode"] == 0 else []:
            for t in r:
                v = 1 if t.startswith(b"HOORAY ") else 2 if t.startswith(b"NO ") else 0
                if v:
                    s["qnamemin"] = v
                    break
    elif msm == S.NXDOMAIN:
        found = [d[:4] for k, d in m["answers"] if k == 1 and len(d) >= 4]
        if m["rcode"] in (0, 3) and m["ancount"] == 0:
            s["nxdomain"], s["hijacked"] = 2, []
        elif m["rcode"] != 0 or not found:
            s["nxdomain"] = 3
        else:
            s["nxdomain"], s["hijacked"] = 1, found[:4]
    elif msm == S.NOT_TA_19036:
        s["not_ta_19036"] = 1 if ok else 2
        s["has_ta_19036"] = ((2 if ok else 1) if s["has_ta_20326"] == 1 else 0)
    elif msm == S.NOT_TA_20326:
        s["not_ta_20326"] = 1 if ok else 2
        s["has_ta_20326"] = 0 if ok or s[f"{S.RSASHA256}_result"] != 1 else 1
    elif msm in S.FLAGDAY:
        s["does_flagday"] = 2 if ok else 1
    for p, secure, bogus in S.pair_measurements():
        if msm == secure:
            s[f"{p}_secure"] = 1 if ok else 2
            if ok and s[f"{p}_bogus"]:
                s[f"{p}_result"] = 1 if s[f"{p}_bogus"] == 2 else 2
            elif not ok and s[f"{p}_bogus"]:
                s[f"{p}_result"] = 3
        elif msm == bogus:
            s[f"{p}_bogus"] = 1 if ok else 2
            if s[f"{p}_secure"] == 1:
                s[f"{p}_result"] = 2 if ok else 1


def tick(s, time):
    """The clock; true if the state is emitted."""
    if not s["updated"]:
        s["updated"] = s["logged"] = time
    elif s["updated"] - time > 3600:
        return False
    s["updated"] = max(s["updated"], time)
    if s["updated"] - s["logged"] > 3600:
        s["logged"] = time
        return True
    return False
