"""Address rules. Spark has no address type, so these are vectorised Python functions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(text: str | None) -> str | None:
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return text
    if address.version == 6 and address.ipv4_mapped:
        return str(address.ipv4_mapped)
    if address.version == 6:
        return str(ipaddress.ip_network((int(address) >> 64 << 64, 64)))
    return str(address)


def _keys(ip: pd.Series) -> pd.Series:
    return ip.map({x: _key(x) for x in ip.unique() if x is not None})


def client_key(ip: Column) -> Column:
    """The bucket of a client: an IPv4 address, an IPv6 /64, or the text itself if it is no address."""
    return F.pandas_udf(_keys, "string")(ip)


def real_ip(peer: Column, forwarded: Column, trusted: list[str]) -> Column:
    """The client's address: the peer, or behind trusted proxies the last hop that isn't one."""
    ranges = [ipaddress.ip_network(t, strict=False) for t in trusted]

    def is_trusted(text: str) -> bool:
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return False
        address = getattr(address, "ipv4_mapped", None) or address
        return any(address.version == r.version and address in r for r in ranges)

    def walk(peer_: str | None, hops: str | None) -> str | None:
        if not ranges or peer_ is None or not is_trusted(peer_):
            return peer_
        chain = [h.strip() for h in (hops or "").split(",") if h.strip()]
        for hop in reversed(chain):
            try:
                ipaddress.ip_address(hop)
            except ValueError:
                return peer_
            if not is_trusted(hop):
                return hop
        return chain[0] if chain else peer_

    f: Callable = F.pandas_udf(lambda p, h: pd.Series([walk(a, b) for a, b in zip(p, h, strict=True)]), "string")
    return f(peer, forwarded)
