"""Which addresses and URLs a crawler may fetch."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Mapping
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IPv4 networks that are never fetched (first octet, least and most second octet).
RESERVED_V4 = ((0, 0, 255), (10, 0, 255), (100, 64, 127), (127, 0, 255), (169, 254, 254), (172, 16, 31), (192, 0, 0), (192, 168, 168), (198, 18, 19))
#: Ports of services that do not speak HTTP.
BLOCKED_PORTS = frozenset((22, 23, 25, 110, 143, 445, 465, 587, 993, 995, 1433, 1521, 3306, 3389, 5432, 5433, 5984, 6379, 9200, 11211, 27017))


def _v4(a: Column, b: Column) -> Column:
    inside = a >= 224
    for first, low, high in RESERVED_V4:
        inside = inside | ((a == first) & b.between(low, high))
    return inside


def is_private(address: Column) -> Column:
    """True for private, reserved and unreadable addresses."""
    bare = F.lower(F.regexp_replace(address, r"^\[|\]$", ""))
    inner = F.when(bare.rlike(r"^::ffff:[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), F.substring(bare, 8, 64)).otherwise(bare)
    octets = F.transform(F.split(inner, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("int"))
    v4 = inner.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    good = F.forall(octets, lambda x: x.between(0, 255))
    v6 = bare.rlike(r"^[0-9a-f:.]*:[0-9a-f:.]*$")
    private6 = bare.isin("::", "::1") | bare.rlike("^(?:fc|fd|fe[89ab]|ff)")
    return F.coalesce(F.when(v4, ~good | _v4(F.get(octets, F.lit(0)), F.get(octets, F.lit(1)))).when(v6, private6), F.lit(True))


class BlockedUrl(ValueError):
    def __init__(self, reason: str, url: str):
        super().__init__(f"{reason}: {url}")
        self.reason = reason


MOST_REDIRECTS = 5


def fetched(url: str, get: Callable[[str, dict[str, str]], tuple[int, str | None, bytes]], resolve: Callable[[str], list[str]] | None = None, headers: Mapping[str, str] | None = None, private_ok: bool = False) -> tuple[str, bytes]:
    """The address that a URL leads to and its body. get(url, headers): status, location of a redirect, body.

    Every hop is tested like the first one, as a public page may lead to a private
    one; credentials go to the origin that they are for and to no other.
    """
    first, at = "{0.scheme}://{0.netloc}".format(urlsplit(url)), url
    for _ in range(MOST_REDIRECTS + 1):
        if reason := blocked_reason(at, resolve, private_ok):
            raise BlockedUrl(reason, at)
        own = dict(headers or {}) if "{0.scheme}://{0.netloc}".format(urlsplit(at)) == first else {k: v for k, v in (headers or {}).items() if k.lower() not in ("authorization", "cookie")}
        code, location, body = get(at, own)
        if not (300 <= code < 400 and location):
            return at, body
        at = urljoin(at, location)
    raise BlockedUrl("redirects", url)


def blocked_reason(url: str, resolve=None, private_ok: bool = False) -> str | None:
    """Why a URL may not be fetched: scheme, port, private_network or unresolvable; None if it may. resolve: host to all its addresses."""
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError:
        return "scheme"
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return "scheme"
    if port in BLOCKED_PORTS:
        return "port"
    if private_ok:
        return None
    try:
        found = [str(ipaddress.ip_address(parts.hostname))]
    except ValueError:
        found = list(resolve(parts.hostname)) if resolve else []
        if not found:
            return "unresolvable"
    return "private_network" if any(not ipaddress.ip_address(a).is_global or ipaddress.ip_address(a).is_multicast for a in found) else None
