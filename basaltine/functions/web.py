"""Addresses and routes as column predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Address ranges that aren't public, as first and last number.
PRIVATE = {
    "0.0.0.0/8": (0, 16777215),
    "10.0.0.0/8": (167772160, 184549375),
    "127.0.0.0/8": (2130706432, 2147483647),
    "169.254.0.0/16": (2851995648, 2852061183),
    "172.16.0.0/12": (2886729728, 2887778303),
    "192.168.0.0/16": (3232235520, 3232301055),
}


def ipv4(text: Column) -> Column:
    """A dotted address as a number, null if it is none."""
    p = F.split(text, r"\.")
    n = sum(F.try_element_at(p, F.lit(k)).cast("long") * F.lit(256 ** (4 - k)) for k in range(1, 5))
    return F.when(text.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), n)


def is_private(address: Column) -> Column:
    n = ipv4(address)
    out = F.lit(False)
    for low, high in PRIVATE.values():
        out = out | n.between(low, high)
    return F.coalesce(out, F.lit(False))


def is_public_url(url: Column) -> Column:
    """http or https, a host, no credentials, no private address and no local name. Names aren't resolved."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#:]*)", 1))
    authority = F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)
    local = host.isin("localhost", "") | host.endswith(".local") | host.endswith(".internal")
    return F.coalesce(url.rlike(r"^https?://") & ~authority.contains("@") & ~local & ~is_private(host), F.lit(False))


def route_regex(route: Column) -> Column:
    """A route's pattern: <int:x> is a number, <x> a part of the path; the rest stays as it is."""
    numbered = F.regexp_replace(route, r"<int:[^>]*>", r"[0-9]+")
    return F.concat(F.lit("^"), F.regexp_replace(numbered, r"<[^>]*>", "[^/]+"), F.lit("$"))


def normal_route(path: Column) -> Column:
    """A path without query, fragment and slash at the end."""
    plain = F.regexp_replace(path, r"[?#].*$", "")
    return F.when(plain == "/", plain).otherwise(F.regexp_replace(plain, "/$", ""))
