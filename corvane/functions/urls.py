"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


def site_of(url: Column) -> Column:
    """Host of ``url``: lower case, no port, no leading ``www.``; null for a null or hostless url."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query of a url; "" where there is none."""
    return F.regexp_extract(F.trim(url), _PARTS, group)


def canonical(url: Column) -> Column:
    """No fragment, scheme and authority in lower case, no slash at the path's end ("/" for none), query kept."""
    path = F.regexp_replace(url_part(url, 3), "/+$", "")
    query = url_part(url, 4)
    return F.concat(F.lower(url_part(url, 1)), F.lit("://"), F.lower(url_part(url, 2)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


#: File endings that no page has.
SKIPPED_ENDINGS = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".zip", ".gz", ".mp4", ".mp3", ".css", ".js", ".xml", ".json")


def skipped(url: Column) -> Column:
    """Whether a url ends like a file that is no page."""
    return F.lower(url).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in SKIPPED_ENDINGS) + ")$")


def joined(base: Column, ref: Column) -> Column:
    """An absolute reference as it is; one from the root or without scheme resolved against ``base``; any other below the base's folder."""
    origin = F.concat(F.lower(url_part(base, 1)), F.lit("://"), url_part(base, 2))
    folder = F.regexp_replace(url_part(base, 3), "[^/]*$", "")
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref).when(ref.startswith("//"), F.concat(F.lower(url_part(base, 1)), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, ref)).when(ref.startswith("?"), F.concat(origin, url_part(base, 3), ref))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), ref))
    )


PORTS = (80, 443, 8080, 8443)


def refusal(url: Column, schemes: tuple[str, ...] = ("http", "https"), ports: tuple[int, ...] = PORTS, blocked_hosts: tuple[str, ...] = ()) -> Column:
    """Why a url must not be fetched (scheme, missing_host, credentials, blocked_host, port, bad_address, blocked_address), the first that holds; null if none.

    Addresses are judged in every spelling: dotted quads, IPv6 in brackets and IPv4 inside it. A host of digits, dots and
    hexadecimal numbers that is no dotted quad is one that some resolvers take for an address: bad_address. Names of the
    machine itself are blocked hosts. A null url has no scheme.
    """
    scheme = F.lower(url_part(url, 1))
    host = F.regexp_extract(F.lower(url_part(url, 2)), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)
    port = F.regexp_extract(url_part(url, 2), r":([^:\]@]*)$", 1)
    number = F.when(port == "", F.when(scheme == "https", 443).otherwise(80)).otherwise(F.expr("NULL").cast("int"))
    number = F.coalesce(number, port.try_cast("int"))
    return (
        F.when(~F.coalesce(scheme.isin(*schemes), F.lit(False)), "scheme").when(host == "", "missing_host").when(url_part(url, 2).contains("@"), "credentials")
        .when(host.isin(*blocked_hosts, *LOCAL_HOSTS) | host.rlike(r"\.(?:localhost|local|internal)\.?$"), "blocked_host")
        .when(number.isNull() | ~number.isin(*ports), "port").otherwise(address_fault(F.when(host.rlike(r"^(?:\[.*|[0-9a-fx.]*\d[0-9a-fx.]*)$"), host)))
    )


#: Names of the machine itself and of metadata services.
LOCAL_HOSTS = ("localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "metadata.google.internal")
#: IPv4 networks that are never public (RFC 6890 and later).
BLOCKED_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)


def ipv4_number(host: Column) -> Column:
    """A dotted quad as a number; null for anything else."""
    p = [F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("long") for i in (1, 2, 3, 4)]
    n = ((p[0] * 256 + p[1]) * 256 + p[2]) * 256 + p[3]
    return F.when((p[0] < 256) & (p[1] < 256) & (p[2] < 256) & (p[3] < 256), n)


def network_ranges(networks: tuple[str, ...] = BLOCKED_NETWORKS) -> list[tuple[int, int]]:
    import ipaddress

    nets = [ipaddress.ip_network(n) for n in networks]
    return [(int(n.network_address), int(n.broadcast_address)) for n in nets]


def blocked_ipv4(host: Column) -> Column:
    """Whether a host is a dotted quad inside a network that is never public; false for names."""
    n = ipv4_number(host)
    hit = F.lit(False)
    for lo, hi in network_ranges():
        hit = hit | n.between(lo, hi)
    return F.coalesce(hit, F.lit(False))


@F.pandas_udf(BooleanType())
def blocked_address(host):
    """Any literal address, IPv6 and IPv4-in-IPv6 included; false for names."""
    import ipaddress

    return host.map(lambda h: _fault(h, strict=False) == "blocked_address")


def _fault(host: str | None, strict: bool = True) -> str | None:
    """blocked_address, or bad_address for what looks like an address and is none (``strict``); null for names and public addresses."""
    import ipaddress
    import re

    h = host or ""
    try:
        ip = ipaddress.ip_address(h.strip("[]").split("%")[0])
    except ValueError:
        numeric = re.fullmatch(r"(?:0x[0-9a-f]+|\d+)(?:\.(?:0x[0-9a-f]+|\d+))*\.?", h)
        return "bad_address" if strict and (numeric or h[:1] == "[") else None
    if ip.version == 6:  # IPv4 inside IPv6: mapped, 6to4, Teredo, NAT64, compatible
        inside = ip.ipv4_mapped or ip.sixtofour or (ip.teredo or (None, None))[1]
        if inside is None and int(ip) >> 32 in (0x64FF9B << 64, 0) and int(ip) > 1:
            inside = ipaddress.ip_address(int(ip) & 0xFFFFFFFF)
        ip = inside or ip
    special = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified
    return "blocked_address" if special or (ip.version == 4 and any(lo <= int(ip) <= hi for lo, hi in network_ranges())) else None


@F.pandas_udf(StringType())
def address_fault(host):
    """What is wrong with a host that looks like an address: bad_address, blocked_address or null."""
    return host.map(_fault)
