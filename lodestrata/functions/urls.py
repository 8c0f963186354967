"""URLs, hosts and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUPPORTED = ["md", "markdown", "txt", "html", "htm", "json"]

#: IPv4 blocks that are not public, as first address and prefix length.
RESERVED_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3),
]
RESERVED_V6 = r"^(?:::1?|f[cd].*|fe[89ab].*|2001:db8:.*)$"

_V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
_PARTS = r"(?i)^([a-z][a-z0-9+.\-]*):(?://(?:([^@/?#]*)@)?(\[[^\]]*\]|[^:/?#]*)(?::(\d*))?)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _number(address: Column) -> Column:
    octets = [F.regexp_extract(address, _V4, i).try_cast("bigint") for i in (1, 2, 3, 4)]
    number = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    valid = octets[0].between(0, 255) & octets[1].between(0, 255) & octets[2].between(0, 255) & octets[3].between(0, 255)
    return F.when(valid, number)


def is_private_address(address: Column) -> Column:
    """Whether an address must not be fetched from; what is no address counts as private."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(address), "%.*$", ""), r"^(?:::ffff:)+", "")
    number = _number(plain)
    lows = [sum(int(x) << (24 - 8 * i) for i, x in enumerate(first.split("."))) for first, _ in RESERVED_V4]
    blocks = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(low + (1 << (32 - bits)) - 1).alias("high")) for low, (_, bits) in zip(lows, RESERVED_V4)])
    inside = F.exists(blocks, lambda b: number.between(b["low"], b["high"]))
    v6 = plain.rlike(r"^[0-9a-f:]*:[0-9a-f:.]*$")
    return F.when(number.isNotNull(), inside).when(v6, plain.rlike(RESERVED_V6)).otherwise(True)


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no default port, a path at least ``/``."""
    scheme, host, port = F.lower(part(url, 1)), F.lower(part(url, 3)), part(url, 4)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    user = F.when(part(url, 2) != "", F.concat(part(url, 2), F.lit("@"))).otherwise("")
    path = F.when(part(url, 5) == "", "/").otherwise(part(url, 5))
    whole = F.concat(scheme, F.lit("://"), user, host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, part(url, 6))
    return F.when(host != "", whole)


def url_problem(url: Column) -> Column:
    """Why a URL must not be fetched, NULL if its form allows it: BAD_URL, BAD_SCHEME, CREDENTIALS, BAD_PORT, LOCAL_HOST or PRIVATE_ADDRESS."""
    scheme, host, port = F.lower(part(url, 1)), F.lower(part(url, 3)), part(url, 4)
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    numeric = bare.rlike(_V4) | host.startswith("[")
    return (
        F.when(url.isNull() | (scheme == ""), "BAD_URL")
        .when(~scheme.isin("http", "https"), "BAD_SCHEME")
        .when(host == "", "BAD_URL")
        .when(part(url, 2) != "", "CREDENTIALS")
        .when((port != "") & ~port.isin("80", "443"), "BAD_PORT")
        .when((bare == "localhost") | bare.rlike(r"\.(?:localhost|local)\.?$"), "LOCAL_HOST")
        .when(numeric & is_private_address(bare), "PRIVATE_ADDRESS")
    )


def origin_of(url: Column) -> Column:
    return F.regexp_extract(canonical_url(url), r"^([a-z0-9+.\-]+://[^/]*)", 1)


def directory_of(url: Column) -> Column:
    """Origin and path up to the last slash, which bounds a crawl."""
    return F.regexp_extract(canonical_url(url), r"^([a-z0-9+.\-]+://[^?#]*/)", 1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def is_supported_file(name: Column) -> Column:
    return extension(name).isin(*SUPPORTED)


def repository_of(url: Column) -> Column:
    """STRUCT(owner, name) of a code repository's URL; NULL fields for another."""
    pattern = r"(?i)^https?://(?:www\.)?github\.com/([^/?#]+)/([^/?#]+?)(?:\.git)?(?:[/?#].*)?$"
    value = lambda n: F.nullif(F.regexp_extract(url, pattern, n), F.lit(""))
    return F.struct(value(1).alias("owner"), value(2).alias("name"))


def wiki_of(url: Column) -> Column:
    """STRUCT(space, book, slug) of a wiki's URL; NULL fields where there are none."""
    pattern = r"(?i)^https?://(?:[^/?#]+\.)?yuque\.com/([^/?#]+)/([^/?#]+)(?:/([^/?#]+))?"
    value = lambda n: F.nullif(F.regexp_extract(url, pattern, n), F.lit(""))
    return F.struct(value(1).alias("space"), value(2).alias("book"), value(3).alias("slug"))


def connection_kind(value: Column) -> Column:
    """github, yuque or web by URL, local for all else."""
    return (
        F.when(repository_of(value)["owner"].isNotNull(), "github")
        .when(wiki_of(value)["space"].isNotNull(), "yuque")
        .when(value.rlike(r"(?i)^https?://"), "web")
        .otherwise("local")
    )
