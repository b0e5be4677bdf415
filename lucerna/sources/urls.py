"""URL checks as column predicates; nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that are never reached.
BLOCKED_HOSTS = ["localhost", "localhost.localdomain", "127.0.0.1", "0.0.0.0", "::1", "169.254.169.254", "metadata.google.internal"]
PRIVATE = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2\d|3[01])|192\.0\.[02]|198\.1[89]|198\.51\.100|203\.0\.113|2[4-5]\d)\."
QUAD = r"^\d{1,3}(?:\.\d{1,3}){3}$"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Scheme and host in lower case, and port or null."""
    clean = F.trim(F.coalesce(url, F.lit("")))
    pattern = r"(?i)^([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#\s]*)(?::(\d+))?(?:[/?#]|$)"
    return (
        F.lower(F.regexp_extract(clean, pattern, 1)), F.lower(F.regexp_extract(clean, pattern, 2)),
        F.regexp_extract(clean, pattern, 3).try_cast("int"),
    )


def is_internal(host: Column) -> Column:
    return (
        host.isin(BLOCKED_HOSTS) | host.endswith(".internal") | host.endswith(".local")
        | (host.rlike(QUAD) & host.rlike(PRIVATE)) | host.rlike(r"^\[(?:::1?|f[cd]|fe[89ab])")
    )


def sanitize_url(url: Column) -> Column:
    """SRC-15: the URL, or empty if it isn't a public http or https one."""
    scheme, host, _ = parts(url)
    return F.when(scheme.isin("http", "https") & (host != "") & ~is_internal(host), F.trim(url)).otherwise("")


def narrowed(requested: list[str] | None, allowed: list[str]) -> list[str]:
    """SET-06: a request may narrow the allowed origins, never widen them."""
    return [x for x in allowed if requested is None or x in requested]


def ingestion_check(url: Column, allowed: list[str]) -> Column:
    """SRC-14: empty if the URL may be read, else why not. allowed: origins such as https://example.org."""
    scheme, host, port = parts(url)
    host = F.regexp_replace(host, r"\.$", "")
    default = F.when(scheme == "https", 443).otherwise(80)
    origin = F.concat(scheme, F.lit("://"), host, F.when(port.isNotNull() & (port != default), F.concat(F.lit(":"), port.cast("string"))).otherwise(""))
    return (
        F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "url is required").when(~scheme.isin("http", "https"), "scheme is not allowed")
        .when(host == "", "hostname is missing").when(~origin.isin(allowed), "origin is not allowed").when(is_internal(host), "host is internal")
        .when(~host.rlike(QUAD) & host.rlike(r"^(?:0x[0-9a-f]+|\d+)(?:\.(?:0x[0-9a-f]+|\d+))*$"), "numeric address is not canonical").otherwise("")
    )
