"""Fetching from trusted hosts only: addresses looked up in a table of ranges, conditional requests from a table of what is stored.

An address becomes a text of fixed length that sorts as its number does (``4`` and 8 hex digits, or ``6`` and 32; addresses of the
old kind within the new one as the old ones they are), so ranges are intervals of texts. Names are resolved, and pages fetched,
by providers on the executors; each host and each address is asked for once.
"""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.session import ship
from sijill.sources import extract

#: Host -> addresses; an error or none: it can't be resolved.
Resolve = Callable[[str], list[str]]
#: url, etag, modified -> http status, last url, content type, body, etag, modified.
Get = Callable[[str, str | None, str | None], tuple[int, str, str | None, bytes | None, str | None, str | None]]

# Registered address blocks that no public host has, and those within them that it may have.
CLOSED = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
)
OPEN = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")

STATE = "url string, etag string, modified string, content_type string, text string, sha256 string"


def system_resolver(host: str) -> list[str]:
    return [x[4][0] for x in socket.getaddrinfo(host, None)]


# ------------------------------------------------------------------ addresses


def _old(x: Column) -> Column:
    """``4`` and 8 hex digits of a dotted address; null if it isn't one."""
    parts = F.split(x, r"\.")
    return F.when(x.rlike(r"^(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})$") & ~F.exists(parts, lambda p: p.try_cast("int") > 255), F.concat(F.lit("4"), F.array_join(F.transform(parts, lambda p: F.lpad(F.lower(F.hex(p.try_cast("int"))), 2, "0")), "")))


def _new(x: Column) -> Column:
    """``6`` and 32 hex digits of an address with colons; null if it isn't one."""
    tail = F.regexp_extract(x, r"[0-9.]*\.[0-9.]*$", 0)
    packed = _old(tail)
    whole = F.when(tail == "", x).otherwise(F.concat(F.regexp_replace(x, r"[0-9.]*\.[0-9.]*$", ""), F.substring(packed, 2, 4), F.lit(":"), F.substring(packed, 6, 4)))
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    halves = F.split(whole, "::")
    left, right = groups(halves[0]), groups(F.coalesce(F.get(halves, 1), F.lit("")))
    size, short = F.size(left) + F.size(right), F.size(halves) == 2
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - size))
    fits = whole.rlike(r"^(?:[0-9a-f]{1,4}:|:(?=:)|(?<=:):)*(?:[0-9a-f]{1,4}|(?<=:):)$") & (F.size(halves) <= 2) & ~whole.contains(":::")
    fits &= (short & (size < 8)) | (~short & (size == 8))
    return F.when(fits, F.concat(F.lit("6"), F.array_join(F.transform(F.concat(left, F.when(short, zeros).otherwise(F.array().cast("array<string>")), right), lambda g: F.lpad(g, 4, "0")), "")))


def address(c: str | Column) -> Column:
    """The sortable text of an address; null if it isn't one. A zone (%eth0) doesn't count."""
    x = F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "%.*$", "")
    new = _new(x)
    return F.when(x.contains(":"), F.when(new.startswith("6" + "0" * 20 + "ffff"), F.concat(F.lit("4"), F.substring(new, 26, 8))).otherwise(new)).otherwise(_old(x))


def _interval(block: str) -> tuple[str, int, int]:
    n = ipaddress.ip_network(block)
    return str(n.version), int(n[0]), int(n[-1])


def intervals() -> list[tuple[str, str, str]]:
    """(kind, low, high): the closed blocks less the open ones as disjoint intervals, in order."""
    out = []
    for kind, digits in (("4", 8), ("6", 32)):
        closed = sorted((a, z) for k, a, z in map(_interval, CLOSED) if k == kind)
        merged: list[list[int]] = []
        for a, z in closed:
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        for k, a, z in map(_interval, OPEN):
            if k == kind:
                merged = [x for low, high in merged for x in ([low, min(high, a - 1)], [max(low, z + 1), high]) if x[0] <= x[1]] if any(low <= a and z <= high for low, high in merged) else merged
        merged = sorted({tuple(x) for x in merged})
        out += [(kind, f"{kind}{a:0{digits}x}", f"{kind}{z:0{digits}x}") for a, z in merged]
    return out


def ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(intervals(), "kind string, low string, high string")


def closed(rows: DataFrame, c: str) -> DataFrame:
    """``rows`` with ``closed``: whether the address ``c`` lies in a closed range; null if it isn't an address. Intervals are disjoint and few."""
    own = rows.withColumn("_a", address(c))
    found = own.join(F.broadcast(ranges(rows.sparkSession)), (F.substring("_a", 1, 1) == F.col("kind")) & F.col("_a").between(F.col("low"), F.col("high")), "left")
    return found.withColumn("closed", F.when(F.col("_a").isNotNull(), F.col("low").isNotNull())).drop("_a", "kind", "low", "high")


# ------------------------------------------------------------------ hosts


def host(c: str) -> Column:
    """A url's host in lower case, without the brackets of an address; null if there is none."""
    return F.nullif(F.lower(F.regexp_replace(F.try_parse_url(F.trim(F.col(c)), F.lit("HOST")), r"^\[|\]$", "")), F.lit(""))


def resolved(hosts: DataFrame, resolve: Resolve) -> DataFrame:
    """(host, open) of distinct hosts: whether it can be resolved and no address of it is closed; what isn't an address doesn't count."""
    ship(hosts.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(h, a) for h in p["host"] for a in _addresses(resolve, h)], columns=["host", "address"])

    own = hosts.select("host").where("host is not null").distinct()
    named = own.where(address("host").isNull()).mapInPandas(run, "host string, address string")
    rows = closed(named.unionByName(own.where(address("host").isNotNull()).withColumn("address", F.col("host"))), "address")
    return rows.groupBy("host").agg((F.bool_and(F.col("address").isNotNull()) & ~F.coalesce(F.bool_or("closed"), F.lit(False))).alias("open"))


def _addresses(resolve: Resolve, name: str) -> list[str | None]:
    try:
        return list(resolve(name)) or [None]
    except Exception:  # noqa: BLE001  whatever the resolver raises, the host can't be trusted
        return [None]


def admitted(urls: DataFrame, hosts: tuple[str, ...], resolve: Resolve = system_resolver) -> DataFrame:
    """``urls`` (url) with refused: null, empty_source_url or source_not_allowed.

    A url must be https, on one of ``hosts`` or below it, and its host must resolve to open addresses only.
    """
    among = F.lit(False)
    for h in hosts:
        among |= (F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))
    rows = urls.withColumn("host", host("url")).withColumn("_among", F.coalesce(among & (F.try_parse_url(F.trim("url"), F.lit("PROTOCOL")) == "https"), F.lit(False)))
    known = resolved(rows.where("_among").select("host"), resolve)
    refused = F.when(F.trim(F.coalesce("url", F.lit(""))) == "", "empty_source_url").when(~F.col("_among") | ~F.coalesce("open", F.lit(False)), "source_not_allowed")
    return rows.join(known, "host", "left").withColumn("refused", refused).drop("host", "_among", "open")


# ------------------------------------------------------------------ conditional requests


def collected(urls: DataFrame, state: DataFrame, hosts: tuple[str, ...], get: Get, resolve: Resolve = system_resolver, **limits) -> DataFrame:
    """A row for each distinct url: url, status, error_code, final_url, content_type, etag, modified, text, sha256, warnings.

    ``state`` (STATE) has what is stored: its etag and modified go with the request, and where the source answers that nothing
    changed (status not_modified) its text, its hash and validators that the answer leaves out stay. Refused urls, errors of the
    transport (fetch_failed) and answers of 400 and more (http_<code>) have no text.
    """
    ship(urls.sparkSession)
    asked = admitted(urls.select("url").distinct(), hosts, resolve)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([_got(get, *x) for x in zip(p["url"], p["etag"], p["modified"], strict=True)], columns=["url", "http", "final_url", "content_type", "content", "etag", "modified", "failure"])

    old = state.select("url", *[F.col(c).alias(f"_{c}") for c in ("etag", "modified", "content_type", "text", "sha256")])
    sent = asked.where("refused is null").join(old, "url", "left").select("url", F.col("_etag").alias("etag"), F.col("_modified").alias("modified"))
    found = sent.mapInPandas(run, "url string, http int, final_url string, content_type string, content binary, etag string, modified string, failure string")
    name = F.element_at(F.split(F.coalesce("final_url", "url"), "/"), -1)
    read = extract.extract(found.withColumn("name", name).withColumn("content", F.when(F.col("http").between(200, 399) & (F.col("http") != 304), F.col("content"))), **limits)
    rows = asked.join(read.withColumnRenamed("status", "_status"), "url", "left").join(old, "url", "left")
    same = F.col("http") == 304
    code = F.coalesce("refused", F.when(F.col("failure").isNotNull(), "fetch_failed").when(F.col("http") >= 400, F.concat(F.lit("http_"), F.col("http"))).when(~same, F.col("error_code")))
    kept = lambda c: F.when(same, F.coalesce(c, f"_{c}")).otherwise(F.col(c))
    text = lambda c: F.when(same, F.col(f"_{c}")).when(code.isNull(), F.col(c))
    said = F.when(F.col("failure").isNotNull(), F.array(F.concat(F.lit("Failed to fetch source URL: "), "failure"))).when(~same & code.isNull(), F.col("warnings")).otherwise(F.array().cast("array<string>"))
    status = F.when(code.isNotNull(), "error").when(same, "not_modified").otherwise("ok")
    return rows.select("url", status.alias("status"), code.alias("error_code"), "final_url", kept("content_type").alias("content_type"), kept("etag").alias("etag"), kept("modified").alias("modified"), text("text").alias("text"), text("sha256").alias("sha256"), said.alias("warnings"))


def _got(get: Get, url: str, etag: str | None, modified: str | None) -> tuple:
    try:
        return url, *get(url.strip(), etag, modified), None
    except Exception as e:  # noqa: BLE001  an error of the transport becomes the url's status
        return url, None, None, None, None, None, None, str(e)


def stored(state: DataFrame, results: DataFrame) -> DataFrame:
    """The new state: what came replaces what was there by url; urls that weren't asked for or failed keep what they had."""
    new = results.where("status in ('ok', 'not_modified')").select("url", "etag", "modified", "content_type", "text", "sha256")
    return state.select("url", "etag", "modified", "content_type", "text", "sha256").join(new.select("url"), "url", "left_anti").unionByName(new)
