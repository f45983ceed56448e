"""Addresses of hosts: looked up by tasks, checked, and kept for a time.

A request may go to a host only if it has addresses and none of them is
private. The request carries the address that was checked, so that a source
connects to it and a name that answers otherwise a moment later leads nowhere.
"""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import urls

Lookup = Callable[[str], list[str]]
KEPT_SECONDS = 30
AT_ONCE = 16
# Why a target is refused.
NO_HOST = "URL must contain a host"
UNRESOLVED = "Host could not be resolved: "
PRIVATE = "Private, local, link-local and multicast targets are blocked"


def system_addresses(host: str) -> list[str]:
    """All addresses that this machine's resolver gives; none if it fails."""
    try:
        found = socket.getaddrinfo(host.strip("[]"), None, type=socket.SOCK_STREAM)
    except (OSError, UnicodeError):
        return []
    return list(dict.fromkeys(f[4][0].split("%")[0] for f in found))


def is_private(address: str) -> bool:
    """Any-local, loopback, link-local, site-local or multicast; what is no address counts as private."""
    try:
        a = ipaddress.ip_address(address.strip("[]"))
    except ValueError:
        return True
    a = getattr(a, "ipv4_mapped", None) or a
    if a.version == 4:
        n = int(a)
        site = n >> 24 == 10 or n >> 20 == 0xAC1 or n >> 16 == 0xC0A8
    else:
        site = a.is_site_local
    return a.is_unspecified or a.is_loopback or a.is_link_local or a.is_multicast or site


def is_literal(host: str) -> bool:
    try:
        ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return False
    return True


def refusal(host: str | None, addresses: list[str]) -> str | None:
    """Why a host with these addresses may not be asked; None if it may."""
    if not host:
        return NO_HOST
    if not addresses:
        return UNRESOLVED + host
    return PRIVATE if any(map(is_private, addresses)) else None


def literal(host: Column) -> Column:
    """The address that a host is by itself; null for names."""
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    return F.when(urls.private_address(host).isNotNull(), bare)


def refused(host: Column, addresses: Column) -> Column:
    """``refusal`` of columns, natively."""
    return (
        F.when(host.isNull(), NO_HOST)
        .when(F.coalesce(F.size(addresses), F.lit(0)) <= 0, F.concat(F.lit(UNRESOLVED), host))
        .when(F.exists(addresses, lambda a: F.coalesce(urls.private_address(a), F.lit(True))), PRIVATE)
    )


def looked_up(hosts: DataFrame, lookup: Lookup) -> DataFrame:
    """``hosts(host)`` with ``addresses``; some are asked for at once in each task, what fails has none."""

    def safely(host: str) -> list[str]:
        try:
            return list(lookup(host))
        except Exception:  # the outside may fail in any way
            return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for b in batches:
                yield pd.DataFrame({"host": b["host"], "addresses": list(pool.map(safely, b["host"]))})

    return hosts.select("host").mapInPandas(run, "host string, addresses array<string>")


class Addresses:
    """Addresses by host for a crawl; names are looked up again when older than ``seconds``.

    ``save`` writes a table and reads it back; ``lookup`` None lets names pass.
    """

    def __init__(self, save: Callable[[DataFrame, str], DataFrame], lookup: Lookup | None, seconds: int = KEPT_SECONDS):
        self.save, self.lookup, self.seconds = save, lookup, seconds
        self.known: DataFrame | None = None
        self.turn = 0

    def of(self, hosts: DataFrame, now: int) -> DataFrame:
        """``(host, addresses)`` of the names among ``hosts(host)`` at a time (microseconds)."""
        names = hosts.where(F.col("host").isNotNull() & literal(F.col("host")).isNull()).distinct()
        live = None if self.known is None else self.known.where(F.col("at") > now - self.seconds * 1_000_000)
        need = names if live is None else names.join(live.select("host"), "host", "left_anti")
        found = looked_up(need, self.lookup).withColumn("at", F.lit(now))
        self.turn += 1
        self.known = self.save(found if live is None else live.unionByName(found), f"addresses-{self.turn}")
        return self.known.drop("at")

    def gate(self, rows: DataFrame, now: int) -> DataFrame:
        """Rows by their ``target`` with ``unsafe`` (a reason or null) and the ``address`` to connect to."""
        rows = rows.withColumn("_host", F.lower(urls.host(F.col("target"))))
        own = literal(F.col("_host"))
        if self.lookup is None:
            bad = F.when(F.col("_host").isNull(), NO_HOST).when(own.isNotNull() & urls.private_address(F.col("_host")), PRIVATE)
            return rows.withColumn("unsafe", bad).withColumn("address", own).drop("_host")
        known = self.of(rows.select(F.col("_host").alias("host")), now).withColumnsRenamed({"host": "_name", "addresses": "_addresses"})
        rows = rows.join(known, F.col("_host") == F.col("_name"), "left")
        all_of = F.when(own.isNotNull(), F.array(own)).otherwise(F.col("_addresses"))
        rows = rows.withColumn("unsafe", refused(F.col("_host"), all_of))
        return rows.withColumn("address", F.when(F.col("unsafe").isNull(), F.get(all_of, F.lit(0)))).drop("_host", "_name", "_addresses")
