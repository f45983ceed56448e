"""Fetching as a replaceable source.

A fetched web is a table ``(url, attempt, status, content_type, body,
location, retry_after, error)``; ``attempt`` null serves every attempt. The
crawl joins its frontier to it. Instead of a table a web may be a function
from requests to such a table: ``live_web`` makes one of an injected fetch
function, an Arrow batch at a time. Only the ``http_pages`` source opens
connections by itself.
"""

from __future__ import annotations

import socket
import ssl
import time
from collections.abc import Callable, Iterator
from http.client import HTTPConnection, HTTPException
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions import fetching
from lodestone.functions.urls import DEFAULT_PORTS
from lodestone.operators import addresses

WEB = "url string, attempt int, status int, content_type string, body string, location string, retry_after string, error string"
MAX_REDIRECTS = 5
Web = DataFrame | Callable[[DataFrame], DataFrame]


def pages_as_web(pages: DataFrame, url: Column) -> DataFrame:
    """A table of saved pages as a web in which each answers 200."""
    none = F.lit(None)
    return pages.select(
        url.alias("url"), none.cast("int").alias("attempt"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.col("html").alias("body"),
        none.cast("string").alias("location"), none.cast("string").alias("retry_after"), none.cast("string").alias("error"),
    )


def decode_body(raw: Column, content_type: Column) -> Column:
    """Bytes to text by the header's charset; UTF-8 if it names none that is known."""
    name = F.upper(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_\-]+)", 1))
    kinds = ("ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32")
    out = F.decode(raw, "UTF-8")
    for k in kinds:
        out = F.when(name == k, F.decode(raw, k)).otherwise(out)
    return out


def answers(requests: DataFrame, web: Web, cap: int = fetching.BODY_CAP) -> DataFrame:
    """``requests(url, attempt, ...)`` with the web's answer; unknown URLs are 404.

    A row of the web for this very attempt goes before one for any attempt. A
    body over the cap is an ``io`` error, not a shorter body.
    """
    w = web(requests) if callable(web) else web
    w = w.withColumnRenamed("url", "w_url").withColumnRenamed("attempt", "w_attempt")
    joined = requests.join(w, (F.col("url") == F.col("w_url")) & (F.col("w_attempt").isNull() | (F.col("w_attempt") == F.col("attempt"))), "left")
    best = W.partitionBy(*requests.columns).orderBy(F.col("w_attempt").desc_nulls_last())
    one = joined.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "w_attempt")
    known = F.col("w_url").isNotNull()
    large = ~F.coalesce(fetching.within_cap(F.col("body"), cap), F.lit(True))
    one = one.withColumn("error", F.when(large, "io").otherwise(F.col("error"))).withColumn("body", F.when(~large, F.col("body")))
    return one.withColumn("status", F.when(known, F.col("status")).otherwise(404)).drop("w_url")


def follow(
    requests: DataFrame, web: Web, gate: Callable[[DataFrame], DataFrame], resolve: Callable[[Column, Column], Column], save: Callable[[DataFrame, str], DataFrame],
    pace: Callable[[DataFrame, int], DataFrame] | None = None, hops: int = MAX_REDIRECTS,
) -> DataFrame:
    """Answers of requests with redirects followed, and every hop gated.

    ``gate`` adds ``blocked`` (a reason or null), ``delay_ms`` and the
    ``address`` to connect to, to rows by their ``target`` column before each
    hop; ``pace`` then gives those that may go their ``slot_us``, and may leave
    out rows of the first hop that have to wait. The result has ``final_url``, the answer columns,
    the last slot, and ``error``: ``blocked`` with the reason in
    ``error_message``, ``io`` for a redirect without a place to go or one too
    many. ``save`` writes a hop's rows, so the plan stays that of one hop;
    without redirects there is one.
    """
    keys = requests.columns
    open_rows = requests.withColumn("target", F.col("url"))
    done: DataFrame | None = None
    for hop in range(hops + 1):
        gated = gate(open_rows)
        asked = gated.where("blocked is null").drop("blocked")
        asked = (pace(asked, hop) if pace else asked.withColumn("slot_us", F.lit(None).cast("long"))).drop("delay_ms")
        got = answers(asked.withColumnRenamed("url", "asked_url").withColumnRenamed("target", "url"), web).withColumnRenamed("url", "target").withColumnRenamed("asked_url", "url")
        moved = F.coalesce(fetching.is_redirect(F.col("status")) & F.col("error").isNull(), F.lit(False))
        lost = moved & (F.col("location").isNull() | F.lit(hop == hops))
        got = got.withColumn("onward", moved & ~lost)
        got = got.withColumn("error_message", F.when(lost, F.when(F.col("location").isNull(), "Redirect without a Location header").otherwise("Too many redirects")).otherwise(F.col("error")))
        got = got.withColumn("error", F.when(lost, "io").otherwise(F.col("error")))
        stopped = gated.where("blocked is not null").withColumn("error_message", F.col("blocked")).withColumn("error", F.lit("blocked")).withColumn("onward", F.lit(False)).drop("blocked", "delay_ms")
        both = save(got.unionByName(stopped, allowMissingColumns=True).drop("address"), f"hop-{hop}")
        final = both.where("not onward").drop("onward")
        done = final if done is None else done.unionByName(final)
        onward = both.where("onward")
        if hop == hops or onward.isEmpty():
            break
        open_rows = onward.select(*keys, resolve(F.col("target"), F.col("location")).alias("target"))
    return done.withColumnRenamed("target", "final_url")


def live_web(fetch: Callable[..., dict], wait: bool = False, pinned: bool = False) -> Web:
    """A web that asks an injected function.

    ``fetch(url, attempt)`` returns a dict with the web's columns; what it
    raises becomes an ``io`` error. With ``wait`` a worker sleeps until a
    request's ``slot_us`` (microseconds since 1970) before it asks, and a crawl
    keeps to the time of day. ``pinned``: ``fetch`` also takes the address that
    was checked (null if none was).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in WEB.split(", ")]
        for b in batches:
            rows = []
            for url, attempt, slot, address in zip(b["url"], b["attempt"], b["slot_us"], b["address"]):
                if wait and slot == slot:
                    time.sleep(max(0.0, slot / 1e6 - time.time()))
                try:
                    got = {**dict.fromkeys(names), **fetch(url, int(attempt), *([address] if pinned else []))}
                except Exception as e:  # the outside may fail in any way
                    got = {**dict.fromkeys(names), "error": "io", "body": str(e)[:2000]}
                rows.append({**got, "url": url, "attempt": int(attempt)})
            yield pd.DataFrame(rows, columns=names)

    def web(requests: DataFrame) -> DataFrame:
        slot = F.col("slot_us") if "slot_us" in requests.columns else F.lit(None).cast("long").alias("slot_us")
        address = F.col("address") if "address" in requests.columns else F.lit(None).cast("string").alias("address")
        return requests.select("url", "attempt", slot, address).sortWithinPartitions("slot_us").mapInPandas(run, WEB)

    web.live = wait
    return web


def http_web(user_agent: str = "lodestone/1.0", timeout: float = 12) -> Web:
    """A web of plain GETs, for ``crawl``, to the addresses that it checked; no redirect is followed here."""
    reader = HttpReader({"user_agent": user_agent, "timeout": str(timeout), "allow_private": "true"})

    def fetch(url: str, attempt: int, address: str | None) -> dict:
        return dict(zip([c.split()[0] for c in WEB.split(", ")], reader.get(url, address)))

    return live_web(fetch, wait=True, pinned=True)


class HttpPages(DataSource):
    """``spark.read.format("http_pages")``: GETs of a list of URLs.

    Options: ``urls`` (one per line), ``user_agent``, ``timeout`` seconds,
    ``allow_private``. Each URL is a partition; redirects are not followed here
    (see ``follow``). A host's addresses are checked, and the one that was
    checked is connected to; a refused one is an ``unsafe`` error.
    """

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return WEB

    def reader(self, schema) -> "HttpReader":
        return HttpReader(dict(self.options))


class HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u.strip()) for u in self.options.get("urls", "").split("\n") if u.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url, address = partition.value, None
        if self.options.get("allow_private", "false").lower() != "true":
            host = urlsplit(url).hostname
            found = addresses.system_addresses(host) if host else []
            why = addresses.refusal(host, found)
            if why is not None:
                yield (url, 1, None, None, why, None, None, "unsafe")
                return
            address = found[0]
        yield self.get(url, address)

    def get(self, url: str, address: str | None) -> tuple:
        """One GET as a row; ``address`` is connected to instead of the URL's name."""
        try:
            parts = urlsplit(url)
            timeout = float(self.options.get("timeout", "12"))
            sock = socket.create_connection((address or parts.hostname, parts.port or DEFAULT_PORTS[parts.scheme]), timeout)
            if parts.scheme == "https":
                sock = ssl.create_default_context().wrap_socket(sock, server_hostname=parts.hostname)
            connection = HTTPConnection(parts.hostname, parts.port, timeout=timeout)
            connection.sock = sock
            try:
                where = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
                headers = {"Host": parts.netloc.rpartition("@")[2], "User-Agent": self.options.get("user_agent", "lodestone/1.0"), "Accept": "text/html,application/xhtml+xml", "Connection": "close"}
                connection.request("GET", where, headers=headers)
                r = connection.getresponse()
                raw = r.read(fetching.BODY_CAP + 1)
            finally:
                connection.close()
            if len(raw) > fetching.BODY_CAP:
                return (url, 1, r.status, None, None, None, None, "io")
            charset = r.headers.get_content_charset() or "utf-8"
            try:
                body = raw.decode(charset, "replace")
            except LookupError:
                body = raw.decode("utf-8", "replace")
            return (url, 1, r.status, r.headers.get("Content-Type"), body, r.headers.get("Location"), r.headers.get("Retry-After"), None)
        except (OSError, HTTPException, ValueError, KeyError) as e:
            return (url, 1, None, None, str(e)[:2000], None, None, "io")
