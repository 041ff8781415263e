"""New responses in, products out, also where only a browser can show a page and its body comes later."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfscan.operators.extract import drop_nameless, extract_products
from shelfscan.operators.groups import salt_of
from shelfscan.operators.screen import route_of, route_reason
from shelfscan.session import ship

#: URLs are dealt by hash into this many groups, each one row of state: a call of Python for every URL costs far more than its rows.
GROUPS = 1 << 14
#: What is known of the URLs of a group, side by side: whether a browser's body is waited for, only failures came or a page was
#: put out (``FLAGS`` as bits), until when (ms of event time) it is remembered, and a body that came first.
STATE = "sites ARRAY<STRING>, urls ARRAY<STRING>, flags ARRAY<INT>, untils ARRAY<BIGINT>, helds ARRAY<STRING>"
FLAGS = [(bool(n & 1), bool(n & 2), bool(n & 4)) for n in range(8)]
PAGES = "site STRING, url STRING, fetched_at TIMESTAMP, html STRING"


def said(fetch_stream: DataFrame) -> DataFrame:
    """(site, url, fetched_at, attempt, says, html): what each response says of its URL, row by row.

    ``accept`` and ``drawn`` bring HTML; ``needs_render`` and ``drop`` are the verdicts on a plain response that counts;
    ``failed`` is one that does not. Drawn bodies without text or with an error say nothing.
    """
    reason = route_reason("status", "coalesce(body, '')")
    rows = fetch_stream.selectExpr("*", "coalesce(via, 'http') = 'render' AS drawn", "coalesce(error IS NULL AND status <> 429, false) AS counts", f"{reason} AS reason")
    says = f"CASE WHEN drawn THEN if(error IS NULL AND body IS NOT NULL, 'drawn', NULL) WHEN counts THEN {route_of()} ELSE 'failed' END"
    told = rows.selectExpr("site", "url", "fetched_at", "coalesce(attempt, 0) AS attempt", f"{says} AS says", "body").filter("says IS NOT NULL")
    return told.selectExpr("site", "url", "fetched_at", "attempt", "says", "if(says IN ('accept', 'drawn'), coalesce(body, ''), NULL) AS html")


def next_state(rows: list[tuple[str, str | None]], waiting: bool, failed: bool, done: bool, held: str | None) -> tuple[tuple, str | None]:
    """State after ``rows`` (says, html) in order, and the HTML to put out, if any.

    The first plain response that counts decides; a body of a browser is put out where that one, or nothing but failures,
    asks for it. Each URL is put out once while it is remembered.
    """
    out = None
    for says, html in rows:
        if done:
            break
        if says == "drawn":
            held = html if held is None else held
        elif says == "failed":
            failed = True
        elif not waiting:
            waiting, done = says == "needs_render", says in ("accept", "drop")
            out = html if says == "accept" else None
        if held is not None and waiting and not done:
            out, done = held, True
    # Nothing but failures: the browser's body counts, unless a plain response came with them.
    if not done and failed and not waiting and held is not None:
        out, done = held, True
    return (waiting, failed, done, None if done else held), out


def _remember(delay: timedelta):
    """The step of one URL: ``run(key, parts, state)`` gives its (site, url, fetched_at, html), if one is put out now.

    ``parts`` are frames, or lists by column; ``state`` is asked and told as Spark's GroupState is.
    """

    def run(key: tuple, parts: Iterable, state: GroupState | Known) -> Iterator[tuple]:
        if state.hasTimedOut:
            state.remove()
            return
        # Most URLs are a single row, so they are read as plain lists: a frame costs far more than its row.
        rows = [row for part in parts for row in zip(part["says"], part["attempt"], part["fetched_at"], part["html"])]
        # Within a batch plain responses go by attempt; bodies of a browser are looked at after them.
        rows.sort(key=lambda row: (row[0] == "drawn", row[1], pd.isna(row[2]), 0 if pd.isna(row[2]) else row[2].value))
        known = state.get if state.exists else (False, False, False, None)
        new, html = next_state([(says, html) for says, _, _, html in rows], *known)
        state.update(new)
        newest = max((at for _, _, at, _ in rows if not pd.isna(at)), default=pd.NaT)
        until = int((newest + delay).timestamp() * 1000)
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        if html is not None:
            yield key[0], key[1], newest, html

    return run


class Known:
    """State of one URL within the state of its group."""

    hasTimedOut = False

    def __init__(self, watermark: int, value: tuple | None = None, until: int = 0):
        self.watermark, self.get, self.until = watermark, value, until

    @property
    def exists(self) -> bool:
        return self.get is not None

    def update(self, value: tuple) -> None:
        self.get = value

    def setTimeoutTimestamp(self, until: int) -> None:
        self.until = until

    def getCurrentWatermarkMs(self) -> int:
        return self.watermark


def _remember_groups(delay: timedelta):
    """The step of a group of URLs: each with rows takes its own step, each other one is forgotten at its own time."""
    step = _remember(delay)
    columns = ("says", "attempt", "fetched_at", "html")

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        known: dict[tuple, Known] = {}
        if state.exists:
            for site, url, flags, until, held in zip(*state.get):
                known[site, url] = Known(watermark, (*FLAGS[flags], held), until)
        came: dict[tuple, dict[str, list]] = {}
        if not state.hasTimedOut:
            for part in parts:
                for site, url, *row in zip(part["site"], part["url"], *(part[c] for c in columns)):
                    of_url = came.setdefault((site, url), {c: [] for c in columns})
                    for c, value in zip(columns, row):
                        of_url[c].append(value)
        out = []
        for url, rows in came.items():
            out.extend(step(url, [rows], known.setdefault(url, Known(watermark))))
        kept = {url: k for url, k in known.items() if url in came or k.until >= watermark}
        if kept:
            # Field by field: of each URL (waiting, failed, done, held) become bits and the body.
            bits = [sum(flag << i for i, flag in enumerate(k.get[:3])) for k in kept.values()]
            sites, urls = map(list, zip(*kept))
            state.update((sites, urls, bits, [k.until for k in kept.values()], [k.get[3] for k in kept.values()]))
            state.setTimeoutTimestamp(min(k.until for k in kept.values()))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["site", "url", "fetched_at", "html"])

    return run


def readable_once(fetch_stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(site, url, fetched_at, html) of URLs that can be read, each once, as fetched or as a browser drew it.

    State is flags per URL, kept for ``delay`` of event time after its last response, in ``GROUPS`` rows at most. It holds a
    body only while a browser's came before the plain response that asks for it.
    """
    ship(fetch_stream.sparkSession)
    told = said(fetch_stream).withWatermark("fetched_at", delay).withColumn("group", salt_of("site", "url", salts=GROUPS))
    step = _remember_groups(pd.Timedelta(delay).to_pytimedelta())
    return told.groupBy("group").applyInPandasWithState(step, PAGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def products_of_pages(pages: DataFrame) -> DataFrame:
    return drop_nameless(extract_products(pages, keep=("site", "url", "fetched_at")))


def products_of_batch(batch: DataFrame) -> DataFrame:
    """Products of the plain responses of a batch that can be read as they are."""
    return products_of_pages(said(batch).filter("says = 'accept'").select("site", "url", "fetched_at", "html"))


def stream_products(
    fetch_stream: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", available_now: bool = False
) -> StreamingQuery:
    """Append the products of new responses to a Parquet table, by batch.

    A batch that is run again after a failure replaces its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        products_of_pages(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = readable_once(fetch_stream, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
