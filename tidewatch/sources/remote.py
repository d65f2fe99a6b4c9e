"""Calls to the outside, through functions the caller supplies.

``fetch`` and ``ask`` are injected, so tests and offline runs need no network.
Calls are made on executors, a partition at a time; task retries may repeat
them, so they must be safe to repeat (the caches in ``state`` make them rare).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# HTTP statuses worth another try.
RETRY = frozenset({429, 500, 502, 503, 504})
Fetched = tuple[int, str]


def with_retries(fetch: Callable[[str], Fetched], tries: int = 3, pause: float = 0.5) -> Callable[[str], Fetched]:
    """``fetch`` tried again, after growing pauses, on retryable statuses and errors of connection."""

    def call(url: str) -> Fetched:
        status, body = 0, ""
        for n in range(tries):
            try:
                status, body = fetch(url)
            except (OSError, TimeoutError) as e:
                status, body = 0, str(e)[:80]
            if status and status not in RETRY:
                break
            if n + 1 < tries:
                time.sleep(pause * 2**n)
        return status, body

    return call


def fetch_pages(requests: DataFrame, key: str, url: str, fetch: Callable[[str], Fetched], tries: int = 3, pause: float = 0.5) -> DataFrame:
    """(key, http_status, body, seconds) of each requested URL."""
    kind = requests.schema[key].dataType.simpleString()

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(fetch, tries, pause)
        for batch in batches:
            out = []
            for k, u in zip(batch[key], batch["tw_url"]):
                began = time.monotonic()
                out.append((k, *call(u), time.monotonic() - began))
            yield pd.DataFrame(out, columns=[key, "http_status", "body", "seconds"])

    return requests.select(F.col(key), F.col(url).alias("tw_url")).mapInPandas(over, f"`{key}` {kind}, http_status int, body string, seconds double")


def request_key(*fields: str) -> Column:
    """Hash of a request's content, by which answers are cached."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def ask_in_batches(requests: DataFrame, key: str, payload: str, ask: Callable[[list[str]], str], schema: str, size: int = 3) -> DataFrame:
    """(key, answer): answers to JSON payloads, asked ``size`` at a time.

    An answer must be a JSON list of objects with ``n``, the number (from 0) in
    the batch; numbers that are missing, out of range or stand twice yield
    null.  ``answer`` is parsed by ``schema``, strictly.
    """
    kind = requests.schema[key].dataType.simpleString()

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, payloads = batch[key].tolist(), batch["tw_payload"].tolist()
            out = []
            for at in range(0, len(keys), size):
                part = payloads[at : at + size]
                try:
                    rows = json.loads(ask(part))
                except (OSError, TimeoutError, ValueError):
                    rows = []
                by_n: dict[int, list] = {}
                for row in rows if isinstance(rows, list) else []:
                    if isinstance(row, dict) and isinstance(row.get("n"), int):
                        by_n.setdefault(row["n"], []).append(row)
                for n in range(len(part)):
                    own = by_n.get(n, [])
                    out.append((keys[at + n], json.dumps(own[0]) if len(own) == 1 else None))
            yield pd.DataFrame(out, columns=[key, "raw"])

    raw = requests.select(F.col(key), F.col(payload).alias("tw_payload")).mapInPandas(over, f"`{key}` {kind}, raw string")
    return raw.select(key, F.from_json("raw", schema, {"mode": "PERMISSIVE"}).alias("answer"))
