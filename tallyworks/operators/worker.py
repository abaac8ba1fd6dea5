"""Workers over claimed rows: handlers by kind, middleware around them, retry policies and codecs."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import backoff_seconds

#: A job as a dictionary to (result, output, error).
Handler = Callable[[dict], tuple[str, str | None, str | None]]
Middleware = Callable[[Handler], Handler]


def chained(handler: Handler, middleware: list[Middleware]) -> Handler:
    """``handler`` inside all middleware; the first of the list is the outermost."""
    for wrap in reversed(middleware):
        handler = wrap(handler)
    return handler


def guarded(handler: Handler) -> Handler:
    """Exceptions become errors, so one job cannot end its batch."""

    def run(job: dict) -> tuple[str, str | None, str | None]:
        try:
            return handler(job)
        except Exception as e:  # noqa: BLE001 - whatever a handler raises is its result
            return "error", None, f"{type(e).__name__}: {e}"

    return run


def work(claimed: DataFrame, handlers: dict[str, Handler], middleware: list[Middleware] = ()) -> DataFrame:
    """(id, attempted_by, fence, result, output, error) of every claimed job; an unknown kind is an error.

    Handlers run in Arrow batches beside the rows and must be safe to repeat, as a lost
    executor's batch runs again; a result counts only through the fence of its attempt.
    """

    def unknown(job: dict) -> tuple[str, str | None, str | None]:
        return "error", None, f"no worker for {job['kind']}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {k: guarded(chained(h, list(middleware))) for k, h in handlers.items()}
        for batch in batches:
            done = [own.get(job["kind"], unknown)(job) for job in batch.to_dict("records")]
            out = batch[["id", "attempted_by", "fence"]].copy()
            out["result"], out["output"], out["error"] = ([d[i] for d in done] for i in range(3))
            yield out

    return claimed.mapInPandas(run, "id long, attempted_by long, fence long, result string, output string, error string")


def retry_delay(attempt: Column, kind: Column, by_kind: dict[str, float], own: Column | None = None) -> Column:
    """Seconds until a retry: the job's own delay, else that of its kind, else the default schedule."""
    table = F.create_map(*[F.lit(x) for k, v in sorted(by_kind.items()) for x in (k, float(v))]) if by_kind else None
    choices = ([own] if own is not None else []) + ([F.try_element_at(table, kind)] if table is not None else [])
    return F.coalesce(*choices, backoff_seconds(attempt))


def encode(value, packed: bool = False) -> str:
    """Arguments as text: canonical JSON, or deflated and in base 64 after ``z:``."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return "z:" + base64.b64encode(zlib.compress(text.encode())).decode() if packed else text


def decode(text: str):
    return json.loads(zlib.decompress(base64.b64decode(text[2:])) if text.startswith("z:") else text)
