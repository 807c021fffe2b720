"""External services and models as injected callables: chat requests, retries, scoring hooks."""

from __future__ import annotations

import asyncio
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType


def requests(rows: DataFrame, system: str, template: str, key: str = "report_id", **columns: str) -> DataFrame:
    """(key, messages): a system and a user message, the template filled from columns."""
    from loomwork.functions import text as T

    user = T.filled(template, **{n: F.col(c) for n, c in columns.items()})
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return rows.select(key, F.array(message("system", F.lit(system)), message("user", user)).alias("messages"))


def asked(rows: DataFrame, provider: Callable[[], Callable], valid: Callable[[str], str | None] = lambda _: None, *, key: str = "report_id", at_once: int = 15, tries: int = 3, pause: float = 1.0, features: dict | None = None) -> DataFrame:
    """(key, status, answer, error, attempts): an async chat callable asked for each row, `at_once` at a time per task.

    provider() makes the callable on the executor; it gets messages and returns
    text.  An exception, or a text that valid() objects to, is tried again after a
    doubled pause, with the objection as one more message; the last answer of a failed
    row is kept.  features: options passed to the callable by name; a service that
    refuses a request (an error with status 400) gets it again at once without the
    next of them, in their order, as long as there are any.  Tasks may be retried, so
    the service should be idempotent; skip ids already written beforehand.
    """

    async def one(chat, gate, messages):
        error, wait, last, given, n = "", pause, None, dict(features or {}), 0
        while n < tries:
            n += 1
            async with gate:
                try:
                    last = text = await chat(messages, **given)
                    problem = valid(text)
                    if problem is None:
                        return "success", text, None, n
                    error = problem
                    messages = [*messages, {"role": "user", "content": problem}]
                except Exception as e:  # noqa: BLE001 - the service's error is data here
                    error = f"{type(e).__name__}: {e}"
                    if given and getattr(e, "status", getattr(e, "status_code", None)) == 400:
                        given.pop(next(iter(given)))
                        n -= 1
                        continue
            if n < tries:
                await asyncio.sleep(wait)
                wait *= 2
        return "failed", last, error, n

    def run(batches):
        chat = provider()

        async def all_of(cells):
            gate = asyncio.Semaphore(at_once)
            return await asyncio.gather(*(one(chat, gate, m) for m in cells))

        for b in batches:
            got = asyncio.run(all_of(b.column("messages").to_pylist()))
            status, answer, error, n = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(status, pa.string()), pa.array(answer, pa.string()), pa.array(error, pa.string()), pa.array(n, pa.int32())], [key, "status", "answer", "error", "attempts"])

    schema = StructType([rows.schema[key]]).add("status", "string").add("answer", "string").add("error", "string").add("attempts", "integer")
    return rows.select(key, "messages").mapInArrow(run, schema)


def scored(rows: DataFrame, model: Callable[[], Callable], columns: list[str], into: str = "scores") -> DataFrame:
    """rows with `into`: a batch model made once per task, given the named columns as Arrow arrays, returns lists of floats."""

    def run(batches):
        predict = model()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(predict(*(b.column(c) for c in columns)), pa.list_(pa.float32()))], [*b.schema.names, into])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add(into, ArrayType(FloatType())))
