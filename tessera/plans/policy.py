"""What happens when a query needs Python, and limits on what a terminal may bring to the driver."""

from __future__ import annotations

import threading
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from tessera.errors import UnsupportedError, ValidationError


@dataclass(frozen=True)
class Policy:
    """on_unsupported: 'error', 'warn' or 'fallback' for callables that can't be traced into native expressions."""

    on_unsupported: str = "fallback"
    max_rows_local: int | None = None
    timeout_ms: int | None = None

    def __post_init__(self):
        if self.on_unsupported not in ("error", "warn", "fallback"):
            raise ValidationError("on_unsupported is 'error', 'warn' or 'fallback'")

    def allow_python(self, why: str) -> None:
        if self.on_unsupported == "error":
            raise UnsupportedError(f"this callable needs Python on the executors: {why}")
        if self.on_unsupported == "warn":
            warnings.warn(f"this callable runs as Python on the executors: {why}", RuntimeWarning, stacklevel=3)

    def rows(self, df: DataFrame) -> list[Any]:
        """All rows on the driver; RuntimeError beyond max_rows_local, TimeoutError beyond timeout_ms."""
        # a plan of its own, as one whose job was cancelled can't run again
        got = self.timed(df, lambda: (df.select("*") if self.max_rows_local is None else df.limit(self.max_rows_local + 1)).collect())
        if self.max_rows_local is not None and len(got) > self.max_rows_local:
            raise RuntimeError(f"the result has more than {self.max_rows_local} rows")
        return got

    def timed(self, df: DataFrame, action: Callable[[], Any]) -> Any:
        if self.timeout_ms is None:
            return action()
        sc, tag, late, over = df.sparkSession.sparkContext, f"t{uuid.uuid4().hex}", threading.Event(), threading.Event()

        def stop():
            late.set()
            # again and again, as a job that isn't submitted yet can't be cancelled
            while not over.is_set():
                sc.cancelJobsWithTag(tag)
                over.wait(0.1)

        timer = threading.Timer(self.timeout_ms / 1000, stop)
        sc.addJobTag(tag)
        timer.start()
        said = TimeoutError(f"stopped after {self.timeout_ms} ms")
        try:
            got = action()
        except Exception as e:
            if late.is_set():
                raise said from e
            raise
        finally:
            over.set()
            timer.cancel()
            sc.removeJobTag(tag)
        if late.is_set():
            raise said
        return got
