"""User scorers run over partitions (F1, F2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCORED = "item_key string, response string, status string, attempts int, error string"


def ask_all(
    requests: DataFrame, complete: Callable[[str], str | None], attempts: int = 3
) -> DataFrame:
    """Call ``complete(request)`` for each (item_key, request) row.

    A row is tried up to ``attempts`` times; what a row raises stays with that row
    (ERROR), an empty answer is FAILED, and the job goes on. Batches stream through,
    so a partition never sits in memory as a whole.
    """

    def ask(request: str | None) -> tuple[str | None, str, int, str | None]:
        problem: str | None = None
        for n in range(1, attempts + 1):
            try:
                answer = complete(request)
            except Exception as e:  # noqa: BLE001 - one item must not stop the job
                problem = f"{type(e).__name__}: {e}"
                continue
            if answer:
                return answer, "OK", n, None
            problem = None
        return None, "ERROR" if problem else "FAILED", attempts, problem

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [ask(r) for r in batch["request"]]
            out = pd.DataFrame(rows, columns=["response", "status", "attempts", "error"])
            out.insert(0, "item_key", batch["item_key"].to_numpy())
            yield out

    return requests.select("item_key", "request").mapInPandas(run, SCORED)
