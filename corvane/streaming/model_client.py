"""Calling a model service from Spark: quota, concurrency, retries, a durable log, resumption.

A client has complete(prompt, n) -> texts and embed(text) -> vector. The rows are dealt over so few
partitions that each one's share of the quota still admits large requests; a partition admits
requests while its minute's share lasts and has several of them in flight, its results in the order
of its rows. logged() writes what is done batch by batch, so a lost job costs one batch of calls.
"""

from __future__ import annotations

import heapq
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import datetime
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import count_pieces
from corvane.session import exists, remove, shared_dir

WINDOW_S = 60.0


class ModelClient(Protocol):
    def complete(self, prompt: str, n: int) -> list[str]: ...

    def embed(self, text: str) -> list[float]: ...


class Recorded:
    """A client that answers from a table of known answers: for tests and replays."""

    def __init__(self, answers: dict[str, list[str]], vectors: dict[str, list[float]] | None = None, failures: int = 0) -> None:
        self.answers, self.vectors, self.failures = answers, vectors or {}, failures

    def _fail(self) -> None:
        if self.failures:
            self.failures -= 1
            raise ConnectionError("a recorded failure")

    def complete(self, prompt: str, n: int) -> list[str]:
        self._fail()
        return self.answers[prompt][:n]

    def embed(self, text: str) -> list[float]:
        self._fail()
        return self.vectors[text]


class Quota:
    """Requests and tokens a minute: taken on admission, corrected on completion, given back a minute after that. Threads may share it."""

    def __init__(self, requests: int, tokens: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.most, self.requests, self.tokens = tokens, requests, tokens
        self.clock, self.sleep, self.lock = clock, sleep, threading.Lock()
        self.back: list[tuple[float, int]] = []

    def _taken(self, cost: int) -> float | None:
        """None if the request is admitted, else how long to wait before trying again."""
        with self.lock:
            while self.back and self.back[0][0] + WINDOW_S <= self.clock():
                _, given = heapq.heappop(self.back)
                self.requests += 1
                self.tokens += given
            if self.requests >= 1 and self.tokens >= cost:
                self.requests -= 1
                self.tokens -= cost
                return None
            # Requests in flight may free tokens before the oldest minute ends.
            return min(1.0, max(0.01, self.back[0][0] + WINDOW_S - self.clock())) if self.back else 0.05

    def admit(self, cost: int) -> None:
        if cost > self.most:
            raise ValueError(f"a request of {cost} tokens never fits a quota of {self.most}")
        while (wait := self._taken(cost)) is not None:
            self.sleep(wait)

    def done(self, cost: int, spent: int) -> None:
        with self.lock:
            self.tokens += cost - spent
            heapq.heappush(self.back, (self.clock(), spent))


def called(f: Callable[[], object], runs: int) -> tuple[object, int, str | None]:
    """(result, runs, error): any failure is tried again, so many runs in all."""
    error = None
    for run in range(1, runs + 1):
        try:
            return f(), run, None
        except Exception as e:  # noqa: BLE001  a service may fail in any way
            error = f"{type(e).__name__}: {e}"
    return None, runs, error


def _stamp() -> str:
    return datetime.now().isoformat()


def _dealt(rows: DataFrame, requests: int, tokens: int, partitions: int) -> tuple[DataFrame, tuple[int, int]]:
    """The rows over at most so many partitions, and a partition's share: 10,000 tokens and one request a minute at least, so shares never add up to more than the quota."""
    parts = max(1, min(partitions, requests, tokens // 10_000))
    return rows.repartition(parts), (requests // parts, tokens // parts)


def pumped(costs: list[int], call: Callable[[int], tuple[object, int]], quota: Quota, in_flight: int) -> list[object]:
    """call(i) -> (result, tokens spent) for every i, so many at a time, each once the quota admits its cost; results in order.

    What never fits the quota gives its error instead of a result.
    """
    open_, out = threading.Semaphore(in_flight), []

    def run(i: int, cost: int) -> object:
        spent = cost
        try:
            result, spent = call(i)
            return result
        finally:
            quota.done(cost, spent)
            open_.release()

    with ThreadPoolExecutor(in_flight) as pool:
        for i, cost in enumerate(costs):
            open_.acquire()
            try:
                quota.admit(cost)
            except ValueError as e:
                open_.release()
                out.append(e)
                continue
            out.append(pool.submit(run, i, cost))
        return [x.result() if isinstance(x, Future) else x for x in out]


def completions(prompts: DataFrame, client: Callable[[], ModelClient], n: int = 3, requests: int = 3000, tokens: int = 250_000, runs: int = 10, column: str = "prompt", counter: Callable[[str], int] = count_pieces, partitions: int = 16, in_flight: int = 16) -> DataFrame:
    """prompts and text_out_list, request_start_time, request_end_time, in_tokens, out_tokens, runs, error.

    A request counts twice its prompt until its answers are known. What fails in all runs, or is too
    large for the quota, keeps a row with its error instead of vanishing; resumption drops such rows
    from what is done.
    """
    dealt, share = _dealt(prompts, requests, tokens, partitions)
    more = "text_out_list array<string>, request_start_time string, request_end_time string, in_tokens bigint, out_tokens bigint, runs bigint, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, quota = client(), Quota(*share)
        for pdf in batches:
            asked = pdf[column].tolist()
            costs = [counter(p) for p in asked]

            def ask(i: int, asked=asked, costs=costs) -> tuple[tuple, int]:
                start = _stamp()
                texts, times, error = called(lambda: service.complete(asked[i], n), runs)
                spent = sum(map(counter, texts or ()))
                return (texts, start, _stamp(), costs[i], spent, times, error), costs[i] + spent

            got = pumped([2 * c for c in costs], ask, quota, in_flight)
            out = [(None, None, None, c, 0, 0, f"ValueError: {x}") if isinstance(x, ValueError) else x for x, c in zip(got, costs, strict=True)]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=[c.split()[0] for c in more.split(", ")])], axis=1)

    own = ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes)
    return dealt.mapInPandas(run, f"{own}, {more}")


def embeddings(texts: DataFrame, client: Callable[[], ModelClient], requests: int = 3000, tokens: int = 1_000_000, runs: int = 10, counter: Callable[[str], int] = count_pieces, partitions: int = 16, in_flight: int = 16) -> DataFrame:
    """(text_id, text) with embedding, tokens, runs, error; the id is the text's own, so the order of completion is of no matter."""
    dealt, share = _dealt(texts.select("text_id", "text"), requests, tokens, partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, quota = client(), Quota(*share)
        for pdf in batches:
            asked = pdf.text.tolist()
            costs = [counter(t) for t in asked]

            def ask(i: int, asked=asked, costs=costs) -> tuple[tuple, int]:
                vector, times, error = called(lambda: service.embed(asked[i]), runs)
                return (vector, costs[i], times, error), costs[i]

            got = pumped(costs, ask, quota, in_flight)
            out = [(None, c, 0, f"ValueError: {x}") if isinstance(x, ValueError) else x for x, c in zip(got, costs, strict=True)]
            yield pd.concat([pdf[["text_id", "text"]].reset_index(drop=True), pd.DataFrame(out, columns=["embedding", "tokens", "runs", "error"])], axis=1)

    return dealt.mapInPandas(run, "text_id bigint, text string, embedding array<double>, tokens bigint, runs bigint, error string")


def logged(todo: DataFrame, key: list[str], call: Callable[[DataFrame], DataFrame], path: str, batches: int = 100) -> None:
    """Runs call over todo in so many batches by a hash of the key, each appended to the JSON log as it ends; what the log has is not asked again.

    The log is read once and what is left dealt to the batches once, so a batch reads its own rows only.
    A job that dies loses the batch it was in. Run again with the same number of batches or another, it goes on.
    """
    spark = todo.sparkSession
    if exists(spark, path):
        shape = ", ".join(f"`{c}` {t}" for c, t in todo.select(*key).dtypes)
        todo = remaining(todo, spark.read.schema(f"{shape}, error string").json(path), *key)
    dealt = f"{shared_dir(spark)}/todo-{uuid.uuid4().hex}"
    todo.withColumn("_batch", F.pmod(F.xxhash64(*key), F.lit(batches)).cast("int")).write.partitionBy("_batch").parquet(dealt)
    for k in range(batches):
        if exists(spark, f"{dealt}/_batch={k}"):
            call(spark.read.schema(todo.schema).parquet(f"{dealt}/_batch={k}")).write.mode("append").option("ignoreNullFields", False).json(path)
    remove(spark, dealt)


def remaining(todo: DataFrame, log: DataFrame | None, *key: str) -> DataFrame:
    """What the log has no successful row for."""
    if log is None:
        return todo
    done = log.where("error is null") if "error" in log.columns else log
    return todo.join(done.select(*key).distinct(), list(key), "left_anti")
