"""Providers of generated text and embeddings.

A provider has ``generate(system, prompt, temperature) -> str`` and ``embed(texts)``. The
default generates nothing, so that every result is deterministic without a network. Providers are
called in tasks, over batches; each partition gets its share of the allowed calls a minute.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def generate(self, system: str, prompt: str, temperature: float = 0.2) -> str: ...


class NullProvider:
    """No text and no vectors."""

    def generate(self, system: str, prompt: str, temperature: float = 0.2) -> str:
        return ""

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return [None for _ in texts]


class HashProvider:
    """Stand-in for tests: answers JSON made from a hash of the prompt."""

    def generate(self, system: str, prompt: str, temperature: float = 0.2) -> str:
        return json.dumps({"summary": f"Computes {hashlib.md5(prompt.encode()).hexdigest()} from the inputs given."})

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts]


@dataclass
class HttpProvider:
    """A local model server. Overload and server errors wait 2**n seconds, timeouts 10 * 2**n;
    other client errors end at once; an empty answer is asked for again."""

    base_url: str
    model: str
    timeout: float = 120
    tries: int = 5
    options: dict | None = None
    embed_model: str = ""
    sleep: Callable[[float], None] = time.sleep

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(self.base_url.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return json.loads(r.read())

    def generate(self, system: str, prompt: str, temperature: float = 0.2) -> str:
        body = {"model": self.model, "system": system, "prompt": prompt, "stream": False, "options": {"temperature": temperature, **(self.options or {})}}
        last: Exception | None = None
        for n in range(self.tries):
            wait = 2.0**n
            try:
                text = str(self._post("/api/generate", body).get("response") or "").strip()
                if text:
                    return text
                last = ValueError("the answer is empty")
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500:
                    raise
                last = e
            except TimeoutError as e:
                last, wait = e, 10 * 2.0**n
            except (urllib.error.URLError, OSError) as e:
                last = e
            if n + 1 < self.tries:
                self.sleep(wait)
        raise RuntimeError(f"no answer after {self.tries} tries") from last

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return [self._post("/api/embeddings", {"model": self.embed_model or self.model, "prompt": t}).get("embedding") for t in texts]


class Limiter:
    """At least 60 / calls a minute seconds between calls."""

    def __init__(self, calls_per_minute: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep = 60 / calls_per_minute, clock, sleep
        self.reset()

    def reset(self) -> None:
        self.next, self.calls = float("-inf"), 0

    def wait(self) -> float:
        """Waits for the next allowed start and returns it."""
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        start = max(now, self.next)
        self.next, self.calls = start + self.gap, self.calls + 1
        return start

    def stats(self) -> dict:
        return {"calls": self.calls, "seconds_between": self.gap}


def generate(prompts: DataFrame, provider: Provider, *, system: str = "", calls_per_minute: float | None = None, partitions: int | None = None) -> DataFrame:
    """``prompts(key, prompt)`` with ``answer``; an error gives an empty answer and ``error``.

    Keys are made distinct first, so that a prompt is asked once. With a limit, the rows are dealt
    to ``partitions`` tasks and each takes its share of the calls."""
    once = prompts.select("key", "prompt").groupBy("key").agg(F.min("prompt").alias("prompt"))
    tasks = partitions or 1
    if calls_per_minute:
        once = once.repartition(tasks, "key")

    def run(batches):
        limit = Limiter(calls_per_minute / tasks) if calls_per_minute else None
        for b in batches:
            answers, errors = [], []
            for p in b.column(1).to_pylist():
                if limit:
                    limit.wait()
                try:
                    answers.append(provider.generate(system, p or "", 0.2))
                    errors.append(None)
                except Exception as e:
                    answers.append("")
                    errors.append(f"{type(e).__name__}: {e}"[:300])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["key", "prompt", "answer", "error"])

    return once.mapInArrow(run, "key string, prompt string, answer string, error string")


def embed(text: Column, provider) -> Column:
    """Embeddings of a text column, batch by batch."""
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(provider.embed([t or "" for t in s]))

    return run(text)
