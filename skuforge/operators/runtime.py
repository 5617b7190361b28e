"""Model calls: distinct prompts, a cache table, providers behind an interface, pacing and retries."""

from __future__ import annotations

import dataclasses
import re
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuforge.sources import tables


class RateLimiter:
    """At most `rpm` grants in any 60 seconds, over all threads of a process; 0 or less means no limit."""

    def __init__(self, rpm: int, window: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rpm, self.window, self.clock, self.sleep = rpm, window, clock, sleep
        self.granted: deque[float] = deque()
        self.blocked_until = 0.0
        self.lock = threading.Lock()

    def acquire(self) -> float:
        """Waits for its turn; returns the seconds waited."""
        if self.rpm <= 0:
            return 0.0
        waited = 0.0
        while True:
            with self.lock:
                now = self.clock()
                while self.granted and now - self.granted[0] >= self.window:
                    self.granted.popleft()
                if len(self.granted) < self.rpm and now >= self.blocked_until:
                    self.granted.append(now)
                    return waited
                turn = self.granted[0] + self.window if len(self.granted) >= self.rpm else now
                pause = max(turn, self.blocked_until) - now
            self.sleep(max(pause, 0.001))
            waited += pause

    def penalise(self, seconds: float) -> None:
        with self.lock:
            self.blocked_until = max(self.blocked_until, self.clock() + seconds)


def retry_after(message: str) -> float | None:
    found = re.search(r"retry in ([0-9.]+)\s*s|retryDelay['\"]?\s*:\s*['\"]?([0-9.]+)s", message, re.IGNORECASE)
    return float(found[1] or found[2]) if found else None


@dataclasses.dataclass
class Provider:
    """A named model: complete(prompt) gives text or raises. vision says whether it takes images."""

    name: str
    complete: Callable[[str], str]
    rpm: int = 0
    vision: bool = False


def null_provider() -> Provider:
    """Deterministic, offline: answers nothing."""
    return Provider("null", lambda prompt: "{}")


def call(providers: list[Provider], prompt: str, limiters: dict[str, RateLimiter], attempts: int = 3, cap: float = 70.0, vision: bool = False, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str]:
    """(provider, answer) of the first provider in order that answers; each is tried `attempts` times, with the wait its
    message asks for or 1, 2, 4, ... seconds, `cap` at most. Raises the last error if none does."""
    last: Exception | None = None
    for p in providers:
        if vision and not p.vision:
            continue
        for n in range(attempts):
            limiters.setdefault(p.name, RateLimiter(p.rpm)).acquire()
            try:
                return p.name, p.complete(prompt)
            except Exception as e:
                last = e
                sleep(min(cap, retry_after(str(e)) or 2.0**n))
    raise RuntimeError("no provider answered") from last


def prompt_key(provider: str, model: str, prompt: str):
    return F.sha2(F.concat(F.lit(f"{provider}|{model}|"), F.coalesce(F.col(prompt), F.lit(""))), 256)


def distinct_prompts(rows: DataFrame, prompt: str, provider: str, model: str) -> DataFrame:
    """prompt_key, prompt, calls: every distinct prompt once, counted before the shuffle."""
    return rows.groupBy(prompt_key(provider, model, prompt).alias("prompt_key")).agg(F.min(prompt).alias("prompt"), F.count("*").alias("calls"))


def share(rpm: int, tasks: int) -> RateLimiter:
    """A limiter for one of `tasks` tasks that together stay within rpm."""
    return RateLimiter(max(1, rpm // tasks), 60.0 * max(1.0, tasks / rpm)) if rpm > 0 else RateLimiter(0)


def complete(rows: DataFrame, prompt: str, providers: Callable[[], list[Provider]], provider: str, model: str, cache: DataFrame | None = None, tasks: int = 8) -> DataFrame:
    """rows with prompt_key and response. Prompts in cache(prompt_key, response) aren't asked again; the others are asked
    once each, by providers made on the executor. A prompt that no provider answers gets a null response.

    Answers are written to the shared folder, so what follows never asks again. `tasks` is how many tasks ask: together they
    keep to each provider's limit, of which each has its share.
    """
    keyed = rows.withColumn("prompt_key", prompt_key(provider, model, prompt))
    ask = distinct_prompts(rows, prompt, provider, model)
    if cache is not None:
        ask = ask.join(cache.select("prompt_key"), "prompt_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = providers()
        limiters = {p.name: share(p.rpm, tasks) for p in known}
        for batch in batches:
            out = []
            for p in batch["prompt"]:
                try:
                    out.append(call(known, p or "", limiters)[1])
                except RuntimeError:
                    out.append(None)
            yield pd.DataFrame({"prompt_key": batch["prompt_key"], "response": out})

    answers = tables.save(ask.select("prompt_key", "prompt").repartition(tasks, "prompt_key").mapInPandas(run, "prompt_key string, response string"), "answers")
    if cache is not None:
        answers = answers.unionByName(cache.select("prompt_key", "response"))
    return keyed.join(answers, "prompt_key", "left")


def build_prompt(task: str, instruction: str, *parts: tuple[str, str]):
    """A prompt column: the task's instruction and titled parts. Tasks: classify, extract, vision, infer, content, judge, conflict."""
    pieces = [F.lit(f"[{task}] {instruction}")]
    for title, column in parts:
        pieces += [F.lit(f"\n## {title}\n"), F.coalesce(F.col(column).cast("string"), F.lit(""))]
    return F.concat(*pieces)
