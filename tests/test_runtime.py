import threading

import pytest

from skuforge.operators import runtime


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def test_limit_waits_for_the_window():
    c = Clock()
    limiter = runtime.RateLimiter(3, 60, c, c.sleep)
    assert [limiter.acquire() for _ in range(3)] == [0, 0, 0]
    assert limiter.acquire() == pytest.approx(60, abs=0.1)
    limiter.penalise(100)
    assert limiter.acquire() >= 99
    assert runtime.RateLimiter(0).acquire() == 0


def test_limiter_holds_over_threads():
    limiter, done = runtime.RateLimiter(50, 60, lambda: 0.0, lambda s: (_ for _ in ()).throw(TimeoutError())), []

    def work():
        try:
            limiter.acquire()
            done.append(1)
        except TimeoutError:
            pass

    threads = [threading.Thread(target=work) for _ in range(80)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(done) == 50


def test_retries_and_fall_through():
    waits, calls = [], []

    def busy(prompt):
        calls.append(prompt)
        raise ValueError("429: retry in 5.5s" if len(calls) < 2 else "down")

    got = runtime.call([runtime.Provider("a", busy), runtime.Provider("b", str.upper)], "x", {}, sleep=waits.append)
    assert got == ("b", "X") and waits == [5.5, 2.0, 4.0] and len(calls) == 3
    with pytest.raises(RuntimeError):
        runtime.call([runtime.Provider("a", busy)], "x", {}, attempts=1, sleep=waits.append)
    assert runtime.retry_after("retryDelay: '59s'") == 59 and runtime.retry_after("no") is None


def test_cache_spares_calls(spark):
    rows = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, None)], "id long, prompt string")
    first = runtime.complete(rows, "prompt", lambda: [runtime.Provider("s", lambda p: f"<{p}>")], "s", "m")
    assert {(r.id, r.response) for r in first.collect()} == {(1, "<p>"), (2, "<p>"), (3, "<q>"), (4, "<>")}
    cache = first.select("prompt_key", "response").distinct()

    def none():
        raise AssertionError

    again = runtime.complete(rows, "prompt", lambda: [runtime.Provider("s", lambda p: none())], "s", "m", cache)
    assert {(r.id, r.response) for r in again.collect()} == {(1, "<p>"), (2, "<p>"), (3, "<q>"), (4, "<>")}
