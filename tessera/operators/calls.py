"""How a task calls its model: several calls in flight, a rate, retries by kind of error, and models kept by process."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd

#: A batch of prompts, and of system messages where given, to a batch of responses; made on the executor by a factory.
Model = Callable[..., pd.Series]
#: A response to what is kept of it, None where it can't be read.
Reader = Callable[[str], str | None]
#: What became of a question: its answer, which reader read it, and its error.
Said = tuple[str | None, int | None, str | None]
#: The questions of a call: an array for each of the model's arguments.
Part = list[np.ndarray]

# What the text of a server's error holds.
SERVER_ERRORS = ("500", "502", "503", "Internal Server Error")
UNREAD = "the response could not be read"


def transient(error: Exception) -> bool:
    """Whether the same call may succeed later: a lost connection, or an error of the server and not of the request."""
    if isinstance(error, (ConnectionError, TimeoutError)):
        return True
    status = getattr(error, "status_code", None)
    if isinstance(status, int):
        return 500 <= status < 600
    return any(x in str(error) for x in SERVER_ERRORS)


@dataclass(frozen=True)
class Calls:
    """The rules of one task's calls.

    ``attempts`` at a question, ``backoff`` seconds after the first failure and
    twice as many each time; only errors that ``retry`` accepts are tried again,
    and responses that no reader can read. ``in_flight`` calls at once, of
    ``size`` questions each (None: what a batch has, split evenly among them).
    At most ``rate`` calls a second begin, ``burst`` of them at once (rate 0: no
    limit); the bound holds for a task, see :meth:`shared`.
    """

    attempts: int = 3
    backoff: float = 0.0
    in_flight: int = 1
    size: int | None = None
    rate: float = 0.0
    burst: int = 1
    retry: Callable[[Exception], bool] = transient

    def __post_init__(self) -> None:
        if min(self.attempts, self.in_flight, self.burst) < 1 or (self.size is not None and self.size < 1) or min(self.rate, self.backoff) < 0:
            raise ValueError("calls need an attempt, a place in flight, a question each and no negative time")

    def shared(self, tasks: int) -> Calls:
        """The rules of each of ``tasks`` tasks at once that keep to this rate together."""
        return replace(self, rate=self.rate / tasks)


class Bucket:
    """Tokens that fill at ``rate`` a second up to ``burst``; who takes one that is not there yet waits for it."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.held, self.at, self.lock = float(burst), clock(), threading.Lock()

    def take(self) -> None:
        if not self.rate:
            return
        with self.lock:
            now = self.clock()
            self.held = min(self.burst, self.held + (now - self.at) * self.rate) - 1
            self.at = now
            wait = -self.held / self.rate
        if wait > 0:
            self.sleep(wait)


class Asker:
    """One task's model under its rules; answers come in the order of the questions."""

    def __init__(self, model: Model, calls: Calls, readers: Sequence[Reader] = ()) -> None:
        self.model, self.calls, self.readers = model, calls, readers
        self.bucket = Bucket(calls.rate, calls.burst)
        self.pool = ThreadPoolExecutor(calls.in_flight) if calls.in_flight > 1 else None

    def __enter__(self) -> Asker:
        return self

    def __exit__(self, *_: object) -> None:
        if self.pool:
            self.pool.shutdown(cancel_futures=True)

    def ask(self, asked: pd.DataFrame) -> list[Said]:
        columns = [asked[c].to_numpy(object) for c in asked.columns]
        size = self.calls.size or -(-len(asked) // self.calls.in_flight) or 1
        parts = [[c[i : i + size] for c in columns] for i in range(0, len(asked), size)]
        done: Iterator[list[Said]] = self.pool.map(self._together, parts) if self.pool else map(self._together, parts)
        return [x for part in done for x in part]

    def _call(self, part: Part) -> list[Said]:
        self.bucket.take()
        got = list(self.model(*(pd.Series(c, dtype=object) for c in part)))
        if len(got) != len(part[0]):
            raise ValueError(f"{len(got)} responses to {len(part[0])} questions")
        return [(None, None, None) if pd.isna(x) else self._read(str(x)) for x in got]

    def _read(self, text: str) -> Said:
        if not self.readers:
            return text, None, None
        for k, reader in enumerate(self.readers):
            if (kept := reader(text)) is not None:
                return kept, k, None
        return None, None, UNREAD

    def _together(self, part: Part) -> list[Said]:
        """A part in one call; where it fails each question alone, and alone those that could not be read."""
        one = lambda i: [c[i : i + 1] for c in part]
        if len(part[0]) == 1:
            return [self._alone(part, self.calls.attempts)]
        try:
            got = self._call(part)
        except Exception:  # noqa: BLE001  one bad question may have failed them all
            return [self._alone(one(i), self.calls.attempts) for i in range(len(part[0]))]
        more = self.calls.attempts - 1
        again = lambda i, x: self._alone(one(i), more) if more and self._unread(x) else x
        return [again(i, x) if self._unread(x) else x for i, x in enumerate(got)]

    def _unread(self, said: Said) -> bool:
        return bool(self.readers) and said[0] is None

    def _alone(self, one: Part, attempts: int) -> Said:
        for k in range(attempts):
            try:
                said = self._call(one)[0]
                if not self._unread(said):
                    return said
                error = UNREAD
            except Exception as failed:  # noqa: BLE001  isolate whatever the model raises
                error = str(failed)
                if not self.calls.retry(failed):
                    break
            if self.calls.backoff and k + 1 < attempts:
                time.sleep(self.calls.backoff * 2**k)
        return None, None, error


class Once:
    """A factory that makes its model once in a worker process and device, for all tasks that run there.

    At most ``capacity`` models are kept in a process; the one not asked for the
    longest goes first, by its ``close`` where it has one. Student and teacher of
    one name and device share a model.
    """

    made: OrderedDict[tuple[str, str], Model] = OrderedDict()
    lock = threading.Lock()

    def __init__(self, name: str, factory: Callable[[], Model], device: str = "", capacity: int = 2) -> None:
        self.name, self.factory, self.device, self.capacity = name, factory, device, capacity

    def __call__(self) -> Model:
        key = self.name, self.device
        with Once.lock:
            if key not in Once.made:
                while len(Once.made) >= self.capacity:
                    self._end(Once.made.popitem(last=False)[1])
                Once.made[key] = self.factory()
            Once.made.move_to_end(key)
            return Once.made[key]

    @staticmethod
    def clear() -> None:
        """Ends all models of this process."""
        with Once.lock:
            while Once.made:
                Once._end(Once.made.popitem()[1])

    @staticmethod
    def _end(model: Model) -> None:
        close = getattr(model, "close", None)
        if callable(close):
            close()
