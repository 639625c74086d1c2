"""Wall time and memory of named steps, for benches."""

from __future__ import annotations

import resource
import time
from collections.abc import Iterator
from contextlib import contextmanager


class Timer:
    """Times steps by name; a name that comes again is added up."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self.runs: dict[str, int] = {}

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - start
            self.runs[name] = self.runs.get(name, 0) + 1

    def report(self) -> list[tuple[str, int, float]]:
        """(name, runs, seconds), the slowest first."""
        return [(n, self.runs[n], s) for n, s in sorted(self.seconds.items(), key=lambda x: -x[1])]


def peak_memory_mb() -> float:
    """The most memory that this process, the driver's Python, has held."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
