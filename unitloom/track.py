"""Wall-clock seconds and peak memory of the driver's Python process while a block runs."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass


@dataclass
class Usage:
    seconds: float = 0.0
    peak_mb: float = 0.0


def resident_mb() -> float:
    """0 where the system does not tell."""
    try:
        with open("/proc/self/status") as f:
            return next((int(line.split()[1]) / 1024 for line in f if line.startswith("VmRSS")), 0.0)
    except OSError:
        return 0.0


@contextmanager
def tracked(every: float = 0.1) -> Iterator[Usage]:
    usage, done, began = Usage(peak_mb=resident_mb()), threading.Event(), time.perf_counter()

    def poll() -> None:
        while not done.wait(every):
            usage.peak_mb = max(usage.peak_mb, resident_mb())

    thread = threading.Thread(target=poll, daemon=True)
    thread.start()
    try:
        yield usage
    finally:
        done.set()
        thread.join()
        usage.seconds, usage.peak_mb = time.perf_counter() - began, max(usage.peak_mb, resident_mb())
