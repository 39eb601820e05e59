"""What a worker process remembers between tasks: one thing at a time, and only while its tasks come.

Workers go on from one operator's stages to another's. Two operators' words at once, or
freed memory that the allocator keeps, are what the later stage then lacks.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
from collections.abc import Callable, Hashable

import pyarrow as pa

_HELD: dict[Hashable, object] = {}
_IDLE: list[threading.Timer] = []
#: Seconds after which a worker process without such tasks forgets.
IDLE = 5.0


def forget() -> None:
    """Nothing is held, and what was goes back to the system."""
    if not _HELD:
        return
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def remembered(key: Hashable, make: Callable[[], object]):
    """What ``make`` made for ``key`` in an earlier task, or makes now. Anything else is forgotten."""
    while _IDLE:
        _IDLE.pop().cancel()
    if (held := _HELD.get(key)) is None:
        forget()
        held = _HELD[key] = make()
    return held


def rest() -> None:
    """A task ends."""
    timer = threading.Timer(IDLE, forget)
    timer.daemon = True
    timer.start()
    _IDLE.append(timer)
