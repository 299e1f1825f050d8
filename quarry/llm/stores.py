"""What Python workers keep of words and pieces they have met: bounded in bytes, all stores of a worker together.

A worker serves one stage after another, so a bound of each store's own would add up.
"""

from __future__ import annotations

import sys
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

#: Bytes of all stores of a worker, and characters of a text that is kept.
BUDGET, LONGEST = 64 << 20, 64
#: A dictionary's entry beside its key and value.
ENTRY = 104

_stores: list[weakref.ref] = []
_held, _room = 0, 0


class Store(dict):
    """What has been made since the last turn; `old` has what was made in the turn before, and goes with the next.

    A turn comes when half of the budget is full, so what is met again and again stays, and the rest goes.
    """

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}
        _stores.append(weakref.ref(self))

    def keep(self, key: str, value: Any, size: int) -> Any:
        """value, kept under a key that isn't too long; `size` is that of the value."""
        if len(key) <= LONGEST:
            charge(sys.getsizeof(key) + size + ENTRY)
            self[key] = value
        return value

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


def charge(size: int) -> None:
    """Count bytes that some store is about to hold."""
    global _held
    _held += size
    if _held > max(BUDGET, _room) // 2:
        _held = size
        alive = [s for r in _stores if (s := r()) is not None]
        _stores[:] = map(weakref.ref, alive)
        for s in alive:
            s.turn()


def held() -> int:
    """Bytes of the present turn."""
    return _held


@contextmanager
def room(size: int) -> Iterator[None]:
    """Within, a worker's stores may hold so much, if that is more than BUDGET; what is too much goes at the end."""
    global _room
    before, _room = _room, size
    try:
        yield
    finally:
        _room = before
        charge(0)
