"""What a Python worker keeps from task to task: the tables of one operator at a time.

A worker serves all stages of a session, so whatever each operator keeps adds
up there. An operator that begins takes the place of the one before.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import Any

_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make() gave for key, made anew if another key's was kept meanwhile."""
    if key not in _kept:
        drop()
        _kept[key] = make()
    return _kept[key]


def drop() -> None:
    """Keeps nothing, and gives the freed memory back to the system where the C library can do that."""
    if _kept:
        _kept.clear()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
