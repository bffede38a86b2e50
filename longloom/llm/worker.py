"""Helpers for code that runs in Python workers."""

from __future__ import annotations

import sys
from collections.abc import Callable


def kept(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task.

    Code that travels by value has new globals in every task; what is costly to build is kept in the interpreter.
    """
    store = sys.__dict__.setdefault("_longloom_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]
