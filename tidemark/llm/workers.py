"""What a Python worker keeps between its tasks."""

from __future__ import annotations

import sys
import types


def kept(key, make):
    """``make()`` once per worker process; later tasks of the worker get the same object."""
    store = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
