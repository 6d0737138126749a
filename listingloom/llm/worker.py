"""Objects that a Python worker builds once and keeps for its later tasks."""

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable

import pyarrow as pa

_HOME = "listingloom_llm_worker"


def _home() -> types.ModuleType:
    home = sys.modules.get(_HOME)
    if home is None:
        home = sys.modules[_HOME] = types.ModuleType(_HOME)
        home.objects = {}
    return home


def kept(key: object, make: Callable[[], object]) -> object:
    """The object under this key, made on first use. Worker code travels by value, so plain globals would not outlive a task."""
    objects = _home().objects
    if key not in objects:
        objects[key] = make()
    return objects[key]


def released(*names: str) -> None:
    """Gives up what is kept under other names than these, and returns free memory to the system.

    Workers outlive a stage. Called at the start of a task, so that a stage does not also hold what an earlier one kept.
    """
    objects = _home().objects
    gone = [k for k in objects if (k[0] if isinstance(k, tuple) else k) not in names]
    for k in gone:
        del objects[k]
    if gone:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


class Memo(dict):
    """A dict that starts anew when it holds `limit` entries, so that it never grows beyond them.

    It only saves work: what it forgets is computed again.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def add(self, key, value):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class Generations(dict):
    """A memo of two generations: with `limit` entries it becomes the older one, which is asked before anything is computed again.

    So what comes up again and again is never forgotten, however many entries come up once. It holds 2 * `limit` at most.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def add(self, key, make):
        """The older generation's value, or else what make(key) returns, kept from now on."""
        value = self.older.get(key)
        if value is None:
            value = make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
