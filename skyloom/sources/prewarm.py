"""Stars of coming batches, loaded into the storage of the executors while another batch runs, under a limit of bytes.

Loading is a persisted frame that a thread of the driver makes Spark fill; the driver holds no rows. A batch whose stars do not fit under the limit, with
what is held already, is read from the store when it begins, as without pre-warming. A block that is lost with its executor is read from the
store again. ``release`` frees a batch's stars, ``close`` all.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Lock

from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: Bytes of a stored star in Spark's columnar cache: eleven columns and the cell, without compression.
STAR_BYTES = 80


class PreWarm:
    def __init__(self, limit_bytes: int):
        self.limit, self.held, self.most = limit_bytes, 0, 0
        self.frames: dict[object, tuple[DataFrame, int, Future]] = {}
        self.loaded: list[object] = []
        self._lock, self._pool = Lock(), ThreadPoolExecutor(1)

    def ahead(self, name: object, n_bytes: int, make: Callable[[], DataFrame]) -> bool:
        """Begin to load what ``make`` gives, if it fits; whether it is (being) loaded."""
        with self._lock:
            if name in self.frames:
                return True
            if not 0 < n_bytes <= self.limit - self.held:
                return False
            self.held += n_bytes
            self.most = max(self.most, self.held)
            frame = make().persist(StorageLevel.MEMORY_AND_DISK)
            self.frames[name] = (frame, n_bytes, self._pool.submit(lambda: frame.write.format("noop").mode("overwrite").save()))
            self.loaded.append(name)
            return True

    def take(self, name: object, otherwise: DataFrame) -> DataFrame:
        """The loaded stars once they are there, or the frame that reads them from the store."""
        with self._lock:
            warm = self.frames.get(name)
        if warm is None or warm[2].exception() is not None:  # waits for the load; what failed is read when it is needed
            return otherwise
        return warm[0]

    def release(self, name: object) -> None:
        with self._lock:
            warm = self.frames.pop(name, None)
        if warm is not None:
            if not warm[2].cancel():
                warm[2].exception()
            warm[0].unpersist()
            with self._lock:
                self.held -= warm[1]

    def close(self) -> None:
        for name in list(self.frames):
            self.release(name)
        self._pool.shutdown()
