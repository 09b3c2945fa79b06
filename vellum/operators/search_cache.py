"""A cache of search results: looked up first, filled on a miss, valid for a while, emptied when documents change."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame


class SearchCache:
    """Results by query, filters and the caller's access groups. They are persisted on the executors, `most` of them at a time: the
    one unused for longest goes first. A result that has outlived `seconds` is made anew."""

    def __init__(self, seconds: float = 300, most: int = 100, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self.held: dict[str, tuple[float, DataFrame]] = {}

    @staticmethod
    def key(query: str, filters: dict, groups: set[str]) -> str:
        said = json.dumps([query, sorted((k, str(v)) for k, v in filters.items()), sorted(groups)])
        return "search:" + hashlib.sha256(said.encode()).hexdigest()

    def get(self, query: str, filters: dict, groups: set[str], search: Callable[[], DataFrame]) -> DataFrame:
        key = self.key(query, filters, groups)
        made, df = self.held.pop(key, (float("-inf"), None))
        if self.clock() - made > self.seconds:
            if df is not None:
                df.unpersist()
            made, df = self.clock(), search().persist()
        self.held[key] = made, df
        while len(self.held) > self.most:
            self.held.pop(next(iter(self.held)))[1].unpersist()
        return df

    def clear(self) -> None:
        """To be called when the index has changed."""
        for _, df in self.held.values():
            df.unpersist()
        self.held.clear()
