"""Per-task helpers for operators that work word by word in Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a memo, and what a word takes in it besides the letters of word and value: two objects, its slot, its mark in a set.
MEMO_BYTES, WORD_BYTES = 96 << 20, 140

#: What this worker keeps from task to task: one thing at a time, as workers outlive the stage that they were started for.
_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker keeps under ``key`` from task to task. Anything kept under another key is freed first."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Frees what this worker keeps, and gives the memory back."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another libc gives memory back in its own time
            pass


class Memo(dict):
    """Values of words, worked out for many missing words at once. Beyond a bound of bytes, words that came in one batch only go."""

    def __init__(self, work_out: Callable[[list[bytes]], Iterable], bound: int = MEMO_BYTES, slice_: int = 8_000):
        super().__init__()
        self.work_out, self.bound, self.slice, self.size = work_out, bound, slice_, 0
        self.again: set[bytes] = set()

    def learn(self, words: list[bytes]) -> None:
        every = set(words)
        known = every & self.keys()
        missing = list(every - known)
        self.again |= known
        if self.size > self.bound:
            kept = {w: self[w] for w in self.again}
            size = _size(kept)
            if size > self.bound // 2:
                kept = {w: self[w] for w in known}
                size = _size(kept)
            self.clear()
            self.update(kept)
            self.size, self.again = size, set()
        for at in range(0, len(missing), self.slice):
            part = missing[at : at + self.slice]
            new = dict(zip(part, self.work_out(part), strict=True))
            self.size += _size(new)
            self.update(new)


class Recent:
    """Values of distinct words, worked out for many missing words at once. Beyond a bound of bytes the half goes that hasn't come for
    longest."""

    def __init__(self, work_out: Callable[[list[bytes]], Iterable], bound: int = MEMO_BYTES, slice_: int = 8_000):
        self.work_out, self.bound, self.slice, self.size = work_out, bound, slice_, 0
        self.young: dict[bytes, Any] = {}
        self.old: dict[bytes, Any] = {}

    def get(self, word: bytes) -> Any:
        v = self.young.get(word)
        return self.old.get(word) if v is None else v

    def values(self, words: list[bytes]) -> list:
        found = list(map(self.young.get, words))
        new, missing = {}, []
        for i in [i for i, v in enumerate(found) if v is None]:
            w = words[i]
            v = self.old.get(w)
            if v is None:
                missing.append(i)
            else:
                found[i] = new[w] = v
        for at in range(0, len(missing), self.slice):
            part = missing[at : at + self.slice]
            own = [words[i] for i in part]
            for i, w, v in zip(part, own, self.work_out(own), strict=True):
                found[i] = new[w] = v
        self.size += _size(new)
        self.young.update(new)
        if self.size > self.bound // 2:
            self.young, self.old, self.size = {}, self.young, 0
        return found


def _size(values: dict[bytes, Any]) -> int:
    return sum(map(len, values)) + sum(map(len, values.values())) + WORD_BYTES * len(values)


def texts(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 512, octets: int = 2 << 20, keep: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Smaller batches of bounded bytes (one larger text is a batch of its own) with the texts (binary; null: empty) as bytes.

    Unless it is to ``keep`` it, frees what the worker kept of another operator.
    """
    if not keep:
        release()
    for batch in batches:
        at = 0
        col = batch.column(batch.schema.get_field_index(column))
        sizes = [len(v) if v is not None else 0 for v in (x.as_buffer() for x in col)] if len(col) else []
        while at < len(sizes):
            end, total = at + 1, sizes[at]
            while end < len(sizes) and end - at < rows and total + sizes[end] <= octets:
                total += sizes[end]
                end += 1
            part = batch.slice(at, end - at)
            yield part, [x or b"" for x in col.slice(at, end - at).to_pylist()]
            at = end


def rows_where(df: DataFrame, judge: Callable[[list[bytes]], tuple[list[bool], dict[str, list]]], text: str = "text", keep: bool = False) -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, by the bytes of their texts (null: empty), with the columns that it replaces.

    Rows pass through the task that reads them, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            columns = list(batch.columns)
            columns[at] = columns[at].cast(pa.binary())
            plain = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            first = 0
            for part, chunk in texts(iter([plain]), text, keep=keep):
                kept, new = judge(chunk)
                own = batch.slice(first, part.num_rows)
                first += part.num_rows
                cols = [pa.array(new[n], own.schema.field(i).type) if n in new else own.column(i) for i, n in enumerate(own.schema.names)]
                yield pa.RecordBatch.from_arrays(cols, names=own.schema.names).filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(run, df.schema)
