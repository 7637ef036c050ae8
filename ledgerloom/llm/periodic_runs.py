"""Periodic runs of words, caught online by dyadic squares.

Words are appended in order. Whenever a block of b = 1, 2, 4, ... words is complete, a catcher is set on it, which
watches the words at distances 2b to 4b - 1 (1 to 3 for single words) for the block's next occurrence. A repetition of
period p covers, at the level with 2b <= p < 4b, a known number of neighbouring blocks that all recur at distance p;
once the catchers of so many neighbours have met theirs, the words before and behind are compared at that distance as
far as they agree. That gives the maximal run, or, where it reaches the last word, an open one which the next words
carry on. Squares of one run, and of multiples of its period, merge into it.

Catchers compare fingerprints of blocks, all catchers of a level at once; every run is confirmed word by word, so equal
fingerprints of different words cost time only. A level's fingerprints are kept as far back as its catchers watch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


@dataclass(frozen=True)
class RunParams:
    least_exponent: int = 4  # length over period, 2 at least
    least_length: int = 6
    segment: int = 65_536  # words appended at once
    long_run: int = 256  # words from which a run is remembered to tell multiples of its period early


class SquareCatchers:
    """Online state over one sequence of words, given as integers that are equal where the words are."""

    def __init__(self, params: RunParams = RunParams()):
        self.params = params
        self.words = np.zeros(0, np.int64)
        self.levels: list[tuple[int, np.ndarray]] = []  # by level: place of the first fingerprint kept, fingerprints of all blocks that start from there
        self.watched: list[int] = []  # by level: number of blocks whose watch is over
        self.open: dict[tuple[int, int], int] = {}  # (start, period) of what reaches the last word -> its end
        self.closed: set[tuple[int, int, int]] = set()
        self.long: list[tuple[int, int, int]] = []

    def append(self, words: np.ndarray) -> None:
        self.words = np.concatenate([self.words, np.asarray(words, np.int64)])
        self._carry_on()
        level = 0
        while (2 << level if level else 1) * self.params.least_exponent <= len(self.words):
            self._advance(level)
            level += 1
        self._forget()

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, smallest period) of every run among the words so far, by start and period."""
        found = self.closed | {(start, end, period) for (start, period), end in self.open.items() if self._is_run(start, end, period)}
        least: dict[tuple[int, int], int] = {}
        for start, end, period in found:
            least[start, end] = min(period, least.get((start, end), period))
        return sorted((start, end - start, period) for (start, end), period in least.items())

    def _is_run(self, start: int, end: int, period: int) -> bool:
        return end - start >= max(self.params.least_length, self.params.least_exponent * period)

    def _keep(self, start: int, end: int, period: int) -> None:
        if end == len(self.words):
            self.open[start, period] = end
        elif self._is_run(start, end, period):
            self.closed.add((start, end, period))
        if end - start >= self.params.long_run:
            self.long.append((start, end, period))

    def _carry_on(self) -> None:
        """Open runs go on as far as the new words agree."""
        waiting, self.open = self.open, {}
        self.long = []
        for (start, period), end in waiting.items():
            self._keep(start, end + self._agree(end - period, period), period)

    def _agree(self, at: int, period: int) -> int:
        """How many words from at on are equal to those a period later."""
        n, step = 0, 64
        while at + period + n < len(self.words):
            later = self.words[at + period + n : at + period + n + step]
            differs = np.flatnonzero(self.words[at + n : at + n + len(later)] != later)
            if len(differs):
                return n + int(differs[0])
            n, step = n + len(later), step * 2
        return n

    def _agree_before(self, at: int, period: int) -> int:
        """How many words before at, backwards, are equal to those a period later."""
        n, step = 0, 64
        while at - n > 0:
            low = max(0, at - n - step)
            differs = np.flatnonzero(self.words[low : at - n] != self.words[low + period : at - n + period])
            if len(differs):
                return n + (at - n - low) - 1 - int(differs[-1])
            n, step = at - low, step * 2
        return n

    def _fingerprints(self, level: int) -> tuple[int, np.ndarray]:
        """Of all blocks of the level that start where fingerprints are kept, the new ones made from the level below."""
        n, b = len(self.words), 1 << level
        if level == len(self.levels):
            self.levels.append((0, np.zeros(0, np.uint64)))
            self.watched.append(0)
        first, known = self.levels[level]
        begin, end = first + len(known), n - b + 1
        if end <= begin:
            return first, known
        if level == 0:
            new = self.words[begin:end].astype(np.uint64) + np.uint64(1)
        else:
            below, prints = self.levels[level - 1]
            new = prints[begin - below : end - below] * np.uint64(0x9E3779B97F4A7C15) + prints[begin - below + b // 2 : end - below + b // 2]
        new = (new ^ (new >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return first, np.concatenate([known, new])

    def _advance(self, level: int) -> None:
        """All catchers of a level meet the new words."""
        b = 1 << level
        nearest, width = (1, 3) if level == 0 else (2 * b, 2 * b)
        neighbours = max(1, ((self.params.least_exponent - 1) * nearest - b + 1) // b)
        first, prints = self._fingerprints(level)
        low = max(0, self.watched[level] - neighbours + 1)  # neighbours of a catcher whose watch goes on count, too
        blocks = len(self.words) // b - low
        if blocks >= neighbours:
            padded = np.zeros(blocks * b + nearest + width, np.uint64)  # no words yet: nothing recurs there
            padded[: len(prints) - (low * b - first)] = prints[low * b - first :][: len(padded)]
            ahead = np.lib.stride_tricks.as_strided(padded[nearest:], (blocks, width), (b * 8, 8), writeable=False)
            met = ahead == padded[: blocks * b : b, None]
            if met.any():
                self._extend(met, low, b, nearest, neighbours)
        self.watched[level] = max(0, (len(self.words) - nearest - width - b) // b)
        self.levels[level] = (first, prints)

    def _forget(self) -> None:
        """Fingerprints behind every watch go; those that the level above still needs, and all of the top level, stay."""
        for level, (first, prints) in enumerate(self.levels[:-1]):
            b, nearest = 1 << level, 2 << level if level else 1
            neighbours = max(1, ((self.params.least_exponent - 1) * nearest - b + 1) // b)
            kept = min((self.watched[level] - neighbours + 1) * b, len(self.words) - 2 * b)
            if kept > first:
                self.levels[level] = (kept, prints[kept - first :])

    def _extend(self, met: np.ndarray, low: int, b: int, nearest: int, neighbours: int) -> None:
        streak, n = met, 1
        while n < neighbours:
            step = min(n, neighbours - n)
            streak = streak[: len(streak) - step] & streak[step:]
            n += step
        begins = streak.copy()
        begins[1:] &= ~streak[:-1]
        for row, column in zip(*np.nonzero(begins)):
            at, period = (low + int(row)) * b, nearest + int(column)
            if any(period % q == 0 and start <= at and at + neighbours * b + period <= end for start, end, q in self.long):
                continue
            ahead = self._agree(at, period)
            if ahead:
                self._keep(at - self._agree_before(at, period), at + ahead + period, period)


def word_runs(words: list, params: RunParams = RunParams()) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of words."""
    catchers, ids = SquareCatchers(params), {}
    for i in range(0, len(words), params.segment):
        catchers.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words[i : i + params.segment]), np.int64))
    return catchers.runs()


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, params: RunParams = RunParams(), text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """docs with the runs of each whole text, by start and period, and the text without the repeats.

    Words are what spaces and the control characters 9 to 13 divide; the collapsed text joins the kept ones by one
    space. Null, empty and blank texts have no runs and an empty collapsed text. Rows are taken one by one, so equal
    texts get equal results, null and repeated ids change nothing, and no rows give no rows. Columns of docs with the
    new names are replaced. A very long text is appended in segments; its words are in one task, as it is one value.
    """
    docs = docs.drop(runs, collapsed)
    schema = extended(docs, f"`{runs}` {RUNS}, `{collapsed}` string")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        kind = out.field(runs).type
        for batch in batches:
            found, kept = [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                words = (value.as_py() or "").encode().split()  # of bytes, split() takes just these six
                own = word_runs(words, params)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                kept.append(b" ".join(collapse(words, own)).decode())
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, out)), pa.array(found, kind), pa.array(kept, pa.string())], schema=out)

    return docs.mapInArrow(search, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of them in a list by start and period. Null if there is none."""
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.element_at(runs, 1), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)))
