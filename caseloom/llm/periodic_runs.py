"""Runs of a repeated period in the word sequence of a text.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at
least ``least`` words and ``power`` periods. They are found on a harmonic grid: a run of period p
matches itself p words further on over at least (power - 1) p words, so one of the positions
0, g, 2g, ... with g = (power - 1) p lies in it, and how far the match reaches from there forwards
and backwards gives its ends. Over all periods these are n log n positions at most.

How far words i and j match (their longest common extension) is answered in two steps. The words
themselves are compared up to the first distance d at which i + d and j + d are both samples; a
difference cover modulo V guarantees one below V, and most pairs differ before. From there the
answer is the least common prefix between two places in the sorted order of the sampled suffixes,
a range minimum from a sparse table. Only the sampled suffixes are sorted, about a fifth of all,
by blocks of V words and then by doubling; a text in which no pair reaches its samples is never
sorted. Texts are worked on many at a time, each closed by a word of its own.

Nothing is shuffled: a text is worked on where it is read, in memory proportional to its words.
NULL, empty and blank texts have no words and no runs. Repeated rows give equal rows, and the
longest run is the one that starts first among equals, then the one of the smaller period. An
empty table gives an empty result. Texts are read whole, however long. Columns beside the id
and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POWER, LEAST = 4, 6
#: Words of texts that are worked on together, about.
WORDS = 1 << 17
#: Pairs that are compared at a time.
PAIRS = 1 << 20
#: Distances of any two numbers modulo V occur between two members of the cover.
V = 31
COVER = (1, 5, 11, 24, 25, 27)


def meeting_table(v: int = V, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """``[a, b]``: the least d with a + d and b + d both in the cover modulo v."""
    member = np.zeros(v, dtype=bool)
    member[list(cover)] = True
    a, b = np.meshgrid(np.arange(v), np.arange(v), indexing="ij")
    table = np.full((v, v), -1, dtype=np.int64)
    for d in range(v - 1, -1, -1):
        table[member[(a + d) % v] & member[(b + d) % v]] = d
    if (table < 0).any():
        raise ValueError("the members do not cover all differences")
    return table


class SampledSuffixes:
    """Common extensions of the suffixes that start at sampled positions of a word sequence."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        member = np.zeros(V, dtype=bool)
        member[list(COVER)] = True
        self.at = np.flatnonzero(member[np.arange(n) % V])
        number = np.full(n + V, -1, dtype=np.int64)
        number[self.at] = np.arange(len(self.at))
        self.number = number
        padded = np.concatenate([words.astype(">i4"), np.full(V, -1, dtype=">i4")])
        heads = np.lib.stride_tricks.sliding_window_view(padded, V)[self.at]
        heads = np.ascontiguousarray(heads).view(np.dtype((np.void, 4 * V))).reshape(-1)
        ranks = [np.unique(heads, return_inverse=True)[1].astype(np.int64)]
        width = V
        while width < n and ranks[-1].max(initial=0) + 1 < len(self.at):
            ranks.append(np.unique(ranks[-1] * (len(self.at) + 1) + self._later(ranks[-1], width), return_inverse=True)[1].astype(np.int64))
            width *= 2
        self.rank = ranks[-1]
        order = np.argsort(self.rank, kind="stable")
        a, b = self.at[order[:-1]].copy(), self.at[order[1:]].copy()
        common = np.zeros(len(a), dtype=np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            width = V << level
            both = (np.maximum(a, b) + common) < n
            i, j = self.number[np.where(both, a + common, 0)], self.number[np.where(both, b + common, 0)]
            same = both & (ranks[level][i] == ranks[level][j])
            common[same] += width
        for _ in range(V - 1):
            both = (np.maximum(a, b) + common) < n
            same = both & (words[np.where(both, a + common, 0)] == words[np.where(both, b + common, 0)])
            if not same.any():
                break
            # A word that differs ends the count for good.
            a, b = np.where(same, a, n), np.where(same, b, n)
            common[same] += 1
        self.least = [common]
        step = 1
        while 2 * step <= len(common):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def _later(self, rank: np.ndarray, width: int) -> np.ndarray:
        """Rank of the sample ``width`` words on, from 1; 0 beyond the end."""
        later = self.at + width
        inside = later < len(self.number) - V
        out = np.zeros(len(rank), dtype=np.int64)
        out[inside] = rank[self.number[later[inside]]] + 1
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at the sampled positions i and j (not equal) begin with."""
        a, b = self.rank[self.number[i]], self.rank[self.number[j]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for k in np.unique(level):
            mine = level == k
            row = self.least[k]
            out[mine] = np.minimum(row[low[mine]], row[high[mine] - (1 << int(k))])
        return out


class Extensions:
    """Longest common extensions to the right in a word sequence. Texts in it are closed by words
    of their own, so that no answer crosses the end of one."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.meeting = meeting_table()
        self._sorted: SampledSuffixes | None = None

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        reach = self.meeting[i % V, j % V]
        out = np.zeros(len(i), dtype=np.int64)
        left = np.arange(len(i))
        met = []
        for d in range(V):
            here = reach[left] == d
            met.append(left[here])
            left = left[~here]
            left = left[self.words[i[left] + d] == self.words[j[left] + d]]
            out[left] += 1
            if len(left) == 0:
                break
        met = np.concatenate(met)
        if len(met):
            if self._sorted is None:
                self._sorted = SampledSuffixes(self.words)
            out[met] += self._sorted.common(i[met] + reach[met], j[met] + reach[met])
        return out


@dataclass(frozen=True)
class Runs:
    """Runs by text, start and period, numbers of words from the beginning of the text."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def grid(starts: np.ndarray, sizes: np.ndarray, power: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of positions and their distance, ``PAIRS`` at a time or those of one period and text."""
    longest = sizes // power
    text = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(longest.sum()) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    step = (power - 1) * period
    many = -((period - sizes[text]) // step)  # positions k * step with k * step + period < size
    ends = np.cumsum(many)
    at = 0
    while at < len(period):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = many[at:end]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(period[at:end], n)
        i = np.repeat(starts[text[at:end]], n) + k * (power - 1) * p
        yield i, i + p, p
        at = end


def find_runs(texts: list[np.ndarray], power: int = POWER, least: int = LEAST) -> Runs:
    """Runs of texts given as word numbers from 0; equal numbers are equal words. ``power`` is 2 at
    least: below that a stretch can have two periods that don't divide one another."""
    if power < 2:
        raise ValueError("a run has two periods at least")
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    top = max((int(t.max()) for t in texts if len(t)), default=-1) + 1
    closes = np.arange(len(texts) + 1) + top
    words = np.empty(int(sizes.sum()) + len(texts) + 1, dtype=np.int32)
    words[0] = closes[0]
    for t, at, close in zip(texts, starts, closes[1:], strict=True):
        words[at : at + len(t)] = t
        words[at + len(t)] = close
    last = len(words) - 1
    forwards, backwards = Extensions(words), Extensions(np.ascontiguousarray(words[::-1]))
    found = []
    for i, j, p in grid(starts, sizes, power):
        same = words[i] == words[j]
        i, j, p = i[same], j[same], p[same]
        if len(i) == 0:
            continue
        ahead = forwards(i, j)
        # A run must match over (power - 1) p words; only backwards from here can the rest lie.
        before = backwards(last - i + 1, last - j + 1)
        size = before + ahead + p
        long = (size >= power * p) & (size >= least)
        found.append(np.stack([i[long] - before[long], size[long], p[long]]))
    start, size, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
    # A stretch found with several periods has the least of them, and all others are its multiples.
    order = np.lexsort((period, size, start))
    start, size, period = start[order], size[order], period[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(size) != 0)
    start, size, period = start[first], size[first], period[first]
    order = np.lexsort((period, start))
    start, size, period = start[order], size[order], period[order]
    text = np.searchsorted(starts, start, side="right") - 1
    return Runs(text, start - starts[text], size, period)


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which word stands at each place: every tenth id repeats a stretch of its words to the end."""
    places = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return places
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places[a:] = a + (places[a:] - a) % p
    return places


def _digests(words: list[list[bytes]], runs: Runs) -> list[tuple]:
    opens = np.searchsorted(runs.text, np.arange(len(words) + 1))
    rows = []
    for k, own in enumerate(words):
        start, length, period = (x[opens[k] : opens[k + 1]] for x in (runs.start, runs.length, runs.period))
        if len(start) == 0:
            rows.append((0, None, None, None, None, hashlib.sha256().hexdigest(), hashlib.sha256(b" ".join(own)).hexdigest()))
            continue
        edge = np.zeros(len(own) + 1, dtype=np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
        best = np.lexsort((period, start, -length))[0]
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
        size, q = int(length[best]), int(period[best])
        rows.append(
            (len(start), int(start[best]), size, q, 1000 * size // q, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(own[i] for i in kept)).hexdigest())
        )
    return rows


COLUMNS = (
    "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
)


def _batches(frames: Iterator[pa.RecordBatch], plant: bool) -> Iterator[tuple[pa.Array, list[list[bytes]], list[np.ndarray]]]:
    """Texts as words and word numbers, about ``WORDS`` words at a time."""
    for frame in frames:
        at, words, numbers, seen, size = 0, [], [], {}, 0
        for k, (key, body) in enumerate(zip(frame.column(0), frame.column(1), strict=True)):
            own = (body.as_py() or b"").split()  # bytes split at ASCII white space only
            coded = np.fromiter((seen.setdefault(w, len(seen)) for w in own), np.int32, len(own))
            if plant and len(own):
                places = planted(key.as_py(), len(own))
                coded, own = coded[places], [own[i] for i in places.tolist()]
            words.append(own)
            numbers.append(coded)
            size += len(own)
            if size >= WORDS:
                yield frame.column(0).slice(at, k + 1 - at), words, numbers
                at, words, numbers, seen, size = k + 1, [], [], {}, 0
        if words:
            yield frame.column(0).slice(at), words, numbers


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))


def digest_runs(docs: DataFrame, power: int = POWER, least: int = LEAST, plant: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of runs, the longest one, and digests of all runs and of the words that stay
    when every run is cut to its first period. With ``plant`` every tenth id (by checksum) is read
    with a stretch of its words repeated; a NULL id is not."""
    plain = _plain(docs, doc_id, text)
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, numbers in _batches(frames, plant):
            columns = list(zip(*_digests(words, find_runs(numbers, power, least)), strict=True))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *arrays], ["doc_id", *[c.split(" ")[0] for c in COLUMNS.split(", ")]])

    return plain.mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def list_runs(docs: DataFrame, power: int = POWER, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, length, period`` of every run."""
    plain = _plain(docs, doc_id, text)
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, numbers in _batches(frames, False):
            found = find_runs(numbers, power, least)
            arrays = [ids.take(pa.array(found.text)), *map(pa.array, (found.start, found.length, found.period))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "period"])

    return plain.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, period bigint")


def collapse_runs(docs: DataFrame, power: int = POWER, least: int = LEAST, text: str = "text") -> DataFrame:
    """The documents, each run cut to its first period. A text with runs becomes its words joined
    by one blank; a text without any, and NULL, stay as they are."""
    rows = docs.withColumn(text, F.col(text).cast("binary"))
    at = docs.columns.index(text)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            done = []
            for _, words, numbers in _batches(iter([pa.RecordBatch.from_arrays([frame.column(at)] * 2, ["key", "text"])]), False):
                found = find_runs(numbers, power, least)
                opens = np.searchsorted(found.text, np.arange(len(words) + 1))
                for k, own in enumerate(words):
                    mine = slice(opens[k], opens[k + 1])
                    if opens[k] == opens[k + 1]:
                        done.append(frame.column(at)[len(done)].as_py())
                        continue
                    edge = np.zeros(len(own) + 1, dtype=np.int64)
                    np.add.at(edge, found.start[mine] + found.period[mine], 1)
                    np.add.at(edge, found.start[mine] + found.length[mine], -1)
                    done.append(b" ".join(own[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)))
            yield frame.set_column(at, frame.schema.field(at), pa.array(done, frame.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema).withColumn(text, F.col(text).cast("string"))
