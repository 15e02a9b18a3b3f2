"""Best-fit packing of token sequences by patterns.

Documents become token ids, and only those beyond the sequence length are cut. The number
of pieces of each length is a histogram with at most ``limit`` bins, whatever the corpus;
everything is planned on it. Patterns are sets of few lengths that fill a sequence; how
often each is used is fitted to the histogram by non-negative least squares and rounded
down, and the residual counts are packed best fit decreasing, still as counts. The plan
says which ranks of each length go where; a piece finds its place by its rank among the
pieces of its length, from counts per (length, hash range) and an order within each. A
length held by a third of all pieces is thus ranked in many tasks.

Ids are put together from those of words where the tokenizer's own description says that its
tokens do not span words; otherwise texts are encoded whole.

NULL and empty texts are a lone end id. Repeated rows are packed as often as they occur.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import whole
from caseloom.sources.sinks import write_stage

LIMIT = 4096
END_ID = 1
ROWS_PER_RANGE = 1000
#: Bytes that a task spends on remembered parts of words; beyond it the older half goes.
MEMORY_BYTES = 64 << 20
#: Letters that lower-case one by one and never combine, marks that never join letters, and spaces.
_LETTERS, _MARKS, _SPACES = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r".,;:!?#*$%&|<>()-", r" \t\n\x0b\x0c\r"
_PLAIN = re.compile(f"[{_LETTERS}{_SPACES}{_MARKS}]*")
_PART = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+")
_WORD = re.compile(f"[^{_SPACES}]+")

# The steps of a tokenizer whose ids of a text are those of its words.
WORD_STEPS = {
    "normalizer": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_at_words(described: str) -> bool:
    """Whether a tokenizer, given as its JSON, lower-cases, splits at white space and between
    letters and marks, and has no added token that reaches over a blank."""
    found = json.loads(described)
    steps = {
        "normalizer": (found.get("normalizer") or {}).get("normalizers"),
        "pretokenizers": (found.get("pre_tokenizer") or {}).get("pretokenizers"),
    }
    added = found.get("added_tokens") or []
    alone = all(t["content"].split() == [t["content"]] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
    return steps == WORD_STEPS and found["model"]["type"] == "BPE" and not found.get("post_processor") and alone


class Memory(dict):
    """Ids by word. A full memory keeps what was met last, so that it stays bounded in bytes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.size = limit, 0

    def put(self, word: str, ids: bytes) -> bytes:
        cost = 110 + sys.getsizeof(word) + sys.getsizeof(ids)
        if self.size + cost > self.limit:
            for old in list(islice(self, (len(self) + 1) // 2)):
                self.size -= 110 + sys.getsizeof(old) + sys.getsizeof(self[old])
                del self[old]
        if cost <= self.limit // 4:
            self.size += cost
            self[word] = ids
        return ids


def encoded(tokenizer, text: str) -> bytes:
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


class WholeIds:
    """Token ids of texts as little-endian bytes, each text encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def of(self, text: str) -> bytes:
        return encoded(self.tokenizer, text)


class WordIds(Memory):
    """The same for a tokenizer of :data:`WORD_STEPS`: no token spans two words, nor letters and
    marks, so the ids of plain text are those of its runs of letters and of marks. Remembers ids by
    such run; words of other characters are encoded whole, with a memory of their own."""

    def __init__(self, path: str, limit: int = MEMORY_BYTES):
        super().__init__(limit)
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model  # reads ASCII as it is
        # For runs beyond ASCII, in lower case: the same merges without the regular expressions.
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.odd = Memory(limit // 4)

    def __missing__(self, part: str) -> bytes:
        if part.isascii():
            ids = [t.id for t in self.model.tokenize(part)]
            return self.put(part, struct.pack(f"<{len(ids)}I", *ids))
        return self.put(part, encoded(self.bare, part))

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _PART.findall(text.lower())))

    def word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:  # signs that may name an added token
            return self.plain(word)
        found = self.odd.get(word)
        return self.odd.put(word, encoded(self.tokenizer, word)) if found is None else found

    def of(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self.plain(text)
        return b"".join(map(self.word, _WORD.findall(text)))


#: Encoders by tokenizer path, kept by the Python worker from task to task, so that the runs one
#: task has met are not encoded again by the next; each memory stays bounded in bytes.
_ENCODERS: dict[str, WordIds | WholeIds] = {}


def task_ids(path: str) -> WordIds | WholeIds:
    """What a task encodes with; a worker that Spark reuses keeps it for its next tasks."""
    found = _ENCODERS.get(path)
    if found is None:
        with open(path, encoding="utf-8") as described:
            by_words = splits_at_words(described.read())
        found = _ENCODERS[path] = WordIds(path) if by_words else WholeIds(path)
    return found


def tokenize(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, little-endian bytes)."""
    end, width = np.asarray([end_id], dtype="<u4").tobytes(), 4 * limit
    plain = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = task_ids(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for k, body in enumerate(batch.column(1)):  # one text at a time as a string
                ids = words.of(body.as_py()) + end
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((k, n, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ()))
            if rows:
                k, *columns = zip(*rows, strict=True)
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k, pa.int32())), *arrays], names)

    return plain.mapInArrow(pieces, schema)


@dataclass
class Plan:
    """For each length, which ranks go where: rank r with ``first <= r < first + count`` sits
    in sequence ``sequence + r - first`` at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def candidate_patterns(histogram: np.ndarray, limit: int, per_length: int = 6) -> list[tuple[int, ...]]:
    """Patterns of one to four lengths. Full ones are paired directly; longer ones take the
    most frequent lengths that leave an existing remainder."""
    present = np.flatnonzero(histogram)
    there = histogram > 0
    common = present[np.argsort(-histogram[present], kind="stable")][: 16 * per_length]
    found: dict[tuple[int, ...], None] = {}

    def best_below(room: int) -> int:
        at = np.searchsorted(present, room, side="right")
        return int(present[at - 1]) if at else 0

    for big in present[::-1].tolist():
        found[(big,)] = None
        rest = limit - big
        if rest <= 0:
            continue
        if second := best_below(rest):
            found[tuple(sorted((big, second), reverse=True))] = None
        taken = 0
        for second in common.tolist():
            room = rest - second
            if room > 0 and (third := best_below(room)) and (there[room] or taken < 2):
                found[tuple(sorted((big, second, third), reverse=True))] = None
                taken += 1
                if (left := room - third) and (fourth := best_below(left)):
                    found[tuple(sorted((big, second, third, fourth), reverse=True))] = None
            if taken >= per_length:
                break
        for parts in (2, 3, 4):
            if big * parts <= limit < big * (parts + 1):
                found[(big,) * parts] = None
    return list(found)


def fit_repeats(histogram: np.ndarray, patterns: list[tuple[int, ...]], limit: int, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeats x that minimise |A x - histogram| with a small
    price on unfilled room, by projected accelerated gradient steps."""
    rows = np.concatenate([np.asarray(p) for p in patterns])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    unfilled = np.array([1 - sum(p) / limit for p in patterns])
    scale = max(1.0, float(histogram.max()))
    goal = histogram / scale
    uses = np.bincount(rows, minlength=len(goal))
    widest = np.bincount(cols, weights=uses[rows].astype(float), minlength=len(patterns))
    step = 1.0 / max(1.0, widest.max())
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        miss = np.bincount(rows, weights=y[cols], minlength=len(goal)) - goal
        slope = np.bincount(cols, weights=miss[rows], minlength=len(patterns)) + 0.02 * unfilled
        new = np.maximum(0.0, y - step * slope)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return np.maximum(0.0, x) * scale


def plan_packing(histogram: np.ndarray, limit: int = LIMIT) -> Plan:
    """``histogram[l]`` is the number of pieces of length l. Work is bounded by the number of
    different lengths, not by their counts."""
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(pattern: tuple[int, ...], repeats: int) -> None:
        nonlocal sequences
        offset = 0
        for length in pattern:
            rows.append((length, int(used[length]), repeats, sequences, offset))
            used[length] += repeats
            left[length] -= repeats
            offset += length
        sequences += repeats

    def fits(pattern: tuple[int, ...]) -> int:
        return min(int(left[n]) // pattern.count(n) for n in set(pattern))

    if left.sum():
        if left[limit]:
            place((limit,), int(left[limit]))
        patterns = [p for p in candidate_patterns(left, limit) if sum(p) > 0.97 * limit]
        if patterns:
            repeats = np.floor(fit_repeats(left, patterns, limit)).astype(np.int64)
            for i in sorted(range(len(patterns)), key=lambda i: (-sum(patterns[i]), len(patterns[i]))):
                if n := min(int(repeats[i]), fits(patterns[i])):
                    place(patterns[i], n)
        # Residuals, best fit decreasing on counts: the longest piece left, then always the
        # longest that still fits, repeated while the counts allow the same pattern.
        while left.any():
            present = np.flatnonzero(left)
            room, chosen = limit, []
            taken: dict[int, int] = {}
            while room:
                at = int(np.searchsorted(present, room, side="right")) - 1
                while at >= 0 and left[present[at]] <= taken.get(int(present[at]), 0):
                    at -= 1
                if at < 0:
                    break
                length = int(present[at])
                chosen.append(length)
                taken[length] = taken.get(length, 0) + 1
                room -= length
            place(tuple(chosen), fits(tuple(chosen)))
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return Plan(*table.T, sequences)


def _range(df: DataFrame, ranges: Column) -> Column:
    """A range by hash of the piece, and of the ``spot`` where it was written if it has one, so that
    rows that are repeated very often are spread too."""
    spot = ["spot"] if "spot" in df.columns else []
    return F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", *spot), ranges)


def ranked(pieces: DataFrame, counts: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``rank``, from 0 within each length."""
    spread = counts.select("length", F.ceil(F.col("n") / rows_per_range).alias("ranges"))
    placed = pieces.join(F.broadcast(spread), "length")  # one row per length, at most the limit
    placed = placed.withColumn("range", _range(placed, F.col("ranges"))).drop("ranges")
    sums = placed.groupBy("length", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = Window.partitionBy("length", "range").orderBy("doc_id", "piece", "ids_crc32")
    inside = placed.withColumn("at", F.row_number().over(order) - 1)
    return inside.join(starts, ["length", "range"]).withColumn("rank", F.col("base") + F.col("at")).drop("base", "at", "range")


def assign(pieces: DataFrame, limit: int = LIMIT, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``doc_id, piece, start, length, ids_crc32`` (a written
    table, with or without a ``spot`` that tells equal rows apart)."""
    counts = write_stage(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(limit + 1, dtype=np.int64)
    for row in counts.collect():  # at most one row per length
        histogram[row["length"]] = row["n"]
    plan = plan_packing(histogram, limit)
    order = np.lexsort((plan.first, plan.length)) if plan.sequences else np.zeros(0, dtype=int)
    length, first = plan.length[order], plan.first[order]
    sequence, offset = plan.sequence[order], plan.offset[order]
    opens = np.searchsorted(length, np.arange(limit + 2)) if plan.sequences else np.zeros(limit + 2, dtype=int)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        at, size = np.zeros(len(lengths), dtype=np.int64), lengths.to_numpy()
        rank = ranks.to_numpy()
        for n in np.unique(size):
            mine = size == n
            lo, hi = opens[n], opens[n + 1]
            at[mine] = lo + np.searchsorted(first[lo:hi], rank[mine], side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank - first[at], "offset": offset[at]})

    out = ranked(pieces, counts, rows_per_range).withColumn("place", place("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = tokenize(docs, tokenizer, limit, end_id, doc_id, text).withColumn("spot", F.monotonically_increasing_id())
    return assign(write_stage(pieces, "pieces"), limit)
