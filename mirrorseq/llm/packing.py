"""Best-fit packing of tokenised documents by linear grouping."""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_key, number_within, part_digits, stored

CAPACITY, END = 1024, 2
#: Fixed value: the pattern by which byte-level BPE splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUPS, SMALL = 64, CAPACITY // 8


#: Runs of white space from here on go to the file's own engine, as the other
#: one backtracks over them on a stack of bounded depth.
LONG_RUN = 10_000


@functools.cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """The byte-level BPE of a tokenizers file, without special tokens at the ends.

    Ids of the vocabulary are the ranks of its merges, so tiktoken, which is
    five times as fast, gives the same ids.  The file's added tokens are ids of
    their own wherever their strings occur in a text, as the file has it.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {t["content"]: t["id"] for t in content["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in added and all(c in byte_of for c in token)}
    fast = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    own = Tokenizer.from_file(path)
    blank = re.compile(rf"\s{{{LONG_RUN}}}")
    names = set(added)

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and blank.search(text):
            return own.encode(text, add_special_tokens=False).ids
        if any(name in text for name in names):
            return fast.encode(text, allowed_special=names)
        return fast.encode_ordinary(text)

    return encode


def cuts(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but perhaps the first."""
    first = n % capacity or capacity
    yield 0, min(n, first)
    for start in range(first, n, capacity):
        yield start, capacity


_PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
_PIECE_IDS = T.StructType([*_PIECE.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) for each piece of each row."""

    @F.pandas_udf(T.ArrayType(_PIECE_IDS if with_ids else _PIECE))
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path)
        for texts in parts:
            rows = []
            for t in texts:
                ids = np.array([*encode(t or ""), END], dtype="<u4")
                rows.append([(i, s, n, zlib.crc32(ids[s : s + n].tobytes()), *([ids[s : s + n].astype(np.int32).tolist()] if with_ids else [])) for i, (s, n) in enumerate(cuts(len(ids), capacity))])
            yield pd.Series([[dict(zip((_PIECE_IDS if with_ids else _PIECE).names, r, strict=True)) for r in x] for x in rows])

    return df.select(F.col(id_col), F.explode(cut(F.col(text))).alias("p")).select(id_col, "p.*")


def _knapsack(values: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes that fits."""
    each = np.array(sizes)
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = room - each
        worth = np.where(fit >= 0, best[fit] + values, -1.0)  # a negative index is masked
        k = int(worth.argmax())
        best[room] = best[room - 1]
        if worth[k] > best[room] + 1e-12:
            best[room], choice[room] = worth[k], k
    counts, room = [0] * len(sizes), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int = CAPACITY, rounds: int = 400) -> list[tuple[list[int], float]]:
    """Fractional bins of few item sizes: (items of each size, bins).

    The configuration linear program by column generation (Gilmore & Gomory,
    1961): the basis starts from bins of one size; the knapsack over the dual
    prices names the bin that lowers the cost most, and it replaces the bin
    that runs out first.
    """
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        worth, column = _knapsack(np.maximum(price, 0), sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        amount = np.linalg.solve(basis, need)
        change = np.linalg.solve(basis, np.array(column, float))
        ratio = np.where(change > 1e-9, np.maximum(amount, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    amount = np.linalg.solve(basis, need)
    return [([int(x) for x in basis[:, j]], max(0.0, float(amount[j]))) for j in range(k)]


class _Bins:
    """Cohorts of bins of the same free room, in the order of their room."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.next, self.rows = capacity, 0, []
        self.rooms: dict[int, list[list[int]]] = {}  # free room: [first bin, bins]
        self.order: list[int] = []

    def add(self, first: int, count: int, room: int) -> None:
        if not count or not room:
            return
        if room not in self.rooms:
            self.rooms[room] = []
            bisect.insort(self.order, room)
        self.rooms[room].append([first, count])

    def put(self, length: int, rank: int, count: int) -> None:
        """Best fit of ``count`` items: each into the bin it fills best."""
        while count:
            at = bisect.bisect_left(self.order, length)
            if at == len(self.order):
                bins = -(-count // (self.capacity // length))
                self.add(self.next, bins, self.capacity)
                self.next += bins
                continue
            room = self.order[at]
            first, n = cohort = self.rooms[room][-1]
            used = min(n, count)
            self.rows.append((length, rank, rank + used, first, self.capacity - room))
            if used == n:
                self.rooms[room].pop()
                if not self.rooms[room]:
                    del self.rooms[room]
                    self.order.pop(at)
            else:
                cohort[:] = [first + used, n - used]
            self.add(first, used, room - length)
            rank, count = rank + used, count - used


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[tuple[int, int, int, int, int]]:
    """Where the items of each length go: (length, from rank, to rank, first bin, offset).

    counts: items by length.  The item of the length with rank r in
    [from, to) goes to bin first + r - from.

    Linear grouping (Fernandez de la Vega & Lueker, 1981): large items, in
    descending order, are dealt into groups of equal cardinality and rounded up
    to the longest of their group; the configuration program packs the few
    sizes that remain; its whole bins get actual documents, which are no
    longer than what they stand for.  What is left over, and then the small
    items in descending order, goes where it fits best.

    Works on the histogram of lengths alone, and its result has a bounded
    number of rows: neither depends on the number of documents.
    """
    bins = _Bins(capacity)
    used = dict.fromkeys(counts, 0)
    if counts.get(capacity):
        bins.put(capacity, 0, counts[capacity])
        used[capacity] = counts[capacity]
    large = sorted((n for n in counts if small < n < capacity and counts[n]), reverse=True)
    total = sum(counts[n] for n in large)
    if total:
        per = -(-total // groups)
        runs: list[list[list[int]]] = []  # by group: [length, items]
        left = 0
        for n in large:
            items = counts[n]
            while items:
                if not left:
                    runs.append([])
                    left = per
                take = min(items, left)
                runs[-1].append([n, take])
                items, left = items - take, left - take
        sizes = [r[0][0] for r in runs]
        # equal sizes in neighbouring groups are one size of the program
        merged: dict[int, list[list[int]]] = {}
        for size, run in zip(sizes, runs, strict=True):
            merged.setdefault(size, []).extend(run)
        sizes = list(merged)
        chosen = configurations(sizes, [sum(x[1] for x in merged[s]) for s in sizes], capacity)
        for column, amount in chosen:
            whole = int(amount + 1e-6)
            slots = [k for k, c in enumerate(column) for _ in range(c)]
            whole = min([whole, *(sum(x[1] for x in merged[sizes[k]]) // column[k] for k in set(slots))])
            if not whole or not slots:
                continue
            cohorts = [[bins.next, whole, 0]]  # first bin, bins, tokens so far
            bins.next += whole
            for k in slots:
                run, after = merged[sizes[k]], []
                for first, n, filled in cohorts:
                    while n:
                        length, items = run[-1] if run[-1][1] else (run.pop(), run[-1])[1]
                        take = min(n, items)
                        bins.rows.append((length, used[length], used[length] + take, first, filled))
                        used[length] += take
                        run[-1][1] -= take
                        after.append([first, take, filled + length])
                        first, n = first + take, n - take
                cohorts = after
            for first, n, filled in cohorts:
                bins.add(first, n, capacity - filled)
    for n in sorted(counts, reverse=True):
        if counts[n] > used[n]:
            bins.put(n, used[n], counts[n] - used[n])
    return bins.rows


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Packs all rows into sequences of at most ``capacity`` tokens.

    Returns (id, piece, start, length, ids_crc32, sequence_id, offset) for each
    piece.  Texts are tokenised once and never shuffled: what moves is a narrow
    row a piece, numbered among those of its length.  The plan is made on the
    driver from at most ``capacity`` counts, and its rows, bounded by lengths
    and groups, are broadcast.

    Defined results: null and empty texts give one piece with the end token;
    documents of more than ``capacity`` tokens are cut, the first piece being
    the shorter; repeated rows and ids are packed as often as they occur; an
    empty table gives no rows.  Runs of any length, of white space or of
    letters, are encoded whole.
    """
    spark = df.sparkSession
    cut = stored(pieces(df, path, id_col, text, capacity=capacity))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    schema = "plan_length long, lo long, hi long, first long, offset long"
    placed = spark.createDataFrame(pd.DataFrame(plan(counts, capacity), columns=["plan_length", "lo", "hi", "first", "offset"], dtype="int64"), schema)
    key = F.concat_ws(":", as_key(F.col(id_col)), F.col("piece").cast("string"))
    digits = part_digits(max(counts.values(), default=0))
    ranked = number_within(cut, ["length"], key, [id_col, "piece", "ids_crc32"], "rank", digits)
    fits = (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    out = ranked.join(F.broadcast(placed), fits)
    return out.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def sequences(df: DataFrame, packed: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the token ids of each packed sequence.

    ``id_col`` must be unique here; a sequence has at most ``capacity`` ids.
    """
    with_ids = pieces(df, path, id_col, text, True, capacity).select(id_col, "piece", "ids")
    joined = packed.join(with_ids, [id_col, "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
