"""Substring dedup: MinHash banding of paragraphs, verified and clustered."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored
from .components import HOT, components

SHINGLE, SIMILAR = 5, 0.8
#: A paragraph has 6 to 64 words and ends where the hash of two words says so,
#: once in 8 places: 13 words on average, at the same places in every copy.
LEAST, MOST, ENDS = 6, 64, 8
#: Share of the pairs at the least similarity that shall share a band.
RECALL = 0.95


def n_bands(similar: float = SIMILAR, recall: float = RECALL, rows: int = 1) -> int:
    """Bands of ``rows`` MinHashes that let a pair of the similarity meet with
    probability 1 - (1 - similar ** rows) ** bands >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similar**rows))


#: Short paragraphs have few shingles, so a band is one MinHash: two bands.
BANDS = n_bands()
#: Repeated paragraphs in a row with at least so many words are a passage.
PASSAGE = 24
#: Any window of 51 equal words holds an anchor: of 28 runs of 24 words in a row
#: the one with the least hash.
WINDOW, ANCHOR = 51, 24
#: Narrow rows of one window that a task sorts and spills.
IN_ONE_TASK = 1_000_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


_MINS = [f"m{b}" for b in range(BANDS)]


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[k % 5]
    x = (x ^ (x >> np.uint64(29))) * _MIX[(k + 2) % 5]
    return x ^ (x >> np.uint64(32))


def _hashed(text: str | None) -> np.ndarray:
    found = _words(text)
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


class _Hashes(dict):
    """Hash of each word, kept for the words of the texts to come."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def split(text: str | None) -> np.ndarray:
    """(first word, words, hash, MinHash 0, MinHash 1) of each paragraph, as the
    rows of an integer array.

    Words are compared in ASCII lower case.  Paragraph ends depend on the words
    around them alone and not on lines, so a passage that was copied into the
    middle of a line has the same paragraphs as its source.
    """
    return _split(_hashed(text))


def _split(hashed: np.ndarray) -> np.ndarray:
    return _split_all([hashed])[1]


def _split_all(hashed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of paragraphs of each text, and those of all as the rows of an
    integer array; arrays of many texts at once cost less than many small ones."""
    words = np.concatenate([*hashed, np.zeros(0, np.uint64)])
    begins = np.cumsum([0, *map(len, hashed)])
    n = len(words)
    if not n:
        return np.zeros(len(hashed), np.int64), np.zeros((0, 3 + BANDS), np.int64)
    pairs = _mixed(words[:-1] * _MIX[0] + words[1:] * _MIX[1], 3)
    ends = np.flatnonzero(pairs % np.uint64(ENDS) == 0) + 1
    bounds = zip(begins[:-1].tolist(), begins[1:].tolist(), np.searchsorted(ends, begins[:-1], "right").tolist(), np.searchsorted(ends, begins[1:], "left").tolist(), strict=True)
    ends = ends.tolist()
    starts, counts = [], []
    for last, end, lo, hi in bounds:
        before = len(starts)
        if last < end:
            starts.append(last)
            for e in [*ends[lo:hi], end]:
                while e - last > MOST:
                    last += MOST
                    starts.append(last)
                if LEAST <= e - last and e < end:
                    last = e
                    starts.append(last)
        counts.append(len(starts) - before)
    at = np.array(starts)
    size = np.diff(np.append(at, n))
    place = (np.arange(n) - np.repeat(at, size)).astype(np.uint64)
    out = np.empty((len(at), 2 + 1 + BANDS), np.int64)
    out[:, 0], out[:, 1] = at - np.repeat(begins[:-1], counts), size
    # a sum of the mixed (word, place) pairs; the length is part of the hash
    sums = np.add.reduceat(_mixed(words + place * _MIX[4], 1), at)
    out[:, 2] = _mixed(sums + size.astype(np.uint64) * _MIX[2], 0).view(np.int64)
    grams = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, n)):
        grams[: n - k] += words[k:] * _MIX[k]
    inside = place + np.uint64(SHINGLE) <= np.repeat(size, size).astype(np.uint64)
    for b in range(BANDS):
        least = np.minimum.reduceat(np.where(inside, _mixed(grams, b), np.uint64(2**64 - 1)), at)
        out[:, 3 + b] = np.where(size >= SHINGLE, least.view(np.int64), out[:, 2])
    return np.array(counts), out


_PARAGRAPH = {"at": pa.int32(), "n": pa.int32(), "h": pa.int64(), **{m: pa.int64() for m in _MINS}}
_PLACE = {"at": pa.int32(), "w": pa.int64()}


def _lists(counts: np.ndarray | list[int], flat: np.ndarray, fields: dict[str, pa.DataType]) -> pa.ListArray:
    """Lists of structs, each of the next ``counts`` rows of integers."""
    ends = np.cumsum([0, *counts]).astype(np.int32)
    columns = [pa.array(flat[:, i]).cast(kind) for i, kind in enumerate(fields.values())]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, list(fields)))


def _structs(fields: dict[str, pa.DataType]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(c, T.IntegerType() if kind == pa.int32() else T.LongType()) for c, kind in fields.items()]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            yield batch.slice(lo, 500)


def _scanned(docs: DataFrame) -> DataFrame:
    """(id, th, n_words, paragraphs, anchors) of each row (id, th, text); rows
    without an id have words but no paragraphs and no anchors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in _chunks(batches):
            hashed = [_hashed(t) for t in few.column("text").to_pylist()]
            used = [h if known else h[:0] for h, known in zip(hashed, few.column("id").is_valid().to_pylist(), strict=True)]
            columns = [few.column("id"), few.column("th"), pa.array([len(h) for h in hashed], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, _lists(*_split_all(used), _PARAGRAPH), _lists(*_anchors_all(used), _PLACE)],
                ["id", "th", "n_words", "paragraphs", "anchors"],
            )

    fields = [docs.schema["id"], docs.schema["th"], T.StructField("n_words", T.LongType()), T.StructField("paragraphs", _structs(_PARAGRAPH)), T.StructField("anchors", _structs(_PLACE))]
    return docs.select("id", "th", "text").mapInArrow(rows, T.StructType(fields))


def _texts_column(text: str, places: str):
    """The words of the paragraphs at the given (at, n, h)."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("words", T.StringType())])))
    def of(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        rows = []
        for t, places in zip(texts, wanted, strict=True):
            found = _words(t)
            rows.append([{"h": p["h"], "words": b" ".join(found[p["at"] : p["at"] + p["n"]]).decode("utf-8", "replace")} for p in places])
        return pd.Series(rows, dtype=object)

    return of(F.col(text), F.col(places))


def _grams(c: str):
    w = F.split(F.col(c), " ")
    n = F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")))


def _jaccard(a: str, b: str):
    both = F.size(F.array_intersect(_grams(a), _grams(b)))
    return both / (F.size(_grams(a)) + F.size(_grams(b)) - both)


def _runs(hashed: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each run of ``size`` words."""
    if len(hashed) < size:
        return np.zeros(0, np.uint64)
    base = int(_MIX[0])
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(hashed) - 1, base, np.uint64))), dtype=np.uint64)
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(hashed) - size, pow(base, -1, 2**64), np.uint64))), dtype=np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashed * power, dtype=np.uint64)))
    return _mixed((sums[size:] - sums[:-size]) * back, 2)


def anchors(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the anchors of a text."""
    at, hashes = _anchors(_hashed(text)).T
    return at, hashes


def _anchors(hashed: np.ndarray) -> np.ndarray:
    grams = _runs(hashed, ANCHOR)
    width = WINDOW - ANCHOR + 1
    if len(grams) < width:
        return np.zeros((0, 2), np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    at = np.unique(views.argmin(1) + np.arange(len(views)))
    return np.stack([at, grams[at].view(np.int64)], 1)


def _slid(values: np.ndarray, width: int, least_or_most: np.ufunc) -> np.ndarray:
    """The least or most of each ``width`` values in a row."""
    size = 1
    while 2 * size <= width:
        values = least_or_most(values[:-size], values[size:])
        size *= 2
    return least_or_most(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def _anchors_all(hashed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of anchors of each text, and those of all as :func:`_anchors` has
    them.

    A run is an anchor if it is the least of a window that holds it, that is,
    if it equals the most of the leasts of these windows.  Where equal runs
    meet in a window, the text is done by :func:`_anchors`, which takes the first.
    """
    words = np.concatenate([*hashed, np.zeros(0, np.uint64)])
    sizes = np.fromiter(map(len, hashed), np.int64, len(hashed))
    begins = np.cumsum(sizes) - sizes
    grams = _runs(words, ANCHOR)
    width = WINDOW - ANCHOR + 1
    if len(grams) < width:
        return np.zeros(len(hashed), np.int64), np.zeros((0, 2), np.int64)
    here, end = np.arange(len(grams)), np.repeat(begins + sizes, sizes)[: len(grams)]
    least = _slid(grams, width, np.minimum)
    whole = here[: len(least)] + WINDOW <= end[: len(least)]
    edge = np.zeros(width - 1, np.uint64)
    most = _slid(np.concatenate([edge, np.where(whole, least, np.uint64(0)), edge]), width, np.maximum)
    held = (here + ANCHOR <= end) & np.repeat(sizes >= WINDOW, sizes)[: len(grams)]
    at = np.flatnonzero((most == grams) & held)
    text = np.searchsorted(begins, at, "right") - 1
    again = np.unique(text[1:][(np.diff(at) < width) & (np.diff(text) == 0) & (grams[at[1:]] == grams[at[:-1]])])
    if len(again):
        one_by_one = [begins[t] + _anchors(hashed[t])[:, 0] for t in again.tolist()]
        at = np.sort(np.concatenate([at[~np.isin(text, again)], *one_by_one]))
        text = np.searchsorted(begins, at, "right") - 1
    return np.bincount(text, minlength=len(hashed)), np.stack([at - begins[text], grams[at].view(np.int64)], 1)


def windows(text: str | None, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the windows that hold an anchor at the places."""
    found = _runs(_hashed(text), WINDOW)
    at = np.unique(np.asarray(places, np.int64)[:, None] - np.arange(WINDOW - ANCHOR + 1))
    at = at[(at >= 0) & (at < len(found))]
    return at, found[at].view(np.int64)


def _around(docs: DataFrame) -> DataFrame:
    """(id, th, windows) of the rows (id, th, text, places)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in _chunks(batches):
            found = [np.stack(windows(t, p), 1) for t, p in zip(few.column("text").to_pylist(), few.column("places").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([few.column("id"), few.column("th"), _lists([len(f) for f in found], np.concatenate(found), _PLACE)], ["id", "th", "windows"])

    fields = [docs.schema["id"], docs.schema["th"], T.StructField("windows", _structs(_PLACE))]
    return docs.select("id", "th", "text", "places").mapInArrow(rows, T.StructType(fields))


def _shared(rows: DataFrame) -> DataFrame:
    """(w, keeper, rows) of the hashes that occur in several ids."""
    ends = rows.groupBy("w").agg(F.min("id").alias("keeper"), F.max("id").alias("latest"), F.count("*").alias("rows"))
    return ends.filter("keeper <> latest").drop("latest")


def _with_facts(rows: DataFrame, facts: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """``rows`` joined with ``facts``, which has a row for a key and counts its
    ``rows``.

    A key of very many rows would be one task of a shuffled join.  Keys of more
    than ``hot`` rows and more than a part in 10000 of all, so at most 10000
    keys, are broadcast; the others are joined by a shuffle.
    """
    n = facts.agg(F.sum("rows")).first()[0] or 0
    if n <= hot:
        return rows.join(facts.drop("rows"), key)
    limit = max(hot, n // 10_000)
    many, few = facts.filter(F.col("rows") > limit).drop("rows"), facts.filter(F.col("rows") <= limit).drop("rows")
    apart = rows.join(F.broadcast(many), key)
    others = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(few, key)
    return apart.unionByName(others)


def _later(spread: DataFrame, most: int, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """The rows (id, th, at, w) of hashes that a lesser id has, with the least
    such id as ``keeper``; no hash has more than ``most`` rows.

    One shuffle by hash finds it, and nothing is stored.  If a hash may have
    more rows than a task shall sort, hashes are counted first, so that the
    hot ones are no key of a shuffle.  Both ways give the same rows.
    """
    if most <= in_one_task:
        found = spread.withColumn("keeper", F.min("id").over(Window.partitionBy("w")))
    else:
        spread = stored(spread)
        found = _with_facts(spread, stored(_shared(spread)), "w")
    return found.filter(F.col("id") > F.col("keeper"))


def _repeated_windows(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, th, at, n, classes, kept_in) of the runs of windows of 51 words that
    occur in a document with a lesser id, however they lie to paragraphs.

    Windows are hashed around anchors (id, th, at, w) that several documents
    hold, and only met by hash: this equals the extension of each anchor word by
    word against all lesser documents, without pairs.  A window holds the same
    anchor wherever it stands, so none is in more rows than the commonest anchor.
    """
    shared = stored(_shared(marks))
    places = _with_facts(marks, shared, "w").groupBy("id", "th").agg(F.collect_set("at").alias("places"))
    spread = _around(docs.join(places, ["id", "th"])).select("id", "th", F.inline("windows"))
    hits = _later(spread, shared.agg(F.max("rows")).first()[0] or 0)
    order = Window.partitionBy("id", "th").orderBy("at")
    gap = F.col("at") - F.lag("at").over(order)
    runs = hits.withColumn("starts", F.coalesce((gap > WINDOW).cast("int"), F.lit(1))).withColumn("run", F.sum("starts").over(order))
    by_keeper = runs.groupBy("id", "th", "run", "keeper").agg(F.min("at").alias("at"), F.max("at").alias("last"), F.min("w").alias("w"))
    spans = by_keeper.groupBy("id", "th", "run").agg(F.min("at").alias("at"), (F.max("last") + WINDOW - F.min("at")).alias("n"), F.array(F.min("w")).alias("classes"), F.collect_set("keeper").alias("kept_in"))
    return spans.drop("run")


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping and adjoining spans (id, th, at, n, classes, kept_in) as one."""
    order = Window.partitionBy("id", "th").orderBy("at", "n")
    before = F.max(F.col("at") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("starts", (F.col("at") > F.coalesce(before, F.lit(-1))).cast("int")).withColumn("run", F.sum("starts").over(order))
    all_of = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return runs.groupBy("id", "th", "run").agg(F.min("at").alias("at"), (F.max(F.col("at") + F.col("n")) - F.min("at")).alias("n"), all_of("classes"), all_of("kept_in")).drop("run")


def _numbered(rows: DataFrame) -> DataFrame:
    """(id, th, v): the texts of the ids that have several, numbered from 0."""
    texts = rows.filter("id is not null").select("id", "th").distinct()
    several = texts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    return texts.join(several, "id", "left_semi").withColumn("v", F.row_number().over(Window.partitionBy("id").orderBy("th")) - 1)


def _with_number(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """``rows`` with the number of the text among those of its id as ``th``, 0
    for all ids with one text: a hash of eight bytes in each of many rows is
    most of what these rows weigh.  ``numbered`` is stored and mostly empty, so
    its known size decides how it is joined."""
    told = rows.join(numbered, ["id", "th"], "left").withColumn("th", F.coalesce("v", F.lit(0)))
    return told.select(*rows.columns)


def band_members(distinct: DataFrame) -> DataFrame:
    """(key, h, size, hub) of distinct paragraphs that share one of the bands."""
    from .similar import shared_bands

    keyed = distinct.select("h", F.posexplode(F.array(*_MINS)).alias("band", "m"))
    return shared_bands(keyed.select(F.xxhash64("band", "m").alias("key"), "h"))


def repeated(df: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR, passage: int = PASSAGE) -> DataFrame:
    """(id, text_hash, n_words, n_removed, spans, classes, kept_in) for each row
    of ``df``; text_hash tells texts with one id apart.

    spans: (first word, words) of the passages to remove, which are runs of
    paragraphs that occur in a document with a lesser id, together at least
    ``passage`` words; classes and kept_in: their components and the documents
    that keep the first occurrence.

    Equal paragraphs collapse by hash before anything else; different ones
    that share a band are verified by exact Jaccard similarity of their
    shingles of five words, large bands by prefixes of their shingles, and
    components of verified pairs are classes.

    Defined results: null and empty texts have no paragraphs and lose nothing;
    repetition inside one document is left alone; rows with equal ids count as
    one document, but each text has its own spans; null ids keep their texts;
    an empty table stays empty.
    """
    from .similar import links as similar_links

    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    scanned = stored(_scanned(docs))
    numbered = stored(_numbered(scanned))
    scanned = _with_number(scanned.withColumn("text_hash", F.col("th")), numbered)
    docs = _with_number(docs, numbered)
    # first of all and stored, so that its shuffles are gone before the others
    by_window = stored(_repeated_windows(docs, scanned.select("id", "th", F.inline("anchors"))))
    cut = scanned.select("id", "th", F.inline("paragraphs"))
    distinct = stored(cut.groupBy("h").agg(*[F.min(m).alias(m) for m in _MINS], F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("rows")))
    members = stored(band_members(distinct))

    # words of the candidates, from one occurrence each
    wanted = members.select("h").distinct()
    places = cut.join(wanted, "h", "left_semi").groupBy("h").agg(F.min(F.struct("id", "th", "at", "n")).alias("o")).select("h", "o.*")
    by_doc = places.groupBy("id", "th").agg(F.collect_list(F.struct("at", "n", "h")).alias("places"))
    texts = docs.join(by_doc, ["id", "th"]).select(F.explode(_texts_column("text", "places")).alias("w")).select("w.*").dropDuplicates(["h"])
    sets = stored(texts.select("h", F.transform(_grams("words"), lambda g: F.xxhash64(g)).alias("grams")))
    links = similar_links(members, sets, similar)

    roots = components(links).withColumnRenamed("node", "h")
    spread = distinct.filter("lo <> hi").select("h").unionByName(roots.select("h")).distinct().join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    firsts = distinct.select("h", "lo", "hi", "rows").join(spread, "h")
    classes = firsts.groupBy("root").agg(F.min("lo").alias("keeper"), F.max("hi").alias("latest")).filter("keeper <> latest")
    of_paragraph = stored(firsts.join(classes, "root").select("h", "root", "keeper", "rows"))

    found = _with_facts(cut, of_paragraph, "h").filter(F.col("id") > F.col("keeper")).select("id", "th", "at", "n", "root", "keeper").distinct()
    order = Window.partitionBy("id", "th").orderBy("at")
    starts = (F.col("at") > F.coalesce(F.lag(F.col("at") + F.col("n")).over(order), F.lit(-1))).cast("int")
    runs = found.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order))
    spans = runs.groupBy("id", "th", "run").agg(F.min("at").alias("at"), (F.max(F.col("at") + F.col("n")) - F.min("at")).alias("n"), F.collect_set("root").alias("classes"), F.collect_set("keeper").alias("kept_in")).filter(F.col("n") >= passage)
    spans = _merged(spans.drop("run").unionByName(by_window))
    removed = spans.groupBy("id", "th").agg(F.sum("n").cast("long").alias("n_removed"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept_in")))).alias("kept_in"))
    out = scanned.select("id", "th", "text_hash", "n_words").join(removed, ["id", "th"], "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))
    return out.drop("th").select(F.col("id").alias(id_col), "text_hash", "n_words", "n_removed", "spans", "classes", "kept_in")


def remove(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without the spans of :func:`repeated`; white space around what
    stays is kept.

    Spans belong to an id and a text, so rows with one id and different texts
    each lose their own.  Only rows without spans keep their text as it is;
    repeated rows, null ids and texts, and an empty table stay.
    """

    @F.pandas_udf(T.StringType())
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        import re

        out = []
        for t, cuts in zip(texts, spans, strict=True):
            if t is None or cuts is None:
                out.append(t)
                continue
            ends = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
            parts, at = [], 0
            for c in cuts:
                parts.append(t[at : ends[c["at"]][0]])
                at = ends[c["at"] + c["n"] - 1][1]
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    spans = found.filter("n_removed > 0").select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__th"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__th"])
    joined = df.join(spans, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text) == F.col("__th")), "left")
    return joined.withColumn(text, without(F.col(text), F.col("__spans"))).select(*[F.col(f"`{c}`") for c in df.columns])
