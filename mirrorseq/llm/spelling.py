"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols.  All strings within one edit of a reduced
word are generated and joined with the reduced vocabulary: two words one edit
apart are at most one edit apart when reduced, so none is missed, and what
meets by the reduction alone is turned away on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_key, stored

#: Fixed by the definition of a word: letters A to Z and U+00C0 to U+00FF.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
#: Symbols of the reduced alphabet, and words whose neighbourhoods a task makes.
SYMBOLS, PART = 8, 20_000


def symbol(letter: str, symbols: int = SYMBOLS) -> str:
    """A letter's symbol, a digit from 0: multiplicative hash of its code point."""
    return "0123456789"[(ord(letter) * 2654435761 % 2**32) * symbols >> 32]


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    return F.translate(word, LETTERS, "".join(symbol(c, symbols) for c in LETTERS))


def neighbourhood(r: Column, symbols: int = SYMBOLS) -> Column:
    """All distinct strings within one edit of a reduced word, itself included:
    its letters deleted, replaced by and preceded or followed by each symbol."""
    every = F.array(*[F.lit(str(s)) for s in range(symbols)])
    head = lambda i: F.substring(r, F.lit(1), i)
    tail = lambda i: F.substring(r, i + F.lit(1), F.length(r))
    places, gaps = F.sequence(F.lit(1), F.length(r)), F.sequence(F.lit(0), F.length(r))
    deleted = F.transform(places, lambda i: F.concat(head(i - 1), tail(i)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(every, lambda s: F.concat(head(i - 1), s, tail(i)))))
    inserted = F.flatten(F.transform(gaps, lambda i: F.transform(every, lambda s: F.concat(head(i), s, tail(i)))))
    return F.array_distinct(F.concat(F.array(r), deleted, replaced, inserted))


def counted_words(df: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, thinned: int | None = 199) -> DataFrame:
    """(word, n): runs of letters, in lower case for A to Z alone, that have at
    least ``least_length`` code points and occur ``least_count`` times.

    With ``thinned``, a run whose crc32 with its document's key is a multiple of
    it loses the code point at crc32 % length: known misspellings.  Words are
    counted before the shuffle, so a word in every row is one row a task.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(rf"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    each = df.filter(F.col(text).isNotNull()).select(as_key(F.col(key)).alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if thinned:
        each = each.select("word", F.crc32(F.concat_ws(":", "id", "word").cast("binary")).alias("h"))
        place = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), place), F.substring(F.col("word"), place + 2, F.length("word")))
        each = each.select(F.when(F.col("h") % thinned == 0, less).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= least_length)
    return each.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words of the vocabulary (word,
    n) at exactly one edit; each pair meets on one key alone.

    Keys are hashes of reduced strings.  A key that many words share (short
    words, few symbols) is a skewed key of a join of narrow rows, which adaptive
    execution splits.
    """
    dealt = vocabulary.repartition(max(1, -(-vocabulary.count() // PART)), "word")
    around = dealt.select("word", F.explode(neighbourhood(reduced(F.col("word"), symbols), symbols)).alias("r")).select(F.xxhash64("r").alias("key"), "word")
    there = vocabulary.select(F.xxhash64(reduced(F.col("word"), symbols)).alias("key"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return around.join(there, "key").filter(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of (word, form) lead to.

    A form has several times its word's occurrences, so there are no circles,
    and chains are short; their length doubles with every round.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not moved.filter("moved").limit(1).count():
            return moved.select("word", "root")
        roots = moved.select("word", "root")


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = 5, symbols: int = SYMBOLS, least_length: int = 6, least_count: int = 5, thinned: int | None = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each counted word.

    form is the near word of largest n (of equal ones the least in code-point
    order) if that is at least ``ratio`` times the word's n; root is where forms
    lead to.  The vocabulary is written to the shared folder once.

    Defined results: null and empty texts have no words; a null key counts as
    'null'; repeated rows count each time; very long runs are words like any
    other; an empty table gives no rows.
    """
    vocabulary = stored(counted_words(df, key, text, least_length, least_count, thinned))
    near = near_words(vocabulary, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    joined = vocabulary.join(near, "word", "left")
    enough = -F.col("best.m") >= ratio * F.col("n")
    found = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")))
    roots = rooted(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
