"""Quality rules that vote or abstain, weighed by expectation-maximisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored, words

GOOD, BAD, ABSTAIN = 1, 2, 0
#: A word of letters, perhaps with one mark behind it.
_PLAIN = r"(?<![^\x20\x09-\x0D])\p{L}+[.,;:!?]?(?![^\x20\x09-\x0D])"


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds counts (all long) of each whole text.

    n_words, word_chars (code points in words), n_symbols, n_lines (with a
    word), n_dup_lines (equal to an earlier one), n_repeat_words, and for the
    rules n_upper (capitals), n_plain (words of letters, perhaps with a mark
    behind), n_distinct (different words), n_short (words of at most three
    characters), n_ended (lines that end in a mark), n_shouts (! signs).

    n_repeat_words counts the words that lie in a window of three words found
    twice or more in the text.  Windows are compared by 64-bit hash: sorted
    with their starts, equal neighbours are repeats, and each repeated start
    covers up to three words, as far as the next one.  All of it happens inside
    the row, so there is no shuffle, in n log n steps.

    Defined results: a null or empty text measures 0 throughout.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(whole, F.lit(pattern)).cast("long")
    out = df.withColumn("__w", words(F.col(text)))
    out = out.withColumn("n_words", F.size("__w").cast("long"))
    out = out.withColumn("word_chars", F.length(whole) - count(r"[\x20\x09-\x0D]"))
    out = out.withColumn("n_symbols", count(r"[#*$%&|<>]"))
    out = out.withColumn("n_upper", count(r"\p{Lu}")).withColumn("n_plain", count(_PLAIN))
    out = out.withColumn("n_shouts", (F.length(whole) - F.length(F.replace(whole, F.lit("!"), F.lit("")))).cast("long"))
    out = out.withColumn("n_distinct", F.size(F.array_distinct("__w")).cast("long"))
    out = out.withColumn("n_short", F.size(F.filter("__w", lambda x: F.length(x) <= 3)).cast("long"))
    out = out.withColumn("__lines", F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)))
    out = out.withColumn("n_lines", F.size("__lines").cast("long"))
    out = out.withColumn("n_ended", F.size(F.filter("__lines", lambda x: x.rlike(r"[.!?][\s\x0B]*$"))).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))

    starts = F.slice("__w", 1, F.greatest(F.size("__w") - 2, F.lit(0)))
    out = out.withColumn("__g", F.transform(starts, lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2))))
    repeats = F.size(F.array_distinct("__g")) < F.size("__g")
    placed = F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__s", F.when(repeats, placed))
    same = lambda e, i: (e["h"] == F.get("__s", i - 1)["h"]) | (e["h"] == F.get("__s", i + 1)["h"])
    found = F.sort_array(F.transform(F.filter("__s", lambda e, i: F.coalesce(same(e, i), F.lit(False))), lambda e: e["i"]))
    out = out.withColumn("__r", found)
    covers = F.transform("__r", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__r", i + 1) - p, F.lit(3))))
    total = F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("__w", "__lines", "__g", "__s", "__r")


def base_failed() -> Column:
    """Under 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, BAD)
    return (vote if good is None else vote.when(good, GOOD)).otherwise(ABSTAIN)


def rules() -> list[Column]:
    """Each rule's vote from the measures.

    Rules overlap and err: a kind of damage trips several, and a clean text may
    trip one, as long texts have few different words.  What a vote is worth is
    for :func:`fit` to find.  The limits are those of public rule sets for web
    text (Rae et al., 2021; Raffel et al., 2020; Penedo et al., 2024), or round
    figures where those have none.
    """
    n = F.greatest(F.col("n_words"), F.lit(1))
    per_word = lambda c: F.col(c) / n
    per_line = lambda c: F.col(c) / F.greatest(F.col("n_lines"), F.lit(1))
    upper = F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    return [
        _vote(per_word("n_symbols") > 0.1, per_word("n_symbols") < 0.02),
        _vote(per_word("n_plain") < 0.8, per_word("n_plain") > 0.95),
        _vote(per_word("n_repeat_words") > 0.3, per_word("n_repeat_words") < 0.1),
        _vote(per_word("n_distinct") < 0.3, per_word("n_distinct") > 0.6),
        _vote(per_line("n_dup_lines") > 0.3, (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 2)),
        _vote(upper > 0.3, upper < 0.1),
        _vote(~per_word("word_chars").between(3.0, 10.0), per_word("word_chars").between(4.0, 7.0)),
        _vote(per_line("n_ended") < 0.2, per_line("n_ended") > 0.8),
        _vote(per_word("n_shouts") > 0.1, per_word("n_shouts") < 0.02),
        _vote(~per_word("n_short").between(0.1, 0.7), per_word("n_short").between(0.2, 0.6)),
    ]


N_RULES = 10


def pattern() -> Column:
    """The votes of all rules as one number to base 3, below 3 ** 10."""
    code = F.lit(0)
    for vote in rules():
        code = code * 3 + vote
    return code


def _digits(codes: np.ndarray, n_rules: int) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(n_rules - 1, -1, -1) % 3


def fit(counts: dict[int, int], n_rules: int = N_RULES, steps: int = 200) -> tuple[float, np.ndarray]:
    """Log odds of good quality before any vote, and what each rule's vote adds:
    an array (rule, vote), with 0 for an abstention.

    The latent class is good or bad.  Each rule has, for either class, the
    chances that it votes good or bad given that it votes, independent of other
    rules given the class; whether it votes is taken to say nothing.  EM starts
    from rules that are right four times in five and raises the likelihood of
    the observed patterns, so a rule that often disagrees with the others loses
    its weight, and several votes outweigh one.  Nothing is fixed beforehand
    but one vote of each kind and class, added to all counts.  The work depends
    on the number of patterns (at most 3 ** rules) alone; without rows the
    starting values decide.
    """
    seen = np.array(sorted(c for c in counts if counts[c]), int)
    mass = np.array([counts[c] for c in seen], float)
    votes = _digits(seen, n_rules)
    good_votes, bad_votes = votes == GOOD, votes == BAD
    prior, right_good, right_bad = 0.8, np.full(n_rules, 0.8), np.full(n_rules, 0.8)

    def weights() -> np.ndarray:
        return np.stack([np.zeros(n_rules), np.log(right_good) - np.log(1 - right_bad), np.log(1 - right_good) - np.log(right_bad)], 1)

    for _ in range(steps if len(seen) else 0):
        w = weights()
        odds = np.log(prior) - np.log(1 - prior) + good_votes @ w[:, GOOD] + bad_votes @ w[:, BAD]
        good = mass / (1 + np.exp(-np.clip(odds, -500, 500)))
        bad = mass - good
        share = lambda part, hit, miss: (part @ hit + 1) / (part @ hit + part @ miss + 2)
        right_good, right_bad = share(good, good_votes, bad_votes), share(bad, bad_votes, good_votes)
        prior = (good.sum() + 1) / (mass.sum() + 2)
    return float(np.log(prior) - np.log(1 - prior)), weights()


def pattern_counts(voted: DataFrame) -> dict[int, int]:
    """Rows by vote pattern, of those that pass the base rules."""
    return {r["pattern"]: r["count"] for r in voted.filter(~F.col("base_failed")).groupBy("pattern").count().collect()}


def posterior(model: tuple[float, np.ndarray], n_rules: int = N_RULES) -> Column:
    """Probability of good quality from the column ``pattern``."""
    odds = F.lit(model[0])
    for j in range(n_rules):
        vote = (F.floor(F.col("pattern") / 3 ** (n_rules - 1 - j)) % 3).cast("int")
        odds = odds + F.when(vote == GOOD, float(model[1][j, GOOD])).when(vote == BAD, float(model[1][j, BAD])).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-odds))


def voted(measured: DataFrame) -> DataFrame:
    """Adds base_failed and pattern to measured rows."""
    return measured.withColumn("base_failed", base_failed()).withColumn("pattern", pattern())


def judged(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds posterior and kept to the voted rows of :func:`voted`.

    The rows are written to the shared folder once and read twice, for the
    counts and for the verdicts, so that nothing is measured again.
    """
    rows = stored(rows)
    out = rows.withColumn("posterior", posterior(fit(pattern_counts(rows))))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that quality rules keep, with its own columns.

    Texts are measured once: those that pass the base rules are written to the
    shared folder with their votes, counted, and read again for the verdict.
    Nothing is shuffled.  Columns that share a name with a measure keep their
    values.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    measured = voted(measures(df.select(row, F.col(text).alias("__text")), "__text"))
    # the filter on an exploded flag stays above the measures, which would
    # otherwise be copied into it and computed anew
    passed = measured.select("__row", "pattern", F.explode(F.array("base_failed")).alias("base_failed")).filter(~F.col("base_failed"))
    return judged(passed).filter("kept").select("__row.*")
