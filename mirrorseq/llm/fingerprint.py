"""Document fingerprints by consistent weighted sampling, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, words

SAMPLES = 64
#: Samples that one row draws; more make the generated code too long to compile.
_BLOCK = 2
#: Identity bits of a sample; the rest of a positive long orders the samples.
_ID_BITS = 23
#: Least draws are kept in steps of 2 ** -34 up to 64.
_MOST, _STEPS = 63.999, float(1 << 34)
#: Quantiles of the ids, rows that a bucket aims at, and most buckets a quantile.
_COARSE, _ROWS, _FINE = 256, 32, 1024
#: Bits by which rows that share one very frequent id are dealt on.
_SUB_BITS = 10
#: Buckets whose first rows are found by a broadcast of their ids and ties.
_FEW_BUCKETS = 1_000_000


def _exponential(value: Column, shift: int, width: int) -> Column:
    """An Exp(1) draw from some bits of a hash."""
    bits = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))
    return -F.log((bits + F.lit(0.5)) * 2.0**-width)


def signatures(terms: DataFrame, by: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """One row for each group with an array of sample identities a weight column.

    terms: (*by, term long, *weights); a term with weight 0 isn't in the set,
    and the signature of an empty set is all null.  Equal sets have equal
    signatures, and the share of equal entries estimates the similarity.
    ``samples`` is a multiple of 2.

    Improved consistent weighted sampling (Ioffe, 2010): for each term and
    sample, r and c are Gamma(2, 1) and b uniform, all drawn from the hash of
    the term and the sample's number; t = floor(ln w / r + b) and
    a = c exp(-r (t - b + 1)).  The term with the least a is the sample and
    (term, t) its identity; two weighted sets share it with probability sum of
    min(w) / sum of max(w), their generalised Jaccard similarity.

    The draws come from three independent Exp(1) variables x, z and v: a
    Gamma(2, 1) variable and its uniform share are a sum of two such variables
    and the first one's part of it, so c = z + v, r (1 - b) = ln(c / z),
    r = x + ln(c / z) and r b = x have the joint distribution above.  At weight
    1, the most frequent, t = 0 and a = z, and no other draw is needed.

    Order and identity are packed into one long, so that a sample is a minimum.
    The draws serve all weight columns, and a term whose weights are equal is
    drawn once.
    """
    log = lambda w: F.log(F.when(F.col(w) > 0, F.col(w)).cast("double")).alias(f"__log_{w}")
    heavy = F.greatest(F.lit(1), *weights) > 1
    each = terms.select(*by, "term", *weights, *map(log, weights), heavy.alias("__heavy"), F.explode(F.array(*map(F.lit, range(samples // _BLOCK)))).alias("__j"))
    each = each.select("*", *[F.xxhash64("term", F.col("__j") * _BLOCK + k).alias(f"__u{k}") for k in range(_BLOCK)])
    draws = []
    for k in range(_BLOCK):
        u = F.col(f"__u{k}")
        draws.append(_exponential(u, 0, 24).alias(f"__z{k}"))
        draws += [F.when(F.col("__heavy"), _exponential(u, shift, 20)).alias(f"__{name}{k}") for name, shift in (("x", 24), ("v", 44))]
    each = each.select("*", *draws)
    each = each.select("*", *[F.when(F.col("__heavy"), F.col(f"__x{k}") + F.log((F.col(f"__z{k}") + F.col(f"__v{k}")) / F.col(f"__z{k}"))).alias(f"__r{k}") for k in range(_BLOCK)])
    step = lambda k, w: F.when(F.col(f"__log_{w}") == 0.0, F.lit(0).cast("long")).otherwise(F.floor((F.col(f"__log_{w}") + F.col(f"__x{k}")) / F.col(f"__r{k}")))
    each = each.select("*", *[step(k, w).alias(f"__t{k}_{w}") for k in range(_BLOCK) for w in weights])

    def packed(k: int, w: str) -> Column:
        t, z = F.col(f"__t{k}_{w}"), F.col(f"__z{k}")
        a = F.when(F.col(f"__log_{w}") == 0.0, z).otherwise((z + F.col(f"__v{k}")) * F.exp(F.col(f"__x{k}") - F.col(f"__r{k}") * (t + 1)))
        identity = F.shiftrightunsigned(F.col("term"), 7).bitwiseXOR(t * 40503).bitwiseAND(F.lit((1 << _ID_BITS) - 1))
        return F.shiftleft((F.least(a, F.lit(_MOST)) * _STEPS).cast("long"), _ID_BITS).bitwiseOR(identity)

    first, *others = weights
    each = each.select("*", *[packed(k, first).alias(f"__p{k}") for k in range(_BLOCK)])
    least = [F.min(F.when(F.col(first) > 0, F.col(f"__p{k}"))).alias(f"{first}_{k}") for k in range(_BLOCK)]
    least += [F.min(F.when(F.col(w) == F.col(first), F.when(F.col(w) > 0, F.col(f"__p{k}"))).when(F.col(w) > 0, packed(k, w))).alias(f"{w}_{k}") for w in others for k in range(_BLOCK)]
    best = each.groupBy(*by, "__j").agg(*least)
    drawn = F.struct("__j", *[F.array(*[f"{w}_{k}" for k in range(_BLOCK)]).alias(w) for w in weights])
    found = best.groupBy(*by).agg(F.sort_array(F.collect_list(drawn)).alias("__s"))
    identity = lambda x: x.bitwiseAND(F.lit((1 << _ID_BITS) - 1)).cast("int")
    entries = lambda w: F.transform(F.flatten(F.transform("__s", lambda s: s[w])), identity).alias(w)
    return found.select(*by, *map(entries, weights))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal entries of two signatures; two empty sets are equal."""
    same = F.lit(0)
    for j in range(samples):
        same = same + F.get(a, F.lit(j)).eqNullSafe(F.get(b, F.lit(j))).cast("int")
    return same / float(samples)


def as_text(signature: str) -> Column:
    """Six hexadecimal digits an entry; dashes for an empty set."""
    return F.concat(*[F.coalesce(F.lower(F.lpad(F.hex(F.get(signature, F.lit(j))), 6, "0")), F.lit("------")) for j in range(SAMPLES)])


def in_order(df: DataFrame, id_col: str, tie: str, columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows dealt to buckets that follow the order of (id, tie), and which
    bucket is next: (bucket, *columns), (bucket, next_bucket), and the least (id,
    tie) of each bucket.  All but the first come from ids and ties alone, which
    are stored, so texts aren't read for them.

    The ids are cut at 256 quantiles, and each part at further quantiles of its
    own, as many as the number of rows asks for up to 1024, so a bucket has some
    rows at small size and a 262144th of them at any size, however the ids lie.
    An id at which a cut falls has buckets of its own, dealt on by ``tie``
    (a long >= 0), so that one id of very many rows is split.  Null ids come
    first.  The last bucket is followed by the first.
    """
    slim = stored(df.select(F.col(id_col).alias("id"), F.col(tie).alias("tie")))
    stats = slim.agg(F.count("*").alias("n"), F.percentile_approx("id", [k / _COARSE for k in range(1, _COARSE)]).alias("q")).first()
    fine = min(_FINE, max(2, -(-stats["n"] // (_COARSE * _ROWS))))
    edges = sorted(set(stats["q"] or []))
    outer = F.array(*[F.lit(int(x)) for x in edges]).cast("array<bigint>")

    def coarse(i: str) -> Column:
        return F.when(F.col(i).isNull(), 0).otherwise(F.size(F.filter(outer, lambda x: x <= F.col(i))) + 1)

    # at most 257 rows of 1024 ids
    cuts = stored(slim.filter("id is not null").groupBy(coarse("id").alias("__c")).agg(F.array_distinct(F.percentile_approx("id", [k / fine for k in range(fine)])).alias("__q")))

    def dealt(rows: DataFrame, i: str, t: str) -> DataFrame:
        out = rows.withColumn("__c", coarse(i)).join(F.broadcast(cuts), "__c", "left")
        at = F.coalesce(F.array_contains("__q", F.col(i)), F.lit(True))
        inside = F.coalesce(F.size(F.filter("__q", lambda x: x < F.col(i))), F.lit(0)) * 2 + at.cast("int")
        sub = F.when(at, F.shiftright(t, 63 - _SUB_BITS)).otherwise(0)
        return out.withColumn("bucket", (F.col("__c").cast("long") * (4 * _FINE) + inside) * (1 << _SUB_BITS) + sub)

    least = stored(dealt(slim, "id", "tie").groupBy("bucket").agg(F.min(F.struct("id", "tie")).alias("m")).select("bucket", "m.*"))
    used = least.select("bucket", F.floor(F.col("bucket") / (4 * _FINE << _SUB_BITS)).alias("__c"))
    parts = used.groupBy("__c").agg(F.min("bucket").alias("__first"))
    every = Window.orderBy("__c")  # at most 257 rows
    first = F.first("__first").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.select("__c", F.coalesce(F.lead("__first").over(every), first).alias("__next"))
    ahead = F.lead("bucket").over(Window.partitionBy("__c").orderBy("bucket"))
    follows = used.withColumn("__ahead", ahead).join(F.broadcast(parts), "__c").select("bucket", F.coalesce("__ahead", "__next").alias("next_bucket"))
    return dealt(df, id_col, tie).select("bucket", *columns), stored(follows), least


def next_value(rows: DataFrame, follows: DataFrame, firsts: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out``, the ``value`` of the next row in the order of (bucket, rank).

    firsts: (bucket, value) of each bucket's first row.
    """
    ahead = F.lead(value).over(Window.partitionBy("bucket").orderBy("rank"))
    last = F.lead("rank").over(Window.partitionBy("bucket").orderBy("rank")).isNull()
    heads = firsts.withColumnRenamed("bucket", "next_bucket").join(follows, "next_bucket").select("bucket", F.col(value).alias("__head"))
    joined = rows.withColumn("__ahead", ahead).withColumn("__last", last).join(heads, "bucket")
    return joined.withColumn(out, F.when(F.col("__last"), F.col("__head")).otherwise(F.col("__ahead"))).drop("__ahead", "__last", "__head")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form.

    The edited text is the text with its last half replaced by the beginning of
    the next document's, in the order of ids (after the last comes the first).
    Terms are the words, weighed by their count.  Returns (id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Texts are shuffled once, by bucket; counting words, sampling them and
    looking ahead keep that partitioning.  A long text is a row among others.

    Defined results: a null text counts as empty; an empty text has a
    fingerprint of dashes, equal to other empty ones only; rows with equal ids
    stand in the order of their texts' hashes, repeated rows one after the
    other; a single row is its own next one; an empty table gives no rows.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    dealt, follows, least = in_order(docs, "id", "tie", ["id", "text", "tie"])
    by_id = Window.partitionBy("bucket").orderBy("id", "tie")
    if least.count() <= _FEW_BUCKETS:  # or all texts would be shuffled to find some
        least = F.broadcast(least)
    same = (F.col("d.bucket") == F.col("l.bucket")) & F.col("d.id").eqNullSafe(F.col("l.id")) & (F.col("d.tie") == F.col("l.tie"))
    firsts = dealt.alias("d").join(least.alias("l"), same, "left_semi").dropDuplicates(["bucket"]).select("bucket", "text")
    rows = dealt.withColumn("rank", F.row_number().over(by_id)).drop("tie")
    rows = next_value(rows, follows, stored(firsts), "text", "next")

    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    about = rows.select("bucket", "rank", "id", "n_chars", F.sha2("edited", 256).alias("sha"))
    split = rows.select("bucket", "rank", words(F.col("text")).alias("own"), words(F.col("edited")).alias("changed"))
    split = split.select("bucket", "rank", F.size("own").alias("n_own"), F.concat("own", "changed").alias("all"))
    each = split.select("bucket", "rank", "n_own", F.posexplode_outer("all").alias("at", "word"))
    here = F.col("word").isNotNull()
    counts = each.groupBy("bucket", "rank", F.xxhash64("word").alias("term")).agg(F.sum((here & (F.col("at") < F.col("n_own"))).cast("int")).alias("own"), F.sum((here & (F.col("at") >= F.col("n_own"))).cast("int")).alias("edited"))
    found = stored(signatures(counts, ["bucket", "rank"], ["own", "edited"]).join(about, ["bucket", "rank"]))

    heads = found.filter("rank = 1").select("bucket", "own")
    found = next_value(found, follows, heads, "own", "next")
    return found.select(
        F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), as_text("own").alias("fingerprint"), as_text("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"), likeness("own", "next").alias("near_next"),
    )
