"""Operator 4: quality rules with a hashed n-gram log-likelihood ratio (native).

Everything is a DataFrame expression.  N-grams are hashed to a fixed number
of buckets; two multinomials over the buckets, of a trusted target and of the raw
corpus (every document), give a weight to each bucket, the logarithm of the ratio
of its smoothed probabilities.  A document's score is the mean weight of its
n-grams; it is kept if the score is not below a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import JAVA_SPACE, stage_table

BUCKETS = 1 << 18


def word_array(text: Column) -> Column:
    """The words of a text; null has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, JAVA_SPACE + "+"))


def with_words(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), *more).withColumn("w", word_array(F.col("t")))


def _behind(array: str, by: int) -> Column:
    """The array without its first ``by`` elements."""
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def gram_buckets(word: Column, after: Column, buckets: int) -> list[Column]:
    """Buckets of the n-grams at a word: it alone, it and the next word (null: the text's
    end), and the characters at their seam, two of each."""
    grams = ((word,), (word, after), (F.right(word, F.lit(2)), F.left(after, F.lit(2))))
    return [F.pmod(F.xxhash64(*g, F.lit(n)), F.lit(buckets)).cast("int") for n, g in enumerate(grams)]


#: Bits of a place in a packed window; longer texts are sorted as pairs.
PLACE = 21


def repeated_words(frame: DataFrame) -> DataFrame:
    """Add n_repeat_words: words in 3-word windows that the text has twice or more.

    The windows' hashes, with their places in the low bits, are sorted; neighbours
    that agree above those bits and in their words give the places of repeated
    windows.  A fold over the places counts the words they cover, each once.  Where
    neighbours agree in hash but not in words, or places need more bits, (hash,
    place) pairs of full width are sorted instead.
    """
    low = (1 << PLACE) - 1
    size = F.greatest(F.size("w") - 2, F.lit(0))
    window = lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))
    frame = frame.withColumn("g", F.sort_array(F.slice(F.transform("w", lambda x, i: window(x, i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))), 1, size)))
    but_last = F.slice("g", 1, F.greatest(F.size("g") - 1, F.lit(0)))
    near = F.zip_with(_behind("g", 1), but_last, lambda x, p: F.when(F.shiftrightunsigned(x.bitwiseXOR(p), PLACE) == 0, F.array(p.bitwiseAND(low).cast("int"), x.bitwiseAND(low).cast("int"))))
    frame = frame.withColumn("p", F.filter(near, lambda p: p.isNotNull())).drop("g")
    same = F.forall("p", lambda p: F.slice("w", p[0] + 1, 3) == F.slice("w", p[1] + 1, 3)) & (F.size("w") <= low)
    full = F.sort_array(F.slice(F.transform("w", lambda x, i: F.struct(window(x, i).alias("h"), i.alias("i"))), 1, size))
    wide = F.aggregate(full, F.struct(F.lit(0).cast("long").alias("h"), F.lit(-1).alias("i"), F.array().cast("array<array<int>>").alias("p")), lambda a, x: F.struct(x["h"].alias("h"), x["i"].alias("i"), F.when((a["i"] >= 0) & (a["h"] == x["h"]), F.concat(a["p"], F.array(F.array(a["i"], x["i"])))).otherwise(a["p"]).alias("p")), lambda a: a["p"])
    places = F.sort_array(F.array_distinct(F.flatten(F.when(same, F.col("p")).otherwise(wide))))
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    fold = F.aggregate(places, start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")), lambda a: a["n"])
    return frame.withColumn("n_repeat_words", fold.cast("long")).drop("p")


def base_counts(frame: DataFrame) -> DataFrame:
    """The contract's counts and base verdict for rows with text t and words w."""
    frame = frame.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    frame = frame.withColumn("n_words", F.size("w").cast("long"))
    frame = frame.withColumn("word_chars", F.char_length(F.array_join("w", "")).cast("long"))
    frame = frame.withColumn("n_symbols", F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long"))
    frame = frame.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    frame = repeated_words(frame)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return frame.withColumn("base_failed", failed)


def bucket_weights(docs: DataFrame, trusted: DataFrame, key: str, text: str, buckets: int, prior: float, least: float) -> DataFrame:
    """(bucket, weight) of every bucket that the corpus fills; ``trusted`` holds a bounded number of keys."""
    ids = trusted.select(F.col(key).alias("k"), F.lit(1).alias("good")).distinct()
    frame = with_words(docs, key, text).join(F.broadcast(ids), "k", "left")
    pairs = frame.select("good", F.explode(F.arrays_zip(F.col("w").alias("x"), _behind("w", 1).alias("y"))).alias("p"))
    grams = pairs.select("good", F.explode(F.array(*gram_buckets(F.col("p.x"), F.col("p.y"), buckets))).alias("bucket"))
    counts = stage_table(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("good")), "buckets")
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    if not total["good"]:  # no trusted text: no evidence either way
        return counts.select("bucket", F.lit(0.0).alias("weight"))
    due = F.col("raw") * (total["good"] / total["raw"])  # what trusted text would have at the raw rate
    return counts.select("bucket", F.log(F.greatest((F.col("good") + prior) / (due + prior), F.lit(least))).alias("weight"))


def trusted_sample(labels: DataFrame, key: str = "doc_id", most: int = 20_000) -> DataFrame:
    """Keys of at most ``most`` rows labelled good, those of least hash: the bound of what is broadcast."""
    return labels.filter("quality = 1").select(key).filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(most)


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, prior: float = 2.0, least: float = 0.1, threshold: float = -0.25, carry: bool = False) -> DataFrame:
    """Counts, score and verdict of every row of ``docs``, and with ``carry`` the row.

    The trusted multinomial is fitted on at most 20,000 labelled rows (a parameter
    of ``trusted_sample``); the raw one on all rows.  Each bucket's trusted count and
    what the raw rate would make it get ``prior`` more, so a bucket of which little
    is known weighs little, and no ratio is taken as less than ``least``.  Null and
    empty texts have no words, score 0 and fail the base rules; a score equal to the
    threshold is kept; texts of any length count as a whole; without labelled rows all
    scores are 0; repeated rows give a row each, null keys stay null, and columns of
    any name go through ``carry`` as one; an empty table gives no rows.
    """
    weights = bucket_weights(docs, trusted_sample(labels, key), key, text, buckets, prior, least)
    # One row with as many entries as there are buckets, whatever the corpus.
    listed = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(weights, "bucket", "left")
    entry = F.struct("bucket", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    one = stage_table(listed.groupBy().agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["weight"]).alias("all")), "weights")
    frame = with_words(docs, key, text, F.struct(*docs.columns).alias("row")) if carry else with_words(docs, key, text)
    frame = base_counts(frame).drop("t").withColumn("table", one.scalar())

    def weight(word: Column, after: Column) -> Column:
        one, two, seam = (F.get("table", b) for b in gram_buckets(word, after, buckets))
        return one + two + seam

    total = F.aggregate(F.zip_with("w", _behind("w", 1), weight), F.lit(0.0), lambda total, x: total + x)
    frame = frame.withColumn("score", F.coalesce(total / F.nullif(3 * F.size("w"), F.lit(0)), F.lit(0.0)))
    return frame.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, score and verdict of every row; see ``judged``."""
    out = judged(docs, labels, key, text)
    return out.select(F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are kept, with all their columns.

    The row number keeps the optimizer from moving the filter below the columns it
    is made of, where it would split the text anew for each word.
    """
    out = judged(docs, labels, key, text, carry=True).select("row", "kept", F.monotonically_increasing_id().alias("at"))
    return out.filter("kept AND at >= 0").select("row.*")
