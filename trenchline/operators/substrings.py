"""Which texts hold which words, by an inverted index of short letter runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, size: Column | int) -> Column:
    """The distinct runs of `size` characters of a text; none of a shorter one."""
    size = F.lit(size) if isinstance(size, int) else size
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    runs = F.array_distinct(F.transform(at, lambda i: F.substring(text, i, size)))
    return F.when(F.length(text) >= size, runs).otherwise(F.array().cast("array<string>"))


def holders(words: DataFrame, texts: DataFrame, keys: list[str], word: str, text: str) -> DataFrame:
    """keys, word, text: every text (once) that holds a word as a substring, within the same keys.

    Texts are posted under their runs of three characters (and under shorter ones, which words
    of one or two characters look for).  A word looks under the rarest of its runs, and only
    there is it compared; a word with a run that no text has is in none.
    """
    distinct_texts = texts.select(*keys, F.col(text).alias("text")).where("text is not null").distinct()
    wanted = words.select(*keys, F.col(word).alias("word")).where("word != ''").distinct()
    # only lengths of runs that some word looks for are posted
    run = F.least(F.length("word"), F.lit(GRAM))
    sizes = wanted.select(*keys, run.alias("size")).distinct()
    posted = distinct_texts.join(sizes, keys).select(*keys, "text", "size", F.explode(grams(F.col("text"), F.col("size"))).alias("gram"))
    counts = posted.groupBy(*keys, "gram").agg(F.count("*").alias("df"))
    looked = wanted.withColumn("own", grams(F.col("word"), run)).select(*keys, "word", F.size("own").alias("n"), F.explode("own").alias("gram"))
    rarest = (looked.join(counts, [*keys, "gram"]).groupBy(*keys, "word", "n").agg(F.count("*").alias("met"), F.min_by("gram", F.struct("df", "gram")).alias("gram"))
              .where("met = n").drop("met", "n"))
    met = rarest.join(posted.drop("size"), [*keys, "gram"]).where(F.contains(F.col("text"), F.col("word")))
    return met.select(*keys, F.col("word").alias(word), F.col("text").alias(text))
