"""Bloom filters as columns: a small set of keys drops rows of a large table before they are shuffled.

The filter is an array of 64-bit words. Each key sets ``HASHES`` bits; the words are a bitwise or per word, combined
in each task before the shuffle, so building it costs one small aggregate however the keys are spread. A row is kept
when all its bits are set: no row whose key is in the set is ever dropped, and about one other row in four hundred stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4
BITS_PER_KEY = 16
MOST_BITS = 1 << 26  # 8 MB; beyond four million keys more rows pass, and none is lost


def filter_bits(keys: int) -> int:
    """Bits for so many keys: a power of two, from one word to ``MOST_BITS``."""
    return min(MOST_BITS, max(64, 1 << (max(1, keys) * BITS_PER_KEY - 1).bit_length()))


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def filter_words(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """(word, bits): the words that have a bit."""
    place = F.explode(F.array(*_places(F.col(column), bits))).alias("place")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    return keys.where(F.col(column).isNotNull()).select(place).groupBy(
        F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(one).alias("bits"))


def possible(table: DataFrame, column: str, keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The rows of ``table`` whose ``column`` may be among ``keys``; all others are certainly not."""
    spark = table.sparkSession
    every = spark.range(bits // 64).withColumnRenamed("id", "word").join(filter_words(keys, key, bits), "word", "left")
    words = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))),
                                  lambda s: s["bits"]).alias("words")).scalar()  # bits / 8 bytes, MOST_BITS / 8 at most
    hit = F.lit(True)
    for place in _places(F.col(column), bits):
        hit = hit & (F.getbit(F.get(words, F.floor(place / 64).cast("int")), (place % 64).cast("int")) == 1)
    return table.where(F.col(column).isNotNull() & hit)
