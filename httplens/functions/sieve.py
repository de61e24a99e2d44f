"""A Bloom filter of a column, made and asked with built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

WORD = 64
BITS_PER_VALUE = 3


class Sieve:
    """The values of ``column`` as a few bits each in one of ``words`` 64-bit words, whatever their number: 128 KB by default.

    A value that is there is always let through; of others a few per cent at 100,000 different values there, and all of them
    at many millions. The filter is a scalar subquery: it is made when the query runs, before the scan it guards.
    """

    def __init__(self, rows: DataFrame, column: str, words: int = 1 << 14):
        self.words = words
        marks = rows.select(self._word(column).alias("word"), self._mask(column).alias("mask"))
        every = rows.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
        united = marks.unionByName(every).groupBy("word").agg(F.bit_or("mask").alias("mask"))
        # A row per word, of which there is a fixed number.
        listed = F.transform(F.sort_array(F.collect_list(F.struct("word", "mask"))), lambda w: w["mask"])
        self._filter = united.agg(listed.alias("words")).scalar()

    def _word(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(1), F.col(column)), F.lit(self.words)).cast("int")

    def _mask(self, column: str) -> Column:
        """``shiftleft`` counts modulo 64: different bits of one hash give the places."""
        digest = F.xxhash64(F.lit(2), F.col(column))
        places = [F.shiftrightunsigned(digest, 6 * k).bitwiseAND(F.lit(WORD - 1)) for k in range(BITS_PER_VALUE)]
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), p.cast("int")) for p in places]
        return reduce(Column.bitwiseOR, bits)

    def may_hold(self, column: str) -> Column:
        """Whether the column's value may be among those of the sieve. Null is a value like others."""
        mask = self._mask(column)
        return F.get(self._filter, self._word(column)).bitwiseAND(mask) == mask
