"""Categories as numbers from a table, and these numbers as inputs of a forest.

A category's values are numbered by falling frequency. The numbers are a table like any other:
they are looked up by a broadcast where the table was measured small, by a shuffle otherwise, and
no list of values is on the driver, in a closure or in a model's metadata.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.lookup import fits_broadcast, lookup
from freshet.operators.ordered import PLACE, running
from freshet.storage import stage

DIGITS = 4


def location_ranks(df: DataFrame, column="location", n=None) -> DataFrame:
    """Each value of ``column`` and its ``<column>_index``, by falling frequency, ties by name.

    For any number of values: they are sorted and numbered in tasks. ``n`` names a column of
    counts. A null is no value.
    """
    rows = F.count("*") if n is None else F.sum(n)
    most = df.where(F.col(column).isNotNull()).groupBy(column).agg(rows.alias("rows_of_value"))
    placed = running(most, [F.desc("rows_of_value"), column], name="ranks")
    return placed.select(column, (F.col(PLACE) - 1).cast("double").alias(f"{column}_index"))


@dataclass(frozen=True)
class Encoding:
    """How a category becomes inputs of ``base`` indexes each, as many for any number of values.

    The ``base - 1`` most frequent values have an index each, all others share the last. The
    others' numbers are told apart by their digits in that base, ``digits`` inputs that are 0 for
    the most frequent. Null and unseen values are numbered after the last one. ``table`` has the
    column and ``number``.
    """

    table: DataFrame
    column: str
    values: int
    base: int
    digits: int
    small: bool

    @property
    def index(self):
        return f"{self.column}_index"

    @property
    def digit_columns(self):
        return [f"{self.column}_digit{k}" for k in range(self.digits)]

    def add(self, df: DataFrame) -> DataFrame:
        """``df`` with the index and the digits, as numbers that Spark ML takes as categories."""
        number = f"{self.column}_number"
        found = lookup(df, self.table.withColumnRenamed("number", number), [self.column], self.small)
        place = F.coalesce(number, F.lit(self.values).cast("long"))
        made = {self.index: F.least(place, F.lit(self.base - 1))}
        rest = F.greatest(place - (self.base - 1), F.lit(0).cast("long"))
        for k, name in enumerate(self.digit_columns):
            made[name] = F.floor(rest / F.lit(self.base**k)) % self.base
        kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
        return found.select(*kept, *(self._category(value, name) for name, value in made.items()))

    def _category(self, value, name):
        about = {"ml_attr": {"type": "nominal", "name": name, "num_vals": self.base}}
        return value.cast("double").alias(name, metadata=about)


def encode_category(df: DataFrame, column="location", base=32, digits=DIGITS, n=None) -> Encoding:
    """Number the values of ``column``; ``n`` names a column of counts."""
    ranks = location_ranks(df, column, n)
    table = stage(ranks.select(column, F.col(f"{column}_index").cast("long").alias("number")), "categories")
    return known_encoding(table, column, base, digits)


def known_encoding(table: DataFrame, column, base, digits) -> Encoding:
    values = table.count()
    if values >= base - 1 + base**digits:
        raise ValueError(f"{values} values of {column} need more than {digits} digits of base {base}")
    return Encoding(table, column, values, base, digits, fits_broadcast(table))
