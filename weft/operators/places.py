"""Countries in addresses, by a table of spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.errors import need_columns
from weft.operators.skew import BROADCAST_ROWS, join_table
from weft.runtime import checkpoint


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _address(c: Column) -> Column:
    """An address in upper case without mail addresses, digits and signs but ``&``, full stops and commas."""
    text = F.upper(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"\S+@\S+", " "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[^A-Z&., ]", " "), " +", " "), "^[ .,]+|[ .,]+$", "")


def affiliation_countries(df: DataFrame, id_col: str, column: str, aliases: DataFrame, alias_col: str = "alias", country_col: str = "country") -> DataFrame:
    """``(id, countries)``: the countries that the addresses of a cell end with, each once, in their order.

    Addresses are separated by ``;`` or line breaks; the longest spelling that an address ends
    with, after a blank or a comma or from its start, decides. Cells without a known one have an
    empty list. ``aliases`` is a table of spellings; a spelling of several countries means the least.
    """
    need_columns("affiliation_countries", "columns", df, [id_col, column])
    need_columns("affiliation_countries", "aliases", aliases, [alias_col, country_col])
    spelling = F.regexp_replace(F.trim(F.upper(_col(alias_col))), " +", " ")
    table = aliases.groupBy(spelling.alias("alias")).agg(F.min(_col(country_col)).alias("country")).where(F.length("alias") > 1)
    parts = df.select(_col(id_col).alias("id"), F.posexplode_outer(F.split(_col(column).cast("string"), r"[;\n]+")).alias("at", "part"))
    parts = parts.withColumn("address", _address(F.col("part")))
    # every end of an address: what follows a blank or a comma, and all of it
    ends = parts.select("id", "at", F.explode(F.concat(F.array("address"), F.transform(F.split("address", "(?<=[ ,])"), lambda w, i: F.array_join(F.slice(F.split(F.col("address"), "(?<=[ ,])"), i + 1, 10_000), "")))).alias("alias"))
    # few spellings end very many addresses: they are taken to the addresses, or dealt out
    table = checkpoint(table)
    known = table.count()
    if known > BROADCAST_ROWS:
        sizes = checkpoint(ends.groupBy("alias").agg(F.count(F.lit(1)).alias("n")))
        rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    else:
        sizes, rows = table, 0
    found = join_table(ends, table, "alias", sizes, known, rows).groupBy("id", "at").agg(F.max_by("country", F.length("alias")).alias("country"))
    first = found.groupBy("id", "country").agg(F.min("at").alias("at")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "country"))), lambda x: x["country"]).alias("countries"))
    ids = df.select(_col(id_col).alias("id")).distinct()
    return ids.join(first, "id", "left").select("id", F.coalesce("countries", F.array().cast("array<string>")).alias("countries"))
