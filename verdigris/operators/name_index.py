"""A sorted table from tokens of names to rows: searches by a token's beginning are ranges of it."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import company_tokens, match_score
from verdigris.operators.lexical_index import input_version
from verdigris.session import shared_dir

#: Rows of a row group at most: a range reads the groups that it cuts.
ROW_GROUP = 1 << 18


def upper_bound(prefix: str) -> str | None:
    """The least text above all that begin with ``prefix``: the last character goes up by one; None if there is none."""
    kept = prefix.rstrip("\U0010ffff")
    return kept[:-1] + chr(ord(kept[-1]) + 1) if kept else None


def begins(column: str, prefix: str) -> Column:
    """Whether a column begins with a prefix, as a range that a scan can be pruned by."""
    top = upper_bound(prefix)
    low = F.col(column) >= prefix
    return low & (F.col(column) < top) if top else low


@dataclass(frozen=True)
class NameIndex:
    """``entries``: ``token, start, id`` in the order of tokens: the ends of each token of a name from each of its letters on (``start`` 0:
    the whole token). ``names``: ``id, tokens``, the tokens in the name's order."""

    entries: DataFrame
    names: DataFrame

    def with_prefix(self, word: str) -> DataFrame:
        """``id`` of the rows one of whose tokens begins with a word."""
        return self.entries.where((F.col("start") == 0) & begins("token", word)).select("id").distinct()

    def with_all(self, words: list[str], most: int = 6) -> DataFrame:
        """``id`` of the rows that hold a token beginning with each of the first words: the words' ranges are read once, their rows intersected by counting."""
        words = list(dict.fromkeys(words))[:most]
        if not words:
            return self.names.select("id").limit(0)
        hits = [F.when(begins("token", w), F.lit(1 << i)) for i, w in enumerate(words)]
        ranges = reduce(lambda a, b: a | b, [begins("token", w) for w in words])
        marks = self.entries.where((F.col("start") == 0) & ranges).groupBy("id").agg(*[F.max(h).alias(f"h{i}") for i, h in enumerate(hits)])
        return marks.where(reduce(lambda a, b: a & b, [F.col(f"h{i}").isNotNull() for i in range(len(words))])).select("id")

    def candidates(self, query: list[str]) -> DataFrame:
        """``id`` of all rows whose score for a query isn't 0.

        A row scores if a token begins with a word of the query, a word with a token, the query stands in the name, or the name in the
        query. Tokens that words hold are listed (a query's own letters bound them), the rest are ranges; a query of one word may stand inside a
        token, which the tokens' ends find.
        """
        words = [w for w in dict.fromkeys(query) if w]
        if not words:
            return self.names.select("id").limit(0)
        held = sorted({w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)})
        whole = (F.col("start") == 0) & reduce(lambda a, b: a | b, [begins("token", w) for w in words] + [F.col("token").isin(held)])
        inside = begins("token", words[0]) if len(query) == 1 else F.lit(False)
        return self.entries.where(whole | inside).select("id").distinct()

    def search(self, query: list[str], k: int) -> DataFrame:
        """``id, match`` of the best names for a query, ties by id: the same as scoring every name."""
        rows = self.names.join(self.candidates(query), "id", "left_semi")
        return rows.select("id", match_score(query, F.col("tokens")).alias("match")).where("match > 0").orderBy(F.desc("match"), "id").limit(k)


def build_name_index(rows: DataFrame, id_col: str, name: Column, path: str) -> None:
    """Write the index of a table of names under a path; null and empty names have no entries."""
    named = rows.select(F.col(id_col).alias("id"), company_tokens(name).alias("tokens")).where(F.size("tokens") > 0)
    named.write.mode("overwrite").parquet(f"{path}/names")
    tokens = rows.sparkSession.read.parquet(f"{path}/names").select("id", F.explode(F.array_distinct("tokens")).alias("whole"))
    ends = tokens.select("id", "whole", F.explode(F.sequence(F.lit(0), F.length("whole") - 1)).alias("start"))
    entries = ends.select(F.expr("substring(whole, start + 1)").alias("token"), "start", "id")
    sorted_rows = entries.repartitionByRange("token", "id").sortWithinPartitions("token", "id")
    sorted_rows.write.mode("overwrite").option("parquet.block.size", 8 * ROW_GROUP).parquet(f"{path}/entries")


def name_index_for(rows: DataFrame, id_col: str, name_col: str, folder: str | None = None) -> NameIndex:
    """The index of a table of names read from files: opened if one of this version of the files is there, else built first."""
    spark = rows.sparkSession
    version = hashlib.sha256(f"{input_version(rows)} {id_col} {name_col}".encode()).hexdigest()[:24]
    path = f"{folder or shared_dir(spark)}/name-index-{version}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/entries/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        build_name_index(rows, id_col, F.col(name_col), path)
    return NameIndex(spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/names"))
