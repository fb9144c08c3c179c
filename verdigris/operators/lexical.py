"""Tokens, positional postings, phrases, proximity and term counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import tokens


def with_tokens(texts: DataFrame, text_col: str = "text", name: str = "tokens") -> DataFrame:
    return texts.withColumn(name, tokens(F.col(text_col)))


def postings(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``token, id, positions, tf``: the positional index of a table of texts."""
    rows = with_tokens(texts, text_col).select(id_col, F.posexplode("tokens").alias("position", "token"))
    found = rows.groupBy("token", id_col).agg(F.sort_array(F.collect_list("position")).alias("positions"))
    return found.withColumn("tf", F.size("positions"))


def positions_of(words: Column, word: str) -> Column:
    """Places (from 0) of a word in a token array."""
    return F.filter(F.transform(words, lambda w, i: F.when(w == word, i)), lambda i: i.isNotNull())


def phrase_starts(words: Column, phrase: list[str]) -> Column:
    """Places at which a run of words begins."""
    n = len(phrase)
    target = F.array(*[F.lit(w) for w in phrase])
    starts = positions_of(words, phrase[0])
    return F.filter(starts, lambda i: F.slice(words, i + 1, n) == target)


def phrase_in(words: Column, phrase: list[str]) -> Column:
    # The first word is tested before any array is built.
    return F.array_contains(words, phrase[0]) & (F.size(phrase_starts(words, phrase)) > 0)


def near_in(words: Column, a: str, b: str, k: int) -> Column:
    """Whether two words stand at most ``k`` places apart, in either order."""
    there = positions_of(words, b)
    close = F.exists(positions_of(words, a), lambda i: F.exists(there, lambda j: F.abs(i - j) <= k))
    return F.array_contains(words, a) & F.array_contains(words, b) & close


def occurrences(words: Column, term: str) -> Column:
    return F.size(positions_of(words, term))


def term_pivot(texts: DataFrame, key: str, terms: list[str], text_col: str = "text") -> DataFrame:
    """One row for each key with the occurrences of each term and their total: sums of columns, no pivot's shuffle."""
    words = with_tokens(texts, text_col)
    sums = [F.sum(occurrences(F.col("tokens"), t)).alias(f"n_{t}") for t in terms]
    return words.groupBy(key).agg(*sums).withColumn("total", sum((F.col(f"n_{t}") for t in terms), F.lit(0)))


def documents_matching(chunks: DataFrame, doc_col: str, query, text_col: str = "text") -> DataFrame:
    """Documents that satisfy a ``DocumentQuery``: each term may be met by another chunk; an excluded term in any chunk
    excludes the document. One aggregation of one flag for each term, whatever their number."""
    from verdigris.plans.boolean_query import condition

    named = [(f"t{i}", t) for i, t in enumerate(query.terms)] + [(f"x{i}", t) for i, t in enumerate(query.exclude)]
    flags = [F.bool_or(condition(t, F.col("tokens"))).alias(name) for name, t in named]
    rows = with_tokens(chunks, text_col).groupBy(doc_col).agg(*flags)
    every = query.operator == "AND" or not query.terms
    keep = F.lit(every)
    for name, _ in named:
        if name[0] == "t":
            keep = keep & F.col(name) if every else keep | F.col(name)
    for name, _ in named:
        if name[0] == "x":
            keep = keep & ~F.col(name)
    return rows.where(keep).select(doc_col)


def document_texts(chunks: DataFrame, doc_col: str, order: list[str], text_col: str = "text") -> DataFrame:
    """``doc, text``: each document's chunks in order, joined by line breaks; a document bounds what is gathered."""
    entry = F.struct(*order, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    return chunks.groupBy(doc_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["_t"]), "\n").alias("text"))


def refined(base: DataFrame, refinements: list[DataFrame], key: list[str]) -> DataFrame:
    """What a base result and every active refinement have in common."""
    for refinement in refinements:
        base = base.join(refinement.select(*key).distinct(), key, "left_semi")
    return base


def by_name_or_content(names: DataFrame, contents: DataFrame, key: str) -> DataFrame:
    """Documents that match by name, by content, or by both, each once."""
    return names.select(key).unionByName(contents.select(key)).distinct()
