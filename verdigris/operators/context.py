"""Chunks of documents, and the packing of chosen chunks into a context of bounded size."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP, LEAST = 1800, 300, 450
#: Where a provision begins, at the start of a line (fixed forms).
PROVISION = re.compile(r"(?im)^(?=\s*(?:art\.?\s*\d|§|par[aá]grafo\s+[uú]nico|[ivxlcdm]+\s*[-–—]|[a-z]\)))")


def _split(block: str, size: int, overlap: int) -> list[str]:
    """A block that is too long: its paragraphs, else its sentences, else windows."""
    for pattern in (r"\n\s*\n", r"(?<=[.!?;])\s+"):
        parts = [p.strip() for p in re.split(pattern, block) if p.strip()]
        if len(parts) > 1:
            return [x for p in parts for x in ([p] if len(p) <= size else _split(p, size, overlap))]
    return [block[i : i + size] for i in range(0, max(len(block) - overlap, 1), size - overlap)]


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """A text's chunks: provisions or paragraphs packed up to ``size``, each chunk led by the last blocks of the one
    before it as far as ``overlap`` allows. A chunk under ``least`` takes the next block even if it grows too long."""
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    blocks = [b.strip() for b in PROVISION.split(text) if b.strip()]
    if len(blocks) < 2:
        blocks = [b.strip() for b in re.split(r"\n\s*\n", text) if b.strip()]
    chunks: list[str] = []
    held: list[str] = []

    def length(parts: list[str]) -> int:
        return sum(map(len, parts)) + 2 * max(len(parts) - 1, 0)

    def flush(keep: bool) -> None:
        nonlocal held
        if held:
            chunks.append("\n\n".join(held))
        tail: list[str] = []
        while keep and len(tail) < len(held) - 1 and length([held[-1 - len(tail)], *tail]) <= overlap:
            tail.insert(0, held[-1 - len(tail)])
        held = tail

    for block in blocks:
        if len(block) > size:
            flush(False)
            parts = _split(block, size, overlap)
            chunks += parts
            continue
        if held and length([*held, block]) > size and length(held) >= least:
            flush(True)
        held.append(block)
    flush(False)
    return chunks


def chunk_documents(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``id, chunk_index, chunk_id, chunk``: packing is sequential inside a text, so texts are chunked in Arrow batches."""

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(split_text)

    rows = docs.select(id_col, F.posexplode(chunks(F.coalesce(F.col(text_col), F.lit("")))).alias("chunk_index", "chunk"))
    return rows.withColumn("chunk_id", F.concat(F.col(id_col).cast("string"), F.lit("::c"), F.col("chunk_index").cast("string")))


def zigzag(rank: Column, n: Column) -> Column:
    """Order first, last, second, last but one, ... for ranks from 1 to n."""
    return F.when(2 * rank <= n + 1, 2 * rank - 1).otherwise(2 * (n - rank + 1))


def pack_context(ranked: DataFrame, doc: str, rank: str, size: Column, budget: int, per_doc: int = 4, header: int = 40) -> DataFrame:
    """The rows of a short ranked list that fit a budget of characters, with their place.

    Rows are taken in zigzag order, at most ``per_doc`` of a document; documents follow by first appearance and each
    starts with a header. A row that doesn't fit ends its document, whose header stays; the next document goes on.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rows = ranked.withColumn("_size", size).withColumn("_z", zigzag(F.col(rank), n))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(doc).orderBy("_z"))).where(F.col("_k") <= per_doc)
    rows = rows.withColumn("_seen", F.min("_z").over(Window.partitionBy(doc)))
    # A document's rows fit as far as they go; what a document uses depends on those before it, so the list is folded in order.
    entry = F.struct("_seen", "_z", F.col(doc).alias("d"), F.col(rank).alias("r"), F.col("_size").alias("s"))
    listed = rows.agg(F.sort_array(F.collect_list(entry)).alias("l"))  # the context's candidates: a short list
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).cast("long").alias("seen"), F.lit(False).alias("shut"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["seen"] != x["_seen"]
        opens = fresh & (acc["used"] + header <= budget)
        used = F.when(opens, acc["used"] + header).otherwise(acc["used"])
        shut = F.when(fresh, ~opens).otherwise(acc["shut"])
        fits = ~shut & (used + x["s"] <= budget)
        return F.struct(
            F.when(fits, used + x["s"]).otherwise(used).cast("long").alias("used"),
            x["_seen"].cast("long").alias("seen"),
            (shut | ~fits).alias("shut"),
            F.when(fits, F.array_append(acc["kept"], x["r"].cast("int"))).otherwise(acc["kept"]).alias("kept"),
        )

    kept = listed.select(F.posexplode(F.aggregate("l", start, step)["kept"]).alias("place", rank))
    return ranked.join(kept, rank)


def cited_documents(ranked: DataFrame, doc: str, page: str, rank: str, score: str, top: int = 12) -> DataFrame:
    """The documents of the best rows in order of appearance, with their best score and pages in order."""
    rows = ranked.where(F.col(rank) <= top)
    pages = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(page).alias("p"))))
    cited = rows.groupBy(doc).agg(F.min(rank).alias("first_rank"), F.max(score).alias("best"), pages.alias("_p"))
    return cited.select(doc, "first_rank", "best", F.array_join(F.array_distinct(F.transform("_p", lambda x: x["p"])).cast("array<string>"), ",").alias("pages"))
