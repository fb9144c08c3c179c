"""Blocks of HTML pages as columns: where they stand, their attributes, their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.text import strip_tags

#: Elements that begin a block of their own, and those of them that hold others.
BLOCKS = "address article aside blockquote body dd div dl dt footer h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
HOLDERS = "article aside blockquote div dl footer header main nav ol section table tr ul".split()
TAG = rf"(?i)<(/?(?:{'|'.join(sorted(BLOCKS, key=len, reverse=True))}))(?:\s([^>]*)|/?)>"
UNSEEN = r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->"
ATTRIBUTE = r"""([A-Za-z_:][A-Za-z0-9_:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: Signs that no page holds once they are taken out: before a block, and between its parts.
OPEN, PART = "\x01", "\x02"


def attributes(text: Column) -> Column:
    """The attributes of a tag as a map of lower-case names; of a name that repeats the first value counts."""
    each = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ATTRIBUTE), F.lit(k)) for k in range(1, 5)]
    made = F.transform(F.arrays_zip(*[x.alias(n) for x, n in zip(each, "nabc", strict=True)]), lambda x: F.struct(F.lower(x["n"]).alias("key"), F.concat(x["a"], x["b"], x["c"]).alias("value")))
    names = F.transform(made, lambda x: x["key"])
    return F.map_from_entries(F.filter(made, lambda x, i: F.array_position(names, x["key"]) == i + 1))


def blocks(html: Column) -> Column:
    """The blocks of a page that have a text, in order: structs ``place, tag, depth, attributes, text``.

    A block begins at the opening or closing tag of a block element and ends at the next; inline markup inside it goes, scripts, styles and
    comments are no text. ``tag`` is empty where text follows a closing tag. ``depth`` counts the open elements that hold
    others (``HOLDERS``), which pages close, unlike paragraphs and rows of lists. Null and empty pages have no blocks.
    """
    seen = F.regexp_replace(F.translate(F.coalesce(html, F.lit("")), OPEN + PART, "  "), UNSEEN, " ")
    pieces = F.split(F.concat(F.lit(PART * 2), F.regexp_replace(seen, TAG, f"{OPEN}$1{PART}$2{PART}")), OPEN)
    cut = F.transform(pieces, lambda piece: F.split(piece, PART, 3))
    named = F.transform(cut, lambda x: F.struct(F.lower(F.get(x, F.lit(0))).alias("tag"), F.get(x, F.lit(1)).alias("attributes"), strip_tags(F.get(x, F.lit(2))).alias("text")))
    opens = [F.lit(t) for t in HOLDERS]
    shuts = [F.lit(f"/{t}") for t in HOLDERS]
    zero = F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        depth = F.greatest(acc["depth"] + F.when(x["tag"].isin(opens), 1).when(x["tag"].isin(shuts), -1).otherwise(0), F.lit(0))
        return F.struct(depth.alias("depth"), F.concat(acc["all"], F.array(depth)).alias("all"))

    depths = F.aggregate(named, zero, step, lambda acc: acc["all"])
    whole = F.zip_with(named, depths, lambda x, d: F.struct(x["tag"].alias("tag"), x["attributes"].alias("attributes"), x["text"].alias("text"), d.alias("depth")))
    kept = F.filter(whole, lambda x: x["text"] != "")
    return F.transform(
        kept,
        lambda x, i: F.struct(
            i.alias("place"), F.when(x["tag"].startswith("/"), "").otherwise(x["tag"]).alias("tag"), x["depth"].alias("depth"), attributes(x["attributes"]).alias("attributes"), x["text"].alias("text")
        ),
    )


def paragraphs(html: Column) -> Column:
    """The texts of a page's paragraphs, list rows, cells and headings, in order."""
    wanted = ["p", "li", "td", "th", "pre", "blockquote", *[f"h{i}" for i in range(1, 7)]]
    return F.transform(F.filter(blocks(html), lambda x: x["tag"].isin(wanted)), lambda x: x["text"])
