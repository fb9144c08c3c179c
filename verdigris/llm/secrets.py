"""Secret scan with multipart credential linking (native: DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm._spans import Pattern, find_spans, joined, kind_place

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    Pattern("assign", ASSIGN, (":", "=")),
    # A run shorter than asked for can't hold a long enough one, so the length stands in the pattern.
    Pattern("access", r"AKIA[A-Z0-9]{16,}", ("AKIA",)),
    Pattern("hex", r"[0-9a-f]{24,}"),
]
#: Weak parts, reported only beside their complements: a name for whom, something that looks like a key, a place.
WEAK = [
    Pattern(
        "ident",
        r"""(?i:(?:user(?:_?name|_?id)?|login|account|client_?id|access_?(?:key_?)?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""",
        (":", "="),
    ),
    Pattern("key", r"""(?i:(?:pass|pwd|auth|bearer|credentials?|private_?key|access_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", (":", "=")),
    Pattern("blob", r"[A-Za-z0-9+/_-]{20,}={0,2}", digits="[0-9]"),
    Pattern("endpoint", r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s"'<>]+""", ("://",)),
    Pattern("host", r"""(?i:(?:host(?:name)?|endpoint|server))["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]+)?""", (":", "=")),
]
#: Ends a scope: a blank line.
BREAK = Pattern("break", r"\n[\x20\t\r]*\n", ("\n",))
KINDS = [p.kind for p in BASE + WEAK]
IDENTIFIERS, SECRETS, ENDPOINTS = ["access", "ident"], ["assign", "hex", "key", "blob"], ["endpoint", "host"]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All reported spans of all texts; a text without any gives one row with null kind.

    Base kinds (``assign``, ``access``, ``hex``) are reported always. Weak kinds are parts of a credential that say little
    alone: an identifier, a secret or an endpoint. The text's scopes are its blocks between blank lines, and a scope
    bounds the join, however far apart its parts stand: an identifier or an endpoint needs a secret there and a secret an
    identifier or an endpoint, and the two must not overlap, as one string is no second part of itself. A part ends before
    another begins if and only if it ends before the last one of that role begins, so the least end and the greatest start of each
    role in the scope decide, with no pairs made however many parts it holds. Parts that are linked so, base kinds too, have
    the scope's number as their ``credential``. A weak span that overlaps a base span is dropped, as the base span reports
    it, and so is a ``blob`` that overlaps another weak span.

    Defined results: null and empty texts have no spans; ids may be null or repeated (each row stands alone); other
    columns are neither read nor returned; an empty table gives an empty result.

    Returns ``_row, doc_id, kind, match, start, end, weak, credential`` (null: not linked).
    """
    found = find_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", ["doc_id"], [*BASE, *WEAK, BREAK])
    value = F.regexp_extract("match", ASSIGN, 2)
    mixed = F.rlike("match", F.lit("[0-9]")) & F.rlike("match", F.lit("[A-Z]")) & F.rlike("match", F.lit("[a-z]"))
    fails = ((F.col("kind") == "assign") & (F.length(value) < 6)) | ((F.col("kind") == "blob") & ~mixed)
    # A failing match becomes a row without a kind, so that its text still has a row.
    gone = F.coalesce(fails, F.lit(False))
    found = found.select(
        "_row", "doc_id", *[F.when(~gone, F.col(c)).alias(c) for c in ("kind", "match", "start", "end")]
    )
    weak = F.col("kind").isin([p.kind for p in WEAK])
    row = Window.partitionBy("_row").orderBy(F.col("start").asc_nulls_first(), "end", "kind")
    back = Window.partitionBy("_row").orderBy(F.col("start").desc_nulls_last(), F.col("end").desc(), F.col("kind").desc())
    before, behind = row.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("kind").isin([p.kind for p in BASE])
    found = found.withColumn("_scope", F.count(F.when(F.col("kind") == "break", 1)).over(row))
    named = F.col("kind").isin([p.kind for p in WEAK if p.kind != "blob"])
    clear = F.lit(True)
    for name, over, when in (("base", base, F.lit(True)), ("named", named, F.col("kind") == "blob")):
        found = found.withColumn(f"_{name}_end", F.max(F.when(over, F.col("end"))).over(before))
        found = found.withColumn(f"_{name}_start", F.min(F.when(over, F.col("start"))).over(behind))
        free = F.coalesce(F.col(f"_{name}_end") <= F.col("start"), F.lit(True)) & F.coalesce(F.col(f"_{name}_start") >= F.col("end"), F.lit(True))
        clear = clear & (~when | free)
    found = found.withColumn("weak", weak).withColumn("_live", ~weak | clear)
    scope = Window.partitionBy("_row", "_scope")
    beside = {}
    for name, kinds in (("identifier", IDENTIFIERS), ("secret", SECRETS), ("endpoint", ENDPOINTS)):
        is_part = F.col("kind").isin(kinds) & F.col("_live")
        found = found.withColumn(f"_{name}_end", F.min(F.when(is_part, F.col("end"))).over(scope))
        found = found.withColumn(f"_{name}_start", F.max(F.when(is_part, F.col("start"))).over(scope))
        beside[name] = F.coalesce((F.col(f"_{name}_end") <= F.col("start")) | (F.col(f"_{name}_start") >= F.col("end")), F.lit(False))
    complemented = F.when(F.col("kind").isin(SECRETS), beside["identifier"] | beside["endpoint"]).otherwise(beside["secret"])
    reported = F.col("kind").isNotNull() & (F.col("kind") != "break") & (base | (F.col("_live") & complemented))
    found = found.withColumn("_linked", F.col("_live") & complemented)
    shown = [F.when(reported, F.col(c)).alias(c) for c in ("kind", "match", "start", "end", "weak")]
    numbered = with_credentials(found.select("_row", "doc_id", *shown, (F.col("_linked") & reported).alias("_linked"), "_scope"))
    return numbered.select("_row", "doc_id", "kind", "match", "start", "end", "weak", "credential")


def with_credentials(spans: DataFrame) -> DataFrame:
    """Number the linked spans of each text: the parts of a scope, in order, are cut into runs that are each a credential.

    A run ends before a part whose role it already has, once it holds a secret and another part that don't overlap; what is left at the
    end of a scope without such a pair belongs to the run before. So two logins with their passwords are two credentials, whichever
    comes first. One fold over the spans of a text, which lie together already.
    """
    bit = F.when(F.col("kind").isin(SECRETS), 1).when(F.col("kind").isin(IDENTIFIERS), 2).otherwise(4)
    part = F.struct("start", kind_place(KINDS, F.col("kind")).alias("k"), "end", "kind", "match", "weak", "_linked", "_scope", bit.alias("bit"))
    texts = spans.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(part)).alias("_parts"))
    far = F.lit(2**62)
    start = F.struct(
        F.lit(0).alias("n"), F.lit(-1).cast("long").alias("scope"), F.lit(0).alias("mask"), F.lit(True).alias("whole"), far.alias("secret"), far.alias("other"),
        F.array().cast("array<int>").alias("numbers"), F.array().cast("array<int>").alias("loose"),
    )

    def step(acc, x):
        moved = x["_scope"] != acc["scope"]
        new = moved | ((acc["mask"].bitwiseAND(x["bit"]) > 0) & acc["whole"])
        n = acc["n"] + F.when(new, 1).otherwise(0)
        secret, other = (F.when(new, far).otherwise(acc[name]) for name in ("secret", "other"))
        is_secret = x["bit"] == 1
        pair = F.when(is_secret, other <= x["start"]).otherwise(secret <= x["start"])
        after = F.struct(
            n.alias("n"),
            x["_scope"].cast("long").alias("scope"),
            F.when(new, x["bit"]).otherwise(acc["mask"].bitwiseOR(x["bit"])).alias("mask"),
            ((~new & acc["whole"]) | pair).alias("whole"),
            F.when(is_secret, F.least(secret, x["end"])).otherwise(secret).alias("secret"),
            F.when(is_secret, other).otherwise(F.least(other, x["end"])).alias("other"),
            F.concat(acc["numbers"], F.array(n)).alias("numbers"),
            F.when(moved & ~acc["whole"], F.concat(acc["loose"], F.array(acc["n"]))).otherwise(acc["loose"]).alias("loose"),
        )
        none = F.struct(*[acc[c].alias(c) for c in ("n", "scope", "mask", "whole", "secret", "other")], F.concat(acc["numbers"], F.array(F.lit(None).cast("int"))).alias("numbers"), acc["loose"].alias("loose"))
        return F.when(x["_linked"], after).otherwise(none)

    def finish(acc):
        loose = F.when(acc["whole"], acc["loose"]).otherwise(F.concat(acc["loose"], F.array(acc["n"])))
        return F.transform(acc["numbers"], lambda n: F.when(F.array_contains(loose, n), n - 1).otherwise(n))

    numbered = texts.withColumn("_numbers", F.aggregate("_parts", start, step, finish))
    rows = numbered.select("_row", "doc_id", F.explode(F.arrays_zip("_parts", "_numbers")).alias("_x"))
    return rows.select("_row", "doc_id", "_x._parts.*", F.col("_x._numbers").alias("credential"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts of the base kinds, the digest of the base spans, all spans as text, and the linked ones.

    ``credentials`` has ``credential:kind:start:end`` of each linked span; spans of one credential share the number, from 1 in a text.
    """
    spans = secret_spans(docs, id_col, text_col)
    entry = F.when(
        F.col("kind").isNotNull(), F.struct("kind", kind_place(KINDS, F.col("kind")).alias("k"), "start", "end", "weak", "credential")
    )
    rows = spans.groupBy("_row", "doc_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.count_if(F.col("weak")).alias("n_weak"),
        F.collect_list(entry).alias("_all"),
    )
    order = F.transform(F.filter("_all", lambda x: x["credential"].isNotNull()), lambda x: F.struct(*[x[c].alias(c) for c in ("start", "k", "end", "kind", "credential")]))
    said = lambda x: F.concat_ws(":", *[x[c].cast("string") for c in ("credential", "kind", "start", "end")])
    linked = F.array_join(F.transform(F.array_sort(order), said), ",")
    return rows.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(joined(F.filter("_all", lambda x: ~x["weak"]), False).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("_all"), False).alias("spans"),
        "n_weak",
        linked.alias("credentials"),
    )
