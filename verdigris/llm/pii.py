"""Personal data: pattern generators, boosted trees over format and context, calibrated thresholds (native)."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm._common import stage
from verdigris.llm._spans import Pattern, find_spans, joined, kind_place

MAIL = "A-Za-z0-9._%+-"
#: Possessive repeats and look-behinds keep the time linear in long runs; they match what the plain patterns match.
BASE = [
    Pattern("email", rf"(?:(?<![{MAIL}])|\G)[{MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",)),
    Pattern("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", (".",)),
    Pattern("card", r"[0-9](?:[\x20-]?[0-9])++", digits=r"[0-9][\x20-]?[0-9]"),
    Pattern("phone", r"\+[0-9][\x20().0-9-]+[0-9]", ("+",)),
]
#: How mails are written so that the base pattern misses them: ``name (at) example dot com``.
AT = r"\x20?(?:@|[(\[{]\x20?at\x20?[)\]}])\x20?"
DOT = r"(?:\.|\x20\.\x20|\x20dot\x20|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?)"
#: How national phones are grouped: three groups; a zero and pairs; a zero, a place and the rest; threes and pairs.
NATIONAL = (
    r"\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}", r"0[0-9](?:[\x20.-][0-9]{2}){4}", r"\(?0[0-9]{1,4}\)?[\x20/-][0-9]{5,8}",
    r"[0-9]{3}(?:[\x20.-][0-9]{2}){3}", r"00[1-9][0-9]{0,2}[\x20.-][0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){2,3}",
)
#: Generators with high recall: their spans overlap those of the base and each other, and count only if the trees say so.
MORE = [
    Pattern(
        "email_like",
        rf"(?<![{MAIL}])[{MAIL}]++(?:{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
        ("@", "at)", "at]", "at}", "at )", "at ]", "at }", " dot "),
    ),
    Pattern("phone_like", rf"(?<![0-9A-Za-z])(?<![0-9][./-])(?:{'|'.join(NATIONAL)})(?![0-9A-Za-z]|[./-][0-9])", digits="[0-9]{2}"),
    # Each card of a run of digits that the base takes for one number: in fours, in the groups of fifteen digits, or bare.
    Pattern("card_like", r"(?<![0-9])(?:[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]{13,19})(?![0-9])", digits="[0-9]{4}"),
    Pattern("number_like", r"(?<![0-9A-Za-z])[A-Z]{0,2}[0-9]{2,}(?:[\x20./-]?[0-9A-Z]{2,})++(?![0-9A-Za-z])", digits="[0-9]{2}"),
]
KINDS = [p.kind for p in BASE + MORE]
AROUND = 32
#: The mark that the base asks of a phone, as it stands before a candidate: features don't see it.
PLUS = r"\+[0-9]{1,3}[\x20.-]?$"
#: Digits in the form of a card; a candidate that reaches into such a run that fails the Luhn check isn't personal.
CARD_FORM = r"^(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$"
#: Dates, spans of years and amounts in thousands.
DATE_FORM = (
    r"^(?:(?:19|20)[0-9]{2}[./\x20-](?:0?[1-9]|1[0-2])[./\x20-](?:0?[1-9]|[12][0-9]|3[01])(?![0-9])|"
    r"[0-3]?[0-9][./\x20-][0-3]?[0-9][./\x20-](?:19|20)[0-9]{2}(?![0-9])|(?:19|20)[0-9]{2}(?:[./\x20-](?:19|20)[0-9]{2})+$|[0-9]{1,2}([.\x20])[0-9]{3}(?:\1[0-9]{3})*$)"
)
#: Letters and digits that a number of a person has at least.
SHORTEST = 7
HINTS = r"(?i)(tel|phone|call|mobile|fax|mail|contact|card|account|konto|iban|ssn|passport|karte|tarjeta|carte|correo|courriel|\bip\b|address)"
TREES, DEPTH = 10, 4
#: A threshold must have kept its precision on the calibrating candidates, of which enough lie above it.
PRECISION, ENOUGH = 0.98, 30


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def base_holds(kind: Column, match: Column) -> Column:
    """Whether a base match passes its kind's test."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(
        F.split(match, r"\."), lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.coalesce(F.left(F.ltrim(part, F.lit("0")), F.lit(4)).try_cast("int"), F.lit(0)) <= 255)
    )
    card = F.when((n >= 13) & (n <= 19), luhn(digits)).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", small).when(kind == "card", card).when(kind == "phone", (n >= 9) & (n <= 15)).otherwise(False)


def refuted(kind: Column, match: Column) -> Column:
    """Whether a candidate's own format says that it isn't personal data."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    card = F.rlike(match, F.lit(CARD_FORM)) & ~luhn(digits)
    address = F.rlike(match, F.lit(r"^[0-9]+(?:\.[0-9]+){3}$")) & ~base_holds(F.lit("ip"), match)
    several = (F.length(digits) > 19) & ~F.rlike(match, F.lit("[A-Za-z]"))  # more than one number
    number = (F.length(F.regexp_replace(match, "[^0-9A-Za-z]", "")) < SHORTEST) | F.rlike(match, F.lit(DATE_FORM)) | card | address | several
    return F.when(kind == "email_like", ~F.rlike(match, F.lit("[A-Za-z]{2,}$"))).otherwise(number)


def counterfeit(kind: Column, match: Column) -> Column:
    """What looks like a candidate but fails its format: a mail without a top-level name, an amount for a phone, an address
    out of range, a card with another last digit."""
    digits = F.left(F.regexp_replace(match, "[^0-9]", ""), F.lit(8))
    amount = F.regexp_replace(digits, F.lit("^([0-9]{2})([0-9]{3})([0-9]{3})$"), F.lit("$1.$2.$3"))
    address = F.rlike(match, F.lit(r"^[0-9]+(?:\.[0-9]+){3}$"))
    turned = F.concat(F.left(match, F.length(match) - 1), F.translate(F.right(match, F.lit(1)), "0123456789", "1234567890"))
    number = F.when(address, F.concat(F.lit("99"), match)).otherwise(turned)
    return F.when(kind == "email_like", F.regexp_replace(match, F.lit("[A-Za-z0-9-]+$"), F.lit("00"))).when(kind == "phone_like", amount).otherwise(number)


def features() -> dict[str, Column]:
    """Format and context of a candidate as numbers, without the marks by which the base knows its matches.

    A mail's ``(at)`` and ``dot`` count as the signs that they stand for, a country code before a phone isn't seen nor
    with what its groups are set apart, so that a base match and the same data in another form look alike.
    """
    plain_mail = F.regexp_replace(F.regexp_replace("match", F.lit(rf"{AT}|\x20at\x20"), F.lit("@")), F.lit(DOT), F.lit("."))
    groups = F.regexp_replace(F.regexp_replace("match", F.lit(r"^\("), F.lit("")), F.lit("[^0-9]+"), F.lit("-"))
    m = F.when(F.col("kind") == "email_like", plain_mail).when(F.col("kind") == "phone_like", groups).otherwise(F.col("match"))
    before, after = F.regexp_replace(F.coalesce("before", F.lit("")), F.lit(PLUS), F.lit("")), F.coalesce("after", F.lit(""))
    count = lambda pattern: F.regexp_count(m, F.lit(pattern)).cast("double")
    flag = lambda c: c.cast("double")
    plain = F.regexp_replace(m, "[^0-9]", "")
    out = {
        "size": F.least(F.length(m), F.lit(100)).cast("double"),
        "digits": F.least(count("[0-9]"), F.lit(50.0)),
        "letters": F.least(count("[A-Za-z]"), F.lit(50.0)),
        "runs": F.least(count("[0-9A-Za-z]+"), F.lit(20.0)),
        "dots": F.least(count(r"\."), F.lit(20.0)),
        "dashes": F.least(count("-"), F.lit(20.0)),
        "spaces": F.least(count(" "), F.lit(20.0)),
        "brackets": count(r"[(\[{]"),
        "luhn": flag(F.coalesce(F.when(F.length(plain).between(13, 19), luhn(plain)), F.lit(False))),
        "hint": flag(F.rlike(before, F.lit(HINTS)) | F.rlike(after, F.lit(HINTS))),
        "sign_before": flag(F.rlike(before, F.lit(r"[=:/#&%$*]\x20?$"))),
        "word_before": flag(F.rlike(before, F.lit(r"[A-Za-z]\x20$"))),
        "word_after": flag(F.rlike(after, F.lit(r"^\x20?[A-Za-z]"))),
        "end_after": flag(F.rlike(after, F.lit(r"^[.,;]?(\s|$)"))),
    }
    return out | {f"is_{p.kind}": flag(F.col("kind") == p.kind) for p in MORE}


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All spans of all generators, with ``base`` (a base match that passes), ``known`` (it overlaps one) and ``label``; staged.

    The label says whether the candidate itself is personal data: 1 where it is a whole base match (a phone's country
    code may be lacking), 0 where its format, or that of a card it reaches into, fails outside base matches. Others,
    such as forms that the base misses or parts of base matches, have none. A text without any has one row with null kind.
    """
    found = find_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", ["doc_id"], [*BASE, *MORE], AROUND, AROUND)
    found = found.withColumn("base", F.coalesce(base_holds(F.col("kind"), F.col("match")), F.lit(False)))
    ahead = Window.partitionBy("_row").orderBy(F.col("start").asc_nulls_first(), "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("_row").orderBy(F.col("start").desc_nulls_last(), F.col("end").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # A candidate overlaps a base span if one that begins before it reaches into it, or one that begins after it begins inside.
    found = found.withColumn("_e", F.max(F.when(F.col("base"), F.col("end"))).over(ahead))
    found = found.withColumn("_s", F.min(F.when(F.col("base"), F.col("start"))).over(behind))
    failed = (F.col("kind") == "card") & ~F.col("base") & F.rlike("match", F.lit(CARD_FORM))
    found = found.withColumn("_fe", F.max(F.when(failed, F.col("end"))).over(ahead)).withColumn("_fs", F.min(F.when(failed, F.col("start"))).over(behind))
    same_end = Window.partitionBy("_row", "end")
    lead = F.col("start") - F.max(F.when(F.col("base"), F.col("start"))).over(same_end)
    spare = F.max(F.when(F.col("base"), F.when(F.col("kind") == "phone", 5).otherwise(0))).over(same_end)
    found = found.withColumn("_whole", F.coalesce((lead >= 0) & (lead <= spare), F.lit(False)))
    known = F.coalesce(F.col("_e") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_s") < F.col("end"), F.lit(False))
    found = found.withColumn("known", known | F.col("base"))
    inside = F.coalesce(F.col("_fe") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_fs") < F.col("end"), F.lit(False))
    wrong = ~F.col("known") & (inside | refuted(F.col("kind"), F.col("match")))
    label = F.when(F.col("kind").isin([p.kind for p in MORE]), F.when(F.col("_whole"), 1.0).when(wrong, 0.0))
    return stage(found.withColumn("label", label).drop("_e", "_s", "_fe", "_fs", "_whole"), "candidates")


def first_and_longest(spans: DataFrame) -> DataFrame:
    """Of overlapping spans of a text the first and longest stays; what only a dropped one overlaps stays as well.

    Spans that hang together by overlaps are folded in order; no other spans of the text are gathered with them.
    """
    order = Window.partitionBy("_row").orderBy("start", F.col("end").desc(), "kind")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") < reached, 0).otherwise(1)
    runs = spans.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.struct("start", (-F.col("end")).alias("back"), "kind", F.struct(*spans.columns).alias("row"))
    runs = runs.groupBy("_row", "_run").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    kept = F.aggregate(
        "_parts",
        F.slice("_parts", 1, 1),
        lambda acc, x: F.when(x["start"] >= -F.element_at(acc, -1)["back"], F.concat(acc, F.array(x))).otherwise(acc),
    )
    return runs.select(F.explode(kept).alias("_part")).select("_part.row.*")


def select_spans(found: DataFrame) -> DataFrame:
    """The base spans and what the boosted trees add: ``_row, doc_id, kind, match, start, end, base``.

    The trees learn from the candidates that have a label whether format and context are those of personal data: all of them take part,
    one half (by a hash) fits the trees, the other calibrates the thresholds. What the base misses
    is in no class there, as it is what they are to judge. Each positive one has a counterfeit in
    its place beside it, so that there are negatives of each kind whatever the texts hold. A threshold for each kind is the lowest
    score whose precision held on labelled candidates not fitted on; a kind without such a score adds nothing. Candidates
    outside every base span that no format refutes and whose score reaches their kind's threshold are added; of
    overlapping ones the first and longest stays.
    """
    proposed = F.col("kind").isin([p.kind for p in MORE])
    weak = found.where(proposed & F.col("label").isNotNull())
    draw = F.pmod(F.xxhash64("doc_id", "start", "end", "kind"), F.lit(1 << 30)) / float(1 << 30)
    halves = weak.withColumn("fits", draw < 0.5)
    columns = features()
    made = lambda df: VectorAssembler(inputCols=list(columns), outputCol="features").transform(df.withColumns(columns))
    kind, match = F.col("kind"), F.col("match")
    false = halves.where("label = 1").withColumn("match", counterfeit(kind, match)).where(refuted(kind, match)).withColumn("label", F.lit(0.0))
    halves = stage(halves.unionByName(false), "halves")
    kinds = {r.label for r in halves.where("fits").select("label").distinct().collect()}
    plain = found.select("_row", "doc_id", *[F.when(F.col("base"), F.col(c)).alias(c) for c in ("kind", "match", "start", "end")], "base")
    if len(kinds) < 2:
        return plain
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, labelCol="label").fit(made(halves.where("fits")))
    score = F.round(vector_to_array("probability")[1] * 50).cast("int")
    judged = model.transform(made(halves.where("not fits"))).select("kind", score.alias("step"), "label")
    # At most 51 rows for each kind.
    table = judged.groupBy("kind", "step").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("all")).collect()
    limits = {}
    for kind in [p.kind for p in MORE]:
        good = total = 0
        for row in sorted((r for r in table if r.kind == kind), key=lambda r: -r.step):
            good, total = good + row.good, total + row["all"]
            if good >= PRECISION * total and total >= ENOUGH:
                limits[kind] = row.step
    if not limits:
        return plain
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    # The rows of a text stay whole: base spans, added spans, and one row that keeps a text without spans.
    outside = found.where(proposed & ~F.col("known") & F.col("label").isNull())
    added = model.transform(made(outside)).where(score >= limit[F.col("kind")])
    return plain.unionByName(first_and_longest(added.select("_row", "doc_id", "kind", "match", "start", "end", "base")))


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts of the base kinds, the digest of the base spans and all spans as text.

    Defined results: null and empty texts have no spans; ids may be null or repeat (each row stands alone); other
    columns are neither read nor returned; where no candidate is a base match, no trees are fitted and the
    base spans stand alone; an empty table gives an empty result.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``.
    """
    spans = select_spans(candidates(docs, id_col, text_col))
    entry = F.when(F.col("kind").isNotNull(), F.struct("kind", kind_place(KINDS, F.col("kind")).alias("k"), "start", "end", "base"))
    rows = spans.groupBy("_row", "doc_id").agg(
        *[F.count_if((F.col("kind") == p.kind) & F.col("base")).alias(f"n_{p.kind}") for p in BASE],
        F.count_if(F.col("kind").isNotNull() & ~F.col("base")).alias("n_added"),
        F.collect_list(entry).alias("_all"),
    )
    return rows.select(
        "doc_id",
        *[f"n_{p.kind}" for p in BASE],
        F.sha2(joined(F.filter("_all", lambda x: x["base"]), True).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("_all"), True).alias("spans"),
        "n_added",
    )
