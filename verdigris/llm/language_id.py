"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm._common import bound_batches, hold, mix64, stage, text_slices, tidied

ORDER = 5
#: Documents of each language, as expected, that the models are fitted on; further ones of the same number calibrate.
SAMPLE = 1000
#: Lengths (predicted characters) at which bands begin: short texts stray farther from their language's mean.
BANDS = (1, 16, 32, 64, 128, 256, 512)
#: The limit of a band lies above every calibrating text of the language, and if texts of other languages lie higher still, half-way
#: to what this share of them stays under; at least by this part of the language's own span above its mean.
FOREIGN_SHARE, ROOM = 0.05, 0.25
#: The score's odds are those of a text of at most this many characters, so that it doesn't say 1 for each longer text.
EVIDENCE = 50
#: Words whose rows a worker keeps.
MEMO = 300_000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+").findall
BASE = 0x9E3779B97F4A7C15


def fold(key: Column) -> Column:
    """CRC-32 of the key as text, modulo 4; a null key has none."""
    return F.crc32(key.cast("string").cast("binary")) % 4


def letter_runs(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    found = LETTERS(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # Signs such as superscript digits count as alphanumeric but aren't letters.
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def band_of(n: int) -> int:
    """The band of a text with ``n`` predicted characters."""
    return int(np.searchsorted(BANDS, n, side="right")) - 1


POWERS = [np.uint64(pow(BASE, n, 1 << 64)) for n in range(ORDER)]
TAGS = [np.uint64((n + 1) * 0xD6E8FEB86659FD93 % (1 << 64)) for n in range(ORDER)]


def gram_keys(codes: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that end at each place of a row of code points, for n from 1 to ORDER."""
    keys = np.zeros((ORDER, len(codes)), np.uint64)
    window = np.zeros(len(codes), np.uint64)
    for n in range(min(ORDER, len(codes))):
        window[n:] += (codes[: len(codes) - n] + np.uint64(1)) * POWERS[n]
        keys[n] = mix64(window + TAGS[n])
    return keys


def keys_of(grams: list[str]) -> np.ndarray:
    """The same hashes of n-grams of one length, as ``gram_keys`` gives at their last places."""
    if not grams:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(grams), -1)
    size = codes.shape[1]
    return mix64(((codes + np.uint64(1)) * np.array(POWERS[:size][::-1], np.uint64)).sum(axis=1, dtype=np.uint64) + TAGS[size - 1])


def places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of words between spaces, and how long the n-gram at each place may be: back to the space before the word."""
    place, spaces = np.arange(len(codes)), np.flatnonzero(codes == 32)
    lead = np.zeros(len(codes), np.int64)
    lead[spaces[1:]] = spaces[:-1]
    inner = codes != 32
    lead[inner] = np.maximum.accumulate(np.where(inner, 0, place))[inner]
    return gram_keys(codes), np.minimum(place - lead + 1, ORDER)


class Table:
    """A sorted array of hashes with their values, looked up by the hashes' leading bits and a few steps from there."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        self.shift = np.uint64(64 - max(1, int(len(hashes)).bit_length()))
        heads = (self.hashes >> self.shift).astype(np.int64)
        self.starts = np.searchsorted(heads, np.arange((1 << (64 - int(self.shift))) + 1))
        self.steps = int(np.diff(self.starts).max(initial=0))

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the table holds each key, and its value."""
        found, at = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        if len(self.hashes):
            heads = (keys >> self.shift).astype(np.int64)
            at, ends = self.starts[heads], self.starts[heads + 1]
            at = np.minimum(at, len(self.hashes) - 1)
            # Of the keys that begin alike the one at hand is smaller: a step on, for those that are left.
            left = np.flatnonzero((self.hashes[at] < keys) & (at + 1 < ends))
            while len(left):
                at[left] += 1
                left = left[(self.hashes[at[left]] < keys[left]) & (at[left] + 1 < ends[left])]
            found = self.hashes[at] == keys
        return found, self.values[at] if len(self.values) else np.zeros(len(keys))


@dataclass
class LanguageModel:
    """One language. ``grams[n - 1]``: sorted hashes of its n-grams and their log2 probabilities.

    ``rests[n - 1]``: the same for the contexts of n-grams, with the log2 weight of the shorter n-gram.
    """

    grams: list[Table]
    rests: list[Table]
    unseen: float  # log2 probability of a character that it never saw

    def log2_at(self, keys: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """log2 probability of the character at each of the places ``at`` after what stands before it."""
        found, p = self.grams[0].look(keys[0, at])
        score = np.where(found, p, self.unseen)
        live = np.arange(len(at))
        for n in range(2, ORDER + 1):
            live = live[reach[at[live]] >= n]
            known, rest = self.rests[n - 1].look(keys[n - 2, at[live] - 1])
            live, rest = live[known], rest[known]  # a context that the language lacks is no part of a longer one
            if not len(live):
                break
            found, p = self.grams[n - 1].look(keys[n - 1, at[live]])
            score[live] = np.where(found, p, rest + score[live])
        return score


@dataclass
class CharModels:
    """The models of all languages, and ``limits[i, band]``: the cross-entropy up to which a text is accepted as language i."""

    langs: list[str]
    models: list[LanguageModel]
    limits: np.ndarray | None = None

    def word_rows(self, words: list[str]) -> np.ndarray:
        """For each word: log2 likelihood in each language and the number of predicted characters (with the space after it)."""
        codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        keys, reach = places(codes)
        longest = keys[reach - 1, np.arange(len(codes))]
        _, first, back = np.unique(longest[1:], return_index=True, return_inverse=True)
        spaces = np.flatnonzero(codes == 32)
        rows = np.zeros((len(words), len(self.models) + 1))
        for i, model in enumerate(self.models):
            score = model.log2_at(keys, first + 1, reach)[back]
            rows[:, i] = np.add.reduceat(score, spaces[:-1])  # places are shifted by the first space, which nothing predicts
        rows[:, -1] = np.diff(spaces)
        return rows


def gram_tables(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kneser-Ney tables from ``lang, word, times``: ``lang, gram, p`` and ``lang, n, context, rest``.

    A word stands between two spaces; n-grams reach back to the space before it at most. An n-gram of the highest
    order, or one that begins with the space, has its count; a shorter one the number of characters that occur before it.
    With d the order's discount, n1 / (n1 + 2 n2) from the numbers of n-grams counted once and twice (0.5 without
    any counted once; at most 0.999),
    p(c|h) = (count(hc) - d) / count(h) + rest(h) p(c|h without its first character), rest(h) = d types(h) / count(h).
    The unigrams share their rest evenly with one character never seen.
    """
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    ends = F.sequence(F.lit(2), F.length("s"))
    grams = F.flatten(
        F.transform(ends, lambda e: F.transform(F.sequence(F.lit(1), F.least(e, F.lit(ORDER))), lambda n: F.substring(F.col("s"), e - n + 1, n)))
    )
    raw = words.select("lang", "times", padded.alias("s")).select("lang", "times", F.explode(grams).alias("gram"))
    raw = stage(raw.groupBy("lang", "gram").agg(F.sum("times").alias("raw")), "grams")
    n = F.length("gram")
    before = raw.where(n > 1).groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("before"))
    counts = raw.join(before, ["lang", "gram"], "left").select(
        "lang",
        "gram",
        n.alias("n"),
        F.when((n == ORDER) | (F.col("gram").startswith(" ") & (n > 1)), F.col("raw")).otherwise(F.col("before")).cast("double").alias("c"),
        F.expr("substring(gram, 1, length(gram) - 1)").alias("context"),
        F.expr("substring(gram, 2)").alias("shorter"),
    )
    counts = stage(counts, "counts")
    once, twice = F.count_if(F.col("c") == 1).cast("double"), F.count_if(F.col("c") == 2).cast("double")
    # A row for each language and order.
    discounts = counts.groupBy("lang", "n").agg(F.when(once > 0, F.least(once / (once + 2 * twice), F.lit(0.999))).otherwise(0.5).alias("d"))
    totals = counts.groupBy("lang", "n", "context").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"))
    rests = stage(totals.join(F.broadcast(discounts), ["lang", "n"]).withColumn("rest", F.col("d") * F.col("types") / F.col("total")), "rests")
    own = counts.join(rests, ["lang", "n", "context"]).withColumn("own", (F.col("c") - F.col("d")) / F.col("total"))
    own = stage(own.select("lang", "n", "gram", "shorter", "own", "rest", "types"), "own")
    level = own.where("n = 1").select("lang", "gram", (F.col("own") + F.col("rest") / (F.col("types") + 1)).alias("p"))
    level = tables = stage(level, "level")
    for order in range(2, ORDER + 1):
        lower = level.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("lower"))
        level = own.where(F.col("n") == order).join(lower, ["lang", "shorter"])
        level = stage(level.select("lang", "gram", (F.col("own") + F.col("rest") * F.col("lower")).alias("p")), "level")
        tables = tables.unionByName(level)
    alone = F.when(F.col("n") == 1, F.col("rest") / (F.col("types") + 1)).otherwise(F.col("rest"))
    return tables, rests.select("lang", "n", "context", alone.alias("rest"))


def _hashed(rows: DataFrame, gram: str, value: str, langs: list[str]) -> dict[str, np.ndarray]:
    """The columns ``lang`` (its place in the list), ``n, key, value``: n-grams as hashes, so the driver gathers a few bytes of each."""
    place = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(1).to_pylist()
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            keys = np.zeros(len(grams), np.uint64)
            for n in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == n)
                keys[at] = keys_of([grams[i] for i in at])
            known = np.array([place[lang] for lang in batch.column(0).to_pylist()], np.int16)
            arrays = [pa.array(known), pa.array(sizes.astype(np.int8)), pa.array(keys.view(np.int64)), pa.array(batch.column(2).to_numpy().astype(np.float32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "n", "key", "value"])

    made = rows.select("lang", gram, F.col(value).cast("double").alias("value")).mapInArrow(run, "lang short, n byte, key long, value float").toArrow()
    return {name: made.column(name).to_numpy() for name in made.column_names}


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> CharModels:
    """Fit the models on about ``sample`` documents of each language and calibrate on about as many others.

    The documents are those of folds 0 and 1 (fit) and 3 (calibrate) whose id's hash lies under the share that
    brings the number; a language with fewer gives all. The tables hold what so many documents contain, whatever the corpus.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (fold(F.col(id_col)) != 2))
    known = known.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (fold(F.col(id_col)) == 3).alias("calibrates"))
    sizes = known.groupBy("lang", "calibrates").count()
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count"))
    draw = F.pmod(F.xxhash64(F.col("_id"), F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    # Two rows for each language; the driver gathers a model of each anyway, which is some thousands of times as much.
    drawn = known.join(F.broadcast(sizes), ["lang", "calibrates"]).where(draw < share)
    runs = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    words = drawn.where(~F.col("calibrates")).select("lang", runs).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("times"))
    tables, rests = gram_tables(words)
    # Bounded by the sample: the n-grams of so many documents, 15 bytes each.
    langs = sorted(r.lang for r in tables.select("lang").distinct().collect())
    if not langs:
        return CharModels([], [])
    grams, rests = _hashed(tables, "gram", "p", langs), _hashed(rests, "context", "rest", langs)
    models = CharModels(langs, [_model(grams, rests, i) for i in range(len(langs))])
    models.limits = _limits(models, drawn.where("calibrates"))
    return models


def _model(grams: dict[str, np.ndarray], rests: dict[str, np.ndarray], lang: int) -> LanguageModel:
    def table(rows: dict[str, np.ndarray], n: int) -> Table:
        some = (rows["lang"] == lang) & (rows["n"] == n)
        return Table(rows["key"][some].view(np.uint64), np.log2(rows["value"][some].astype(float)))

    # The context of an n-gram has n - 1 characters; that of a unigram, none, says what a character never seen gets.
    unseen = rests["value"][(rests["lang"] == lang) & (rests["n"] == 0)]
    return LanguageModel([table(grams, n) for n in range(1, ORDER + 1)], [table(rests, n - 1 if n > 1 else -1) for n in range(1, ORDER + 1)], float(np.log2(unseen[0])))


def _limits(models: CharModels, drawn: DataFrame) -> np.ndarray:
    """Limits of the cross-entropy by language and band, from labelled texts that the models haven't seen.

    A language's own texts say how far up it reaches. Texts of the other languages, scored as if theirs had no model, stand for
    what no model knows: for each of them the best of the other models' cross-entropies.
    """
    scored = _score(drawn, models, ["lang"]).where("n_predicted > 0").withColumn("right", F.col("lang") == F.col("lang_pred"))
    cut = lambda c: F.greatest(F.lit(0), *[F.when(c >= b, i).otherwise(0) for i, b in enumerate(BANDS)])
    scored = stage(scored.withColumn("band", cut(F.col("n_predicted"))), "calibration")
    own = scored.where("right").groupBy("lang", "band").agg(F.avg("cross_entropy").alias("mean"), F.max("cross_entropy").alias("top"))
    other = scored.where("right and second is not null").groupBy("second", "band").agg(F.percentile_approx("second_entropy", FOREIGN_SHARE, 1000).alias("low"))
    place = {lang: i for i, lang in enumerate(models.langs)}
    mean, top, low = (np.full((len(place), len(BANDS)), np.nan) for _ in range(3))
    for r in own.collect():  # a row for each language and band, as below
        mean[place[r.lang], r.band], top[place[r.lang], r.band] = r["mean"], r.top
    for r in other.collect():
        low[place[r.second], r.band] = r.low
    limits = np.full(mean.shape, np.inf)
    for i in range(len(place)):
        reach = -np.inf
        # From long texts to short ones: what a long text may have a short one may have too.
        for band in range(len(BANDS) - 1, -1, -1):
            if np.isfinite(top[i, band]):
                reach = max(reach, top[i, band] + ROOM * (top[i, band] - mean[i, band]))
                gap = low[i, band] if np.isfinite(low[i, band]) else np.nanmin(low[:, band], initial=np.inf)
                between = (top[i, band] + gap) / 2 if np.isfinite(gap) else -np.inf
                limits[i, band] = max(reach, between)
    # A band without calibrating texts takes the limit of the next shorter one that has some, else the next longer one's.
    for i in range(len(place)):
        for order in (range(1, len(BANDS)), range(len(BANDS) - 2, -1, -1)):
            step = -1 if order.step > 0 else 1
            for band in order:
                if not np.isfinite(limits[i, band]):
                    limits[i, band] = limits[i, band + step]
    return limits


VERDICT = (
    ("lang_pred", T.StringType(), pa.string()),
    ("score", T.DoubleType(), pa.float64()),
    ("cross_entropy", T.DoubleType(), pa.float64()),
    ("n_predicted", T.LongType(), pa.int64()),
    ("accepted", T.BooleanType(), pa.bool_()),
    ("second", T.StringType(), pa.string()),
    ("second_entropy", T.DoubleType(), pa.float64()),
)


def _score(rows: DataFrame, models: CharModels, carry: list[str]) -> DataFrame:
    """The fields of ``VERDICT`` beside the columns of ``carry``; ``rows`` has ``text``, which is not returned."""
    bound_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(models)
    picked = rows.select(*carry, "text")
    schema = T.StructType([f for f in picked.schema.fields if f.name != "text"])
    for name, kind, _ in VERDICT:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            made = [row for texts in text_slices(batch.column(batch.num_columns - 1)) for row in scorer.judge(texts)]
            columns = list(zip(*made, strict=True)) or [()] * len(VERDICT)
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays += [pa.array(c, t) for c, (_, _, t) in zip(columns, VERDICT, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return picked.mapInArrow(tidied(run), schema)


NO_VERDICT = (UNKNOWN, 0.0, None, 0, False, None, None)


class _Scorer:
    """Scores texts by the rows of their words, which are kept for the words seen last."""

    def __init__(self, models: CharModels):
        self.models = models
        hold("language", lambda: None)  # nothing is kept from task to task
        self.start()

    def start(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.models.langs) + 1))

    def judge(self, texts: list[str]) -> list[tuple]:
        """A tuple of the fields of ``VERDICT`` for each text; words that no text had before are scored together."""
        runs = [letter_runs(text) for text in texts]
        if not self.models.langs:
            return [NO_VERDICT] * len(texts)
        if len(self.place) > MEMO:
            self.start()
        fresh = list(dict.fromkeys(w for run in runs for w in run if w not in self.place))
        if fresh:
            begin = len(self.place)
            self.place.update(zip(fresh, range(begin, begin + len(fresh)), strict=True))
            if len(self.place) > len(self.rows):
                grown = np.zeros((2 * len(self.place), self.rows.shape[1]))
                grown[:begin] = self.rows[:begin]
                self.rows = grown
            for part in range(0, len(fresh), 20_000):
                words = fresh[part : part + 20_000]
                self.rows[begin + part : begin + part + len(words)] = self.models.word_rows(words)
        place = self.place.__getitem__
        return [self._verdict(self.rows[np.fromiter(map(place, run), np.int64, len(run))]) if run else NO_VERDICT for run in runs]

    def _verdict(self, rows: np.ndarray) -> tuple:
        total = rows.sum(axis=0)
        n = int(total[-1])
        bits = -total[:-1] / n
        best = int(np.argmin(bits))
        score = 1 / float(np.exp2(np.minimum((bits[best] - bits) * min(n, EVIDENCE), 0)).sum())
        accepted = self.models.limits is None or bool(bits[best] <= self.models.limits[best, band_of(n)])
        langs = self.models.langs
        if len(langs) == 1:
            return (langs[best], score, float(bits[best]), n, accepted, None, None)
        bits[best], least = np.inf, float(bits[best])
        second = int(np.argmin(bits))
        return (langs[best], score, least, n, accepted, langs[second], float(bits[second]))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Predict the language of each whole text; nothing but the training's small tables is shuffled.

    Each language has an interpolated Kneser-Ney model of the characters of its words. A text's runs of letters are
    scored in all models; the lowest cross-entropy for each character wins. The text is rejected (``accepted``
    false) if its cross-entropy lies above the limit of its language for texts about as long: above every calibrating text of the
    language and, where other languages' texts lie higher still, half-way to them (``_limits``). Labels are learnt from the rows of
    folds 0, 1 and 3 of the id's CRC-32 only.

    Defined results: a null text, and one without letters, is ``und`` with score 0 and rejected; so is every text if no
    row can be learnt from. Without calibrating texts nothing else is rejected. A row with null id or null language is predicted but not learnt from (null id: ``held_out``
    false). Equal scores go to the language first by code point. Rows may repeat and count each; other columns are neither read nor
    returned; an empty table gives an empty result.

    Returns ``doc_id, held_out, lang_pred, score, cross_entropy, n_predicted, accepted, second, second_entropy``.
    """
    models = train(docs, id_col, text_col, lang_col, sample)
    held_out = F.coalesce(fold(F.col(id_col)) == 2, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return _score(rows, models, ["doc_id", "held_out"])


def keep_known_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text the language identification accepts, with all their columns.

    Rows pass through the workers in batches of bounded bytes; none waits beside them, as it would for a function of one column.
    Defined results are those of ``language_id``: texts that are null or have no letters go, whatever else their row holds.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))
    place = docs.columns.index(text_col)
    accepted = [name for name, _, _ in VERDICT].index("accepted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            keep = [row[accepted] for texts in text_slices(batch.column(place)) for row in scorer.judge(texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
