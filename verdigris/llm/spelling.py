"""Groups of spelling variants by anagram hashing."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm._common import bound_batches, drop_staged, frequent_first, frequent_values, mix64, stage, text_slices, tidied, with_global_rank

#: Letters of words, the power of the anagram keys.
RUN = "[A-Za-zÀ-ÿ]+"
POWER = 5
LEAST_CHARS, LEAST_COUNT = 5, 3
#: A form occurs at least so many times as often as its variant.
TIMES = 2
#: One of so many (document, word) pairs has a letter deleted.
SLIPS = 97
#: Words whose counts a task holds before it passes them on.
HELD = 400_000
#: Radixes of the two fingerprints of letters in their order.
RADIXES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def document_words(doc_id, text: str, slips: int | None = SLIPS) -> Counter:
    """How often each word occurs in a text, in the letters that the document has it in.

    With ``slips`` a word loses the letter ``h % length`` in documents where ``slips`` divides h, the CRC-32 of ``<doc_id>:<word>``.
    """
    runs = Counter(re.findall(RUN.replace("+", f"{{{LEAST_CHARS},}}"), text.encode().lower().decode()))
    if not slips:
        return runs
    found: Counter = Counter()
    start = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % slips == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        found[run] += n
    return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = SLIPS) -> DataFrame:
    """``word, n`` over all texts: counted inside tasks, whose memory is bounded, then summed."""
    bound_batches(docs.sparkSession)

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            ids, at = batch.column(0), 0
            for texts in text_slices(batch.column(1)):
                for text in texts:
                    for word, n in document_words(ids[at].as_py(), text, slips).items():
                        counts[word] += n
                    at += 1
                    if len(counts) > HELD:
                        yield flush(counts)
                        counts = Counter()
        yield flush(counts)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _cumulative(values: np.ndarray, owner_start: np.ndarray) -> np.ndarray:
    """Sums of the values before each one inside its own word (modulo 2 ** 64)."""
    before = np.cumsum(values) - values
    return before - before[owner_start]


def anagram_rows(words: list[str]) -> tuple[np.ndarray, ...]:
    """For all words together: ``owner, place, key, first, second, opens``.

    The anagram key of a word is the sum of its letters' fifth powers. Each word gives a row for itself (place -1) and a row for each
    letter taken out (its place): the key without the letter's value and two fingerprints of the letters left, in their order. ``opens``
    says that the letter begins a run of equal letters: words that repeat a letter give the same rest more than once.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(codes)) - start
    value = codes**POWER
    key = np.zeros(len(words), np.uint64)
    np.add.at(key, owner, value)
    opens = np.append(True, codes[1:] != codes[:-1])[: len(codes)] | (place == 0)
    most = int(sizes.max(initial=0)) + 1
    prints = []
    for radix in RADIXES:
        steps = np.full(most, radix, np.uint64)
        steps[0] = 1
        powers = np.multiply.accumulate(steps)
        back = np.uint64(pow(radix, -1, 1 << 64))
        term = mix64(codes + np.uint64(radix & 0xFFFF)) * powers[place]
        whole = np.zeros(len(words), np.uint64)
        np.add.at(whole, owner, term)
        before = _cumulative(term, start)
        rest = before + (whole[owner] - before - term) * back  # letters behind the gap move up by one
        prints.append(np.append(whole, rest))
    return (
        np.append(np.arange(len(words)), owner),
        np.append(np.full(len(words), -1), place),
        np.append(key, key[owner] - value),
        *prints,
        np.append(np.zeros(len(words), bool), opens),
    )


def _anagram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "first", "second", "place", "opens", "n", "id"]
    for batch in batches:
        ids, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        at = 0
        for words in text_slices(batch.column(1), 100_000):
            owner, place, key, first, second, opens = anagram_rows(words)
            arrays = [key.view(np.int64), first.view(np.int64), second.view(np.int64), place.astype(np.int32), opens, n[at + owner], ids[at + owner]]
            for part in range(0, len(owner), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[part : part + 100_000]) for x in arrays], names=names)
            at += len(words)


def _summed(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def near_in_order(first: np.ndarray, place: np.ndarray, opens: np.ndarray, n: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """What the rows of equal rests say: ``id, count, best_n, best`` - how many near words, and the best of them.

    ``first`` numbers the groups of equal rests. Rows are in the order of group, place, falling n, id. Words that left one rest at one place
    differ by one exchanged letter; a word equal to a rest differs from the word that left it by one letter more or less.
    """
    out = []
    # Exchanges: runs of equal group and place.
    new = np.append(True, (first[1:] != first[:-1]) | (place[1:] != place[:-1]))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(first)))
    size, start = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    some = np.flatnonzero((size > 1) & (place >= 0))
    best = np.where(some == start[some], start[some] + 1, start[some])
    out.append((ids[some], size[some] - 1, n[best], ids[best]))
    # One letter more or less: groups that begin with a whole word.
    heads = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(first))))
    longer = np.flatnonzero((place >= 0) & opens & (place[heads][group] == -1))
    if len(longer):
        order = longer[np.lexsort((ids[longer], -n[longer], group[longer]))]
        begin = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
        top, count = order[begin], np.diff(np.append(begin, len(order)))
        short = heads[group[top]]
        out.append((ids[short], count, n[top], ids[top]))
        short = heads[group[longer]]
        out.append((ids[longer], np.ones(len(longer), np.int64), n[short], ids[short]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words from rows in the order of key, rest, place, n; a group that a batch may not end is held for the next.

    A group holds the words that are one letter away from one rest: at most its places times the letters there are.
    """
    held = None

    def found(rows):
        keys = rows[:3]
        new = np.append(True, np.any([x[1:] != x[:-1] for x in keys], axis=0))
        arrays = near_in_order(np.cumsum(new), *rows[3:])
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], names=["id", "near", "best_n", "best"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        last = np.all([x == x[-1] for x in rows[:3]], axis=0)
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield found([x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None:
        yield found(held)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """For each word of ``vocabulary`` (``id, word, n``; ids in the order of words) with near words: ``id, n_near, best_n, best``.

    Words whose anagram keys differ by a letter's value are met by taking each letter's value off each key: one is left with the other's
    key (a letter more or less), or both with the same (an exchange). So a word gives a row for each letter instead of one for each
    exchange of the alphabet. What meets by key is verified by the order of the letters left. A key that very many words share is dealt out
    by the letters' order as well, on which near words agree.
    """
    rows = stage(vocabulary.select("id", "word", "n").mapInArrow(tidied(_anagram_batches), "key long, first long, second long, place int, opens boolean, n long, id long"), "anagrams")
    hot = frequent_values(rows.select("key"), "key").withColumn("_hot", F.lit(True))
    dealt = rows.join(F.broadcast(hot), "key", "left").withColumn("_salt", F.when(F.col("_hot"), F.col("first")).otherwise(F.lit(0)))
    order = ["key", "first", "second", "place", F.col("n").desc(), "id"]
    met = dealt.repartition("key", "_salt").select("key", "first", "second", "place", "opens", "n", "id").sortWithinPartitions(*order)
    said = met.mapInArrow(tidied(_near_batches), "id long, near long, best_n long, best long")
    top = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("top")
    near = stage(said.groupBy("id").agg(F.sum("near").alias("n_near"), top), "near-words")
    drop_staged(rows, hot)
    return near.select("id", "n_near", (-F.col("top.m")).alias("best_n"), F.col("top.best").alias("best"))


def chain_ends(forms: DataFrame) -> DataFrame:
    """``id, root``: where following ``id, form`` (staged) ends. Each step counts twice as often, so chains are short; each round doubles the reach."""
    reached = stage(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = reached.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        hubs = frequent_values(reached, "root")
        moved = frequent_first(reached, ahead, "root", hubs).select("id", F.col("_next").alias("root"))
        still = reached.join(ahead.select("root").hint("merge"), "root", "left_anti").select("id", "root")
        if moved.isEmpty():
            drop_staged(hubs)
            return reached
        step = stage(moved.unionByName(still), "roots")
        drop_staged(reached, hubs)
        reached = step


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = SLIPS, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES
) -> DataFrame:
    """The words of all texts with the form that each is a variant of, and the root where forms end.

    Words are runs of letters (``RUN``), lower-cased in A-Z only, of at least ``least_chars`` code points that occur ``least_count`` times or more.
    Two words are near if one inserted, deleted or replaced code point makes one of the other (``near_words``). A word's form is its
    near word that occurs most (ties: the smallest in code-point order) if that occurs ``times`` as often as the word.

    Defined results: null and empty texts have no words. A null id stands in the slips' hash as the empty text; rows that repeat an id count
    each. A run of any length is a word: memory grows with its length, not with its square. Other columns are neither read nor
    returned. An empty table gives an empty result.

    Returns ``word, n, form, form_n, root, n_near``.
    """
    if least_chars < LEAST_CHARS:
        raise ValueError(f"words have {LEAST_CHARS} code points at least")
    counts = word_counts(docs, id_col, text_col, slips).where((F.col("n") >= least_count) & (F.char_length("word") >= least_chars))
    vocabulary = stage(with_global_rank(counts, ["word"], "id", "vocabulary"), "vocabulary")
    near = near_words(vocabulary)
    worded = vocabulary.join(near.hint("merge"), "id", "left")
    form = F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))
    decided = stage(worded.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), "forms")
    variants = decided.where(F.col("form").isNotNull())
    ends = chain_ends(stage(variants.select("id", "form"), "links"))
    linked = stage(variants.join(ends.hint("merge"), "id"), "linked")
    names = vocabulary.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    formed = stage(frequent_first(linked, names, "form"), "formed")
    rooted = frequent_first(formed, names.select(F.col("form").alias("root"), F.col("form_word").alias("root_word")), "root")
    out = rooted.select("word", "n", F.col("form_word").alias("form"), "form_n", F.col("root_word").alias("root"), "n_near")
    alone = decided.where(F.col("form").isNull()).select("word", "n", F.lit(None).cast("string").alias("form"), "form_n", F.col("word").alias("root"), "n_near")
    return out.unionByName(alone)
