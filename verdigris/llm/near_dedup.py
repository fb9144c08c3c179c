"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banding, verified weighted Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm._common import bound_batches, drop_staged, frequent_first, frequent_left, frequent_values, hold, mix64, packed, stage, text_slices, tidied

WORDS = 5
THRESHOLD = 0.8
#: Samples of a signature, and rows of a band: 16 bands of 4. Two texts of weighted Jaccard similarity 0.8 share a
#: band with probability 1 - (1 - 0.8 ** 4) ** 16 = 0.9998.
SAMPLES, BAND = 64, 4
BANDS = SAMPLES // BAND
#: Signature places that candidates must share before their texts are compared. A pair of similarity 0.8 has 51 on
#: average with deviation 3.2, and fewer than these once in a million pairs.
AGREE = 36
#: Documents' share up to which all shingles count as equally rare: IDF = 1 + ln(N / max(df, RARE * N)).
RARE = 0.001
#: Rows of the table of random parameters that shingles are hashed to.
ROWS = 1 << 14
BLOCK = 256
#: The count-min sketch of document frequencies: rows, counters of a row, counters that travel together.
SKETCH_ROWS, SKETCH, TOGETHER = 2, 1 << 20, 1 << 12
#: Candidates that a task counts before it passes its counts on.
HELD = 1_000_000

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
RADIX = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2 ** 64."""
    made = []
    for base in (RADIX, pow(RADIX, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    return tuple(made)


def word_codes(text: str) -> np.ndarray:
    """A hash of each word (run of bytes other than ASCII white space) of the text in lower case, in its order.

    A word's polynomial in the radix is a difference of running sums, shifted to its start by the inverse's power.
    """
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = SPACES[data]
    edges = np.flatnonzero(np.diff(space))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(max(1 << 16, 1 << int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Shingler:
    """Shingle hashes of texts: runs of ``WORDS`` words in lower case; a shorter text is one shingle."""

    def all(self, text: str) -> np.ndarray:
        """The hashes in the text's order, repeated ones too."""
        codes = word_codes(text)
        if not len(codes):
            return codes
        size = min(WORDS, len(codes))
        mixed = np.zeros(len(codes) - size + 1, np.uint64)
        for k in range(size):
            mixed = mixed * np.uint64(RADIX) + codes[k : len(codes) - size + 1 + k]
        return mix64(mixed)

    def distinct(self, text: str) -> np.ndarray:
        """The distinct hashes, sorted."""
        found = np.sort(self.all(text))
        return found[np.append(True, found[1:] != found[:-1])] if len(found) else found

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes, sorted, and how often each occurs."""
        return np.unique(self.all(text), return_counts=True)


def _map_texts(docs: DataFrame, make, schema: str) -> DataFrame:
    """Run ``make()(batch, texts)``, which yields record batches, over slices of ``docs``, whose last column is the text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column(batch.num_columns - 1)):
                yield from work(batch.slice(at, len(texts)), texts)
                at += len(texts)
        if hasattr(work, "end"):
            yield from work.end()

    return docs.mapInArrow(tidied(run), schema)


def sketch_places(hashes: np.ndarray) -> list[np.ndarray]:
    """The counter of each hash in each row of the sketch: bits that neither ``Sampler`` nor the other row uses alone."""
    bits = SKETCH.bit_length() - 1
    return [(hashes >> np.uint64(64 - bits * (k + 1))).astype(np.int64) & (SKETCH - 1) for k in range(SKETCH_ROWS)]


class _Sketch:
    """The count-min sketch of a task's document frequencies: its size doesn't depend on the task's, and no count is lost."""

    def __init__(self):
        self.shingle, self.counts = Shingler(), np.zeros((SKETCH_ROWS, SKETCH), np.int64)
        self.parts: list[np.ndarray] = []
        self.docs = self.held = 0

    def __call__(self, _, texts):
        for text in texts:
            self.parts.append(self.shingle.distinct(text))
            self.docs += 1
            self.held += len(self.parts[-1])
            if self.held > HELD:
                self.merge()
        yield from ()

    def merge(self):
        for row, places in zip(self.counts, sketch_places(np.concatenate(self.parts)), strict=True):
            row += np.bincount(places, minlength=SKETCH)
        self.parts, self.held = [], 0

    def end(self):
        if self.docs:
            self.merge()
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if self.counts.max() <= np.iinfo(k).max)
            blocks = self.counts.reshape(-1, TOGETHER)
            some = np.flatnonzero(blocks.any(axis=1))
            contents = [pa.compress(blocks[i].astype(kind).tobytes(), "zstd", asbytes=True) for i in some]
            arrays = [pa.array(some), pa.array(np.full(len(some), np.dtype(kind).itemsize, np.int32)), pa.array(contents, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "bytes", "counts"])


def _full_counters(blocks: DataFrame, most: float) -> DataFrame:
    """The counters above ``most``: blocks meet by number and are summed as they pass, one array for each number that a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, size, counts in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                held = sums.setdefault(block, np.zeros(TOGETHER, np.int64))
                held += np.frombuffer(pa.decompress(counts, size * TOGETHER, "zstd"), f"u{size}").astype(np.int64)
        found = [block * TOGETHER + np.flatnonzero(held > most) for block, held in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], names=["counter"])

    return blocks.repartition("block").mapInArrow(run, "counter long")


class _CandidateCounts:
    """Document frequencies of the shingles whose counters are all full; passed on whenever many are held, so memory is bounded."""

    def __init__(self, full: np.ndarray):
        self.full, self.shingle = full, Shingler()
        self.parts: list[np.ndarray] = []
        self.held = 0

    def __call__(self, _, texts):
        for text in texts:
            found = self.shingle.distinct(text)
            likely = np.ones(len(found), bool)
            for row, places in zip(self.full, sketch_places(found), strict=True):
                likely &= row[places]
            self.parts.append(found[likely])
            self.held += len(self.parts[-1])
            if self.held > HELD:
                yield from self.end()

    def end(self):
        if self.held:
            found, times = np.unique(np.concatenate(self.parts), return_counts=True)
            self.parts, self.held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], names=["shingle", "df"])


def common_shingles(texts: DataFrame, rare: float = RARE) -> tuple[np.ndarray, np.ndarray, int]:
    """The shingles in more than the share ``rare`` of all documents, with their weights (IDF), and the number of documents.

    A count-min sketch over all documents, a fixed number of counters for each task, bounds each shingle's document frequency
    from above. Only shingles whose counters lie above ``rare`` of all documents can be common, and a second pass counts
    these exactly: nothing is dropped, whatever the split. There are at most 1 / ``rare`` times the mean number of shingles
    of a document that are common, whatever the corpus; only they go to the driver.
    """
    n = texts.count()
    local = _map_texts(texts, _Sketch, "block long, bytes int, counts binary")
    full = np.zeros(SKETCH_ROWS * SKETCH, bool)
    full[_full_counters(local, rare * n).toArrow().column("counter").to_numpy()] = True  # some of a fixed number of counters
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(full))
    unpacked = lambda: np.unpackbits(shared.value).astype(bool).reshape(SKETCH_ROWS, SKETCH)
    exact = _map_texts(texts, lambda: _CandidateCounts(unpacked()), "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df"))
    found = exact.where(F.col("df") > rare * n).toArrow()
    hashes = found.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], 1 + np.log(n / found.column("df").to_numpy().astype(float)[order]), n


class Weights:
    """TF-IDF weights of a text's shingles."""

    def __init__(self, common: np.ndarray, idf: np.ndarray, rare: float = RARE):
        self.common, self.idf, self.most = common, idf, 1 + np.log(1 / rare)
        self.shingle = Shingler()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found, times = self.shingle(text)
        return found, times * self.idf_of(found)

    def idf_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.full(len(hashes), self.most)
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        return np.where(self.common[at] == hashes, self.idf[at], self.most)

    def elements(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same weights as a set: one element of a shingle's IDF for each time that it occurs."""
        found, times = self.shingle(text)
        idf = self.idf_of(found)
        turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return mix64(np.repeat(found, times) + turn.astype(np.uint64)), np.repeat(idf, times)


@lru_cache(maxsize=2)
def _parameters(rows: int = ROWS, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The random numbers of improved consistent weighted sampling: r and c of Gamma(2, 1), b uniform (S. Ioffe, 2010)."""
    draw = np.random.Generator(np.random.PCG64(20100)).random((5, rows, samples))
    r = -np.log(1 - draw[0]) - np.log(1 - draw[1])
    c = np.log(-np.log(1 - draw[2]) - np.log(1 - draw[3]))
    return r, c, draw[4].copy()  # a view would keep all draws


def _sortable(x: np.ndarray) -> np.ndarray:
    """Numbers as uint64 with the same order, in the upper 32 bits."""
    bits = x.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)


class Sampler:
    """Signatures: for each of ``SAMPLES`` samplings the place (shingle and step) of the smallest ``a``.

    ln a = c - r (t - b) - r with t = floor(ln w / r + b). Shingles share the random numbers of a table's row; equal
    ``a`` are decided by the shingle's hash. A value joins ``a`` (32 bits) and the shingle (32 bits), so two texts agree in a
    place if and only if they sampled the same shingle at the same step. A signature holds 32 bits of each value, mixed: it proposes
    and sorts out candidates, which are then compared in full.
    """

    def __init__(self, usual: float):
        self.usual = usual
        hold("near", _parameters.cache_clear)
        r, c, b = _parameters()
        self.table = _sortable(self._log_a(r, c, b, np.log(usual)))

    @staticmethod
    def _log_a(r, c, b, log_w):
        return c - r * (np.floor(log_w / r + b) - b) - r

    def __call__(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
        row = (hashes % np.uint64(ROWS)).astype(np.int64)
        low = (hashes >> np.uint64(32)) & np.uint64(0xFFFFFFFF)
        usual = weights == self.usual
        for part in range(0, len(hashes), 4096):
            cut = slice(part, part + 4096)
            some = usual[cut]
            if some.any():
                np.minimum(out, (self.table[row[cut][some]] | low[cut][some, None]).min(axis=0), out=out)
            if not some.all():
                at = row[cut][~some]
                r, c, b = (x[at] for x in _parameters())
                value = _sortable(self._log_a(r, c, b, np.log(weights[cut][~some])[:, None]))
                np.minimum(out, (value | low[cut][~some, None]).min(axis=0), out=out)
        return (mix64(out) >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A hash of each band of a signature (its number is part of it)."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in signature.reshape(BANDS, BAND).T.astype(np.uint64):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights by sum of the larger ones; ``a`` and ``b``: sorted hashes, weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total else 0.0


class _Signer:
    """Signatures of texts, null for a text without words, beside the other columns."""

    def __init__(self, common: np.ndarray, idf: np.ndarray):
        self.weights = Weights(common, idf)
        self.sample = Sampler(self.weights.most)

    def __call__(self, batch, texts):
        signatures = []
        for text in texts:
            hashes, weights = self.weights(text)
            signatures.append(self.sample(hashes, weights).tobytes() if len(hashes) else None)
        arrays = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(signatures, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "signature"])


def _signature_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SAMPLES)


def _bander(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.array([band_keys(x) for x in _signature_rows(batch.column(1))], np.uint64).reshape(-1)
        ids = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.view(np.int64))], names=["id", "band"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        agree = (_signature_rows(batch.column(2)) == _signature_rows(batch.column(3))).sum(axis=1) >= AGREE
        yield batch.select([0, 1]).filter(pa.array(agree))


def _merge(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A sort-merge join, whatever the sizes: both sides grow with the corpus, so what a small one does is what a large one does."""
    return left.join(right.hint("merge"), key, how)


def verified(pairs: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """The pairs ``a, b`` of ids whose texts have at least the similarity asked for."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, last = Weights(*shared.value), (None, None)
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if last[0] != a.as_py():
                    last = (a.as_py(), weights(ta.as_py()))
                keep.append(weighted_jaccard(last[1], weights(tb.as_py())) >= threshold)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return _merge(_merge(pairs, left, "a"), right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def verified_stars(pairs: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """``verified`` for pairs (staged) of which very many may share a text, as the ends of a large bucket do.

    Such a text meets the others in blocks of ``BLOCK``: it is copied once for a block, not once for a pair, and no task holds more than a
    block of the pairs. What is shared by fewer pairs is compared pair by pair.
    """
    ends = pairs.select(F.col("a").alias("pivot")).unionByName(pairs.select(F.col("b").alias("pivot")))
    hubs = stage(ends.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "pivots")
    marked = pairs
    for side in ("a", "b"):
        marked = stage(frequent_left(marked, hubs.select(F.col("pivot").alias(side), F.col("n").alias(f"n{side}")), side), "starred")
    few = verified(marked.where("na IS NULL AND nb IS NULL").select("a", "b"), texts, shared, threshold)
    by_a = F.col("na").isNotNull()
    starred = marked.where("na IS NOT NULL OR nb IS NOT NULL").select(
        F.when(by_a, F.col("a")).otherwise(F.col("b")).alias("pivot"), F.when(by_a, F.col("b")).otherwise(F.col("a")).alias("other"), F.coalesce("na", "nb").alias("n")
    )
    block = F.pmod(F.xxhash64("other", F.lit(11)), F.ceil(F.col("n") / BLOCK))
    tasks = stage(starred.select(F.xxhash64("pivot", block).alias("task"), "pivot", "other"), "stars")
    one = tasks.select("task", F.lit(True).alias("outer"), F.col("pivot").alias("id")).distinct()
    rows = one.unionByName(tasks.select("task", F.lit(False).alias("outer"), F.col("other").alias("id"))).withColumn("root", F.col("id"))
    return few.unionByName(verified_blocks(stage(rows, "likely"), texts, shared, threshold))


def _across(rest: DataFrame, signatures: DataFrame) -> DataFrame:
    """Texts to compare, block by block: ``task, outer, id, root``.

    ``rest``: ``band, id, root, n`` of buckets with several components. Rows outside the bucket's largest component (``outer``)
    meet all rows of the bucket; a block holds about ``BLOCK`` rows and a task two blocks, of which those rows come out
    that agree with one of another component. A pair counts in the first band that it shares.
    """
    groups = rest.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size"))
    top = groups.groupBy("band").agg(F.max_by("root", F.struct("size", "root")).alias("top"), F.max("size").alias("most"))
    rows = _merge(rest.join(top, "band"), signatures, "id")
    nu, nm = F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("n") / BLOCK).cast("int")
    place = F.xxhash64("id", F.lit(7))
    entry = F.collect_list(F.struct("id", "root", "signature"))  # a block: its size is bounded by the number of blocks
    few = rows.where(F.col("root") != F.col("top")).groupBy("band", F.pmod(place, nu).cast("int").alias("u"), nm.alias("nm")).agg(entry.alias("us"))
    few = few.select("band", "u", "us", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("m"))
    many = rows.groupBy("band", F.pmod(place, nm).cast("int").alias("m")).agg(entry.alias("ms"))
    pairs = few.join(many, ["band", "m"]).select(F.xxhash64("band", "u", "m").alias("task"), "band", "us", "ms")
    return pairs.mapInArrow(_block_candidates, "task long, outer boolean, id long, root long")


def _block_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            (ids, roots, rows), (others, their, columns) = (
                (x.field("id").to_numpy(), x.field("root").to_numpy(), _signature_rows(x.field("signature")))
                for x in (batch.column(2)[k].values, batch.column(3)[k].values)
            )
            agree = np.zeros((len(ids), len(others)), np.int16)
            first = np.full(agree.shape, BANDS, np.int16)  # the first band that a pair shares
            for j in reversed(range(BANDS)):
                same = np.ones(agree.shape, bool)
                for place in range(j * BAND, (j + 1) * BAND):
                    equal = rows[:, place, None] == columns[None, :, place]
                    agree += equal
                    same &= equal
                first[same] = j
            band = np.flatnonzero(band_keys(rows[0]).view(np.int64) == batch.column(1)[k].as_py())[0]
            found = (agree >= AGREE) & (first == band) & (roots[:, None] != their[None, :])
            u, m = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
            task = np.full(len(u) + len(m), batch.column(0)[k].as_py(), np.int64)
            outer = np.arange(len(task)) < len(u)
            arrays = [pa.array(x) for x in (task, outer, np.append(ids[u], others[m]), np.append(roots[u], their[m]))]
            yield pa.RecordBatch.from_arrays(arrays, names=["task", "outer", "id", "root"])


def verified_blocks(rows: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """Links ``a, b`` between the outer and the other texts of each task: for each outer text one to each component.

    All pairs of a task are compared by one product of matrices: a shingle that occurs k times stands for k elements of its IDF,
    so that the sum of smaller weights is the IDF of the shared elements.
    """

    def run(table: pa.Table) -> pa.Table:
        weights = Weights(*shared.value)
        outer = table["outer"].to_numpy(zero_copy_only=False)
        ids, roots = table["id"].to_numpy(), table["root"].to_numpy()
        parts = [weights.elements(text.as_py()) for text in table["text"]]
        keys, column = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        owner = np.repeat(np.arange(len(parts)), [len(h) for h, _ in parts])
        idf = np.zeros(len(keys))
        idf[column] = np.concatenate([w for _, w in parts])
        total = np.bincount(owner, idf[column], len(parts))
        shared_weight = np.zeros((outer.sum(), (~outer).sum()))
        for start in range(0, len(keys), 8192):
            cut = (column >= start) & (column < start + 8192)
            has = np.zeros((len(parts), min(8192, len(keys) - start)), np.float64)
            has[owner[cut], column[cut] - start] = 1
            shared_weight += (has[outer] * idf[start : start + 8192]) @ has[~outer].T
        likeness = shared_weight / (total[outer][:, None] + total[~outer][None, :] - shared_weight)
        links = {}
        for u, m in zip(*np.nonzero(likeness >= threshold - 1e-12), strict=True):
            a, b = ids[outer][u], ids[~outer][m]
            if roots[outer][u] != roots[~outer][m]:
                links.setdefault((a, roots[~outer][m]), (min(a, b), max(a, b)))
        a, b = zip(*links.values(), strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _merge(rows, texts, "id").select("task", "outer", "id", "root", "text").groupBy("task").applyInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``id, root``: for each id in ``edges`` (``a, b``) the smallest id that it is connected with.

    Smallest labels spread along edges and by jumping to the label's own label. Each round is staged; the driver holds
    the number of changes only. Minima combine on the map side; the edges of an id with very many of them, and the ids of a large
    component, look up their label by broadcast (``frequent_first``), so no id is a hot key.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    hubs = frequent_values(both, "b")
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = frequent_first(both, labels.withColumnRenamed("id", "b"), "b", hubs).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = stage(labels.join(near, "id").select("id", "root", F.least("root", "near").alias("new")), "step")
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        moved = stage(frequent_first(step, jump, "new").select("id", "root", F.least("new", "far").alias("new")), "labels")
        done = moved.where(F.col("root") != F.col("new")).isEmpty()
        drop_staged(labels, step)
        labels = moved.select("id", F.col("new").alias("root"))
        if done:
            drop_staged(both, hubs)
            return labels


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The near-duplicate class of each row (staged): ``row, doc_id, digest, tid, root``.

    ``row`` numbers the input's rows and is all that the steps below know a row by, so ids may be null or repeat. ``tid`` is the row
    that stands for the row's text, ``root`` that which stands for the class.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    common, idf, _ = common_shingles(docs.select(text.alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast((common, idf))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = stage(_map_texts(rows, lambda: _Signer(*shared.value), f"row long, doc_id {kind}, digest binary, signature binary"), "signatures")
    # Of equal texts the row with the smallest id stands for all; a null id comes after the others.
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    twins = stage(signed.groupBy("digest").agg(F.min(rank).alias("best")).select("digest", F.col("best.row").alias("tid")), "twins")
    owner = stage(frequent_first(signed.select("row", "doc_id", "digest"), twins, "digest").select("row", "doc_id", "digest", "tid"), "owners")
    lone = signed.where(F.col("signature").isNotNull()).select(F.col("row").alias("id"), "signature")
    signatures = stage(_merge(lone, twins.select(F.col("tid").alias("id")), "id", "left_semi"), "signed")
    buckets = stage(signatures.mapInArrow(_bander, "id long, band long"), "bands")
    ends = buckets.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
    shared_buckets = stage(frequent_first(buckets, stage(ends.where("n > 1"), "ends"), "band"), "buckets")
    # Only these texts are compared; the whole table's texts are shuffled this once.
    wanted = stage(_merge(shared_buckets.select(F.col("id").alias("row")).distinct(), owner.select("row", F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")), "row"), "wanted")
    met = _merge(rows, wanted, "row").where((F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = stage(met.select(F.col("row").alias("id"), "text"), "texts")
    signatures = stage(_merge(signatures, wanted.select(F.col("row").alias("id")), "id", "left_semi"), "signed")
    if texts.count() != wanted.count():
        raise RuntimeError("the input's rows came in another order when read again: write it as a table first")
    star = shared_buckets.select("id", F.explode(F.array("low", "high")).alias("other")).where("id <> other")
    pairs = star.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    left = signatures.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    right = signatures.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    # The ends of large buckets stand in very many pairs: their signatures come by broadcast.
    one = stage(frequent_first(stage(pairs, "pairs"), left, "a"), "pairs")
    likely = stage(frequent_first(one, right, "b").select("a", "b", "sa", "sb").mapInArrow(_agreeing, "a long, b long"), "likely")
    links = stage(verified_stars(likely, texts, shared, threshold), "links")
    joined = components(links)
    root = F.coalesce("root", "id").alias("root")
    placed = stage(shared_buckets.where("n > 3").select("band", "id").join(joined, "id", "left").select("band", "id", root), "placed")
    mixed = stage(placed.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count(F.lit(1)).alias("n")).where("r <> s"), "mixed")
    rest = stage(frequent_first(placed, mixed, "band").select("band", "id", "root", "n"), "rest")
    more = verified_blocks(stage(_across(rest, signatures), "likely"), texts, shared, threshold)
    total = stage(links.unionByName(more), "links")
    roots = components(total)
    placed_rows = frequent_left(owner, roots.withColumnRenamed("id", "tid"), "tid")
    classes = stage(placed_rows.select("row", "doc_id", "digest", "tid", F.coalesce("root", "tid").alias("root")), "classes")
    drop_staged(one, likely, signed, twins, owner, signatures, buckets, shared_buckets, wanted, texts, links, placed, mixed, rest, total)
    return classes


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The near-duplicate class of each document: classes are connected by links of weighted Jaccard >= ``threshold``.

    1. Texts' shingles of five words weigh their number times IDF. Shingles common enough to weigh less are counted
       exactly over all documents (``common_shingles``); they are few, whatever the corpus, and broadcast.
    2. Each text gets a signature of consistent weighted samples and sixteen bands; identical texts stand for each
       other by digest and go on once.
    3. In each band's bucket every text is a candidate with the bucket's first and last text: two rows
       for each text and bucket, however large the bucket. Candidates whose signatures agree are compared in full.
    4. What these links leave in different components although it shares a bucket is compared too, block against block
       inside tasks: first signatures, then the texts that agree with one of another component. So no link that would join
       two classes is left out, no pairs come out of a task but links, and a group that is already connected costs nothing.

    Defined results: ids are integers. A null text counts as empty; empty texts equal each other and nothing else; texts of fewer
    than five words are one shingle; a document without links is its own class. Rows with null or repeated ids are rows like others, each
    in the class of its own text. A class is named by its smallest id; where that is null or names another class as well (ids that
    repeat), by a number above all ids. Other columns are neither read nor returned; an empty table gives an empty result.

    Returns ``doc_id, class_id, class_size`` and ``text_id`` (the smallest id of the same text), one row for each input row.
    """
    rows = near_rows(docs, id_col, text_col, threshold)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row")
    groups = stage(rows.groupBy("root").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("class_size")), "groups")
    # Of the classes with one and the same smallest id the first keeps it as a name.
    names = groups.where("first.id is not null").groupBy(F.col("first.id").alias("_id")).agg(F.min("first.row").alias("_first"))
    above = F.lit((rows.agg(F.max("doc_id")).first()[0] or 0) + 1)
    name = F.when(F.col("_first") == F.col("first.row"), F.col("first.id")).otherwise(above + F.col("first.row")).cast("long")
    named = groups.join(names, F.col("first.id") == F.col("_id"), "left").select("root", name.alias("class_id"), "class_size")
    ids = rows.where("row = tid").select("tid", F.col("doc_id").alias("text_id"))
    out = frequent_first(rows, stage(named, "named"), "root").select("doc_id", "tid", "class_id", "class_size")
    return frequent_first(stage(out, "named-rows"), stage(ids, "text-ids"), "tid").select("doc_id", "class_id", "class_size", "text_id")


def keep_one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate class, that of the smallest id, with all its columns.

    Rows are told apart by id and text, so rows that share an id stay or go by their own texts; a null id loses to any other. Of rows
    that repeat id and text one stays.
    """
    rows = near_rows(docs, id_col, text_col)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row"), F.col("digest"))
    heads = stage(rows.groupBy("root").agg(F.min(rank).alias("head")).select("root", F.col("head.id").alias("_id"), F.col("head.digest").alias("_digest"), F.col("head.row").alias("_row")), "heads")
    placed = stage(frequent_first(rows.select("row", "doc_id", "digest", "root"), heads, "root").where("row <> _row"), "followers")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    dropped = placed.where(~same).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_sha")).distinct()
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).cast("binary"), 256))
    kept = packed(docs).select("row", digest.alias("_digest"), F.col(f"row.`{id_col}`").alias("_key"))
    kept = kept.join(dropped, F.col("_digest").eqNullSafe(F.col("_sha")) & F.col("_key").eqNullSafe(F.col("_id")), "left_anti")
    if not placed.where(same).isEmpty():
        kept = kept.dropDuplicates(["_key", "_digest"])
    return kept.select("row.*")
