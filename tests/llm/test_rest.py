"""Language, vectors, shards, archives, tokens and mixing against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from verdigris.llm import bpe, warc
from verdigris.llm.hilbert import curve, hilbert_shards, name_edges
from verdigris.llm.language_id import ORDER, Table, gram_tables, language_id, letter_runs
from verdigris.llm.mixing import mix_sources, mixed_documents
from verdigris.llm.vp_tree import LEAF, VpTree, nearest

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_language_on_held_out_rows(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "ti", "no", "mu", "se"], "bb": ["str", "ong", "ach", "tz", "ell"], "cc": ["ça", "è", "eau", "oi", "ñu"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 30)))
        rows.append((i, text, lang, 1))
    rows += [(1000, None, "aa", 1), (1001, "", "aa", 1), (1002, "123 !? ²", "aa", 1), (1003, "kati nomu " * 20_000, None, 1), (1004, "ZQXJ WVBK" * 50, None, 1), (None, "kati nomu", "aa", 1)]
    got = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    truth = {r[0]: r[2] for r in rows[:600]}
    for i in truth:
        assert by_id[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [i for i in truth if by_id[i].held_out]
    assert np.mean([by_id[i].lang_pred == truth[i] for i in held]) >= 0.98
    assert np.mean([by_id[i].accepted for i in held]) >= 0.98
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].accepted) == ("und", False)
    assert by_id[1003].lang_pred == "aa" and by_id[1003].accepted and not by_id[1004].accepted
    assert all(0 <= r.score <= 1 for r in got) and by_id[None].held_out is False


def textbook(words):
    """Interpolated Kneser-Ney probabilities of the n-grams of padded words, by the definition."""
    raw = collections.Counter()
    for word, times in words.items():
        s = f" {word} "
        for end in range(1, len(s)):
            for n in range(1, min(end + 1, ORDER) + 1):
                raw[s[end - n + 1 : end + 1]] += times
    before = collections.Counter(g[1:] for g in raw if len(g) > 1)
    count = {g: raw[g] if len(g) == ORDER or (len(g) > 1 and g[0] == " ") else before[g] for g in raw}
    ones = {n: [sum(c == k for g, c in count.items() if len(g) == n) for k in (1, 2)] for n in range(1, ORDER + 1)}
    d = {n: min(a / (a + 2 * b), 0.999) if a else 0.5 for n, (a, b) in ones.items()}
    total, types = collections.Counter(), collections.Counter()
    for g, c in count.items():
        total[g[:-1], len(g)] += c
        types[g[:-1], len(g)] += 1
    p = {}
    for g in sorted(count, key=len):
        n, h = len(g), (g[:-1], len(g))
        rest = d[n] * types[h] / total[h]
        p[g] = (count[g] - d[n]) / total[h] + rest * (p[g[1:]] if n > 1 else 1 / (types[h] + 1))
    rests = {h: d[h[1]] * types[h] / total[h] / (types[h] + 1 if h[1] == 1 else 1) for h in total}
    return p, rests


def test_models_equal_the_textbook(spark):
    rng = random.Random(17)
    words = {lang: collections.Counter("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(400)) for lang, letters in (("x", "abcd"), ("y", "bcdéß"))}
    frame = spark.createDataFrame([(lang, w, n) for lang, c in words.items() for w, n in c.items()], "lang string, word string, times long")
    tables, rests = gram_tables(frame)
    for lang, counts in words.items():
        p, want = textbook(counts)
        got = {r.gram: r.p for r in tables.where(F.col("lang") == lang).collect()}
        assert got.keys() == p.keys() and all(math.isclose(got[g], p[g], rel_tol=1e-9) for g in p)
        found = {(r.context, r.n): r.rest for r in rests.where(F.col("lang") == lang).collect()}
        assert found.keys() == want.keys() and all(math.isclose(found[h], want[h], rel_tol=1e-9) for h in want)
        # Probabilities after any context, and of a character never seen, sum to one.
        letters, unseen = {g for g in p if len(g) == 1}, want["", 1]

        def after(h, c, p=p, want=want, unseen=unseen):
            if h + c in p:
                return p[h + c]
            return unseen if not h else want.get((h, len(h) + 1), 1.0) * after(h[1:], c)

        for h in ("", " ", " b", "bc", "bcd", "dcbb"):
            assert math.isclose(sum(after(h, c) for c in letters) + after(h, "?"), 1, rel_tol=1e-9)


def test_language_left_out_is_rejected(spark):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "ti", "no", "mu", "se"], "bb": ["str", "ong", "ach", "tz", "ell"], "cc": ["ça", "è", "eau", "oi", "ñu"]}
    rows = []
    for i in range(1500):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 40)))
        rows.append((i, text, lang if lang != "cc" else None, lang))
    got = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")).collect()
    by_id = {r.doc_id: r for r in got}
    share = lambda some: np.mean([by_id[i].accepted for i, _, _, lang in rows if lang in some and by_id[i].held_out])
    assert share(("aa", "bb")) >= 0.99 and share(("cc",)) <= 0.05


def test_tables_find_their_hashes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 5000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        table = Table(keys[rng.permutation(len(keys))], np.zeros(len(keys)))
        asked = np.concatenate([keys, rng.integers(0, 2**64, 100, dtype=np.uint64)])
        assert table.look(asked)[0].tolist() == np.isin(asked, keys).tolist()


def test_language_without_labels(documents):
    assert {r.lang_pred for r in language_id(documents(["some text", None]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id(documents([])).count() == 0
    assert letter_runs("Ab2c ²d_é") == ["ab", "c", "d", "é"]


def vectors_of(rng, n, dims):
    v = rng.normal(size=(n, dims))
    v[n // 2 :] = np.round(v[n // 2 :])  # ties
    v[: n // 10] = v[0]  # a group of equal vectors
    return v


def brute(ids, v, every, top):
    out = {}
    for q in [k for k, i in enumerate(ids) if i % every == 0]:
        scores = [(-float((v[k] * v[q]).sum() / (math.sqrt((v[k] * v[k]).sum()) * math.sqrt((v[q] * v[q]).sum()))), ids[k]) for k in range(len(ids)) if k != q]
        out[ids[q]] = sorted(scores)[:top]
    return out


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(3)
    v = vectors_of(rng, 700, 8)
    v = v[(v * v).sum(axis=1) > 0]
    rows = [(int(i), [float(x) for x in row], 1) for i, row in enumerate(v)]
    rows += [(10_000, None, 1), (10_050, [0.0] * 8, 1), (10_100, [float("nan")] * 8, 1), (10_150, [None] * 8, 1), (10_200, [1.0] * 3, 1), (None, [1.0] * 8, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int")
    got = collections.defaultdict(list)
    for r in nearest(frame, shard=150).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, -r.score, r.vec_id))
    want = brute(list(range(len(v))), v, 50, 5)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert np.allclose([s for _, s, _ in got[q]], [s for s, _ in best], atol=1e-12)
        rounded = [(round(s, 9), i) for s, i in best]
        assert sorted((round(s, 9), i) for _, s, i in got[q]) == sorted(rounded)
    assert nearest(frame.limit(0)).count() == 0
    assert nearest(frame.where("vec_id in (0, 1)")).count() == 1


def test_nearest_of_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e200, 1.0]), (2, [1e-200, 0.0]), (3, [2.0, 0.0]), (3, [0.0, 2.0]), (4, [1.0, 1.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    # The overflowing and the vanishing vector take no part; id 3 stands for its least vector.
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in got] == [(0, 1, 4, 0.707107), (0, 2, 3, 0.0)]


def test_clusters_are_pruned_and_exact(spark):
    rng = np.random.default_rng(9)
    v = (8 * rng.normal(size=(12, 1, 6)) + rng.normal(size=(12, 80, 6))).reshape(-1, 6)
    frame = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    want = brute(list(range(len(v))), v, 20, 5)
    for shard in (40, 100, 2000):
        got = collections.defaultdict(list)
        for r in nearest(frame, every=20, shard=shard).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        assert got == {q: [i for _, i in best] for q, best in want.items()}
    tree = VpTree(np.arange(len(v)), v, 6)
    ids = np.arange(0, len(v), 20)
    list(tree.search(v[ids], ids, 5, 1.0))
    assert LEAF < len(v) and tree.seen < 0.75 * len(v) * len(ids)


def test_relaxed_pruning_keeps_recall():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(2000, 16)) + 3 * rng.normal(size=(1, 16)) * rng.integers(0, 5, (2000, 1))
    tree, ids = VpTree(np.arange(2000), v, 6), np.arange(0, 2000, 50)
    exact, loose = (collections.defaultdict(set), collections.defaultdict(set))
    for factor, out in ((1.0, exact), (1.3, loose)):
        for q, i, _ in tree.search(v[ids], ids, 5, factor):
            out[q].add(i)
    assert np.mean([len(exact[q] & loose[q]) / 5 for q in exact]) >= 0.9


def test_hilbert_curve_is_continuous():
    for dims, bits in ((2, 3), (3, 4)):
        places = curve(dims, bits)
        assert sorted(places) == list(range(1 << dims * bits))
        cell = {p: c for c, p in enumerate(places)}
        split = lambda c: [(c >> (bits * d)) & ((1 << bits) - 1) for d in range(dims)]  # noqa: B023, E731
        for p in range(len(places) - 1):
            assert sum(abs(a - b) for a, b in zip(split(cell[p]), split(cell[p + 1]), strict=True)) == 1


def test_shards_have_equal_counts(documents):
    given = [None, "", "é" * 70_000, *["same"] * 60, *[f"text {i}" * (i % 40) for i in range(100)]]
    got = hilbert_shards(documents(given)).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == len(given) and max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    for r in got:
        data = (given[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve_place for r in order] == sorted(r.curve_place for r in got)
    assert hilbert_shards(documents([])).count() == 0


def test_shards_prune(spark):
    rng = random.Random(31)
    rows = [(i, "w " * int(10 ** rng.uniform(0, 3.5)), f"s{min(int(rng.expovariate(0.15)), 30):02d}", rng.choice(["de", "en", "en", "es", "fr"])) for i in range(6000)]
    rows += [(None, None, None, None), (1, "w", None, "en"), (1, "w", None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    edges = name_edges(docs, "source")
    assert len(edges) >= 10 and edges == sorted(set(edges))
    got = hilbert_shards(docs).collect()
    assert len(got) == len(rows)
    meta = {i: (s, g) for i, _, s, g in rows}
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append((*meta[r.doc_id], r.size))
    # What a filter must read: shards whose least and greatest value enclose what it asks for.
    reads = lambda k, value: sum(min(x[k] or "" for x in s) <= value <= max(x[k] or "" for x in s) for s in shards.values())
    assert np.mean([reads(0, s) for s in {x[2] for x in rows if x[2]}]) <= 10 and np.mean([reads(1, g) for g in ("de", "es", "fr")]) <= 17
    spans = [max(x[2] for x in s) / min(x[2] for x in s) for s in shards.values()]
    assert np.median(spans) <= max(r.size for r in got) / 8 / 4


def test_archives_round_trip(spark):
    rows = [(i, f"http://x/{i}" if i % 3 else None, h, 0) for i, h in enumerate([None, "", "<p>é</p>" * 50, "<p>é</p>" * 50, "x" * 300_000, *[f"<b>page {k}</b>" * 20 for k in range(60)], "<p>é</p>" * 50])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, top int")
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    groups = collections.defaultdict(list)
    for i, _, html, _ in rows:
        groups[html or ""].append(i)
    assert len(got) == len(rows)
    for html, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.payload_bytes, r.payload_digest, r.problem) == (len(html.encode()), warc.payload_digest(html.encode()), None)
            assert (r.record_type, r.refers_to) == (("response", None) if i == max(ids) else ("revisit", max(ids)))
    read = warc.read_archives(warc.write_archives(pages), payloads=True).where("record_type = 'response'").collect()
    assert {bytes(r.payload).decode() for r in read} == set(groups)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_archives_that_are_damaged(spark):
    good = warc.record_bytes(1, "http://x/", b"body", None, False)
    assert warc.parse_record(good)["payload"] == b"body"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"body", b"bodY"), good.replace(b"WARC-Date", b"WARC-Dote"), b""):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    import zstandard

    frame = zstandard.ZstdCompressor().compress(good)
    contents = [frame + frame, frame[:-3], b"rubbish", b"", frame + zstandard.ZstdCompressor().compress(b"none")]
    got = warc.read_archives(spark.createDataFrame([(bytearray(c),) for c in contents], "content binary")).collect()
    assert sum(r.problem is None for r in got) == 3 and sum(r.problem is not None for r in got) == 3


def test_archives_with_null_and_repeated_ids(spark):
    rows = [(None, "http://x/", "lone"), (None, None, "lone"), (None, "u", "met"), (3, "u", "met"), (3, "u", "met"), (2, "u", "met"), (7, "u", "own")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    found = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert found == {(None, 4, "response", None): 2, (None, 3, "revisit", 3): 1, (3, 3, "response", None): 2, (2, 3, "revisit", 3): 1, (7, 3, "response", None): 1}


def test_archives_with_dictionaries(spark):
    import struct

    import zstandard

    records = [warc.record_bytes(i, "http://x/", b"<p>some page of words and more words</p>" * (i + 2), None, False) for i in range(300)]
    trained = zstandard.train_dictionary(4096, records).as_bytes()
    frame = lambda x: struct.pack("<II", warc.DICTIONARY_FRAME, len(x)) + x
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    body = b"".join(packer.compress(r) for r in records)
    squeezed = zstandard.ZstdCompressor().compress(trained)
    contents = [frame(trained) + body, frame(squeezed) + body, frame(squeezed[:-9]) + body, frame(trained[:-1]), (frame(trained) + body)[:-5], body]
    frames = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "n int, content binary").repartition(2)
    count = lambda i, cut=None: [sum((r.problem is None) == good for r in warc.read_archives(frames.where(f"n = {i}")).collect()) for good in (True, False)]
    assert count(0) == count(1) == [300, 0]
    assert count(2)[0] == 0 and count(2)[1] >= 1
    assert count(3) == [0, 0] and count(4) == [299, 1] and count(5)[0] == 0


@pytest.fixture(scope="module")
def codec():
    return bpe.Bpe(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)


def test_tokens_equal_the_library(spark, documents, codec):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    rng = random.Random(6)
    alphabet = "abcdefghij  \n\t's0123 .,!?é日本🙂\u0085 　"
    given = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    given += ["a" * 3000, "ab" * 2000, " " * 500, "é" * 999, "<|endoftext|>", "don't they'll"]
    for text in given:
        ids = codec.encode(text)
        assert ids == own.encode_ordinary(text) and codec.decode(ids) == text.encode()
    few = [None, "", *given[:50], "word " * 30_000]
    got = {r.doc_id: r for r in bpe.bpe_tokens(documents(few), RANKS, public_tokenizers.PATTERN, ids=True).collect()}
    for i, text in enumerate(few):
        ids = own.encode_ordinary(text or "")
        assert (got[i].n_tokens, list(got[i].ids)) == (len(ids), ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def mix(rows):
    """Sizes and targets of the sources by water filling."""
    sizes, order = collections.Counter(), {}
    for _, source, size in rows:
        sizes[source] += size
    for rank, source in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        order[source] = (5, 2, 1)[rank % 3]
    left, open_, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        unit = left / sum(order[s] for s in open_)
        over = {s for s in open_ if 2 * sizes[s] <= unit * order[s]}
        if not over:
            target |= {s: unit * order[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return sizes, target


def test_mix_meets_its_targets(documents):
    rng = random.Random(8)
    given = [None, "", *[" ".join(["w"] * rng.randint(1, 40)) for _ in range(400)]]
    docs = documents(given)
    got = {r.doc_id: r for r in mix_sources(docs).collect()}
    rows = [(r.doc_id, r.source, len((r.text or "").split())) for r in docs.collect()]
    sizes, target = mix(rows)
    assert len(got) == len(rows)
    sums, largest = collections.Counter(), collections.Counter()
    for i, source, size in rows:
        assert (got[i].size, got[i].source_size) == (size, sizes[source])
        assert got[i].target == pytest.approx(target[source], rel=1e-9) and got[i].taken in (0, size, 2 * size)
        sums[source] += got[i].taken
        largest[source] = max(largest[source], size)
    assert all(abs(sums[s] - target[s]) <= largest[s] for s in sizes)
    again = {r.doc_id: r.taken for r in mix_sources(docs.repartition(3)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = collections.Counter(r.doc_id for r in mixed.collect())
    assert all(counts.get(i, 0) == r.copies for i, r in got.items())
    assert mix_sources(documents([])).count() == 0


def test_mix_meets_its_targets_without_ids(spark):
    rng = random.Random(10)
    rows = [(None if rng.random() < 0.5 else rng.randint(0, 40), " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 30))), f"s{i % 3}") for i in range(3000)]
    rows += [(None, None, "s0"), (None, "", None), *[(7, "the same words", "s1")] * 20, (None, "x" * 100_000, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    sizes, target = mix([(i, s, len((t or "").split())) for i, t, s in rows])
    for r in got:
        assert r["max(source_size)"] == sizes[r.source]
        assert abs(r["sum(taken)"] - target[r.source]) <= 60  # the largest document, or the rows that repeat id and text, at once
    assert mixed_documents(docs).count() == mix_sources(docs).agg({"copies": "sum"}).first()[0]
