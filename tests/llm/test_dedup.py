"""Exact and near duplicates against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from verdigris.llm import near_dedup as N
from verdigris.llm.exact_dedup import exact_dedup, keep_one_of_each
from verdigris.llm.near_dedup import components, keep_one_of_each_class, near_classes

UPPER = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def lower(text):
    return "".join(UPPER.get(c, c) for c in text or "")


def some_texts():
    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha beta gamma delta Éa ÉB İ".split()) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    return [None, "", None, *base, *base[:20], *[t.upper() for t in base[:10]], *["hot Text"] * 80, "x" * 200_000]


def test_exact_dedup_matches_brute_force(documents):
    given = some_texts()
    groups = collections.defaultdict(list)
    for i, text in enumerate(given):
        groups[lower(text)].append(i)
    got = {r.doc_id: r for r in exact_dedup(documents(given)).collect()}
    assert len(got) == len(given)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_repeated_rows_keep_one(documents):
    docs = documents(["same", "same"]).unionByName(documents(["same", "same"]))
    decided = exact_dedup(docs).collect()
    assert len(decided) == 4 and sum(r.kept for r in decided) == 1
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_null_ids_lose(spark):
    docs = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    kept = sorted(keep_one_of_each(docs).collect(), key=lambda r: r.text)
    assert [(r.doc_id, r.text) for r in kept] == [(3, "a"), (None, "b")]


def edited(words, share, rng):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


def test_near_classes_match_brute_force(documents):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    given = [None, "", "short text", "short text", "Short Text"]
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        given += [" ".join(edited(words, share, rng)) for share in (0, 0.002, 0.005, 0.01, 0.02, 0.2)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    given += [" ".join(edited(base, rng.random() * 0.04, rng)) for _ in range(150)]  # a large group of uneven likeness
    got = {r.doc_id: r for r in near_classes(documents(given)).collect()}
    assert len(got) == len(given)
    shingle, counts, n = N.Shingler(), collections.Counter(), len(given)
    parts = [shingle(t or "") for t in given]
    for hashes, _ in parts:
        counts.update(hashes.tolist())
    weigh = lambda h: 1 + np.log(n / max(counts[h], N.RARE * n))
    weighted = [(h, c * np.array([weigh(x) for x in h.tolist()])) for h, c in parts]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if given[a] == given[b] or not (given[a] or given[b]) or N.weighted_jaccard(weighted[a], weighted[b]) >= N.THRESHOLD:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: r.class_id for i, r in got.items()} == {i: find(i) for i in range(n)}
    sizes = collections.Counter(find(i) for i in range(n))
    assert all(r.class_size == sizes[r.class_id] for r in got.values())
    kept = keep_one_of_each_class(documents(given))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(n)})


def test_frequent_values_come_by_broadcast(spark):
    from verdigris.llm._common import frequent_first, frequent_values, stage

    rows = [(i, ("hot" if i % 3 else f"k{i}") if i % 10 else None) for i in range(4000)]
    for kind in ("string", "binary"):
        table = spark.createDataFrame(rows, "n int, k string").withColumn("k", F.col("k").cast(kind))
        keys = table.where("k is not null and n % 2 = 1").select("k").distinct().withColumn("mark", F.lit(1))
        table, keys = stage(table, "rows"), stage(keys, "keys")
        found = {bytes(r.k).decode() if kind == "binary" else r.k for r in frequent_values(table, "k").collect()}
        assert "hot" in found and len(found) <= 1000
        want = [(r.n, r.mark) for r in table.join(keys, "k").collect()]
        assert sorted((r.n, r.mark) for r in frequent_first(table, keys, "k").collect()) == sorted(want)


def words_of(text):
    """Words as runs of bytes other than ASCII white space, in lower case."""
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]


def brute_classes(texts, threshold=0.8):
    """Classes by the definition, from texts alone: shingles of five words, IDF = 1 + ln(N / max(df, N / 1000)), weighted Jaccard."""
    parts = []
    for text in texts:
        words = words_of(text or "")
        size = min(5, len(words))
        parts.append(collections.Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else collections.Counter())
    df, n = collections.Counter(s for part in parts for s in part), len(texts)
    weighted = [{s: c * (1 + math.log(n / max(df[s], n / 1000))) for s, c in part.items()} for part in parts]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(set)
    for i, part in enumerate(weighted):
        for s in part:
            holders[s].add(i)
    for a, part in enumerate(weighted):
        for b in {b for s in part for b in holders[s] if b < a} | {b for b in range(a) if (texts[a] or "") == (texts[b] or "")}:
            other = weighted[b]
            same = sum(min(w, other[s]) for s, w in part.items() if s in other)
            total = sum(part.values()) + sum(other.values()) - same
            if (texts[a] or "") == (texts[b] or "") or total and same / total >= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(n)]


def test_classes_by_definition_with_any_ids(spark):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(4000)]
    long = [rng.choice(vocabulary) for _ in range(100_000)]
    texts = [None, "", "", "two words", "two words", "Two  WORDS", " ".join(long), " ".join(edited(long, 0.002, rng)), "\u00a0 odd\u00a0space and\x0bmore words here"]
    for _ in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 300))]
        texts += [" ".join(edited(words, share, rng)) for share in (0, 0.003, 0.01, 0.03)]
    common = " ".join(rng.choice(vocabulary) for _ in range(12))
    texts += [f"{common} " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30))) for _ in range(80)]  # a passage that many share
    texts += texts[9:15]
    ids = [rng.choice([None, 1, 2, i, 5000 + i, -7]) for i in range(len(texts))]
    want = brute_classes(texts)
    rows = [(i, text, i, "x", b"y") for i, text in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, row string, digest binary")
    got = N.near_rows(docs).collect()
    place = {r.row: k for k, r in enumerate(sorted(got, key=lambda r: r.row))}  # rows are numbered in the input's order
    assert len(got) == len(texts)
    found = collections.defaultdict(set)
    for r in got:
        assert r.doc_id == ids[place[r.row]]
        found[r.root].add(place[r.row])
    classes = collections.defaultdict(set)
    for k, root in enumerate(want):
        classes[root].add(k)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, classes.values()))
    named = near_classes(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in named) == sorted((i is None, i or 0) for i in ids)
    assert sorted(collections.Counter(r.class_id for r in named).values()) == sorted(map(len, classes.values()))
    assert None not in {r.class_id for r in named}
    kept = keep_one_of_each_class(docs)
    assert kept.columns == docs.columns
    first = [min(group, key=lambda k: (ids[k] is None, ids[k] or 0, k)) for group in classes.values()]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((ids[k] is None, ids[k] or 0, texts[k] or "") for k in first)


def test_counts_are_exact_however_split(spark):
    rng = random.Random(14)
    words = [f"w{i}" for i in range(50_000)]
    shared = [" ".join(rng.choice(words) for _ in range(5)) for _ in range(40)]
    texts = [" ".join([*(shared[k] for k in range(40) if i % (k + 2) == 0), *(rng.choice(words) for _ in range(60))]) for i in range(900)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    shingler, want = N.Shingler(), collections.Counter()
    for text in texts:
        want.update(set(shingler.all(text).tolist()))
    rare = 0.02
    for parts in (1, 7):
        hashes, idf, n = N.common_shingles(docs.repartition(parts), rare)
        assert n == 900 and hashes.tolist() == sorted(h for h, c in want.items() if c > rare * n)
        assert np.allclose(idf, [1 + math.log(n / want[h]) for h in hashes.tolist()])


def test_candidate_counts_pass_on_what_they_hold(monkeypatch):
    monkeypatch.setattr(N, "HELD", 100)
    counts = N._CandidateCounts(np.ones((N.SKETCH_ROWS, N.SKETCH), bool))
    texts = [" ".join(f"w{(i * j) % 37}" for j in range(60)) for i in range(50)]
    found, want = collections.Counter(), collections.Counter()
    for batch in [*(b for t in texts for b in counts(None, [t])), *counts.end()]:
        for h, c in zip(batch.column(0).to_numpy().view(np.uint64).tolist(), batch.column(1).to_pylist(), strict=True):
            found[h] += c
    for text in texts:
        want.update(set(N.Shingler().all(text).tolist()))
    assert found == want and counts.held == 0


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(4)
    sampler, usual = N.Sampler(3.0), 3.0
    hashes = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    agree = []
    for _ in range(40):
        keep = rng.random(len(hashes)) < 0.8
        weights = np.where(rng.random(len(hashes)) < 0.3, rng.random(len(hashes)) * 5 + 0.1, usual)
        a, b = (hashes, weights), (hashes[keep], weights[keep])
        agree.append((sampler(*a) == sampler(*b)).mean() - N.weighted_jaccard(a, b))
    assert abs(np.mean(agree)) < 0.03


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r.id: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_empty_tables(documents):
    assert exact_dedup(documents([])).count() == 0
    assert near_classes(documents([])).count() == 0
    assert near_classes(documents([None, ""])).select("class_id").distinct().count() == 1


def test_ends_of_large_buckets_meet_the_others_in_blocks(documents, monkeypatch):
    rng = random.Random(14)
    words = [f"w{i}" for i in range(400)]
    given = [None, "", *[" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]]
    for base in given[2:5]:
        given += [f"{base} new{i}" for i in range(25)]
    docs = documents(given)
    want = sorted(map(tuple, near_classes(docs).collect()))
    starred = []
    whole = N.verified_blocks
    monkeypatch.setattr(N, "verified_blocks", lambda rows, *a: starred.append(rows.count()) or whole(rows, *a))
    monkeypatch.setattr(N, "BLOCK", 3)
    assert sorted(map(tuple, near_classes(docs).collect())) == want
    assert starred[0] > 50 and len({r[1] for r in want}) <= 9
