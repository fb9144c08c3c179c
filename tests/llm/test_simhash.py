"""SimHash components against all pairs, and the pivot table's bounds."""

import random
import re

import numpy as np
import pytest
import xxhash

from verdigris.llm import simhash as H


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    prints = [plain_fingerprint(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    name = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((doc_id, f"{prints[i]:016x}", name[find(i)], len(ids[find(i)])) for i, (doc_id, _) in enumerate(rows)), key=str)


def some_texts():
    rng = random.Random(13)
    words = [f"w{i}" for i in range(500)] + ["É", "éa", " "]
    texts = [None, "", " \n", "One two three", "ONE two\tthree", "a b", "word " * 100_000]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 400))]
        for _ in range(8):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "new"
            texts.append(rng.choice([" ", "\x0b"]).join(copy))
    return texts + texts[20:40]


@pytest.mark.parametrize("large", [1, 128])
def test_matches_all_pairs(documents, large):
    docs = documents(some_texts())
    docs = docs.unionByName(docs.where("doc_id % 9 = 0")).unionByName(docs.where("doc_id % 13 = 3").selectExpr("null doc_id", "text", "lang", "source", "n_chars", "_row", "kind", "size"))
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted((tuple(r) for r in H.simhash_components(docs, large=large).collect()), key=str)
    assert got == want
    assert len({r[1] for r in want}) > len({r[2] for r in want}) + 5  # texts with other fingerprints are linked


def near_prints(rng, n):
    base = [rng.getrandbits(64) for _ in range(n)]
    return np.array([b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3)], np.uint64)


def test_links_share_a_key_and_pass_the_table():
    fps = near_prints(random.Random(5), 400)
    references = H.reference_fingerprints()
    table = H.distances(fps, references)
    keys = H.bucket_keys(table)
    assert len(set(references.tolist())) == 33 and (table == [[(int(f) ^ int(r)).bit_count() for r in references] for f in fps]).all()
    discarded = 0
    for i in range(len(fps)):
        for j in range(i - i % 4, i):
            apart = (int(fps[i]) ^ int(fps[j])).bit_count()
            off = np.abs(table[i].astype(int) - table[j].astype(int)).max()
            assert off <= apart
            assert apart > 2 or (keys[i] == keys[j]).any()
            discarded += apart > 2 and off > 2
    assert discarded > 300  # of 1,200 pairs at distance 3 and above


@pytest.mark.parametrize("large", [1, 3, 128])
def test_both_ways_of_linking_connect_alike(spark, large):
    rng = random.Random(large)
    fps = {0, 1, 3, 7, 15, 31, *[int(x) for x in near_prints(rng, 30)], *[((1 << i) | (1 << j)) for i in range(0, 64, 9) for j in range(0, 64, 5)]}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    from verdigris.llm._common import stage
    from verdigris.llm.near_dedup import components

    links = H.fingerprint_links(stage(spark.createDataFrame([(x,) for x in signed], "fp long"), "fps"), large)
    roots = dict(components(links).collect())
    groups = {}
    for x in signed:
        groups.setdefault(roots.get(x, x), set()).add(x)
    want = []
    left = set(signed)
    while left:
        group, edge = set(), [left.pop()]
        while edge:
            x = edge.pop()
            group.add(x)
            near = {y for y in left if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 2}
            left -= near
            edge += near
        want.append(group)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))


def test_empty_table(documents):
    assert H.simhash_components(documents([]).limit(0)).count() == 0
