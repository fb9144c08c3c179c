"""Spelling variants against all pairs of words."""

import collections
import random
import re
import zlib

import pytest

from verdigris.llm import spelling as S

LETTERS = "abcdeéÀß×"


def corpus_words(rows):
    """``word: n`` by the contract's sentences, a run at a time."""
    found = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode()) & 0xFFFFFFFF
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    words = corpus_words(rows)
    form, near = {}, {}
    for w, n in words.items():
        others = [x for x in words if one_edit(w, x)]
        near[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, form[w], words[form[w]] if form[w] else None, root, near[w])
    return out


def test_matches_all_pairs(documents, monkeypatch):
    rng = random.Random(11)
    base = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(4, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aabaa", "ababab", "bababa", "abcde", "edcba"]
    words = []
    for _ in range(6000):
        w = list(rng.choice(base))
        if rng.random() < 0.5:
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(LETTERS), rng.choice(LETTERS).upper(), "B"])
        words.append("".join(w))
    texts = [None, "", "long" * 20_000, "long" * 20_000, "long" * 20_000, "1a2b " + "qwert " * 3 + "qwerty " * 7 + "qwertyu " * 15 + "qwertyui " * 31, *[" ".join(words[i : i + 40]) + rng.choice("?! ") for i in range(0, 6000, 40)]]
    monkeypatch.setattr(S, "HELD", 100)
    docs = documents(texts)
    docs = docs.unionByName(docs.where("doc_id % 7 = 0")).unionByName(docs.where("doc_id % 9 = 0").selectExpr("null doc_id", "text", "lang", "source", "n_chars", "_row", "kind", "size"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(rows)
    got = {r.word: (r.n, r.form, r.form_n, r.root, r.n_near) for r in S.spelling_variants(docs).collect()}
    assert got == want
    assert sum(v[1] is not None for v in want.values()) > 100 and any(v[3] not in (w, v[1]) for w, v in want.items())


def test_hot_keys_are_dealt_out_and_lose_nothing(documents, monkeypatch):
    rng = random.Random(3)
    words = list({"".join(rng.sample("abcdefg", 7)) for _ in range(400)} | {"".join(rng.sample("abcdef", 6)) for _ in range(200)})  # few anagram keys
    docs = documents([" ".join(words)] * 3)
    counts = []
    whole = S.frequent_values
    monkeypatch.setattr(S, "frequent_values", lambda *a: counts.append(whole(*a)) or counts[-1])
    got = {r.word: (r.n, r.form, r.form_n, r.root, r.n_near) for r in S.spelling_variants(docs).collect()}
    assert got == expected([(i, " ".join(words)) for i in range(3)])


def test_long_words_cost_their_length():
    owner, *_ = S.anagram_rows(["x" * 50_000, "abc"])
    assert len(owner) == 2 + 50_000 + 3


def test_without_slips_and_empty(documents, spark):
    docs = documents(["colour colour colour colour colour colour color color color"])
    got = {r.word: r.root for r in S.spelling_variants(docs, slips=None).collect()}
    assert got == {"colour": "colour", "color": "colour"}
    assert S.spelling_variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.spelling_variants(docs, least_chars=3)
