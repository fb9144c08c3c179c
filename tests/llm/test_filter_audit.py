"""The audit of filters against sequential filtering of every order."""

import collections
import itertools
import random
import re

from verdigris.llm import filter_audit as A


def failures(rows):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" * (len(words) < 100)
        fails += "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
        fails += "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * (doc_id is not None and least.get(text, doc_id) < doc_id)
        out.append((part or "", set(fails), doc_id))
    return out


def expected(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found, shapley = {}, collections.Counter()
    judged = failures(rows)
    for part in {p for p, _, _ in judged}:
        for order in itertools.permutations("ABCDE"):
            left, gone = [x for x in judged if x[0] == part], []
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left = [x for x in left if f not in x[1]]
                gone += removed
                unique = sum(x[0] == part and x[1] == {f} for x in judged)
                shapley[part, f] += len(removed)
                lost = [sum(x[2] in some for x in removed) for some in (good, toxic)]
                found[part, "".join(order), step] = [len(left), len(removed), redundant, unique, *lost]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def table(report):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in report.collect()}


def some_rows(spark, documents):
    rng = random.Random(12)
    vocabulary = [f"{rng.choice(['w', 'W', 'WW', 'é'])}{i}" for i in range(300)]
    texts = [None, "", "", "A" * 200_000]
    for _ in range(150):
        words = [rng.choice(vocabulary[: rng.choice([20, 300])]) for _ in range(rng.choice([3, 99, 100, 130]))]
        texts.append(rng.choice([" ", "\n", "\x0b", "  "]).join(words) + rng.choice(["", "", "#", " | "]))
    texts += texts[10:60] + [texts[20]] * 40
    docs = documents(texts)
    docs = docs.unionByName(docs.where("doc_id % 8 = 0"))
    docs = docs.unionByName(docs.where("doc_id % 11 = 0").selectExpr("null doc_id", "text", "lang", "source", "n_chars", "_row", "kind", "size"))
    labels = [(rng.choice([None, *range(len(texts) + 5)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)]
    return docs, labels, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_matches_sequential_filtering(spark, documents):
    docs, labels, marks = some_rows(spark, documents)
    want = expected([(r.doc_id, r.text, r.lang) for r in docs.collect()], labels)
    assert table(A.filter_audit(docs, marks)) == want
    assert len(want) == 2 * 600 and any(v[4] for v in want.values()) and any(v[5] for v in want.values())


def test_many_parts_and_small_blocks(spark, documents):
    docs, labels, marks = some_rows(spark, documents)
    flags = A.flagged(docs, marks, part_col="_row")
    small = A.audit(A.bitmap_index(flags, block=16).cache())
    want = expected([(r.doc_id, r.text, r._row) for r in docs.collect()], labels)
    assert table(small) == want


def test_empty_tables(spark, documents):
    docs, _, marks = some_rows(spark, documents)
    assert A.filter_audit(docs.limit(0), marks).count() == 0
    assert A.filter_audit(docs, marks.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0
