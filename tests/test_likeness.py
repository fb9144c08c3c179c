"""Alike names against all pairs."""

import random
import re

import pytest

from verdigris.operators import likeness as L

WORDS = ["resolução", "portaria", "instrução", "normativa", "anm", "dnpm", "2019", "2018", "12", "123", "PORTARIA", "Resolucao"]


def groups(name):
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c)).lower()
    plain = re.sub(r"\s+", " ", plain).strip()
    text = f"##{plain}##"
    return {text[i : i + 3] for i in range(len(text) - 2)} if plain else set()


def pairs(left, right, least):
    out = {}
    for a in set(left) - {None}:
        for b in set(right) - {None}:
            x, y = groups(a), groups(b)
            if a != b and x and y and len(x & y) / len(x | y) >= least - 1e-9:
                out[a, b] = round(len(x & y) / len(x | y), 6)
    return out


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9, 1.0])
def test_pairs_equal_all_pairs(spark, least):
    rng = random.Random(int(least * 10))
    made = lambda: "".join(c if rng.random() > 0.04 else rng.choice("axz ") for c in " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))))
    left, right = ([None, "", "  ", "a", *[made() for _ in range(120)]] for _ in range(2))
    right += left[10:20]
    frame = lambda names: spark.createDataFrame([(n,) for n in names + names[:5]], "n string")
    got = {(r.a, r.b): r.likeness for r in L.alike_names(frame(left), frame(right), "n", least).collect()}
    assert got == pairs(left, right, least) and (got or least == 1.0)


def test_candidates_are_few(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(14)) for _ in range(400)]
    names += [n[:7] + "x" + n[8:] for n in names[:50]]
    rare = {}
    sets = {n: groups(n) for n in names}
    counts = {}
    for s in sets.values():
        for g in s:
            counts[g] = counts.get(g, 0) + 1
    for n, s in sets.items():
        for g in sorted(s, key=lambda g: (counts[g], g))[: L.prefix_size(len(s))]:
            rare.setdefault(g, []).append(n)
    candidates = {(a, b) for names in rare.values() for a in names for b in names if a < b}
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = {(r.a, r.b) for r in L.alike_names(frame, frame, "n").collect() if r.a < r.b}
    assert len(got) >= 50 and got <= candidates and len(candidates) < 0.03 * len(names) ** 2 / 2  # of all pairs


def test_nearest_names(spark):
    held = spark.createDataFrame([("portaria 12 2019",), ("portaria 13 2019",), ("lei 1",)], "n string")
    wanted = spark.createDataFrame([("lei 1",), ("portaria 12/2019",), ("nada",), (None,)], "n string")
    got = {r.name: r.found for r in L.nearest_names(wanted, held, "n").collect()}
    assert got == {"lei 1": "lei 1", "portaria 12/2019": "portaria 12 2019", "nada": None, None: None}
    with pytest.raises(ValueError):
        L.alike_names(held, held, "n", 0)
