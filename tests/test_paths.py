"""Paths from both ends against a plain breadth-first search."""

import random

import pytest

from verdigris.operators import paths as P


def brute(pairs, weak, sources, targets, depth, most, per_partner):
    """Hop by hop from the sources alone."""
    tried = {p: sorted(c for c, q in pairs if q == p)[:per_partner] for _, p in pairs}
    frontier, seen, spent, found = {s: ([str(s)], True) for s in sources}, set(sources), set(), []
    for hop in range(1, depth + 1):
        if most is not None and len(found) >= most:
            break
        uses = sorted((path, strong, p) for at, (path, strong) in frontier.items() for c, p in pairs if c == at)
        met, keys = set(), []
        for path, strong, p in uses:
            if p in weak and (p in spent or p in met):
                continue
            met |= {p} & weak
            keys.append((path, strong, p))
        spent |= met
        moves = [(c, [*path, str(p), str(c)], strong and p not in weak) for path, strong, p in keys for c in tried[p] if str(c) not in path[::2]]
        found += [(path, hop, "forte" if strong else "indicio") for c, path, strong in moves if c in targets]
        frontier = {}
        for c, path, strong in moves:
            if c not in seen:
                frontier[c] = min(frontier.get(c, (path, strong)), (path, strong))
        seen |= set(frontier)
    return sorted(found, key=lambda x: (x[1], x[0]))[:most]


@pytest.mark.parametrize("most, per_partner, depth, side", [(5, 10, 3, 1), (None, None, 3, 1), (None, 6, 2, 8), (40, None, 3, 8)])
def test_paths_match_a_plain_search(spark, most, per_partner, depth, side):
    rng = random.Random(side)
    # Companies from 101 and partners from 501: labels of one length, so that their order is the numbers'.
    pairs = sorted({(rng.randint(101, 160), rng.randint(501, 545)) for _ in range(95)} | {(c, 599) for c in range(101, 130)})
    weak = {p for _, p in pairs if p % 3 == 0}
    sources, targets = list(range(103, 103 + side)), [150, 155, 160, 130]
    rows = [(c, p, p in weak) for c, p in pairs]
    edges = spark.createDataFrame([*rows, (None, 501, False), (103, None, False), *rows[:9]], "c long, p long, weak boolean")
    got = P.paths_between(edges, sources, targets, "c", "p", depth, most, per_partner, "weak").collect()
    want = brute(pairs, weak, sources, set(targets), depth, most, per_partner)
    assert sorted(((list(r.path), r.hops, r.confidence) for r in got), key=lambda x: (x[1], x[0])) == want
    assert want and {x[2] for x in want} == {"forte", "indicio"}


def test_the_smaller_side_grows_and_a_hub_costs_its_bound(spark, monkeypatch):
    """A hub with all companies: the sources' hop is bounded by what is tried, and few targets restrict a wide frontier."""
    pairs = [(c, 1) for c in range(1000, 4000)] + [(c, c) for c in range(1000, 1100)] + [(9999, 1050)]
    edges = spark.createDataFrame(pairs, "c long, p long")
    sizes = {}
    whole = P.staged
    monkeypatch.setattr(P, "staged", lambda df, name: sizes.setdefault(name, []).append(t.count()) or t if (t := whole(df, name)) is not None else None)
    got = [tuple(r.path) for r in P.paths_between(edges, [3000], [9999], "c", "p", 2).collect()]
    assert got == [("3000", "1", "1050", "1050", "9999")]
    assert max(sizes["path-keys"]) <= 101 and sizes["path-near"]  # the targets' side grew too
    assert sizes["path-keys"][-1] <= 3  # and left one company of a hundred to go on from
    assert P.paths_between(edges, [3000], [5], "c", "p", 2).count() == 0
    assert P.paths_between(edges, [], [9999], "c", "p", 3).collect() == []
