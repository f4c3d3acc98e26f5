import random
import re

import numpy as np
import pytest
import xxhash

from veriframe.llm import op03_simhash as op
from veriframe.llm.components import components


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, near):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in near:
        root[find(i)] = find(j)
    out = {}
    for i in range(n):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def test_every_pair_within_the_radius_meets_in_a_table():
    rng, kept = random.Random(1), op.masks(2)
    assert len(kept) == 7
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 2)):
            y ^= 1 << b
        assert any((x & m) == (y & m) for m in kept)


@pytest.mark.parametrize("pairwise", [16, 2, 10_000])
def test_links_against_brute_force(spark, pairwise):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 30, dtype=np.int64)
    fps = set(base.tolist())
    for b in base[:4].tolist():
        for _ in range(120):
            x = b
            for i in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                x ^= (1 << i) if i < 63 else -(1 << 63)
            fps.add(x)
    fps = sorted(fps)
    a = np.array(fps, np.int64)
    near = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count((a[i] ^ a).view(np.uint64)) <= 2)]
    want = {frozenset(fps[i] for i in g) for g in groups(len(fps), near) if len(g) > 1}
    found = components(op.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 2, pairwise)).toPandas()
    assert {frozenset(g) for g in found.groupby("root").node.apply(list)} == want
    assert (found.groupby("root").node.min().to_numpy() == np.sort(found.root.unique())).all()


def test_documents(spark):
    rng = random.Random(5)
    text = " ".join(rng.choices([f"w{i}" for i in range(500)], k=3000))
    docs = [(7, text), (3, text.upper()), (9, text.replace("w1 ", "changed ", 1)), (4, None), (2, ""), (8, " \n "), (11, "a"), (12, "a b"), (13, "Éa b c D"), (7, text), (None, "z y x w v"), (20, "É b c d e f")]
    df = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, component_id string")
    rows = op.near_duplicates(df).collect()
    assert len(rows) == len(docs)
    prints = {d: plain(t) for d, t in docs}
    assert all(r["fingerprint"] == f"{prints[r['doc_id']]:016x}" for r in rows)
    ids = list(prints)
    near = [(i, j) for i, a in enumerate(ids) for j, b in enumerate(ids) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = {}
    for g in groups(len(ids), near):
        known = [ids[i] for i in g if ids[i] is not None]
        want |= {ids[i]: min(known) if known else None for i in g}
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1400)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
