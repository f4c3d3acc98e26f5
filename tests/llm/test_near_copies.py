"""Against brute force: the Jaccard similarity of all pairs of texts."""

import random

import numpy as np
import pytest

from veriframe.llm import near_copies as op


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Places in rows of those that stay."""
    own = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(own[i] & own[j]), len(own[i] | own[j])
            if 5 * both >= 4 * either:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(find(i), set()).add((d is None, d, t))
    return groups


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)]


def edited(rng, text, most):
    w = text.split()
    for _ in range(rng.randint(1, most)):
        at = rng.randrange(len(w))
        w[at : at + 1] = rng.choice(([], ["new" + str(rng.randrange(10**6))], [w[at], "more" + str(rng.randrange(50))]))
    return " ".join(w)


def sample(seed):
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randint(1, 120))) for _ in range(25)]
    long = " ".join(words(rng, 150))
    # a large group of near copies, of which some are edited so much that they link to few others or none
    group = [edited(rng, long, 7) for _ in range(70)]
    group += [edited(rng, rng.choice(group), 3) for _ in range(20)]
    short = " ".join(long.split()[:110])
    group += [edited(rng, short, 4) for _ in range(15)]
    texts += group + [edited(rng, rng.choice(texts[:20]), 2) for _ in range(20)]
    texts += [None, "", " \n ", "Two Words", "two words", "x" * 5000, " ".join(words(rng, 30_000))]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(3, texts[3]), (7, "another text under one id"), (None, texts[5]), (None, "nobody has this"), (None, "nobody has this")]


@pytest.mark.parametrize(("seed", "pairwise"), [(1, 16), (2, 2), (3, 2), (4, 6)])
def test_against_brute_force(spark, seed, pairwise):
    rows = sample(seed)
    docs = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, row string, sid int")
    out = op.keep_first(docs, pairwise)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    groups = brute(rows)
    assert len(got) == len(groups)
    for members in groups.values():
        stay = [g for g in got if (g[0] is None, *g) in members]
        assert len(stay) == 1
        ids = [d for none, d, _ in members if not none]
        assert stay[0][0] == (min(ids) if ids else None)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, extra map<string,int>")
    assert op.keep_first(docs).count() == 0
    one = spark.createDataFrame([(1, "a b", {"k": 1}), (1, "a b", {"k": 2})], docs.schema)
    assert op.keep_first(one).count() == 1


def test_candidates_come_from_covering_simhash(spark):
    """Fingerprints by their definition; sets that differ in two bits of a part meet, whatever the rest; others don't."""
    own = op.shingle_sets([" ".join(words(random.Random(1), 300)).encode()])[0]
    parts, width = op.layout(1000)
    hashes = [[int(x) for x in op.mix64(np.array([h], np.uint64) + op._WORDS)] for h in [*own, op._COMMON]]
    bits = op.simhash(own, parts * width)
    assert bits.tolist() == [2 * sum(h[i // 64] >> i % 64 & 1 for h in hashes) > len(hashes) for i in range(parts * width)]
    whole = op.prints([own], parts, width)[0][0].tolist()
    assert whole == [sum(int(bits[p * width + i]) << i for i in range(width)) for p in range(parts)]
    rng = random.Random(2)
    rows = [(0, whole)]
    for sid in range(1, 60):  # two bits in one part, all in the others
        kept, two = rng.randrange(parts), rng.sample(range(width), 2)
        rows.append((sid, [x ^ sum(1 << b for b in two) if p == kept else x ^ (1 << width) - 1 for p, x in enumerate(whole)]))
    rows += [(sid, [x ^ (1 << width) - 1 for x in whole]) for sid in (100, 101)]
    once = spark.createDataFrame([(s, s, x, 0, 0) for s, x in rows], "sid long, root long, parts array<long>, x long, y long")
    met = set()
    for first in range(0, parts, op.ROUND):
        dealt = op._dealt(once, first)
        met |= {r["sid"] for r in dealt.join(dealt.filter("sid = 0").select("key"), "key", "left_semi").select("sid").distinct().collect()}
    assert met == set(range(60))


@pytest.mark.parametrize(("size", "shared"), [((4, 5), 4), ((9, 9), 8), ((12, 15), 12), ((40, 50), 40), ((90, 90), 80), ((360, 360), 320)])
def test_pairs_at_the_similarity_meet(size, shared):
    """Of pairs at exactly 0.8 none is left out: by masks, by the words that go with a set, by sizes."""
    rng, kept = np.random.default_rng(3), np.array(op.masks(2))
    parts, width = op.layout(200_000)
    for _ in range(300):
        h = rng.integers(0, 2**64, sum(size) - shared, dtype=np.uint64)
        each, x, y = op.prints([h[: size[0]], h[size[0] - shared :]], parts, width)
        assert ((each[0] ^ each[1])[:, None] & kept == 0).any()
        assert (int(x[0] ^ x[1]) % 2**64).bit_count() + (int(y[0] ^ y[1]) % 2**64 >> 10).bit_count() <= op.NEAR
        assert abs(int(y[0] & 1023) - int(y[1] & 1023)) <= op.STEPS


def test_a_group_edited_apart_meets_once_a_set_and_once_a_pair(spark, monkeypatch):
    """Sets of crowded buckets are told once each, not with each other in all buckets; a pair is one row, however many shingles it shares."""
    rng = random.Random(5)
    base = words(rng, 200)
    texts = []
    for k in range(60):  # each is unlike all others but for a twin that shares its edits, and more of its own
        own = list(base)
        for at in range(k % 7, 200, 9):
            own[at] = f"e{k}x{at}"
        twin = list(own)
        twin[150] = twin[160] = f"t{k}"
        texts += [" ".join(own), " ".join(twin)]
    texts += [" ".join(base)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, joined = [], []
    monkeypatch.setattr(op, "_nearest", lambda dealt, pairwise: dealt.select("sid", "sid").limit(0).toDF("a", "b"))
    monkeypatch.setattr(op, "_met", lambda *a, f=op._met: met.extend(f(*a).collect()) or f(*a))
    monkeypatch.setattr(op, "_linked", lambda pairs, own, f=op._linked: joined.append(pairs.count()) or f(pairs, own))
    assert {r["doc_id"] for r in op.keep_first(docs, 16).collect()} == {*range(0, 120, 2), 120}
    assert all(not r["others"] or len(r["others"]) < op.FEW for r in met)
    assert joined[-1] < 3 * len(texts)
