import random
import re
from collections import Counter

import numpy as np

from veriframe.llm import op02_decontaminate as op


def plain(t):
    return re.sub(r"[\x00-\x7f]", lambda m: m[0] if m[0].isalnum() else " ", (t or "").lower())


def brute(docs, items):
    """Every window of every item's length, exact weighted similarity."""
    found = {}
    for d, t in docs:
        w = plain(t).split()
        sh = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for i, it in items:
            iw = plain(it).split()
            if len(iw) < op.SHINGLE:
                continue
            ish = Counter(tuple(iw[j : j + 5]) for j in range(len(iw) - 4))
            n = min(sum(ish.values()), len(sh))
            weight = lambda s: sum(len(x.encode()) for x in s)
            known = [x in ish for x in sh]
            for s in range(len(sh) - n + 1 if n else 0):
                if not any(known[s : s + n]):  # nothing in common
                    continue
                own = Counter(sh[s : s + n])
                keys = set(own) | set(ish)
                low = sum(min(own[k], ish[k]) * weight(k) for k in keys)
                high = sum(max(own[k], ish[k]) * weight(k) for k in keys)
                if high and low / high >= op.THRESHOLD:
                    found[(d, i)] = max(found.get((d, i), 0), low / high)
    return found


def sample():
    rng = random.Random(5)
    vocab = [f"w{i}" * rng.randint(1, 2) for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(6, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, "short one"), (93, "these five words are short"), (94, "and, seven: of them are here too")]
    docs = []
    for d in range(60):
        w = rng.choices(vocab, k=rng.randint(0, 200))
        if d % 2:
            own = items[rng.randrange(25)][1].split()
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = own
        docs.append((d, " ".join(w).upper() if d % 3 == 0 else '"' + ", ".join(w) + '."' if d % 3 == 1 else " \n ".join(w)))
    docs += [(110, "w1 w2 these five words are short w3"), (111, "and seven of them are here"), (112, "And Seven of them are here too!")]
    return docs + [(100, None), (101, ""), (None, items[3][1]), (102, items[4][1]), (102, items[4][1])], items


def test_against_brute_force(spark):
    docs, items = sample()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for chars in (op.BLOCK_CHARS, 900):
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in op.matches(df, bench, chars).collect()}
        assert set(got) <= set(want)
        assert len(got) >= 0.97 * len(want)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert {(110, 93), (112, 94)} <= set(got) and not any(d == 111 for d, _ in got)
    assert [r["item_id"] for r in op.too_short(bench).orderBy("item_id").collect()] == [91, 92]
    kept = {r["doc_id"] for r in op.clean(df, bench, 900).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_empty_tables(spark):
    docs, items = sample()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert op.matches(df, bench.limit(0)).count() == 0
    assert op.matches(df.limit(0), bench).count() == 0
    assert op.clean(df, bench.limit(0)).count() == len(docs)


def test_index_meets_all_within_radius():
    rng = random.Random(1)
    words = [[f"x{rng.randrange(99)}" for _ in range(20)] for _ in range(30)]
    index = op.Index([(i, " ".join(w)) for i, w in enumerate(words)])
    _, tables = index.lengths[16]
    for _, _, _, blocks in index.items:
        v = blocks.copy()
        for bit in rng.sample(range(64), op.RADIUS):
            v[bit // 8] ^= np.uint8(1 << bit % 8)
        _, items, bits = tables.within(v[None])
        exact = {i: int(np.bitwise_count(x[3] ^ v).sum()) for i, x in enumerate(index.items)}
        assert dict(zip(items.tolist(), bits.tolist())) == {i: d for i, d in exact.items() if d <= op.RADIUS}


def test_blocks_hold_all_items_whatever_repeats(spark):
    """Null and repeated ids, and one huge item, in blocks by size."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"x{rng.randrange(10**6)}" for _ in range(n))
    items = [(None, text(9)) for _ in range(40)] + [(1, text(9))] * 30 + [(2, text(3000))] + [(k, text(12)) for k in range(3, 60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    held = [i for index in op._indexes(bench, 800) for i in index.items]
    assert len(held) == 40 + 1 + 1 + 57
    assert max(len(index.items) for index in op._indexes(bench, 800)) < 40


def test_long_text_and_clashing_columns(spark):
    rng = random.Random(6)
    long = [f"y{rng.randrange(10**6)}" for _ in range(120_000)]
    docs = spark.createDataFrame([(1, " ".join(long), 5, "s"), (2, "short", 6, "t")], "doc_id long, text string, item_id int, similarity string")
    bench = spark.createDataFrame([(7, " ".join(long[60_000:60_030]))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["from_word"]) for r in op.matches(docs, bench).collect()] == [(1, 7, 60_000)]
    assert [tuple(r) for r in op.clean(docs, bench).collect()] == [(2, "short", 6, "t")]
