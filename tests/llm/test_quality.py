import random
import re
from collections import Counter

import zstandard

from veriframe.llm import op09_quality as op


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    hit = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def texts():
    rng = random.Random(9)
    out = [None, "", " \n\t", "é" * 3000, "a b c d e f g h " * 2, "x " * 19, "x " * 20, "one\ntwo\none\n\n\n one\none", "日本 " * 40 + "#*$%&|<>", "     a"]
    for _ in range(150):
        vocab = [f"w{i}" for i in range(rng.choice((1, 3, 40, 400)))]
        words = rng.choices(vocab, k=rng.randint(0, 300))
        if rng.random() < 0.5 and len(words) > 30:
            words[20:20] = words[3 : 3 + rng.randint(5, 15)]
        out.append("".join(w + rng.choice(" \n\t") for w in words))
    return out + [" ".join(f"word{i}" for i in range(60_000))]


def test_counts_against_brute_force(spark):
    rows = [(i, t, 5) for i, t in enumerate(texts())] + [(None, "a b", 5), (1, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    out = op.quality(df).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    for i, t in enumerate(texts()):
        r = by[i]
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == brute(t), (i, (t or "")[:80])
        assert not (r["kept"] and r["base_failed"])
    assert op.quality(df.limit(0)).count() == 0


def test_bands():
    rng = random.Random(3)
    prose = " ".join("".join(rng.choices("etaoinshrdlu", weights=range(12, 0, -1), k=rng.randint(1, 8))) for _ in range(3000)).encode()
    loops = b"".join(b"%d buy now cheap pills online today %d\n" % (i % 7, i % 5) for i in range(600))
    noise = bytes(rng.choices(range(33, 127), k=9000))
    comp = zstandard.ZstdCompressor(level=op.LEVEL)
    whole, bad = op.compression(prose, comp)
    assert op.band(len(prose))[0] <= whole <= op.band(len(prose))[1] and bad == 0
    whole, bad = op.compression(loops, comp)
    assert whole > op.band(len(loops))[1] and bad == 1
    whole, bad = op.compression(noise, comp)
    assert whole < op.band(len(noise))[0] and bad == 1


def test_keep_good_keeps_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = op.keep_good(docs)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in op.quality(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want
