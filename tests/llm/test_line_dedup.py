import random

from veriframe.llm import op06_line_dedup as op


def gone_by_definition(docs):
    """Positions of lines in a run of MIN_LINES lines or MIN_WORDS words that stands at any earlier position."""
    earlier, gone = set(), {}
    for d, t in docs:
        lines = [" ".join(x.split()) for x in t.split("\n") if x.strip()]
        own = set()
        for p in range(len(lines)):
            for n in range(1, len(lines) - p + 1):
                run = tuple(lines[p : p + n])
                if run in earlier and (n >= op.MIN_LINES or sum(len(x.split()) for x in run) >= op.MIN_WORDS):
                    own |= set(range(p, p + n))
            # runs that start here count for later places
            earlier |= {tuple(lines[p : p + n]) for n in range(1, len(lines) - p + 1)}
        gone[d] = own
    return gone


def check(spark, docs):
    """The operator on docs (in order of doc_id) against the definition."""
    want = gone_by_definition(docs)
    rows = op.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        kept, k, gone = [], 0, want[r["doc_id"]]
        for line in texts[r["doc_id"]].split("\n"):
            if line.strip():
                k += 1
                if k - 1 in gone:
                    continue
            kept.append(line)
        assert (r["text"], r["n_lines"], r["n_deleted"]) == ("\n".join(kept), k, len(gone)), r["doc_id"]
    return want


def test_copied_lines_against_the_definition(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choices("abcdefghij", k=rng.choice((1, 3, 6, 45)))) for _ in range(30)]
    docs = [(None, "x\ny\nz")]
    for d in range(120):
        lines = [rng.choice(pool) if rng.random() < 0.4 else f"own {d} {i}" for i in range(rng.randint(0, 14))]
        if rng.random() < 0.4 and d:
            other = rng.choice(docs)[1].split("\n")
            lines[2:2] = other[1 : 1 + rng.randint(2, 7)] + ["  "]
        docs.append((d, "\n".join(lines)))
    check(spark, [*docs, (501, ""), (502, "\n\n"), (503, "same\n" * 9), (504, " x \ny\n\n z")])


def test_a_run_of_four_lines_whose_middle_stood_elsewhere(spark):
    docs = [(1, "b 1\nb 2"), (2, "a 1\nb 1\nb 2\na 4"), (3, "c\na 1\nb 1\nb 2\na 4\nd")]
    assert check(spark, docs)[3] == {1, 2, 3, 4}


def test_repeated_rows_stay_alike(spark):
    text = "one two\nthree four\nfive six"
    docs = [(5, text), (5, text), (6, text), (None, text), (None, None)]
    rows = op.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_deleted"]) for r in rows) == [(0, 0), (0, 0), (5, 3), (5, 3), (6, 3)]
    assert sum(r["text"] is None for r in rows) == 1


def test_long_single_line_is_found(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in op.dedup_lines(df).collect()}
    assert out == {1: f"a\n{passage}\nb", 2: "c\nd"}


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, runs string, text string, n int")
    assert op.dedup_lines(df).columns == ["doc_id", "runs", "text", "n", "n_lines", "n_deleted"]
    assert op.dedup_lines(df).count() == 0
    df = spark.createDataFrame([(1, "r", "a b", 7)], df.schema)
    assert op.dedup_lines(df).first()["runs"] == "r"
    clash = "h int, row string, doc string, text string, print long, pos int, __h1 long, runs int, doc_id long, n_lines int"
    df = spark.createDataFrame([(1, "r", "d", "a b", 5, 6, 7, 8, 9, 3)], clash)
    assert op.dedup_lines(df, "lines", "deleted").first() == (1, "r", "d", "a b", 5, 6, 7, 8, 9, 3, 1, 0)


def test_against_all_earlier_positions(spark):
    rng = random.Random(9)
    docs = []
    for k in range(12):  # lines X, Y stand in another context first
        x, y, z = (" ".join(f"{c}{k}_{i}" for i in range(10)) for c in "xyz")
        docs += [(100 * k + 1, f"{x}\n{y}\nother {k}"), (100 * k + 2, f"odd {k}\n{y}\n{z}"), (100 * k + 5, f"{x}\n{y}\n{z}"), (100 * k + 9, f"own {k}\n{x}\n{y}\n{z}\nend {k}")]
    pool = [" ".join(rng.choices("abcdef", k=rng.choice((1, 3, 15, 45)))) for _ in range(8)]
    docs.sort()
    docs += [(5000 + d, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for d in range(60)]
    assert all(check(spark, docs)[100 * k + 9] == {1, 2, 3} for k in range(12))


def test_windows_select_the_same_grams():
    """Equal runs of three lines select the same gram in any surroundings; about two grams of three are selected."""
    from veriframe.llm.common import WordHasher

    rng, hasher = random.Random(2), WordHasher()
    lines = [[f"{rng.randint(0, 10**9)}".encode()] for _ in range(6000)]
    rows = list(op.marks(lines, hasher))
    assert 0.6 * len(lines) < len(rows) < 0.72 * len(lines)
    windows = {(v, -1, b): p - 1 for v, p, n, b, a in rows if b is not None} | {(v, 1, a): p for v, p, n, b, a in rows if a is not None}
    assert sorted(windows.values()) == list(range(len(lines) - 2))
    for at in range(0, 5900, 50):
        own = list(op.marks([[b"x"], *lines[at : at + 3], [b"y"]], hasher))
        keys = {(v, -1, b): p - 1 for v, p, n, b, a in own if b is not None} | {(v, 1, a): p for v, p, n, b, a in own if a is not None}
        assert {p: k for k, p in keys.items()}[1] in windows
    assert list(op.marks(lines[:2], hasher)) == []


def test_matches_are_extended_to_whole_runs(spark):
    """A copied passage of 30 lines is one run, between strange lines and after fragments of it elsewhere."""
    passage = [f"line {i} of it" for i in range(30)]
    docs = [(1, passage[4:9]), (2, ["a", *passage, "b"]), (3, ["c", "d", *passage, "e"])]
    df = spark.createDataFrame([(d, "\n".join(t)) for d, t in docs], "doc_id long, text string")
    from veriframe.llm.common import content_key

    runs = {r["doc_id"]: sorted((x["from"], x["to"]) for x in r["runs"]) for r in op.repeated_runs(content_key(df)).collect()}
    assert runs == {2: [(5, 9)], 3: [(2, 7), (6, 10), (9, 31)]}


def test_very_long_text_and_two_texts_of_one_id(spark):
    long = "\n".join(f"row {i}" for i in range(40_000))
    docs = [(1, long), (2, long + "\nend"), (3, "a a\nb b\nc c\nd d"), (3, "z\na a\nb b\nc c")]
    rows = op.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_deleted"]) for r in rows) in ([(1, 40_000, 0), (2, 40_001, 40_000), (3, 4, 0), (3, 4, 3)],)
