"""Folds against plain loops, and the streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veriframe.operators import lines as L
from veriframe.operators import quota as Q
from veriframe.operators import regions as R


def test_group_words_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(r, w, f"w{w}", rng.random(), float(rng.randint(0, 400)), float(y := rng.randint(0, 120)), 0.0, float(y + rng.randint(5, 30))) for r in range(40) for w in range(rng.randint(1, 15))]
    rows = [(r, w, t, c, x0, y0, x0 + 20, y1) for r, w, t, c, x0, y0, _, y1 in rows]
    df = spark.createDataFrame(rows, "record_id long, word_id int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in L.group_words(df).collect():
        got.setdefault(r["record_id"], []).append((r["line_no"], r["text"]))
    for record in range(40):
        own = sorted(((y0 + y1) / 2, (x0 + x1) / 2, w, t) for r, w, t, c, x0, y0, x1, y1 in rows if r == record)
        heights = sorted(y1 - y0 for r, w, t, c, x0, y0, x1, y1 in rows if r == record)
        tol = max(0.65 * heights[len(heights) // 2], 8)
        groups, at = [], None
        for cy, cx, w, t in own:
            if at is not None and abs(cy - at) <= tol:
                groups[-1].append((cx, w, t))
                at = (at + cy) / 2
            else:
                groups.append([(cx, w, t)])
                at = cy
        want = [(i + 1, " ".join(t for _, _, t in sorted(g))) for i, g in enumerate(groups)]
        assert sorted(got[record]) == want


def test_warning_block(spark):
    mk = lambda r, *ls: [(r, i, t, 0.9, y, 0.0, y - 5, y + 5, 10.0) for i, (t, y) in enumerate(ls)]
    rows = (
        mk(1, ("brand", 10.0), ("GOVERNMENT WARNING: (1) a", 30.0), ("www.noise", 50.0), ("b", 65.0), ("may cause health", 85.0), ("after", 100.0))
        + mk(2, ("government  warning: a", 10.0), ("far", 60.0)) + mk(3, ("none", 10.0)) + mk(4, ("GOVERNMENT WARNING x", 10.0), ("scan here", 60.0), ("y", 70.0))
    )
    df = spark.createDataFrame(rows, "record_id long, line_id int, text string, confidence double, y_center double, x_min double, y_min double, y_max double, x_max double")
    got = {r["record_id"]: r["warning"] for r in L.warning_block(df).collect()}
    assert got == {1: "GOVERNMENT WARNING: (1) a b may cause health", 2: "government warning: a", 3: "", 4: "GOVERNMENT WARNING x"}
    region = {r["record_id"]: r["warning"] for r in L.warning_block(df, 40.0).collect()}
    assert region[2] == "government warning: a far"


def test_box_merge_against_a_loop(spark):
    rng = random.Random(6)
    rows = []
    for r in range(50):
        for b in range(rng.randint(1, 7)):
            x, y = rng.randint(0, 60), rng.randint(0, 60)
            rows.append((r, b, x, y, x + rng.randint(1, 50), y + rng.randint(1, 50)))
    df = spark.createDataFrame(rows, "record_id long, box_id int, x0 int, y0 int, x1 int, y1 int")
    got = {}
    for m in R.merged_boxes(df).collect():
        got.setdefault(m["record_id"], []).append((m["place"], m["x0"], m["y0"], m["x1"], m["y1"]))
    for r in range(50):
        kept = []
        for _, b, x0, y0, x1, y1 in sorted((-(q[4] - q[2]) * (q[5] - q[3]), *q[1:]) for q in rows if q[0] == r):
            for i, (a0, b0, a1, b1) in enumerate(kept):
                w, h = min(x1, a1) - max(x0, a0), min(y1, b1) - max(y0, b0)
                if w > 0 and h > 0 and w * h / max((x1 - x0) * (y1 - y0), 1) >= 0.35:
                    kept[i] = (min(x0, a0), min(y0, b0), max(x1, a1), max(y1, b1))
                    break
            else:
                kept.append((x0, y0, x1, y1))
        assert [g[1:] for g in sorted(got[r])] == kept


def grants(rows, limit):
    used, out = {}, []
    for tenant, seq, n in sorted(rows):
        ok = limit <= 0 or used.get(tenant, 0) + n <= limit
        used[tenant] = used.get(tenant, 0) + (n if ok else 0)
        out.append((tenant, seq, n, ok, used[tenant]))
    return out


def test_quota(spark):
    rng = random.Random(1)
    rows = [(t, s, rng.randint(1, 5)) for t in range(10) for s in range(rng.randint(1, 12))]
    df = spark.createDataFrame(rows, "tenant long, seq long, n int")
    for limit in (10, 0):
        assert sorted(tuple(r) for r in Q.reserve(df, limit).collect()) == grants(rows, limit)
    left = Q.remaining(spark.createDataFrame([(1, 7), (2, 70)], "tenant long, used long"), 50).collect()
    assert sorted((r["tenant"], r["remaining"]) for r in left) == [(1, 43), (2, 0)]
    assert Q.remaining(spark.createDataFrame([(1, 7)], "tenant long, used long"), 0).first()["remaining"] == Q.NO_LIMIT


def test_quota_blocks(spark):
    """A hot tenant in blocks of blocks, ties, nulls, empty tables; no task gets it whole, no Python."""
    rng = random.Random(4)
    rows = [(1, s, rng.randint(0, 3)) for s in range(3000)] + [(t, s, rng.randint(1, 9)) for t in range(2, 40) for s in range(rng.randint(1, 20))] + [(2, 5, 1), (2, 5, 1)]
    df = spark.createDataFrame(rows, "tenant long, seq long, n int").repartition(6)
    for limit, width in ((10, 4), (1000, 16), (0, 7), (-1, 3000)):
        assert sorted(tuple(r) for r in Q.reserve(df, limit, width).collect()) == grants(rows, limit)
    odd = spark.createDataFrame([(None, 1, 3), (None, 2, None), ("a", 1, 11)], "tenant string, seq long, n int")
    got = {(r["tenant"], r["seq"]): (r["granted"], r["used"]) for r in Q.reserve(odd, 10, 2).collect()}
    assert got == {(None, 1): (True, 3), (None, 2): (True, 3), ("a", 1): (False, 0)}
    assert Q.reserve(df.limit(0), 10).count() == 0
    assert "Python" not in Q.reserve(df, 10, 4)._jdf.queryExecution().toString()


def test_quota_stream(spark, tmp_path):
    """Requests in shuffled order over several micro-batches and a restart: the grants of the batch, each once."""
    from veriframe.streaming.verify import quota_stream

    rng = random.Random(7)
    rows = [(t, s, 1 + (t + s) % 4) for t in range(5) for s in range(8)]
    kind = "tenant long, seq long, n int, ts timestamp"

    def arrive(some):
        timed = spark.createDataFrame([(t, s, n, 1_000_000 + 60 * s) for t, s, n in some], "tenant long, seq long, n int, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        timed.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        grants_of = quota_stream(stream, 10, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        grants_of.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)

    mixed = rng.sample(rows, len(rows))
    for part in (mixed[:15], mixed[15:25]):
        arrive(part)
    run()
    assert not list((tmp_path / "out").glob("*.parquet")) or spark.read.parquet(str(tmp_path / "out")).count() == 0  # all wait for earlier ones
    arrive(mixed[25:])
    run()
    arrive([(99, 1000, 1)])  # the watermark passes all others
    run()
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.filter("tenant < 99").select("tenant", "seq", "n", "granted", "used").collect()) == grants(rows, 10)


def test_verify_stream(spark, tmp_path):
    from veriframe.plans import corpus as K
    from veriframe.plans import queries
    from veriframe.streaming.verify import verify_stream

    sf = "/root/testdata/sf0.001"
    K.reads(spark, sf).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("record_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    verify_stream(stream, K.claims(spark, sf), str(tmp_path / "out"), str(tmp_path / "cp"), fuzzy=False).awaitTermination(180)
    key = lambda df: sorted(tuple(r) for r in df.select("record_id", "overall_status", "rescue_keys").collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(queries.queries()["record_rollup"](spark, sf))


def test_event_windows(spark):
    """The extension for reports: tumbling windows over events, with Spark's own operators."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    assert out.agg(F.sum("n")).first()[0] == e.count()


def test_usage_snapshots(spark, tmp_path):
    from veriframe.sources.usage import VersionTaken, read_usage, read_version, write_usage

    path = str(tmp_path / "usage")
    assert read_usage(spark, path).count() == 0
    grants = spark.createDataFrame([(1, 2, True), (1, 9, False), (2, 3, True)], "tenant long, n int, granted boolean")
    write_usage(grants, path, 1)
    write_usage(grants, path, 2, read_usage(spark, path))
    assert sorted(tuple(r) for r in read_usage(spark, path).collect()) == [(1, 4), (2, 6)]
    with pytest.raises(VersionTaken):
        write_usage(grants, path, 2)
    assert read_version(spark, path)[0] == 2
    # a damaged version falls back to the one before, and nothing whole reads as no use
    for version, left in ((2, [(1, 2), (2, 3)]), (1, [])):
        said = json.loads((tmp_path / "usage" / "commits" / f"{version:012d}").read_text())
        for part in (tmp_path / "usage" / "data" / said["data"]).glob("part-*"):
            part.write_bytes(b"garbage")
        for checksum in (tmp_path / "usage" / "data" / said["data"]).glob(".part-*.crc"):
            checksum.unlink()
        assert sorted(tuple(r) for r in read_usage(spark, path).collect()) == left
    (tmp_path / "usage" / "commits" / "000000000003").write_text("{not json")
    assert read_usage(spark, path).count() == 0


def test_improved_and_clarified_brand(spark):
    from veriframe.operators import brand as Br

    claims = spark.createDataFrame([(i, "Old Lantern Distillery") for i in range(5)], "record_id long, brand_name string")
    reads = spark.createDataFrame([(0, "01d L4nt3rn D1st1ll3ry\n45%"), (1, "Small Batch\nRye Whiskey"), (2, "Old Lantern Distillery\n45%"), (3, ""), (4, "Blue Heron\n45%")], "record_id long, text string")
    more = spark.createDataFrame([(i, p, t) for i in range(4) for p, t in enumerate(("750 mL", "Batch 7 Lot 9", "Old Lantern Distillery", "old lantern distillery"))] + [(4, 0, "zzz")], "record_id long, pos int, line string")
    found = Br.candidates(more)
    assert [tuple(r) for r in found.filter("record_id = 0").collect()] == [(0, 2, "Old Lantern Distillery")]
    got = {r["record_id"]: r["text"] for r in Br.improve(reads, found, claims).collect()}
    assert got == {0: "Old Lantern Distillery\n45%", 1: "Old Lantern Distillery\nSmall Batch\nRye Whiskey", 2: "Old Lantern Distillery\n45%", 3: "", 4: "Blue Heron\n45%"}
    shown = {r["record_id"]: r["text"] for r in Br.clarified(reads, claims).collect()}
    assert shown[0].startswith("Old Lantern Distillery  [script OCR read: 01d") and shown[2] == "Old Lantern Distillery\n45%" and shown[4] == "Blue Heron\n45%"


def test_group_words_of_a_long_record(spark):
    """A record of 60,000 words: lines by the loop, and no array longer than a segment's."""
    rng = random.Random(6)
    rows = [(1, i, f"w{i}", 0.5, float(rng.randint(0, 800)), float((i // 12) * 30 + rng.randint(-4, 4))) for i in range(60_000)]
    df = spark.createDataFrame([(r, w, t, c, x, y, x + 20, y + 10) for r, w, t, c, x, y in rows], "record_id long, word_id int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    out = L.group_words(df.repartition(8)).orderBy("line_no").collect()
    own = sorted(((y + 5.0, x + 10.0, w) for _, w, _, _, x, y in rows))
    groups, at = [], None
    for cy, cx, w in own:
        if at is not None and abs(cy - at) <= 8:
            groups[-1].append((cx, w))
            at = (at + cy) / 2
        else:
            groups.append([(cx, w)])
            at = cy
    assert [r["text"] for r in out] == [" ".join(f"w{w}" for _, w in sorted(g)) for g in groups]
    assert [r["line_no"] for r in out] == list(range(1, len(groups) + 1))


def test_upper_median_under_skew(spark):
    """Equal values, near ones beside an outlier, few distinct ones, small keys: the element at n // 2, in rounds."""
    rng = random.Random(8)
    by = {
        "near": [1.0 + rng.random() * 1e-6 for _ in range(20_000)] + [1e12], "equal": [5.0] * 15_001, "two": [1.0] * 5000 + [2.0] * 5000, "few": [float(rng.randint(0, 3)) for _ in range(9000)],
        "wide": [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(12_000)], "one": [7.25], "pair": [1.0, 2.0], None: [3.0, 1.0, 2.0],
    }
    rows = [(k, v) for k, vs in by.items() for v in vs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    for most in (50, 100_000):
        got = {r["k"]: r["v"] for r in L.upper_value(df, "k", "v", most).collect()}
        assert got == {k: sorted(vs)[len(vs) // 2] for k, vs in by.items()}
    assert L.upper_value(df.limit(0), "k", "v").count() == 0


def test_box_merge_in_clusters(spark):
    """Clusters give what one fold gives: scattered boxes, touching ones, chains and a crowd."""
    rng = random.Random(12)

    def some(n, canvas, most):
        out = []
        for i in range(n):
            x, y, w, h = rng.randrange(canvas), rng.randrange(canvas), rng.randint(1, most), rng.randint(1, most)
            out += [(i, x, y, x + w, y + h)]
        return out

    rows = [(r, *b) for r, (n, canvas, most) in enumerate([(300, 4000, 60), (200, 300, 60), (120, 1000, 400), (1, 10, 5), (250, 2500, 20)]) for b in some(n, canvas, most)]
    rows += [(9, i, 10 * i, 0, 10 * i + 14, 10) for i in range(100)] + [(10, i, 10 * i, 0, 10 * i + 10, 10) for i in range(100)]
    df = spark.createDataFrame(rows, "record_id long, box_id int, x0 int, y0 int, x1 int, y1 int").repartition(6)
    one = sorted(tuple(r) for r in R.merged_boxes(df, many=10_000).collect())
    assert sorted(tuple(r) for r in R.merged_boxes(df, many=20).collect()) == one
    apart = R._clusters(df.filter("record_id = 4"))
    assert apart.select("cluster").distinct().count() > 20
    assert R.merged_boxes(df.limit(0)).count() == 0


def test_box_merge_of_a_large_record(spark):
    """100,000 boxes of one record in groups of three, of which each is merged to one."""
    df = spark.range(33_334).selectExpr("1 record_id", "id", "cast(id % 200 * 50 as int) x", "cast(id div 200 * 50 as int) y")
    df = df.selectExpr("record_id", "explode(array(0, 1, 2)) k", "id * 3 + k box_id", "x + k * 3 x0", "y + k * 2 y0", "x + 30 - k x1", "y + 25 y1").drop("k")
    out = R.merged_boxes(df).agg(F.count("*").alias("n"), F.max("place").alias("last"), F.min(F.col("x1") - F.col("x0")).alias("w")).first()
    assert (out["n"], out["last"], out["w"]) == (33_334, 33_333, 30)
