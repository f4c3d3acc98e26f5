"""Boxes, rotations and skews as tables of candidates: boxes(record_id, box_id, x0, y0, x1, y1, img_w, img_h)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.functions import vocab as V
from veriframe.shared import met, written

PAD = 8
SPLIT = 0.48


def area() -> Column:
    return (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))


def padded(boxes: DataFrame, pad: int = PAD) -> DataFrame:
    return boxes.select("record_id", "box_id", F.greatest(F.col("x0") - pad, F.lit(0)).alias("x0"), F.greatest(F.col("y0") - pad, F.lit(0)).alias("y0"), F.least(F.col("x1") + pad, F.col("img_w")).alias("x1"), F.least(F.col("y1") + pad, F.col("img_h")).alias("y1"))


def large_enough(boxes: DataFrame) -> DataFrame:
    """Boxes of 2 % of the image's area and 8 % of either side at least."""
    return boxes.filter((area() >= F.col("img_w") * F.col("img_h") * 0.02) & (F.col("x1") - F.col("x0") >= F.col("img_w") * 0.08) & (F.col("y1") - F.col("y0") >= F.col("img_h") * 0.08))


def resized(images: DataFrame, most: int = 1600) -> DataFrame:
    """record_id, w, h: sizes of images (record_id, img_w, img_h) scaled down to a width."""
    small = F.col("img_w") <= most
    return images.select("record_id", F.when(small, F.col("img_w")).otherwise(most).alias("w"), F.when(small, F.col("img_h")).otherwise((F.col("img_h") * (F.lit(float(most)) / F.col("img_w"))).cast("int")).alias("h"))


def rotated(images: DataFrame) -> DataFrame:
    """record_id, w, h: the canvas that holds an image (record_id, img_w, img_h, degrees) after a turn."""
    turn = F.abs(F.col("degrees")) >= 0.01
    c, s = F.abs(F.cos(F.radians("degrees"))), F.abs(F.sin(F.radians("degrees")))
    return images.select("record_id", F.when(turn, (F.col("img_h") * s + F.col("img_w") * c).cast("int")).otherwise(F.col("img_w")).alias("w"), F.when(turn, (F.col("img_h") * c + F.col("img_w") * s).cast("int")).otherwise(F.col("img_h")).alias("h"))


def top_two(boxes: DataFrame) -> DataFrame:
    """The two largest boxes of a record, left to right (place 1, 2)."""
    w = Window.partitionBy("record_id")
    ranked = boxes.withColumn("r", F.row_number().over(w.orderBy(area().desc(), "box_id"))).filter("r <= 2")
    return ranked.withColumn("place", F.row_number().over(w.orderBy("x0", "box_id"))).drop("r")


def shape_role() -> Column:
    aspect = (F.col("x1") - F.col("x0")) / F.greatest(F.col("y1") - F.col("y0"), F.lit(1))
    right = (F.col("x0") + F.col("x1")) / 2.0 > F.col("img_w") * 0.45
    flat = F.col("y1") - F.col("y0") < F.col("img_h") * 0.45
    return F.when(((aspect >= 2.2) & right) | ((aspect >= 1.8) & flat), "warning").otherwise("brand")


def roles(boxes: DataFrame) -> DataFrame:
    """record_id, role, box: of two boxes by shape, by place if the shapes agree; a single warning box is both."""
    two = top_two(boxes).withColumn("shape", shape_role())
    w = Window.partitionBy("record_id")
    two = two.withColumns({"n": F.count("*").over(w), "kinds": F.size(F.collect_set("shape").over(w))})
    by_place = F.when(F.col("place") == 1, "brand").otherwise("warning")
    role = F.when(F.col("n") == 1, F.when(F.col("shape") == "brand", F.array(F.lit("brand"))).otherwise(F.array(F.lit("brand"), F.lit("warning")))).when(F.col("kinds") == 2, F.array("shape")).otherwise(F.array(by_place))
    return two.select("record_id", F.explode(role).alias("role"), "box_id", "x0", "y0", "x1", "y1")


def halves(images: DataFrame) -> DataFrame:
    """Without boxes: an image (record_id, img_w, img_h) is split at 48 % of its width."""
    cut = (F.col("img_w") * SPLIT).cast("int")
    rows = F.array(F.struct(F.lit("brand").alias("role"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), cut.alias("x1"), F.col("img_h").alias("y1")), F.struct(F.lit("warning").alias("role"), cut.alias("x0"), F.lit(0).alias("y0"), F.col("img_w").alias("x1"), F.col("img_h").alias("y1")))
    return images.select("record_id", F.explode(rows).alias("b")).select("record_id", "b.*")


#: Records of more boxes than this are folded in clusters.
MANY_BOXES = 1000


def _clusters(boxes: DataFrame) -> DataFrame:
    """boxes with cluster: boxes of different clusters of a record lie in rectangles that don't meet, so no merge can join them.

    Rectangles are dealt to the cells of a grid (as wide as the record's boxes on the average); those of a cell become one cluster, and clusters
    the rectangle around their boxes, until no two share a cell. Rectangles meet through their cells only: no pairs.
    """
    sides = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    grid = boxes.groupBy("record_id").agg(F.greatest(F.ceil(F.avg(sides)), F.lit(1)).cast("int").alias("g"))
    rows = written(boxes.join(grid, "record_id").withColumn("cluster", F.xxhash64("box_id", "x0", "y0", "x1", "y1")))
    labels = rows.select("record_id", "cluster", F.col("cluster").alias("now")).distinct()
    count = -1
    while True:
        labels = written(labels)
        now = rows.join(labels, ["record_id", "cluster"]).groupBy("record_id", "now", "g").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
        found = written(now)
        if (n := found.count()) == count:
            return rows.join(labels, ["record_id", "cluster"]).drop("cluster", "g").withColumnRenamed("now", "cluster")
        count = n
        cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / F.col("g")), F.floor(F.greatest(F.col(low), F.col(high) - 1) / F.col("g"))))
        dealt = found.select("record_id", "now", "g", "y0", "y1", cells("x0", "x1").alias("cx")).select("record_id", "now", "cx", cells("y0", "y1").alias("cy"))
        least = dealt.groupBy("record_id", "cx", "cy").agg(F.min("now").alias("least"))
        joined = dealt.join(least, ["record_id", "cx", "cy"]).groupBy("record_id", "now").agg(F.min("least").alias("least"))
        labels = labels.join(joined, ["record_id", "now"]).select("record_id", "cluster", F.col("least").alias("now"))


def merged_boxes(boxes: DataFrame, overlap: float = 0.35, many: int = MANY_BOXES) -> DataFrame:
    """Greedy merge, largest first: a box goes into the first kept one that covers ``overlap`` of its area.

    Boxes (record_id, box_id, x0, y0, x1, y1) of a record with more than ``many`` are dealt to clusters that can't meet, and each cluster is folded alone;
    what comes out is the same. A cluster's boxes are one array.
    """
    item = F.struct((-area()).alias("k"), "box_id", "x0", "y0", "x1", "y1")
    ints = boxes.select("record_id", "box_id", *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])
    box = ", ".join(f"{k}:{t}" for k, t in (("k", "int"), ("box_id", dict(ints.dtypes)["box_id"]), *((c, "int") for c in ("x0", "y0", "x1", "y1"))))
    start = F.array().cast(f"array<struct<{box}>>")

    def step(acc: Column, b: Column) -> Column:
        size = F.greatest((b["x1"] - b["x0"]) * (b["y1"] - b["y0"]), F.lit(1))
        w = lambda e: F.least(b["x1"], e["x1"]) - F.greatest(b["x0"], e["x0"])
        h = lambda e: F.least(b["y1"], e["y1"]) - F.greatest(b["y0"], e["y0"])
        into = F.array_position(F.transform(acc, lambda e: (w(e) > 0) & (h(e) > 0) & (w(e) * h(e) / size >= overlap)), True).cast("int")
        wide = {"x0": F.least, "y0": F.least, "x1": F.greatest, "y1": F.greatest}
        grown = lambda e: F.struct(e["k"].alias("k"), e["box_id"].alias("box_id"), *[f(b[c], e[c]).alias(c) for c, f in wide.items()])
        return F.when(into > 0, F.transform(acc, lambda e, i: F.when(i + 1 == into, grown(e)).otherwise(e))).otherwise(F.concat(acc, F.array(b)))

    crowded = ints.groupBy("record_id").count().filter(F.col("count") > many).select("record_id")
    dealt = ints.withColumn("cluster", F.lit(0).cast("long"))
    if not crowded.isEmpty():
        apart = _clusters(ints.join(crowded, "record_id", "left_semi"))
        dealt = dealt.join(crowded, "record_id", "left_anti").unionByName(apart)
    grouped = dealt.groupBy("record_id", "cluster").agg(F.array_sort(F.collect_list(item)).alias("b"))
    kept = grouped.select("record_id", F.inline(F.aggregate("b", start, step)))
    # a kept box stands where the box stood that it began with
    place = (F.row_number().over(Window.partitionBy("record_id").orderBy("k", "box_id", "x0", "y0", "x1", "y1")) - 1).cast("int")
    return kept.select("record_id", place.alias("place"), "x0", "y0", "x1", "y1")


def regions(boxes: DataFrame, images: DataFrame, pad: int = PAD) -> DataFrame:
    """record_id, role, x0, y0, x1, y1: the brand's and the warning's region of each image (record_id, img_w, img_h).

    Boxes too small are left out, overlapping ones merged, the two largest get their roles and a margin; an
    image without boxes is split in halves.
    """
    size = images.select("record_id", "img_w", "img_h")
    merged = merged_boxes(large_enough(boxes)).withColumnRenamed("place", "box_id").join(boxes.select("record_id", "img_w", "img_h").distinct(), "record_id")
    two = roles(merged).join(boxes.select("record_id", "img_w", "img_h").distinct(), "record_id")
    wide = padded(two.withColumn("box_id", F.col("role")), pad).withColumnRenamed("box_id", "role")
    without = size.join(wide.select("record_id").distinct(), "record_id", "left_anti")
    return wide.unionByName(halves(without))


def selection_score(readable: Column, score: Column) -> Column:
    return score * (F.lit(0.25) + F.lit(0.75) * readable)


def rotation_worth(base: Column, better: Column, angle: Column) -> Column:
    gain = better - base
    return (angle != 0) & (gain >= 0.10) & ~((base > 0) & (gain / F.when(base > 0, base).otherwise(1.0) < 0.06))


def skew_worth(skew: Column, base: Column, better: Column) -> Column:
    gain, size = better - base, F.abs(skew)
    return F.when(size <= 3, False).when(size >= 6, gain >= 0.03).when(size >= 4, gain >= 0.05).otherwise(gain >= 0.08)


def best_rotation(candidates: DataFrame) -> DataFrame:
    """record_id, angle, score: of candidates (record_id, angle, score) the best that is worth applying, else 0."""
    w = Window.partitionBy("record_id")
    rows = candidates.withColumn("base", F.max(F.when(F.col("angle") == 0, F.col("score"))).over(w))
    rows = rows.filter((F.col("angle") == 0) | ((F.col("score") > F.col("base")) & rotation_worth(F.col("base"), F.col("score"), F.col("angle"))))
    return rows.withColumn("r", F.row_number().over(w.orderBy(F.col("score").desc(), "angle"))).filter("r = 1").select("record_id", "angle", "score")


def best_read(candidates: DataFrame) -> DataFrame:
    """record_id, angle, score, upright of candidates (record_id, angle, text, score): reads of a record turned by 0 to 270 degrees.

    A read's worth is its score weighed by how readable its text is. A record whose read at 0 looks upright stays there;
    else the best angle is taken that is worth it.
    """
    worth = selection_score(T.readability(F.col("text")), F.col("score"))
    rows = candidates.select("record_id", "angle", worth.alias("worth"), ((F.col("angle") == 0) & T.looks_upright(F.col("text"), F.col("score"))).alias("up"))
    rows = rows.withColumn("upright", F.max("up").over(Window.partitionBy("record_id")))
    kept = rows.filter(~F.col("upright") | (F.col("angle") == 0)).select("record_id", "angle", F.col("worth").alias("score"), "upright")
    best = best_rotation(kept)
    return met(best, kept.filter("angle = 0").select("record_id", "upright"), "record_id").select("record_id", "angle", "score", "upright")


def best_skew(candidates: DataFrame, readable: float | None = None) -> DataFrame:
    """record_id, skew, score of candidates (record_id, pos, skew, text, score): the best small turn that is worth it, else 0.

    The candidate of skew 0 is the read as it is; of equals the first by pos counts. With ``readable``, a read
    of that readability isn't turned.
    """
    r = T.readability(F.col("text"))
    rows = candidates.select("record_id", "pos", "skew", r.alias("r"), selection_score(r, F.col("score")).alias("worth"))
    base = F.col("skew") == 0
    by = rows.groupBy("record_id").agg(
        F.max(F.when(base, F.col("worth"))).alias("base"), F.max(F.when(base, F.col("r"))).alias("r"),
        F.max(F.when(~base, F.struct("worth", (-F.col("pos")).alias("k"), "skew"))).alias("best"),
    )
    good = F.coalesce((F.col("best.worth") > F.col("base")) & skew_worth(F.col("best.skew"), F.col("base"), F.col("best.worth")), F.lit(False))
    if readable is not None:
        good = good & (F.col("r") < readable)
    return by.select("record_id", F.when(good, F.col("best.skew")).otherwise(0).alias("skew"), F.when(good, F.col("best.worth")).otherwise(F.col("base")).alias("score"))


def coarse_turns(records: DataFrame) -> DataFrame:
    """record_id, angle and skew of the first reads of a record: upright and by quarter turns."""
    return records.select("record_id", F.explode(F.array(*[F.lit(a) for a in (0, 90, 180, 270)])).alias("angle"), F.lit(0).alias("skew"))


def fine_turns(picked: DataFrame, narrow: bool = False) -> DataFrame:
    """record_id, angle, pos and skew of the second reads: small turns around the angle that the first reads chose (``best_read``).

    A text that was turned by quarters, and any text with ``narrow``, gets the shorter list.
    """
    listed = lambda skews: F.array(*[F.lit(a) for a in skews])
    skews = listed(V.SKEWS_TURNED) if narrow else F.when(F.col("angle") == 0, listed(V.SKEWS)).otherwise(listed(V.SKEWS_TURNED))
    return picked.select("record_id", "angle", F.posexplode(skews).alias("pos", "skew"))


def turn_search(candidates: DataFrame, readable: float | None = None, narrow: bool = False) -> DataFrame:
    """record_id, angle, skew, score: of candidates (record_id, angle, skew, text, score) the best quarter turn, then the best small turn at it.

    The second pass looks at the candidates of ``fine_turns`` only; ``readable`` as in ``best_skew``. Where reads cost much, read ``coarse_turns`` first, then
    the ``fine_turns`` of what ``best_read`` picks of them.
    """
    first = best_read(candidates.filter("skew = 0").drop("skew")).select("record_id", "angle")
    second = met(candidates, fine_turns(first, narrow), ["record_id", "angle", "skew"])
    base = met(candidates.filter("skew = 0"), first, ["record_id", "angle"]).withColumn("pos", F.lit(-1))
    each = second.unionByName(base).select("record_id", "pos", "skew", "text", "score")
    return met(best_skew(each, readable), first, "record_id").select("record_id", "angle", "skew", "score")


def orientation(scored: DataFrame, margin: float = 0.05) -> DataFrame:
    """How a record is read: record_id, decision, and the columns of a rotation (see compare.ROTATION).

    scored: record_id, angle and upright (of the whole, see ``best_read``), brand_angle, brand_score, brand_upright (the brand's
    score at 0), warning_angle (null without two regions), skew (of the turned whole), sweeps (false: read directly).
    direct: no turn was tried. per_region: whole at 0, warning at 0, the brand better turned by more than the margin.
    uniform: whole at 0 and not upright, both regions turned alike. whole: else, by its own angle.
    """
    apart = (F.col("warning_angle") == 0) & F.col("brand_angle").isin(90, 180, 270) & (F.col("brand_score") > F.col("brand_upright") + margin)
    alike = ~F.col("upright") & (F.col("brand_angle") == F.col("warning_angle")) & (F.col("brand_angle") != 0)
    yes = lambda c: F.coalesce(c, F.lit(False))
    whole = F.col("angle") == 0
    decision = F.when(~F.col("sweeps"), "direct").when(whole & yes(apart), "per_region").when(whole & yes(alike), "uniform").otherwise("whole")
    rows = scored.withColumn("decision", decision)
    is_ = lambda d: F.col("decision") == d
    turn = F.when(is_("uniform"), F.col("brand_angle")).when(is_("whole"), F.col("angle")).otherwise(0)
    skew = F.when(is_("uniform") | is_("whole"), F.coalesce("skew", F.lit(0))).otherwise(0)
    own = lambda c: F.when(is_("per_region"), F.col(c)).otherwise(turn)
    upright = is_("direct") | (~is_("per_region") & (turn == 0) & (skew == 0))
    inverted = is_("per_region") & (F.col("brand_angle") == 180) & (F.col("warning_angle") == 0)
    return rows.select(
        "record_id", "decision", turn.cast("int").alias("rotation_deg"), skew.cast("int").alias("skew_deg"), upright.alias("was_upright"), inverted.alias("brand_inverted"),
        is_("per_region").alias("per_region"), own("brand_angle").cast("int").alias("brand_deg"), own("warning_angle").cast("int").alias("warning_deg"),
    )


def orientation_conflict(pairs: DataFrame, margin: float = 0.05) -> DataFrame:
    """Adds conflict to pairs (brand_angle, brand_score, brand_upright, warning_angle)."""
    return pairs.withColumn("conflict", (F.col("warning_angle") == 0) & F.col("brand_angle").isin(90, 180, 270) & (F.col("brand_score") > F.col("brand_upright") + margin))
