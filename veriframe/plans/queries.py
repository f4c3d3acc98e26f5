"""The queries of the verification engine, by name. Each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.functions import vocab as V
from veriframe.operators import bins as B
from veriframe.operators import brand as Br
from veriframe.operators import compare as C
from veriframe.operators import extract as E
from veriframe.operators import lines as L
from veriframe.operators import quota as Q
from veriframe.operators import regions as R
from veriframe.plans import corpus as K
from veriframe.shared import met, shared_dir, written

_QUERIES = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict:
    return dict(_QUERIES)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def parsed(spark, sf) -> DataFrame:
    return E.parse(K.reads(spark, sf))


def line(spark, sf, n: int) -> DataFrame:
    return K.lines(spark, sf).filter(F.col("line_id") == n)


def claim_and_line(spark, sf, n: int) -> DataFrame:
    """Claims beside line n of their read."""
    return K.claims(spark, sf).join(line(spark, sf, n).select("record_id", "text"), "record_id")


def claims_and_lines(spark, sf) -> DataFrame:
    """Claims beside every line of their read."""
    return K.claims(spark, sf).join(K.lines(spark, sf).select("record_id", "line_id", "text"), "record_id")


@query
def abv_net_verdict(spark, sf):
    rows = claim_and_line(spark, sf, 4).join(line(spark, sf, 5).select("record_id", F.col("text").alias("volume")), "record_id")
    a = C.number_rule(F.col("alcohol_content"), F.col("text"), T.abv, V.ABV_TOLERANCE)["severity"]
    n = C.number_rule(F.col("net_contents"), F.col("volume"), T.millilitres, V.ML_TOLERANCE)["severity"]
    return rows.select(C.status(F.greatest(a, n)).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query
def ws_normalize(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.ws(F.col("text")).cast("binary")).alias("folded"))


@query
def brand_normalize(spark, sf):
    return K.lines(spark, sf).select("record_id", "line_id", T.brand_fold(F.col("text")).alias("folded"))


@query
def ocr_fold(spark, sf):
    return K.lines(spark, sf).select("record_id", "line_id", T.confusion_fold(F.col("text")).alias("folded"))


@query
def warning_fold(spark, sf):
    return K.lines(spark, sf).select("record_id", "line_id", T.warning_fold(F.col("text")).alias("folded"))


@query
def token_sets(spark, sf):
    rows = E.once(docs(spark, sf).select("doc_id", "text"), t=T.tokens(F.col("text")))
    return rows.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ").cast("binary")).alias("words"))


@query
def token_jaccard(spark, sf):
    return claims_and_lines(spark, sf).select("record_id", "line_id", F.round(T.jaccard(T.tokens(F.col("class_type")), T.tokens(F.col("text"))), 6).alias("overlap"))


@query
def token_set_equal(spark, sf):
    return claims_and_lines(spark, sf).select("record_id", "line_id", T.same_set(T.tokens(F.col("brand_name")), T.tokens(F.col("text"))).alias("same"))


@query
def garbled_flags(spark, sf):
    c = F.col("text")
    return K.lines(spark, sf).select("record_id", "line_id", T.is_garbled(c).alias("garbled"), T.is_garbled_prose(c).alias("garbled_prose"))


@query
def line_kinds(spark, sf):
    return L.line_kinds(K.reads(spark, sf))


@query
def noise_by_kind(spark, sf):
    kinds = L.line_kinds(K.reads(spark, sf))
    return kinds.groupBy("is_batch_lot", "is_noise", "is_discard").agg(F.count("*").alias("n"))


@query
def document_lines(spark, sf):
    rows = L.numbered_lines(docs(spark, sf).selectExpr("doc_id as record_id", "text"))
    return rows.groupBy("record_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"))


@query
def reading_order(spark, sf):
    return L.reading_order(K.lines(spark, sf)).select("record_id", "line_id", "line_no")


@query
def line_gaps(spark, sf):
    return L.line_gaps(K.lines(spark, sf)).select("record_id", "line_no", "gap")


@query
def raw_lines(spark, sf):
    return L.raw_lines(K.lines(spark, sf)).select("record_id", F.array_join("raw_lines", "|").alias("raw_lines"))


@query
def brand_read(spark, sf):
    return E.flagged(K.reads(spark, sf), T.split_lines(F.col("text"))).select("record_id", E.brand_read(F.col("f")).alias("brand"))


@query
def class_read(spark, sf):
    rows = E.flagged(K.reads(spark, sf), F.transform(T.split_lines(F.col("text")), T.ws))
    return rows.select("record_id", E.class_read(F.col("f")).alias("class_type"))


@query
def parsed_fields(spark, sf):
    return parsed(spark, sf).drop("raw_lines")


@query
def text_field_verdict(spark, sf):
    r = C.text_rule(F.col("class_type"), F.col("text"))
    return claims_and_lines(spark, sf).select("record_id", "line_id", r["severity"].alias("severity"), r["reason"].alias("reason"))


@query
def warning_verdict(spark, sf):
    p = parsed(spark, sf).select("record_id", F.col("government_warning").alias("read"))
    r = C.warning_rule(F.col("government_warning"), F.col("read"))
    return K.claims(spark, sf).join(p, "record_id").select("record_id", r["severity"].alias("severity"), r["reason"].alias("reason"))


@query
def brand_verdict_norm(spark, sf):
    r = C.brand_rule(F.col("brand_name"), C.brand_shown(F.col("text")), None)
    return claims_and_lines(spark, sf).select("record_id", "line_id", r["severity"].alias("severity"), r["reason"].alias("reason"))


@query
def brand_verdict_fuzzy(spark, sf):
    return C.compare(K.claims(spark, sf), parsed(spark, sf), fields=("brand_name",))


@query
def all_fields_long(spark, sf):
    return C.compare(K.claims(spark, sf), parsed(spark, sf), fuzzy=False).drop("claim")


@query
def record_rollup(spark, sf):
    return C.rollup(C.compare(K.claims(spark, sf), parsed(spark, sf), fuzzy=False))


@query
def verification_json(spark, sf):
    reads = K.reads(spark, sf)
    return C.results(K.claims(spark, sf), E.parse(reads), reads, fuzzy=False, rotations=_rotations(spark, sf).filter("record_id % 2 = 0"))


@query
def missing_parts(spark, sf):
    return parsed(spark, sf).select("record_id", F.array_join(T.missing_parts(F.col("government_warning")), "|").alias("missing"))


@query
def trimmed_warning(spark, sf):
    return K.reads(spark, sf).select("record_id", T.trim_warning(F.col("text")).alias("warning"))


@query
def repaired_text(spark, sf):
    return K.reads(spark, sf).select("record_id", T.repair(F.replace(F.col("text"), F.lit("Alc./Vol."), F.lit("Alc NVol."))).alias("text"))


@query
def merged_warning(spark, sf):
    first, columns = K.reads(spark, sf), ("record_id", "line_id", "text")
    # second reads: each line by itself, and (line 0) the whole read
    second = K.lines(spark, sf).select(*columns).union(first.withColumn("line_id", F.lit(0)).select(*columns)).withColumnRenamed("text", "second")
    return first.join(second, "record_id").select("record_id", "line_id", T.merge_warning(F.col("text"), F.concat(F.lit("noise "), F.col("second"))).alias("text"))


@query
def payload_fields(spark, sf):
    return B.payload_fields(K.bins(spark, sf))


@query
def ref_flatten(spark, sf):
    rows = B.payload_fields(K.bins(spark, sf))
    return rows.select("record_id", "field_key", F.array_join(B.line_refs(F.col("refs")).cast("array<string>"), ",").alias("line_nos"))


def _refs(spark, sf):
    return B.refs(K.reads(spark, sf), K.bins(spark, sf), K.claims(spark, sf))


@query
def bin_refs(spark, sf):
    return _refs(spark, sf).select("record_id", "field_key", F.array_join(F.col("line_nos").cast("array<string>"), ",").alias("line_nos"))


@query
def bin_fields(spark, sf):
    return B.picked(_refs(spark, sf))


@query
def bin_complete(spark, sf):
    return B.completed(B.picked(_refs(spark, sf)), parsed(spark, sf))


@query
def bin_validity(spark, sf):
    return B.validity(bin_complete(spark, sf), K.reads(spark, sf))


@query
def rescue_recompare(spark, sf):
    # the parsed and compared tables are used twice: written once in the shared folder
    claims, p = K.claims(spark, sf), written(parsed(spark, sf).drop("raw_lines"))
    compared = written(C.compare(claims, p))
    rescued = written(B.rescued_fields(compared, B.picked(_refs(spark, sf))))
    return C.rollup(C.with_rescue(claims, p, rescued, compared=compared))


@query
def rescue_outcomes(spark, sf):
    compared = written(C.compare(K.claims(spark, sf), parsed(spark, sf), fuzzy=False))
    rescued = B.rescued_fields(compared, B.picked(_refs(spark, sf)))
    reads = K.reads(spark, sf).withColumn("text", F.when(F.col("record_id") % 41 == 0, F.lit("")).otherwise(F.col("text")))
    return B.rescue_outcome(compared, reads, K.bins(spark, sf), rescued)


@query
def mapping_outcomes(spark, sf):
    return B.mapping_outcome(K.bins(spark, sf), bin_validity(spark, sf))


@query
def line_dedupe_union(spark, sf):
    first = L.numbered_lines(K.reads(spark, sf))
    second = first.withColumn("line", F.when(F.col("line_no") % 2 == 0, F.upper("line")).otherwise(F.concat("line", F.lit(" again"))))
    return L.union_lines(first, second)


@query
def positional_pair(spark, sf):
    from veriframe.sources.claims import pair_by_position

    part = K.part(spark, sf).selectExpr("p_partkey", "p_partkey div 50 as batch_id", "p_partkey % 50 as pos", "p_name")
    images, claims = part.filter("p_partkey % 97 != 5").select("batch_id", "pos", "p_name"), part.select("batch_id", "pos", F.col("p_partkey").alias("record_id"))
    return pair_by_position(images, claims)


@query
def hash_pair(spark, sf):
    p = parsed(spark, sf).select("record_id", F.col("net_contents").alias("read"))
    return K.claims(spark, sf).select("record_id", "net_contents").join(p, "record_id")


@query
def text_containment_join(spark, sf):
    rows = K.claims(spark, sf).join(K.reads(spark, sf), "record_id")
    return rows.select("record_id", B.first_line_with(T.split_lines(F.col("text")), F.col("class_type")).alias("line_no"))


@query
def doc_score(spark, sf):
    means = K.lines(spark, sf).groupBy("record_id").agg(F.avg("confidence").alias("line_confidence"))
    rows = K.reads(spark, sf).join(means, "record_id").select("record_id", F.col("text").alias("full_text"), "line_confidence", F.when(F.col("record_id") % 2 == 0, 0.0).otherwise(0.75).alias("avg_confidence"))
    return L.document_score(rows).select("record_id", F.round("score", 6).alias("score"))


@query
def readability(spark, sf):
    millionths = F.floor(T.readability(F.col("text")) * 1e6 + 0.5)
    return K.reads(spark, sf).select("record_id", millionths.alias("millionths"))


@query
def upright(spark, sf):
    score = (F.col("record_id") % 250).cast("double")
    return K.lines(spark, sf).select("record_id", "line_id", T.looks_upright(F.col("text"), score).alias("upright"))


@query
def warning_checks(spark, sf):
    c = F.col("text")
    return K.reads(spark, sf).select("record_id", T.warning_complete(c).alias("complete"), T.warning_ok(c).alias("ok"))


def _images(spark, sf):
    return K.part(spark, sf).selectExpr("p_partkey as record_id", "cast(800 + (p_partkey * 7) % 3000 as int) as img_w", "cast(500 + (p_partkey * 3) % 1900 as int) as img_h", "cast(p_partkey % 31 - 15 as double) as degrees")


@query
def image_sizes(spark, sf):
    return R.resized(_images(spark, sf))


@query
def rotated_sizes(spark, sf):
    return R.rotated(_images(spark, sf))


@query
def improved_brand(spark, sf):
    another = (F.col("line_id") == 1) & (F.col("record_id") % 2 == 1)
    again = K.lines(spark, sf).select("record_id", F.col("line_id").alias("pos"), F.when(another, F.lit("Old Lantern Distillery")).otherwise(F.col("text")).alias("line"))
    return Br.improve(K.reads(spark, sf), Br.candidates(again), K.claims(spark, sf))


@query
def clarified_text(spark, sf):
    return Br.clarified(K.reads(spark, sf), K.claims(spark, sf))


@query
def field_matches(spark, sf):
    """The parts of a scored verification: which fields of the parsed read agree with the claim."""
    p = parsed(spark, sf).select("record_id", *[F.col(k).alias(f"r_{k}") for k in V.FIELDS])
    rows = K.claims(spark, sf).join(p, "record_id")
    words = lambda k: F.array_sort(T.tokens(F.col(k))) == F.array_sort(T.tokens(F.col(f"r_{k}")))
    same = lambda f, k: f(F.col(k)).eqNullSafe(f(F.col(f"r_{k}")))
    return rows.select("record_id", words("brand_name").alias("brand"), words("class_type").alias("class"), same(T.abv, "alcohol_content").alias("alcohol"), same(T.millilitres, "net_contents").alias("net"))


@query
def rotation_pick(spark, sf):
    return R.best_rotation(K.angles(spark, sf))


def millionths(name: str):
    """A number in whole millionths, cut where sums of decimals don't stand."""
    return F.floor(F.col(name) * 1e6 + 0.3).alias(name)


def _turned(spark, sf) -> DataFrame:
    """Reads of a record at four angles: text, more or less of it as the angle fits, and a score."""
    text = F.when(F.col("angle") == (F.col("record_id") % 4) * 90, F.col("text")).otherwise(F.substring("text", 1, 12))
    both = met(K.angles(spark, sf), K.reads(spark, sf), "record_id")
    return both.select("record_id", "angle", text.alias("text"), (F.col("score") * F.length(text) / 3.0).alias("score"))


@query
def rotation_read(spark, sf):
    """The angle of a record's text, with the gate for reads that are upright already."""
    return R.best_read(_turned(spark, sf)).select("record_id", "angle", "upright", millionths("score"))


@query
def skew_pick(spark, sf):
    rows = K.angles(spark, sf).join(K.reads(spark, sf), "record_id")
    skew = ((F.col("angle") / 30).cast("int") - 3) * F.when(F.col("angle") == 90, 0).otherwise(1)
    found = rows.select("record_id", F.col("angle").alias("pos"), skew.alias("skew"), "text", (F.lit(1.0) + F.col("score") / 10).alias("score"))
    return R.best_skew(found).select("record_id", "skew", millionths("score"))


@query
def turn_search(spark, sf):
    """Quarter turns first, then small turns around the best, by the list of its kind."""
    skews = F.explode(F.array(*[F.lit(a) for a in sorted([0, *V.SKEWS])])).alias("skew")
    each = _turned(spark, sf).select("record_id", "angle", "text", "score", skews)
    lean = F.when(F.col("skew") == 0, 0.0).otherwise((F.col("record_id") + F.col("angle") + F.col("skew") + 15) % 7 - 2)
    found = R.turn_search(each.withColumn("score", F.col("score") * (F.lit(1.0) + lean / 20.0)))
    return found.select("record_id", "angle", "skew", millionths("score"))


def _rotations(spark, sf) -> DataFrame:
    a = K.angles(spark, sf)
    whole = R.best_rotation(a.filter("record_id % 3 != 1 or angle = 0")).select("record_id", "angle", (F.col("record_id") % 5 == 0).alias("upright"))
    at = lambda n, c: a.filter(F.col("angle") == n).select("record_id", F.col("score").alias(c))
    rows = whole.join(at(0, "brand_upright"), "record_id").join(at(180, "brand_score"), "record_id")
    return R.orientation(rows.withColumns({
        "brand_angle": F.when(F.col("record_id") % 4 == 0, 0).when(F.col("record_id") % 4 == 1, 90).otherwise(180), "warning_angle": F.when(F.col("record_id") % 6 < 3, 0).when(F.col("record_id") % 6 == 3, F.lit(None)).otherwise(180),
        "skew": F.when(F.col("record_id") % 7 == 0, 3).otherwise(0), "sweeps": F.col("record_id") % 11 != 0,
    }))


@query
def orientation_decision(spark, sf):
    return _rotations(spark, sf)


@query
def rotation_reasons(spark, sf):
    return _rotations(spark, sf).select("record_id", C.rotation_reason(*map(F.col, C.ROTATION[:5])).alias("reason"))


@query
def merged_reads(spark, sf):
    rows = K.reads(spark, sf).withColumn("raw_lines", T.split_lines(F.col("text")))
    second = K.lines(spark, sf).filter("line_id >= 5").groupBy("record_id").agg(K.joined_text())
    second = second.withColumn("raw_lines", F.transform(T.split_lines(F.col("text")), lambda x, i: F.when(i % 2 == 0, F.upper(x)).otherwise(F.concat(x, F.lit(" again")))))
    return L.merged_reads(rows, second).select("record_id", "text", F.array_join("raw_lines", "|").alias("raw_lines"))


@query
def region_roles(spark, sf):
    """Boxes to regions in one go: large ones are merged, get roles and a margin; records without any are split."""
    return R.regions(K.boxes(spark, sf), _canvas(spark, sf))


@query
def skew_gate(spark, sf):
    a = K.angles(spark, sf)
    return a.select("record_id", "angle", R.skew_worth(((F.col("record_id") % 19) - 9).cast("int"), F.lit(1.0), F.col("score")).alias("worth"))


@query
def orientation_conflict(spark, sf):
    a = K.angles(spark, sf)
    best = R.best_rotation(a).select("record_id", F.col("angle").alias("brand_angle"), F.col("score").alias("brand_score"))
    base = a.filter("angle = 0").select("record_id", F.col("score").alias("brand_upright"), F.when(F.col("record_id") % 2 == 0, 0).otherwise(90).alias("warning_angle"))
    return R.orientation_conflict(best.join(base, "record_id")).select("record_id", "brand_angle", "conflict")


def _canvas(spark, sf) -> DataFrame:
    return K.part(spark, sf).selectExpr("p_partkey as record_id", "cast(800 + p_partkey % 1000 as int) as img_w", "950 as img_h")


@query
def box_filter(spark, sf):
    return R.large_enough(K.boxes(spark, sf)).select("record_id", "box_id")


@query
def box_padding(spark, sf):
    return R.padded(K.boxes(spark, sf), 30)


@query
def top_two_boxes(spark, sf):
    return R.top_two(K.boxes(spark, sf)).select("record_id", "place", "box_id")


@query
def box_roles(spark, sf):
    return R.roles(K.boxes(spark, sf)).select("record_id", "role", "box_id")


@query
def box_halves(spark, sf):
    return R.halves(_canvas(spark, sf))


@query
def box_merge(spark, sf):
    return R.merged_boxes(K.boxes(spark, sf))


def _words(spark, sf):
    return K.lines(spark, sf).select(
        "record_id", (F.col("line_id") / 4).cast("int").alias("block"), (F.col("line_id") % 4).cast("int").alias("paragraph"),
        F.when(F.col("line_id") % 3 == 0, 0.0).otherwise(F.col("confidence")).alias("base"), "x_min", "y_min", "y_max", F.posexplode(F.split("text", " ")).alias("pos", "text"),
    ).select("record_id", "block", "paragraph", "pos", "text", F.when(F.col("pos") % 5 == 4, 0.0).otherwise(F.col("base")).alias("confidence"), (F.col("x_min") + F.col("pos") * 50).alias("x0"), F.col("y_min").alias("y0"), (F.col("x_min") + F.col("pos") * 50 + 45).alias("x1"), F.col("y_max").alias("y1"))


@query
def paragraph_fold(spark, sf):
    return L.paragraphs(_words(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query
def line_group_fold(spark, sf):
    words = _words(spark, sf).withColumn("word_id", F.col("block") * 1000 + F.col("paragraph") * 100 + F.col("pos")).drop("block", "paragraph", "pos")
    return L.group_words(words).withColumn("confidence", F.round("confidence", 6))


@query
def warning_block(spark, sf):
    return L.warning_block(K.lines(spark, sf))


@query
def warning_block_region(spark, sf):
    return L.warning_block(K.lines(spark, sf), V.GAP_REGION)


@query
def assembled_text(spark, sf):
    return E.assemble(K.lines(spark, sf))


@query
def assembled_documents(spark, sf):
    """Assembled texts beside whole ones: a record of noise falls back to its document, a document without lines keeps its text."""
    # the kinds of records are told apart by the key's remainder: a shifted id may be that of another record
    key = lambda kind: (F.col("record_id") * 3 + kind).alias("record_id")
    lines, claims = K.lines(spark, sf).withColumn("record_id", key(0)), K.claims(spark, sf)
    noise = claims.select(key(2), F.lit(1).alias("line_id"), F.lit("www.example.com scan here").alias("text"), *[F.lit(x).alias(c) for c, x in (("confidence", 0.5), ("y_center", 10.0), ("x_min", 0.0), ("y_min", 0.0), ("y_max", 20.0), ("x_max", 300.0))])
    text = lambda df, kind, name: df.select(key(kind), F.col(name).alias("full_text"))
    documents = text(K.reads(spark, sf), 0, "text").union(text(claims, 1, "brand_name")).union(text(claims, 2, "class_type"))
    return E.assemble(lines.unionByName(noise), documents).selectExpr("record_id div 3 + record_id % 3 * 1000000 as record_id", "text")


@query
def text_preview(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.preview(F.col("text")).cast("binary")).alias("preview"))


@query
def quota_greedy(spark, sf):
    return Q.reserve(K.requests(spark, sf), 10)


@query
def quota_remaining(spark, sf):
    used = K.requests(spark, sf).groupBy("tenant").agg(F.sum("n").cast("long").alias("used"))
    return Q.remaining(used, 50)


@query
def upper_median(spark, sf):
    return L.upper_median(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "value")


@query
def score_report(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    expected = labels.select(F.col("doc_id").alias("record_id"), F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("expected"))
    results = labels.filter("doc_id % 7 != 0").select(F.col("doc_id").alias("record_id"), F.when(F.col("doc_id") % 5 == 0, "REVIEW").when(F.col("toxic") == 1, "FAIL").otherwise("PASS").alias("overall_status"))
    return C.score(results, expected)


@query
def reader_report(spark, sf):
    """Verdicts and times of three readers, written as a report file and read back."""
    from veriframe.sources.claims import write_report

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    expected = labels.select(F.col("doc_id").alias("record_id"), F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("expected"))
    reader = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    each = labels.select(F.col("doc_id").alias("record_id"), "toxic", reader.alias("r"))
    verdict = F.when((F.col("record_id") + F.col("r")) % 5 == 0, "REVIEW").when(F.col("toxic") == 1, "FAIL").otherwise("PASS")
    results = each.select(F.concat(F.lit("reader "), F.col("r").cast("string")).alias("reader"), "record_id", verdict.alias("overall_status"), ((F.col("record_id") * (F.col("r") + 3) % 97) / 8.0).alias("seconds"))
    path, report = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}", C.reader_report(results, expected)
    write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query
def sample_names(spark, sf):
    p = K.part(spark, sf)
    a, b = p.filter("p_size % 2 = 0").select(F.col("p_brand").alias("name")), p.filter("p_size % 3 = 0").select(F.col("p_brand").alias("name"))
    return a.union(b).distinct().join(a.intersect(b).withColumn("in_both", F.lit(True)), "name", "left").withColumn("in_both", F.coalesce("in_both", F.lit(False)))


@query
def claims_from_json(spark, sf):
    from veriframe.sources.claims import parse_claims

    packed = K.claims(spark, sf).withColumn("batch_id", F.expr("record_id div 20")).groupBy("batch_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("record_id", *V.FIELDS)))).alias("body"))
    return parse_claims(packed, "body").groupBy("batch_id").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"), F.count_if(F.col("net_contents") == "1.5 L").alias("litres"))


@query
def detection_tuples(spark, sf):
    from veriframe.sources.connectors import detections

    rows = K.lines(spark, sf).select("record_id", "line_id", F.when(F.col("record_id") % 2 == 0, F.to_json(F.array(F.lit("[]"), "text", F.lit("0.5")))).otherwise(F.to_json(F.array(F.lit("[]"), "text"))).alias("detection"))
    return detections(rows).select("record_id", "line_id", "text", "confidence")


@query
def order_totals_verdict(spark, sf):
    """The verdict machinery on numeric claims: an order's total against the sum of its lines."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("total"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
    severity = F.when(F.col("total").isNull(), C.REVIEW).when(F.abs(F.col("total") - F.col("o_totalprice")) < 50000, C.PASS).otherwise(C.FAIL)
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(C.status(severity).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query
def reads_source(spark, sf):
    """Lines of a folder of files, through the data source of reads: how often each stands there."""
    from veriframe.sources import reads

    reads.register(spark)
    folder = f"{shared_dir(spark)}/reads-{uuid.uuid4().hex}"
    K.lines(spark, sf).select("text").write.option("maxRecordsPerFile", 500_000).text(folder)
    found = spark.read.format(reads.NAME).schema("text string, confidence double").option("path", folder).load()
    return found.groupBy("text").agg(F.count("*").alias("n"), F.min("confidence").alias("confidence"))


@query
def usage_snapshot(spark, sf):
    """Grants in two versions of the counter: all tenants, then those of even number again."""
    from veriframe.sources.usage import read_usage, write_usage

    path = f"{shared_dir(spark)}/usage-{uuid.uuid4().hex}"
    granted = Q.reserve(K.requests(spark, sf), 10)
    write_usage(granted, path, 1)
    write_usage(granted.filter("tenant % 2 = 0"), path, 2, read_usage(spark, path))
    return read_usage(spark, path)


@query
def event_log(spark, sf):
    """The events of a stream of verdicts, in batches of 50 records, written by the sink and read back."""
    from veriframe.streaming.events import emit, read_events

    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    batch, record = F.expr("record_id div 50"), F.col("record_id")
    verdicts = record_rollup(spark, sf).select(batch.alias("batch_id"), (record % 50 + 1).cast("int").alias("k"), F.lit(50).alias("n"), "record_id", F.col("overall_status").alias("status"))
    verdicts.write.parquet(f"{path}/results")
    emit(spark.readStream.schema(verdicts.schema).parquet(f"{path}/results"), f"{path}/log", f"{path}/checkpoint", limit=1_000_000).awaitTermination()
    return read_events(spark, f"{path}/log").drop("micro_batch")


@query
def quota_stream(spark, sf):
    """Quotas of a stream of requests: in order of time within a tenant, whatever the order of arrival."""
    from veriframe.streaming.verify import quota_stream

    path = f"{shared_dir(spark)}/quota-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id as tenant", "event_id as seq", "1 + event_id % 4 as n", "cast(ts as timestamp) as ts")
    # a request of nobody, later than all, lets the watermark pass the last one
    last = events.agg(F.expr("max(ts) + interval 1 day").alias("ts")).select(F.lit(-1).cast("long").alias("tenant"), F.lit(0).cast("long").alias("seq"), F.lit(1).cast("long").alias("n"), "ts")
    events.unionByName(last).write.parquet(f"{path}/requests")
    grants = quota_stream(spark.readStream.schema(events.schema).parquet(f"{path}/requests"), 10)
    grants.writeStream.format("parquet").option("path", f"{path}/grants").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(grants.schema).parquet(f"{path}/grants").filter("tenant >= 0")


def _stub_model(prompt: str) -> str:
    """Stands for a language model: fails on lines with an address."""
    if "www." in prompt:
        raise RuntimeError("no answer")
    return K.STUB_ANSWER


@query
def model_rescue(spark, sf):
    """Unclear fields re-mapped by a model's answers: verdicts, and why a record has none."""
    from veriframe.sources import models

    claims, reads, p = K.claims(spark, sf), K.reads(spark, sf), written(parsed(spark, sf).drop("raw_lines"))
    compared = written(C.compare(claims, p))
    return models.rescue(claims, reads, p, compared, _stub_model, f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}")
