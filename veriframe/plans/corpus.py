"""Derived fixtures: claims, label lines and other inputs from the driver's tables, with faults keyed by modulo.

The expressions are plain SQL that Spark and DuckDB read alike; only the explode of line numbers differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriframe import ship

WARNING_TAIL = (
    "(1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects.",
    "(2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems.",
)

CLAIMS = f"""
select p_partkey as record_id,
  case when p_partkey % 4 = 0 then 'Old Lantern Distillery' when p_partkey % 4 = 1 then 'Copper Fox Ridge' when p_partkey % 4 = 2 then 'Blue Heron' else 'Stone & Mill Co.' end as brand_name,
  case when p_partkey % 3 = 0 then 'Kentucky Straight Bourbon Whiskey' when p_partkey % 3 = 1 then 'Small Batch Rye Whiskey' else 'Indiana Blended Whisky' end as class_type,
  cast(40 + p_size % 21 as string) || '% Alc./Vol. (' || cast(2 * (40 + p_size % 21) as string) || ' Proof)' as alcohol_content,
  case when p_partkey % 10 = 3 then '1.5 L' else '750 mL' end as net_contents,
  'GOVERNMENT WARNING: {WARNING_TAIL[0]} {WARNING_TAIL[1]}' as government_warning
from part"""

N_LINES = 9
_LINES = f"""
select record_id, line_id,
  case line_id
    when 1 then case when k % 17 = 0 then '' when k % 11 = 0 then replace(brand_name, 'o', 'u') when k % 13 = 0 then replace(replace(brand_name, 'l', '1'), 'e', '3')
                     when k % 19 = 0 then upper(brand_name) when k % 29 = 0 then '  ' || brand_name || '  ' when k % 27 = 0 then chr(9) || brand_name || chr(160) when k % 33 = 1 then brand_name || ' [script OCR read: xyz]' else brand_name end
    when 2 then case when k % 2 = 0 then 'Batch No. 7 Lot ' || cast(k as string) when k % 5 = 1 then 'Small Batch' else 'Bottled by hand' end
    when 3 then case when k % 43 = 0 then chr(9) || class_type when k % 7 = 0 then replace(class_type, 'i', 'y') when k % 23 = 0 then 'Kentucky' else class_type end
    when 4 then case when k % 5 = 0 then '41.5% Alc./Vol.' when k % 31 = 0 then '' else alcohol_content end
    when 5 then case when k % 6 = 0 then '700 ML' when k % 25 = 0 then '25 fl oz' else net_contents end
    when 6 then case when k % 9 = 0 then 'Government Warning: (1) According to the' when k % 37 = 0 then '' else 'GOVERNMENT  WARNING : ( 1 ) According to the' end
    when 7 then 'Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects .'
    when 8 then case when k % 8 = 0 then 'Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems.'
                     when k % 15 = 0 then '(2) Consumption of alcoholic drinks impairs your ability to drive car or operate machinery , and may cause health problems'
                     else '( 2 ) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems.' end
    else case when k % 21 = 0 then chr(160) || chr(9) when k % 3 = 0 then 'www.example.com scan here' else 'Product of somewhere' end end as text,
  cast(50 + (k * line_id) % 50 as double) / 100.0 as confidence,
  cast(line_id * 40 + k % 3 as double) as y_center, cast((k * 7 + line_id) % 30 as double) as x_min,
  cast(line_id * 40 + k % 3 - 10 - case when k % 12 = 1 and line_id = 8 then -25 else 0 end as double) as y_min,
  cast(line_id * 40 + k % 3 + 10 as double) as y_max, cast(300 as double) as x_max
from (select *, record_id as k from claims) c"""

LINES_SPARK = _LINES + f" lateral view explode(sequence(1, {N_LINES})) t as line_id"
LINES_DUCKDB = _LINES + f", (select unnest(range(1, {N_LINES + 1})) as line_id) t"

#: Boxes: two large ones and small ones on a canvas of 1800 x 950.
BOXES = """
select record_id, box_id, x0, y0,
  x0 + case box_id when 1 then cast(500 + k % 300 as int) when 2 then cast(700 + k % 400 as int) else cast(60 + k % 150 as int) end as x1,
  y0 + case box_id when 1 then cast(700 + k % 200 as int) when 2 then cast(200 + (k * 7) % 500 as int) else cast(40 + k % 90 as int) end as y1, 1800 as img_w, 950 as img_h
from (select p_partkey as record_id, p_partkey as k, b as box_id,
        case b when 1 then cast(20 + p_partkey % 40 as int) when 2 then cast(600 + (p_partkey * 3) % 400 as int) else cast((p_partkey * 13) % 900 as int) end as x0,
        case b when 1 then cast(10 + p_partkey % 30 as int) when 2 then cast(100 + p_partkey % 300 as int) else cast((p_partkey * 17) % 500 as int) end as y0
      from part {explode}) q
where not (box_id = 2 and k % 9 = 0)"""
BOXES_SPARK = BOXES.format(explode="lateral view explode(sequence(1, 3)) t as b")
BOXES_DUCKDB = BOXES.format(explode=", (select unnest(range(1, 4)) as b) t")

#: Rotation candidates: four angles of a record with a score each.
ANGLES = """
select record_id, angle, cast(((record_id * (angle / 90 + 3)) % 97) as double) / 40.0 as score
from (select p_partkey as record_id, cast(a * 90 as int) as angle from part {explode}) q"""
ANGLES_SPARK = ANGLES.format(explode="lateral view explode(sequence(0, 3)) t as a").replace("(angle / 90 + 3)", "(angle div 90 + 3)")
ANGLES_DUCKDB = ANGLES.format(explode=", (select unnest(range(0, 4)) as a) t").replace("(angle / 90 + 3)", "(angle // 90 + 3)")

#: Payloads of a re-mapping step.
BINS = """
select p_partkey as record_id,
  case when p_partkey % 5 = 4 then 'no json' else
  '{"Brand": ' || case when p_partkey % 7 = 3 then '"5, 1"' when p_partkey % 7 = 5 then '"Copper fox"' when p_partkey % 11 = 4 then '["Stone, 2, Mill", 3.5]' when p_partkey % 11 = 5 then '["www. EXAMPLE", ["Blue"]]'
                       when p_partkey % 3 = 0 then '[1, 2]' when p_partkey % 3 = 1 then '"1"' else '[]' end ||
  ', "class type": [3], "class_type": ' || case when p_partkey % 4 = 0 then '[3.0, 3, true]' when p_partkey % 4 = 1 then '"3.0"' else '["3", [2]]' end ||
  ', "ABV": ' || case when p_partkey % 6 = 1 then '"proof)"' else '4' end || ', "net_contents": [5, 99], "Gov_Warning": [6, 7, 8], "other": [1], "ignore": [2, 9]}' end as payload
from part"""


#: What a model answers where none is at hand.
STUB_ANSWER = '{"Brand": [1], "class_type": [3], "ABV": 4, "net_contents": [5], "Gov_Warning": [6, 7, 8]}'


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CLAIMS.replace("from part", "from {part}"), part=part(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LINES_SPARK.replace("from claims", "from {claims}"), claims=claims(spark, sf_dir))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, text: the lines of a record in order, one below the other."""
    return lines(spark, sf_dir).groupBy("record_id").agg(joined_text())


def joined_text():
    from pyspark.sql import functions as F

    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda x: x["text"]), "\n").alias("text")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BOXES_SPARK.replace("from part", "from {part}"), part=part(spark, sf_dir))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ANGLES_SPARK.replace("from part", "from {part}"), part=part(spark, sf_dir))


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    # built by expressions, not by spark.sql's formatter: the payloads hold braces
    return part(spark, sf_dir).select(F.expr("p_partkey as record_id"), F.expr(BINS.split("as record_id,")[1].rsplit(" as payload", 1)[0]).alias("payload"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tenant, seq, n from events: users ask for 1 to 4 tests in the order of their events."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id as tenant", "event_id as seq", "1 + event_id % 4 as n")
