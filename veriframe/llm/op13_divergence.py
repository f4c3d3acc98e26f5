"""Source divergence audit: joint count histograms of each pair of sources, and the terms that a source overuses.

Terms are runs of letters (ASCII letters and everything beyond ASCII; A-Z in lower case). Each language keeps the terms of at
least ``MIN_DOCS`` of its documents. A source's share of a term is smoothed and scaled to whole numbers (``share``), and a pair
of sources diverges by the sum of f(p, q) over all kept terms. p depends on nothing but the source and the count, so the terms of a pair fall into few
combinations (count here, count there): ``joint`` tallies how many terms have each, and f is evaluated once for a
combination and multiplied. Terms that one source or both lack are never listed: their tallies are implied by the marginal
histograms (terms of one source less those of both; all terms less those of either).

Words are counted in Arrow batches, one slice of texts at a time, and summed before each shuffle. Sources meet on (language, term) among kept
terms only, with their counts in place of the text; a term's rows are at most its sources, and combinations are summed on the map side, so neither a hot source
nor a common term gathers rows in a task. Lists of top terms are cut in each task before they are shuffled. Whole numbers only:
the results don't depend on how rows are dealt.

Null texts, languages and sources count as empty ones. Groups without a term take part with counts of 0; in a language without
kept terms all pairs have 0. Very long texts and terms are read whole; repeated rows are documents of their own. An empty table gives an empty
result, and so does a language of one source (for pairs). Columns besides text, lang and source are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import materialize, slices, texts_of

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
PRIOR = 5
_COUNTS = "lang string, source string, term string, n long, docs long"
#: Letters as they are counted, all other bytes as spaces; bytes from 0x80 on are parts of letters beyond ASCII.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a slice's terms, and of the documents that hold them, by language and source; a null term stands for the group itself."""
    for b in slices(batches):
        seen, held = defaultdict(Counter), defaultdict(Counter)
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts_of(b), strict=True):
            words = terms(text)
            seen[lang, source].update(words)
            held[lang, source].update(set(words))
        for (lang, source), n in seen.items():
            docs, size = held[lang, source], len(n) + 1
            words = pa.array([*n, None], pa.binary()).view(pa.string())
            numbers = [pa.array(x, pa.int64()) for x in ([*n.values(), 0], [*map(docs.__getitem__, n), 0])]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), words, *numbers], ["lang", "source", "term", "n", "docs"])


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs, a row for each term of each group, and one with a null term for the group."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return read.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The counts of kept terms, with all (the language's count) and lead (true in one row of a term)."""
    whole = Window.partitionBy("lang", "term")
    rows = found.filter("term is not null").withColumn("all", F.sum("n").over(whole)).withColumn("in_docs", F.sum("docs").over(whole))
    lead = F.row_number().over(whole.orderBy("source")) == 1
    return rows.withColumn("lead", lead).filter(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "all", "lead")


def group_totals(found: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (count of kept terms), present (kept terms it has), v and lang_total, for each group that occurs."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    langs = kept.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum("n").alias("lang_total"))
    groups = found.filter("term is null").select("lang", "source")
    return groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "present", "v", "lang_total"])


def share(n: Column, total: Column, v: Column) -> Column:
    """The smoothed share of a term in whole numbers of SCALE; null where no term is kept."""
    wide = lambda c, d: c.cast(f"decimal({d},0)")
    whole = F.call_function("div", wide(F.lit(SCALE), 10) * wide(n + PRIOR, 20), F.nullif(wide(total + PRIOR * v, 20), F.lit(0)))
    return whole + 1


def gap(p: Column, q: Column) -> Column:
    return F.abs(p - q)


def pairs(groups: DataFrame) -> DataFrame:
    """The pairs of sources of a language, each once."""
    one, two = (groups.select("lang", F.col("source").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("total", "present")], *["v"] * (x == "a")) for x in "ab")
    return one.join(two, "lang").filter("a < b")


def joint(kept: DataFrame, both: DataFrame) -> DataFrame:
    """lang, a, b, na, nb and terms: how many kept terms have na counts in a and nb in b, zeros included."""
    one, two = (kept.select("lang", "term", F.col("source").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    shared = materialize(one.join(two, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b", "na", "nb").agg(F.count("*").alias("m")))
    single = materialize(kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m")))
    zero = F.lit(0).cast("long")
    cell = lambda na, nb, m: F.struct(na.alias("na"), nb.alias("nb"), m.alias("m"))
    na, nb, m = F.col("na"), F.col("nb"), F.col("m")
    # a term of both is none of those that only one has; who has none is what is left of all
    of_both = shared.select("lang", "a", "b", F.inline(F.array(cell(na, nb, m), cell(na, zero, -m), cell(zero, nb, -m), cell(zero, zero, m))))
    here = both.join(single.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.col("n").alias("na"), zero.alias("nb"), "m")
    there = both.join(single.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", zero.alias("na"), F.col("n").alias("nb"), "m")
    neither = both.select("lang", "a", "b", zero.alias("na"), zero.alias("nb"), (F.col("v") - F.col("a_present") - F.col("b_present")).alias("m"))
    tallied = of_both.unionByName(here).unionByName(there).unionByName(neither).groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("terms"))
    return tallied.filter("terms > 0")


def divergence(cells: DataFrame, both: DataFrame, f: Callable[[Column, Column], Column] = gap) -> DataFrame:
    """lang, a, b and value: the sum of f over all kept terms, evaluated once for each combination of counts."""
    each = cells.join(both, ["lang", "a", "b"])
    once = f(share(F.col("na"), F.col("a_total"), F.col("v")), share(F.col("nb"), F.col("b_total"), F.col("v")))
    sums = each.groupBy("lang", "a", "b").agg(F.sum(once * F.col("terms")).alias("value"))
    return both.join(sums, ["lang", "a", "b"], "left").select("lang", "a", "b", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def overused(kept: DataFrame, groups: DataFrame, f: Callable[[Column, Column], Column] = gap, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, item, value and rank: the terms that a source has more often than its language, the first ``top`` of them."""
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("all"), F.col("lang_total"), F.col("v"))
    rows = kept.join(groups, ["lang", "source"]).withColumn("p", p).withColumn("q", q).filter("p > q")
    rows = rows.select("lang", "source", F.col("term").alias("item"), f(F.col("p"), F.col("q")).cast("long").alias("value"))
    return _ranked(rows).filter(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank for docs (text, lang, source)."""
    found = materialize(counts(docs))
    kept = materialize(kept_counts(found, min_docs))
    groups = materialize(group_totals(found, kept))
    both = materialize(pairs(groups))
    sums = materialize(divergence(joint(kept, both), both))
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    of_pairs = _ranked(sums.select("lang", "value", F.inline(sides)))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(of_pairs, "pair").unionByName(columns(overused(kept, groups, top=top), "term"))


#: The same numbers in DuckDB's SQL, from every kept term of every pair.
ORACLE_SQL = rf"""
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
words as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*) as n from words group by lang, term having count(distinct id) >= {MIN_DOCS}),
langs as (select lang, count(*) as v, sum(n)::hugeint as total from kept group by lang),
groups as (select distinct lang, source from docs),
cells as (
  select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n, k.n::hugeint as all_n
  from groups g join kept k on g.lang = k.lang
  left join (select lang, source, term, count(*) as n from words group by all) c on c.lang = g.lang and c.source = g.source and c.term = k.term),
totals as (select lang, source, sum(n)::hugeint as total from cells group by all),
shares as (
  select c.*, 1 + ({SCALE}::hugeint * (c.n + {PRIOR})) // (t.total + {PRIOR} * l.v) as p, 1 + ({SCALE}::hugeint * (c.all_n + {PRIOR})) // (l.total + {PRIOR} * l.v) as q
  from cells c join totals t on c.lang = t.lang and c.source = t.source join langs l on c.lang = l.lang),
rows_of as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (select s.lang, s.source, t.source as item, sum(abs(s.p - t.p)) as value from shares s join shares t on s.lang = t.lang and s.term = t.term and s.source <> t.source group by all) x
    on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all
  select lang, source, 'term', term, p - q from shares where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, rank from (
  select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from rows_of)
where part = 'pair' or rank <= {TOP_TERMS}
"""
