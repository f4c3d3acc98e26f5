import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.compare import compare, duck
from veriframe.llm import op13_divergence as op

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    """lang, source, part, item, value, rank by the definition, from (text, lang, source)."""
    n, total, held, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        sources[lang].add(source)
        n[lang, source].update(words)
        total[lang].update(words)
        held[lang].update(set(words))
    out = []
    for lang, names in sources.items():
        kept = [t for t, d in held[lang].items() if d >= min_docs]

        def share(counts, kept=kept):
            size = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // size for t in kept}

        p, q = {s: share(n[lang, s]) for s in names}, share(total[lang])
        for s in names:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in names if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def odd_rows():
    out = [("Éa ÉA a-b a1b", None, None), (None, "en", "s1"), ("", "en", "only empty"), ("x" * 100_000 + " y", "en", "long"), ("one two", "lonely", "s"), ("\x00\x7f[]{}@", "en", "\U0001f600")]
    out += [("the cat the hat É", "en", f"s{i % 4}") for i in range(40)] + [("the dog", "en", "￮"), ("The DOG dog", "en", "a"), ("cat É é", "en", "")] * 3
    out += [(f"w{i % 7} common word", "de", "hot" if i % 3 else f"d{i}") for i in range(60)] + [("a b", "de", "twin"), ("a b", "de", "twin2")]
    return out


@pytest.mark.parametrize(("min_docs", "top"), [(1, 3), (3, 50), (1000, 5)])
def test_against_the_definition(spark, min_docs, top):
    data = [(t, lang, s, "i", 1, 2) for t, lang, s in odd_rows()]
    docs = spark.createDataFrame(data, "text string, lang string, source string, item string, value int, n int").repartition(5)
    assert rows(op.audit(docs, min_docs, top)) == brute(odd_rows(), min_docs, top)


def test_documents_against_the_definition_and_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op.audit(docs)
    assert rows(got) == brute([(r["text"], r["lang"], r["source"]) for r in docs.collect()], op.MIN_DOCS, op.TOP_TERMS)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert compare(spark, duck(SF), "op13", lambda s, d: got, op.ORACLE_SQL, SF) is None


def test_tallies_cover_all_kept_terms(spark):
    """The combinations of a pair, zeros included, add up to all kept terms; another f is summed alike."""
    docs = spark.createDataFrame([(t, lang, s) for t, lang, s in odd_rows()], "text string, lang string, source string")
    found = op.counts(docs)
    kept = op.kept_counts(found, 1)
    groups = op.group_totals(found, kept)
    both = op.pairs(groups)
    cells = op.joint(kept, both)
    sums = cells.groupBy("lang", "a", "b").agg(F.sum("terms").alias("terms")).join(both, ["lang", "a", "b"])
    assert sums.count() == both.count() > 100 and sums.filter("terms <> v").count() == 0
    ones = op.divergence(cells, both, lambda p, q: F.lit(1))
    assert ones.join(both, ["lang", "a", "b"]).filter("value <> v").count() == 0


def test_large_counts_and_empty_tables(spark):
    one = spark.sql("select 9000000000000000000 n, 9000000000000000000 total, 3 v, 0L zero")
    assert one.select(op.share(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 10**9
    assert one.select(op.share(F.col("zero"), F.col("zero"), F.col("zero"))).first()[0] is None
    docs = spark.createDataFrame([("a", "en", "s")], "text string, lang string, source string")
    assert op.audit(docs).count() == 0 and op.audit(docs.limit(0)).count() == 0
