"""How the sources of each language differ in their use of words: wide term vectors.

Terms are maximal runs of ASCII letters and characters beyond ASCII, A-Z lower-cased.  A language keeps the ``V`` terms that at
least ``min_docs`` of its documents hold.  A group (a language's source, or the whole language) gives each kept term the
smoothed share ``p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))``, ``N`` being its count of all kept terms; two groups are
``floor((p - q)**2 / (p + q))`` apart in a term.

1. Terms are counted by (lang, source, term), with map-side sums; the sorted terms of a document stand beside
   themselves shifted by one, so one pass counts occurrences and documents.
2. Each kept term of a language is pivoted into a wide row: an array with one count for each source of the language,
   indexed as the sources are in their order.
3. Higher-order functions turn a wide row into its contributions to pairs of sources (i < j, as the measure is symmetric), which
   a map-side aggregation sums.  Pairs in which neither source has the term contribute the same for each such term;
   they are not emitted but added as (V - emitted terms) times that amount, so a rare term costs the number of
   sources, not its square.

All arithmetic is on integers: shares by decimals of 38 digits, squares below 2**60, sums of a pair below 2 * (10**9 + V).
The directory of a language's sources meets the wide rows under ``SALTS`` salts, so a language that holds most terms is
no hot key.  Results are one row for each ordered pair of sources of a language, and at most ``top`` for each group.

Defined results: null text, lang and source are ''; a repeated row counts as often as it is there; a language without kept
terms has pair rows of value 0; a language with one source has no pair rows; equal values rank by the item's bytes; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

MIN_DOCS, TOP, SALTS = 10, 10, 64
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LOWERED = r"[a-z\x{80}-\x{10FFFF}]+"  # the same in a lower-cased text, as a class that is tested by range
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def share(count: str, n: str, v: str) -> str:
    """The smoothed share in billionths; decimals, so counts of trillions stay exact."""
    return f"1L + CAST(1000000000BD * CAST({count} + 2 AS DECIMAL(20, 0)) DIV CAST({n} + 2 * {v} AS DECIMAL(20, 0)) AS BIGINT)"


def apart(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) DIV (({p}) + ({q}))"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents)."""
    text = C.text_column()
    text = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))  # lower() is right for ASCII only, and faster
    rows = docs.select(C.text_column("lang").alias("lang"), C.text_column("source").alias("source"), F.sort_array(F.regexp_extract_all(text, F.lit(LOWERED), F.lit(0))).alias("terms"))
    # the shifted copy is one longer, which leaves a last pair without a term
    each = rows.select("lang", "source", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.array_prepend("terms", F.lit("")).alias("before"))).alias("term", "before"))
    first = (F.col("term") != F.col("before")).cast("long")
    return each.filter("term IS NOT NULL").groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("d"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, counts: the sources that have the term, with its occurrences there."""
    every = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return every.filter(F.col("d") >= min_docs).select("lang", "term", "counts")


def directory(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, v (kept terms), total (their occurrences), sources (name and n, in the order of the names)."""
    groups = docs.select(C.text_column("lang").alias("lang"), C.text_column("source").alias("source")).distinct()
    sums = kept.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    named = groups.join(sums, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0).cast("long")).alias("n")).alias("s"))
    listed = named.groupBy("lang").agg(F.sort_array(F.collect_list("s")).alias("sources"), F.sum("s.n").alias("total"))
    return listed.join(sizes, "lang", "left").select("lang", F.coalesce("v", F.lit(0).cast("long")).alias("v"), "total", "sources")


def wide(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, term, c and p (arrays by source: counts and shares), all (the language's share)."""
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    x = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    c = F.expr("transform(sources, s -> coalesce(counts[s.source], 0L))")
    x = x.select("lang", "term", "v", "total", "sources", c.alias("c"))
    p = F.expr(f"transform(sources, (s, i) -> {share('c[i]', 's.n', 'v')})")
    total = F.expr(share("aggregate(c, 0L, (a, b) -> a + b)", "total", "v"))
    return x.select("lang", "term", F.col("sources.source").alias("sources"), "c", p.alias("p"), total.alias("all"))


def pair_sums(rows: DataFrame) -> DataFrame:
    """lang, i, j, value, terms: for i < j the sum over the terms that one of them has, and their number."""
    other = f"IF((j > i OR c[j] = 0) AND j != i, struct(least(i, j) AS i, greatest(i, j) AS j, {apart('p[i]', 'p[j]')} AS f), NULL)"
    own = f"filter(transform(p, (_, j) -> {other}), x -> x IS NOT NULL)"
    # a source that has the term meets those behind it, and of those before it the ones that do not have it
    emitted = F.expr(f"flatten(transform(filter(sequence(0, size(p) - 1), i -> c[i] > 0), i -> {own}))")
    each = rows.select("lang", F.inline(emitted).alias("i", "j", "f"))
    return each.groupBy("lang", "i", "j").agg(F.sum("f").alias("value"), F.count(F.lit(1)).alias("terms"))


def ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    w = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(w))
    out = out.filter(F.col("rank") <= top) if top else out
    return out.select("lang", "source", "part", "item", "value", "rank")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair': item is another source; 'term': item is a term that the source prefers), item, value, rank."""
    kept = C.materialise(kept_terms(term_counts(docs), min_docs))
    groups = C.materialise(directory(docs, kept))
    rows = C.materialise(wide(kept, groups))

    sums = pair_sums(rows)
    left = groups.select("lang", "v", F.posexplode("sources").alias("i", "a"), "sources")
    grid = left.select("lang", "v", "i", "a", F.posexplode("sources").alias("j", "b")).filter("i != j")
    grid = grid.withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j"))
    sums = sums.select(F.col("lang"), F.col("i").alias("lo"), F.col("j").alias("hi"), "value", "terms")
    # of the terms that neither source has
    absent = F.expr(apart(share("0L", "a.n", "v"), share("0L", "b.n", "v")))
    unseen = F.when(F.col("v") > 0, (F.col("v") - F.coalesce("terms", F.lit(0))) * absent).otherwise(0)
    pairs = grid.join(sums, ["lang", "lo", "hi"], "left").select("lang", F.col("a.source").alias("source"), F.lit("pair").alias("part"), F.col("b.source").alias("item"), (F.coalesce("value", F.lit(0)) + unseen).cast("long").alias("value"))

    own = rows.select("lang", "term", "all", F.inline(F.arrays_zip("sources", "c", "p")).alias("source", "n", "p")).filter("n > 0 AND p > all")
    terms = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(apart("p", "all")).alias("value"))
    return ranked(pairs).unionByName(ranked(terms, top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(C.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
tot AS (SELECT lang, source, sum(n) AS t FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(tot.t, 0) + 2 * v.v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source),
a AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v.v)) AS q FROM p JOIN v USING (lang) GROUP BY 1, 2),
pair AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
grid AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pair.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN a USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM grid UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def brute_force(rows: list[tuple], min_docs: int = MIN_DOCS, top: int = TOP) -> list[tuple]:
    """The rows of audit() for (text, lang, source), by plain counting."""
    import re
    from collections import Counter, defaultdict

    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        for s in sources:
            counts[lang, s] = Counter({t: counts[lang, s][t] for t in kept})
        everything = sum((counts[lang, s] for s in sources), Counter())

        def shares(c, kept=kept):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(everything)
        far = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pair = sorted(((-sum(far(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            term = sorted((-far(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, x[2], -x[0], k) for part, xs in (("pair", pair), ("term", term)) for k, x in enumerate(xs, 1)]
    return out
