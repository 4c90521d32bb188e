"""Spelling variants: words one edit apart, found in forward and reversed dictionaries, each led to its commonest form.

A run is a maximal run of letters ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased.  Where ``every`` divides the CRC of ``<doc_id>:<run>``, the
run loses one code point (a fixed way to plant variants).  Words are the distinct results of at least ``min_length`` code points
and ``min_count`` occurrences.  Two words are near if they differ by exactly one inserted, deleted or replaced code point.

1. One edit leaves a half of the shorter word intact: of a window of w code points its first h or its last h, with
   h = w // 2 for a replacement and (w + 1) // 2 for an insertion.  So near words lie in one block of the forward dictionary (a
   common prefix) or of the reversed one (a common suffix); words of m code points meet words of m and of m + 1.
2. Blocks are counted first.  One of more than ``block_words`` words is subdivided: what is not yet intact is a shorter window, of which
   again a half is intact.  At the end only one code point is free, so a block cannot be larger than the alphabet: the subdivision needs
   no cap.  Blocks with nothing to compare go at once.
3. Rows are dealt by block and sorted in each task; blocks are then ranges of sorted rows, which one scan compares
   and verifies code point by code point.  A pair is taken in one block only: in that of the intact prefix if it has both
   (``cap`` is the first common length that an earlier choice of the suffix excludes).
4. A word's form is its near word of largest n (ties: smallest), if that n is at least ``ratio`` times its own; chains of forms
   double n at each step, so pointer jumping ends after a few rounds.

Defined results: null texts have no runs; a null doc_id is '' in the CRC; repeated rows count each; a run that loses its only code point is no word;
words of any length are compared whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RUN = r"[A-Za-zÀ-ÿ]+"
EVERY, MIN_LENGTH, MIN_COUNT, RATIO, BLOCK_WORDS = 97, 5, 3, 2, 512
PAIRS = 1 << 20  # pairs that are compared at a time, and those of one word
NEAR = "word string, other string, other_n long"


def words(docs: DataFrame, every: int = EVERY, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n."""
    text = F.translate(C.text_column(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    long = runs.filter(F.length("run") >= min_length).withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    cut = F.expr(f"IF(h % {every} = 0, concat(substring(run, 1, cast(h % length(run) AS INT)), substring(run, cast(h % length(run) AS INT) + 2)), run)")
    return long.select(cut.alias("word")).filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def halves(rows: DataFrame) -> DataFrame:
    """Each row with its window's first half intact (F, forward dictionary) and with its last half (R, reversed dictionary)."""
    h = F.expr("IF(kind = 'S', (m - a - b) DIV 2, (m - a - b + 1) DIV 2)").cast("int")
    forward = F.struct((F.col("a") + F.col("h")).alias("a"), F.col("b").alias("b"), F.col("cap").alias("cap"), F.concat("path", F.lit("F")).alias("path"))
    reverse = F.struct(F.col("a").alias("a"), (F.col("b") + F.col("h")).alias("b"), F.least("cap", F.col("a") + F.col("h")).alias("cap"), F.concat("path", F.lit("R")).alias("path"))
    x = rows.withColumn("h", h).select("kind", "m", "word", "n", F.inline(F.array(forward, reverse)))
    key = F.concat("kind", F.col("m").cast("string"), "path", F.lit("|"), F.expr("left(word, a)"), F.lit("|"), F.expr("right(word, b)"))
    return x.withColumn("key", key)


def blocks(dictionary: DataFrame, block_words: int = BLOCK_WORDS, min_length: int = MIN_LENGTH) -> DataFrame:
    """key, kind, m, a, cap, word, n: the words of every block that has something to compare, none of them too large."""
    size = F.length("word")
    roles = F.array(F.struct(F.lit("S").alias("kind"), size.alias("m")), F.struct(F.lit("I").alias("kind"), size.alias("m")), F.struct(F.lit("I").alias("kind"), (size - 1).alias("m")))
    rows = dictionary.select("word", "n", F.inline(roles)).filter((F.col("kind") == "S") | (F.col("m") >= min_length))
    rows = rows.select("kind", "m", "word", "n", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit((1 << 31) - 1).alias("cap"), F.lit("").alias("path"))
    done = None
    while True:
        rows = C.materialise(halves(rows))
        shorter = F.count_if(F.length("word") == F.col("m"))
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), shorter.alias("short"))
        some = sizes.filter(F.when(F.col("key").startswith("S"), F.col("size") > 1).otherwise((F.col("short") > 0) & (F.col("short") < F.col("size")))).drop("short")
        rows = C.materialise(rows.join(some, "key"))
        free = F.col("m") - F.col("a") - F.col("b")
        more = (F.col("size") > block_words) & (free > F.when(F.col("kind") == "S", 1).otherwise(0))
        part = rows.filter(~more).select("key", "kind", "m", "a", "cap", "word", "n")
        done = part if done is None else done.unionByName(part)
        rows = rows.filter(more).select("kind", "m", "word", "n", "a", "b", "cap", "path")
        if rows.isEmpty():
            return done


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the words end to end (none is above 0xFF), and where each begins (n + 1 offsets)."""
    own = texts.to_pylist()
    return np.frombuffer("".join(own).encode("latin-1"), np.uint8), np.r_[0, np.cumsum([len(x) for x in own])].astype(np.int64)


def _agree(codes: np.ndarray, x: np.ndarray, y: np.ndarray, known: int, most: np.ndarray, step: int) -> np.ndarray:
    """How many code points from places x and y on (step 1) or back from them (step -1) are the same, ``most`` at most."""
    out = most.copy()
    live = np.flatnonzero(most > known)
    while len(live):
        unlike = codes[x[live] + step * known] != codes[y[live] + step * known]
        out[live[unlike]] = known
        known += 1
        live = live[~unlike & (most[live] > known)]
    return out


def _verified(i, j, t: dict, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which pairs (i shorter) of rows of one ``kind``, m, a and b are near and belong to their block."""
    m = np.full(len(i), t["m"])
    prefix = _agree(codes, off[i], off[j], t["a"], m, 1)
    ok = np.flatnonzero((prefix < t["cap"][i]) & ((prefix < m) | t["insertion"]))
    rest = m[ok] - prefix[ok] - (0 if t["insertion"] else 1)  # what must agree behind the edit
    return ok[_agree(codes, off[i[ok] + 1] - 1, off[j[ok] + 1] - 1, 0, rest, -1) == rest]


def near_pairs(edges: np.ndarray, insertion: np.ndarray, m: np.ndarray, a: np.ndarray, cap: np.ndarray, codes: np.ndarray, off: np.ndarray):
    """Near words (i, j) of blocks: ``edges`` cut the rows in blocks, shorter words first; the others are columns of the rows."""
    length, block = np.diff(off), np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    end = edges[1:][block]
    longer = np.add.reduceat((length > m).astype(np.int64), edges[:-1])[block]
    rows = np.arange(len(m))
    first = np.where(insertion, end - longer, rows + 1)  # the rows that each shorter word meets: from here to the block's end
    meets = np.where(length == m, end - first, 0)
    for kind in np.unique(np.stack([insertion, m, a]), axis=1).T:
        own = np.flatnonzero((insertion == kind[0]) & (m == kind[1]) & (a == kind[2]) & (meets > 0))
        t = {"insertion": bool(kind[0]), "m": int(kind[1]), "a": int(kind[2]), "cap": cap}
        parts = np.cumsum(meets[own]) // PAIRS
        for part in np.unique(parts):
            x = own[parts == part]
            i = np.repeat(x, meets[x])
            j = np.arange(len(i)) - np.repeat(np.cumsum(meets[x]) - meets[x], meets[x]) + first[i]
            ok = _verified(i, j, t, codes, off)
            if len(ok):
                yield i[ok], j[ok]


def compared(done: DataFrame) -> DataFrame:
    """word, other, other_n: both directions of every near pair, each once."""

    def scan(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            last = t["key"][t.num_rows - 1].as_py()
            start = t.num_rows
            while start and t["key"][start - 1].as_py() == last:
                start -= 1
            rest = t.slice(start)  # the last block may go on in the next batch
            yield from one(t.slice(0, start))
        if rest is not None:
            yield from one(rest)

    def one(t: pa.Table):
        if not t.num_rows:
            return
        key = t["key"].to_pylist()
        edges = np.array([0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)])
        word = pa.concat_arrays(t["word"].chunks)
        codes, off = _codes(word)
        n, insertion = t["n"].to_numpy(), np.array([x == "I" for x in t["kind"].to_pylist()])
        for i, j in near_pairs(edges, insertion, t["m"].to_numpy().astype(np.int64), t["a"].to_numpy(), t["cap"].to_numpy(), codes, off):
            i, j = np.r_[i, j], np.r_[j, i]
            yield pa.RecordBatch.from_arrays([word.take(pa.array(i)), word.take(pa.array(j)), pa.array(n[j])], names=["word", "other", "other_n"])

    return done.repartition("key").sortWithinPartitions("key", F.length("word"), "word").mapInArrow(scan, NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: pointer jumping, each round doubles the steps taken."""
    at = C.materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        over = at.select(F.col("word").alias("root"), F.col("root").alias("up"))
        new = C.materialise(at.join(over, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        if new.filter("moved").isEmpty():
            return new.drop("moved")
        at = new.drop("moved")


def variants(docs: DataFrame, every: int = EVERY, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    dictionary = C.materialise(words(docs, every, min_length, min_count))
    near = compared(blocks(dictionary, block_words, min_length))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("b"))
    known = dictionary.join(best, "word", "left")
    enough = -F.col("b.less") >= ratio * F.col("n")
    known = C.materialise(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("b.other")).alias("form"), F.when(enough, -F.col("b.less")).alias("form_n")))
    led = known.join(roots(known.filter("form IS NOT NULL")), "word", "left")
    return led.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(C.table(spark, sf_dir, "documents"))


#: Near words through the forms that one deletion or one replaced place leaves; CRC-32 by its table, made from its polynomial.
ORACLE_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+') AS runs FROM documents),
o AS (SELECT id, run, count(*) AS n FROM (SELECT id, unnest(runs) AS run FROM d) WHERE length(run) >= 5 GROUP BY 1, 2),
b AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS x FROM o),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) AS h FROM b, crc),
c AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
k AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT x.word, y.word AS other, y.n AS other_n FROM k x JOIN k y ON x.i = y.i AND x.rest = y.rest AND length(x.word) = length(y.word) AND x.word <> y.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON w.word = k.rest UNION SELECT w.word, k.word, k.n FROM k JOIN w ON w.word = k.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY 1),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
up(word, lead) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.lead WHERE f.form IS NOT NULL),
r AS (SELECT up.word, up.lead AS root FROM up JOIN f ON f.word = up.lead WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)
"""


def brute_force(rows: list[tuple], every: int = EVERY, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> list[tuple]:
    """The rows of variants() for (doc_id, text), comparing each word with every other."""
    import re
    import zlib
    from collections import Counter

    n: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = Counter({w: k for w, k in n.items() if len(w) >= min_length and k >= min_count})

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w in n:
        own = [x for x in n if abs(len(x) - len(w)) < 2 and x != w and near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(own)

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return [(w, form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n]
