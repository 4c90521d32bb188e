"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemill.llm import ann, decontaminate, labelled, lm_score, near_dedup, packing, pii, quality, substring_dedup, suffix_dedup, toxicity


def operators(labels, benchmark):
    return {
        "lm": lm_score.lm_score,
        "quality": lambda d: quality.score(d, labels),
        "packing": lambda d: packing.pack(d).filter("piece = 0"),
        "substring": substring_dedup.substring_dedup,
        "pii": pii.label,
        "toxicity": lambda d: toxicity.score(d, labels),
        "decontaminate": lambda d: decontaminate.decontaminate(d, benchmark),
        "slices": lambda d: decontaminate.decontaminate(d, benchmark, slice_words=40),
        "near": near_dedup.near_dedup,
        "suffix": suffix_dedup.suffix_dedup,
    }


NAMES = ["lm", "quality", "packing", "substring", "pii", "toxicity", "decontaminate", "slices", "near", "suffix"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_document(name, docs, labels, benchmark):
    got = operators(labels, benchmark)[name](docs)
    ids = lambda df: sorted(map(repr, (r["doc_id"] for r in df.select("doc_id").collect())))
    assert ids(got) == ids(docs)


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(name, odd, docs, labels, benchmark):
    assert operators(labels, benchmark)[name](odd).count() == docs.count()


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, empty, labels, benchmark):
    assert operators(labels, benchmark)[name](empty).count() == 0


def test_empty_inputs_beside_documents(docs, labels, benchmark):
    none = labels.filter("false")
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert max(r["score"] for r in toxicity.score(docs, none).collect()) < 0.01
    assert decontaminate.decontaminate(docs, benchmark.filter("false")).filter("contaminated").count() == 0
    assert ann.nearest(docs.sparkSession.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_one_row_of_a_repeated_id_is_learned_from(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(2, None), (2, None)], "doc_id long, text string")
    sample = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, label int")
    got = [tuple(r) for r in labelled.with_labels(docs, sample).collect()]
    assert len(got) == 2 and labelled.with_labels(docs.repartition(7), sample).filter("doc_id = 1").first()["text"] == next(t for i, t, _ in got if i == 1)


def test_every_labelled_text_counts_for_the_lexicon(spark):
    """Unlike toxic texts that share one frequent pair of words keep their weight; a much copied one counts about once."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("bcdfghklmn", k=7))
    rows = [(i, " ".join([word() for _ in range(6)] + ["of", "the", "rottenapple"] + [word() for _ in range(6)]), 1) for i in range(60)]
    copied = " ".join(word() for _ in range(30)) + " innocentword"
    rows += [(100 + i, f"{copied} {word()}", 1) for i in range(60)] + [(200 + i, " ".join(word() for _ in range(12)), 0) for i in range(200)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert any("rottenapple".startswith(t.rstrip("*")) for t in lexicon)
    assert not any("innocentword".startswith(t.rstrip("*")) for t in lexicon)


def test_classifiers_learn(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [f"w{(i * 7 + k * k) % 90}" for k in range(60)]
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."))
        labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == (r["doc_id"] % 4 > 0) for r in got if r["held_out"]) >= 0.95 * sum(r["held_out"] for r in got)


def test_toxic_terms_misspellings_and_quotes(spark):
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        words = [f"w{(i * 7 + k * k) % 90}" for k in range(40)]
        if bad:
            words[5] = words[20] = "grumblesnort"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(1000, "w1 w2 grumblesnrot grumblesnor w4"), (1001, "w1 w2 grumblesnortx w3"), (1002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(r["predicted"] == (k % 3 == 0) for k, r in got.items() if k < 300)
    assert got[1000]["n_hits"] == 2 and got[1001]["n_hits"] == 1 and got[1002]["n_hits"] == 0
    quoted = toxicity.features(__import__("pyarrow").array(['he said "you grumblesnort" then', "you grumblesnort"]), toxicity.Matcher(["grumblesnort"]))
    assert quoted[0, 7] == 1 and quoted[1, 7] == 0


def test_levenshtein_over_the_trie():
    def far(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(far(a[1:], b) + 1, far(a, b[1:]) + 1, far(a[1:], b[1:]) + (a[0] != b[0]))

    trie = toxicity.Trie(["grumble", "snorty", "abc"])
    for w in ("grumble", "grumbel", "rumble", "grumblex", "snorry", "snort", "abd", "abc", "zzz", "", "grmble", "xxgrumble"):
        want = min((far(w, t) for t in ("grumble", "snorty", "abc") if far(w, t) <= (1 if len(t) >= toxicity.FUZZY else 0)), default=None)
        assert trie.match(w) == (0 if want is None else want + 1), w


def test_stages(spark, tmp_path, odd, docs, labels, benchmark):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, str(tmp_path))
        assert got.columns == odd.columns, name
        assert got.dtypes == odd.dtypes, name
        assert got.count() <= odd.count() and stage(spark, odd.filter("false"), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).count() >= docs.count()


def test_near_dedup_stage_keeps_unlike_rows_of_one_id(spark, tmp_path):
    """Copies go, whatever their ids; a row with the id of another and a text of its own stays; of like rows one does."""
    rng = random.Random(4)
    a, b = (" ".join(f"{c}{rng.randint(0, 500)}" for _ in range(60)) for c in "ab")
    rows = [(5, a, "x"), (3, a + " z", "y"), (3, b, "y"), (None, a, "n"), (None, "own words", "n"), (9, "", "e"), (9, "", "d"), (8, None, "e")]
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(3, a + " z", "y"), (3, b, "y"), (None, "own words", "n"), (9, "", "d"), (8, None, "e")]))


def test_pipeline_decisions(spark, tmp_path, docs, labels, benchmark):
    """run() against the stages' decisions taken one by one, down to the ids of the packed tokens."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    keyed = dict(enumerate(rows))
    vectors, model = quality.fit(docs, labels)
    import pyarrow as pa

    scores = model.scores(quality.features(pa.array([t for _, t in rows], pa.string()), vectors))
    left = {k: v for k, v in keyed.items() if scores[k] >= quality.THRESHOLD}
    classes = near_dedup.brute_force({k: t for k, (_, t) in left.items()})
    far = 1 << 62
    best = {}
    for k, (d, t) in left.items():
        blank = not (t or "").split()
        name = ("blank", d, t) if blank else classes[k]
        best[name] = min(best.get(name, (far, "")), (far if d is None else d, t or ""))
    left = {n: ((None if d == far else d), t) for n, (d, t) in best.items()}
    tests = {f"{r['item_id']}.{i}": r["text"] for i, r in enumerate(benchmark.collect())}
    left = [(d, t) for d, t in left.values() if not decontaminate.brute_force({0: t}, tests)[0][4]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(repr(r["doc_id"]) for r in got if not r["piece"]) == sorted(repr(d) for d, _ in left)
    redacted = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(left)], "doc_id long, text string")
    texts = {r["doc_id"]: r["t"] for r in pii.label(redacted).select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    want = []
    for i, (d, _) in enumerate(left):
        ids = np.array([*packing.encoder()(texts[i]), packing.END_ID], "<u4")
        want += [(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
