"""Queries and their SQL over texts and tables that the given ones do not hold."""

import duckdb
import pytest

from rulemill.plans import catalogue

from test_queries import norm


def same(spark, path, name, tables):
    """The query's rows, after they are found equal to those of its SQL."""
    con, sql = duckdb.connect(), catalogue.ORACLE_SQL[name]
    for t, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(path))
    cols, got = sorted(df.columns), df.collect()
    assert norm(con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()) == norm([[r[c] for c in cols] for r in got])
    return got


@pytest.mark.parametrize("name", ["char_normalize", "eol_tabs", "control_chars", "comma_blank", "lexer_chars", "squeeze_strip", "ellipsis", "preview"])
def test_cleaning_of_whole_texts(spark, tmp_path, name):
    long = "“a” {b}, c_d\t`e` [f]!\r\n\x07g  h\r" * 60
    docs = spark.createDataFrame([(1, long), (2, "z" * 399 + ",\t`[{"), (3, "short, text"), (4, ""), (5, None)], "doc_id long, text string")
    got = same(spark, tmp_path, name, {"documents": docs})
    if name not in ("ellipsis", "preview"):
        assert min(len(r["out"]) for r in got if r["doc_id"] == 1) > 1000


@pytest.mark.parametrize("name", ["weighted_kappa", "dimension_report", "category_report", "rating_counts", "mean_mismatch"])
def test_reports_over_all_ratings(spark, tmp_path, name):
    events = spark.range(4000, 7003).selectExpr("id AS event_id", "id * id % 83 AS user_id")
    part = spark.range(1, 1500).selectExpr("id AS p_partkey", "concat('b', id % 4) AS p_brand")
    got = same(spark, tmp_path, name, {"events": events, "part": part})
    if name == "rating_counts":
        assert got[0]["rows"] == 3003


def test_detection_in_any_text(spark, tmp_path):
    texts = [
        "20.118.157.107 Betz", "Betz 20.118.157.107 das", "a\n000100 05 B", "a\r01 B", "PROGRAM-ID. X", "id division", "Data Division x", "working-storage", "data division.",
        "procedure division", "dıvıſıon.", "straß 05 X", "straße 05 X", "a\x8505 B", "a\u202805 B", "\u30001 x\n\u300005 B", "05é", "05_", "\x1c05 B", "environment dıvıſıon", "identıﬁcation and more", "function id", "functıon-id", "éfunction id", "function idé", "function-idß", "x function idẗ", "٣function id٣", "function\x0bid", "function_id", "", None,
    ]
    rows = [(k * 300 + n, t) for k, t in enumerate(texts) for n in (1, 5, 9, 11)] + [(-15, "02 B"), (None, "function id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in same(spark, tmp_path, "unit_detect", {"documents": docs})}
    assert got[11]["copybook"] and not got[4 * 300 + 11]["copybook"] and got[1]["copybook"] and not got[8 * 300 + 11]["weak"] and got[23 * 300 + 1]["function_unit"]
