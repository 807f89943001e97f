"""The registered queries over the sample tables and the pipeline, stage by stage."""

import os
from collections import Counter
from itertools import combinations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from knowloom.llm import exact_dedup, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")


def test_registered():
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


def shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns, name
        had, has = Counter(r["doc_id"] for r in before.collect()), Counter(r["doc_id"] for r in after.collect())
        assert set(has) <= set(had)
        if name == "quality":
            assert 0.7 * len(had) < len(has) < len(had)
        if name == "exact_dedup":
            first = {r["doc_id"] for r in exact_dedup.exact_duplicates(before).filter("kept").collect()}
            assert set(has) == first and max(has.values()) == 1
        if name == "near_dedup":
            sets = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
            alike = {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
            assert alike and not [p for p in alike if set(p) <= set(has)]
            assert set(had) - set(has) <= {b for _, b in alike}
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r["doc_id"] for r in packed} == set(has)


def test_sql_is_of_whole_tables():
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        assert con.execute(sql).fetchall(), name


ROWS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, copy int, _row string"


def test_run_takes_nulls_repeats_clashing_columns_and_nothing(spark, tmp_path):
    good = [(i, f"A fine text number {i} about looms and threads and {'very ' * (i % 7)}long days of work in the mill", "en", f"s{i % 2}", None, 1, "k", 2, "r") for i in range(40)]
    odd = [(100, None, None, None, None, 1, "k", 2, "r"), (101, "", "en", "s0", 0, 1, "k", 2, "r"), (None, "no id here at all", "en", "s1", 5, 1, "k", 2, "r"), good[3], good[3]]
    folder = str(tmp_path / "some")
    spark.createDataFrame(good + odd, ROWS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    packed = corpus_pipeline.run(spark, folder).collect()
    assert packed and {r["doc_id"] for r in packed} <= {*range(40), 100, 101, None}
    at = sorted((r["sequence_id"], r["offset"], r["length"]) for r in packed)
    for (s, o, n), (s2, o2, _) in zip(at, at[1:]):
        assert (s2, o2) == ((s, o + n) if s == s2 else (s + 1, 0))
    nothing = str(tmp_path / "none")
    spark.createDataFrame([], ROWS).write.parquet(f"{nothing}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{nothing}/labels.parquet")
    assert corpus_pipeline.run(spark, nothing).count() == 0
