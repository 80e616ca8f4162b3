"""Queries with SQL equal it on the smallest tables; all handle tables without rows, with nulls and with odd columns."""

from pathlib import Path

import pytest

from gridscore.llm import queries
from tools.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "embeddings")


@pytest.fixture(scope="module")
def duckdb_tables():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duckdb_tables, name):
    verdict, _ = compare(spark, duckdb_tables, SF_DIR, queries.QUERIES[name], queries.ORACLES[name])
    assert verdict.startswith("equal") and "types" not in verdict, verdict


def write_tables(spark, folder: Path, rows: int) -> str:
    """The given tables with ``rows`` rows (0 or a few), nulls in every column, repeated rows and added columns."""
    for name in TABLES:
        source = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        few = source.limit(rows)
        if rows:
            empty = spark.createDataFrame([tuple([None] * len(source.columns))], source.schema)
            blank = spark.createDataFrame([tuple({"string": "", "array<float>": []}.get(f.dataType.simpleString(), 10_000 + i) for i, f in enumerate(source.schema))], source.schema)
            few = few.union(few.limit(2)).union(empty).union(blank)
        extra = few.withColumns({c: few[few.columns[0]].cast("string") for c in ("size", "shard", "slot", "ledger", "found", "n_words", "kept", "key", "counts")})
        extra.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
@pytest.mark.parametrize("rows", [0, 12])
def test_odd_tables(spark, tmp_path_factory, name, rows):
    folder = write_tables(spark, tmp_path_factory.mktemp(f"odd{rows}"), rows)
    source = {"op1": "pages", "op5": "pages", "op12": "embeddings"}.get(name.split("_")[0], "documents")
    result = queries.QUERIES[name](spark, folder)
    if name.startswith("op") and not name.startswith("op13"):
        given = spark.read.parquet(f"{folder}/{source}.parquet")
        assert result.count() == (given.where("size(embedding) = 64") if source == "embeddings" else given).count()
    else:
        result.collect()
