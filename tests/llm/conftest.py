import glob
import os

import duckdb
import pytest

from storyloom.llm.common import ready

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def workers(spark):
    ready(spark)


@pytest.fixture(scope="session")
def corpus(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def texts(corpus):
    return {r.doc_id: r.text for r in corpus.select("doc_id", "text").collect()}


def same_as_sql(spark, query, folder=FOLDER):
    """The rows of a query equal those of its SQL."""
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = query.run(spark, folder)
    result = con.execute(query.sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(repr, result.fetchall()))
    got = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    assert got == want
    return len(got)


def messy(spark, rows, schema="doc_id bigint, text string"):
    """A table whose further columns have names that the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    for name in ("_id", "_text", "kept", "keep_id", "group_size", "component_id", "sequence_id", "spans", "fingerprint", "Kept Rows"):
        df = df.withColumn(name, F.lit("other"))
    return df


def thue_morse(n, letters="ab"):
    """A word in which no polynomial modulo a power of two tells the two letters apart."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))
