"""Each query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    result = con.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    expected = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in result.fetchall()), key=repr)
    assert columns == sorted(names)
    assert found == expected


def test_pagerank_sums_to_one(spark):
    from lodestone.operators.links import pagerank

    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "b", 1)], "src string, dst string, freq long")
    rank = {r.node: r["rank"] for r in pagerank(edges).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank["b"] > rank["a"]


@pytest.mark.parametrize("name", ["maximum_entropy_labels", "decision_tree_labels", "support_vector_labels"])
def test_trained_labels_beat_the_commoner_class(spark, name):
    found = catalog.QUERIES[name](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality in (0, 1)")
    rows = found.join(labels, "doc_id").select("quality", "predicted").collect()
    right = sum(r.quality == r.predicted for r in rows)
    common = max(sum(r.quality == k for r in rows) for k in (0, 1))
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert right > common


def test_topics_and_clusters_are_whole(spark):
    topics = catalog.QUERIES["latent_topics"](spark, SF).collect()
    assert len(topics) == 80 and all(r.term and r.weight > 0 for r in topics)
    clusters = catalog.QUERIES["k_means_clusters"](spark, SF)
    assert clusters.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert clusters.select("cluster").distinct().count() == 8
