from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import learn
from lodestone.sources import tables
from lodestone.streaming import counts


def test_number_or_date(spark):
    rows = [("5月4日", True), ("年月日", False), ("1978年", True), ("25%", True), ("0.25", True), ("中国", False), (None, False)]
    df = spark.createDataFrame(rows, "x string, want boolean")
    assert all(r.got == r.want for r in df.select("want", tx.is_number_or_date(F.col("x")).alias("got")).collect())


def test_wiki_parsers_and_titles(spark):
    text = "#REDIRECT [[Other page#part]] [[Category:Birds|b]] [[Category:Birds]] [[A|see]] [[B]] [[A]] [[File:x.png]]"
    r = spark.createDataFrame([(text,)], "t string").select(tx.categories(F.col("t")).alias("c"), tx.internal_links(F.col("t")).alias("l"), tx.redirect_target(F.col("t")).alias("r")).first()
    assert r.c == ["Birds"] and r.r == "Other page" and r.l[-3:] == ["A", "B", "A"]
    titles = spark.createDataFrame([("List of birds",), ("1984 in film",), ("1984",), ("Bird",), ("Bird (disambiguation)",)], "t string")
    assert [x[0] for x in titles.select(tx.accepts_title(F.col("t"))).collect()] == [False, False, True, True, False]


def test_clustering_golden(spark):
    truth = [0, 0, 0, 0, 0, 1, 1, 2, 2, 2, 2, 2]
    one = spark.createDataFrame([(t, 0) for t in truth], "truth int, cluster int")
    m = learn.clustering_measures(one).first()
    assert m.pair_recall == 1 and abs(m.pair_precision - 21 / 66) < 1e-9
    each = learn.clustering_measures(spark.createDataFrame(list(enumerate(truth)), "cluster int, truth int")).first()
    assert each.pair_precision == 1 and each.b3_precision == 1


def test_wiki_dump(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<mediawiki><page><title>A</title><ns>0</ns><id>7</id><redirect title="B"/><revision><id>9</id><format>text/x-wiki</format><text>hello [[B]]</text></revision></page></mediawiki>')
    r = tables.read_wiki_dump(spark, str(tmp_path / "d.xml")).first()
    assert (r.id, r.title, r.ns, r.redirect, r.format) == (7, "A", 0, "B", "text/x-wiki")


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    batch.write.parquet(str(tmp_path / "in"))
    q = counts.term_totals(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, counts.term_totals(batch).collect()))
