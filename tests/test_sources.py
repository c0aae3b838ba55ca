"""Readers, writers and streams: what is written is read back."""

import json

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.sources import tables
from lodestone.streaming import counts


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", text', "x"), (2, "two\nlines", None), (3, "semi;colon", "z")]
    df = spark.createDataFrame(rows, "id long, text string, t string")
    for k, options in enumerate(({}, {"delimiter": ";", "quote": "'", "escape": "\\"})):
        path = f"{tmp_path}/csv{k}"
        tables.write_csv(df, path, **options)
        assert sorted(map(tuple, tables.read_csv(spark, path, "id long, text string, t string", **options).collect())) == rows


def test_text_sinks_in_one_scan(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, 0, "One", None, "[[Two|label]] and [[three]] [[Category:X]]"), (2, 14, "Category:X", None, "text"), (3, 0, "Old", "One", "#REDIRECT [[One]]"), (4, 0, "one", "ONE", "")], "id long, ns int, title string, redirect string, text string"
    )
    redirects = lambda df: tables.write_lines(df.filter("redirect is not null and lower(title) <> lower(redirect)").select("id", "title", "redirect"), f"{tmp_path}/redirects")
    links = lambda df: tables.write_lines(df.filter("ns = 0").select("id", tx.internal_links(F.col("text")).alias("l")).filter("size(l) > 0"), f"{tmp_path}/links")
    labels = lambda df: tables.write_lines(tables.anchors(df), f"{tmp_path}/labels")
    kinds = lambda df: tables.write_split(df.withColumn("kind", F.when(F.col("ns") == 0, "article").otherwise("category")), f"{tmp_path}/split")
    tables.traverse(pages, redirects, links, labels, kinds)
    read = lambda name: [r.value for r in spark.read.text(f"{tmp_path}/{name}").orderBy("value").collect()]
    assert read("redirects") == ["3\tOld\tOne"] and read("labels") == ["1\tTwo\tlabel"]
    assert read("links") == ["1\tTwo\tthree", "3\tOne"]
    assert spark.read.parquet(f"{tmp_path}/split/kind=category").count() == 1
    assert {tuple(r) for r in tables.category_rows(pages).collect()} == {(1, "One", "X"), (2, "Category:X", "ROOT")}


def test_graph_sinks(spark, tmp_path):
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    links = spark.createDataFrame([(1, 2, 3), (2, 3, 1), (1, 3, 1)], "src long, dst long, freq long")
    assert {r.src: json.loads(r.value)["links"] for r in tables.link_json(links).collect()}[1] == [{"dst": 2, "freq": 3}, {"dst": 3, "freq": 1}]
    tree = json.loads(tables.neighbours_json(names, links, 1).first().value)
    assert tree["size"] == 20 and [c["name"] for c in tree["children"]] == ["b", "c"] and tree["children"][0]["children"][0]["id"] == 3
    tables.write_gml(names.withColumnRenamed("name", "label"), links, f"{tmp_path}/g")
    gml = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/g").collect())
    assert gml.count("node [") == 3 and gml.count("edge [") == 3 and gml.startswith("graph [")


def test_xml_dump(spark, tmp_path):
    page = "<page><title>{}</title><ns>{}</ns><id>{}</id>{}<revision><id>99</id><format>text/x-wiki</format><text xml:space='preserve'>{}</text></revision></page>"
    body = page.format("One", 0, 1, "", "'''Bold''' text of enough letters to be a sample, with [[Two]] linked in it.") + page.format("Old", 0, 2, '<redirect title="One"/>', "#REDIRECT [[One]]")
    (tmp_path / "dump.xml").write_text(f"<mediawiki>{body}</mediawiki>")
    pages = tables.read_wiki_dump(spark, f"{tmp_path}/dump.xml")
    assert [(r.id, r.title, r.redirect) for r in pages.orderBy("id").collect()] == [(1, "One", None), (2, "Old", "One")]
    known = spark.createDataFrame([("Old",)], "title string")
    drawn = tables.sampled_pages(pages, 1000, known)
    assert [r.text for r in drawn.collect()] == ["Bold text of enough letters to be a sample, with Two linked in it."]
    tables.write_xml(drawn, f"{tmp_path}/sample")
    again = spark.read.format("xml").option("rowTag", "page").load(f"{tmp_path}/sample")
    assert [(r.id, r.title) for r in again.collect()] == [(1, "One")]


def test_sql_dump(spark, tmp_path):
    lines = ["-- a comment", r"INSERT INTO `langlinks` VALUES (1,'de','Eins'),(1,'en','One\'s, (own)'),(2,'fr','Deux'),(3,'en','Three');", "INSERT INTO `langlinks` VALUES (9,'fr','Neuf');"]
    (tmp_path / "ll.sql").write_text("\n".join(lines))
    got = sorted(map(tuple, tables.read_sql_dump(spark, f"{tmp_path}/ll.sql", "en").collect()))
    assert got == [(1, "en", "One's, (own)"), (3, "en", "Three")]


def test_bucketed_table(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    spark.sql("DROP TABLE IF EXISTS bucketed_test")
    df.write.mode("overwrite").option("path", f"{tmp_path}/b").bucketBy(4, "id").sortBy("id").saveAsTable("bucketed_test")
    plan = spark.table("bucketed_test").groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and spark.table("bucketed_test").count() == 100
    spark.sql("DROP TABLE bucketed_test")


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = counts.windowed_counts(stream, "1 hour", "3650 days").writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert spark.table("hourly").agg(F.sum("n")).first()[0] == events.count() and spark.table("hourly").count() == want.count()


def test_stems():
    pairs = "caresses:caress ponies:poni agreed:agre plastered:plaster motoring:motor conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat rational:ration digitizer:digit vietnamization:vietnam operator:oper decisiveness:decis sensibiliti:sensibl triplicate:triplic goodness:good allowance:allow adjustment:adjust adoption:adopt controll:control generalizations:gener by:by"
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    words, stems = zip(*(p.split(":") for p in pairs.split()), strict=True)
    got = spark.createDataFrame([(list(words), "中国 的 Running dogs 1978年 été")], "w array<string>, t string").select(tx.stemmed("w").alias("s"), tx.english("t").alias("e"), tx.han_bigrams(F.col("t")).alias("h")).first()
    assert tuple(got.s) == stems and got.e == ["run", "dog", "été"] and got.h == ["中国", "的", "年"]
