from pyspark.sql import functions as F

from quillguard.streaming import incoming


def test_masked_stream(spark, tmp_path):
    schema = "page_id long, raw_text string, at timestamp"
    rows = [(1, "mail a@b.example"), (1, "mail a@b.example"), (2, None), (3, "call 0612345678")]
    spark.createDataFrame(rows, "page_id long, raw_text string").withColumn("at", F.to_timestamp(F.lit("2024-01-01 10:00:00"))).write.parquet(str(tmp_path / "in"))
    df = incoming.masked_stream(incoming.page_stream(spark, str(tmp_path / "in"), schema))
    q = incoming.start(df, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r["page_id"]: r["masked"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "mail [EMAIL_ADDRESS]", 2: None, 3: "call [PHONE_NUMBER]"}


def test_counts_stream(spark, tmp_path):
    schema = "page_id long, raw_text string, at timestamp"
    spark.createDataFrame([(1, "a@b.example"), (1, "a@b.example"), (2, "x")], "page_id long, raw_text string").withColumn("at", F.to_timestamp(F.lit("2024-01-01 10:00:00"))).write.parquet(str(tmp_path / "in"))
    df = incoming.counts_stream(incoming.page_stream(spark, str(tmp_path / "in"), schema), "at")
    q = df.writeStream.format("memory").queryName("counts_test").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    r = spark.sql("select * from counts_test").collect()
    assert [(x["n_emails"], x["n_pages"]) for x in r] == [(1, 2)]


def test_terms_of_a_dossier_are_learned_and_used(spark, tmp_path):
    schema = "page_id long, dossier_id string, doc_id long, page_no int, raw_text string"
    rows = [(1, "D", 10, 1, "Nom : Karl Mozdrin\nTel: 1"), (1, "D", 10, 1, "Nom : Karl Mozdrin\nTel: 1"), (2, "D", 11, 2, "signed Mozdrin, a@b.example"), (3, None, 12, 1, None), (4, "E", 13, 1, "Mozdrin")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = incoming.terms_stream(incoming.page_stream(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("terms_test").outputMode("complete")
    q.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    terms = spark.sql("select * from terms_test")
    assert [r["dossier_id"] for r in terms.collect()] == ["D"] and "mozdrin" in terms.first()["terms"]
    terms.write.parquet(str(tmp_path / "terms"))
    df = incoming.masked_with_terms(incoming.page_stream(spark, str(tmp_path / "in"), schema), spark.read.parquet(str(tmp_path / "terms")))
    incoming.start(df, str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination(120)
    got = {r["page_id"]: r["masked"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # a label takes the next line up to a colon along, so the family name is what is known
    assert got == {1: "Nom : Karl [PERSON]\nTel: 1", 2: "signed [PERSON], [EMAIL_ADDRESS]", 3: None, 4: "Mozdrin"}
