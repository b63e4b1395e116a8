"""Resampling by ids that are no numbers."""

from pyspark.sql import functions as F

from lectern.llm import quality_classifier


def test_quality_takes_ids_of_any_type(spark):
    texts = [f"good words number {k} and some more" if k % 2 else f"spam spam {k} buy now" for k in range(60)]
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)] + [(None, "good words")], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{k}", k % 2) for k in range(40)], "doc_id string, quality int")
    got = quality_classifier.resample(docs, labels, 0.5)
    assert dict(got.dtypes)["doc_id"] == "string" and got.count() == 61 and got.where("kept").count() == 31
    mean = {r["good"]: r["w"] for r in got.where("doc_id is not null").groupBy((F.substring("doc_id", 2, 9).cast("int") % 2).alias("good")).agg(F.avg("log_weight").alias("w")).collect()}
    assert mean[1] > mean[0]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, quality_classifier.resample(docs, labels, 0.5).collect()), key=repr)
