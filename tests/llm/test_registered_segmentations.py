from pyspark.sql import functions as F

from quivra.llm import queries


def test_three_segmentations_a_document(spark, small):
    found = queries.QUERIES["op6_gumbel_segmentations"](spark, small)
    assert found.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 3
