"""The cheap test before the email generator passes whatever the generator matches."""

import pytest
from pyspark.sql import functions as F

from marlstone.llm import pii_boosting


@pytest.mark.parametrize("text", ["john.smith at example[dot]com", "john at example(dot)org", "write to john at example.com", "john {at} example{dot}com", "a [at] b dot com"])
def test_email_generator(spark, text):
    kind, pattern, test = pii_boosting.GENERATORS[0]
    at = spark.createDataFrame([(text,)], "text string")
    assert kind == "email" and at.select(F.col("text").rlike(pattern), F.col("text").rlike(test)).first() == (True, True)
