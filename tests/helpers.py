"""What several test modules use. The name is not that of a module in tests/llm."""


def one(spark, column):
    """The value of a column expression."""
    return spark.range(1).select(column.alias("v")).first()["v"]
