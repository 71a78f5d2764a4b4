from pyspark.sql import functions as F


def shuffled(read):
    """A table reader whose rows come in another order and other partitions."""
    return lambda spark, sf, name: read(spark, sf, name).repartition(5, F.rand(3)).sortWithinPartitions(F.rand(7))
