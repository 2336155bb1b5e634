import random

import pytest


@pytest.fixture
def rnd():
    return random.Random(7)


def frame(spark, texts, schema="id long, t string", extra=()):
    return spark.createDataFrame([(i, t, *extra) for i, t in enumerate(texts)], schema)
