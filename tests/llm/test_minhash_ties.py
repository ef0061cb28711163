from turnlytics.llm import minhash
from turnlytics.llm.common import Scratch


def test_an_outlier_at_exactly_the_threshold_is_linked(spark):
    """51 of 60 shingles are 85 %; the outlier's link is all it can share, with the least set of its bucket."""
    sets = {1: list(range(51)) + list(range(100, 109)), 2: list(range(51)), 3: list(range(51))}
    members = spark.createDataFrame([(7, i, len(s), 1 if i == 1 else 2) for i, s in sets.items()], "bucket long, id long, n long, part long")
    got = minhash.outlier_links(members, spark.createDataFrame(list(sets.items()), "id long, items array<long>"), 85, Scratch(spark, "ties"))
    assert {r["a"] for r in got.collect()} == {1}
