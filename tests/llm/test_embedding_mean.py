import numpy as np
import pytest

from turnlytics.llm import embedding_dedup


@pytest.mark.parametrize("shared", [0.05, 0.7])
def test_pairs_are_found_whatever_mean_the_vectors_share(spark, shared):
    """Pairs at 0.935 of vectors whose mean has this squared norm, with the recall of production."""
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 64))
    v[:, 0] = 0
    x = np.sqrt(1 - shared) * v / np.linalg.norm(v, axis=1, keepdims=True)
    x[:, 0] = np.sqrt(shared)
    y = embedding_dedup.partners(x, 0.935, seed=2)
    frame = spark.createDataFrame([(i, z.tolist(), 1) for i, z in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.embedding_duplicates(frame).collect()}
    assert np.mean([got[i] == got[i + 1500] for i in range(1500)]) >= 0.98
