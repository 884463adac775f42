import numpy as np

from nearfield.operators import ivf


def test_tune_goes_on(spark):
    """A target that the listed steps do not reach: cells whose centroids say nothing about their rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 48))
    frame = spark.createDataFrame([(i, v.tolist(), i % 50) for i, v in enumerate(x)], "id long, vector array<double>, cell int")
    cells = ivf.Cells(rng.normal(size=(50, 48)), np.full(50, 120))
    found = ivf.tune(frame, cells, ef=2, target=0.95)
    assert found > ivf.TRIED[-1] and found == cells.oversample
    assert len(cells.probe(x[0], 2, 10)) >= 40
