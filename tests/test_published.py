"""Published figures replayed from published points. Fixed values."""

import pytest
from codeweave.functions import metrics
from codeweave.operators import triage
from pyspark.sql import functions as F

#: Mean F1 by the number of training codes, of two tracks; none where there are too few codes.
CURVES = {
    "a": {40: 0.609570165675961, 70: 0.636118876786728, 100: 0.650579699076409, 140: 0.646485594861728, 180: 0.667199028497085, 220: 0.666359264649237, 260: 0.661102760423348},
    "b": {40: 0.827857422068676, 70: 0.842802879048037, 100: 0.842146705139514, 140: 0.845980099852267, 180: 0.846096152216923, 220: 0.841356815724032, 260: None},
}
#: Slope over the last three points for 100 more codes, and predictions at 500, 1000 and 2000.
TRENDS = {"a": (-0.0076, 0.689, 0.709, 0.728), "b": (-0.0118, 0.853, 0.859, 0.865)}


@pytest.mark.parametrize("track", CURVES)
def test_trends(spark, track):
    points = spark.createDataFrame([(float(n), f) for n, f in CURVES[track].items()], "n double, f1 double")
    slope, *at = TRENDS[track]
    assert triage.last_slope(points.withColumn("n", F.col("n") / 100), "n", "f1").first().slope == pytest.approx(slope, abs=5e-5)
    got = triage.trend(points, "n", "f1", [500, 1000, 2000]).first()
    assert [round(got[f"at_{n}"], 3) for n in (500, 1000, 2000)] == at


def test_metrics_of_counts(spark):
    """Counts of a best setting and its published F1 and accuracy; F1 comes from rounded precision and recall."""
    df = spark.createDataFrame([(402, 179, 535)], "tp long, fp long, fn long")
    got = df.withColumns(metrics.rounded(F.col("tp"), F.col("fp"), F.col("fn"))).first()
    assert (got.f1, got.accuracy) == (0.53, 0.36)


def test_pooled_counts_of_a_cross_validation(spark):
    """True, emitted and known pairs of two tracks and their published precision, recall, F1 and accuracy."""
    df = spark.createDataFrame([(540, 728, 889), (268, 309, 329)], "tp long, n_emitted long, n_true long").withColumns(metrics.exact(F.col("tp"), F.col("n_emitted"), F.col("n_true")))
    got = [(round(r.precision, 3), round(r.recall, 3), round(r.f1, 3), round(r.accuracy, 3)) for r in df.collect()]
    assert got == [(0.742, 0.607, 0.668, 0.501), (0.867, 0.815, 0.84, 0.724)]
