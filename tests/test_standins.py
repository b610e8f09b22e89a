from codeweave.plans.standins import code_chapter


def test_codes_of_five_digits_have_no_chapter(spark):
    df = spark.createDataFrame([(7,), (95,), (96,), (1000,), (1995,), (2000,), (9999,), (10000,), (10409,), (1950001,), (None,)], "code long")
    assert [r[0] for r in df.select(code_chapter("code")).collect()] == [1, 1, None, 11, 20, None, None, None, None, None, None]


def test_codes_without_chapters_stay_out_of_filtered_products(spark, tmp_path):
    import numpy as np
    from pyspark.sql import functions as F

    from codeweave.plans.standins import Data, chapters

    rng = np.random.default_rng(5)
    ids = [*range(1900, 1960), *range(12000, 12060)]
    spark.createDataFrame([(i, rng.normal(size=64).astype(float).tolist(), 0) for i in ids], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = Data(spark, str(tmp_path))
    s, t = chapters()
    for side, own in (("source", s), ("target", t)):
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(d.near_placed(0.5, side).where(t.isNotNull() & s.isNotNull())) == rows(d.near(0.5, side).where(s.isNotNull() & t.isNotNull()))
        assert d.near(0.5, side).where(own.isNull()).count() > 0 and d.near_placed(0.5, side).where(F.isnull(own)).count() == 0
