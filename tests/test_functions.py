from pyspark.sql import functions as F

from codeweave.functions import chapters as ch
from codeweave.functions import metrics, text


def column(spark, values, f):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_chapters_numeric(spark):
    assert column(spark, ["1", "01", "250.1", "V10", "999", None], lambda x: ch.chapter(x, ch.ICD9CM)) == [1, 1, 3, None, 17, None]


def test_chapters_alpha(spark):
    assert column(spark, ["A00", "D48", "D49", "D50", "T99", "Y98"], lambda x: ch.chapter(x, ch.ICD10CA, alpha=True)) == [1, 2, None, 3, None, 20]


def test_icda8_gap(spark):
    assert column(spark, ["0", "136", "137", "140"], lambda x: ch.chapter(x, ch.ICDA8)) == [1, 1, None, 2]


def test_distance(spark):
    df = spark.createDataFrame([(6, 7), (6, 8), (6, 9), (3, 3), (3, 4), (1, 3), (None, 1)], "s int, t int")
    assert [r[0] for r in df.select(ch.distance(F.col("s"), F.col("t"), ch.ALIGN_10_9)).collect()] == [0, 0, 2, 2, 0, 2, None]
    one = spark.createDataFrame([(7, 8)], "s int, t int").select(ch.distance(F.col("s"), F.col("t"), {7: [9]}))
    assert one.first()[0] == 1


def test_inverse():
    assert ch.inverse({1: [1, 2], 2: [2]}) == {1: [1], 2: [1, 2]}


def test_text(spark):
    assert column(spark, ["pain due to injury of the knee type"], text.strip_fillers) == ["pain injury knee"]
    assert column(spark, ["Other  Hernia, other"], text.tokens) == [["other", "hernia"]]
    assert column(spark, [" A-b,  C "], text.clean) == ["a b c"]
    pair = spark.createDataFrame([(["other", "hernia"], ["hernia", "nos"], "kitten", "sitting")], "a array<string>, b array<string>, c string, d string")
    row = pair.select(text.jaccard(F.col("a"), F.col("b")), text.overlap(F.col("a"), F.col("b")), text.first_token_equal(F.col("a"), F.col("b")), text.edit_distance(F.col("c"), F.col("d"))).first()
    assert [round(x, 6) for x in row] == [round(1 / 3, 6), 0.5, 0, round(3 / 7, 6)]


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")
    row = df.select(*[c.alias(n) for n, c in metrics.rounded(F.col("tp"), F.col("fp"), F.col("fn")).items()]).first()
    assert list(row) == [0.0, 0.0, 0.0, 0.0]
    f = spark.range(1).select(metrics.round3(metrics.f1(F.lit(0.692), F.lit(0.429)))).first()[0]
    assert f == 0.530
