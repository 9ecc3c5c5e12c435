import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellflow.operators import models
from cellflow.streaming import slots


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i % 13), float(i % 7) if i % 5 else None, "abc"[i % 3], 2.0 * (i % 13) + (i % 3), dt.date(2024, 1, 1) + dt.timedelta(days=i % 30)) for i in range(300)]
    return spark.createDataFrame(data, "k int, a double, b double, t string, y double, day date")


def test_regressors_fill_in_medians_and_unseen_texts(spark, rows, tmp_path):
    m = models.fit(rows, "y", ["a", "b"], ["t"], "linear")
    scored = m.transform(rows)
    assert scored.agg(F.max(F.abs(F.col("predicted") - F.col("y")))).first()[0] < 1e-3
    odd = spark.createDataFrame([(1, None, None, "new", 0.0, None)], rows.schema)
    assert m.transform(odd).first()["predicted"] is not None
    m.save(str(tmp_path / "m"))
    again = models.Fitted.load(spark, str(tmp_path / "m")).transform(rows)
    assert again.join(scored.withColumnRenamed("predicted", "p"), "k").agg(F.max(F.abs(F.col("predicted") - F.col("p")))).first()[0] < 1e-9
    c = models.linear_contributions(models.fit(rows, "y", ["a", "b"], kind="ridge"), rows, "k")
    assert c.columns == ["k", "a", "b"] and c.count() == 300


def test_components_and_selection(rows):
    numbers, texts = models.feature_columns(rows, exclude=["k", "y"])
    assert (numbers, texts) == (["a", "b"], ["t"])
    labelled = rows.withColumns({"frozen": F.col("a"), "hot": (F.col("y") > 20).cast("int"), "way": F.col("k") % 3})
    corr = models.fit_residual(labelled, "frozen", "y", ["a"], kind="ridge")
    hot = models.fit(labelled, "hot", ["a"], kind="logistic", out="hot", classes=True)
    way = models.fit(labelled, "way", ["a"], kind="forest", out="way", classes=True)
    out = models.predict_components(labelled.drop("hot", "way"), corr, hot, way, "frozen", 0.1, beta=0.0)
    assert out.agg(F.avg(F.abs(F.col("p_final") - F.col("y")))).first()[0] < 2.0
    assert models.importances(models.fit(rows, "y", ["a", "b"], kind="trees"))[0][0] == "a"


def test_folds_never_look_ahead(rows):
    for train, test in models.folds(rows, "day", [dt.date(2024, 1, 10), dt.date(2024, 1, 20), dt.date(2024, 1, 31)]):
        assert train.agg(F.max("day")).first()[0] < test.agg(F.min("day")).first()[0]


def test_stream_adds_up_to_the_table(spark, tmp_path):
    data = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * i), i % 3, "click", float(i)) for i in range(200)]
    table = spark.createDataFrame(data, slots.SCHEMA)
    table.write.parquet(str(tmp_path / "in"))
    stream = slots.slot_sums(slots.read(spark, str(tmp_path / "in"), slots.SCHEMA))
    got = slots.run_to_end(stream, "slot_sums", str(tmp_path / "cp"), "update")
    want = slots.slot_sums(table)
    assert got.agg(F.sum("records"), F.sum("sum_value")).first() == want.agg(F.sum("records"), F.sum("sum_value")).first()
