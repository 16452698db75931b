"""Models are fitted on all rows that are not held back."""

import pytest
from pyspark.sql import functions as F

from threatloom.plans import training


class Seen(Exception):
    pass


def counted(df, *_):
    raise Seen({r[0]: r[1] for r in df.groupBy(df.columns[1]).count().collect()})


@pytest.fixture(scope="module")
def rows(spark):
    """300,000 rows of one class and 1,000 of another."""
    kind = F.when(F.col("id") < 300_000, 0).otherwise(1)
    return spark.range(301_000).select("id", kind.alias("malware"), (F.col("id") % 7).cast("double").alias("f0"))


def test_the_traffic_model_sees_all_rows(rows, monkeypatch):
    monkeypatch.setattr(training, "fit_traffic_model", counted)
    named = rows.select("id", F.concat(F.lit("c"), "malware").alias("attack_type"), "f0")
    with pytest.raises(Seen) as seen:
        training.train_traffic(named, "id", ["f0"])
    assert seen.value.args[0] == {"c0": 240_000, "c1": 800}


def test_the_malware_model_sees_all_rows(rows, monkeypatch):
    monkeypatch.setattr(training, "balance_classes", counted)
    with pytest.raises(Seen) as seen:
        training.train_malware(rows, "id", ["f0"])
    assert seen.value.args[0] == {0: 240_000, 1: 800}
