"""Verdicts of the two malware scorers and their ensemble."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom import fixed_values as V


def confidence(probability: Column) -> Column:
    return F.abs(probability - 0.5) * 2


def ensemble_probability(rf: Column, net: Column) -> Column:
    return rf * V.RF_WEIGHT + net * V.NET_WEIGHT


def ensemble_is_malware(rf: Column, net: Column, threshold: float = V.SERVING_THRESHOLD) -> Column:
    """Both scorers and their weighted mean must reach the threshold."""
    return (rf >= threshold) & (net >= threshold) & (ensemble_probability(rf, net) >= threshold)


def verdict_name(is_malware: Column) -> Column:
    return F.when(is_malware, "Malware").otherwise("Benign")


def _verdict(is_malware: Column, probability: Column, *extra: Column) -> Column:
    return F.struct(
        verdict_name(is_malware).alias("prediction"),
        probability.cast("double").alias("probability"),
        confidence(probability).cast("double").alias("confidence"),
        *extra,
    )


def prediction_struct(rf: Column, net: Column, threshold: float = V.SERVING_THRESHOLD) -> Column:
    """Nested result of the random forest, the network (named lstm) and the ensemble."""
    both = ensemble_is_malware(rf, net, threshold)
    return F.struct(
        _verdict(rf >= threshold, rf).alias("random_forest"),
        _verdict(net >= threshold, net).alias("lstm"),
        _verdict(
            both, ensemble_probability(rf, net), verdict_name(both).alias("final_prediction")
        ).alias("ensemble"),
    )


def _fixed_verdict(name: str, final: bool) -> Column:
    fields = [
        F.lit(name).alias("prediction"),
        F.lit(0.0).alias("probability"),
        F.lit(0.0).alias("confidence"),
    ]
    if final:
        fields.append(F.lit(name).alias("final_prediction"))
    return F.struct(*fields)


def fixed_prediction(name: str) -> Column:
    """A result no model made: zero probabilities under the given name."""
    return F.struct(
        _fixed_verdict(name, False).alias("random_forest"),
        _fixed_verdict(name, False).alias("lstm"),
        _fixed_verdict(name, True).alias("ensemble"),
    )


def override_known_benign(name: Column, prediction: Column) -> Column:
    """Known harmless tools keep their ensemble verdict but get a fixed network verdict."""
    lstm = F.struct(
        F.lit("Benign").alias("prediction"),
        F.lit(V.KNOWN_BENIGN_PROBABILITY).alias("probability"),
        F.lit(V.KNOWN_BENIGN_CONFIDENCE).alias("confidence"),
    )
    known = F.lower(name).isin(V.KNOWN_BENIGN_NAMES)
    return F.when(known, prediction.withField("lstm", lstm)).otherwise(prediction)
