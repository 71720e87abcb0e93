"""Names and types that the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

# The classes in canonical order, the baseline class first; arg-max ties go to the first.
CLASSES = ("Healthy", "Mech_Damage", "Elec_Damage", "Mech_Elec_Damage")
BASELINE = CLASSES[0]

# The time features of a channel, in order, then its spectral ones.
TIME_FEATURES = ("mean", "std", "variance", "rms", "max", "min", "peak", "peak_to_peak", "skewness", "kurtosis", "crest")
SPECTRAL_FEATURES = ("spectral_energy", "spectral_centroid", "spectral_bandwidth")

SAMPLES = T.StructType([
    T.StructField("acquisition_id", T.StringType(), False),
    T.StructField("sample", T.LongType(), False),
    T.StructField("t", T.DoubleType()),
    T.StructField("ch_a", T.DoubleType()),
    T.StructField("ch_b", T.DoubleType()),
])

AUDIT_EVENT = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("event_index", T.LongType(), False),
    T.StructField("event_type", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("previous_event_hash", T.StringType()),
    T.StructField("event_hash", T.StringType()),
])

TREND_EVIDENCE = T.StructType([
    T.StructField("acquisition_id", T.StringType(), False),
    T.StructField("trend_model", T.StringType(), False),
    *[T.StructField(c, T.DoubleType()) for c in ("trend_value", "first_derivative", "second_derivative", "curvature", "maximum_curvature", "fit_rmse", "roughness", "effective_degrees_of_freedom", "uncertainty")],
    T.StructField("window_count", T.LongType()),
    T.StructField("fit_status", T.StringType()),
    T.StructField("reason", T.StringType()),
])
