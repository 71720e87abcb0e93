"""Windows and features (C)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import features as fe
from ..plans import adapters as ad
from ..schemas import TIME_FEATURES
from ._registry import query

W8 = ad.WIDTH
CHANNELS = ("ch_a", "ch_b")
NAMES = [f"{c}_{f}" for c in CHANNELS for f in TIME_FEATURES]
_FIX = "round({}, 6)::DECIMAL(38,6)::VARCHAR"


@query("SELECT acquisition_id, sample, (ch_a - 2.5) * 8 AS current_a, ch_b * 10000 AS speed_rpm FROM samples", "current_a speed_rpm")
def convert_units(spark, d):
    return fe.convert_units(ad.samples(spark, d), {"current_a": ("ch_a", 2.5, 8.0), "speed_rpm": ("ch_b", 0.0, 10000.0)}).select("acquisition_id", "sample", "current_a", "speed_rpm")


@query(f"SELECT acquisition_id || ':' || w * {W8} || ':' || (w + 1) * {W8} AS window_id, acquisition_id, w AS window_order, w * {W8} AS start_sample, (w + 1) * {W8} AS end_sample FROM (SELECT acquisition_id, sample // {W8} AS w FROM samples GROUP BY ALL HAVING count(*) = {W8})")
def count_tumbling_windows(spark, d):
    return fe.count_windows(ad.samples(spark, d), W8)


@query(f"SELECT acquisition_id, sample // {W8} AS window_order, sha256('window/1;' || string_agg(sample || ',' || {_FIX.format('ch_a')} || ',' || {_FIX.format('ch_b')}, ';' ORDER BY sample)) AS fingerprint FROM samples GROUP BY ALL HAVING count(*) = {W8}")
def window_fingerprint(spark, d):
    return fe.window_fingerprint(ad.samples(spark, d), CHANNELS, W8)


@query("SELECT * FROM features", " ".join(NAMES))
def window_time_features(spark, d):
    return ad.features(spark, d)


def _dft_sql() -> str:
    """Direct Fourier sums with the window's constants written out."""
    n, rate = W8, 50.0
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    rows = ", ".join(f"({k}, {j}, {hann[j] * np.cos(2 * np.pi * k * j / n)!r}::DOUBLE, {-hann[j] * np.sin(2 * np.pi * k * j / n)!r}::DOUBLE)" for k in range(n // 2 + 1) for j in range(n)).replace("np.float64(", "(")
    scale = n * float(hann @ hann)
    parts = []
    for c in CHANNELS:
        parts.append(f"""p_{c} AS (SELECT acquisition_id, w, k, k * {rate / n} AS f, (pow(sum(({c} - m_{c}) * re), 2) + pow(sum(({c} - m_{c}) * im), 2)) * CASE WHEN k IN (0, {n // 2}) THEN 1 ELSE 2 END AS p FROM x JOIN tw ON tw.j = x.j GROUP BY acquisition_id, w, k),
e_{c} AS (SELECT acquisition_id, w, sum(p) AS total, CASE WHEN sum(p) > 0 THEN sum(f * p) / sum(p) ELSE 0 END AS centre, CASE WHEN sum(p) > 0 THEN arg_max(f, (round(p, 9), -k)) ELSE 0 END AS dominant FROM p_{c} GROUP BY ALL),
b_{c} AS (SELECT acquisition_id, w, total / {scale!r} AS {c}_spectral_energy, any_value(centre) AS {c}_spectral_centroid, CASE WHEN any_value(total) > 0 THEN sqrt(sum((f - centre) ** 2 * p) / any_value(total)) ELSE 0 END AS {c}_spectral_bandwidth, any_value(dominant) AS {c}_dominant_frequency FROM p_{c} JOIN e_{c} USING (acquisition_id, w) GROUP BY acquisition_id, w, total)""")
    return f"""SELECT acquisition_id, w AS window_order, * EXCLUDE (acquisition_id, w) FROM (WITH tw(k, j, re, im) AS (VALUES {rows}),
x AS (SELECT acquisition_id, sample // {n} AS w, sample % {n} AS j, ch_a, ch_b, avg(ch_a) OVER v AS m_ch_a, avg(ch_b) OVER v AS m_ch_b, count(*) OVER v AS n FROM samples WINDOW v AS (PARTITION BY acquisition_id, sample // {n}) QUALIFY n = {n}),
{", ".join(parts)} SELECT * FROM b_ch_a JOIN b_ch_b USING (acquisition_id, w))"""


_SPECTRAL = [f"{c}_{f}" for c in CHANNELS for f in ("spectral_energy", "spectral_centroid", "spectral_bandwidth", "dominant_frequency")]


@query(_dft_sql(), " ".join(_SPECTRAL))
def window_spectral_features(spark, d):
    return fe.spectral_features(ad.samples(spark, d), CHANNELS, W8, 50.0)


@query("SELECT acquisition_id, window_order, ch_a_dominant_frequency, ch_b_dominant_frequency, 6.25::DOUBLE AS resolution, 25.0::DOUBLE AS nyquist FROM (" + _dft_sql() + ")", "ch_a_dominant_frequency ch_b_dominant_frequency")
def dominant_frequency(spark, d):
    f = fe.spectral_features(ad.samples(spark, d), CHANNELS, W8, 50.0)
    return f.select("acquisition_id", "window_order", "ch_a_dominant_frequency", "ch_b_dominant_frequency", F.lit(50.0 / W8).alias("resolution"), F.lit(25.0).alias("nyquist"))


@query(f"SELECT acquisition_id, window_order, canonical_class, len([{', '.join(NAMES)}])::INTEGER AS n, list_sum([{', '.join(NAMES)}]) AS total, '{{\"n\":22,\"first\":\"ch_a_mean\",\"last\":\"ch_b_crest\"}}' AS provenance FROM labelled_features", "total")
def assemble_feature_row(spark, d):
    rows = fe.assemble_features(ad.features(spark, d), NAMES, ad.acquisitions(spark, d))
    return rows.select("acquisition_id", "window_order", "canonical_class", F.size("ordered").alias("n"), F.aggregate("ordered", F.lit(0.0), lambda a, x: a + x).alias("total"), "provenance")


@query(f"SELECT acquisition_id, sample // {W8} AS window_order, count(*) AS n, CASE WHEN count(*) <> {W8} THEN 'WRONG_SAMPLE_COUNT' WHEN max(ch_b) >= 98 THEN 'NON_FINITE_SAMPLE' ELSE 'EXTRACTION_OK' END AS status FROM samples GROUP BY ALL")
def extraction_status(spark, d):
    s = ad.samples(spark, d).withColumn("ch_b", F.when(F.col("ch_b") >= 98, F.lit(float("nan"))).otherwise(F.col("ch_b")))
    return fe.extraction_status(s, W8, CHANNELS)


@query(f"SELECT acquisition_id, window_order, sha256(acquisition_id || '|' || window_order || '|v1|' || {' || chr(124) || '.join(_FIX.format(n) for n in NAMES[:6])}) AS feature_row_hash FROM features")
def feature_row_hash(spark, d):
    return fe.feature_row_hash(ad.features(spark, d), NAMES[:6], "v1")


@query("SELECT vec_id, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm, list_avg(v) AS mean FROM vectors", "norm mean")
def signal_reduce(spark, d):
    v = ad.vectors(spark, d)
    return fe.reduce_signal(fe.reduce_signal(v, "norm", out="norm"), "mean", out="mean").select("vec_id", "norm", "mean")


_CLASSICAL = [n for n in NAMES if not n.endswith(("_skewness", "_kurtosis", "_crest"))]


@query(f"SELECT acquisition_id, window_order, {', '.join(_CLASSICAL)} FROM features", " ".join(_CLASSICAL))
def representation_select(spark, d):
    return fe.select_representation(ad.features(spark, d), ("acquisition_id", "window_order"), "classical")


@query("SELECT name AS feature, status, status = 'AVAILABLE' AS included FROM (SELECT unnest(['ch_a_mean', 'ch_a_harmonic_1']) AS name, unnest(['AVAILABLE', 'DECLARED_ABSENT']) AS status UNION ALL SELECT column_name, 'UNDECLARED' FROM (DESCRIBE SELECT * FROM features) WHERE column_name NOT IN ('acquisition_id', 'window_order', 'ch_a_mean'))")
def feature_dictionary(spark, d):
    return fe.feature_dictionary(ad.features(spark, d), ("acquisition_id", "window_order"), ["ch_a_mean", "ch_a_harmonic_1"])


@query("SELECT event_id, coalesce(value, 0) + k + 1 AS total, 3 AS names FROM (SELECT event_id, value, (props->>'k')::DOUBLE AS k FROM events)", "total")
def merge_feature_maps(spark, d):
    e = ad.table(spark, d, "events").select("event_id", F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.lit(-1.0), F.lit("bad"), F.lit(float("nan"))).alias("m1"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("double"), F.lit("one"), F.lit(1.0)).alias("m2"))
    m = fe.merge_feature_maps(e, ["m1", "m2"])
    values = fe.ordered_values("merged")
    return m.select("event_id", F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(values).alias("names"))
