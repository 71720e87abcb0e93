"""Windows of samples and their features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, content_hash, dot, finite, first_reason, fixed, norm, ratio
from ..schemas import SPECTRAL_FEATURES, TIME_FEATURES


def convert_units(samples: DataFrame, rules: dict[str, tuple[str, float, float]]) -> DataFrame:
    """Add columns: rules map a new name to (source column, offset, factor), the value being (source - offset) * factor."""
    return samples.withColumns({name: (F.col(c) - F.lit(offset)) * F.lit(factor) for name, (c, offset, factor) in rules.items()})


def window_number(width: int, sample: str = "sample") -> Column:
    return F.floor(F.col(sample) / width).cast("long")


def count_windows(samples: DataFrame, width: int) -> DataFrame:
    """(window_id, acquisition_id, window_order, start_sample, end_sample): full windows of `width` samples, half open.

    The incomplete tail of an acquisition gives no window.
    """
    w = samples.groupBy("acquisition_id", window_number(width).alias("window_order")).agg(F.count("*").alias("n")).where(F.col("n") == width)
    start = F.col("window_order") * width
    w = w.withColumn("start_sample", start).withColumn("end_sample", start + width)
    return w.select(F.concat_ws(":", F.col("acquisition_id").cast("string"), F.col("start_sample").cast("string"), F.col("end_sample").cast("string")).alias("window_id"), "acquisition_id", "window_order", "start_sample", "end_sample")


def window_fingerprint(samples: DataFrame, channels: Sequence[str], width: int, tag: str = "window/1") -> DataFrame:
    """(acquisition_id, window_order, fingerprint): SHA-256 over a tag and the window's values in sample order."""
    text = F.concat_ws(",", F.col("sample").cast("string"), *[fixed(c) for c in channels])
    w = samples.groupBy("acquisition_id", window_number(width).alias("window_order")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("sample", text.alias("text")))).alias("rows")).where(F.col("n") == width)
    return w.select("acquisition_id", "window_order", F.sha2(F.concat(F.lit(tag + ";"), F.array_join(F.transform("rows", lambda r: r["text"]), ";")), 256).alias("fingerprint"))


def _time(c: str) -> list[Column]:
    """Population moments; a constant channel has skewness and kurtosis 0, an all-zero one crest 0."""
    sd, rms = F.stddev_pop(c), F.sqrt(F.avg(F.col(c) * F.col(c)))
    values = [F.avg(c), sd, F.var_pop(c), rms, F.max(c), F.min(c), F.max(F.abs(c)), F.max(c) - F.min(c), F.when(sd == 0, 0.0).otherwise(F.skewness(c)), F.when(sd == 0, 0.0).otherwise(F.kurtosis(c)), F.when(rms == 0, 0.0).otherwise(F.max(F.abs(c)) / rms)]
    return [v.alias(f"{c}_{name}") for v, name in zip(values, TIME_FEATURES, strict=True)]


def time_features(samples: DataFrame, channels: Sequence[str], width: int) -> DataFrame:
    """(acquisition_id, window_order, 11 features a channel) of full windows: one aggregation, combined before its shuffle."""
    aggs = [a for c in channels for a in _time(c)]
    out = samples.groupBy("acquisition_id", window_number(width).alias("window_order")).agg(F.count("*").alias("_n"), *aggs)
    return out.where(F.col("_n") == width).drop("_n")


def spectra(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One-sided power by frequency of centred signals, a row each, under a periodic Hann window, and the window's energy times N."""
    n = x.shape[1]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * hann)) ** 2
    power[:, 1 : (n + 1) // 2] *= 2
    return np.fft.rfftfreq(n, 1 / rate), power, n * float(hann @ hann)


def spectral_features(samples: DataFrame, channels: Sequence[str], width: int, rate: float) -> DataFrame:
    """(acquisition_id, window_order, energy, centroid, bandwidth and dominant frequency a channel) of full windows.

    A window's samples meet in one row, `width` of them; the windows of a batch are one Fourier transform of numpy's. No
    power gives zeros; of equal powers the lowest frequency is dominant.
    """
    names = [f"{c}_{f}" for c in channels for f in (*SPECTRAL_FEATURES, "dominant_frequency")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c in channels:
                values = b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                f, p, scale = spectra(values, rate)
                total = p.sum(1)
                some = np.where(total > 0, total, 1.0)
                centre = (p @ f) / some
                spread = np.sqrt(((f - centre[:, None]) ** 2 * p).sum(1) / some)
                out += [total / scale, centre, spread, np.where(total > 0, f[np.argmax(np.round(p, 9), axis=1)], 0.0)]
            yield pa.RecordBatch.from_arrays([b.column("acquisition_id"), b.column("window_order"), *[pa.array(x) for x in out]], ["acquisition_id", "window_order", *names])

    kind = samples.schema["acquisition_id"].dataType.simpleString()
    schema = f"acquisition_id {kind}, window_order long, " + ", ".join(f"{n} double" for n in names)
    rows = samples.select("acquisition_id", window_number(width).cast("long").alias("window_order"), F.struct("sample", *[F.col(c).cast("double").alias(c) for c in channels]).alias("s"))
    full = rows.groupBy("acquisition_id", "window_order").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("s")).alias("s")).where(F.col("n") == width)
    return full.select("acquisition_id", "window_order", *[F.transform("s", lambda x: x[c]).alias(c) for c in channels]).mapInArrow(run, schema)  # noqa: B023


def assemble_features(features: DataFrame, names: Sequence[str], classes: DataFrame) -> DataFrame:
    """Feature rows with the ordered array and its JSON provenance; the class is joined after extraction, by acquisition."""
    f = features.select("acquisition_id", "window_order", F.array(*names).alias("ordered"), F.to_json(F.struct(F.lit(len(names)).alias("n"), F.lit(names[0]).alias("first"), F.lit(names[-1]).alias("last"))).alias("provenance"))
    return f.join(classes.select("acquisition_id", "canonical_class"), "acquisition_id")


def extraction_status(windows: DataFrame, width: int, channels: Sequence[str]) -> DataFrame:
    """(acquisition_id, window_order, n, status): why a group of samples gives no features, the first reason in order."""
    bad = sum(F.sum((~finite(c)).cast("int")) for c in channels)
    w = windows.groupBy("acquisition_id", window_number(width).alias("window_order")).agg(F.count("*").alias("n"), bad.alias("bad"), F.count_distinct("sample").alias("k"))
    return w.select("acquisition_id", "window_order", "n", first_reason((F.col("acquisition_id").isNull(), "MISSING_IDENTITY"), (F.col("n") != width, "WRONG_SAMPLE_COUNT"), (F.col("k") != width, "DUPLICATED_SAMPLES"), (F.col("bad") > 0, "NON_FINITE_SAMPLE"), ok="EXTRACTION_OK").alias("status"))


def feature_row_hash(features: DataFrame, names: Sequence[str], schema_hash: str) -> DataFrame:
    """(acquisition_id, window_order, feature_row_hash) over ids, schema and the features in order, six decimals each."""
    return features.select("acquisition_id", "window_order", content_hash("acquisition_id", "window_order", F.lit(schema_hash), *[fixed(n) for n in names]).alias("feature_row_hash"))


def reduce_signal(vectors: DataFrame, how: str, vector: str = "v", out: str = "signal") -> DataFrame:
    """A vector's mean or Euclidean norm."""
    v = F.col(vector)
    value = norm(v) if how == "norm" else ratio(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v))
    return vectors.withColumn(out, value)


def select_representation(features: DataFrame, keys: Sequence[str], which: str, missing: Sequence[str] = ()) -> DataFrame:
    """Keys and the columns of a representation: `classical` the moments, `spectral` the rest, `hybrid` all; absent ones NaN."""
    shape = ("_skewness", "_kurtosis", "_crest")
    rest = [c for c in features.columns if c not in keys]
    chosen = {"classical": [c for c in rest if not c.endswith(shape)], "shape": [c for c in rest if c.endswith(shape)], "hybrid": rest}[which]
    return features.select(*keys, *chosen, *[F.lit(float("nan")).alias(m) for m in missing if m not in rest])


def feature_dictionary(features: DataFrame, keys: Sequence[str], declared: Sequence[str]) -> DataFrame:
    """(feature, status, included): declared names that the table has, those it hasn't, and those nobody declared."""
    spark = features.sparkSession
    there = [c for c in features.columns if c not in keys]
    rows = [(n, "AVAILABLE" if n in there else "DECLARED_ABSENT", n in there) for n in declared] + [(n, "UNDECLARED", False) for n in there if n not in declared]
    return spark.createDataFrame(rows, "feature string, status string, included boolean")


def _later_wins(first: Column, later: Column) -> Column:
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(later, k)), later)


def merge_feature_maps(df: DataFrame, maps: Sequence[str], out: str = "merged") -> DataFrame:
    """Several name -> value maps merged, the later ones winning; only finite values stay; an empty result is null."""
    merged = F.col(maps[0])
    for m in maps[1:]:
        merged = _later_wins(merged, F.col(m))
    good = F.map_filter(merged, lambda k, v: finite(v))
    return df.withColumn(out, F.when(F.size(good) > 0, good))


def ordered_values(m: Column | str, names: Sequence[str] | None = None) -> Column:
    """A map's values by sorted name, or in the given order with null for what is absent."""
    m = col(m)
    keys = F.array(*[F.lit(n) for n in names]) if names else F.array_sort(F.map_keys(m))
    return F.transform(keys, lambda k: F.try_element_at(m, k))
