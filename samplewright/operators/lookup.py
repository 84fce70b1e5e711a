"""Joins, name normalisation and coverage checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from samplewright.functions.columns import int_div
from samplewright.functions.fixed import FALLBACK_MEAN_MS, FALLBACK_STD_MS
from samplewright.operators.rank import ordered_position
from samplewright.session import broadcast_if_small, is_small, same_keys, settled


def fetch_by_index(samples: DataFrame, index_df: DataFrame, idx: str = "sample_idx",
                   on_missing: str = "error") -> DataFrame:
    """Rows of ``samples`` at the indices of ``index_df`` (repeats allowed).

    An index outside the samples raises when the row is computed, or is left out
    with ``on_missing='drop'``.
    """
    # A short list of indices is sent to the samples first, so that only hits move.
    near = samples
    if is_small(index_df.select(idx)):
        near = samples.join(F.broadcast(index_df.select(idx).distinct()), idx, "left_semi")
    if on_missing == "drop":
        return index_df.join(near, idx)
    if on_missing != "error":
        raise ValueError(f"unknown on_missing {on_missing!r}")
    joined = index_df.join(near.withColumn("_found", F.lit(True)), idx, "left")
    problem = F.raise_error(F.concat(F.lit("index out of range: "), F.coalesce(F.col(idx).cast("string"), F.lit("NULL"))))
    kind = index_df.schema[idx].dataType
    checked = F.when(F.col("_found").isNull(), problem.cast(kind)).otherwise(F.col(idx))
    return joined.withColumn(idx, checked).drop("_found")


def shard_ranges(shard_counts: DataFrame, shard: str = "shard_id", count: str = "n") -> DataFrame:
    """``shard_id, n, first_idx, end_idx``: global index range of each shard, by shard number.

    One row per shard, so the window holds shard totals and never samples.
    """
    end = F.sum(count).over(Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, 0))
    return shard_counts.select(shard, count, (end - F.col(count)).alias("first_idx"), end.alias("end_idx"))


def locate_shard(index_df: DataFrame, shard_counts: DataFrame, idx: str = "sample_idx",
                 shard: str = "shard_id", count: str = "n", on_missing: str = "error") -> DataFrame:
    """Add ``shard_id`` and ``local_idx`` of each global index.

    Index space is cut into bins as wide as the average shard, which turns the
    range condition into an equi-join with a residual test.
    """
    ranges = shard_ranges(settled(shard_counts), shard, count).where(F.col(count) > 0)
    step = ranges.agg(F.greatest(F.lit(1).cast("bigint"), F.coalesce(F.ceil(F.avg(count)), F.lit(1)))).scalar()
    bins = F.sequence(int_div("first_idx", step), int_div(F.col("end_idx") - 1, step))
    binned = ranges.withColumn("_bin", F.explode(bins))
    asked = index_df.withColumn("_bin", int_div(idx, step))
    hit = (asked["_bin"] == binned["_bin"]) & (asked[idx] >= binned["first_idx"]) & (asked[idx] < binned["end_idx"])
    joined = asked.join(broadcast_if_small(binned), hit, "left" if on_missing == "error" else "inner")
    problem = F.raise_error(F.concat(F.lit("index out of range: "), F.coalesce(F.col(idx).cast("string"), F.lit("NULL"))))
    kind = index_df.schema[idx].dataType
    checked = F.when(F.col("first_idx").isNull(), problem.cast(kind)).otherwise(F.col(idx)).alias(idx)
    return joined.select(
        *[checked if c == idx else asked[c] for c in index_df.columns],
        F.col(shard), (F.col(idx) - F.col("first_idx")).alias("local_idx"),
    )


def class_index(df: DataFrame, label: str = "label", out: str = "class_idx") -> DataFrame:
    """Dense number of each class in the order of the sorted class names."""
    classes = settled(df.select(label).where(F.col(label).isNotNull()).distinct())
    if is_small(classes):
        number = F.row_number().over(Window.orderBy(label)) - 1
        numbered = F.broadcast(classes.withColumn(out, number.cast("int")))
    else:
        numbered = ordered_position(classes, [label], out)
    return df.join(numbered, label, "left").select(*df.columns, F.col(out).cast("int").alias(out))


def normalise_names(df: DataFrame, name: str, mapping: DataFrame | Sequence[tuple[str, str]],
                    out: str = "clean_name") -> DataFrame:
    """Short device name: exact map entry, else the first entry contained in the name
    (ignoring case and spaces; found by an index of letter triples), else the name with ``_`` for spaces.

    ``mapping`` is ``(ord, raw, clean)``, or a sequence of ``(raw, clean)``. Distinct
    names are matched once and joined back.
    """
    if not isinstance(mapping, DataFrame):
        rows = [(i, raw, clean) for i, (raw, clean) in enumerate(mapping)]
        mapping = df.sparkSession.createDataFrame(rows, "ord int, raw string, clean string")

    def squeezed(text: str | Column) -> Column:
        return F.replace(F.lower(text), F.lit(" "), F.lit(""))

    names = df.select(F.col(name).alias("_name")).where("_name is not null").distinct()
    # A name the map holds is done; the contains test is left for the others.
    exact = mapping.groupBy(F.col("raw").alias("_name")).agg(F.max_by("clean", "ord").alias("_exact"))
    names = names.join(broadcast_if_small(exact), "_name", "left")
    inside = _contained(names.where("_exact is null").select("_name", squeezed("_name").alias("_text")),
                        mapping.select("ord", "clean", squeezed("raw").alias("_raw")))
    found = inside.groupBy("_name").agg(F.min_by("clean", "ord").alias("_inside"))
    matched = names.join(found, "_name", "left").select("_name", F.coalesce("_exact", "_inside").alias(out))
    cleaned = settled(matched.select("_name", F.coalesce(out, F.replace("_name", F.lit(" "), F.lit("_"))).alias(out)))
    joined = df.join(broadcast_if_small(cleaned), df[name] == cleaned["_name"], "left")
    return joined.select(*[df[c] for c in df.columns], out)


def _contained(names: DataFrame, entries: DataFrame) -> DataFrame:
    """``_name, ord, clean`` of all entries (``ord, clean, _raw``) whose text lies in that of a name (``_name, _text``).

    An index of letter triples: a name holds every triple of an entry within it, so it is enough to look an entry up by
    the one of its triples that the fewest names have, and to test these names. Shorter entries are their own key.
    """
    def grams(text: str, size: int) -> Column:
        ends = F.sequence(F.lit(1), F.length(text) - (size - 1))
        own = F.transform(ends, lambda i: F.substring(F.col(text), i, F.lit(size))) if size else F.array(F.lit(""))
        return F.when(F.length(text) >= size, own).otherwise(F.array().cast("array<string>"))

    entries = entries.where("_raw is not null").withColumn("_size", F.least(F.lit(3), F.length("_raw")))
    sizes = sorted(r[0] for r in entries.select("_size").distinct().collect())  # four numbers at most
    if not sizes:
        return names.select("_name", F.lit(0).alias("ord"), F.lit("").alias("clean")).limit(0)
    held = names.select("_name", "_text", F.explode(F.array_distinct(F.concat(*[grams("_text", k) for k in sizes]))).alias("_gram"))
    own = F.coalesce(*[F.when(F.col("_size") == k, grams("_raw", k)) for k in sizes])
    keyed = entries.select("ord", "clean", "_raw", F.explode(F.array_distinct(own)).alias("_gram"))
    common = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_names"))
    rarest = keyed.join(common, "_gram").groupBy("ord", "clean", "_raw").agg(F.count(F.lit(1)).alias("_held"), F.min(F.struct("_names", "_gram"))["_gram"].alias("_gram"))
    return held.join(broadcast_if_small(settled(rarest)), "_gram").where(F.contains("_text", F.col("_raw"))).select("_name", "ord", "clean")


def expected_grid(spark: SparkSession, batch_sizes: Mapping[str, Sequence[int]], models: Sequence[str],
                  optimizers: Sequence[str]) -> DataFrame:
    """Every configuration that should have been measured."""
    devices = spark.createDataFrame(
        [(d, list(sizes)) for d, sizes in batch_sizes.items()], "device string, batch_sizes array<int>"
    )
    return (
        devices.select("device", F.explode("batch_sizes").alias("batch_size"))
        .withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
        .withColumn("optimizer", F.explode(F.array(*[F.lit(o) for o in optimizers])))
        .select("device", "model", "batch_size", "optimizer")
    )


def observed_configs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct configurations seen in the runs."""
    return runs.select(*keys).distinct()


def coverage_gap(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected configurations without a run."""
    return expected.select(*keys).join(observed_configs(observed, keys), list(keys), "left_anti")


def coverage_counts(gap: DataFrame, devices: DataFrame, device: str = "device") -> DataFrame:
    """Number of missing configurations of every device, zeros included."""
    counts = gap.groupBy(device).agg(F.count(F.lit(1)).alias("_n"))
    return (
        devices.select(device).distinct().join(counts, device, "left")
        .select(device, F.coalesce("_n", F.lit(0).cast("bigint")).alias("missing"))
    )


def tiered_lookup(df: DataFrame, config: DataFrame, gpu: str = "gpu", model: str = "model",
                  default_ms: float = FALLBACK_MEAN_MS, default_std_ms: float = FALLBACK_STD_MS) -> DataFrame:
    """Add ``delay_s, std_s, tier`` from the model entry, the device default or a constant.

    ``config`` is the long table ``gpu, model, mean_ms, std_ms, default_mean_ms,
    default_std_ms``. A device default of NULL or 0 is passed over.
    """
    config = settled(config)
    by_model = config.where("model is not null").select(
        F.col("gpu").alias("_gpu"), F.col("model").alias("_model"),
        F.col("mean_ms").alias("_mean"), F.col("std_ms").alias("_std"), F.lit(True).alias("_has_model"),
    )
    by_gpu = config.groupBy("gpu").agg(
        F.first("default_mean_ms").alias("_default_mean"), F.first("default_std_ms").alias("_default_std"),
    ).withColumnRenamed("gpu", "_device")
    joined = (
        df.join(broadcast_if_small(by_model), (df[gpu] == by_model["_gpu"]) & (df[model] == by_model["_model"]), "left")
        .join(broadcast_if_small(by_gpu), df[gpu] == by_gpu["_device"], "left")
    )
    use_model = F.col("_has_model").isNotNull()
    use_gpu = F.coalesce(F.col("_default_mean") != 0, F.lit(False))

    def pick(own: str, default: str, constant: float) -> Column:
        chosen = F.when(use_model, F.col(own)).when(use_gpu, F.col(default)).otherwise(F.lit(constant))
        return chosen / 1000.0

    tier = F.when(use_model, "model").when(use_gpu, "device").otherwise("fallback")
    return joined.select(
        *[df[c] for c in df.columns],
        pick("_mean", "_default_mean", default_ms).alias("delay_s"),
        pick("_std", "_default_std", default_std_ms).alias("std_s"),
        tier.alias("tier"),
    )


def compare(df: DataFrame, system: str, keys: Sequence[str], value: str, a: str, b: str) -> DataFrame:
    """Two systems on the same keys: ``a_value, b_value, ratio = b/a, change_pct``.

    One aggregation; keys that only one system has are left out.
    """
    sides = df.where(F.col(system).isin(a, b)).groupBy(*keys).agg(
        F.avg(F.when(F.col(system) == a, F.col(value))).alias("a_value"),
        F.avg(F.when(F.col(system) == b, F.col(value))).alias("b_value"),
    )
    both = sides.where("a_value is not null and b_value is not null")
    ratio = F.try_divide("b_value", "a_value")
    return both.withColumns({"ratio": ratio, "change_pct": (ratio - 1) * 100})


def overhead(df: DataFrame, system: str, keys: Sequence[str], value: str, base: str, other: str) -> DataFrame:
    """``overhead_pct = (1 - mean(other)/mean(base))*100`` per key."""
    sides = df.where(F.col(system).isin(base, other)).groupBy(*keys).agg(
        F.avg(F.when(F.col(system) == base, F.col(value))).alias("base_mean"),
        F.avg(F.when(F.col(system) == other, F.col(value))).alias("other_mean"),
    )
    share = F.try_divide("other_mean", "base_mean")
    return sides.withColumn("overhead_pct", (1 - share) * 100)


def union_results(*tables: DataFrame) -> DataFrame:
    """Result tables of several systems or phases under one another, by column name."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


__all__ = [
    "class_index", "compare", "coverage_counts", "coverage_gap", "expected_grid", "fetch_by_index",
    "locate_shard", "normalise_names", "observed_configs", "overhead", "same_keys", "shard_ranges",
    "tiered_lookup", "union_results",
]
