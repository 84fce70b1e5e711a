"""Dense positions, running values and order statistics without a one-task sort.

Three recipes, shared by the samplers and the metric operators:

* ``hashed_position`` - rank by a seeded hash. Rows are split into hash buckets
  (uniform whatever the key distribution), the bucket counts give each bucket
  its first position, and only rows of one bucket are sorted together.
* ``ordered_position`` - rank by natural order, from one range-partitioned sort
  that is checkpointed so both of its passes see the same partitions.
* ``running`` / ``order_statistics`` - cumulative values and exact quantiles per
  group, where a group may hold most of the table: groups are cut into blocks by
  sampled ranges of their order, or narrowed down by digits of their values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DataType, DoubleType, IntegralType

from samplewright.functions.columns import hash_hex, hex_number, int_div
from samplewright.functions.fixed import DEFAULT_SEED
from samplewright.session import BROADCAST_ROWS, broadcast_if_small, checkpoint_dir, kept, row_bytes, same_keys, settled

BUCKET = "_bucket"
MAX_DIGITS = 5
# Bits that a pass of a radix selection resolves.
DIGIT_BITS = 16
# Rows of one digit node that are ranked rather than split further.
RANKED_ROWS = 65_536


def bucket_digits(rows: int, rows_per_bucket: int = 4096) -> int:
    """Hex digits of the bucket for a table of about ``rows`` rows, 2 to 5.

    A bucket is sorted and buffered as one group, payload included, so it stays
    small; 16^5 bucket counts are the most that is broadcast.
    """
    digits = 2
    while digits < MAX_DIGITS and rows > rows_per_bucket * 16 ** digits:
        digits += 1
    return digits


def hashed_position(df: DataFrame, key: str | Sequence[str], seed: int | Column = DEFAULT_SEED,
                    pos: str = "pos", total: str | None = None, by: Sequence[str] = (),
                    bucket_hex: int | None = None, by_values: int = 1, partitions: int | None = None,
                    align: int = 1, keep_part: bool = False, part_bytes: int | None = None,
                    weight: Column | None = None) -> DataFrame:
    """Add ``pos``: the 0-based rank of each row by ``md5(seed:key)``, ties broken by key.

    ``total`` names a column for the row count. ``by`` ranks each group of those
    columns (at most ``by_values`` distinct combinations) on its own. ``key`` must
    be unique; a repeated key raises while the ranks are computed.

    ``bucket_hex`` defaults to what the row count asks for (one count, from footers
    for Parquet); give it where counting ``df`` is expensive.

    ``partitions`` lays the rows out in that many partitions of consecutive
    positions, each starting at a multiple of ``align``: written out they are in
    order, and runs of ``align`` rows never straddle two of them. ``part_bytes``
    sets as many partitions as it takes for each to hold about that many bytes of
    its rows, and at least one for each core (``weight`` gives a row's bytes; by default they are estimated from
    all columns). Either way a row goes straight to its one partition.
    ``keep_part`` keeps the partition number as column ``_part``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    by = list(by)
    if bucket_hex is None:
        bucket_hex = bucket_digits(df.select(*keys).count() // by_values)
        while partitions and bucket_hex < MAX_DIGITS and 16 ** bucket_hex < 4 * partitions:
            bucket_hex += 1
    buckets = 16 ** bucket_hex
    hashed = df.withColumn("_hash", hash_hex(seed, *[F.col(k) for k in keys]))
    hashed = hashed.withColumn(BUCKET, hex_number(F.col("_hash"), 1, bucket_hex).cast("int"))

    laid_out = bool(partitions or part_bytes)
    if laid_out and by:
        raise ValueError("partitions need a single ranking")
    weights = [F.sum(row_bytes(df) if weight is None else weight).alias("_bytes")] if part_bytes and not partitions else []
    counts = hashed.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("_n"), *weights)
    up_to = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select(
        *by, BUCKET, "_n", *["_bytes" for _ in weights],
        (F.sum("_n").over(up_to) - F.col("_n")).alias("_start"),
        *[(F.sum("_bytes").over(up_to) - F.col("_bytes")).alias("_bytes_before") for _ in weights],
        F.sum("_n").over(Window.partitionBy(*by)).alias("_total"),
    )

    if laid_out:
        starts = settled(starts)
        starts, number = _with_cuts(hashed.select(BUCKET, "_hash", *keys), keys, starts, _borders(starts, align, partitions, part_bytes, df.sparkSession.sparkContext.defaultParallelism))
        # a bucket on a border is cut at the hash of the border's row, so each of its rows has one partition
        routed = hashed.join(F.broadcast(starts), BUCKET)
        routed = routed.withColumn("_passed", F.filter("_cuts", lambda cut: cut["hash"] <= F.col("_hash")))
        routed = routed.withColumn("_part", (F.col("_parts_before") + F.size("_passed")).cast("int"))
        routed = routed.withColumn("_start", F.coalesce(F.try_element_at("_passed", F.lit(-1))["pos"], F.col("_start")))
        routed = routed.drop("_passed", "_cuts", "_parts_before", "_n", "_bytes", "_bytes_before")
        ranked = _ranked(routed.repartitionById(number, "_part"), ["_part", BUCKET], keys)
        placed = ranked.withColumn(pos, F.col("_start") + F.col("_rank") - 1)
    else:
        # At most 16^bucket_hex rows per group of ``by``.
        if buckets * by_values <= 16 ** MAX_DIGITS:
            starts = F.broadcast(starts)
        # Ranked before the starts are joined, so that nothing is shuffled but the rows themselves.
        ranked = _ranked(hashed, [*by, BUCKET], keys)
        placed = ranked.join(starts, [*by, BUCKET])
        placed = placed.withColumn(pos, F.col("_start") + F.col("_rank") - 1)
    kept = [c for c in df.columns if c not in (pos, total)]
    return placed.select(
        *kept, pos, *([F.col("_total").alias(total)] if total else []), *(["_part"] if laid_out and keep_part else [])
    )


def _borders(starts: DataFrame, align: int, partitions: int | None, part_bytes: int | None, cores: int) -> DataFrame:
    """``_pos``: first positions of all partitions but the first one, multiples of ``align``.

    By number, partitions have equally many rows; by bytes, a border lies where the running total of the buckets' bytes
    passes a multiple of ``part_bytes``, placed inside the bucket in proportion; small tables are cut finer, so that there
    is a partition for every core.
    """
    if partitions:
        span = int_div(int_div(F.col("_total") + (align - 1), align) + (partitions - 1), partitions) * align
        last = int_div(F.col("_start") + F.col("_n") - 1, span)
        inside = F.sequence(int_div(F.col("_start") + span - 1, span), last)
        found = starts.where(last * span >= F.col("_start")).select("_total", F.explode(inside).alias("_i"), span.alias("_span"))
        found = found.select("_total", (F.col("_i") * F.col("_span")).alias("_pos"))
    else:
        every = F.greatest(F.lit(1), F.least(F.lit(part_bytes), int_div(F.sum("_bytes").over(Window.partitionBy()), cores))).cast("bigint")
        measured = starts.withColumn("_every", every)
        first, last = int_div("_bytes_before", F.col("_every")) + 1, int_div(F.col("_bytes_before") + F.col("_bytes"), F.col("_every"))
        found = measured.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("_i"))
        share = (F.col("_i") * F.col("_every") - F.col("_bytes_before")) / F.col("_bytes")
        found = found.select("_total", (F.round((F.col("_start") + share * F.col("_n")) / align).cast("bigint") * align).alias("_pos"))
    return found.where((F.col("_pos") > 0) & (F.col("_pos") < F.col("_total"))).select("_pos").distinct()


def _with_cuts(hashes: DataFrame, keys: list[str], starts: DataFrame, borders: DataFrame) -> tuple[DataFrame, int]:
    """Add to each bucket how many partitions begin before it and where inside it others begin; and the partitions' number.

    The row at a border inside a bucket is looked up in a tree of hash digits: only buckets with a border are counted by
    their next digits, and so on, until few rows are left to be ranked. Keys alone are read for that.
    """
    at = starts.select(F.col("_start").alias("_pos"), BUCKET, F.lit(0).alias("_kind")).union(
        borders.select("_pos", F.lit(None).cast("int"), F.lit(1)))
    upward = Window.orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    # borders and buckets are both counted in advance: at most 16^5 buckets, one border per partition
    held = at.withColumn(BUCKET, F.last(BUCKET, True).over(upward)).where("_kind = 1").select("_pos", BUCKET)
    held = held.join(F.broadcast(starts), BUCKET).select(BUCKET, "_pos", (F.col("_pos") - F.col("_start")).alias("_left"), "_n", F.lit("").alias("_prefix"))
    count, most = held.agg(F.count(F.lit(1)), F.max(F.when(F.col("_left") > 0, F.col("_n")))).first()
    open_, digits = held.where("_left > 0"), 0

    def sent(nodes: DataFrame) -> DataFrame:
        return F.broadcast(nodes) if count <= BROADCAST_ROWS else nodes

    while digits < 32 and most and most > RANKED_ROWS:
        digits += 6
        nodes = hashes.join(sent(open_), BUCKET).where(F.col("_hash").startswith(F.col("_prefix")))
        nodes = nodes.groupBy(BUCKET, "_pos", "_left", F.substring("_hash", 1, digits).alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
        so_far = Window.partitionBy(BUCKET, "_pos").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
        nodes = nodes.withColumn("_before", F.sum("_n").over(so_far) - F.col("_n"))
        open_ = settled(nodes.where("_before <= _left and _left < _before + _n").select(
            BUCKET, "_pos", (F.col("_left") - F.col("_before")).alias("_left"), "_n", "_prefix"))
        most = open_.agg(F.max("_n")).first()[0]
    few = hashes.join(sent(open_), BUCKET).where(F.col("_hash").startswith(F.col("_prefix")))
    place = F.row_number().over(Window.partitionBy(BUCKET, "_pos").orderBy("_hash", *keys)) - 1
    inner = few.withColumn("_place", place).where("_place = _left").select(BUCKET, "_pos", "_hash")
    cuts = settled(held.where("_left = 0").select(BUCKET, "_pos", F.lit("").alias("_hash")).union(inner).groupBy(BUCKET).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_pos").alias("pos"), F.col("_hash").alias("hash")))).alias("_cuts")))
    joined = starts.join(F.broadcast(cuts), BUCKET, "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)))
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("_parts_before", F.coalesce(F.sum(F.size("_cuts")).over(before), F.lit(0))), count + 1


def _ranked(hashed: DataFrame, inside: list[str], keys: list[str]) -> DataFrame:
    """Add ``_rank`` (from 1) by hash inside each group; a repeated key raises."""
    order = Window.partitionBy(*inside).orderBy("_hash", *keys)
    repeated = F.lit(True)
    for k in keys:
        repeated = repeated & F.col(k).eqNullSafe(F.lag(k).over(order))
    problem = F.raise_error(F.concat_ws(" ", F.lit("key is not unique:"), *[F.col(k).cast("string") for k in keys]))
    # the row before the first one is no NULL key
    repeated = repeated & (F.row_number().over(order) > 1)
    return hashed.withColumn("_rank", F.when(repeated, problem.cast("int")).otherwise(F.row_number().over(order)))


def ordered_position(df: DataFrame, order: Sequence[str], pos: str = "pos",
                     total: str | None = None) -> DataFrame:
    """Add ``pos``: the 0-based rank of each row in the natural order of ``order``.

    The sorted rows are checkpointed once (keep ``df`` narrow and join wide columns
    back by key); partition totals - one row per shuffle partition - turn the row
    number inside a partition into a position.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    slot = "_slot"
    laid_out = df.orderBy(*order).withColumn(slot, F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright(F.col(slot), 33).cast("int")
    offset = F.col(slot).bitwiseAND(F.lit((1 << 33) - 1))
    laid_out = laid_out.withColumn("_part", part).withColumn("_offset", offset)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid_out.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    placed = laid_out.join(broadcast_if_small(starts), "_part")
    columns = [*df.columns, (F.col("_start") + F.col("_offset")).alias(pos)]
    return placed.select(*columns, *([F.col("_total").alias(total)] if total else []))


# Rows of one block of a running value, about.
BLOCK_ROWS = 1 << 20
_RUNNING = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, tuple[str, str]],
            block: int = BLOCK_ROWS, inclusive: bool = True) -> DataFrame:
    """Running values of ``columns = {output: (input, 'sum'|'max'|'min')}`` per ``keys``.

    ``order`` may be of any sorted type and as sparse as it likes; it is unique per
    group, a repeated one raises. A table of more than ``block`` rows is dealt by
    sampled ranges of (keys, order) to blocks of about that many rows, kept in the
    checkpoint folder. Each block is scanned on its own and starts from the carried
    value of the group's blocks before it; only a block's first group has one, so
    there are no more carried rows than blocks, and no task holds a whole group.
    """
    keys = list(keys)
    rows = df.withColumns({out: F.col(source) for out, (source, _) in columns.items()})
    blocks = -(-df.count() // block)
    if blocks > 1:
        rows = kept(rows.repartitionByRange(blocks, *keys, order).withColumn("_block", F.spark_partition_id()), "blocks")
    else:
        rows = rows.withColumn("_block", F.lit(0))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    repeated = (F.row_number().over(inside) > 1) & F.col(order).eqNullSafe(F.lag(order).over(inside))
    problem = F.raise_error(F.concat_ws(" ", F.lit("order is not unique:"), F.col(order).cast("string")))
    scanned = rows.withColumns({
        "_checked": F.when(repeated, problem.cast("int")),
        **{out: _RUNNING[how](out).over(frame) for out, (_, how) in columns.items()},
    }).where("_checked is null")
    if blocks <= 1:
        return scanned.drop("_block", "_checked")
    totals = rows.groupBy(*keys, "_block").agg(*[_RUNNING[how](out).alias(out) for out, (_, how) in columns.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(c).alias(f"_on_{c}") for c in [*keys, "_block"]], F.count(F.lit(1)).over(earlier).alias("_earlier"),
        *[_RUNNING[how](out).over(earlier).alias(f"_carried_{out}") for out, (_, how) in columns.items()],
    ).where("_earlier > 0")
    match = F.lit(True)
    for c in [*keys, "_block"]:
        match = match & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    # at most one carried row per block
    joined = scanned.join(F.broadcast(carried), match, "left")

    def combined(out: str, how: str) -> Column:
        own, before = F.col(out), F.col(f"_carried_{out}")
        both = {"sum": own + before, "max": F.greatest(own, before), "min": F.least(own, before)}[how]
        return F.coalesce(both, own, before)

    return joined.withColumns({out: combined(out, how) for out, (_, how) in columns.items()}).select(
        *df.columns, *[out for out in columns if out not in df.columns])


def dense_index(df: DataFrame, keys: Sequence[str], order: str, out: str = "idx", start: int = 0,
                block: int = BLOCK_ROWS) -> DataFrame:
    """Number the rows of each group ``start, start+1, …`` in ``order``."""
    counted = running(df.withColumn("_one", F.lit(1)), keys, order, {out: ("_one", "sum")}, block)
    return counted.withColumn(out, F.col(out) - 1 + start).drop("_one")


def order_image(value: Column, kind: DataType = DoubleType()) -> Column:
    """A 64-bit whole number that rises with the value: whole numbers themselves, of others the bits as a double.

    A double's bits are its sign, exponent and mantissa as stored; both zeros are one, NaN is above infinity.
    """
    if isinstance(kind, IntegralType):
        return value.cast("bigint")
    value = value.cast("double") + F.lit(0.0)
    size = F.abs(value)
    tiny, endless = size < F.lit(2.0 ** -1022), F.isnan(value) | (size == F.lit(float("inf")))
    plain = F.when(tiny | endless, F.lit(1.0)).otherwise(size)
    # a logarithm may round to the next whole number; powers of two are exact
    rough = F.floor(F.log2(plain))
    power = F.pow(F.lit(2.0), rough)
    exponent = F.when(power > plain, rough - 1).when(plain / power >= 2, rough + 1).otherwise(rough)
    mantissa = ((plain / F.pow(F.lit(2.0), exponent) - 1) * F.lit(2.0 ** 52)).cast("bigint")
    bits = (
        F.when(F.isnan(value), F.lit((2047 << 52) + 1))
        .when(endless, F.lit(2047 << 52))
        .when(tiny, (F.when(tiny, size).otherwise(F.lit(0.0)) * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("bigint"))
        .otherwise((exponent + 1023) * F.lit(1 << 52) + mantissa)
    )
    return F.when(value < 0, -bits).otherwise(bits)


def order_statistics(df: DataFrame, keys: Sequence[str], value: str,
                     ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact elements of the sorted ``value`` list of each group.

    ``ranks`` maps an output column to a function from the group's row count to a
    0-based rank. A radix selection on the 64-bit image of the values, 16 bits a
    pass: a histogram over the next digits finds the prefix of each rank, and only
    rows with such a prefix are counted in the next pass. It ends when the prefixes
    hold few rows each; of these equal values are counted before they are sorted.
    NULL values are ignored.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).alias("_v")).where("_v is not null")
    data = data.withColumn("_image", order_image(F.col("_v"), df.schema[value].dataType))
    hits, shift = None, 64
    while shift and (hits is None or (hits.agg(F.max("_n")).first()[0] or 0) > RANKED_ROWS):
        shift -= DIGIT_BITS
        rows = data if hits is None else _with_prefix(data, hits, keys, shift + DIGIT_BITS, [])
        # one more group column than the last pass had: at most 2^16 digits below a prefix
        within = [*keys, F.shiftright("_image", shift + DIGIT_BITS).alias("_above")] if hits is not None else keys
        counted = rows.groupBy(*within, F.shiftright("_image", shift).alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
        group = [*keys, "_above"] if hits is not None else keys
        so_far = Window.partitionBy(*group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
        histogram = counted.withColumn("_to", F.sum("_n").over(so_far)).withColumn("_from", F.col("_to") - F.col("_n"))
        if hits is None:
            count = F.sum("_n").over(Window.partitionBy(*keys))
            wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_count")).cast("bigint").alias("rank")) for name, rank in ranks.items()])
            histogram = histogram.withColumn("_count", count).withColumn("_want", wanted)
        else:
            last = hits.select(*[F.col(k).alias(f"_last_{k}") for k in keys], F.col("_prefix").alias("_last"), "_want")
            match = F.col("_above") == F.col("_last")
            for k in keys:
                match = match & F.col(k).eqNullSafe(F.col(f"_last_{k}"))
            histogram = histogram.join(broadcast_if_small(last), match)
        inside = F.filter("_want", lambda w: (w["rank"] >= F.col("_from")) & (w["rank"] < F.col("_to")))
        hits = settled(histogram.withColumn("_want", inside).where(F.size("_want") > 0).select(
            *keys, "_prefix", "_n", F.transform("_want", lambda w: F.struct(w["name"].alias("name"), (w["rank"] - F.col("_from")).alias("rank"))).alias("_want")))
    close = _with_prefix(data, hits, keys, shift, ["_want"])
    by_value = Window.partitionBy(*keys, "_prefix").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        close.groupBy(*keys, "_prefix", "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_want").alias("_want"))
        .withColumn("_to", F.sum("_n").over(by_value))
        .withColumn("_from", F.col("_to") - F.col("_n"))
        .select(*keys, "_v", "_from", "_to", F.explode("_want").alias("_want"))
        .where("_want.rank >= _from and _want.rank < _to")
    )
    return counted.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_want.name") == name, F.col("_v"))).alias(name) for name in ranks]
    )


def _with_prefix(data: DataFrame, hits: DataFrame, keys: list[str], shift: int, columns: list[str]) -> DataFrame:
    """The rows of each group whose image begins with a prefix of ``hits``, one row per group and rank at most."""
    hits = hits.select(*[F.col(k).alias(f"_hit_{k}") for k in keys], "_prefix", *columns)
    match = F.shiftright("_image", shift) == hits["_prefix"]
    for k in keys:
        match = match & data[k].eqNullSafe(hits[f"_hit_{k}"])
    return data.join(broadcast_if_small(hits), match).select(*data.columns, "_prefix", *columns)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str = "percentile") -> DataFrame:
    """The element at ``round_half_even((n-1)*p)`` of the sorted values of each group."""
    keys = list(keys)
    found = order_statistics(df, keys, value, {out: lambda n: F.bround((n - 1) * F.lit(float(p)), 0)})
    groups = df.groupBy(*keys).agg(F.count(value).alias("n"))
    joined = groups.join(found, same_keys(groups, found, keys), "left")
    return joined.select(*[groups[k] for k in keys], "n", F.coalesce(out, F.lit(0.0)).alias(out))


def medians(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median of each group: the mean of the two middle elements."""
    found = order_statistics(df, keys, value, {
        "_low": lambda n: int_div(n - 1, 2),
        "_high": lambda n: int_div(n, 2),
    })
    return found.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(out))


__all__ = [
    "bucket_digits", "dense_index", "hashed_position", "medians", "nearest_rank",
    "order_image", "order_statistics", "ordered_position", "running",
]
