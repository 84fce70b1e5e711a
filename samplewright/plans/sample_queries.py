"""Queries over samples: scans, lookups, labels, shuffles, batches, collation, images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions import columns as C
from samplewright.operators import images, lookup, sampler
from samplewright.operators.rank import hashed_position
from samplewright.plans.epoch import EpochPlan
from samplewright.plans.registry import positions_sql, query, table
from samplewright.sinks.shards import shard_manifest as manifest_of
from samplewright.sinks.tables import keyed_records as keyed
from samplewright.sinks.tables import storage_overhead as overhead_of
from samplewright.sources import tables as sources

ORDERS = positions_sql("orders", "o_orderkey", 42, "o_orderkey")
VECTORS = positions_sql("embeddings", "vec_id")


def _docs(spark, sf_dir) -> DataFrame:
    """Documents with their storage position."""
    return sources.with_sample_idx(table(spark, sf_dir, "documents"))


# --- scans and index fetches --------------------------------------------------

@query("""
    SELECT doc_id AS sample_idx, doc_id, lang AS label, strlen(text) AS n_bytes
    FROM documents WHERE doc_id < (SELECT count(*) // 2 FROM documents)
""")
def scan_prefix(spark, sf_dir):
    """The first half of the table in storage order."""
    half = table(spark, sf_dir, "documents").count() // 2
    return sources.read_parquet_table(spark, f"{sf_dir}/documents.parquet", max_samples=half).select(
        "sample_idx", "doc_id", F.col("lang").alias("label"), F.octet_length("text").alias("n_bytes")
    )


@query("""
    SELECT o_orderkey, d.doc_id AS sample_idx, d.lang AS label, d.n_chars
    FROM orders JOIN documents d ON d.doc_id = o_orderkey % (SELECT count(*) FROM documents)
""")
def fetch_by_index(spark, sf_dir):
    count = table(spark, sf_dir, "documents").count()
    wanted = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % count).alias("sample_idx"))
    found = sources.fetch_rows(spark, f"{sf_dir}/documents.parquet", wanted, columns=["lang", "n_chars"])
    return found.withColumnRenamed("lang", "label")


@query("""
    WITH n AS (SELECT count(*) AS n FROM documents),
    draws AS (
        SELECT i AS draw, ('0x' || substr(md5('42:' || i::VARCHAR), 1, 15))::BIGINT % (SELECT n FROM n) AS sample_idx
        FROM (SELECT unnest(range((SELECT n FROM n))) AS i)
    )
    SELECT draw, sample_idx, lang AS label FROM draws JOIN documents ON doc_id = sample_idx
""")
def random_index_sample(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    n = docs.count()
    return lookup.fetch_by_index(docs.select("sample_idx", F.col("lang").alias("label")), sources.random_indices(spark, n, n))


@query("""
    SELECT i AS op, doc_id AS sample_idx, lang AS label
    FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS i)
    JOIN documents ON doc_id = i % (SELECT count(*) FROM documents)
""")
def cyclic_reuse(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    ops = sources.cyclic_indices(spark, table(spark, sf_dir, "orders").count(), docs.count())
    return lookup.fetch_by_index(docs.select("sample_idx", F.col("lang").alias("label")), ops)


# --- shards, storage, keyed records -------------------------------------------

@query("""
    SELECT doc_id, doc_id // 100 AS shard_id, doc_id % 100 AS local_idx,
        (sum(strlen(text)) OVER w - strlen(text))::BIGINT AS "start", (sum(strlen(text)) OVER w)::BIGINT AS "end"
    FROM documents WINDOW w AS (PARTITION BY doc_id // 100 ORDER BY doc_id)
""")
def shard_manifest(spark, sf_dir):
    return manifest_of(table(spark, sf_dir, "documents"), "doc_id", "text", 100)


@query("""
    WITH counts AS (SELECT substr(source, 4)::INT AS shard_id, count(*) AS n FROM documents GROUP BY 1),
    ranges AS (SELECT shard_id, n, sum(n) OVER (ORDER BY shard_id) AS end_idx FROM counts),
    asked AS (SELECT o_orderkey, o_orderkey % (SELECT count(*) FROM documents) AS sample_idx FROM orders)
    SELECT o_orderkey, sample_idx, shard_id, (sample_idx - (end_idx - n))::BIGINT AS local_idx
    FROM asked JOIN ranges ON sample_idx >= end_idx - n AND sample_idx < end_idx
""")
def shard_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = docs.groupBy(F.substring("source", 4, 10).cast("int").alias("shard_id")).agg(F.count(F.lit(1)).alias("n"))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % docs.count()).alias("sample_idx"))
    return lookup.locate_shard(asked, counts)


@query("""
    SELECT source AS container, round(sum(strlen(text)) / 1048576.0, 9) AS container_mb,
        round(sum(n_chars) / 1048576.0, 9) AS raw_mb,
        round((sum(strlen(text))::DOUBLE / sum(n_chars) - 1) * 100, 9) AS overhead_pct
    FROM documents GROUP BY source
""")
def storage_overhead(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "container")
    out = overhead_of(docs.select("container", F.octet_length("text").alias("length")),
                      docs.select("container", F.col("n_chars").alias("length")))
    return out.select("container", *[F.round(c, 9).alias(c) for c in ("container_mb", "raw_mb", "overhead_pct")])


@query("SELECT doc_id::VARCHAR AS key, text AS image, lang AS label FROM documents")
def keyed_records(spark, sf_dir):
    return keyed(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


# --- labels, names, filters ---------------------------------------------------

@query("""
    SELECT doc_id, doc_id AS class_no, TRY_CAST(replace(lang, 'n', '') AS BIGINT) AS bad_class FROM documents
""")
def label_parse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("n"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return docs.select("doc_id", C.parse_label(name).alias("class_no"), C.parse_label("lang", "null").alias("bad_class"))


@query("""
    SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS class_idx FROM documents
""")
def class_index(spark, sf_dir):
    return lookup.class_index(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")


@query("""
    SELECT page_id, list_extract(string_split(url, '/'), -2) AS parent, string_split(url, '/')[1] AS first_part,
        list_extract(string_split(url, '/'), -1) AS file, regexp_matches(url, '\\.(html|htm)$') AS is_match
    FROM pages
""")
def label_from_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", C.label_from_path("url").alias("parent"), C.label_from_path("url", "first").alias("first_part"),
        C.file_name("url").alias("file"), C.has_extension("url", ("html", "htm")).alias("is_match"),
    )


PART_NAMES = (("old ring", "OLD"), ("Ring", "RING"), ("red  bolt", "RB"), ("bolt", "BOLT"), ("red", "RED"), ("small ring", "SR"))


@query(f"""
    WITH m(ord, raw, clean) AS (VALUES {', '.join(f"({i}, '{r}', '{c}')" for i, (r, c) in enumerate(PART_NAMES))})
    SELECT p_partkey, p_name, coalesce(
        (SELECT clean FROM m WHERE raw = p_name),
        (SELECT arg_min(clean, ord) FROM m
         WHERE contains(replace(lower(p_name), ' ', ''), replace(lower(raw), ' ', ''))),
        replace(p_name, ' ', '_')) AS clean_name
    FROM part
""")
def device_normalise(spark, sf_dir):
    return lookup.normalise_names(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", PART_NAMES)


@query("""
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'
""")
def config_filter(spark, sf_dir):
    """Rows of one configuration; both conditions reach the scan."""
    runs = table(spark, sf_dir, "orders")
    return runs.where("o_orderstatus = 'F' and o_orderpriority = '5-LOW'").select("o_orderkey", "o_totalprice")


@query("""
    WITH f AS (
        SELECT event_id, 'summary_' || event_type || '_v' || (user_id % 3)::VARCHAR || '_bs' || (user_id + 1)::VARCHAR
            || CASE WHEN event_id % 2 = 0 THEN '_sgd_' ELSE '_adam_' END || 'NVIDIA_A' || (user_id % 7)::VARCHAR
            || '_20240101_' || lpad((event_id % 1000000)::VARCHAR, 6, '0') || '.csv' AS file_name FROM events
    ), p AS (SELECT *, '^(?:calib_)?summary_(.+?)_bs(\\d+)(?:_nb\\d+)?_(adam|sgd)_(.+)_(\\d{8}_\\d{6})\\.csv$' AS re FROM f)
    SELECT event_id, regexp_extract(file_name, re, 1) AS model, regexp_extract(file_name, re, 2)::INT AS batch_size,
        regexp_extract(file_name, re, 3) AS optimizer, regexp_extract(file_name, re, 4) AS gpu,
        regexp_extract(file_name, re, 5) AS ts
    FROM p
""")
def run_name_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    user = F.col("user_id")
    text = F.concat(
        F.lit("summary_"), "event_type", F.lit("_v"), (user % 3).cast("string"), F.lit("_bs"), (user + 1).cast("string"),
        F.when(F.col("event_id") % 2 == 0, "_sgd_").otherwise("_adam_"), F.lit("NVIDIA_A"), (user % 7).cast("string"),
        F.lit("_20240101_"), F.lpad((F.col("event_id") % 1_000_000).cast("string"), 6, "0"), F.lit(".csv"),
    )
    named = e.select("event_id", text.alias("file_name"))
    return named.select("event_id", *[C.parse_run_name("file_name", f).alias(f) for f in ("model", "batch_size", "optimizer", "gpu", "ts")])


# --- tensors as arrays ---------------------------------------------------------

@query("""
    SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim,
        round(unnest(embedding)::DOUBLE / 255.0, 12) AS value FROM embeddings
""")
def scale_255(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(C.scale_255("embedding")).alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 12).alias("value")
    )


@query("""
    WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT vec_id, dim, round((x - [0.485, 0.456, 0.406][dim // 22 + 1]) / [0.229, 0.224, 0.225][dim // 22 + 1], 9) AS value
    FROM x
""")
def channel_normalise(spark, sf_dir):
    """Planes of 22, 22 and 20 values of a 64-value vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(C.channel_normalise("embedding", 22)).alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 9).alias("value")
    )


# --- shuffles, partitions, batches ---------------------------------------------

@query(f"SELECT o_orderkey, pos FROM ({ORDERS})")
def shuffle_epoch(spark, sf_dir):
    return sampler.shuffle(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "pos")


@query(" UNION ALL ".join(
    f"SELECT {e} AS epoch, o_orderkey, pos FROM ({positions_sql('orders', 'o_orderkey', s, 'o_orderkey')})"
    for e, s in enumerate((42, 43, 44))
))
def shuffle_multi_epoch(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    return sampler.shuffle_epochs(keys, "o_orderkey", (42, 43, 44)).select("epoch", "o_orderkey", "pos")


@query("""
    WITH l AS (SELECT row_number() OVER () - 1 AS sample_idx, l_orderkey, l_linenumber FROM lineitem)
    SELECT sample_idx, l_orderkey, l_linenumber,
        row_number() OVER (ORDER BY md5('7:' || sample_idx::VARCHAR), sample_idx) - 1 AS pos FROM l
""")
def shuffle_by_row(spark, sf_dir):
    """A table without a unique key, shuffled by storage position."""
    rows = sources.with_sample_idx(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))
    return hashed_position(rows, "sample_idx", 7)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def shuffle_off(spark, sf_dir):
    return sampler.shuffle(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", enabled=False).select("o_orderkey", "pos")


def _orders(spark, sf_dir) -> DataFrame:
    return sampler.shuffle(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(f"SELECT o_orderkey, pos, least(pos // (n // 7), 6)::INT AS worker_id FROM ({ORDERS})")
def worker_contiguous(spark, sf_dir):
    return sampler.assign_workers(_orders(spark, sf_dir), 7).drop(sampler.TOTAL)


@query(f"SELECT o_orderkey, pos, (pos % 7)::INT AS worker_id FROM ({ORDERS})")
def worker_strided(spark, sf_dir):
    return sampler.assign_workers(_orders(spark, sf_dir), 7, mode="strided").drop(sampler.TOTAL)


@query(f"""
    SELECT o_orderkey, pos, pos // 256 AS chunk_id, least(pos // (n // 7), 6)::INT AS worker_id,
        (pos - least(pos // (n // 7), 6) * (n // 7)) // 32 AS staging_chunk FROM ({ORDERS})
""")
def chunks(spark, sf_dir):
    placed = sampler.assign_chunks(_orders(spark, sf_dir), 256)
    placed = sampler.assign_workers(placed, 7)
    return sampler.assign_chunks(placed, 32, n_workers=7, out="staging_chunk").drop(sampler.TOTAL)


@query(f"""
    WITH o AS ({positions_sql('orders', 'o_orderkey', 6, 'o_orderkey')}),
    slots AS (SELECT unnest(range((n + 6) // 7 * 7)) AS slot FROM (SELECT DISTINCT n FROM o))
    SELECT o_orderkey, (slot % 7)::INT AS rank, slot // 7 AS local_idx FROM slots JOIN o ON slot % n = pos
""")
def replica_shard(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    return sampler.replica_shards(keys, "o_orderkey", 7, seed=5, epoch=1).select("o_orderkey", "rank", "local_idx")


@query(f"""
    SELECT o_orderkey, pos // 256 AS batch_id, (pos % 256)::INT AS slot FROM ({ORDERS}) WHERE pos // 256 < n // 256
""")
def batches_drop_last(spark, sf_dir):
    return sampler.assign_batches(_orders(spark, sf_dir), 256).select("o_orderkey", "batch_id", "slot")


@query(f"SELECT o_orderkey, pos // 256 AS batch_id, (pos % 256)::INT AS slot FROM ({ORDERS})")
def batches_keep_last(spark, sf_dir):
    return sampler.assign_batches(_orders(spark, sf_dir), 256, drop_last=False).select("o_orderkey", "batch_id", "slot")


@query(f"""
    WITH w AS (SELECT *, least(pos // (n // 7), 6) AS worker FROM ({ORDERS})),
    c AS (SELECT *, pos - worker * (n // 7) AS inside FROM w),
    a AS (SELECT *, row_number() OVER (ORDER BY inside // 32, worker, inside) - 1 AS arrival FROM c)
    SELECT o_orderkey, arrival // 256 AS batch_id, (arrival % 256)::INT AS slot FROM a WHERE arrival // 256 < n // 256
""")
def batches_interleaved(spark, sf_dir):
    placed = sampler.assign_batches(_orders(spark, sf_dir), 256, order="interleaved", n_workers=7, chunk=32)
    return placed.select("o_orderkey", "batch_id", "slot")


# --- collation -------------------------------------------------------------------

@query(f"""
    SELECT pos // 32 AS batch_id, count(*)::INT AS size, string_agg(label::VARCHAR, ',' ORDER BY pos) AS labels
    FROM ({VECTORS}) WHERE pos // 32 < n // 32 GROUP BY 1
""")
def collate_labels(spark, sf_dir):
    """Flagship: shuffle, batch, gather the labels."""
    batches = EpochPlan("vec_id", 32).collated(table(spark, sf_dir, "embeddings"), None, "label")
    return batches.select("batch_id", "size", F.concat_ws(",", F.col("labels").cast("array<string>")).alias("labels"))


def _pixels(batches: DataFrame) -> DataFrame:
    rows = batches.select("batch_id", F.posexplode(F.arrays_zip("images", "labels")).alias("slot", "_s"))
    return rows.select("batch_id", "slot", F.col("_s.labels").alias("label"), F.posexplode("_s.images").alias("dim", "value"))


_PIXELS_SQL = f"""
    WITH x AS (SELECT pos // 64 AS batch_id, (pos % 64)::INT AS slot, label,
        (generate_subscripts(embedding, 1) - 1)::INT AS dim, unnest(embedding)::DOUBLE AS x FROM ({VECTORS}))
    SELECT batch_id, slot, label, dim, round(VALUE, 12) AS value FROM x
"""


@query(_PIXELS_SQL.replace("VALUE", "x / 255.0"))
def collate_tensors(spark, sf_dir):
    plan = EpochPlan("vec_id", 64, drop_last=False)
    pixels = _pixels(plan.collated(table(spark, sf_dir, "embeddings"), "embedding", "label"))
    return pixels.withColumn("value", F.round("value", 12))


@query(_PIXELS_SQL.replace("round(VALUE, 12)", "(x / 255.0)::FLOAT"))
def collate_float32(spark, sf_dir):
    """Batches of single precision, as a training step takes them."""
    plan = EpochPlan("vec_id", 64, drop_last=False)
    return _pixels(plan.collated(table(spark, sf_dir, "embeddings"), "embedding", "label", dtype="float"))


@query(_PIXELS_SQL.replace("VALUE", "x"))
def collate_raw(spark, sf_dir):
    plan = EpochPlan("vec_id", 64, drop_last=False)
    pixels = _pixels(plan.collated(table(spark, sf_dir, "embeddings"), "embedding", "label", scale=False))
    return pixels.withColumn("value", F.round(F.col("value").cast("double"), 12))


def _first_and_sum(samples: pd.DataFrame) -> pd.DataFrame:
    stacked = np.stack(samples["embedding"].to_numpy()).astype(np.float64)
    return pd.DataFrame({
        "batch_id": samples["batch_id"].iloc[:1], "n": len(samples), "first_label": samples["label"].iloc[0],
        "label_sum": int(samples["label"].sum()), "total": round(float(stacked.sum()), 6),
    })


@query(f"""
    SELECT pos // 50 AS batch_id, count(*) AS n, arg_min(label, pos) AS first_label, sum(label)::BIGINT AS label_sum,
        round(sum(list_sum(embedding::DOUBLE[])), 6) AS total
    FROM ({VECTORS}) WHERE pos // 50 < n // 50 GROUP BY 1
""")
def user_collate(spark, sf_dir):
    schema = "batch_id bigint, n bigint, first_label int, label_sum bigint, total double"
    return EpochPlan("vec_id", 50).collated_with(table(spark, sf_dir, "embeddings"), _first_and_sum, schema)


def _weights() -> np.ndarray:
    return np.arange(1, 65, dtype=np.float64)


def _weighted(samples: pd.DataFrame, weights: np.ndarray) -> pd.DataFrame:
    stacked = np.stack(samples["embedding"].to_numpy()).astype(np.float64)
    return pd.DataFrame({"vec_id": samples["vec_id"], "label": samples["label"] + 1, "score": np.round(stacked @ weights, 6)})


@query("""
    WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT vec_id, label + 1 AS label, round(sum(x * i), 6) AS score FROM x GROUP BY vec_id, label
""")
def user_transform(spark, sf_dir):
    samples = table(spark, sf_dir, "embeddings")
    return images.map_samples(samples, _weighted, "vec_id bigint, label int, score double", setup=_weights)


# --- images ------------------------------------------------------------------------

_AUG_SQL = """
    WITH d AS (SELECT doc_id, 32 + n_chars % 200 AS h, 32 + doc_id % 200 AS w FROM documents),
    a AS (SELECT *, unnest(range(10)) AS i FROM d),
    m AS (SELECT *, md5('42:3:' || doc_id::VARCHAR || ':' || i::VARCHAR) AS t FROM a),
    u AS (SELECT *,
        ('0x' || substr(t, 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u0, ('0x' || substr(t, 9, 8))::BIGINT / 4294967296.0::DOUBLE AS u1,
        ('0x' || substr(t, 17, 8))::BIGINT / 4294967296.0::DOUBLE AS u2, ('0x' || substr(t, 25, 8))::BIGINT / 4294967296.0::DOUBLE AS u3
        FROM m),
    s AS (SELECT *, (h * w) * (0.08::DOUBLE + 0.92::DOUBLE * u0) AS area, exp(ln(0.75::DOUBLE) + (ln(4.0::DOUBLE / 3) - ln(0.75::DOUBLE)) * u1) AS r FROM u),
    b AS (SELECT *, round_even(sqrt(area * r), 0)::BIGINT AS bw, round_even(sqrt(area / r), 0)::BIGINT AS bh FROM s),
    f AS (SELECT doc_id, arg_min(struct_pack(t := floor(u2 * (h - bh + 1))::BIGINT, l := floor(u3 * (w - bw + 1))::BIGINT, h := bh, w := bw), i) AS box
        FROM b WHERE bh > 0 AND bw > 0 AND bh <= h AND bw <= w GROUP BY doc_id),
    c AS (SELECT *,
        CASE WHEN w / h::DOUBLE < 0.75 THEN round_even(w / 0.75::DOUBLE, 0)::BIGINT ELSE h END AS fh,
        CASE WHEN w / h::DOUBLE > 4.0::DOUBLE / 3 THEN round_even(h * (4.0::DOUBLE / 3), 0)::BIGINT ELSE w END AS fw FROM d)
    SELECT c.doc_id, coalesce(box.t, (c.h - fh) // 2) AS crop_top, coalesce(box.l, (c.w - fw) // 2) AS crop_left,
        coalesce(box.h, fh) AS crop_h, coalesce(box.w, fw) AS crop_w,
        ('0x' || substr(md5('42:3:' || c.doc_id::VARCHAR || ':flip'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5 AS flip
    FROM c LEFT JOIN f ON f.doc_id = c.doc_id
"""


@query(_AUG_SQL)
def aug_params(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (32 + F.col("n_chars") % 200).alias("h"), (32 + F.col("doc_id") % 200).alias("w")
    )
    return images.augment_params(docs, "doc_id", "h", "w", seed=42, epoch=3).drop("h", "w")


@query("""
    WITH s AS (SELECT 16 + doc_id % 3 AS width, (strlen(text) // (3 * (16 + doc_id % 3)) + 1)::BIGINT AS height,
        CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END AS channels FROM documents)
    SELECT 'size' AS kind, width, height, NULL::INT AS channels, count(*) AS n FROM s GROUP BY width, height
    UNION ALL SELECT 'mode', NULL, NULL, channels, count(*) FROM s GROUP BY channels
""")
def image_profile(spark, sf_dir):
    """Documents seen as raw pixel rows."""
    docs = table(spark, sf_dir, "documents")
    width = 16 + F.col("doc_id") % 3
    shapes = docs.select(
        width.alias("width"), (C.int_div(F.octet_length("text").cast("bigint"), width * 3) + 1).alias("height"),
        F.when(F.col("doc_id") % 2 == 0, 3).otherwise(1).alias("channels"),
    )
    return images.image_profile(shapes)


def _pixel_images(spark, sf_dir) -> DataFrame:
    """Vectors as 8x8 RGB images: red, green and blue are the values at i, i+1 and i+7."""
    e = table(spark, sf_dir, "embeddings")
    level = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("int"))

    def pixel(i):
        return F.concat(*[F.lpad(F.hex(F.element_at("_level", (i + shift) % 64 + 1)), 2, "0") for shift in (0, 1, 7)])

    packed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), pixel), "")
    return e.withColumn("_level", level).select(
        F.col("vec_id").alias("sample_idx"), "label", F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.lit(3).alias("channels"), F.unhex(packed).alias("image"),
    )


_RAW = {"decoder": images.raw_decoder, "decoder_columns": ("height", "width", "channels", "image")}

_LEVELS_SQL = """
    levels AS (SELECT vec_id AS sample_idx, label, generate_subscripts(embedding, 1) - 1 AS k,
        floor(abs(unnest(embedding)::DOUBLE) * 1000)::BIGINT % 256 AS v FROM embeddings),
    pixels AS (SELECT l.sample_idx, l.label, c.channel, p.i // 8 AS y, p.i % 8 AS x, l.v
        FROM (VALUES (0, 0), (1, 1), (2, 7)) c(channel, shift), (SELECT unnest(range(64)) AS i) p
        JOIN levels l ON l.k = (p.i + c.shift) % 64)
"""


@query(f"""
    WITH {_LEVELS_SQL}
    SELECT sample_idx, label, channel * 16 + (y // 2) * 4 + x // 2 AS dim, floor(sum(v) / 4.0 + 0.5)::SMALLINT AS value
    FROM pixels GROUP BY sample_idx, label, channel, y // 2, x // 2
""")
def decode_resize(spark, sf_dir):
    """Decode and halve every image; the bilinear value is the mean of four pixels."""
    tensors = images.image_tensors(_pixel_images(spark, sf_dir), size=(4, 4), **_RAW)
    values = F.posexplode(images.tensor_values("data")).alias("dim", "value")
    return tensors.select("sample_idx", "label", values).withColumn("dim", F.col("dim").cast("bigint"))


@query(f"""
    WITH {_LEVELS_SQL}
    SELECT sample_idx, label, channel * 64 + y * 8 + x AS dim,
        round(((v::FLOAT / 255::FLOAT - [0.485, 0.456, 0.406][channel + 1]::FLOAT) / [0.229, 0.224, 0.225][channel + 1]::FLOAT)::DOUBLE, 9) AS value
    FROM pixels
""")
def decode_normalise(spark, sf_dir):
    """Decode, scale and normalise per channel."""
    from samplewright.functions.fixed import CHANNEL_MEAN, CHANNEL_STD

    tensors = images.image_tensors(_pixel_images(spark, sf_dir), size=None, scale=True, mean=CHANNEL_MEAN, std=CHANNEL_STD, **_RAW)
    values = F.posexplode(images.tensor_values("data", "float32")).alias("dim", "value")
    return tensors.select("sample_idx", "label", values).select(
        "sample_idx", "label", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value").cast("double"), 9).alias("value")
    )


@query(f"""
    WITH {_LEVELS_SQL}
    SELECT sample_idx, label, channel * 16 + (y - 2) * 4 + x - 2 AS dim, v::SMALLINT AS value
    FROM pixels WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5
""")
def eval_crop(spark, sf_dir):
    """Centre 4x4 of every 8x8 image."""
    tensors = images.eval_crop(_pixel_images(spark, sf_dir), 8, 4, **_RAW)
    values = F.posexplode(images.tensor_values("data")).alias("dim", "value")
    return tensors.select("sample_idx", "label", values).withColumn("dim", F.col("dim").cast("bigint"))


@query(f"""
    WITH {_LEVELS_SQL},
    small AS (SELECT sample_idx, label, channel * 16 + (y // 2) * 4 + x // 2 AS dim, floor(sum(v) / 4.0 + 0.5)::INT AS value
        FROM pixels GROUP BY sample_idx, label, channel, y // 2, x // 2),
    blobs AS (SELECT sample_idx, label, string_agg(printf('%02X', value), '' ORDER BY dim) AS pixels FROM small GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (ORDER BY md5('11:' || sample_idx::VARCHAR), sample_idx) - 1 AS pos, count(*) OVER () AS n FROM blobs)
    SELECT pos // 48 AS batch_id, (pos % 48)::INT AS slot, label, pixels FROM placed WHERE pos // 48 < n // 48
""")
def epoch_images(spark, sf_dir):
    """A whole epoch: shuffle, batch, decode, resize, collate."""
    batches = EpochPlan("sample_idx", 48, seed=11).collated_images(_pixel_images(spark, sf_dir), size=(4, 4), **_RAW)
    rows = batches.select("batch_id", F.posexplode(F.arrays_zip("images", "labels")).alias("slot", "_s"))
    return rows.select("batch_id", "slot", F.col("_s.labels").alias("label"), F.hex("_s.images").alias("pixels"))


def _filter_sql(lengths: str, size: int) -> str:
    """Weights of the triangle filter from every length of ``lengths`` to ``size``: ``length, o, k, weight``."""
    return f"""
        raw AS (SELECT length, o, k, greatest(length / {size}.0::DOUBLE, 1.0::DOUBLE) AS support, (o + 0.5::DOUBLE) * (length / {size}.0::DOUBLE) AS centre
            FROM (SELECT unnest({lengths}) AS length), (SELECT unnest(range({size})) AS o), (SELECT unnest(range(16)) AS k) WHERE k < length),
        near AS (SELECT *, greatest(1 - abs((k - centre + 0.5::DOUBLE) * (1 / support)), 0::DOUBLE) AS t FROM raw
            WHERE k >= trunc(centre - support + 0.5::DOUBLE) AND k < trunc(centre + support + 0.5::DOUBLE)),
        weights AS (SELECT length, o, k, floor(t / sum(t) OVER (PARTITION BY length, o) * 4194304 + 0.5::DOUBLE)::BIGINT AS weight FROM near)"""


@query(f"""
    WITH {_LEVELS_SQL}, {_filter_sql('[8]', 6)},
    wide AS (SELECT sample_idx, label, channel, y, o AS x, (sum(weight * v)::BIGINT + 2097152) // 4194304 AS v
        FROM pixels JOIN weights ON k = x GROUP BY sample_idx, label, channel, y, o),
    small AS (SELECT sample_idx, label, channel, o AS y, x, (sum(weight * v)::BIGINT + 2097152) // 4194304 AS v
        FROM wide JOIN weights ON k = y GROUP BY sample_idx, label, channel, o, x)
    SELECT sample_idx, label, channel * 16 + (y - 1) * 4 + x - 1 AS dim, v::SMALLINT AS value FROM small WHERE y BETWEEN 1 AND 4 AND x BETWEEN 1 AND 4
""")
def eval_crop_shrunk(spark, sf_dir):
    """Every image to 6x6 with an antialiasing filter, then its centre 4x4."""
    tensors = images.eval_crop(_pixel_images(spark, sf_dir), 6, 4, **_RAW)
    values = F.posexplode(images.tensor_values("data")).alias("dim", "value")
    return tensors.select("sample_idx", "label", values).withColumn("dim", F.col("dim").cast("bigint"))


_BOXES_SQL = (_AUG_SQL.replace("'42:3:'", "'42:0:'").replace("doc_id", "vec_id")
              .replace("SELECT vec_id, 32 + n_chars % 200 AS h, 32 + vec_id % 200 AS w FROM documents", "SELECT vec_id, 8 AS h, 8 AS w FROM embeddings"))


def _augment_sql(size: int) -> str:
    return f"""
    WITH {_LEVELS_SQL}, {_filter_sql('range(1, 9)', size)}, boxes AS ({_BOXES_SQL}),
    cut AS (SELECT p.sample_idx, p.label, channel, y - crop_top AS y, x - crop_left AS x, v, crop_h AS h, crop_w AS w, flip
        FROM pixels p JOIN boxes ON vec_id = sample_idx AND y >= crop_top AND y < crop_top + crop_h AND x >= crop_left AND x < crop_left + crop_w),
    wide AS (SELECT sample_idx, label, channel, y, o AS x, h, flip, (sum(weight * v)::BIGINT + 2097152) // 4194304 AS v
        FROM cut JOIN weights ON length = w AND k = x GROUP BY sample_idx, label, channel, y, o, h, flip),
    small AS (SELECT sample_idx, label, channel, o AS y, CASE WHEN flip THEN {size - 1} - x ELSE x END AS x, (sum(weight * v)::BIGINT + 2097152) // 4194304 AS v
        FROM wide JOIN weights ON length = h AND k = y GROUP BY sample_idx, label, channel, o, x, flip)
    SELECT sample_idx, label, string_agg(printf('%02X', v), '' ORDER BY channel, y, x) AS pixels FROM small GROUP BY sample_idx, label
    """


def _augmented(spark, sf_dir, size: int) -> DataFrame:
    boxed = images.augment_params(_pixel_images(spark, sf_dir), "sample_idx", "height", "width", seed=42, epoch=0)
    tensors = images.augment(boxed, (size, size), **_RAW)
    return tensors.select("sample_idx", "label", F.hex("data").alias("pixels"))


@query(_augment_sql(8))
def augment_pixels(spark, sf_dir):
    """Random crop and mirror of every image."""
    return _augmented(spark, sf_dir, 8)


@query(_augment_sql(5))
def augment_pixels_shrunk(spark, sf_dir):
    """The same, to a size that some crops are shrunk to with an antialiasing filter and some enlarged."""
    return _augmented(spark, sf_dir, 5)
