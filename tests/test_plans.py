"""Shapes of physical plans: shuffles, pruning, broadcasts, Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as registered
from samplewright import EpochPlan
from samplewright.operators import rank, sampler
from samplewright.session import broadcast_if_small

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_shuffle_plan(spark):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").select("o_orderkey", "o_totalprice")
    text = plan_of(sampler.shuffle(orders, "o_orderkey"))
    assert text.count("Exchange SinglePartition") == 1  # bucket counts only
    below = text[text.index("Exchange SinglePartition"):]
    assert below.index("HashAggregate") < below.index("FileScan")
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint>", text)  # the counting pass reads the key alone
    assert len(re.findall(r"\bExchange hashpartitioning\(_bucket", text)) == 2 and "SortMergeJoin" not in text
    # One shuffle of the rows: the rank window sits directly on it.
    assert len(re.findall(r"\bExchange ", text)) == 3


def test_collate_moves_rows_once(spark):
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    text = plan_of(EpochPlan("vec_id", 64).collated(vectors, "embedding", "label"))
    # The rows' own shuffle; the bucket counts and borders are settled before, and nothing is above the rank window.
    assert len(re.findall(r"\bExchange ", text)) == 2 and text.count("shufflepartitionidpassthrough") == 1 and "SinglePartition" in text
    assert "Exchange" not in text[:text.index("Window [")].replace("BroadcastExchange", "")


def test_decoded_epoch_moves_encoded_rows_once(spark):
    text = plan_of(registered.queries()["epoch_images"](spark, SF_DIR))
    assert text.count("ArrowEvalPython [") == 1 and len(re.findall(r"\bExchange ", text)) == 2
    assert text.index("ArrowEvalPython") < text.index("shufflepartitionidpassthrough")


def test_user_collate_moves_rows_once(spark):
    text = plan_of(registered.queries()["user_collate"](spark, SF_DIR))
    assert len(re.findall(r"\bExchange ", text)) == 2


def test_warmup_keeps_k_rows_per_run_and_task(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").select("event_type", "event_id")
    place = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    text = plan_of(events.withColumn("p", place).where("p <= 5").groupBy("event_type").agg(F.max("event_id")))
    assert "WindowGroupLimit" in text[text.index("Exchange"):]


def test_ordered_layout_needs_no_second_shuffle(spark):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").select("o_orderkey", "o_totalprice")
    text = plan_of(EpochPlan("o_orderkey", 64, partitions=4).batches(orders))
    assert text.count("shufflepartitionidpassthrough") == 1 and "rangepartitioning" not in text


def test_running_has_no_group_wide_row_window(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").select("event_type", "event_id", "value")
    text = plan_of(rank.running(events, ["event_type"], "event_id", {"s": ("value", "sum")}, block=200))
    windows = re.findall(r"Window \[.*\], \[(.*?)\], \[", text)
    assert len(windows) == 2 and sum("_block" in w for w in windows) == 1
    carried = text[text.rindex("Window ["):]
    assert carried.index("HashAggregate") < carried.index("FileScan")


@pytest.mark.parametrize("name", ["config_filter"])
def test_filters_reach_the_scan(spark, name):
    assert re.search(r"PushedFilters: \[[^\]]*(GreaterThan|EqualTo)", plan_of(registered.queries()[name](spark, SF_DIR)))


def test_broadcast_is_size_checked(spark):
    assert "broadcast" in broadcast_if_small(spark.range(10), 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(spark.range(11), 10)._jdf.queryExecution().logical().toString().lower()
