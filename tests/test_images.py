from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from samplewright.functions.fixed import CHANNEL_MEAN, CHANNEL_STD
from samplewright.operators import images
from samplewright.sources.folders import read_decoded_folder
from tests.pictures import picture

RAW = {"decoder": images.raw_decoder, "decoder_columns": ("height", "width", "channels", "image")}


def raw_rows(spark, arrays):
    rows = [(i, f"n{i:08d}", a.shape[0], a.shape[1], 3, a.tobytes()) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "sample_idx bigint, label string, height int, width int, channels int, image binary")


def bilinear(a, size):
    """Plain loops, half-pixel centres."""
    out = np.zeros((*size, a.shape[2]))
    for y in range(size[0]):
        for x in range(size[1]):
            sy = max((y + .5) * a.shape[0] / size[0] - .5, 0)
            sx = max((x + .5) * a.shape[1] / size[1] - .5, 0)
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(y0 + 1, a.shape[0] - 1), min(x0 + 1, a.shape[1] - 1)
            fy, fx = sy - y0, sx - x0
            out[y, x] = ((a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy)
    return out


def test_resize_by_hand():
    a = np.array([[[0], [100]], [[200], [40]]], dtype=np.uint8)
    got = images.resize_bilinear(a[None], (4, 4))[0, :, :, 0]
    want = [[0, 25, 75, 100], [50, 59, 76, 85], [150, 126, 79, 55], [200, 160, 80, 40]]
    assert np.abs(got.astype(int) - np.array(want)).max() <= 1
    same = np.arange(16, dtype=np.uint8).reshape(1, 4, 4, 1)
    assert images.resize_bilinear(same, (4, 4)) is same


@pytest.mark.parametrize("size", [(3, 9), (12, 2), (64, 64), (1, 1)])
def test_resize_matches_loops(size):
    a = picture(3, 7, 5)
    assert np.abs(images.resize_bilinear(a[None], size)[0].astype(float) - bilinear(a.astype(float), size)).max() <= 0.51


def test_mixed_sizes_keep_their_rows(spark):
    arrays = [picture(i, 4 + i % 3, 5 + i % 2) for i in range(20)]
    out = images.image_tensors(raw_rows(spark, arrays), size=(6, 6), **RAW).collect()
    assert len(out) == 20
    for r in out:
        want = images.resize_bilinear(arrays[r.sample_idx][None], (6, 6))[0]
        got = np.frombuffer(r.data, np.uint8).reshape(3, 6, 6).transpose(1, 2, 0)
        assert (got == want).all() and (r.height, r.width, r.channels, r.error) == (6, 6, 3, None)


def test_scaled_and_normalised(spark):
    a = picture(1)
    scaled = images.image_tensors(raw_rows(spark, [a]), size=None, scale=True, **RAW).first()
    assert np.allclose(np.frombuffer(scaled.data, "<f4"), a.transpose(2, 0, 1).ravel() / 255)
    normal = images.image_tensors(raw_rows(spark, [a]), size=None, mean=CHANNEL_MEAN, std=CHANNEL_STD, **RAW).first()
    want = (a / 255 - np.array(CHANNEL_MEAN)) / np.array(CHANNEL_STD)
    assert np.allclose(np.frombuffer(normal.data, "<f4"), want.transpose(2, 0, 1).ravel(), atol=1e-5)


def test_tensor_values(spark):
    a = picture(2)
    df = images.image_tensors(raw_rows(spark, [a]), size=None, **RAW)
    assert df.select(images.tensor_values("data").alias("v")).first().v == a.transpose(2, 0, 1).ravel().tolist()


def test_rejects(spark):
    df = raw_rows(spark, [picture(0), picture(1)])
    df = df.withColumn("image", F.when(F.col("sample_idx") == 0, F.lit(b"xx")).otherwise(F.col("image")))
    df = df.unionByName(df.where("sample_idx = 1").withColumns({"sample_idx": F.lit(2).cast("bigint"), "image": F.lit(None).cast("binary")}))
    df = df.unionByName(df.where("sample_idx = 1").withColumns({"sample_idx": F.lit(3).cast("bigint"), "height": F.lit(None).cast("int")})).coalesce(1)
    good, bad = images.split_rejects(images.image_tensors(df, **RAW))
    assert [r.sample_idx for r in good.collect()] == [1]
    assert sorted(r.sample_idx for r in bad.collect()) == [0, 2, 3]
    with pytest.raises(PythonException):
        images.image_tensors(df, on_bad="error", **RAW).collect()


def triangle(a, size):
    """Triangle filter pixel by pixel, columns before rows, each in whole levels."""
    for axis, n in ((1, size[1]), (0, size[0])):
        a = np.moveaxis(a, axis, 0)
        m = a.shape[0]
        out = []
        for i in range(n):
            scale = m / n
            support, centre = max(scale, 1.0), (i + 0.5) * scale
            taps = range(max(0, int(centre - support + 0.5)), min(m, int(centre + support + 0.5)))
            weight = [max(0.0, 1 - abs((k - centre + 0.5) * (1 / support))) for k in taps]
            whole = [int(w / sum(weight) * 2 ** 22 + 0.5) for w in weight]
            out.append(np.clip((sum(a[k].astype(np.int64) * w for k, w in zip(taps, whole)) + 2 ** 21) >> 22, 0, 255))
        a = np.moveaxis(np.array(out), 0, axis) if n != m else np.moveaxis(a, 0, axis)
    return a


@pytest.mark.parametrize("shape, size", [((9, 7), (3, 4)), ((5, 6), (11, 6)), ((64, 48), (7, 5)), ((1, 1), (4, 3)), ((8, 8), (8, 8)), ((300, 2), (1, 1))])
def test_antialiased_resize_is_the_triangle_filter(shape, size):
    stack = np.random.default_rng(3).integers(0, 256, (2, *shape, 3), dtype=np.uint8)
    assert all((got == triangle(a, size)).all() for got, a in zip(images.resize_antialiased(stack, size), stack))
    flat = np.full((1, *shape, 3), 255, dtype=np.uint8)
    assert (images.resize_antialiased(flat, size) == 255).all()


def test_shrinking_looks_at_every_pixel():
    """A checkerboard becomes grey; two taps would keep single pixels."""
    board = (np.indices((64, 64)).sum(axis=0) % 2 * 255).astype(np.uint8)[None, :, :, None]
    assert np.abs(images.resize_antialiased(board, (4, 4)).astype(int) - 128).max() <= 2


def test_png_files_are_read_by_the_image_source(spark, tmp_path):
    arrays = [picture(i, 3 + i, 5) for i in range(4)] + [picture(9)[:, :, :1]]
    rows = spark.createDataFrame([(i, a.shape[0], a.shape[1], a.shape[2], bytearray(a.tobytes())) for i, a in enumerate(arrays)] + [(9, 1, 1, 3, None)],
                                 "i int, height int, width int, channels int, image binary")
    files = images.png_files(rows).collect()
    assert files[-1].image is None
    (tmp_path / "a").mkdir()
    for r in files[:-1]:
        (tmp_path / "a" / f"{r.i}.png").write_bytes(r.image)
    for r in read_decoded_folder(spark, str(tmp_path), ("png",)).collect():
        a = arrays[int(r.path.split("/")[-1][0])]
        assert (images.spark_image_decoder(r.height, r.width, r.channels, r.image) == np.broadcast_to(a, (*a.shape[:2], 3))).all()
    with pytest.raises(ValueError):
        images.png_bytes(np.zeros((2, 2, 4), np.uint8))


def test_eval_crop(spark):
    a = picture(5, 20, 10)
    row = images.eval_crop(raw_rows(spark, [a]), 8, 6, **RAW).first()
    want = triangle(a, (16, 8))[5:11, 1:7]
    assert (np.frombuffer(row.data, np.uint8).reshape(3, 6, 6).transpose(1, 2, 0) == want).all()


def test_augment(spark):
    arrays = [picture(i, 12 + i % 5, 9 + i % 4) for i in range(40)]
    boxed = images.augment_params(raw_rows(spark, arrays), "sample_idx", "height", "width", seed=1, epoch=2)
    params = {r.sample_idx: r for r in boxed.collect()}
    out = images.augment(boxed, (5, 5), **RAW).collect()
    assert {p.flip for p in params.values()} == {True, False}
    for r in out:
        p, a = params[r.sample_idx], arrays[r.sample_idx]
        assert 0 <= p.crop_top and p.crop_top + p.crop_h <= a.shape[0] and p.crop_h > 0
        assert 0 <= p.crop_left and p.crop_left + p.crop_w <= a.shape[1] and p.crop_w > 0
        cut = a[p.crop_top:p.crop_top + p.crop_h, p.crop_left:p.crop_left + p.crop_w]
        want = triangle(cut, (5, 5))
        want = want[:, ::-1] if p.flip else want
        assert (np.frombuffer(r.data, np.uint8).reshape(3, 5, 5).transpose(1, 2, 0) == want).all()
    again = images.augment_params(raw_rows(spark, arrays).repartition(5), "sample_idx", "height", "width", seed=1, epoch=2)
    assert {r.sample_idx: r for r in again.collect()} == params
    other = images.augment_params(raw_rows(spark, arrays), "sample_idx", "height", "width", seed=1, epoch=3)
    assert {r.sample_idx: r for r in other.collect()} != params


def test_augment_falls_back_to_a_centred_box(spark):
    df = spark.createDataFrame([(1, 10, 1000), (2, 1000, 10)], "k bigint, h int, w int")
    rows = {r.k: r for r in images.augment_params(df, "k", "h", "w", area=(1.0, 1.0)).collect()}
    assert (rows[1].crop_h, rows[1].crop_w, rows[1].crop_left) == (10, 13, 493)
    assert (rows[2].crop_h, rows[2].crop_w, rows[2].crop_top) == (13, 10, 493)


def test_map_samples_opens_state_once_per_partition(spark):
    opened = spark.sparkContext.accumulator(0)

    def setup():
        opened.add(1)
        return 10

    df = spark.range(100, numPartitions=4)
    out = images.map_samples(df, lambda f, state: f.assign(id=f.id * state), "id bigint", setup)
    assert sorted(r.id for r in out.collect()) == [i * 10 for i in range(100)]
    assert opened.value == 4
