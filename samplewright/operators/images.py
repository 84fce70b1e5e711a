"""Per-sample image work: one fused Python pass over Arrow batches.

Decode, resize and conversion stay together so that pixels cross the JVM/Python
border once. Images of equal size inside an Arrow batch are handled as one
numpy array. Codecs are not part of this library: a decoder is a function
``bytes -> uint8 array [H,W,3]`` (or ``(row) -> array`` with ``decoder_columns``),
imported on the executors.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from samplewright.functions.columns import as_col, hash_hex, hash_uniform, int_div
from samplewright.functions.fixed import DEFAULT_IMAGE_SIZE

TENSOR_FIELDS = "height int, width int, channels int, data binary, error string"
SLICE_BYTES = 32 << 20
# Bits behind the point of a resampling weight.
RESAMPLE_BITS = 22


# --- pixels -----------------------------------------------------------------

def pillow_decoder(blob: bytes) -> np.ndarray:
    """Decode with Pillow where the executors have it."""
    from PIL import Image

    return np.asarray(Image.open(io.BytesIO(blob)).convert("RGB"))


def _axis(length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-pixel-centre source indices and weights of one axis."""
    centre = np.maximum((np.arange(size, dtype=np.float32) + 0.5) * (length / size) - 0.5, 0)
    low = np.minimum(centre.astype(np.int64), length - 1)
    high = np.minimum(low + 1, length - 1)
    return low, high, (centre - low).astype(np.float32)


def resize_bilinear(stack: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Bilinear resize of a uint8 stack ``[N,H,W,C]``; a stack of the target size is returned as it is."""
    height, width = size
    if stack.shape[1:3] == (height, width):
        return stack
    top, bottom, dy = _axis(stack.shape[1], height)
    left, right, dx = _axis(stack.shape[2], width)
    dy, dx = dy[None, :, None, None], dx[None, None, :, None]

    def corner(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return stack[:, rows[:, None], columns[None, :]].astype(np.float32)

    upper = corner(top, left) * (1 - dx) + corner(top, right) * dx
    lower = corner(bottom, left) * (1 - dx) + corner(bottom, right) * dx
    out = upper * (1 - dy) + lower * dy
    return np.floor(out + 0.5).clip(0, 255).astype(np.uint8)


@lru_cache(maxsize=1024)
def _triangle(length: int, size: int) -> np.ndarray:
    """Weights ``[size, length]`` of a triangle filter as wide as a target pixel, in units of 2^-22.

    Rows are normalised before they are brought to whole numbers; most of their weights are zero.
    """
    scale = length / size
    support = max(scale, 1.0)
    weights = np.zeros((size, length))
    for i in range(size):
        centre = (i + 0.5) * scale
        low, high = max(int(centre - support + 0.5), 0), min(int(centre + support + 0.5), length)
        near = np.maximum(1 - np.abs((np.arange(low, high) - centre + 0.5) * (1 / support)), 0)
        weights[i, low:high] = near / near.sum()
    return np.floor(weights * (1 << RESAMPLE_BITS) + 0.5)


def resize_antialiased(stack: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Bilinear resize of a uint8 stack ``[N,H,W,C]`` in which every source pixel below a target pixel counts.

    Columns first, then rows, each rounded to whole levels; a pass that changes nothing is left out. The products are
    whole numbers that doubles hold exactly, so results do not depend on the machine.
    """
    half = 1 << (RESAMPLE_BITS - 1)
    for axis, length in ((2, size[1]), (1, size[0])):
        if stack.shape[axis] != length:
            moved = np.moveaxis(stack, axis, -1).astype(np.float64) @ _triangle(stack.shape[axis], length).T
            stack = np.moveaxis(np.floor((moved + half) / (1 << RESAMPLE_BITS)).clip(0, 255).astype(np.uint8), -1, axis)
    return stack


def to_bytes(stack: np.ndarray, scale: bool, mean: Sequence[float] | None, std: Sequence[float] | None) -> list[bytes]:
    """Channel-major bytes per image: uint8, or little-endian float32 when scaled."""
    planes = np.ascontiguousarray(stack.transpose(0, 3, 1, 2))
    if scale or mean is not None:
        planes = planes.astype("<f4") / np.float32(255)
    if mean is not None:
        shape = (1, -1, 1, 1)
        planes = (planes - np.asarray(mean, "<f4").reshape(shape)) / np.asarray(std, "<f4").reshape(shape)
    return [image.tobytes() for image in planes]


def _decode(decoder: Callable, values: Sequence) -> tuple[np.ndarray | None, str | None]:
    """The decoded array, or the reason there is none."""
    try:
        if any(v is None or v != v for v in values):
            raise ValueError("missing image")
        array = np.asarray(decoder(*values), dtype=np.uint8)
        if array.ndim != 3:
            raise ValueError(f"decoder returned {array.ndim} dimensions")
        return array, None
    except Exception as problem:  # any codec error makes this row a reject
        return None, f"{type(problem).__name__}: {problem}"


def _tensors(arrays: list, rows: pd.DataFrame | None, make: Callable, scale: bool, mean, std) -> tuple[list, np.ndarray]:
    """Tensor bytes and shapes of decoded arrays; those of equal shape are handled as one array."""
    shape = np.zeros((len(arrays), 3), dtype=np.int32)
    data: list = [None] * len(arrays)
    groups: dict[tuple, list[int]] = {}
    for i, array in enumerate(arrays):
        if array is not None:
            groups.setdefault(array.shape, []).append(i)
    for members in groups.values():
        stack = make(np.stack([arrays[i] for i in members]), None if rows is None else rows.iloc[members])
        shape[members] = stack.shape[1:]
        for i, blob in zip(members, to_bytes(stack, scale, mean, std)):
            data[i] = blob
    return data, shape


def _image_pass(df: DataFrame, keep: Sequence[str], decoder: Callable | None, decoder_columns: Sequence[str],
                make: Callable[[np.ndarray, pd.DataFrame], np.ndarray], scale: bool, mean, std,
                on_bad: str, extra: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns and the tensor fields.

    A pandas UDF, so that only the decoder's columns go to Python. It works on
    slices of about ``SLICE_BYTES`` of pixels.
    """
    if on_bad not in ("error", "reject"):
        raise ValueError(f"unknown on_bad {on_bad!r}")
    decode = decoder or pillow_decoder
    names = list(dict.fromkeys([*decoder_columns, *extra]))
    decoder_columns = list(decoder_columns)
    whole = [isinstance(df.schema[c].dataType, IntegralType) for c in decoder_columns]

    def finish(rows: pd.DataFrame, arrays: list, errors: list) -> pd.DataFrame:
        data, shape = _tensors(arrays, rows, make, scale, mean, std)
        return pd.DataFrame({
            "height": shape[:, 0], "width": shape[:, 1], "channels": shape[:, 2], "data": data, "error": errors,
        })

    @F.pandas_udf(TENSOR_FIELDS)
    def tensors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            arrays, errors, first, held = [], [], 0, 0
            for i, values in enumerate(zip(*(frame[c] for c in decoder_columns))):
                # pandas turns whole numbers next to a NULL into floats
                values = [int(v) if w and v == v else v for v, w in zip(values, whole)]
                array, error = _decode(decode, values)
                if error and on_bad == "error":
                    raise ValueError(error)
                arrays.append(array)
                errors.append(error)
                held += 0 if array is None else array.nbytes
                if held >= SLICE_BYTES or i + 1 == len(frame):
                    yield finish(frame.iloc[first:i + 1], arrays, errors)
                    arrays, errors, first, held = [], [], i + 1, 0

    added = df.withColumn("_tensor", tensors(F.struct(*names)))
    fields = ("height", "width", "channels", "data", "error")
    return added.select(*keep, *[F.col(f"_tensor.{f}").alias(f) for f in fields])


def _fit(size: tuple[int, int] | None) -> Callable:
    def make(stack: np.ndarray, _: pd.DataFrame) -> np.ndarray:
        return stack if size is None else resize_bilinear(stack, size)

    return make


def batch_tensors(batches: DataFrame, size: tuple[int, int] | None = DEFAULT_IMAGE_SIZE, scale: bool = False,
                  mean: Sequence[float] | None = None, std: Sequence[float] | None = None,
                  decoder: Callable | None = None, decoder_columns: Sequence[str] = ("image",),
                  out: str = "images") -> DataFrame:
    """Replace the array columns ``decoder_columns`` of gathered batches by ``images``, an array of binary tensors.

    A bad image raises: a batch has no place for a reject.
    """
    decode, make = decoder or pillow_decoder, _fit(size)

    @F.pandas_udf("array<binary>")
    def tensors(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in frames:
            done = []
            for batch in zip(*columns):
                arrays = []
                for values in zip(*batch):
                    array, error = _decode(decode, values)
                    if error:
                        raise ValueError(error)
                    arrays.append(array)
                data, shape = _tensors(arrays, None, make, scale, mean, std)
                if len(np.unique(shape, axis=0)) > 1:
                    raise ValueError("images of one batch differ in shape; give a size")
                done.append(data)
            yield pd.Series(done)

    return batches.withColumn(out, tensors(*decoder_columns)).drop(*[c for c in decoder_columns if c != out])


def image_tensors(df: DataFrame, size: tuple[int, int] | None = DEFAULT_IMAGE_SIZE, scale: bool = False,
                  mean: Sequence[float] | None = None, std: Sequence[float] | None = None,
                  decoder: Callable | None = None, decoder_columns: Sequence[str] = ("image",),
                  keep: Sequence[str] = ("sample_idx", "label"), on_bad: str = "reject") -> DataFrame:
    """Decode, resize, convert: ``keep`` columns plus ``height, width, channels, data, error``.

    ``data`` is channel-major: uint8, or float32 in 0..1 with ``scale``, or
    normalised with ``mean``/``std``. Bad images keep their row with ``error`` set
    (see ``split_rejects``) unless ``on_bad='error'``.
    """
    return _image_pass(df, keep, decoder, decoder_columns, _fit(size), scale, mean, std, on_bad)


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected rows."""
    return df.where("error is null").drop("error"), df.where("error is not null").drop("data")


def tensor_values(data: str | Column, dtype: str = "uint8") -> Column:
    """The numbers of a ``data`` blob as an array column."""
    stored, kind, read = ("u1", "array<smallint>", "i2") if dtype == "uint8" else ("<f4", "array<float>", "f4")

    @F.pandas_udf(kind)
    def values(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype=stored).astype(read))

    return values(as_col(data))


def spark_image_blobs(images: DataFrame) -> DataFrame:
    """Rows of Spark's ``image`` source as ``path, label, height, width, channels, image`` (raw bytes).

    Use ``spark_image_decoder`` on ``("height", "width", "channels", "image")``.
    """
    pieces = F.split("image.origin", "/")
    return images.select(
        F.col("image.origin").alias("path"),
        F.element_at(pieces, -2).alias("label"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("image"),
    )


def spark_image_decoder(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """BGR / BGRA / grey bytes of Spark's ``image`` source to RGB."""
    if height <= 0:
        raise ValueError("undecodable image")
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(pixels, 3, axis=2)
    return pixels[:, :, 2::-1]


def raw_decoder(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Row-major interleaved bytes of a known shape."""
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)


# --- image files ------------------------------------------------------------

def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG file of a uint8 array ``[H,W,3]`` or ``[H,W,1]``: unfiltered rows in stored blocks."""
    height, width, channels = pixels.shape
    if channels not in (1, 3):
        raise ValueError(f"no PNG colour type for {channels} channels")
    rows = np.zeros((height, 1 + width * channels), dtype=np.uint8)  # each row begins with its filter type, none
    rows[:, 1:] = pixels.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    parts = [(b"IHDR", head), (b"IDAT", zlib.compress(rows.tobytes(), 0)), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(
        struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data)) for kind, data in parts)


def png_files(df: DataFrame, height: str = "height", width: str = "width", channels: str = "channels", image: str = "image") -> DataFrame:
    """Replace raw pixel bytes by PNG files; null images stay null."""

    @F.pandas_udf("binary")
    def encode(h: pd.Series, w: pd.Series, c: pd.Series, blobs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else png_bytes(raw_decoder(int(y), int(x), int(z), b)) for y, x, z, b in zip(h, w, c, blobs)], dtype=object)

    return df.withColumn(image, encode(height, width, channels, image))


# --- crops ------------------------------------------------------------------

def eval_crop(df: DataFrame, resize: int = 256, crop: int = 224, **options) -> DataFrame:
    """Shorter side to ``resize`` (antialiased), then the centre ``crop`` x ``crop``."""

    def make(stack: np.ndarray, _: pd.DataFrame) -> np.ndarray:
        height, width = stack.shape[1:3]
        if height <= width:
            target = (resize, int(resize * width / height))
        else:
            target = (int(resize * height / width), resize)
        stack = resize_antialiased(stack, target)
        short = [max(0, crop - n) for n in target]
        if any(short):  # a crop larger than the image is filled up with zeros around it
            stack = np.pad(stack, ((0, 0), *((n // 2, n - n // 2) for n in short), (0, 0)))
        top, left = (round((n - crop) / 2) for n in stack.shape[1:3])
        return stack[:, top:top + crop, left:left + crop]

    return _image_pass(df, options.pop("keep", ("sample_idx", "label")), options.pop("decoder", None),
                       options.pop("decoder_columns", ("image",)), make, options.pop("scale", False),
                       options.pop("mean", None), options.pop("std", None), options.pop("on_bad", "reject"))


def augment_params(df: DataFrame, key: str, height: str | Column, width: str | Column, seed: int = 42,
                   epoch: int = 0, area: tuple[float, float] = (0.08, 1.0),
                   ratio: tuple[float, float] = (3 / 4, 4 / 3), attempts: int = 10) -> DataFrame:
    """Add ``crop_top, crop_left, crop_h, crop_w, flip``, a pure function of (seed, epoch, key).

    Each attempt draws an area share and a log-uniform aspect ratio; the first
    box that fits is used, else the largest centred box of a permitted ratio.
    """
    h, w = as_col(height).cast("bigint"), as_col(width).cast("bigint")
    low, high = float(np.log(ratio[0])), float(np.log(ratio[1]))

    def draw(i: Column) -> Column:
        return hash_hex(seed, epoch, F.col(key), i)

    def box(text: Column) -> Column:
        share = (h * w) * (F.lit(area[0]) + F.lit(area[1] - area[0]) * hash_uniform(text, 0))
        shape = F.exp(F.lit(low) + F.lit(high - low) * hash_uniform(text, 1))
        return F.struct(share.alias("share"), shape.alias("shape"), text.alias("text"))

    def sides(b: Column) -> Column:
        return F.struct(
            F.bround(F.sqrt(b["share"] / b["shape"]), 0).cast("bigint").alias("h"),
            F.bround(F.sqrt(b["share"] * b["shape"]), 0).cast("bigint").alias("w"),
            b["text"].alias("text"),
        )

    def fits(b: Column) -> Column:
        return (b["h"] > 0) & (b["w"] > 0) & (b["h"] <= h) & (b["w"] <= w)

    def placed(b: Column) -> Column:
        return F.struct(
            b["h"].alias("h"), b["w"].alias("w"),
            F.floor(hash_uniform(b["text"], 2) * (h - b["h"] + 1)).alias("top"),
            F.floor(hash_uniform(b["text"], 3) * (w - b["w"] + 1)).alias("left"),
        )

    def first_fit(tries: Column) -> Column:
        # One transform per step, so that each value is computed once per try.
        sized = F.transform(F.transform(F.transform(tries, draw), box), sides)
        return F.get(F.transform(F.slice(F.filter(sized, fits), 1, 1), placed), F.lit(0))

    shape = w / h
    full_h = F.when(shape < ratio[0], F.bround(w / F.lit(ratio[0]), 0).cast("bigint")).otherwise(h)
    full_w = F.when(shape > ratio[1], F.bround(h * F.lit(ratio[1]), 0).cast("bigint")).otherwise(w)
    centred = F.struct(
        full_h.alias("h"), full_w.alias("w"),
        int_div(h - full_h, 2).alias("top"), int_div(w - full_w, 2).alias("left"),
    )
    flip = hash_uniform(hash_hex(seed, epoch, F.col(key), "flip"), 0) < 0.5
    # Most rows are settled by the first try; the others are drawn only when needed.
    tries = [first_fit(F.array(F.lit(0)))]
    if attempts > 1:
        tries.append(first_fit(F.sequence(F.lit(1), F.lit(attempts - 1))))
    boxed = df.withColumn("_box", F.coalesce(*tries, centred))
    return boxed.withColumns({
        "crop_top": F.col("_box.top"), "crop_left": F.col("_box.left"),
        "crop_h": F.col("_box.h"), "crop_w": F.col("_box.w"), "flip": flip,
    }).drop("_box")


def augment(df: DataFrame, size: tuple[int, int] = (224, 224), **options) -> DataFrame:
    """Cut the ``crop_*`` box of each row, resize it (antialiased) and mirror it where ``flip`` is set."""

    def make(stack: np.ndarray, frame: pd.DataFrame) -> np.ndarray:
        out = np.empty((len(stack), *size, stack.shape[3]), dtype=np.uint8)
        boxes = frame[["crop_top", "crop_left", "crop_h", "crop_w", "flip"]].itertuples(index=False)
        for i, (top, left, h, w, flip) in enumerate(boxes):
            cut = resize_antialiased(stack[i:i + 1, top:top + h, left:left + w], size)[0]
            out[i] = cut[:, ::-1] if flip else cut
        return out

    return _image_pass(df, options.pop("keep", ("sample_idx", "label")), options.pop("decoder", None),
                       options.pop("decoder_columns", ("image",)), make, options.pop("scale", False),
                       options.pop("mean", None), options.pop("std", None), options.pop("on_bad", "reject"),
                       extra=("crop_top", "crop_left", "crop_h", "crop_w", "flip"))


# --- user code and profile --------------------------------------------------

def map_samples(df: DataFrame, fn: Callable, schema: str, setup: Callable | None = None) -> DataFrame:
    """Apply ``fn(frame)`` - or ``fn(frame, state)`` - to every Arrow batch of samples.

    ``setup()`` makes the state once per partition: open handles and load models there.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = setup() if setup else None
        for frame in frames:
            yield fn(frame, state) if setup else fn(frame)

    return df.mapInPandas(run, schema)


def image_profile(images: DataFrame) -> DataFrame:
    """Counts by size and by channel count, as ``kind, width, height, channels, n``."""
    shapes = images.groupBy("width", "height", "channels").agg(F.count(F.lit(1)).alias("n"))
    sizes = shapes.groupBy("width", "height").agg(F.sum("n").alias("n"))
    modes = shapes.groupBy("channels").agg(F.sum("n").alias("n"))
    return sizes.select(
        F.lit("size").alias("kind"), "width", "height", F.lit(None).cast("int").alias("channels"), "n"
    ).unionByName(modes.select(
        F.lit("mode").alias("kind"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), "channels", "n",
    ))
