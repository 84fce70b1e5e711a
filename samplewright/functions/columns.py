"""Scalar expressions: labels, paths, units, ratios, scaling, schedules.

Everything here stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from samplewright.functions.fixed import CHANNEL_MEAN, CHANNEL_STD, IMAGE_EXTENSIONS


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def int_div(a, b) -> Column:
    """Integer division of two whole-number columns or literals."""
    a = F.lit(a) if isinstance(a, int) else as_col(a)
    b = F.lit(b) if isinstance(b, int) else as_col(b)
    return F.call_function("div", a, b)


# --- names and labels -------------------------------------------------------

def has_extension(name, exts: tuple[str, ...] = IMAGE_EXTENSIONS) -> Column:
    """Case-sensitive test of the file-name suffix."""
    return as_col(name).rlike(r"\.(" + "|".join(exts) + ")$")


def label_from_path(path, part: str = "parent") -> Column:
    """``parent`` directory of a file path, or the ``first`` part of a member name."""
    pieces = F.split(as_col(path), "/")
    if part == "parent":
        return F.try_element_at(pieces, F.lit(-2))
    if part == "first":
        return F.element_at(pieces, 1)
    raise ValueError(f"unknown part {part!r}")


def file_name(path) -> Column:
    return F.element_at(F.split(as_col(path), "/"), -1)


def parse_label(label, on_bad: str = "error") -> Column:
    """Class id to number: every ``n`` is removed, the rest is read as an integer."""
    label = as_col(label)
    number = F.replace(label, F.lit("n"), F.lit("")).try_cast("bigint")
    if on_bad == "null":
        return number
    if on_bad == "error":
        text = F.concat(F.lit("label is not a class id: "), F.coalesce(label, F.lit("NULL")))
        return F.when(number.isNull(), F.raise_error(text).cast("bigint")).otherwise(number)
    raise ValueError(f"unknown on_bad {on_bad!r}")


def parse_run_name(name, field: str) -> Column:
    """One field of ``[calib_]summary_{model}_bs{n}[_nb{n}]_{optimizer}_{gpu}_{timestamp}.csv``."""
    pattern = r"^(?:calib_)?summary_(.+?)_bs(\d+)(?:_nb\d+)?_(adam|sgd)_(.+)_(\d{8}_\d{6})\.csv$"
    group = {"model": 1, "batch_size": 2, "optimizer": 3, "gpu": 4, "ts": 5}[field]
    text = F.nullif(F.regexp_extract(as_col(name), pattern, group), F.lit(""))
    return text.cast("int") if field == "batch_size" else text


# --- units and ratios -------------------------------------------------------

def rounded(value, digits: int) -> Column:
    """Half-even rounding."""
    return F.bround(as_col(value), digits)


def to_ms(seconds, digits: int = 3) -> Column:
    return F.bround(as_col(seconds) * 1000, digits)


def to_us(seconds, digits: int = 2) -> Column:
    return F.bround(as_col(seconds) * 1_000_000, digits)


def pct(part, other, eps: float = 1e-8, digits: int = 2) -> Column:
    """``100*part/(part+other+eps)``, defined for an empty total."""
    part, other = as_col(part), as_col(other)
    return F.bround(100 * part / (part + other + F.lit(eps)), digits)


def safe_ratio(num, den) -> Column:
    """``num/den``, and 0 where ``den`` is not positive."""
    num, den = as_col(num), as_col(den)
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def core_equivalents(cpu_seconds, elapsed) -> Column:
    return as_col(cpu_seconds) / as_col(elapsed)


# --- tensors as arrays ------------------------------------------------------

def scale_255(values, depth: int = 1) -> Column:
    """0..255 to 0..1, element by element of an array, or of nested arrays with ``depth``."""
    if depth > 1:
        return F.transform(as_col(values), lambda a: scale_255(a, depth - 1))
    return F.transform(as_col(values), lambda x: x.cast("double") / F.lit(255.0))


def channel_normalise(values, plane: int, mean: tuple[float, ...] = CHANNEL_MEAN,
                      std: tuple[float, ...] = CHANNEL_STD) -> Column:
    """``(x-mean)/std`` per channel of a channel-major array with ``plane`` values per channel."""
    means = F.array(*[F.lit(float(m)) for m in mean])
    stds = F.array(*[F.lit(float(s)) for s in std])

    def one(x, i):
        channel = int_div(i, plane).cast("int") + 1
        return (x.cast("double") - F.element_at(means, channel)) / F.element_at(stds, channel)

    return F.transform(as_col(values), one)


def argmax(scores) -> Column:
    """Index of the first largest element."""
    scores = as_col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def cross_entropy(scores, label) -> Column:
    """``log(sum(exp(scores))) - scores[label]``, shifted by the maximum."""
    scores = as_col(scores)
    top = F.array_max(scores).cast("double")
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    return F.log(total) + top - F.get(scores, as_col(label)).cast("double")


# --- schedules --------------------------------------------------------------

def step_lr(epoch, lr: float, step: int, gamma: float) -> Column:
    """Learning rate of a step schedule."""
    return F.lit(lr) * F.pow(F.lit(gamma), int_div(as_col(epoch), step).cast("double"))


def every_k(index, k: int, first: int = 0) -> Column:
    """True for ``first+k-1, first+2k-1, …``: every ``k``-th row counted from ``first``."""
    return (as_col(index) - first + 1) % k == 0


# --- deterministic draws ----------------------------------------------------

def hash_hex(*parts) -> Column:
    """md5 of the parts joined by ``:``."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def hex_number(hex_text: Column, start: int, digits: int) -> Column:
    """``digits`` (at most 15) hex digits from 1-based ``start`` as a number."""
    return F.conv(F.substring(hex_text, start, digits), 16, 10).cast("bigint")


def hash_uniform(hex_text: Column, lane: int) -> Column:
    """One of four uniforms in [0,1) that an md5 text holds."""
    return hex_number(hex_text, 1 + 8 * lane, 8) / F.lit(float(1 << 32))
