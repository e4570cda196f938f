"""Scalar functions as column expressions; pandas functions only where there is no built-in."""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cents_between(reference: Column, estimate: Column) -> Column:
    return 1200 * F.log2(estimate / reference)


def fold_octave(cents: Column) -> Column:
    """Distance to the nearest octave, in cents."""
    return F.abs(F.pmod(cents + 600, F.lit(1200.0)) - 600)


def hz_to_cents(hz: Column) -> Column:
    return 1200 * F.log2(hz)


def midi_to_hz(note: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (note - 69) / F.lit(12.0))


def db(power: Column, eps: float = 1e-12) -> Column:
    return 10 * F.log10(power + eps)


def db_ratio(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return 10 * F.log10((a + eps) / (b + eps))


def wrap_phase(x: Column) -> Column:
    """The angle in [-pi, pi)."""
    return F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi


def circular_variance(angle: Column, weight: Column) -> Column:
    """Aggregate: 1 - length of the weighted mean direction, within 0 and 1; null without weight."""
    c, s, w = F.sum(weight * F.cos(angle)), F.sum(weight * F.sin(angle)), F.sum(weight)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(F.sqrt(c * c + s * s), w)))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def entropy(p: Column, bins: int) -> Column:
    """Normalised entropy of an array of probabilities over ``bins`` possible bins."""
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0)) / math.log(bins)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def rotate(a: Column, shift: Column) -> Column:
    """The array turned by ``shift`` places."""
    n = F.size(a)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(a, (F.pmod(i - shift, n) + 1).cast("int")))


def argmax(a: Column) -> Column:
    """Place from 0 of the first greatest element."""
    return F.array_position(a, F.array_max(a)) - 1


def pitch_class_step(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(12))
    return F.least(d, 12 - d) / F.lit(6.0)


def signed_shift(s: Column) -> Column:
    return F.when(s <= 6, s).otherwise(s - 12)


def clean_text(c: Column) -> Column:
    """Line feeds for all line ends, single blanks, none around line feeds or at the ends."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r" *\n *", "\n"), r"^[ \n]+|[ \n]+$", "")


def comma_tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def duration_token(c: Column) -> Column:
    """Seconds of a token like 30s or 7.5s; null for other texts."""
    return F.when(c.rlike(r"^[0-9]+(\.[0-9]+)?s$"), F.regexp_extract(c, r"^([0-9]+(?:\.[0-9]+)?)s$", 1).cast("double"))


def safe_name(c: Column) -> Column:
    """A relative path without parent steps, backslashes, NUL or empty parts."""
    return c.isNotNull() & (c != "") & ~c.startswith("/") & ~c.contains("\\") & ~c.contains("\x00") & ~F.exists(F.split(c, "/"), lambda p: p.isin("", ".", ".."))


@F.pandas_udf(T.StringType())
def normal_text(s: pd.Series) -> pd.Series:
    """NFKC, case folded, white space collapsed; Arrow batches, as there is no built-in for it."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z > z) of the standard normal distribution."""
    return z.map(lambda x: None if x is None or np.isnan(x) else 0.5 * math.erfc(x / math.sqrt(2)))


@F.pandas_udf(T.StructType([T.StructField("mantissa", T.DoubleType()), T.StructField("exponent", T.IntegerType())]))
def frexp(x: pd.Series) -> pd.DataFrame:
    m, e = np.frexp(x.to_numpy(float))
    return pd.DataFrame({"mantissa": m, "exponent": e.astype(np.int32)})
