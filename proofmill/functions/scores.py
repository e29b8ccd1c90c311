"""Column functions for scores, grades, dates and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 1) -> Column:
    """floor(x * 10^d + 1/2) / 10^d on doubles."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + F.lit(0.5)).cast("double") / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normative_score(high: Column, medium: Column, low: Column) -> Column:
    weighted = F.coalesce(high, F.lit(0)) * 10 + F.coalesce(medium, F.lit(0)) * 4 + F.coalesce(low, F.lit(0))
    return F.greatest(F.lit(0.0), F.lit(100.0) - weighted)


def originality_score(rate: Column) -> Column:
    return clamp(F.lit(100.0) - rate.cast("double") * 100, 0.0, 100.0)


def json_number(payload: Column, path: str) -> Column:
    """A number in JSON text. A key that is there with null is 0; one that is missing, and what is no number, is null."""
    key = path.removeprefix("$.")
    null = F.try_variant_get(F.try_parse_json(payload), path, "variant")
    is_null = F.is_variant_null(null)
    return F.when(F.coalesce(is_null, F.lit(False)), F.lit(0.0)).otherwise(F.get_json_object(payload, f"$.{key}").try_cast("double"))


def item_sum(items: Column) -> Column:
    """Sum of the scores of an array of structs; null without items."""
    return F.when(F.size(items) > 0, F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x["score"].cast("double"), F.lit(0.0))))


def decile(score: Column) -> Column:
    low = F.greatest(F.lit(0), (F.floor(score / 10) * 10)).cast("int")
    return F.when(score >= 100, F.lit("100")).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string")))


def grade(total: Column) -> Column:
    return F.when(total >= 90, "优秀").when(total >= 80, "良好").when(total >= 60, "一般").otherwise("待提升")


def percent_label(rate: Column) -> Column:
    return F.concat(F.round(rate * 100, 1).cast("string"), F.lit("%"))


def date_of(text: Column) -> Column:
    """The UTC date of a text timestamp; null if it is none."""
    return F.to_date(F.try_to_timestamp(text))


def china_time(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, "Asia/Shanghai"), "yyyy-MM-dd HH:mm")


def radar_point(index: Column, total: Column, ratio: Column, centre: float = 110.0, radius: float = 82.0) -> Column:
    """Where a ratio lies on the axis of its index; the first axis points up."""
    angle = index * (2 * math.pi) / total - math.pi / 2
    return F.struct((F.cos(angle) * ratio * radius + centre).alias("x"), (F.sin(angle) * ratio * radius + centre).alias("y"))
