"""Row-local column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

from trackloom import constants as K


def finite(col: Column | str) -> Column:
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def all_finite(columns: list[str]) -> Column:
    return reduce(and_, [finite(c) for c in columns], F.lit(True))


def safe_identifier(col: Column) -> Column:
    return F.regexp_replace(col, r"[^\p{L}\p{N}_-]", "_")


def feet_to_meters(col: Column) -> Column:
    return col.cast("double") * K.FEET_TO_METERS


def pixels_to_meters(col: Column) -> Column:
    return col.cast("double") * K.PIXELS_TO_METERS


def float_list(col: Column) -> Column:
    """Parse "a;b;c"; blanks are skipped and null gives an empty list."""
    parts = F.filter(F.split(F.coalesce(col, F.lit("")), ";"), lambda s: F.trim(s) != "")
    return F.transform(parts, lambda s: F.trim(s).cast("double"))


def is_route_vehicle(agent_type: Column) -> Column:
    return F.lower(F.trim(F.coalesce(agent_type, F.lit("vehicle")))).isin(K.ROUTE_VEHICLES)


def ego_longitudinal(dx: Column, dy: Column, theta: Column) -> Column:
    return F.cos(theta) * dx + F.sin(theta) * dy


def ego_lateral(dx: Column, dy: Column, theta: Column) -> Column:
    return F.cos(theta) * dy - F.sin(theta) * dx


def heading_sector(lon: Column, lat: Column, half_width: Column, half_length: Column) -> Column:
    """Sector index, or null in the overlap zone of the ego vehicle."""
    left = lat > 0
    return (
        F.when(F.abs(lat) <= half_width, F.when(lon > half_length, 0).when(lon < -half_length, 1))
        .when(F.abs(lon) <= half_length, F.when(left, 3).otherwise(6))
        .when(lon > 0, F.when(left, 2).otherwise(5))
        .otherwise(F.when(left, 4).otherwise(7))
    )


def lane_sector(dx: Column, lane_delta: Column, half_length: Column) -> Column:
    """Sector index from lane difference (-1 left, +1 right) and longitudinal offset."""
    ahead, behind = dx > half_length, dx < -half_length
    alongside = F.abs(dx) <= half_length
    return (
        F.when(lane_delta == 0, F.when(ahead, 0).when(behind, 1))
        .when(lane_delta == -1, F.when(alongside, 3).when(dx > 0, 2).otherwise(4))
        .when(lane_delta == 1, F.when(alongside, 6).when(dx > 0, 5).otherwise(7))
    )


def plausible_pair(
    action: Column, following: Column, ax_limit: float, ay_limit: float, dax_limit: float, day_limit: float
) -> Column:
    """Acceleration gate on two consecutive float32 actions given as arrays."""

    def within(a: Column, limit: float) -> Column:
        return F.abs(a.cast("double")) <= limit

    ax, ay, bx, by = (F.get(a, F.lit(i)) for a in (action, following) for i in (0, 1))
    gate = [finite(c) for c in (ax, ay, bx, by)]
    gate += [within(ax, ax_limit), within(bx, ax_limit), within(ay, ay_limit), within(by, ay_limit)]
    gate += [within(bx - ax, dax_limit), within(by - ay, day_limit)]
    return F.coalesce(reduce(and_, gate), F.lit(False))


def window_ttc(front: Column, speed: Column, ax: Column, horizon: float) -> Column:
    """Front gap over predicted ego speed; null outside the valid range."""
    ttc = front / F.greatest(speed + ax * horizon, F.lit(0.5))
    valid = finite(front) & (front > 0) & (front < 120.0) & finite(speed) & (speed > 0.5)
    return F.when(valid & finite(ttc) & (ttc >= 0) & (ttc <= 5.0), ttc)


def frame_ttc(distance: Column, relative_speed: Column, epsilon: float = 1e-3) -> Column:
    """Nearest distance over |speed difference|; infinite when speeds match, null without neighbour."""
    return F.when(
        distance.isNotNull(),
        F.when(relative_speed <= epsilon, F.lit(float("inf"))).otherwise(distance / relative_speed),
    )


def interval_distance(value: Column, low: float, high: float, scale: float) -> Column:
    """Squared distance to a caller-supplied interval; a small centred penalty inside."""
    return (
        F.when(value < low, F.pow((F.lit(low) - value) / scale, 2))
        .when(value > high, F.pow((value - high) / scale, 2))
        .otherwise(F.pow((value - 0.5 * (low + high)) / scale, 2) * 0.05)
    )


def in_interval(value: Column, low: float, high: float) -> Column:
    return (value >= low) & (value <= high)


def clipped_completion(fde: Column, path_length: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - fde / F.greatest(path_length * 3.0, F.lit(1e-6))))


def standardize(values: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(values, mean, lambda v, m: v - m), std, lambda v, s: v / s)


def destandardize(values: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(values, std, lambda v, s: v * s), mean, lambda v, m: v + m)


def rbf(squared_distance: Column) -> Column:
    """Mean of Gaussian kernels over the fixed bandwidths."""
    terms = [F.exp(squared_distance * (-1.0 / (2.0 * b * b))) for b in K.KERNEL_BANDWIDTHS]
    return reduce(lambda a, b: a + b, terms) / len(terms)
