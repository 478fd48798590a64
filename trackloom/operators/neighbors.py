"""Same-frame neighbours: by direction sector, by lane, by shipped ids, and the single nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackloom import constants as K
from trackloom.functions import columns as C
from trackloom.session import materialize

# The scene rides along: a recording belongs to one scene.
FRAME = ["dataset", "scene_id", "recording", "frame"]


def _reach(df: DataFrame, radius: float, cell: float) -> DataFrame:
    """One copy of a point per grid cell its disc can touch: four on average when cell = 2 * radius."""
    span = lambda c: F.sequence(
        F.floor((F.col(c) - radius) / cell).cast("long"), F.floor((F.col(c) + radius) / cell).cast("long")
    )
    return df.withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y")))


def distinct_spots(tracks: DataFrame, keys: list[str], id_col: str, extra: list[str] = ()) -> DataFrame:
    """One row per distinct position, so copies of a point cost one comparison, not one each.

    The smallest and largest 64-bit id hash are enough to know whether some *other* track stands there.
    """
    code = F.xxhash64(id_col)
    return tracks.groupBy(*keys, "x", "y", *extra).agg(F.min(code).alias("_id_lo"), F.max(code).alias("_id_hi"))


def sector_distances(
    tracks: DataFrame, radius: float, sector: str = "heading", half_width: Column | None = None,
    half_length: Column | None = None, keys: list[str] = FRAME, id_col: str = "track_id", carry: list[str] = (),
) -> DataFrame:
    """Nearest neighbour distance in each of eight sectors, null where a sector is empty.

    Rows must be unique per (keys, id). Neighbours are matched through a spatial grid, so a crowded frame
    is spread over its cells; the minimum is taken before anything is shuffled again.
    """
    cell = 2.0 * radius
    keys, carry = list(keys), list(carry)
    lanes = ["lane_id"] if sector == "lane" else []
    spots = _reach(distinct_spots(tracks, keys, id_col, lanes), radius, cell)
    spots = spots.select(
        *[F.col(k).alias(f"_k_{k}") for k in [*keys, "_cx", "_cy"]],
        F.col("x").alias("_ox"), F.col("y").alias("_oy"), "_id_lo", "_id_hi",
        *[F.col(c).alias(f"_o_{c}") for c in lanes],
    )
    hw = half_width if half_width is not None else F.lit(1.0)
    hl = half_length if half_length is not None else F.lit(2.5)
    egos = (
        tracks.withColumn("_cx", F.floor(F.col("x") / cell).cast("long"))
        .withColumn("_cy", F.floor(F.col("y") / cell).cast("long"))
        .withColumn("_hw", hw).withColumn("_hl", hl)
    )
    dx, dy = F.col("_ox") - F.col("x"), F.col("_oy") - F.col("y")
    dist = F.sqrt(dx * dx + dy * dy)
    own = F.xxhash64(id_col)
    other = (F.col("_id_lo") != own) | (F.col("_id_hi") != own)
    near = other & (dist > 1e-6) & (dist <= radius)
    for k in [*keys, "_cx", "_cy"]:
        near = near & (F.col(k) == F.col(f"_k_{k}"))
    pairs = egos.join(spots, near, "left")
    if sector == "lane":
        code = C.lane_sector(dx, F.col("_o_lane_id").cast("long") - F.col("lane_id").cast("long"), F.col("_hl"))
    else:
        theta = F.col("heading")
        code = C.heading_sector(
            C.ego_longitudinal(dx, dy, theta), C.ego_lateral(dx, dy, theta), F.col("_hw"), F.col("_hl")
        )
    kept = [c for c in tracks.columns if c in carry or c in lanes]
    pairs = pairs.withColumn("_d", dist).withColumn("_s", code)
    return pairs.groupBy(*keys, "_cx", "_cy", id_col).agg(
        *[F.first(c).alias(c) for c in kept],
        *[F.min(F.when(F.col("_s") == i, F.col("_d"))).alias(f"dist_{n}") for i, n in enumerate(K.SECTORS)],
    ).drop("_cx", "_cy")


def neighbor_id_distances(
    tracks: DataFrame, keys: list[str] = FRAME, id_col: str = "track_id", carry: list[str] = ()
) -> DataFrame:
    """Distances to the eight neighbours named by id columns; null when the id is 0 or not in the frame."""
    keys, carry = list(keys), list(carry)
    links = tracks.select(
        *keys, id_col, "x", "y",
        F.posexplode(F.array(*[F.col(c).cast("string") for c in K.NEIGHBOR_ID_COLUMNS])).alias("_s", "_other"),
    ).where(F.col("_other") != "0")
    spots = tracks.select(*keys, F.col(id_col).alias("_other"), F.col("x").alias("_ox"), F.col("y").alias("_oy"))
    dist = F.hypot(F.col("_ox") - F.col("x"), F.col("_oy") - F.col("y"))
    found = links.join(spots, [*keys, "_other"]).groupBy(*keys, id_col).agg(
        *[F.min(F.when(F.col("_s") == i, dist)).alias(f"dist_{n}") for i, n in enumerate(K.SECTORS)]
    )
    return tracks.select(*keys, id_col, *carry).join(found, [*keys, id_col], "left")


def feature_row(df: DataFrame) -> Column:
    """The 12 float32 features in contract order; an empty sector becomes the sentinel."""
    moving = [F.col(c).cast("float") for c in ("vx", "ax", "vy", "ay")]
    gaps = [F.coalesce(F.col(f"dist_{n}"), F.lit(K.MISSING_DISTANCE)).cast("float") for n in K.SECTORS]
    return F.array(*moving, *gaps)


def nearest_neighbor(tracks: DataFrame, first_radius: float = 60.0, keys: list[str] = FRAME,
                     id_col: str = "track_id", carry: list[str] = ()) -> DataFrame:
    """Nearest other agent of the same frame without a radius limit: its distance and speed.

    A round joins rows and positions by grid cell and settles the rows that have another agent within its radius. Rows that
    are left stand farther apart than that, so few of them share a cell of the next round, whose radius is twice as large:
    each round compares a position with a bounded number of rows. Rows without another agent, or without finite
    coordinates, have no distance.
    """
    keys, carry, radius = list(keys), list(carry), float(first_radius)
    base = tracks.select(*keys, id_col, "x", "y", F.hypot("vx", "vy").alias("_speed"), *carry)
    placed = F.coalesce(C.finite("x") & C.finite("y"), F.lit(False))
    odd, base = base.where(~placed), base.where(placed)
    spots = base.groupBy(*keys, "x", "y").agg(
        F.min(F.struct(id_col, "_speed")).alias("_lo"), F.max(F.struct(id_col, "_speed")).alias("_hi")
    )
    hit = materialize(_search(base, spots, radius, keys, id_col, carry), "ring")
    done = hit.where(F.col("_best").isNotNull())
    left = hit.where(F.col("_best").isNull()).drop("_best")
    wide = lambda c: F.max(c) - F.min(c)
    frames = spots.join(left.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(
        F.hypot(wide("x"), wide("y")).alias("_extent"), F.min(F.col("_lo")[id_col]).alias("_a"), F.max(F.col("_hi")[id_col]).alias("_b"))
    frames = materialize(frames.where(F.col("_a") != F.col("_b")).select(*keys, "_extent"), "ring-frames")
    nothing = F.lit(None).cast(hit.schema["_best"].dataType)
    alone = left.join(frames, keys, "left_anti").unionByName(odd)
    done = done.unionByName(alone.withColumn("_best", nothing))
    left = left.join(frames, keys, "left_semi")
    widest = frames.agg(F.max("_extent")).first()[0]
    if widest is not None:
        spots = materialize(spots.join(frames.select(*keys), keys, "left_semi"), "ring-spots")
    while widest is not None and not left.isEmpty():
        # The last radius covers the widest frame, rounding included, so every row finds another agent by then.
        radius *= 2.0
        hit = materialize(_search(left, spots, radius, keys, id_col, carry), "ring")
        done = done.unionByName(hit.where(F.col("_best").isNotNull()))
        left = hit.where(F.col("_best").isNull()).drop("_best")
        if radius > widest * 2.0 + 1.0:
            done = done.unionByName(left.withColumn("_best", nothing))
            break
    return done.select(
        *keys, id_col, *carry, F.col("_speed").alias("speed"),
        F.col("_best._d").alias("distance"), F.col("_best._v").alias("neighbor_speed"),
    )


def _best(id_col: str) -> tuple[Column, Column]:
    d = F.hypot(F.col("_ox") - F.col("x"), F.col("_oy") - F.col("y"))
    lo, hi = F.col("_lo"), F.col("_hi")
    pick = F.when(lo[id_col] != F.col(id_col), lo).when(hi[id_col] != F.col(id_col), hi)
    return d, F.when(pick.isNotNull(), F.struct(d.alias("_d"), pick[id_col].alias("_oid"), pick["_speed"].alias("_v")))


def _near_pairs(rows: DataFrame, spots: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Rows with every position whose disc touches their cell, or with none."""
    cell = 2.0 * radius
    reach = _reach(spots, radius, cell).withColumnsRenamed({"x": "_ox", "y": "_oy"})
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    return rows.withColumns({"_cx": at("x"), "_cy": at("y")}).join(reach, [*keys, "_cx", "_cy"], "left")


def _search(rows: DataFrame, spots: DataFrame, radius: float, keys: list[str], id_col: str, carry: list[str]) -> DataFrame:
    d, best = _best(id_col)
    pairs = _near_pairs(rows, spots, radius, keys).withColumn("_cand", F.when(d <= radius, best))
    return pairs.groupBy(*keys, "_cx", "_cy", id_col).agg(
        F.first("x").alias("x"), F.first("y").alias("y"), F.first("_speed").alias("_speed"),
        *[F.first(c).alias(c) for c in carry], F.min("_cand").alias("_best"),
    ).drop("_cx", "_cy")
