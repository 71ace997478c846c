"""Spatial joins as equi joins on the cells of a hierarchical grid, with an exact test afterwards.

A box belongs to the level whose cells are just as wide as the box or wider, so it touches four of them at most.  Two
boxes meet one level below that of the larger one, where the larger touches 25 cells at most: its own cells would hold
many rows beside it.  The larger is listed in those cells, the smaller in the cells it touches on every such level the
other side has from its own upwards.  A country among fields therefore costs 25 cells at most and not one for each
field-sized cell of its area.  A pair found in several cells is kept only in the one that holds the lower-left
corner of the common box, so no de-duplication is needed.  The levels a side has are one row that travels as a broadcast;
no job runs while a plan is built, and cells that hold far more rows than others are split by adaptive execution.

A point or an upright rectangle is its own box, so pairs of these need no test after the join; all other pairs do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import geo
from fieldspark.plans.keyjoin import join_on
from fieldspark.plans.ordered import Sequence

BOX = ("xmin", "ymin", "xmax", "ymax")
# Cells of one level are so many times as wide as those of the level below; the lowest level's are about 1e-6 wide.
_STEP, _LOWEST = 4.0, -10


def with_box(df: DataFrame, geom: str, kind: str = "polygon") -> DataFrame:
    """Add the bounding box of a point, line (array) or polygon (ring array)."""
    g = F.col(geom)
    if kind == "point":
        return df.withColumns({"xmin": g.x, "ymin": g.y, "xmax": g.x, "ymax": g.y})
    pts = F.flatten(g) if kind == "polygon" else g
    x, y = F.transform(pts, lambda p: p.x), F.transform(pts, lambda p: p.y)
    return df.withColumns(
        {"xmin": F.array_min(x), "ymin": F.array_min(y), "xmax": F.array_max(x), "ymax": F.array_max(y)}
    )


def _leveled(df: DataFrame, name: str) -> DataFrame:
    """The rows with their columns renamed, their boxes and levels; rows without a box drop out."""
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    level = F.greatest(F.ceil(F.log(_STEP, side)).cast("int"), F.lit(_LOWEST))
    d = df.filter(F.col("xmin").isNotNull() & F.col("ymin").isNotNull() & side.isNotNull())
    # Plain columns up to the join: Spark prunes the fields of a struct wrongly below explode.
    kept = [F.col(f"`{c}`").alias(f"_{name}_{i}") for i, c in enumerate(df.columns)]
    # The logarithm of 0 is null.
    own = F.coalesce(level, F.lit(_LOWEST)).alias(f"_{name}_own")
    return d.select(*kept, *[F.col(c).cast("double").alias(f"_{name}_{c}") for c in BOX], own)


def _cells(df: DataFrame, name: str, levels: Column) -> DataFrame:
    """One row per cell that the box touches on each of the levels."""

    def span(axis: str, size: Column) -> Column:
        return F.sequence(F.floor(F.col(f"_{name}_{axis}min") / size), F.floor(F.col(f"_{name}_{axis}max") / size))

    def on(level: Column) -> Column:
        size = F.pow(F.lit(_STEP), level)
        cell = lambda x: lambda y: F.struct(level.alias("level"), x.alias("x"), y.alias("y"))
        return F.flatten(F.transform(span("x", size), lambda x: F.transform(span("y", size), cell(x))))

    return df.withColumn("_cell", F.explode(F.flatten(F.transform(levels, on))))


def _meet(larger: DataFrame, smaller: DataFrame, equal: bool, names: tuple[str, str], points: bool = False) -> DataFrame:
    """Pairs whose first box is on a higher level, or on the same one if `equal`; ``points`` says the second ones are points."""
    own_level, level = f"_{names[0]}_own", F.col(f"_{names[1]}_own")
    own = _cells(larger, names[0], F.array(F.col(own_level) - 1)).drop(own_level)
    # One row: the levels of the larger side.
    levels = larger.agg(F.sort_array(F.collect_set(own_level)).alias("_levels"))
    from_own = F.filter("_levels", lambda v: (v >= level) if equal else (v > level))
    below = F.transform(from_own, lambda v: v - 1)
    up = _cells(smaller.crossJoin(F.broadcast(levels)), names[1], below).drop("_levels", f"_{names[1]}_own")
    # Plain keys sort faster than a struct.
    keys = {"_cx": F.col("_cell.x"), "_cy": F.col("_cell.y"), "_cl": F.col("_cell.level")}
    own = own.withColumns(keys).drop("_cell")
    if not points:
        # The cell's corners; exact, as sizes are powers of two.  A point is in one cell of a level anyway.
        size = F.pow(F.lit(_STEP), F.col("_cl"))
        corners = {f"_{c}{i}": (F.col(f"_c{c}") + i) * size for c in "xy" for i in (0, 1)}
        own = own.withColumns(corners)
    # Never a broadcast: a table of few files has few tasks, and they would make all the pairs.
    pairs = own.hint("merge").join(up.withColumns(keys).drop("_cell"), list(keys))
    x, y = F.greatest("_a_xmin", "_b_xmin"), F.greatest("_a_ymin", "_b_ymin")
    common = (x <= F.least("_a_xmax", "_b_xmax")) & (y <= F.least("_a_ymax", "_b_ymax"))
    if points:
        return pairs.filter(common)
    return pairs.filter(common & (x >= F.col("_x0")) & (x < F.col("_x1")) & (y >= F.col("_y0")) & (y < F.col("_y1")))


def box_join(a: DataFrame, b: DataFrame, self_join: str | None = None, points: str | None = None) -> DataFrame:
    """All pairs (structs ``a`` and ``b``) of rows whose boxes share a point.

    ``self_join`` names an id: each unordered pair is then returned once.  ``points`` names the side, "a" or "b", whose
    boxes are all points: none of them can be the larger one, which saves a join.
    """
    left, right = _leveled(a, "a"), _leveled(b, "b")
    if points == "b":
        pairs = _meet(left, right, True, ("a", "b"), True)
    else:
        pairs = _meet(right, left, True, ("b", "a"), points == "a")
        if points != "a":
            pairs = pairs.unionByName(_meet(left, right, False, ("a", "b")))
    rows = [F.struct(*[F.col(f"_{n}_{i}").alias(c) for i, c in enumerate(df.columns)]).alias(n) for n, df in (("a", a), ("b", b))]
    pairs = pairs.select(*rows)
    return pairs.filter(F.col(f"a.{self_join}") < F.col(f"b.{self_join}")) if self_join else pairs


def _edges(parts: Column) -> Column:
    """Vertex pairs of all lines or closed rings."""

    def one(p: Column) -> Column:
        n = F.size(p)
        return F.zip_with(
            F.slice(p, 1, F.greatest(n - 1, F.lit(0))),
            F.slice(p, 2, F.greatest(n - 1, F.lit(0))),
            lambda u, v: F.struct(u.alias("p"), v.alias("q")),
        )

    return F.flatten(F.transform(parts, one))


def _closed(rings: Column) -> Column:
    return F.transform(rings, lambda r: F.concat(r, F.slice(r, 1, 1)))


def _side(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x))


def _touch(s: Column, t: Column) -> Column:
    """Two segments share a point."""

    def boxed(a: Column, b: Column, c: Column) -> Column:
        return c.x.between(F.least(a.x, b.x), F.greatest(a.x, b.x)) & c.y.between(
            F.least(a.y, b.y), F.greatest(a.y, b.y)
        )

    d1, d2 = _side(s.p, s.q, t.p), _side(s.p, s.q, t.q)
    d3, d4 = _side(t.p, t.q, s.p), _side(t.p, t.q, s.q)
    return (
        ((d1 * d2 < 0) & (d3 * d4 < 0))
        | ((d1 == 0) & boxed(s.p, s.q, t.p))
        | ((d2 == 0) & boxed(s.p, s.q, t.q))
        | ((d3 == 0) & boxed(t.p, t.q, s.p))
        | ((d4 == 0) & boxed(t.p, t.q, s.q))
    )


def intersects(a: Column, kind_a: str, b: Column, kind_b: str) -> Column:
    """Exact test for points, lines and polygons with holes."""
    order = {"point": 0, "line": 1, "polygon": 2}
    if order[kind_a] > order[kind_b]:
        a, kind_a, b, kind_b = b, kind_b, a, kind_a
    if kind_a == "point" and kind_b == "point":
        return (a.x == b.x) & (a.y == b.y)
    parts_b = _closed(b) if kind_b == "polygon" else F.array(b)
    if kind_a == "point":
        dot = F.struct(a.alias("p"), a.alias("q"))
        on_edge = F.exists(_edges(parts_b), lambda e: _touch(e, dot))
        return on_edge if kind_b == "line" else on_edge | geo.in_polygon(a.x, a.y, b)
    parts_a = _closed(a) if kind_a == "polygon" else F.array(a)
    cross = geo.bind(
        _edges(parts_b),
        lambda eb: F.exists(_edges(parts_a), lambda s: F.exists(eb, lambda t: _touch(s, t))),
    )
    if kind_b == "line":
        return cross
    start = F.element_at(F.element_at(parts_a, 1), 1)
    inside = geo.in_polygon(start.x, start.y, b)
    if kind_a == "polygon":
        other = F.element_at(F.element_at(parts_b, 1), 1)
        inside = inside | geo.in_polygon(other.x, other.y, a)
    return cross | inside


def _is_box(geom: Column, kind: str) -> Column:
    """Whether a geometry is the whole of its bounding box: a point, or one upright rectangle as the only ring."""
    if kind != "polygon":
        return F.lit(kind == "point")
    ring = F.element_at(geom, 1)
    p = [F.get(ring, F.lit(i)) for i in range(4)]
    turns = lambda u, v: (
        (p[0][u] == p[1][u]) & (p[1][v] == p[2][v]) & (p[2][u] == p[3][u]) & (p[3][v] == p[0][v])
    )
    # An open ring of four corners, or a closed one of five.
    corners = (F.size(ring) == 4) | ((F.size(ring) == 5) & (F.get(ring, F.lit(4)) == p[0]))
    upright = turns("x", "y") | turns("y", "x")
    return F.coalesce((F.size(geom) == 1) & corners & upright, F.lit(False))


def spatial_join(
    a: DataFrame,
    b: DataFrame,
    kind_a: str = "point",
    kind_b: str = "polygon",
    geom_a: str = "geom",
    geom_b: str = "geom",
    self_join: str | None = None,
) -> DataFrame:
    """Pairs of features that intersect, as structs ``a`` and ``b``.

    ``self_join`` names an id: each unordered pair is then returned once.
    """
    points = "a" if kind_a == "point" else "b" if kind_b == "point" else None
    left, right = with_box(a, geom_a, kind_a), with_box(b, geom_b, kind_b)
    box_a, box_b = _is_box(F.col(geom_a), kind_a), _is_box(F.col(geom_b), kind_b)
    exact = intersects(F.col(f"a.{geom_a}"), kind_a, F.col(f"b.{geom_b}"), kind_b)

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        return box_join(x, y, self_join=self_join, points=points)

    # Apart, as the exact test would make the join of plain boxes slow.
    sides = [(left, right, False)]
    if "line" not in (kind_a, kind_b):
        sides = [(left.filter(box_a), right.filter(box_b), True), (left, right.filter(~box_b), False)]
        if kind_a != "point":
            sides.append((left.filter(~box_a), right.filter(box_b), False))
    out = None
    for x, y, whole in sides:
        found = pairs(x, y) if whole else pairs(x, y).filter(exact)
        out = found if out is None else out.unionByName(found)
    return out


def extract_by_location(
    a: DataFrame,
    b: DataFrame,
    key: str,
    kind_a: str = "polygon",
    kind_b: str = "point",
    geom_a: str = "geom",
    geom_b: str = "geom",
) -> DataFrame:
    """Features of A that intersect any feature of B.

    Points of B are thinned to one in each sixteenth of a cell first; only features that none of these hits meet them all.
    """

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        return spatial_join(x, y, kind_a, kind_b, geom_a, geom_b).select(F.col(f"a.{key}").alias(key)).distinct()

    if kind_b != "point" or kind_a == "point":
        return a.join(met(a, b), key, "left_semi")
    levels = _leveled(with_box(a, geom_a, kind_a), "a").agg(F.collect_set("_a_own").alias("_levels"))
    size = F.pow(F.lit(_STEP), F.col("_level") - 2)
    g = F.col(geom_b)
    tiled = b.select(geom_b).crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels"))
    few = tiled.groupBy("_level", F.floor(g.x / size).alias("_cx"), F.floor(g.y / size).alias("_cy")).agg(F.min(geom_b).alias(geom_b))
    hit = a.join(met(a, few.select(geom_b).distinct()), key, "left_semi")
    rest = a.join(hit.select(key).distinct(), key, "left_anti")
    return hit.unionByName(rest.join(met(rest, b), key, "left_semi"))


# Administrative levels of the looked-up place names.
ADMIN_LEVELS = {"municipality": 8, "district": 5, "state": 4, "region": 3}


def reverse_geocode(
    points: DataFrame, admin: DataFrame, key: str = "fid", geom: str = "geom", rings: str = "rings"
) -> DataFrame:
    """Names of the administrative areas that contain each point; null where none does."""
    # The largest name is found by its place among all names: long sums up in a hash table, text must be sorted.
    known = admin.filter(F.col("name").isNotNull()).select("name").distinct()
    known = Sequence(known, [], ["name"]).number("_place").result().select("name", "_place")
    placed = admin.join(known, "name").select("admin_level", "_place", rings)
    hits = spatial_join(points, placed, "point", "polygon", geom, rings)
    level, place = F.col("b.admin_level"), F.col("b._place")
    names = hits.groupBy(F.col(f"a.{key}").alias(key)).agg(
        *[F.max(F.when(level == v, place)).alias(f"_{n}") for n, v in ADMIN_LEVELS.items()]
    )
    for n in ADMIN_LEVELS:
        of = known.select(F.col("name").alias(n), F.col("_place").alias(f"_{n}"))
        names = names.join(of, f"_{n}", "left").drop(f"_{n}")
    return join_on(points, names, [key], "left")
