"""Box arithmetic. A box is four Columns; ``Box`` only groups them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from broadsheet.functions.text import let


def split_box(df, array: Column):
    """Adds x0, y0, x1, y1 from a box array that is evaluated once."""
    return df.withColumn("_box", array).withColumns(Box.of_array(F.col("_box"))._asdict()).drop("_box")


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def named(cls, prefix: str = "") -> "Box":
        return cls(*[F.col(prefix + side) for side in cls._fields])

    @classmethod
    def of(cls, struct: Column) -> "Box":
        return cls(*[struct[side] for side in cls._fields])

    @classmethod
    def of_array(cls, array: Column) -> "Box":
        return cls(*[F.get(array, F.lit(i)) for i in range(4)])

    def cast(self, kind: str) -> "Box":
        return Box(*[side.cast(kind) for side in self])

    def columns(self, prefix: str = "") -> list[Column]:
        return [side.alias(prefix + name) for name, side in self._asdict().items()]

    def array(self) -> Column:
        return F.array(*self)

    def text(self) -> Column:
        """Printed as a list: ``[x0, y0, x1, y1]``."""
        return F.concat(F.lit("["), F.concat_ws(", ", *[side.cast("string") for side in self]), F.lit("]"))


def _hull(numbers: Column) -> Column:
    """Ordered box of ``array<double>[x0, y0, x1, y1]``."""
    n = [F.get(numbers, F.lit(i)) for i in range(4)]
    return F.array(F.least(n[0], n[2]), F.least(n[1], n[3]), F.greatest(n[0], n[2]), F.greatest(n[1], n[3]))


def _whole(numbers: Column, size: int | None = None) -> Column:
    """The array where all of its entries are numbers (and there are ``size`` of them)."""
    ok = F.forall(numbers, lambda v: v.isNotNull())
    if size is not None:
        ok = ok & (F.size(numbers) == size)
    return F.when(ok, numbers)


def _point_hull(points: Column) -> Column:
    good = F.filter(points, lambda p: F.size(p) >= 2)
    xs, ys = F.transform(good, lambda p: F.get(p, F.lit(0))), F.transform(good, lambda p: F.get(p, F.lit(1)))
    return F.when(F.size(good) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
FOUR_NUMBERS = rf"^\[\s*{NUMBER}(?:\s*,\s*{NUMBER}){{3}}\s*\]$"

# Keys searched for a box, in order.
BOX_KEYS = ("bbox", "coordinate", "box", "poly", "points")


def bbox_array_from_any(raw: Column, depth: int = 2) -> Column:
    """``array<int>`` box of a JSON value: four numbers, a list of points, or an object with either.

    Objects are followed ``depth`` levels down. Fractions are cut towards zero.
    """

    def listed(value: Column) -> Column:
        numbers = F.split(F.translate(value, "[]", ""), ",")
        points = F.from_json(value, "array<array<double>>")
        return (F.when(value.rlike(FOUR_NUMBERS), let(F.transform(numbers, lambda v: v.cast("double")), _hull))
                .when(value.rlike(r"^\[\s*\["), let(points, _point_hull)))

    def inner(value: Column) -> Column:
        fields = F.from_json(value, ",".join(f"{key} string" for key in BOX_KEYS))

        def pick(keys: Column) -> Column:
            first = F.get(F.filter(F.array(*map(F.lit, BOX_KEYS)), lambda k: F.array_contains(keys, k)), F.lit(0))
            return let(fields, lambda v: let(first, lambda f: F.coalesce(*[F.when(f == key, v[key]) for key in BOX_KEYS])))

        return let(F.json_object_keys(value), pick)

    def parse(value: Column, levels: int) -> Column:
        if levels == 0:
            return listed(value)
        nested = let(inner(value), lambda v: parse(v, levels - 1))
        return F.when(F.startswith(value, F.lit("{")), nested).otherwise(listed(value))

    numbers = let(F.trim(raw), lambda value: parse(value, depth))
    return F.transform(numbers, lambda v: v.cast("int"))


def bbox_from_any(raw: Column, depth: int = 2) -> Box:
    """``bbox_array_from_any`` as four Columns."""
    return Box.of_array(bbox_array_from_any(raw, depth))


def bbox_array_for_columns(raw: Column) -> Column:
    """``array<double>`` box of a JSON value for column segmentation; ends are not reordered."""
    corners = (("x0", "y0", "x1", "y1"), ("left", "top", "right", "bottom"), ("x", "y", "width", "height"))
    schema = ",".join(f"{name} double" for names in corners for name in names) + ",points string"

    def point_hull(points: Column) -> Column:
        xs = F.filter(F.transform(points, lambda p: p["x"]), F.isnotnull)
        ys = F.filter(F.transform(points, lambda p: p["y"]), F.isnotnull)
        return F.when((F.size(xs) > 0) & (F.size(ys) > 0),
                      F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))

    def lists(value: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(value, F.lit(NUMBER), F.lit(0)), lambda v: v.cast("double"))
        hull = let(F.from_json(value, "array<struct<x:double,y:double>>"), point_hull)
        return F.when(value.rlike(FOUR_NUMBERS), numbers).when(value.rlike(r"^\[\s*\{"), hull)

    def objects(o: Column) -> Column:
        direct = [_whole(F.array(*[o[name] for name in names])) for names in corners]
        sized = F.array(o["x"], o["y"], o["x"] + o["width"], o["y"] + o["height"])
        return F.coalesce(direct[0], direct[1], _whole(sized), let(F.trim(o["points"]), lists))

    return let(F.trim(raw), lambda value: F.when(
        F.startswith(value, F.lit("{")), let(F.from_json(value, schema), objects)).otherwise(lists(value)))


def bbox_for_columns(raw: Column) -> Box:
    """``bbox_array_for_columns`` as four Columns."""
    return Box.of_array(bbox_array_for_columns(raw))


def model_value_array(raw: Column, width: Column, height: Column) -> Column:
    """``array<int>`` box clamped to the page; text numbers may be fractions, 0-1000 or pixels."""
    sides = F.array(width, height, width, height)

    def pixels(values: Column) -> Column:
        reach = F.array_max(F.transform(values, F.abs))
        return let(reach, lambda r: F.transform(values, lambda v, i: F.bround(
            F.when(r <= 1.5, v * F.get(sides, i))
            .when((r <= 1000) & (F.greatest(width, height) > 1200), v / 1000.0 * F.get(sides, i))
            .otherwise(v), 0).cast("int")))

    texts = F.transform(F.from_json(raw, "array<string>"), lambda v: v.try_cast("double"))
    scaled = let(let(texts, lambda v: _whole(v, 4)), pixels)
    box = let(F.coalesce(bbox_array_from_any(raw), scaled), lambda b: clamp_bbox(Box.of_array(b), width, height).array())
    return F.when(F.get(box, F.lit(0)).isNotNull(), box)


def parse_bbox_text(text: Column) -> Box:
    """Box of the numbers in an attribute: four are a box, six or more (even) a polygon."""

    def hull(numbers: Column) -> Column:
        xs, ys = F.filter(numbers, lambda v, i: i % 2 == 0), F.filter(numbers, lambda v, i: i % 2 == 1)
        usable = (F.size(numbers) >= 4) & (F.size(numbers) % 2 == 0)
        return F.when(usable, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))

    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda v: v.cast("double"))
    return Box.of_array(F.transform(let(numbers, hull), lambda v: F.bround(v, 0).cast("int")))


def bbox_union(box: Box) -> Box:
    """Hull over a group (or, with ``over``, over a window)."""
    return Box(F.min(box.x0), F.min(box.y0), F.max(box.x1), F.max(box.y1))


def bbox_width(box: Box) -> Column:
    return F.greatest(F.lit(0), box.x1 - box.x0)


def bbox_height(box: Box) -> Column:
    return F.greatest(F.lit(0), box.y1 - box.y0)


def bbox_area(box: Box) -> Column:
    return bbox_width(box).cast("long") * bbox_height(box).cast("long")


def center_x(box: Box) -> Column:
    return (box.x0 + box.x1) / 2


def center_y(box: Box) -> Column:
    return (box.y0 + box.y1) / 2


def clamp_bbox(box: Box, width: Column, height: Column) -> Box:
    """Into the page; an axis that collapses is one pixel long."""

    def inside(value: Column, limit: Column) -> Column:
        return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(limit, value)))

    x0, y0, x1, y1 = (inside(v, s) for v, s in zip(box, (width, height, width, height)))
    return Box(x0, y0, F.when(x1 <= x0, F.least(width, x0 + 1)).otherwise(x1),
               F.when(y1 <= y0, F.least(height, y0 + 1)).otherwise(y1))


def clamp_bbox_a(box: Box, width: Column, height: Column) -> Box:
    """Float clamp; reversed ends are swapped."""

    def inside(value: Column, limit: Column) -> Column:
        return F.least(F.greatest(value.cast("double"), F.lit(0.0)), limit.cast("double"))

    x0, y0, x1, y1 = (inside(v, s) for v, s in zip(box, (width, height, width, height)))
    return Box(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def expand_bbox(box: Box, width: Column, height: Column, margin: float = 12.0) -> Box:
    grown = Box(box.x0 - margin, box.y0 - margin, box.x1 + margin, box.y1 + margin)
    return clamp_bbox_a(grown, width, height)


def needs_scaling(max_x: Column, max_y: Column, width: Column, height: Column) -> Column:
    """Boxes reaching (max_x, max_y) on a large page look like 0-1000 coordinates."""
    return (
        (F.least(width, height) >= 1500) & (max_x <= 1100) & (max_y <= 1100)
        & (max_x / F.greatest(width, F.lit(1)) <= 0.6) & (max_y / F.greatest(height, F.lit(1)) <= 0.6)
    )


def page_needs_scaling(box: Box, width: Column, height: Column, page: list[str]) -> Column:
    """``needs_scaling`` decided once for all boxes of a page."""
    over = Window.partitionBy(*page)
    return needs_scaling(F.max(box.x1).over(over), F.max(box.y1).over(over), width, height)


def scale_bbox(box: Box, width: Column, height: Column) -> Box:
    return clamp_bbox(_scaled(box, width, height), width, height)


def _scaled(box: Box, width: Column, height: Column) -> Box:
    # rint is bround to whole numbers, without a BigDecimal for each.
    return Box(*[F.rint(v / 1000 * s).cast("int") for v, s in zip(box, (width, height, width, height))])


def normalize_bbox(box: Box, width: Column, height: Column) -> Box:
    """Scale or clamp one box, judged on its own."""
    return normalize_bboxes(box, width, height, needs_scaling(box.x1, box.y1, width, height))


def normalize_bboxes(box: Box, width: Column, height: Column, scale: Column) -> Box:
    """Scale or clamp a box after the page-wide decision ``scale``."""
    return clamp_bbox(Box(*[F.when(scale, a).otherwise(b) for a, b in zip(_scaled(box, width, height), box)]), width, height)


def box_contains(outer: Box, inner: Box) -> Column:
    return (outer.x0 <= inner.x0) & (outer.y0 <= inner.y0) & (outer.x1 >= inner.x1) & (outer.y1 >= inner.y1)


def intersection_area(a: Box, b: Box) -> Column:
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w > 0) & (h > 0), w.cast("long") * h.cast("long")).otherwise(F.lit(0).cast("long"))


def h_overlap_ratio(a: Box, b: Box) -> Column:
    """Shared width over the narrower width; widths count as one pixel at least."""
    shared = F.greatest(F.lit(0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    return shared / F.least(F.greatest(F.lit(1), a.x1 - a.x0), F.greatest(F.lit(1), b.x1 - b.x0))


def bbox_distance(a: Box, b: Box) -> Column:
    return F.sqrt(F.pow(center_x(a) - center_x(b), 2) + F.pow(center_y(a) - center_y(b), 2))
