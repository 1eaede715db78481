"""Page layout: boxes from polygons, routing of lines, ids, reading order, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sizes in pixels, and shares of the page's width.
MIN_HEIGHT, MIN_WIDTH, MAX_HEIGHT = 15, 80, 120
MARGIN, SHORT = 0.12, 0.35
CAPITAL_RATIO, DOUBLE_RATIO = 1.5, 1.2
Y_SHARE, Y_LEAST = 0.6, 12.0
# Types of lines by their tags, for the two kinds of segmenters.
TAGS = {"default": "main_text", "text": "main_text", "marginalia": "marginalia", "margin": "marginalia", "heading": "heading", "title": "heading", "illustration": "illustration", "drop_capital": "heading"}
BOX_CLASSES = {"text": "main_text", "line": "main_text", "default_line": "main_text", "marginalia": "marginalia", "margin": "marginalia", "heading": "heading", "title": "heading"}


def _lookup(x: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(v) for kv in table.items() for v in kv))[x], F.lit("main_text"))


def tag_type(tag: Column) -> Column:
    return _lookup(F.lower(tag), TAGS)


def box_type(name: Column) -> Column:
    return _lookup(name, BOX_CLASSES)


def tag_of(tags: Column) -> Column:
    """The type in a line's tags as JSON: an object with `type`, which is text or a list of texts or objects; or a text; else default."""
    kind = F.get_json_object(tags, "$.type")
    listed = F.coalesce(F.get_json_object(tags, "$.type[0].type"), F.when(kind.rlike(r'^\["'), F.get_json_object(tags, "$.type[0]")), F.lit("default"))
    named = F.when(kind.startswith("["), listed).when(F.coalesce(kind, F.lit("")) == "", F.lit("default")).otherwise(kind)
    return F.when(F.coalesce(tags, F.lit("")).isin("", "null", "{}", '""'), F.lit("default")).when(tags.startswith("{"), named).otherwise(F.regexp_replace(tags, '^"|"$', ""))


def bbox(polygon: Column) -> Column:
    """(x0, y0, x1, y1) around a polygon."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))


def polygon(boundary: Column, envelope: Column, box: Column, width: Column, height: Column) -> Column:
    """The first that there is: boundary or envelope of three points at least, the box, the page; whole pixels."""
    points = lambda p: F.when(F.size(p) >= 3, F.transform(p, lambda q: F.transform(q, lambda v: v.cast("int"))))
    whole = F.transform(box, lambda v: v.cast("int"))
    return F.coalesce(points(boundary), points(envelope), F.when(F.size(box) == 4, rectangle(whole[0], whole[1], whole[2], whole[3])), rectangle(F.lit(0), F.lit(0), width, height))


def baseline(points: Column) -> Column:
    return F.coalesce(F.transform(points, lambda q: F.transform(q, lambda v: v.cast("int"))), F.array().cast("array<array<int>>"))


def median(values: Column) -> Column:
    """Of an array; the mean of the middle two of an even number."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / F.lit(2.0)


def baseline_y(points: Column, y0: Column, y1: Column) -> Column:
    return F.when(F.size(points) > 0, median(F.transform(points, lambda p: p[1].cast("double")))).otherwise((y0 + y1) / F.lit(2.0))


def is_double_page(width: Column, height: Column) -> Column:
    return F.when(height > 0, width / height).otherwise(0.0) > DOUBLE_RATIO


def route(boxes: DataFrame, method: str = "lines") -> DataFrame:
    """Adds height, width, region_type, route (main, marginalia, discarded) and reason.

    boxes: page_id, det_ord, x0, y0, x1, y1, img_w, tag. method `lines` follows segmenters
    that trace lines: too small, tall (a heading, or a drop capital if also narrow), at a
    margin. `regions` and `boxes` discard all that is too tall; `regions` keeps the
    region's own type, `boxes` maps detector classes.
    """
    if method not in ("lines", "regions", "boxes"):
        raise ValueError(f"unknown method: {method}")
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    small, tall = (h < MIN_HEIGHT) | (w < MIN_WIDTH), h > MAX_HEIGHT
    margin = ((F.col("x0") < F.col("img_w") * MARGIN) | (F.col("x1") > F.col("img_w") * (1 - MARGIN))) & (w < F.col("img_w") * SHORT)
    if method == "lines":
        reason = F.when(small, "too_small").when(tall & (w < h * CAPITAL_RATIO), "drop_capital")
        kind = F.when(margin, "marginalia").when(tall, "heading").otherwise(tag_type(F.coalesce("tag", F.lit("default"))))
    else:
        reason = F.when(small, "too_small").when(tall, "too_tall")
        own = box_type(F.col("tag")) if method == "boxes" else F.coalesce("tag", F.lit("text"))
        kind = F.when(margin, "marginalia").otherwise(own)
    aside = margin if method == "regions" else F.col("region_type") == "marginalia"
    out = boxes.withColumns({"height": h, "width": w, "reason": reason, "region_type": kind})
    return out.withColumn("route", F.when(F.col("reason").isNotNull(), "discarded").when(aside, "marginalia").otherwise("main"))


def number(routed: DataFrame, method: str = "lines") -> DataFrame:
    """Adds line_id: counted by route in the order of detection; detectors' main lines keep the index of their box."""
    at = F.row_number().over(Window.partitionBy("page_id", "route").orderBy("det_ord")) - 1
    main = F.col("det_ord") if method == "boxes" else at
    name = lambda kind, i: F.concat("page_id", F.lit(f"_{kind}_"), F.lpad(i.cast("string"), 4, "0"))
    return routed.withColumn("line_id", F.when(F.col("route") == "main", name("line", main)).when(F.col("route") == "marginalia", name("marg", at)))


def tolerance(lines: DataFrame) -> DataFrame:
    """(page_id, y_tolerance): a share of the median height, 12 at least."""
    return lines.groupBy("page_id").agg(F.greatest(F.median("height") * Y_SHARE, F.lit(Y_LEAST)).alias("y_tolerance"))


def reading_order(lines: DataFrame, *, vertical: bool = False, centre: bool = False) -> DataFrame:
    """Adds reading_order in each page.

    Lines from top to bottom join the group whose running mean height is near, else begin a
    new one; in a group they go from left to right. centre: heights of box centres, not of
    baselines. vertical: by x0, then y0. A page's lines are one array, folded in the JVM;
    nothing is joined back.
    """
    if vertical:
        w = Window.partitionBy("page_id").orderBy("x0", "y0", "det_ord")
        return lines.withColumn("reading_order", F.row_number().over(w) - 1)
    mid = (F.col("y0") + F.col("y1")) / F.lit(2.0)
    y = mid if centre or "baseline" not in lines.columns else baseline_y(F.col("baseline"), F.col("y0"), F.col("y1"))
    line = F.struct(y.cast("double").alias("y"), "x0", "det_ord", (F.col("y1") - F.col("y0")).cast("double").alias("height"), F.struct(*lines.columns).alias("line"))
    pages = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    near = F.greatest(median(F.transform("rows", lambda r: r["height"])) * Y_SHARE, F.lit(Y_LEAST))
    start = F.struct(near.alias("near"), F.lit(-1).alias("group"), F.lit(0.0).alias("mean"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("groups"))

    def joined(a: Column, r: Column) -> Column:
        new = (a["group"] < 0) | (F.abs(r["y"] - a["mean"]) > a["near"])
        group = F.when(new, a["group"] + 1).otherwise(a["group"])
        mean = F.when(new, r["y"]).otherwise((a["mean"] * a["size"] + r["y"]) / (a["size"] + 1))
        return F.struct(a["near"].alias("near"), group.alias("group"), mean.alias("mean"), F.when(new, 1).otherwise(a["size"] + 1).alias("size"), F.concat(a["groups"], F.array(group)).alias("groups"))

    grouped = pages.withColumn("groups", F.aggregate("rows", start, joined, lambda a: a["groups"]))
    # by group, then from left to right; i keeps what is equal in place
    placed = F.array_sort(F.transform(F.arrays_zip("rows", "groups"), lambda z, i: F.struct(z["groups"].alias("g"), z["rows"]["x0"].alias("x0"), i.alias("i"), z["rows"]["line"].alias("line"))))
    return grouped.select(F.posexplode(placed).alias("reading_order", "r")).select("r.line.*", "reading_order")


def region_ids(regions: DataFrame, *, shared: bool = False) -> DataFrame:
    """Adds region_id to (page_id, type_ord, ord): one a region, or shared by all of a type."""
    at = F.col("type_ord") if shared else F.row_number().over(Window.partitionBy("page_id").orderBy("type_ord", "ord")) - 1
    return regions.withColumn("region_id", F.concat("page_id", F.lit("_region_"), F.lpad(at.cast("string"), 3, "0")))


def synthetic_regions(pages: DataFrame, regions: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, region_id, region_type, polygon) over the whole page, for pages with lines and no region."""
    bare = pages.join(lines.select("page_id").distinct(), "page_id", "left_semi").join(regions.select("page_id").distinct(), "page_id", "left_anti")
    zero = F.lit(0)
    return bare.select("page_id", F.concat("page_id", F.lit("_region_000")).alias("region_id"), F.lit("text").alias("region_type"), rectangle(zero, zero, F.col("img_w"), F.col("img_h")).alias("polygon"))


def clipped(lines: DataFrame, target_height: int = 384) -> DataFrame:
    """Lines whose box meets the image, the box cut to it, with the size of their crops."""
    zero = F.lit(0)
    cut = lines.withColumns({"x0": F.greatest(zero, "x0"), "y0": F.greatest(zero, "y0"), "x1": F.least("x1", "img_w"), "y1": F.least("y1", "img_h")})
    cut = cut.filter("x1 > x0 and y1 > y0")
    return cut.withColumns({"crop_h": F.lit(target_height), "crop_w": F.floor((F.col("x1") - F.col("x0")) * F.lit(float(target_height)) / (F.col("y1") - F.col("y0"))).cast("int")})


