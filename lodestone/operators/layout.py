"""What of a page isn't to be seen: hidden runs and spans, boxes under opaque covers, traces of drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import policy

COVERED_FROM, OPAQUE_FROM = 0.8, 0.95


def covered_fraction(text: str, cover: str) -> Column:
    """The part of box ``text`` (x0, y0, x1, y1) within box ``cover``; 0 for a box without area."""
    t, c = (lambda k, p=p: F.col(f"{p}.{k}") for p in (text, cover))
    width = F.greatest(F.least(t("x1"), c("x1")) - F.greatest(t("x0"), c("x0")), F.lit(0.0))
    height = F.greatest(F.least(t("y1"), c("y1")) - F.greatest(t("y0"), c("y0")), F.lit(0.0))
    area = (t("x1") - t("x0")) * (t("y1") - t("y0"))
    return F.coalesce(F.try_divide(width * height, F.when((t("x1") > t("x0")) & (t("y1") > t("y0")), area)), F.lit(0.0))


def _level(box: Column) -> Column:
    """The level of the grid on which a box is no larger than a cell: cells of level n are 2^n wide and high. Null for a box
    without area, which meets nothing."""
    size = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"])
    sound = (box["x1"] > box["x0"]) & (box["y1"] > box["y0"])
    return F.when(sound, F.greatest(F.lit(0), F.ceil(F.log2(size))).cast("int"))


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("bigint")


def _placed(rows: DataFrame, keys: list[str], box: str, level: Column) -> DataFrame:
    """Each row once for each cell of a level that its box touches, at most four from its own level on."""
    b = F.col(box)
    rows = rows.withColumn("_level", level)
    across = lambda x, y: F.explode(F.sequence(_cell(b[x], F.col("_level")), _cell(b[y], F.col("_level"))))
    return rows.withColumn("_x", across("x0", "x1")).withColumn("_y", across("y0", "y1")).select(*keys, "_level", "_x", "_y", box)


def meeting(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, s): rows of two tables of boxes (keys, x0, y0, x1, y1, …) as structs, for each pair of one key that shares an
    area, once.

    Boxes lie on a grid of as many levels as there are sizes; a box looks for others of its own size or larger in the few
    cells of each level that it touches, so no two boxes are compared that don't touch one cell. A pair that meets in
    several cells counts in that of the corner where the common area begins.
    """
    held = [rows.withColumn(name, F.struct(*[F.col(c) for c in rows.columns])).withColumn("_own", _level(F.col(name))).where("_own IS NOT NULL").select(*keys, name, "_own") for rows, name in ((left, "t"), (right, "s"))]
    top = held[0].select(*keys, "_own").union(held[1].select(*keys, "_own")).groupBy(*keys).agg(F.max("_own").alias("_top"))
    cell = [*keys, "_level", "_x", "_y"]
    corner = [F.greatest("t.x0", "s.x0"), F.greatest("t.y0", "s.y0")]
    once = (F.col("_x") == _cell(corner[0], F.col("_level"))) & (F.col("_y") == _cell(corner[1], F.col("_level")))
    out = None
    for small, large, name, other, above in ((held[0], held[1], "t", "s", 0), (held[1], held[0], "s", "t", 1)):
        upper = small.join(top, keys).where(F.col("_own") + above <= F.col("_top")).withColumn("_up", F.explode(F.sequence(F.col("_own") + above, F.col("_top"))))
        found = _placed(upper, keys, name, F.col("_up")).join(_placed(large, keys, other, F.col("_own")), cell).where(overlap(F.col("t"), F.col("s")) & once).select(*keys, "t", "s")
        out = found if out is None else out.union(found)
    return out


def occluded(texts: DataFrame, covers: DataFrame) -> DataFrame:
    """The texts (page, seq, x0, y0, x1, y1) that a cover of their page with a later seq and enough opacity hides."""
    pairs = meeting(texts, covers.where(F.col("opacity") >= OPAQUE_FROM), ["page"])
    hidden = pairs.where((F.col("s.seq") > F.col("t.seq")) & (covered_fraction("t", "s") >= COVERED_FROM)).select("t").distinct()
    return texts.withColumn("_t", F.struct(*texts.columns)).join(hidden, F.col("_t").eqNullSafe(F.col("t")), "left_semi").drop("_t")


def hidden_run(vanish: Column, web_hidden: Column, color: Column, highlight: Column, size: Column) -> Column:
    """A run of a text document: switched off, near white without a background to show it, or a point high at most."""
    shown = F.coalesce(~F.lower(highlight).isin("none", "white"), F.lit(False))
    return F.coalesce(vanish, F.lit(False)) | F.coalesce(web_hidden, F.lit(False)) | (policy.is_near_white(color) & ~shown) | F.coalesce(size <= 1, F.lit(False))


def hidden_style(hidden: Column, color: Column, size: Column) -> Column:
    """A character style: switched off, near white, or a point high at most."""
    return F.coalesce(hidden, F.lit(False)) | policy.is_near_white(color) | F.coalesce(size <= 1, F.lit(False))


def overlap(a: Column, b: Column) -> Column:
    """Whether two boxes (x0, y0, x1, y1) share an area."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def hidden_span(color: Column, size: Column, opacity: Column, box: Column, page: Column) -> Column:
    """A span of a page: near white, a point high at most, all but transparent, or off the page."""
    return policy.is_near_white(color) | F.coalesce(size <= 1, F.lit(False)) | F.coalesce(opacity <= 0.05, F.lit(False)) | ~overlap(box, page)


def color_hex(value: Column) -> Column:
    """A colour out of a number."""
    return F.concat(F.lit("#"), F.lpad(F.hex(value.bitwiseAND(F.lit(0xFFFFFF))), 6, "0"))


def opacity(value: Column) -> Column:
    """An opacity of 0 to 1; greater numbers are of 255."""
    return F.when(value > 1, value / F.lit(255.0)).otherwise(value)


def trace_color(channels: Column) -> Column:
    """A colour out of one grey or three channels of 0 to 1; null out of two or none."""
    three = F.when(F.size(channels) == 1, F.array_repeat(channels[0], 3)).when(F.size(channels) >= 3, channels)
    byte = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(x * 255))).cast("bigint")), 2, "0")
    return F.when(three.isNotNull(), F.concat(F.lit("#"), *[byte(three[i]) for i in range(3)]))


def traced(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """(page, trace, span) of traces and spans (page, trace or span, key, x0, y0, x1, y1) that are of one text and share an
    area; a trace whose text no span of its page has goes to the spans of which, or of itself, half is shared."""
    half = (covered_fraction("t", "s") >= 0.5) | (covered_fraction("s", "t") >= 0.5)
    out = ["t.page", "t.trace", "s.span"]
    same = meeting(traces, spans, ["page", "key"]).select(*out)
    alone = traces.join(spans.select("page", "key").distinct(), ["page", "key"], "left_anti")
    return same.union(meeting(alone.select(*traces.columns), spans, ["page"]).where(half).select(*out))
