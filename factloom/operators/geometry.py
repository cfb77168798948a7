"""Where facts lie on pages: spans, boxes of lines and fragments, confidence of the recognised text.

lines(doc_id, page, line, text, x, y, w, h, confidence, parts) are a page's lines in order; parts (may be missing) are
array<struct<at,to,x,y,w,h>>, pieces of a line with boxes of their own. Coordinates are shares of the page.

Defined results: a place outside all pages or lines has no span and no boxes; null texts count as empty lines; spans
that repeat are boxed alike; confidence over nothing is 0; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import layout

BOX = ("x", "y", "w", "h")


def line_places(lines: DataFrame) -> DataFrame:
    """Adds begins and ends: where each line stands in its page's text, lines being joined by a line feed."""
    size = F.length(F.coalesce("text", F.lit("")))
    before = F.sum(size + 1).over(Window.partitionBy("doc_id", "page").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("begins", F.coalesce(before, F.lit(0)).cast("long")).withColumn("ends", F.col("begins") + size)


def spans(places: DataFrame, pages: DataFrame) -> DataFrame:
    """places(doc_id, at, to) of a document's full text on the page where they begin, clipped to it: page, page_at, page_to, quote."""
    own = layout.offsets(pages).select("doc_id", "page", "text", "begins")
    met = places.join(own, "doc_id").where(F.col("begins") <= F.col("at"))
    last = met.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "at", "to").orderBy(F.desc("begins")))).where("rn = 1").drop("rn")
    stop = F.least(F.col("to") - F.col("begins"), F.length("text").cast("long"))
    out = last.withColumns({"page_at": F.col("at") - F.col("begins"), "page_to": stop}).where("page_at < page_to")
    return out.withColumn("quote", F.expr("substring(text, int(page_at) + 1, int(page_to - page_at))")).drop("text", "begins")


def covered(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """spans(span_id, doc_id, page, page_at, page_to) and the lines they cover: own_at and own_to within the line."""
    met = spans.join(line_places(lines), ["doc_id", "page"]).where((F.col("page_at") < F.col("ends")) & (F.col("page_to") > F.col("begins")) & (F.col("begins") < F.col("ends")))
    return met.withColumns({"own_at": F.greatest(F.lit(0), F.col("page_at") - F.col("begins")), "own_to": F.least("page_to", "ends") - F.col("begins")})


def sliced(box: Column, at: Column, to: Column, size: Column) -> Column:
    """The share at..to of a box of so many characters, by its width."""
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), at / F.greatest(size, F.lit(1))))
    b = F.greatest(a, F.least(F.lit(1.0), to / F.greatest(size, F.lit(1))))
    return F.struct((box["x"] + box["w"] * a).alias("x"), box["y"].alias("y"), (box["w"] * (b - a)).alias("w"), box["h"].alias("h"))


def boxes(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """span_id, line and the boxes of each span: slices of its lines, or of their parts where those are known."""
    met = covered(spans, lines if "parts" in lines.columns else lines.withColumn("parts", F.expr("cast(null as array<struct<at:int,to:int,x:double,y:double,w:double,h:double>>)")))
    whole = F.array(sliced(F.struct(*BOX), F.col("own_at"), F.col("own_to"), F.col("ends") - F.col("begins")))
    inside = F.filter("parts", lambda p: (p["at"] < F.col("own_to")) & (p["to"] > F.col("own_at")))
    pieces = F.transform(inside, lambda p: sliced(p, F.greatest(F.col("own_at") - p["at"], F.lit(0)), F.least(F.col("own_to"), p["to"]) - p["at"], p["to"] - p["at"]))
    own = F.when(F.coalesce(F.size("parts"), F.lit(0)) > 0, pieces).otherwise(whole)
    return met.select("span_id", "line", F.explode(own).alias("b")).select("span_id", "line", "b.*")


def united(boxes: DataFrame, *keys: str) -> DataFrame:
    """The least box around all boxes of a key."""
    far = boxes.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("t"))
    return far.select(*keys, "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("t") - F.col("y")).alias("h"))


def span_confidence(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """span_id and the lowest confidence of the lines it covers; 0 if it covers none."""
    low = covered(spans, lines).groupBy("span_id").agg(F.min("confidence").alias("confidence"))
    return spans.select("span_id").distinct().join(low, "span_id", "left").select("span_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def page_confidence(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page and the mean confidence of its lines; 0 if it has none."""
    mean = lines.groupBy("doc_id", "page").agg(F.avg("confidence").alias("confidence"))
    return pages.select("doc_id", "page").distinct().join(mean, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def highlights(boxes: DataFrame, crops: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Rectangles on the page: those of glyphs(span_id, x, y, w, h) where a span has any of positive size, else its boxes scaled to the
    crop box of its page (crops: span_id, crop_x, crop_y, crop_w, crop_h)."""
    exact = glyphs.where("w > 0 and h > 0").select("span_id", *BOX)
    scaled = boxes.join(exact.select("span_id").distinct(), "span_id", "left_anti").join(crops, "span_id")
    scaled = scaled.select("span_id", (F.col("crop_x") + F.col("x") * F.col("crop_w")).alias("x"), (F.col("crop_y") + F.col("y") * F.col("crop_h")).alias("y"), (F.col("w") * F.col("crop_w")).alias("w"), (F.col("h") * F.col("crop_h")).alias("h"))
    return exact.unionByName(scaled)


def extra_spans(spans: DataFrame) -> DataFrame:
    """spans(fact, n, at, to): the first of each fact, and of the others those not inside it."""
    first = F.first(F.struct("at", "to")).over(Window.partitionBy("fact").orderBy("n"))
    return spans.withColumn("first", first).where("n = 0 or at < first.at or to > first.to").drop("first")
