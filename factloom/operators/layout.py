"""Pages, their offsets and chunks, and rows of scanned fragments.

Defined results: a null text counts as an empty page; pages that share a document and number are taken in the order of
their texts; a document without pages has no rows; quotes under three characters and null ones are found nowhere;
repeated fragments stay apart; other columns are left aside; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_GAP = 2  # pages are joined by a blank line


def offsets(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text) with the place where each page begins in the full text."""
    before = F.sum(F.length("text") + PAGE_GAP).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    return pages.withColumn("begins", F.coalesce(before, F.lit(0)).cast("long"))


def full_text(pages: DataFrame) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    return pages.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("full_text"))


def page_at(places: DataFrame, pages: DataFrame) -> DataFrame:
    """places(doc_id, at): the page that holds each place, by the last page beginning at or before it."""
    starts = offsets(pages).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("begins", "page"))).alias("starts"))
    held = F.element_at(F.filter("starts", lambda s: s["begins"] <= F.col("at")), -1)
    return places.join(starts, "doc_id").select("doc_id", "at", held["page"].alias("page"), (F.col("at") - held["begins"]).alias("within"))


def prompt_body(pages: DataFrame, budget: int) -> DataFrame:
    """Pages in tags until the next would pass the budget; truncated tells that one was left out."""
    tagged = F.concat(F.format_string("<page number=\"%d\">\n", F.col("page") + 1), "text", F.lit("\n</page>\n"))
    order = Window.partitionBy("doc_id").orderBy("page")
    rows = pages.withColumn("body", tagged).withColumn("so_far", F.sum(F.length("body")).over(order))
    rows = rows.withColumn("fits", F.min((F.col("so_far") <= budget).cast("int")).over(order) == 1)
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("page", "body")))), lambda p: p["body"])
    return rows.groupBy("doc_id").agg(F.array_join(kept, "").alias("body"), (~F.min("fits")).alias("truncated"))


def cut_at_lines(lines: Column, size: int) -> Column:
    """Lines joined into pieces of up to size characters; a longer line is a piece of its own."""
    return F.aggregate(
        lines, F.array().cast("array<string>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + 1 + F.length(x) <= size),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit("\n"), x)))).otherwise(F.array_append(acc, x)),
    )


def chunks(pages: DataFrame, size: int) -> DataFrame:
    """Greedy packing of pages into chunks: a page joins the chunk while the sum stays within size. An oversize
    page is cut at lines first. The fold runs in order over each document's own array."""
    small = cut_at_lines(F.split("text", "\n"), size)
    pieces = pages.select("doc_id", "page", F.posexplode(F.when(F.length("text") <= size, F.array("text")).otherwise(small)).alias("piece", "text"))
    rows = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "piece", F.length("text").cast("long").alias("n")))).alias("pages"))
    state = "struct<chunk:int,used:bigint,out:array<struct<page:int,piece:int,chunk:int>>>"
    start = F.expr(f"cast(named_struct('chunk', 0, 'used', 0, 'out', array()) as {state})")

    def step(acc, p):
        fresh = (acc["used"] > 0) & (acc["used"] + p["n"] > size)
        chunk = F.when(fresh, acc["chunk"] + 1).otherwise(acc["chunk"])
        used = F.when(fresh, p["n"]).otherwise(acc["used"] + p["n"])
        row = F.struct(p["page"].cast("int").alias("page"), p["piece"].cast("int").alias("piece"), chunk.cast("int").alias("chunk"))
        return F.struct(chunk.cast("int").alias("chunk"), used.cast("bigint").alias("used"), F.array_append(acc["out"], row).alias("out")).cast(state)

    return rows.select("doc_id", F.explode(F.aggregate("pages", start, step)["out"]).alias("c")).select("doc_id", "c.page", "c.piece", "c.chunk")


def chunk_texts(pages: DataFrame, size: int) -> DataFrame:
    """doc_id, chunk and the text of each chunk: its pages, or pieces of them, parted by blank lines."""
    line = F.split("text", "\n")
    small = cut_at_lines(line, size)
    pieces = pages.select("doc_id", "page", F.posexplode(F.when(F.length("text") <= size, F.array("text")).otherwise(small)).alias("piece", "text"))
    rows = chunks(pages, size).join(pieces, ["doc_id", "page", "piece"])
    kept = F.transform(F.array_sort(F.collect_list(F.struct("page", "piece", "text"))), lambda p: p["text"])
    return rows.groupBy("doc_id", "chunk").agg(F.array_join(kept, "\n\n").alias("text"))


def scanned_rows(fragments: DataFrame) -> DataFrame:
    """fragments(page_id, text, x, y, w, h, confidence) in reading order: those on one visual row become one line. Each fragment,
    from the top down and left to right, is compared with the one before it and with how far the row reaches so far: a fold over
    its page. Fragments at one place go by text, then size. Fragments without text are left out; a missing place begins a row of its own."""
    trimmed = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    own = fragments.select("page_id", trimmed.alias("text"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "confidence"))).where("text <> ''")
    own = own.withColumn("top", F.col("y") + F.col("h"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("top")).alias("down"), "x", "text", "y", "w", "h", "top", "confidence")))
    pages = own.groupBy("page_id").agg(order.alias("fragments"))
    state = "struct<row:int,right:double,y:double,h:double,top:double,rows:array<int>>"

    def step(acc, f):
        least = F.least(acc["h"], f["h"])
        overlap = (F.least(acc["top"], f["top"]) - F.greatest(acc["y"], f["y"])) / F.when(least > 0, least)
        joins = F.coalesce((overlap > 0.5) & (f["x"] >= acc["right"] - 0.01), F.lit(False))
        row, right = F.when(joins, acc["row"]).otherwise(acc["row"] + 1), F.when(joins, F.greatest(acc["right"], f["x"] + f["w"])).otherwise(f["x"] + f["w"])
        return F.struct(row.alias("row"), right.alias("right"), f["y"].alias("y"), f["h"].alias("h"), f["top"].alias("top"), F.array_append(acc["rows"], row).alias("rows")).cast(state)

    start = F.expr(f"cast(named_struct('row', -1, 'right', null, 'y', null, 'h', null, 'top', null, 'rows', array()) as {state})")
    told = pages.select("page_id", "fragments", F.aggregate("fragments", start, step)["rows"].alias("rows"))
    each = told.select("page_id", F.posexplode(F.arrays_zip("fragments", "rows")).alias("place", "z")).select("page_id", "place", F.col("z.rows").alias("row"), "z.fragments.*")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("x", "place", "text"))), lambda t: t["text"])
    rows = each.groupBy("page_id", "row").agg(
        F.array_join(texts, "  ").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max("top").alias("top"), F.min("confidence").alias("confidence")
    )
    return rows.select("page_id", "row", "text", "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("top") - F.col("y")).alias("h"), "confidence")


def sideways(lines: DataFrame) -> DataFrame:
    """Pages of which most long lines are taller than wide."""
    long = lines.where(F.length("text") >= 8)
    return long.groupBy("page_id").agg(((F.count(F.lit(1)) >= 2) & (F.avg((F.col("h") > 1.5 * F.col("w")).cast("int")) > 0.6)).alias("sideways"))


#: Words of a quote by which it is looked up.
RUN = 5


def word_runs(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and the hash of every run of k words of docs(doc_id, text)."""
    words = F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # exploding one row to one row keeps the words from being put into the lambda below, to be cut anew for every run
    rows = docs.select("doc_id", F.explode(F.array(F.transform(words, lambda w: F.xxhash64(w)))).alias("each"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("each") - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("each", i, F.lit(k))))
    return rows.select("doc_id", F.explode(F.array_distinct(runs)).alias("run"))


def quote_matches(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """docs(doc_id, text) and quotes(item_id, quote): doc_id, item_id and places of each quote in each document that holds it.

    A quote of RUN + 2 words or more is met by the run after its first word, which stands between word ends in every text that
    holds the quote: an equi-join on its hash, then compared. Shorter ones are held against all documents.
    """
    inner = F.filter(F.split("quote", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    run = F.xxhash64(F.slice(F.transform(inner, lambda w: F.xxhash64(w)), 2, RUN))
    rows = quotes.where(F.length("quote") >= 3).select("item_id", "quote", F.when(F.size(inner) >= RUN + 2, run).alias("run"))
    met = word_runs(docs, RUN).join(rows.where("run is not null"), "run").select("doc_id", "item_id", "quote").distinct()
    pairs = met.join(docs, "doc_id").where(F.contains("text", "quote")).select("doc_id", "item_id", "text", "quote")
    short = docs.join(rows.where("run is null").select("item_id", "quote"), F.contains("text", "quote")).select("doc_id", "item_id", "text", "quote")
    return quote_places(pairs.unionByName(short))


def quote_places(pairs: DataFrame) -> DataFrame:
    """pairs(text, quote): places of all occurrences that don't overlap, by splitting at the quote."""
    parts = F.call_function("split", F.col("text"), F.concat(F.lit(r"\Q"), F.replace("quote", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), F.lit(-1))
    fold = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1), F.expr("cast(named_struct('at', 0, 'out', array()) as struct<at:int,out:array<int>>)"),
        lambda acc, p: F.struct((acc["at"] + F.length(p) + F.length("quote")).cast("int").alias("at"), F.array_append(acc["out"], (acc["at"] + F.length(p)).cast("int")).alias("out")).cast("struct<at:int,out:array<int>>"),
        lambda acc: acc["out"],
    )
    return pairs.where(F.length("quote") >= 3).withColumn("places", fold)

