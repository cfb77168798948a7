"""Reading documents, page models and labels; writing tables and reports.

Defined results: an empty file is one empty line of one page; files of other extensions pair with no label; labels that
cannot be read, are empty or hold no JSON object come with the reason and are left out of pairs; unknown fields are ignored;
of files of one name and extension the first by path counts; empty folders give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGES = (
    "pages array<struct<index:int,source:string,appliedRotation:int,lines:array<struct<text:string,confidence:double,"
    "box:struct<x:double,y:double,width:double,height:double>>>>>"
)
LABELS = (
    "document_type string, parties array<string>, effective_date string, end_date string, total_amount double, "
    "payments array<struct<amount:double,due_date:string,recurrence:string>>, notice_period_days int, renewal_automatic boolean, "
    "identifiers array<string>, obligations array<struct<category:string,due_date:string>>, _corrupt string"
)
#: Of files with one base name the first of these is the document.
PRIORITY = ["txt", "pages.json", "pdf", "png", "jpg", "jpeg", "heic"]


def _named(df: DataFrame) -> DataFrame:
    file = F.element_at(F.split("path", "/"), -1)
    return df.withColumn("name", F.regexp_extract(file, r"^([^.]+)\.(.+)$", 1)).withColumn("extension", F.lower(F.regexp_extract(file, r"^([^.]+)\.(.+)$", 2)))


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Plain text files: (name, page, line, text), pages parted by form feed."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    pages = _named(raw).select("name", F.posexplode(F.split("value", "\f")).alias("page", "body"))
    return pages.select("name", "page", F.posexplode(F.split("body", "\n")).alias("line", "text"))


def page_models(spark: SparkSession, path: str) -> DataFrame:
    """Serialised page models: (name, page, line, text, confidence, box)."""
    raw = spark.read.schema(PAGES).json(path, multiLine=True).select("pages", F.col("_metadata.file_path").alias("path"))
    pages = _named(raw).select("name", F.explode("pages").alias("p"))
    return pages.select("name", F.col("p.index").alias("page"), F.posexplode("p.lines").alias("line", "l")).select("name", "page", "line", "l.text", "l.confidence", "l.box")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files; a malformed one has its text in skipped_because."""
    raw = spark.read.schema(LABELS).option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)
    named = _named(raw.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")))
    known = [c.split()[0] for c in LABELS.split(", ") if not c.startswith(("_", "payments", "obligations"))]
    bare = F.coalesce(*(F.col(c).cast("string") for c in known), F.col("payments").cast("string"), F.col("obligations").cast("string")).isNull()
    reason = F.when(F.col("size") == 0, "empty file").when(F.col("_corrupt").isNotNull(), "not readable as JSON").when(bare, "no expected values")
    return named.withColumn("skipped_because", reason).drop("_corrupt", "path", "extension", "size")


def paired(files: DataFrame, label_files: DataFrame) -> DataFrame:
    """files(path), label_files(name, ...): each label with its document, by base name and extension priority."""
    order = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("extension"))
    best = _named(files).where(order > 0).withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy(order, "path"))).where("rn = 1")
    usable = label_files.where("skipped_because is null") if "skipped_because" in label_files.columns else label_files
    return usable.join(best.select("name", "path"), "name")


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """Arriving files with their kind by leading bytes: pdf, image, text, empty or unsupported."""
    raw = spark.read.format("binaryFile").load(path)
    head = F.substring(F.hex(F.substring("content", 1, 12)), 1, 24)
    kind = (
        F.when(F.col("length") == 0, "empty")
        .when(head.startswith("25504446"), "pdf")
        .when(head.startswith("FFD8FF") | head.startswith("89504E47") | head.rlike("^.{8}66747970"), "image")
        .when(F.expr("is_valid_utf8(cast(content as string))"), "text")
        .otherwise("unsupported")
    )
    return raw.select("path", "length", kind.alias("kind"))


def accepted_pages(pages: DataFrame, least: int = 25) -> DataFrame:
    """Embedded text of a page counts only with so many characters that aren't white space."""
    return pages.where(F.length(F.regexp_replace("text", r"(?U)\s", "")) >= least)


def best_orientation(candidates: DataFrame) -> DataFrame:
    """candidates(page_id, rotation, n_chars, confidence): the rotation read best, and whether it is acceptable."""
    score = F.struct(F.col("n_chars") * F.col("confidence"), -F.col("rotation"))
    best = candidates.groupBy("page_id").agg(F.max_by(F.struct("rotation", "n_chars", "confidence"), score).alias("b"))
    return best.select("page_id", "b.*", ((F.col("b.n_chars") >= 40) & (F.col("b.confidence") >= 0.4)).alias("accepted"))


def write_report(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").json(path)


def without(table: DataFrame, deleted: DataFrame, key: str = "doc_id") -> DataFrame:
    """A table rewritten without the rows of deleted documents."""
    return table.join(deleted.select(key).distinct(), key, "left_anti")
