"""Search by an inverted index: postings of words, values and phrases keys, written once and read in small pieces.

Three tables come from an index (see `search.build`): `words` (token, doc_id, part, item: where a word stands), `values` (doc_id, part,
item, minor, day, year, month: what a field, an obligation or the text is worth) and `names` (doc_id, k_title, k_parties). Words are
laid out by ranges of (token, doc_id), sorted, so that a word of a third of all documents is spread over many files while a
rare one lies in one row group; a search reads only the row groups of its words (equality, or the beginning for the last word),
values by their amount or month, and names only for documents that hold all words of a query of several.

Scores and order are those of `search.search`. Defined results: as there; documents that repeat are one document here, found once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import Query, indexed, query_of

#: Parts of a document and what a hit in one is worth; fields, obligations and texts have items of their own.
TITLE, PARTIES, KIND, FIELD, OBLIGATION, BODY = range(6)
WORTH = {TITLE: 5.0, PARTIES: 4.0, KIND: 2.0, FIELD: 2.0, OBLIGATION: 2.0, BODY: 1.0}
AMOUNT_WORTH, DAY_WORTH, PHRASE_WORTH = {FIELD: 6.0, OBLIGATION: 5.0, BODY: 3.0}, {FIELD: 4.0, OBLIGATION: 4.0}, 5.0


@dataclass(frozen=True)
class Postings:
    words: DataFrame
    values: DataFrame
    names: DataFrame

    def write(self, path: str, files: int | None = None) -> None:
        """The three tables below a path; `files` is the number of ranges of words and of values."""
        n = files or int(self.words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.words.repartitionByRange(n, "token", "doc_id").sortWithinPartitions("token", "doc_id").write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(f"{path}/words")
        self.values.repartitionByRange(n, "minor", "doc_id").sortWithinPartitions("minor", "doc_id").write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(f"{path}/values")
        self.names.write.mode("overwrite").parquet(f"{path}/names")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Postings:
        return Postings(*(spark.read.parquet(f"{path}/{t}") for t in ("words", "values", "names")))


def sub_words(word: Column) -> Column:
    """The pieces of a word that a search may ask for whole: it begins where no letter or digit goes before, and ends where none follows."""
    is_solid = lambda i: F.substring(word, i, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    places = F.sequence(F.lit(1), F.length(word))
    begins = F.filter(places, lambda i: (i == 1) | ~is_solid(i - 1))
    ends = F.filter(places, lambda i: (i == F.length(word)) | ~is_solid(i + 1))
    every = F.flatten(F.transform(begins, lambda b: F.transform(F.filter(ends, lambda e: e >= b), lambda e: F.substring(word, b, e - b + 1))))
    return F.when(word.rlike(r"^[\p{L}\p{N}]+$"), F.array(word)).otherwise(every)


def postings(index: DataFrame) -> Postings:
    """The postings of an index table; each word of a part once. Documents that repeat repeat their postings: a search drops those
    among the few that it reads, so that building moves every posting once, into its range."""
    keys = index if "k_title" in index.columns else indexed(index)
    texts = [(TITLE, F.array("k_title")), (PARTIES, F.array("k_parties")), (KIND, F.array("k_kind")), (FIELD, F.col("k_fields")), (OBLIGATION, F.col("k_obligations")), (BODY, F.array("body_key"))]
    parts = F.array(*(F.struct(F.lit(p).alias("part"), F.coalesce(t, F.array().cast("array<string>")).alias("texts")) for p, t in texts))
    rows = keys.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.part", F.posexplode("p.texts").alias("item", "text"))
    pieces = F.flatten(F.transform(F.filter(F.split("text", " "), lambda w: w != ""), sub_words))
    words = rows.select(F.explode(F.array_distinct(pieces)).alias("token"), "doc_id", "part", "item")
    worth = lambda part, column: F.transform(F.coalesce(column, F.array()), lambda x, i: F.struct(F.lit(part).alias("part"), i.alias("item"), x["minor"].alias("minor"), x["day"].alias("day")))
    plain = F.transform(F.array_distinct("text_amounts"), lambda m, i: F.struct(F.lit(BODY).alias("part"), i.alias("item"), m.alias("minor"), F.lit(None).cast("date").alias("day")))
    values = keys.select("doc_id", F.explode(F.concat(*(worth(p, F.col(c)) for p, c in ((FIELD, "fields"), (OBLIGATION, "obligations"))), F.coalesce(plain, F.array()))).alias("v"))
    values = values.select("doc_id", "v.*", F.year("v.day").alias("year"), F.month("v.day").alias("month")).where("minor is not null or day is not null")
    return Postings(words, values, keys.select("doc_id", "k_title", "k_parties"))


def worth_of(part: Column, table: dict[int, float]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[part], F.lit(0.0))


def word_scores(words: DataFrame, tokens: tuple[str, ...]) -> DataFrame:
    """doc_id, score of the documents that hold all tokens, the last one as the beginning of a word. One scan of the ranges of all
    tokens, one shuffle by document."""
    last = len(tokens) - 1
    test = lambda i: F.col("token").startswith(tokens[i]) if i == last else F.col("token") == tokens[i]
    some = words.where(reduce(Column.__or__, map(test, range(len(tokens)))))
    asked = F.filter(F.array(*(F.when(test(i), F.lit(i)) for i in range(len(tokens)))), lambda i: i.isNotNull())
    hits = some.select("doc_id", "part", "item", F.explode(asked).alias("i")).distinct()
    return hits.groupBy("doc_id").agg(F.sum(worth_of(F.col("part"), WORTH)).alias("score"), F.count_distinct("i").alias("n")).where(F.col("n") == len(tokens)).drop("n")


def value_scores(values: DataFrame, q: Query) -> tuple[DataFrame | None, DataFrame | None]:
    """doc_id, score by amount, and by day or month."""
    total = lambda rows, table: rows.distinct().groupBy("doc_id").agg(F.sum(worth_of(F.col("part"), table)).alias("score")).where("score > 0")
    amounts = total(values.where(F.col("minor") == q.minor), AMOUNT_WORTH) if q.minor is not None else None
    days = None
    if q.day:
        days = total(values.where(F.col("day") == F.lit(q.day)), DAY_WORTH)
    elif q.month:
        days = total(values.where((F.col("month") == q.month) & (F.lit(True) if q.year is None else F.col("year") == q.year)), DAY_WORTH)
    return amounts, days


def search(index: Postings, raw: str, limit: int | None = None) -> DataFrame:
    """doc_id, score of what a query finds, best first; with `limit` only the first ones."""
    q = query_of(raw)
    empty = index.names.where("false").select("doc_id", F.lit(0.0).alias("score"))
    amounts, days = value_scores(index.values, q)
    text = word_scores(index.words, q.tokens) if q.tokens else empty
    if len(q.tokens) > 1:
        phrase = " ".join(q.tokens)
        bonus = F.when(F.contains("k_title", F.lit(phrase)) | F.contains("k_parties", F.lit(phrase)), PHRASE_WORTH).otherwise(0.0)
        names = index.names.join(text.select("doc_id"), "doc_id", "left_semi").distinct()
        text = text.join(names, "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce(bonus, F.lit(0.0))).alias("score"))
    rest = text.unionByName(days).groupBy("doc_id").agg(F.sum("score").alias("score")) if days is not None else text
    if amounts is not None:  # an amount decides where it is found
        rest = amounts.unionByName(rest.join(amounts.select("doc_id"), "doc_id", "left_anti"))
    out = rest.orderBy(F.desc("score"), "doc_id")
    return out if limit is None else out.limit(limit)
