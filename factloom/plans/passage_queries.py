"""Registered queries of texts as relations (lines, blocks, mentions, spans of a fact), and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, model, passages
from ..operators.tables import written
from .queries import query, read
from .rendered import TRUTH_SQL, rendered

BLOCK = 200


def texts_of(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("full_text"))


#: Lines of documents with a letter or digit, with the place where each begins.
LINES_SQL = """
select doc_id, no - 1 no, line, coalesce(sum(length(line) + 1) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0)::bigint begins
from (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(1, len(string_split(text, chr(10))) + 1)) no from documents)
"""


@query(f"""with l as ({LINES_SQL}), w as (select doc_id, begins as at, len(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}]+')) n from l where regexp_matches(line, '[^\\s]')),
t as (select doc_id, count(*) filter (n > 0) n_lines, sum(n)::bigint n_words, max(n)::bigint most from w group by doc_id having sum(n) > 0)
select t.*, (select min("at") from w where w.doc_id = t.doc_id and n = most)::int fullest_at from t""")
def words_in_lines(spark, sf_dir):
    """Words met with the lines that hold them: lines with words, words, most in a line and where the first such line begins."""
    docs = texts_of(spark, sf_dir)
    met = passages.within(passages.words(docs).select("doc_id", "at"), passages.lines(docs), "line").where("line is not null")
    each = met.groupBy("doc_id", F.col("line.at").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    out = each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n").alias("n_words"), F.max(F.struct("n", (-F.col("at")).alias("at"))).alias("top"))
    return out.select("doc_id", "n_lines", "n_words", F.col("top.n").alias("most"), (-F.col("top.at")).alias("fullest_at"))


@query(f"""with l as (select doc_id, begins as at, begins + length(line) "to" from ({LINES_SQL}) where regexp_matches(line, '[^\\s]')),
b as (select doc_id, unnest(range(0, length(text), {BLOCK})) as at, length(text) size from documents)
select b.doc_id, b.at::int as at, count(l.at) n_lines, min(l.at)::int first_at from b join l on l.doc_id = b.doc_id and l.at < least(b.at + {BLOCK}, size) and b.at < l."to" group by b.doc_id, b.at""")
def lines_in_blocks(spark, sf_dir):
    """Lines that reach into each block of 200 characters: an overlap join of intervals."""
    docs = texts_of(spark, sf_dir)
    size = F.length("full_text")
    blocks = docs.where(size > 0).select("doc_id", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1, F.lit(BLOCK))).alias("at"))
    blocks = blocks.select("doc_id", "at", F.least(F.col("at") + BLOCK, F.col("size")).alias("to"))
    met = passages.overlapping(blocks, passages.lines(docs), "line")
    return met.groupBy("doc_id", "at").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line.at").alias("first_at"))


LONG = "strftime(issue_date, '%-d %B %Y')"
PLAIN = "length(cast(total_minor // 100 as varchar)) + 3"


@query(f"""select doc_id, case when variant = 0 and 12 + {PLAIN} < 24 or variant = 1 and 20 + {PLAIN} < 14 + length({LONG}) or variant = 8 and 13 + {PLAIN} < 25
  then issue_date + net_days else issue_date end as day from ({TRUTH_SQL}) where variant < 9""", dates="day")
def nearest_date_of_amounts(spark, sf_dir):
    """The date that stands nearest to the amount of each rendered document, before or behind it."""
    found = written(model.mentions(rendered(spark, sf_dir).select("doc_id", "full_text")), "mentions")
    amounts = found.where("kind = 'amount'").select("doc_id", "at")
    return passages.nearest(amounts, found.where("kind = 'date'").select("doc_id", "at", "day"), "date").select("doc_id", "date.day")


@query(f"""select doc_id, variant in (0, 1, 8) or (variant = 4 and cast(issue_date + to_months(term_months) - interval 1 day as date) = issue_date + net_days) verified from ({TRUTH_SQL})""")
def payments_over_spans(spark, sf_dir):
    """Whether amount and due date of each rendered document are written in the spans of all its amounts and dates, taken together."""
    docs = written(rendered(spark, sf_dir).select("doc_id", "full_text", "issue_date", "net_days", "total_minor"), "rendered")
    given = {"kind": F.lit("payment"), "minor": F.col("total_minor"), "day": F.date_add("issue_date", F.col("net_days"))}
    kinds = dict(v.split() for v in matching.VALUE.split(", "))
    value = F.struct(*(given.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in matching.NAMES))
    facts = docs.select(F.col("doc_id").alias("fact_id"), "doc_id", value.alias("value"))
    spans = model.mentions(docs).where("kind in ('amount', 'date')").select(F.col("doc_id").alias("fact_id"), F.col("at").alias("n"), "at", "to")
    return matching.verified_over(facts, spans, docs).select(F.col("fact_id").alias("doc_id"), "verified")
