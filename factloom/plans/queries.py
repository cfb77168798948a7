"""Registered queries over the driver tables and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import parsers as P
from ..operators import evaluate, layout, lifecycle
from ..operators import search as S
from ..operators.extract import asked, extract_facts
from ..operators.profile import similar_names
from ..operators.tables import written
from .rendered import KINDS, TRUTH_SQL, rendered, truth

TODAY = "1998-06-15"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: str = "") -> Callable[[Query], Query]:
    """Register a query; its columns named in `dates` come out as ISO strings on both sides."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates.split()})

        QUERIES[f.__name__] = run if dates else f
        if sql is not None:
            changed = ", ".join(f"strftime(cast({c} as date), '%Y-%m-%d') as {c}" for c in dates.split())
            SQL[f.__name__] = f"select * replace ({changed}) from ({sql})" if dates else sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OBLIGATIONS = """
select o_orderkey obligation_id, o_custkey doc_id, cast(o_orderdate as date) + cast(30 as int) due_date, cast(round(o_totalprice * 100) as bigint) amount_minor,
  case o_custkey % 3 when 0 then 'INR' when 1 then 'USD' else 'EUR' end currency,
  case o_orderkey % 4 when 0 then 'owed_to_me' when 1 then 'i_owe' when 2 then 'unknown' else 'not_mine' end direction,
  case o_orderstatus when 'O' then 'pending' when 'P' then 'overdue' else 'completed' end status
from orders
"""
EFFECTIVE = f"""case when status not in ('upcoming', 'pending', 'overdue') or due_date is null then status when due_date < date '{TODAY}' then 'overdue' when status = 'overdue' then 'pending' else status end"""


def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    pick = lambda c, *xs: F.get(F.array(*map(F.lit, xs)), c.cast("int"))
    return o.select(
        F.col("o_orderkey").alias("obligation_id"), F.col("o_custkey").alias("doc_id"), F.date_add(F.to_date("o_orderdate"), 30).alias("due_date"),
        C.minor_units(F.col("o_totalprice")).alias("amount_minor"), pick(F.col("o_custkey") % 3, "INR", "USD", "EUR").alias("currency"),
        pick(F.col("o_orderkey") % 4, "owed_to_me", "i_owe", "unknown", "not_mine").alias("direction"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "overdue").otherwise("completed").alias("status"), F.lit("payment").alias("category"),
    )


def today():
    return F.lit(TODAY).cast("date")


@query(f"""with o as ({OBLIGATIONS}) select currency, cast(sum(case when direction = 'owed_to_me' then amount_minor else 0 end) as bigint) owed_to_me,
  cast(sum(case when direction = 'i_owe' then amount_minor else 0 end) as bigint) i_owe, count(*) filter (direction = 'unknown') unassigned
  from o where status in ('upcoming', 'pending', 'overdue') group by currency""")
def money_totals(spark, sf_dir):
    return lifecycle.money_totals(obligations(spark, sf_dir))


@query(f"with o as ({OBLIGATIONS}) select obligation_id, {EFFECTIVE} status from o")
def effective_status(spark, sf_dir):
    o = obligations(spark, sf_dir)
    return o.select("obligation_id", C.effective_status(F.col("status"), F.col("due_date"), today()).alias("status"))


def _upcoming(days: int) -> str:
    return f"with o as ({OBLIGATIONS}) select obligation_id, doc_id, due_date from (select *, {EFFECTIVE} s from o) where s in ('upcoming', 'pending') and due_date <= date '{TODAY}' + {days}"


@query(_upcoming(30), dates="due_date")
def upcoming_30(spark, sf_dir):
    return lifecycle.upcoming(obligations(spark, sf_dir), today(), 30).select("obligation_id", "doc_id", "due_date")


@query(_upcoming(90), dates="due_date")
def upcoming_90(spark, sf_dir):
    return lifecycle.upcoming(obligations(spark, sf_dir), today(), 90).select("obligation_id", "doc_id", "due_date")


@query(f"with o as ({OBLIGATIONS}) select doc_id, count(*) n, count(*) filter (status = 'pending') pending, count(*) filter (status = 'pending') > 0 needs_review from o group by doc_id")
def pending_counts(spark, sf_dir):
    o = obligations(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "pending").alias("pending"))
    return o.withColumn("needs_review", F.col("pending") > 0)


FREQUENCY = "case doc_id % 5 when 0 then 'weekly' when 1 then 'monthly' when 2 then 'quarterly' when 3 then 'half_yearly' else 'yearly' end"
STEP = "case frequency when 'weekly' then to_days(cast(7 * n as int)) when 'monthly' then to_months(cast(n as int)) when 'quarterly' then to_months(cast(3 * n as int)) when 'half_yearly' then to_months(cast(6 * n as int)) else to_months(cast(12 * n as int)) end"
RECURRING = f"""r as (select obligation_id, doc_id, due_date, {FREQUENCY} frequency, due_date + 900 ends from ({OBLIGATIONS})),
occ as (select obligation_id, frequency, ends, cast(due_date + {STEP} as date) as day from r, range(0, 400) t(n)),
good as (select obligation_id, day, row_number() over (partition by obligation_id order by day) k from occ where day >= date '{TODAY}' and day <= ends)"""


def recurring(spark, sf_dir):
    return obligations(spark, sf_dir).selectExpr("*", f"{FREQUENCY} frequency", "date_add(due_date, 900) ends")


def first_six(o):
    days = C.occurrences(F.col("due_date"), F.col("frequency"), F.lit(1), F.col("ends"), today(), 6)
    return o.select("obligation_id", F.posexplode(days).alias("k", "day")).withColumn("k", F.col("k") + 1)


def next_day(o):
    after = C.next_occurrence(F.date_sub(today(), 1), F.col("due_date"), F.col("frequency"), F.lit(1), F.col("ends"))
    return o.select("obligation_id", after.alias("next_day"))


@query(f"with {RECURRING} select obligation_id, cast(k as int) k, day from good where k <= 6", dates="day")
def recurrence_occurrences(spark, sf_dir):
    return first_six(recurring(spark, sf_dir))


@query(f"with {RECURRING} select r.obligation_id, day next_day from r left join good on r.obligation_id = good.obligation_id and k = 1", dates="next_day")
def next_occurrence(spark, sf_dir):
    return next_day(recurring(spark, sf_dir))


@query(f"""with o as ({OBLIGATIONS}), c as (select obligation_id, due_date from o where status <> 'completed'),
f as (select 'reminder.' || obligation_id || '.' || strftime(due_date, '%Y-%m-%d') || '.' || d reminder_id, obligation_id, due_date due, cast(d as int) days_before,
  cast(due_date - d as timestamp) + interval 9 hour fire_at from c, (values (30), (14), (7), (0)) v(d))
select reminder_id, obligation_id, due, days_before, strftime(fire_at, '%Y-%m-%d %H:%M') fire_at,
  case days_before when 0 then 'Due today (' else 'Due in ' || days_before || ' days (' end || strftime(due, '%-d %b %Y') || ') · order' body
from f where fire_at > timestamp '{TODAY} 09:00:00' order by fire_at, reminder_id limit 60""", dates="due")
def reminder_plan_top60(spark, sf_dir):
    o = obligations(spark, sf_dir).where("status <> 'completed'")
    c = o.selectExpr("obligation_id", "'t' title", "'order' body", "due_date", "cast(null as string) frequency", "1 every", "cast(null as date) recurrence_end", "array(30, 14, 14, 7, 0, -3) offsets", "true is_open")
    out = lifecycle.plan_reminders(c, F.lit(f"{TODAY} 09:00:00").cast("timestamp"))
    return out.select("reminder_id", "obligation_id", "due", "days_before", F.date_format("fire_at", "yyyy-MM-dd HH:mm").alias("fire_at"), "body")


@query(f"""with {RECURRING}, f as (select 'reminder.' || obligation_id || '.' || strftime(day, '%Y-%m-%d') || '.' || d reminder_id, obligation_id, day due, cast(d as int) days_before, cast(day - d as timestamp) + interval 9 hour fire_at from good, (values (30), (14), (7), (0)) v(d) where k <= 6)
select reminder_id, obligation_id, due, days_before from f where fire_at > timestamp '{TODAY} 09:00:00' order by fire_at, reminder_id limit 60""", dates="due")
def reminder_plan_recurring(spark, sf_dir):
    c = recurring(spark, sf_dir).selectExpr("obligation_id", "'t' title", "'order' body", "due_date", "frequency", "1 every", "ends recurrence_end", "array(30, 14, 7, 0) offsets", "true is_open")
    return lifecycle.plan_reminders(c, F.lit(f"{TODAY} 09:00:00").cast("timestamp")).select("reminder_id", "obligation_id", "due", "days_before")


ZONES = [("UTC", 0), ("Asia/Kolkata", 330), ("Asia/Tokyo", 540), ("America/Phoenix", -420)]


@query(f"""with o as ({OBLIGATIONS}) select obligation_id, epoch_us(cast(due_date as timestamp) + interval 9 hour - to_minutes(({[m for _, m in ZONES]})[obligation_id % 4 + 1])) // 1000000 fire_second from o where due_date is not null""")
def reminder_instants(spark, sf_dir):
    """When nine o'clock of the due day is, in a zone of each obligation's own."""
    zone = F.get(F.array(*(F.lit(z) for z, _ in ZONES)), (F.col("obligation_id") % 4).cast("int"))
    return obligations(spark, sf_dir).where("due_date is not null").select("obligation_id", F.unix_seconds(C.instant_at(F.col("due_date"), 9, 0, zone)).alias("fire_second"))


@query(f"""with o as ({OBLIGATIONS}), p as (select obligation_id, due_date due from o where obligation_id % 3 > 0), n as (select obligation_id, due_date due from o where obligation_id % 3 < 2)
select 'drop' act, obligation_id from p where obligation_id not in (select obligation_id from n) union all select 'add', obligation_id from n where obligation_id not in (select obligation_id from p)""")
def stale_and_new_reminders(spark, sf_dir):
    o = obligations(spark, sf_dir).select("obligation_id", F.col("obligation_id").alias("reminder_id"))
    drop, add = lifecycle.replanned(o.where("obligation_id % 3 > 0"), o.where("obligation_id % 3 < 2"))
    return drop.select(F.lit("drop").alias("act"), "obligation_id").union(add.select(F.lit("add"), "obligation_id"))


@query(f"""with o as ({OBLIGATIONS}), e as (select doc_id, obligation_id no, 'payment' category, status, obligation_id % 5 = 0 touched from o where obligation_id % 2 = 0),
k as (select * from e where status = 'completed' or touched)
select doc_id, no, status, 'kept' origin from k union all select doc_id, obligation_id, 'pending', 'draft' from o where not exists (select 1 from k where k.doc_id = o.doc_id and k.no = o.obligation_id)""")
def finalize_preserve(spark, sf_dir):
    o = obligations(spark, sf_dir)
    e = o.where("obligation_id % 2 = 0").selectExpr("doc_id", "obligation_id no", "'payment' category", "status", "if(obligation_id % 5 = 0, array('done'), array()) history", "'kept' origin")
    drafts = o.selectExpr("doc_id", "obligation_id no", "'payment' category", "'pending' status", "cast(array() as array<string>) history", "'draft' origin")
    return lifecycle.finalized(e.withColumn("history", F.col("history").cast("array<string>")), drafts).select("doc_id", "no", "status", "origin")


@query(f"with t as ({TRUTH_SQL}) select doc_id, cast(issue_date + to_months(term_months) as date) - 1 term_end, cast(issue_date - notice_days as date) notice_by, cast(issue_date + to_months(-term_months) as date) back, notice_days * 1 as days from t", dates="term_end notice_by back")
def derived_dates(spark, sf_dir):
    t = truth(spark, sf_dir)
    day, months, notice = F.col("issue_date"), F.col("term_months"), F.col("notice_days")
    return t.select(
        "doc_id", C.derived_date(day, months, F.lit("months"), F.lit(True), F.lit(True)).alias("term_end"), C.derived_date(day, notice, F.lit("days"), F.lit(False), F.lit(None).cast("boolean")).alias("notice_by"),
        C.shifted(day, months, F.lit("months"), F.lit(False)).alias("back"), C.approximate_days(notice, F.lit("days")).cast("int").alias("days"),
    )


@query(f"""with t as ({TRUTH_SQL}), d as (select doc_id, total_minor m, total_minor // 100 w, case when total_minor % 100 <> 0 then '.' || lpad(cast(total_minor % 100 as varchar), 2, '0') else '' end f from t)
select doc_id, '$' || format('{{:,}}', w) || f usd, '₹' || case when w < 1000 then cast(w as varchar) when w < 100000 then cast(w // 1000 as varchar) || ',' || lpad(cast(w % 1000 as varchar), 3, '0')
  else cast(w // 100000 as varchar) || ',' || lpad(cast(w // 1000 % 100 as varchar), 2, '0') || ',' || lpad(cast(w % 1000 as varchar), 3, '0') end || f inr from d""")
def money_text(spark, sf_dir):
    t = truth(spark, sf_dir)
    return t.select("doc_id", C.money_text(F.col("total_minor"), F.lit("USD")).alias("usd"), C.money_text(F.col("total_minor"), F.lit("INR")).alias("inr"))


def facts(spark, sf_dir, *kinds):
    """Facts of the rendered documents, of some kinds."""
    return extract_facts(asked(rendered(spark, sf_dir), *kinds, dealt=True))


def _one(spark, sf_dir, kind, *columns):
    return facts(spark, sf_dir, kind).select("doc_id", *columns)


@query(f"with t as ({TRUTH_SQL}) select doc_id, case when variant = 7 then cast(round(cast(round(total_minor // 100 / 100000.0, 2) as decimal(12,2)) * 10000000) as bigint) else total_minor end minor, case variant when 5 then 'USD' when 8 then 'USD' else 'INR' end currency from t where variant not in (4, 9)")
def render_total(spark, sf_dir):
    return _one(spark, sf_dir, "total_amount", "minor", "currency")


@query(f"with t as ({TRUTH_SQL}) select doc_id, issue_date as day, variant = 0 and day(issue_date) <= 12 and day(issue_date) <> month(issue_date) ambiguous from t where variant < 9", dates="day")
def render_issue_date(spark, sf_dir):
    return _one(spark, sf_dir, "effective_date", "day", "ambiguous")


@query(f"with t as ({TRUTH_SQL}) select doc_id, total_minor minor, case when variant < 2 then issue_date + net_days end as day, case when variant = 2 then net_days else 0 end net_days from t where variant < 3", dates="day")
def render_due_date(spark, sf_dir):
    f = facts(spark, sf_dir, "payment").where("label = 'Invoice payment'")
    return f.select("doc_id", "minor", "day", F.coalesce("term_value", F.lit(0)).alias("net_days"))


@query(f"with t as ({TRUTH_SQL}) select doc_id, total_minor minor, 'monthly' frequency, 'Rent' as label, cast(case when day(issue_date) <= 5 then date_trunc('month', issue_date) + interval 4 day else date_trunc('month', issue_date) + interval 1 month + interval 4 day end as date) as day, cast(issue_date + to_months(term_months) as date) - 1 recurrence_end from t where variant = 4", dates="day recurrence_end")
def render_rent(spark, sf_dir):
    f = facts(spark, sf_dir, "payment").where("frequency is not null")
    return f.select("doc_id", "minor", "frequency", "label", "day", "recurrence_end")


@query(f"""with t as ({TRUTH_SQL}) select doc_id, case variant when 4 then 'Rent' when 8 then 'Quoted amount' else 'Invoice payment' end as label, total_minor minor, case when variant = 4 then 'monthly' end frequency,
  case variant when 2 then null when 4 then cast(case when day(issue_date) <= 5 then date_trunc('month', issue_date) + interval 4 day else date_trunc('month', issue_date) + interval 1 month + interval 4 day end as date) when 8 then null else issue_date + net_days end as day
  from t where variant in (0, 1, 2, 4, 8)""", dates="day")
def render_payments(spark, sf_dir):
    return _one(spark, sf_dir, "payment", "label", "minor", "frequency", "day")


@query(f"""with t as ({TRUTH_SQL}) select doc_id, 'Maker Works ' || issuer as name, 'Vendor' as role from t where variant < 9 union all select doc_id, 'Buyer House ' || cust || ' Pvt Ltd', 'Client' from t where variant < 9""")
def render_parties(spark, sf_dir):
    return _one(spark, sf_dir, "party", F.col("text").alias("name"), "role")


@query(f"with t as ({TRUTH_SQL}) select doc_id, notice_days, 'days' unit from t where variant in (5, 6)")
def render_notice(spark, sf_dir):
    return _one(spark, sf_dir, "notice_period", F.col("term_value").alias("notice_days"), F.col("term_unit").alias("unit"))


@query(f"with t as ({TRUTH_SQL}) select doc_id, variant = 6 automatic from t where variant in (6, 7)")
def render_renewal(spark, sf_dir):
    return _one(spark, sf_dir, "renewal", "automatic")


@query(f"with t as ({TRUTH_SQL}) select doc_id, case when variant = 8 then issue_date + net_days else cast(issue_date + to_months(case when variant = 6 then 12 else term_months end) as date) - 1 end as day from t where variant in (3, 4, 6, 8)", dates="day")
def render_term_end(spark, sf_dir):
    return _one(spark, sf_dir, "end_date", "day")


@query(f"with t as ({TRUTH_SQL}) select doc_id, ({KINDS!r})[variant + 1] kind from t")
def classify_document(spark, sf_dir):
    return _one(spark, sf_dir, "document_type", F.col("category").alias("kind"))


@query("select doc_id, cast(0 as bigint) n_dates from documents")
def addresses_are_no_dates(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("full_text"))
    found = extract_facts(docs, "effective_date", "end_date", "total_amount", "identifier")
    counts = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_dates"))
    return docs.select("doc_id").join(counts, "doc_id", "left").fillna(0, ["n_dates"])


IDS = """select c_custkey, lpad(cast(c_custkey % 37 + 1 as varchar), 2, '0') || 'ABCPE' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') || 'F1Z5' tax, 'XYZPK' || lpad(cast(c_custkey * 7 % 10000 as varchar), 4, '0') || 'Q' account from customer"""


@query(f"with i as ({IDS}) select c_custkey, tax as value, 'gstin' kind from i union all select c_custkey, account, 'pan' from i")
def business_ids(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    tax = F.concat(F.lpad((F.col("c_custkey") % 37 + 1).cast("string"), 2, "0"), F.lit("ABCPE"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("F1Z5"))
    account = F.concat(F.lit("XYZPK"), F.lpad((F.col("c_custkey") * 7 % 10000).cast("string"), 4, "0"), F.lit("Q"))
    docs = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Tax id "), tax, F.lit("; account "), account, F.lit("; bad ABC1234 and 1234 5678 9012.")).alias("full_text"))
    f = extract_facts(docs, "identifier")
    return f.select(F.col("doc_id").alias("c_custkey"), F.col("text").alias("value"), F.col("category").alias("kind"))


#: Folding in SQL: the same tables and classes, in DuckDB's spelling.
SQL_TEXT = lambda value: "'" + value.replace("'", "''") + "'"
SQL_FOLD = lambda value: f"lower(translate({value}, {SQL_TEXT(C.FOLD_FROM)}, {SQL_TEXT(C.FOLD_TO)}))"
SQL_PLAIN = f"translate(regexp_replace(text, '[{C.NO_WIDTH}]', '', 'g'), {SQL_TEXT(C.PLAIN_FROM)}, {SQL_TEXT(C.PLAIN_TO)})"


@query(f"""with n as (select doc_id, trim(regexp_replace({SQL_FOLD(SQL_PLAIN)}, '[\\t\\n\\x0B\\f\\r\\x{{85}}\\p{{Z}}]+', ' ', 'g')) normal, ltrim(regexp_replace({SQL_FOLD("text")}, '[^\\p{{L}}\\p{{M}}\\p{{N}}₹]+', ' ', 'g')) key from documents)
select doc_id, normal, key, len(list_filter(regexp_split_to_array(normal, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) n_tokens from n""")
def search_keys(spark, sf_dir):
    return keys_of(read(spark, sf_dir, "documents"))


def keys_of(d):
    text = F.col("text")
    return d.select("doc_id", C.normalized(text).alias("normal"), C.search_key(text).alias("key"), F.size(C.tokens(text)).cast("long").alias("n_tokens"))


PAGES = "select conv_id doc_id, turn page, text from conversations"
OFFSETS = f"o as (select doc_id, page, text, cast(coalesce(sum(len(text) + 2) over (partition by doc_id order by page rows between unbounded preceding and 1 preceding), 0) as bigint) begins from ({PAGES}))"


def conversation_pages(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text")


@query(f"with {OFFSETS} select doc_id, cast(page as int) page, begins, cast(len(text) as bigint) n from o")
def page_offsets(spark, sf_dir):
    o = layout.offsets(conversation_pages(spark, sf_dir))
    return o.select("doc_id", "page", "begins", F.length("text").cast("long").alias("n"))


@query(f"with {OFFSETS} select doc_id, cast(sum(len(text)) + 2 * (count(*) - 1) as bigint) n, sha256(string_agg(text, chr(10) || chr(10) order by page)) digest from o group by doc_id")
def full_texts(spark, sf_dir):
    t = layout.full_text(conversation_pages(spark, sf_dir))
    return t.select("doc_id", F.length("full_text").cast("long").alias("n"), F.sha2("full_text", 256).alias("digest"))


@query(f"with {OFFSETS}, p as (select doc_id, unnest([0, 100, 500]) as at from (select distinct doc_id from o)) select p.doc_id, cast(p.at as bigint) as at, cast(arg_max(page, begins) as int) page, p.at - max(begins) as within from p join o on o.doc_id = p.doc_id and begins <= p.at group by p.doc_id, p.at")
def page_at_place(spark, sf_dir):
    pages = conversation_pages(spark, sf_dir)
    places = pages.select("doc_id").distinct().select("doc_id", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 100, 500)))).alias("at"))
    return layout.page_at(places, pages)


@query(f"""with recursive pg as ({PAGES}), ln as (select doc_id, page, i, len(l[i]) n from (select doc_id, page, string_split(text, chr(10)) l, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from pg where len(text) > 400)),
cut as (select doc_id, page, i, 0 piece, n used from ln where i = 1
  union all select ln.doc_id, ln.page, ln.i, case when used + 1 + n <= 400 then piece else piece + 1 end, case when used + 1 + n <= 400 then used + 1 + n else n end from cut join ln on ln.doc_id = cut.doc_id and ln.page = cut.page and ln.i = cut.i + 1),
pieces as (select doc_id, page, piece, max(used) n from cut group by all union all select doc_id, page, 0, len(text) from pg where len(text) <= 400),
ordered as (select *, row_number() over (partition by doc_id order by page, piece) k from pieces),
packed as (select doc_id, page, piece, k, 0 chunk, n used from ordered where k = 1
  union all select o.doc_id, o.page, o.piece, o.k, case when used > 0 and used + n > 400 then chunk + 1 else chunk end, case when used > 0 and used + n > 400 then n else used + n end from packed join ordered o on o.doc_id = packed.doc_id and o.k = packed.k + 1)
select doc_id, cast(page as int) page, cast(piece as int) piece, cast(chunk as int) chunk from packed""")
def chunk_pages(spark, sf_dir):
    return layout.chunks(conversation_pages(spark, sf_dir), 400)


@query(f"""with p as (select doc_id, page, len('<page number="' || (page + 1) || '">' || chr(10) || text || chr(10) || '</page>' || chr(10)) n from ({PAGES})),
s as (select doc_id, n, sum(n) over (partition by doc_id order by page) so_far from p)
select doc_id, bool_or(so_far > 1200) truncated, cast(coalesce(sum(n) filter (so_far <= 1200), 0) as int) n from s group by doc_id""")
def prompt_bodies(spark, sf_dir):
    b = layout.prompt_body(conversation_pages(spark, sf_dir), 1200)
    return b.select("doc_id", "truncated", F.length("body").alias("n"))


@query("select doc_id, item_id, cast((len(d.text) - len(replace(d.text, b.text, ''))) / len(b.text) as bigint) n, cast(instr(d.text, b.text) - 1 as bigint) first_at from documents d join benchmark b on contains(d.text, b.text)")
def quote_exact(spark, sf_dir):
    quotes = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    p = layout.quote_matches(read(spark, sf_dir, "documents").select("doc_id", "text"), quotes)
    return p.select("doc_id", "item_id", F.size("places").cast("long").alias("n"), F.get("places", 0).cast("long").alias("first_at"))


NAMES = "select distinct p_name n from part"


@query(f"""with n as ({NAMES}), t as (select a.n a, b.n b, string_split(a.n, ' ') ta, string_split(b.n, ' ') tb from n a, n b),
c as (select *, list_unique(ta) na, list_unique(tb) nb, len(list_intersect(list_distinct(ta), list_distinct(tb))) both_n, 1 - levenshtein(a, b) / greatest(len(a), len(b)) ratio from t),
h as (select *, case when na <= nb then ta else tb end sm, case when na <= nb then tb else ta end lg from c)
select a, b, round(case when a = b then 1.0 when both_n = least(na, nb) then case when least(na, nb) >= 2 then 0.9 else 0.65 end when ratio >= 0.88 then 0.86
 else 0.8 * len(list_filter(list_distinct(sm), lambda x: list_contains(lg, x) or len(list_filter(lg, lambda y: len(y) >= 5 and levenshtein(x, y) <= 1)) > 0)) / len(list_distinct(lg)) end, 6) score from h where score >= 0.6""")
def name_similarity(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("n")).distinct()
    return similar_names(names, "n", C.MAYBE_NAME).select("a", "b", F.round("score", 6).alias("score"))


@query(f"with t as ({TRUTH_SQL}) select doc_id, case when variant = 9 then 'unknown' when doc_id % 4 = 0 then 'not_mine' when doc_id % 4 = 1 then 'owed_to_me' when doc_id % 4 = 2 then 'i_owe' else 'unknown' end direction from t")
def payment_direction(spark, sf_dir):
    t = truth(spark, sf_dir)
    vendor, client = F.format_string("Maker Works %d", "issuer"), F.format_string("Buyer House %d Pvt Ltd", "cust")
    parties = F.array(F.struct(vendor.alias("name"), F.lit("Service Provider").alias("role")), F.struct(client.alias("name"), F.lit("Client").alias("role")))
    user = F.when(F.col("variant") == 9, None).when(F.col("doc_id") % 4 == 1, vendor).when(F.col("doc_id") % 4 == 2, client).when(F.col("doc_id") % 4 == 0, vendor)
    none = F.lit(None).cast("string")
    neither = (F.col("doc_id") % 4 == 0) & (F.col("variant") != 9)
    rows = t.select("doc_id", none.alias("payer"), none.alias("payee"), user.alias("user_party"), neither.alias("is_neither"), parties.alias("parties"))
    return C.direction(rows).select("doc_id", "direction")


@query(f"""select doc_id, case doc_id % 6 when 0 then 'owed_to_me' when 1 then 'i_owe' when 2 then 'owed_to_me' when 3 then 'i_owe' when 4 then 'owed_to_me' else 'unknown' end direction from ({TRUTH_SQL})""")
def payment_direction_named(spark, sf_dir):
    """By who pays and who is paid: the user, the other of two parties, the roles, nobody known."""
    t = truth(spark, sf_dir)
    vendor, client = F.format_string("Maker Works %d", "issuer"), F.format_string("Buyer House %d Pvt Ltd", "cust")
    form, party = F.col("doc_id") % 6, lambda name, role: F.struct(name.alias("name"), F.lit(role).alias("role"))
    rows = t.select(
        "doc_id", F.when(form == 1, vendor).when(form == 2, client).when(form == 4, F.lit("Some Stranger")).alias("payer"), F.when(form.isin(0, 5), vendor).when(form == 3, client).alias("payee"),
        F.when(form != 5, vendor).alias("user_party"), F.lit(False).alias("is_neither"), F.array(party(vendor, "Vendor"), party(client, "Client")).alias("parties"),
    )
    return C.direction(rows).select("doc_id", "direction")


CASES = """(select l_orderkey, l_linenumber, case l_orderkey % 4 when 0 then 'user' when 1 then 'both' when 2 then 'rules' else 'model' end origin, l_partkey % 5 > 0 has_source,
  case when l_suppkey % 2 = 0 then 'strong' else 'weak' end rule_strength, case l_partkey % 4 when 0 then 'exact' when 1 then 'normalized' when 2 then 'fuzzy' else 'value_only' end match,
  case l_suppkey % 3 when 0 then true when 1 then false end verified, case when cast(l_quantity as int) % 2 = 0 then 0.3D else 0.9D end ocr, l_linenumber % 2 = 0 ambiguous, l_orderkey % 3 = 0 base_missing, l_partkey % 7 = 0 conflict from lineitem)"""


@query(f"""with c as (select * from {CASES.replace('0.3D', '0.3').replace('0.9D', '0.9')}),
s as (select *, case when origin = 'user' then 3 when not has_source then 0 when origin = 'both' then 3 when origin = 'rules' then case rule_strength when 'strong' then 3 else 2 end when verified = false or match in ('value_only', 'fuzzy') then 1 else 2 end l0 from c),
l1 as (select *, case when ocr < 0.5 then greatest(l0 - 1, 1) else l0 end l from s), l2 as (select *, case when ambiguous and origin <> 'both' then greatest(l - 1, 1) else l end l3 from l1),
e as (select *, case when origin = 'user' or not has_source then l0 when base_missing or conflict then least(l3, 2) else l3 end level from l2)
select l_orderkey, l_linenumber, origin, has_source, (['unverified', 'low', 'medium', 'high'])[level + 1] confidence from e""")
def confidence_matrix(spark, sf_dir):
    """The confidence of a fact in every case, by cases taken from the lines of orders."""
    c = spark.sql("select * from " + CASES.replace("from lineitem", "from {lines}"), lines=read(spark, sf_dir, "lineitem"))
    level = C.confidence(*(F.col(x) for x in ("origin", "has_source", "rule_strength", "match", "verified", "ocr", "ambiguous", "base_missing", "conflict")))
    return c.select("l_orderkey", "l_linenumber", "origin", "has_source", level.alias("confidence"))


@query("""with p as (select source, l.quality want, cast(n_chars > 200 as int) got from documents join labels l using (doc_id)),
s as (select source, sum(want * got) m, sum(want) w, sum(got) g from p group by source)
select source, case when w = 0 and g = 0 then 1.0 when w = 0 or g = 0 or m = 0 then 0.0 else round(2.0 * m / (w + g), 9) end f1 from s""")
def f1_by_source(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    p = d.select("source", F.col("quality").alias("want"), (F.col("n_chars") > 200).cast("int").alias("got"))
    s = p.groupBy("source").agg(F.sum(F.col("want") * F.col("got")).alias("m"), F.sum("want").alias("w"), F.sum("got").alias("g"))
    return s.select("source", F.round(C.f1(F.col("m"), F.col("w"), F.col("g")), 9).alias("f1"))


@query("""with d as (select o_orderpriority, o_custkey doc_id, sum(case when o_orderstatus = 'F' then 1 else 0 end) / count(*) r from orders group by all) select o_orderpriority, round(avg(r), 9) score, count(*) n_docs from d group by 1""")
def macro_mean(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("right"), F.lit(1).alias("total"))
    return evaluate.macro(o, ["o_orderpriority"]).withColumn("score", F.round("score", 9))


@query("""with w as (select l_orderkey doc_id, l_quantity q, count(*) want from lineitem where l_returnflag <> 'A' group by all), h as (select l_orderkey doc_id, l_quantity q, count(*) have from lineitem where l_linestatus = 'F' group by all),
b as (select coalesce(w.doc_id, h.doc_id) doc_id, coalesce(want, 0) want, coalesce(have, 0) have from w full join h on w.doc_id = h.doc_id and w.q = h.q),
s as (select doc_id, sum(least(want, have)) m, sum(want) w, sum(have) g from b group by doc_id)
select doc_id, case when w = 0 or g = 0 or m = 0 then 0.0 else round(2.0 * m / (w + g), 9) end f1 from s""")
def greedy_f1(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("q"), "l_returnflag", "l_linestatus")
    out = evaluate.multiset_f1(li.where("l_returnflag <> 'A'"), li.where("l_linestatus = 'F'"), ["q"])
    return out.select("doc_id", F.round("f1", 9).alias("f1"))


def search_index(spark, sf_dir):
    t = truth(spark, sf_dir)
    vendor, client = F.format_string("Maker Works %d", "issuer"), F.format_string("Buyer House %d Pvt Ltd", "cust")
    return t.select(
        "doc_id", F.format_string("%s order %d", F.get(F.array(*map(F.lit, KINDS)), F.col("variant")), "doc_id").alias("title"), F.array(vendor, client).alias("parties"), F.lit("paper").alias("kind"),
        F.array(F.struct(F.lit("Total").alias("label"), C.money_text(F.col("total_minor"), F.lit("INR")).alias("value"), F.col("total_minor").alias("minor"), F.col("issue_date").alias("day"))).alias("fields"),
        F.array(F.struct(F.lit("Payment").alias("title"), F.lit("pending").alias("status"), F.col("total_minor").alias("minor"), F.date_add("issue_date", F.col("net_days")).alias("day"))).alias("obligations"),
        F.lit("grand total of goods").alias("body_key"), F.array("total_minor").alias("text_amounts"),
    )


@query(f"""with t as ({TRUTH_SQL}), k as (select doc_id, replace(({KINDS!r})[variant + 1], '_', ' ') || ' order ' || doc_id title, 'maker works ' || issuer || ' buyer house ' || cust || ' pvt ltd' parties from t),
s as (select doc_id, case when regexp_matches(title, '(^| )invoice( |$)') then 5.0 else 0 end inv, case when regexp_matches(title, '(^| )7') then 5.0 else 0 end + case when regexp_matches(parties, '(^| )7') then 4.0 else 0 end seven,
  case when contains(title, 'invoice 7') or contains(parties, 'invoice 7') then 5.0 else 0 end bonus from k)
select doc_id, cast(inv + seven + bonus as double) score from s where inv > 0 and seven > 0""")
def search_text(spark, sf_dir):
    index = search_index(spark, sf_dir)
    return S.search(index.withColumn("fields", F.transform("fields", lambda f: F.struct(f["label"].alias("label"), F.lit("x").alias("value"), f["minor"].alias("minor"), f["day"].alias("day")))), "Invoice 7")


@query(f"with t as ({TRUTH_SQL}), m as (select min(total_minor // 10000 * 10000) v from t) select doc_id, cast(14 as double) score from t where total_minor = (select total_minor from t where doc_id = (select min(doc_id) from t))")
def search_amount(spark, sf_dir):
    first = truth(spark, sf_dir).orderBy("doc_id").select("total_minor").first()[0]
    return S.search(search_index(spark, sf_dir), f"₹{first // 100}.{first % 100:02d}")


@query(f"with t as ({TRUTH_SQL}) select doc_id, cast(4 as double) * (cast(month(issue_date) = 9 and year(issue_date) = 1997 as int) + cast(month(issue_date + net_days) = 9 and year(issue_date + net_days) = 1997 as int)) score from t where month(issue_date) = 9 and year(issue_date) = 1997 or month(issue_date + net_days) = 9 and year(issue_date + net_days) = 1997")
def search_month(spark, sf_dir):
    index = search_index(spark, sf_dir).withColumn("title", F.lit("paper"))
    return S.search(index.withColumn("parties", F.array(F.lit("x"))), "Sept 1997")


BOX = "select l_orderkey, l_linenumber, (l_quantity % 10) / 100 x, (l_partkey % 10) / 100.0 y, 0.3 w, 0.05 h, cast(l_linenumber % 5 * 90 - 90 as int) turn from lineitem"


@query(f"""with b as ({BOX}) select l_orderkey, l_linenumber, round(case pmod_turn when 90 then 1 - y - h when 180 then 1 - x - w when 270 then y else x end, 6) nx, round(case pmod_turn when 90 then x when 180 then 1 - y - h when 270 then 1 - x - w else y end, 6) ny
from (select *, ((turn % 360) + 360) % 360 pmod_turn from b)""")
def rotate_boxes(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    li = li.selectExpr("l_orderkey", "l_linenumber", "(l_quantity % 10) / 100 x", "(l_partkey % 10) / 100.0D y", "0.3D w", "0.05D h", "cast(l_linenumber % 5 * 90 - 90 as int) turn")
    box = C.rotated(*(F.col(c) for c in ("x", "y", "w", "h", "turn")))
    return li.select("l_orderkey", "l_linenumber", F.round(box["x"], 6).alias("nx"), F.round(box["y"], 6).alias("ny"))


FRAGMENTS = """select l_orderkey page_id, 'f' || l_linenumber "text", (l_linenumber % 3) * 0.3::double x, 0.9::double - l_linenumber // 3 * 0.1::double y, case when l_partkey % 4 = 0 then 0.35::double else 0.2::double end w, 0.05::double h,
  0.5::double + cast(l_quantity as int) % 10 / 20::double confidence from lineitem"""


@query(f"""with recursive f as (select *, y + h top, row_number() over (partition by page_id order by y + h desc, x, "text", y, w, h, confidence) i from ({FRAGMENTS})),
r as (select page_id, i, 0 row, x + w "right", y, h, top from f where i = 1 union all
  select f.page_id, f.i, case when j then r.row else r.row + 1 end, case when j then greatest(r."right", f.x + f.w) else f.x + f.w end, f.y, f.h, f.top
  from r join f on f.page_id = r.page_id and f.i = r.i + 1, lateral (select (least(r.top, f.top) - greatest(r.y, f.y)) / least(r.h, f.h) > 0.5 and f.x >= r."right" - 0.01 j) z)
select page_id, r.row, string_agg("text", '  ' order by x, i) "text", round(min(x), 6) x, round(max(x + w) - min(x), 6) w, round(min(confidence), 6) confidence from r join f using (page_id, i) group by page_id, r.row""")
def scanned_rows(spark, sf_dir):
    fragments = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey page_id", "concat('f', l_linenumber) text", "(l_linenumber % 3) * 0.3D x", "0.9D - floor(l_linenumber / 3) * 0.1D y", "case when l_partkey % 4 = 0 then 0.35D else 0.2D end w", "0.05D h", "0.5D + cast(l_quantity as int) % 10 / 20D confidence"
    )
    return layout.scanned_rows(fragments).select("page_id", "row", "text", F.round("x", 6).alias("x"), F.round("w", 6).alias("w"), F.round("confidence", 6).alias("confidence"))


def checksum_sql() -> str:
    """The state after the six digits of column s and the digit of column i, by the tables of the checksum."""
    product, powers = C._dihedral()
    state = "0"
    for place in range(7):
        digit = "i" if place == 0 else f"cast(substr(s, {7 - place}, 1) as int)"
        state = f"({product})[{state} + 1][({powers[place]})[{digit} + 1] + 1]"
    return state


@query(f"select c_custkey, cast(i as int) digit from (select c_custkey, lpad(cast(c_custkey * 7919 % 1000000 as varchar), 6, '0') s, unnest(range(0, 10)) i from customer) where {checksum_sql()} = 0")
def checksum_digits(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.lpad((F.col("c_custkey") * 7919 % 1000000).cast("string"), 6, "0").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("digit"))
    return rows.where(C.checksum_valid(F.concat("s", F.col("digit").cast("string")))).select("c_custkey", "digit")


@query(f"with o as ({OBLIGATIONS}) select obligation_id, cast(case when day(due_date) <= 29 then date_trunc('month', due_date) + to_days(cast(least(29, day(last_day(due_date))) - 1 as int)) else date_trunc('month', due_date) + interval 1 month + to_days(cast(least(29, day(last_day(cast(due_date + interval 1 month as date)))) - 1 as int)) end as date) as day from o", dates="day")
def first_on_day(spark, sf_dir):
    o = obligations(spark, sf_dir)
    day = C.first_on_day(F.lit(29), F.col("due_date"))
    return o.select("obligation_id", day.alias("day"))


@query(f"with t as ({TRUTH_SQL}) select doc_id, case when variant = 6 or variant = 7 then 'renewal' else 'contract_end' end category, case when variant = 8 then issue_date + net_days else cast(issue_date + to_months(case when variant = 6 then 12 else term_months end) as date) - 1 end due_date from t where variant in (3, 4, 6, 8)", dates="due_date")
def obligations_from_facts(spark, sf_dir):
    built = built_from_facts(spark, sf_dir, None, "end_date", "renewal").where("category in ('renewal', 'contract_end')")
    return built.select("doc_id", "category", "due_date")


def built_from_facts(spark, sf_dir, user, *kinds):
    """Obligations of the facts of some kinds, for a user of that name; the facts are found once and read by each kind of obligation."""
    f = written(facts(spark, sf_dir, "party", *kinds).drop("notes", "quote", "extra"), "facts")
    f = f.withColumns({"verification": F.lit("confirmed"), "payer": F.lit(None).cast("string"), "payee": F.lit(None).cast("string")})
    p = f.where("kind = 'party'").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("text").alias("name"), "role")).alias("parties"))
    p = p.select("doc_id", F.lit(user).cast("string").alias("user_party"), F.lit(False).alias("is_neither"), "parties")
    return lifecycle.build(f, p)


FIFTH = "cast(case when day(issue_date) <= 5 then date_trunc('month', issue_date) + interval 4 day else date_trunc('month', issue_date) + interval 1 month + interval 4 day end as date)"


@query(f"""with t as ({TRUTH_SQL}) select doc_id, case when variant = 4 then 'monthly' end frequency, case when variant in (0, 1) then issue_date + net_days when variant = 4 then {FIFTH} end due_date,
  total_minor amount_minor, case when variant = 8 then 'USD' else 'INR' end currency, 'Maker Works ' || issuer counterparty, 'i_owe' direction from t where variant in (0, 1, 2, 4, 8)""", dates="due_date")
def payments_from_facts(spark, sf_dir):
    """Payments that accepted facts of every rendered document make, and to whom."""
    return built_from_facts(spark, sf_dir, "Buyer House", "payment").where("category = 'payment'").select("doc_id", "frequency", "due_date", "amount_minor", "currency", "counterparty", "direction")


@query(f"""with t as ({TRUTH_SQL}) select doc_id, cast(issue_date + to_months(12) as date) - 1 - notice_days due_date, 'Maker Works ' || issuer counterparty from t where variant = 6""", dates="due_date")
def notices_from_facts(spark, sf_dir):
    """The last days to give notice before an agreement renews."""
    return built_from_facts(spark, sf_dir, "Buyer House", "end_date", "renewal", "notice_period").where("category = 'notice_deadline'").select("doc_id", "due_date", "counterparty")


@query(f"""with t as ({TRUTH_SQL} where o_orderkey % 10 not in (4, 9)) select doc_id, case when doc_id % 2 = 0 then 'both' else 'rules' end origin, doc_id % 2 = 1 conflict from t union all select doc_id, 'model', true from t where doc_id % 2 = 1""")
def merge_conflicts(spark, sf_dir):
    rules = facts(spark, sf_dir, "total_amount").drop("notes").persist()  # read once, used five times
    model = rules.withColumn("minor", F.col("minor") + F.col("doc_id") % 2)
    return lifecycle.merged(rules, model).select("doc_id", "origin", "conflict")


@query(f"""with t as ({TRUTH_SQL}), p as (select doc_id, variant, cast(case variant when 4 then case when day(issue_date) <= 5 then date_trunc('month', issue_date) + interval 4 day else date_trunc('month', issue_date) + interval 1 month + interval 4 day end when 2 then null when 8 then null else issue_date + net_days end as date) as day from t where variant in (0, 1, 2, 4, 8))
select doc_id, 'both' origin, case when variant = 8 then date '2000-01-01' else day end as day, 'Acme' payer from p
union all select doc_id, 'model', coalesce(day, date '2000-01-01') + 1, null from p""", dates="day")
def merge_payments(spark, sf_dir):
    """Each payment is said again by the model with a payer; a second one a day later is another payment, said twice."""
    rules = facts(spark, sf_dir, "payment").drop("notes").persist()
    day = F.coalesce("day", F.lit("2000-01-01").cast("date"))
    again = rules.withColumns({"payer": F.lit("Acme"), "day": F.when(F.col("anchor").isNull(), day)})
    later = rules.withColumns({"payer": F.lit(None).cast("string"), "day": F.date_add(day, 1), "anchor": F.lit(None).cast("string"), "term_value": F.lit(None).cast("int"), "term_unit": F.lit(None).cast("string")})
    model = again.unionByName(later.withColumn("no", F.col("no") + 500)).unionByName(later.withColumn("no", F.col("no") + 900))
    return lifecycle.merged(rules, model).select("doc_id", "origin", "day", "payer")


@query(f"with o as ({OBLIGATIONS}) select obligation_id, case when direction = 'owed_to_me' then 'received' else 'completed' end status from o")
def mark_done(spark, sf_dir):
    o = obligations(spark, sf_dir).withColumns({"category": F.lit("payment"), "anchor_date": F.col("due_date"), "frequency": F.lit(None).cast("string"), "recurrence_end": F.lit(None).cast("date")})
    return lifecycle.marked_done(o).select("obligation_id", "status")


def contained(table, text):
    """As parsers.first_contained, for a column."""
    return F.coalesce(*(F.when(text.contains(key), value) for key, value in table))


SQL_CASE = lambda table, text: "case " + " ".join(f"when contains({text}, '{key}') then '{value}'" for key, value in table) + " end"
SQL_EXACT = "case " + " ".join(f"when bare = '{t.replace('_', '')}' then '{t}'" for t in dict.fromkeys(dict(P.TYPES).values())) + " end"


@query(f"""with d as (select doc_id, lower(text) low, translate(lower(text), '_-', '  ') key from documents), e as (select *, replace(key, ' ', '') bare from d)
select doc_id, coalesce({SQL_EXACT}, {SQL_CASE(P.TYPES, 'key')}) as type, case when low in ('pm', 'p.m.') then 'monthly' else {SQL_CASE(P.FREQUENCIES, 'low')} end frequency,
  case when low is not null then coalesce({SQL_CASE(P.CATEGORIES, 'low')}, 'other') end category, {SQL_CASE(P.CLAUSES, 'low')} clause from e""")
def loose_names(spark, sf_dir):
    low = F.lower("text")
    key = F.translate(low, "_-", "  ")
    bare = F.replace(key, F.lit(" "), F.lit(""))
    exact = F.coalesce(*(F.when(bare == t.replace("_", ""), t) for t in dict(P.TYPES).values()))
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(exact, contained(P.TYPES, key)).alias("type"), F.when(low.isin("pm", "p.m."), "monthly").otherwise(contained(P.FREQUENCIES, low)).alias("frequency"),
        F.when(low.isNotNull(), F.coalesce(contained(P.CATEGORIES, low), F.lit("other"))).alias("category"), contained(P.CLAUSES, low).alias("clause"),
    )
