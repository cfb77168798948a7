"""Registered queries of reviewing, profiles, places and evaluation, and their DuckDB counterparts.

Documents are orders, their facts are lines; documents of obligations are customers. What both engines compute alike
is written once, as SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.parsers import AGREEMENTS
from ..operators.tables import written
from ..operators import evaluate, geometry, lifecycle, profile, review
from .queries import EFFECTIVE, OBLIGATIONS, TODAY, obligations, query, read, today

KINDS_SQL = "case no when 1 then 'payment' when 2 then 'effective_date' when 3 then 'party' when 4 then 'title' when 5 then 'end_date' when 6 then 'clause' else 'payment' end"
FACTS = f"""select *, {KINDS_SQL} kind from (select l_orderkey doc_id, l_linenumber no, min(l_partkey) part, min(l_suppkey) supp, max(l_returnflag) flag, cast(max(l_quantity) as int) qty,
  cast(round(max(l_extendedprice) * 100) as bigint) minor, cast(min(l_shipdate) as date) as shipped from lineitem group by l_orderkey, l_linenumber) x"""
MARKED = f"""select doc_id, no, kind, minor, shipped, qty, part, cast(no - 1 as int) sort_index, case when qty % 10 = 0 then 'edited' when flag = 'A' then 'confirmed' when flag = 'R' then 'rejected' else 'pending' end verification,
  case qty % 4 when 0 then 'unverified' when 1 then 'low' when 2 then 'medium' else 'high' end confidence, part % 3 = 0 conflict,
  case supp % 3 when 0 then 'rules' when 1 then 'model' else 'user' end origin from ({FACTS}) y"""
DOCUMENTS = """select o_orderkey doc_id, cast(o_orderdate as date) as added_on, case o_orderkey % 6 when 0 then 'queued' when 1 then 'reading_text' when 2 then 'extracting' when 3 then 'needs_review' when 4 then 'confirmed' else 'failed' end status,
  case when o_orderkey % 6 = 4 or o_orderkey % 7 = 0 then cast(o_orderdate as date) end confirmed_on, case when o_custkey % 3 = 0 then 'Maker Works 5' end user_party, o_custkey % 5 = 0 is_neither, o_orderkey % 97 + 1 issuer, o_custkey cust from orders"""
CUSTOMERS = "select c_custkey doc_id, c_name title, case when c_custkey % 4 > 0 then date '1998-01-01' end confirmed_on from customer"
DUTIES = f"select *, obligation_id % 3 > 0 reminders, case when obligation_id % 2 = 0 then 'Party ' || doc_id end counterparty from ({OBLIGATIONS}) z"


def table(spark, sf_dir, sql):
    """A shared SQL text over the tables it names."""
    args = {name: read(spark, sf_dir, name) for name in ("orders", "lineitem", "customer") if f"from {name}" in sql}
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("from orders", "from {orders}").replace("from lineitem", "from {lineitem}").replace("from customer", "from {customer}"), **args)


def duties(spark, sf_dir):
    return obligations(spark, sf_dir).selectExpr("*", "obligation_id % 3 > 0 reminders", "case when obligation_id % 2 = 0 then concat('Party ', doc_id) end counterparty")


@query(f"select doc_id, status from ({DOCUMENTS}) where status in ('queued', 'reading_text', 'extracting')")
def documents_in_flight(spark, sf_dir):
    return review.in_flight(table(spark, sf_dir, DOCUMENTS)).select("doc_id", "status")


@query(f"with d as ({DOCUMENTS}), f as ({MARKED}) select doc_id, status from d where status = 'needs_review' or status = 'confirmed' and doc_id in (select doc_id from f where verification = 'pending')")
def documents_to_review(spark, sf_dir):
    return review.needs_review(table(spark, sf_dir, DOCUMENTS), table(spark, sf_dir, MARKED)).select("doc_id", "status")


@query(f"with o as ({OBLIGATIONS}), c as ({CUSTOMERS}) select obligation_id, row_number() over (order by due_date nulls last, obligation_id) place from o where doc_id in (select doc_id from c where confirmed_on is not null)")
def tracked_by_due(spark, sf_dir):
    # the order is the result: places come from row numbers of the sorted partitions and the counts before them
    rows = review.tracked(obligations(spark, sf_dir), table(spark, sf_dir, CUSTOMERS)).select("obligation_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    rows = written(rows.select("obligation_id", "part", F.expr("at & 8589934591L").alias("at")), "tracked")  # partitions are numbered once, for both uses
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.expr("sum(n) over (order by part rows between unbounded preceding and 1 preceding)").alias("before"))
    return rows.join(sizes, "part").select("obligation_id", (F.coalesce("before", F.lit(0)) + F.col("at") + 1).alias("place"))


@query(f"select doc_id, no from ({MARKED}) where verification = 'pending' and confidence = 'high' and not conflict")
def facts_acceptable_together(spark, sf_dir):
    return review.acceptable_together(table(spark, sf_dir, MARKED)).select("doc_id", "no")


@query(f"with f as ({MARKED}) select doc_id from ({DOCUMENTS}) where user_party is null and not is_neither and doc_id in (select doc_id from f where kind = 'payment' and verification in ('confirmed', 'edited'))")
def documents_without_identity(spark, sf_dir):
    return review.identity_needed(table(spark, sf_dir, DOCUMENTS), table(spark, sf_dir, MARKED)).select("doc_id")


@query(f"select kind, count(*) n from ({MARKED}) where verification <> 'rejected' group by kind")
def facts_not_rejected(spark, sf_dir):
    return review.not_rejected(table(spark, sf_dir, MARKED)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with o as ({DUTIES}), e as (select *, {EFFECTIVE} s from o), c as ({CUSTOMERS})
select obligation_id, coalesce(counterparty, title) body, cast(doc_id as varchar) thread from e join c using (doc_id) where confirmed_on is not null and reminders and due_date is not null and s in ('upcoming', 'pending', 'overdue')""")
def reminder_candidates(spark, sf_dir):
    return review.reminder_candidates(duties(spark, sf_dir), table(spark, sf_dir, CUSTOMERS), today()).select("obligation_id", "body", "thread")


@query(f"select obligation_id, row_number() over (partition by doc_id order by due_date nulls last, obligation_id) as place from ({OBLIGATIONS})")
def obligations_by_due(spark, sf_dir):
    return review.by_due(obligations(spark, sf_dir)).select("obligation_id", F.col("place").cast("long").alias("place"))


@query(f"select doc_id, no, row_number() over (partition by doc_id order by case kind when 'title' then 1 when 'party' then 2 when 'effective_date' then 3 when 'end_date' then 4 when 'payment' then 5 else 6 end, sort_index, no) as place from ({MARKED})")
def facts_presented(spark, sf_dir):
    kinds = "document_type title party effective_date end_date notice_period renewal total_amount payment payment_frequency obligation clause identifier".split()
    return review.presented(table(spark, sf_dir, MARKED), kinds).select("doc_id", "no", F.col("place").cast("long").alias("place"))


@query(f"select case kind when 'title' then 'Document' when 'party' then 'Parties' when 'clause' then 'Important clauses' when 'payment' then 'Money' else 'Dates' end as grp, count(*) n from ({MARKED}) group by 1")
def facts_in_groups(spark, sf_dir):
    return review.in_groups(table(spark, sf_dir, MARKED)).groupBy(F.col("group").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


PICKED = f"select *, qty = max(qty) over (partition by doc_id) and no = 1 picked from ({MARKED}) w"


def picks(spark, sf_dir):
    return table(spark, sf_dir, PICKED).where("picked").select("doc_id", "no")


@query(f"""with f as ({PICKED}), g as (select *, max(cast(picked and conflict as int)) over (partition by doc_id, kind) decided from f)
select doc_id, no, case when picked then 'confirmed' when conflict and decided = 1 and verification = 'pending' then 'rejected' else verification end verification from g""")
def confirm_with_conflicts(spark, sf_dir):
    return review.confirmed(table(spark, sf_dir, MARKED), picks(spark, sf_dir)).select("doc_id", "no", "verification")


@query(f"""with f as ({PICKED}) select doc_id, no, case when picked then minor + 1 else minor end minor, case when picked then 'edited' else verification end verification, case when picked then 'high' else confidence end confidence, case when picked then 1 else 0 end n_notes from f
union all select doc_id, (select max(no) from f g where g.doc_id = f.doc_id) + 1, minor, 'confirmed', 'high', 1 from f where picked""")
def edit_and_add(spark, sf_dir):
    facts = table(spark, sf_dir, MARKED).withColumn("notes", F.array().cast("array<string>"))
    one = table(spark, sf_dir, PICKED).where("picked")
    out = review.added(review.edited(facts, one.select("doc_id", "no", (F.col("minor") + 1).alias("minor"))), one.select("doc_id", "no", "kind", "minor"))
    return out.select("doc_id", "no", "minor", "verification", "confidence", F.size("notes").alias("n_notes"))


@query(f"""with f as ({PICKED}), r as (select doc_id, no, case when picked then 'rejected' else verification end verification from f) select verification, count(*) n from r group by 1""")
def reject_facts(spark, sf_dir):
    return review.rejected(table(spark, sf_dir, MARKED), picks(spark, sf_dir)).groupBy("verification").agg(F.count(F.lit(1)).alias("n"))


REREAD = f"select doc_id, no, kind, minor, 'model' origin from ({FACTS}) v where kind = 'payment'"


@query(f"""with f as ({MARKED}), k as (select * from f where verification in ('confirmed', 'edited', 'rejected') or origin = 'user'), n as ({REREAD}),
fresh as (select * from n where not exists (select 1 from k where k.doc_id = n.doc_id and k.kind = 'payment' and k.minor = n.minor))
select doc_id, no, minor, cast(sort_index as bigint) sort_index, verification from k
union all select fresh.doc_id, coalesce(last_no, 0) + row_number() over (partition by fresh.doc_id order by no), minor, coalesce(last, 0) + row_number() over (partition by fresh.doc_id order by no), 'pending'
from fresh left join (select doc_id, max(sort_index) last, max(no) last_no from k group by doc_id) m on m.doc_id = fresh.doc_id""")
def read_again(spark, sf_dir):
    values = {c: F.lit(None).cast(t) for c, t in (("text", "string"), ("category", "string"), ("day", "date"), ("term_value", "int"), ("term_unit", "string"), ("after", "boolean"), ("anchor", "string"), ("automatic", "boolean"), ("frequency", "string"))}
    old = table(spark, sf_dir, MARKED).withColumns(values)
    new = table(spark, sf_dir, REREAD).withColumns({**values, "verification": F.lit("pending")})
    out = review.reapplied(old, new)
    return out.select("doc_id", "no", "minor", F.col("sort_index").cast("long").alias("sort_index"), "verification")


@query(f"""with o as ({OBLIGATIONS}), c as (select *, case obligation_id % 3 when 0 then 'completed' when 1 then 'pending' end new from o)
select obligation_id, coalesce(new, status) status, case when new is null then 0 else 1 end n_history, case when new = 'completed' then date '{TODAY}' end completed_on, case when new is not null then case new when 'completed' then 'Completed' else 'Pending' end || ' on 15/06/1998' end line from c""", dates="completed_on")
def set_statuses(spark, sf_dir):
    o = obligations(spark, sf_dir).withColumns({"history": F.array().cast("array<string>"), "completed_on": F.lit(None).cast("date")})
    changes = o.where("obligation_id % 3 < 2").select("obligation_id", F.when(F.col("obligation_id") % 3 == 0, "completed").otherwise("pending").alias("new_status"))
    return review.with_status(o, changes, today()).select("obligation_id", "status", F.size("history").alias("n_history"), "completed_on", F.get("history", 0).alias("line"))


@query(f"with o as ({OBLIGATIONS}) select obligation_id, case when obligation_id % 5 = 0 then 'pending' else status end status, case when obligation_id % 5 = 0 then 'Reopened on 15/06/1998' end line from o")
def reopen(spark, sf_dir):
    o = obligations(spark, sf_dir).withColumns({"history": F.array().cast("array<string>"), "completed_on": F.lit(None).cast("date")})
    return review.reopened(o, o.where("obligation_id % 5 = 0"), today()).select("obligation_id", "status", F.get("history", 0).alias("line"))


@query(f"""with d as ({DOCUMENTS}) select doc_id, case when status not in ('queued', 'reading_text', 'extracting') then status when doc_id % 5 = 0 then 'failed' when status = 'queued' then 'reading_text' when status = 'reading_text' then 'extracting' when confirmed_on is not null then 'confirmed' else 'needs_review' end status,
  case when status in ('queued', 'reading_text', 'extracting') and doc_id % 5 = 0 then 'no text' end message from d""")
def documents_advance(spark, sf_dir):
    d = table(spark, sf_dir, DOCUMENTS)
    return review.advanced(d, d.select("doc_id", (F.col("doc_id") % 5 == 0).alias("failed"), F.lit("no text").alias("message"))).select("doc_id", "status", "message")


@query(f"select doc_id, case when status in ('queued', 'reading_text', 'extracting') then 'queued' else status end status from ({DOCUMENTS})")
def documents_resume(spark, sf_dir):
    return review.resumed(table(spark, sf_dir, DOCUMENTS)).select("doc_id", "status")


@query(f"""select doc_id, doc_id % 4 > 1 sent_to_cloud, case when doc_id % 2 = 0 then 'cloud' else 'old' end provider_name, case when doc_id % 2 = 1 then 'timeout' end message, 'a,b,c' warnings from ({DOCUMENTS}) where doc_id % 4 <> 3
union all select doc_id, false, 'old', 'timeout', 'a,b,c' from ({DOCUMENTS}) where doc_id % 4 = 3""")
def reading_provenance(spark, sf_dir):
    d = table(spark, sf_dir, DOCUMENTS).select("doc_id", F.lit(False).alias("sent_to_cloud"), F.lit("old").alias("provider_name"), F.array(F.lit("c"), F.lit("a")).alias("warnings"))
    o = d.select("doc_id", F.lit("cloud").alias("provider"), (F.col("doc_id") % 4 > 1).alias("sent_off_device"), F.when(F.col("doc_id") % 2 == 1, "timeout").alias("error"), F.array(F.lit("b"), F.lit("a")).alias("warnings"))
    return review.provenance(d, o).select("doc_id", "sent_to_cloud", "provider_name", "message", F.array_join("warnings", ",").alias("warnings"))


@query(f"with d as ({DOCUMENTS}), f as ({MARKED}) select 'documents' name, count(*) n from d where doc_id % 3 > 0 union all select 'facts', count(*) from f where doc_id % 3 > 0")
def delete_documents(spark, sf_dir):
    d, f = table(spark, sf_dir, DOCUMENTS), table(spark, sf_dir, MARKED)
    left = review.without_documents({"documents": d, "facts": f}, d.where("doc_id % 3 = 0"))
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in left.items()]
    return counts[0].unionByName(counts[1])


@query(f"select doc_id, case when type in ('invoice', 'quotation') then 'Document date' else 'Effective date' end a, case when type = 'quotation' then 'Valid until' else 'End date' end b from (select doc_id, case doc_id % 4 when 0 then 'invoice' when 1 then 'quotation' when 2 then 'nda' else 'contract' end as type from ({DOCUMENTS}))")
def kind_labels(spark, sf_dir):
    d = table(spark, sf_dir, DOCUMENTS).withColumn("type", F.get(F.array(*map(F.lit, ("invoice", "quotation", "nda", "contract"))), (F.col("doc_id") % 4).cast("int")))
    label = lambda kind: review.kind_label(F.lit(kind), F.col("type"), sorted(AGREEMENTS))
    return d.select("doc_id", label("effective_date").alias("a"), label("end_date").alias("b"))


SHOWN = f"select doc_id, no, minor, shipped, qty, part % 4 form from ({FACTS}) u"
PHRASE = "qty || case when qty = 1 then ' day after the invoice date' else ' days after the invoice date' end"
WHOLE = "case when minor // 100 < 1000 then cast(minor // 100 as varchar) else format('{:,}', minor // 100) end || case when minor % 100 <> 0 then '.' || lpad(cast(minor % 100 as varchar), 2, '0') else '' end"


@query(f"""with s as ({SHOWN}) select doc_id, no, '$' || {WHOLE} || case form when 0 then '' when 1 then ' — due ' || strftime(shipped, '%d/%m/%Y')
  when 2 then ' — due ' || strftime(shipped, '%d/%m/%Y') || ' (' || {PHRASE} || ': base ' || strftime(shipped - qty, '%d/%m/%Y') || ')' else ' — due ' || {PHRASE} || ' (base date unknown)' end || case when qty % 2 = 0 then ' — half yearly' else '' end shown,
  case form when 2 then {PHRASE} || ', base date ' || strftime(shipped - qty, '%d/%m/%Y') when 3 then {PHRASE} || '; the base date is not known yet' end derived from s""")
def payments_shown(spark, sf_dir):
    s = table(spark, sf_dir, SHOWN)
    relative = F.col("form") >= 2
    rows = s.withColumns({
        "kind": F.lit("payment"), "currency": F.lit("USD"), "day": F.when(F.col("form").isin(1, 2), F.col("shipped")), "anchor": F.when(relative, "invoice"), "after": F.when(relative, True), "is_term": F.lit(None).cast("boolean"),
        "term_value": F.when(relative, F.col("qty")), "term_unit": F.when(relative, "days"), "base_date": F.when(F.col("form") == 2, F.expr("date_sub(shipped, qty)")), "frequency": F.when(F.col("qty") % 2 == 0, "half_yearly"),
        **{c: F.lit(None).cast("string") for c in ("text", "role", "category")}, "automatic": F.lit(None).cast("boolean"),
    })
    return rows.select("doc_id", "no", review.display_text().alias("shown"), review.derivation().alias("derived"))


VENDOR = "case when issuer = 5 then 1.0 when 1 - levenshtein('maker works ' || issuer, 'maker works 5') / length('maker works ' || issuer) >= 0.88 then 0.86 else 0.8 * 2 / 3 end"


@query(f"""with d as (select *, {VENDOR} v from ({DOCUMENTS}))
select doc_id, case when v >= 0.85 then 'matched' else 'none' end outcome, case when v >= 0.85 then v end score, case when v >= 0.85 then 0 end party_index, case when v >= 0.85 then 'Maker Works 5' end matched_name from d""")
def profile_outcomes(spark, sf_dir):
    d = table(spark, sf_dir, DOCUMENTS).withColumn("parties", F.array(F.format_string("Maker Works %d", "issuer"), F.format_string("Buyer House %d Pvt Ltd", "cust")))
    me = F.struct(F.lit("Maker Works 5").alias("name"), F.lit("M/s Maker Works 5 Ltd").alias("business"), profile.alias_list(F.lit("Zed Q, ,\n")).alias("aliases"))
    return profile.matched(d, me).select("doc_id", "outcome", "score", "party_index", "matched_name")


@query(f"""with d as (select *, {VENDOR} v from ({DOCUMENTS}))
select doc_id, case when cust % 7 = 0 then user_party when v >= 0.85 then 'Maker Works ' || issuer end user_party, case when cust % 7 = 0 then 'user_chosen' when v >= 0.85 then 'automatic' else 'undetermined' end identity,
  case when doc_id % 2 = 0 then 'mine' when (case when cust % 7 = 0 then user_party = 'Maker Works 5' and v >= 0.85 else v >= 0.85 end) then 'Buyer House ' || cust || ' Pvt Ltd — Service Agreement' else 'Maker Works ' || issuer || ' — Service Agreement' end title from d""")
def identities_and_titles(spark, sf_dir):
    d = table(spark, sf_dir, DOCUMENTS).withColumns({
        "parties": F.array(F.format_string("Maker Works %d", "issuer"), F.format_string("Buyer House %d Pvt Ltd", "cust")), "identity": F.when(F.col("cust") % 7 == 0, "user_chosen").otherwise("undetermined"),
        "filename": F.lit("deed.v2.pdf"), "title": F.when(F.col("doc_id") % 2 == 0, "mine").otherwise("deed.v2"), "document_type": F.lit("service_agreement"),
    })
    me = F.struct(F.lit("Maker Works 5").alias("name"), F.lit("").alias("business"), F.array().cast("array<string>").alias("aliases"))
    return profile.generated_title(profile.identified(d, me)).select("doc_id", "user_party", "identity", "title")


LINES = "select l_orderkey doc_id, 0 page, l_linenumber line, max(cast(l_quantity as int)) n, max(l_quantity) / 50 confidence from lineitem group by l_orderkey, l_linenumber"


def scan_lines(spark, sf_dir):
    return table(spark, sf_dir, LINES).select("doc_id", "page", "line", F.repeat(F.lit("x"), F.col("n")).alias("text"), F.lit(0.1).alias("x"), (F.lit(0.9) - F.col("line") * 0.1).alias("y"), F.lit(0.5).alias("w"), F.lit(0.05).alias("h"), "confidence")


PLACED_LINES = f"l as (select *, coalesce(sum(n + 1) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0) begins from ({LINES})), c as (select doc_id span_id, line, n, confidence, greatest(10, begins) - begins a, least(60, begins + n) - begins b from l where begins < 60 and begins + n > 10)"


def scan_spans(lines):
    return lines.select("doc_id", "page").distinct().withColumns({"span_id": F.col("doc_id"), "page_at": F.lit(10), "page_to": F.lit(60)})


@query(f"with {PLACED_LINES} select span_id, cast(line as int) line, round(0.1 + 0.5 * a / n, 6) x, round(0.5 * (b - a) / n, 6) w from c")
def span_boxes(spark, sf_dir):
    lines = scan_lines(spark, sf_dir)
    return geometry.boxes(scan_spans(lines), lines).select("span_id", "line", F.round("x", 6).alias("x"), F.round("w", 6).alias("w"))


@query(f"with {PLACED_LINES}, u as (select span_id, min(cast(0.1 as double) + cast(0.5 as double) * a / n) x, max(cast(0.1 as double) + cast(0.5 as double) * b / n) r, min(cast(0.9 as double) - line * cast(0.1 as double)) y, max(cast(0.95 as double) - line * cast(0.1 as double)) t from c group by span_id) select span_id, round(100 + 200 * x, 4) x, round(200 * (r - x), 4) w, round(50 + 400 * y, 4) y, round(400 * (t - y), 4) h from u")
def span_highlights(spark, sf_dir):
    lines = scan_lines(spark, sf_dir)
    spans = scan_spans(lines)
    crops = spans.select("span_id", F.lit(100.0).alias("crop_x"), F.lit(50.0).alias("crop_y"), F.lit(200.0).alias("crop_w"), F.lit(400.0).alias("crop_h"))
    glyphs = spans.select("span_id", *(F.lit(0.0).alias(c) for c in geometry.BOX))
    out = geometry.highlights(geometry.united(geometry.boxes(spans, lines), "span_id"), crops, glyphs)
    return out.select("span_id", *(F.round(c, 4).alias(c) for c in ("x", "w", "y", "h")))


@query(f"with {PLACED_LINES}, low as (select span_id, min(confidence) low from c group by span_id) select doc_id, coalesce(low, 0.0) low, round(avg(l.confidence), 9) mean from l left join low on span_id = doc_id group by doc_id, low")
def text_confidence(spark, sf_dir):
    lines = scan_lines(spark, sf_dir)
    low = geometry.span_confidence(scan_spans(lines), lines).select(F.col("span_id").alias("doc_id"), F.col("confidence").alias("low"))
    return geometry.page_confidence(lines.select("doc_id", "page"), lines).join(low, "doc_id").select("doc_id", "low", F.round("confidence", 9).alias("mean"))


PAGES = "select conv_id doc_id, cast(turn as int) page, text from conversations"


@query(f"""with o as (select doc_id, page, text, cast(coalesce(sum(len(text) + 2) over (partition by doc_id order by page rows between unbounded preceding and 1 preceding), 0) as bigint) begins from ({PAGES})),
p as (select doc_id, unnest([20, 200, 600]) q from (select distinct doc_id from o)),
s as (select p.doc_id, p.q, arg_max(page, begins) page, arg_max(text, begins) text, max(begins) begins from p join o on o.doc_id = p.doc_id and begins <= p.q group by p.doc_id, p.q)
select doc_id, cast(q as bigint) as "at", cast(page as int) page, q - begins page_at, least(q + 150 - begins, len(text)) page_to, sha256(substring(text, cast(q - begins + 1 as bigint), cast(least(q + 150 - begins, len(text)) - (q - begins) as bigint))) quote from s where q - begins < least(q + 150 - begins, len(text))""")
def page_spans(spark, sf_dir):
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text")
    places = pages.select("doc_id").distinct().select("doc_id", F.explode(F.array(*(F.lit(x).cast("long") for x in (20, 200, 600)))).alias("at")).withColumn("to", F.col("at") + 150)
    out = geometry.spans(places, pages)
    return out.select("doc_id", "at", "page", "page_at", "page_to", F.sha2("quote", 256).alias("quote"))


JUDGED = f"select doc_id, kind field, cast(verification in ('confirmed', 'edited') as int) as ok, confidence from ({MARKED}) t"


@query(f"with j as ({JUDGED}) select field, cast(sum(ok) as bigint) n_right, count(*) total, count(*) filter (ok = 0 and confidence = 'high') high_errors from j group by field")
def field_accuracy(spark, sf_dir):
    out = evaluate.accuracy(table(spark, sf_dir, JUDGED).withColumnRenamed("ok", "right"))
    return out.select("field", F.col("right").alias("n_right"), "total", "high_errors")


@query(f"""with j as ({JUDGED}), s as (select doc_id, field, cast(sum(ok) as bigint) n_right, count(*) total from j group by all)
select * from s union all select doc_id, 'dates', cast(sum(n_right) as bigint), cast(sum(total) as bigint) from s where field in ('effective_date', 'end_date') group by doc_id""")
def combined_dates(spark, sf_dir):
    s = table(spark, sf_dir, JUDGED).groupBy("doc_id", "field").agg(F.sum("ok").alias("right"), F.count(F.lit(1)).alias("total"))
    return evaluate.combined(s, ["effective_date", "end_date"], "dates").select("doc_id", "field", F.col("right").alias("n_right"), "total")


@query(f"""with f as ({MARKED}) select doc_id, count(*) filter (qty % 5 > 0 and qty % 7 > 0 and qty % 3 > 0) n_right, count(*) total from f where kind not in ('clause', 'title') group by doc_id""")
def source_matching_rate(spark, sf_dir):
    f = table(spark, sf_dir, MARKED).withColumns({"at": F.expr("if(qty % 5 > 0, qty, null)"), "match": F.expr("if(qty % 7 > 0, 'exact', 'fuzzy')"), "verified": F.expr("if(qty % 3 > 0, if(qty % 2 = 0, true, null), false)")})
    return evaluate.source_matching(f).select("doc_id", F.col("right").alias("n_right"), "total")


@query("""with w as (select l_orderkey doc_id, list(cast(l_partkey % 50 as varchar)) w from lineitem where l_returnflag <> 'A' group by 1), h as (select l_orderkey doc_id, list(cast(l_partkey % 50 as varchar)) h from lineitem where l_linestatus = 'F' group by 1),
b as (select doc_id, len(w) n, coalesce(len(h), 0) m, coalesce(len(list_intersect(list_distinct(w), list_distinct(h))), 0) both_n from w left join h using (doc_id))
select doc_id, case when m = 0 or both_n = 0 then 0.0 else round(2.0 * both_n / (n + m), 9) end f1 from b""")
def identifier_f1(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 50).cast("string").alias("value"), "l_returnflag", "l_linestatus")
    out = evaluate.identifier_f1(li.where("l_returnflag <> 'A'"), li.where("l_linestatus = 'F'"))
    return out.select("doc_id", F.round("f1", 9).alias("f1"))


@query(f"with o as ({OBLIGATIONS}) select obligation_id, case when obligation_id % 9 = 0 and frequency is not null then 'pending' when direction = 'owed_to_me' then 'received' else 'completed' end status from (select *, case when obligation_id % 9 = 0 then 'monthly' end frequency from o)")
def mark_recurring_done(spark, sf_dir):
    o = obligations(spark, sf_dir).withColumns({"anchor_date": F.col("due_date"), "frequency": F.when(F.col("obligation_id") % 9 == 0, "monthly"), "recurrence_end": F.lit(None).cast("date")})
    return lifecycle.marked_done(o).select("obligation_id", "status")


@query("select doc_id, case s when 0 then 'PDF text' when 1 then 'Scanned (OCR)' when 2 then 'No readable text' else 'PDF text and OCR' end as shown from (select c_custkey doc_id, c_custkey % 4 s from customer)")
def text_sources(spark, sf_dir):
    pick = {0: ["pdf_text", "pdf_text"], 1: ["ocr"], 2: ["none"], 3: ["ocr", "pdf_text"]}
    sources = F.coalesce(*(F.when(F.col("c_custkey") % 4 == k, F.array(*map(F.lit, v))) for k, v in pick.items()))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), review.text_source(sources).alias("shown"))
