"""Reviewing facts and keeping obligations: who may be accepted together, what a decision changes, what is listed where.

Tables: documents(doc_id, status, confirmed_on, title, filename, document_type, user_party, is_neither, identity),
facts as `extract_facts` gives them with origin, verification, confidence, conflict and sort_index, and
obligations(obligation_id, doc_id, status, due_date, category, ...). Decisions come as small tables keyed by
doc_id and no (or obligation_id) and are joined, so that many decisions are one pass.

Defined results: null statuses, dates and verifications meet no condition; keys without a partner change nothing;
rows that repeat are changed alike; two decisions on one key count as one (the least by value); empty tables give
empty tables; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import lifecycle

IN_FLIGHT = ["queued", "reading_text", "extracting"]
#: Steps of a document on its way; where it goes from each.
NEXT_STEP = {"queued": "reading_text", "reading_text": "extracting"}
# Groups of kinds as they are reviewed.
GROUPS = {
    "Document": ["document_type", "title"], "Parties": ["party"], "Dates": ["effective_date", "end_date"], "Money": ["total_amount", "payment", "payment_frequency"],
    "Renewal & notice": ["renewal", "notice_period"], "Deadlines & deliverables": ["obligation"], "Important clauses": ["clause"], "Identifiers": ["identifier"],
}


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it: what is joined to a caller's table meets none of its columns."""
    while name in df.columns:
        name += "_"
    return name


def accepted(verification: Column) -> Column:
    return F.coalesce(verification.isin("confirmed", "edited"), F.lit(False))


def not_rejected(facts: DataFrame) -> DataFrame:
    return facts.where(~F.col("verification").eqNullSafe("rejected"))


def in_flight(documents: DataFrame) -> DataFrame:
    """Documents still being read."""
    return documents.where(F.col("status").isin(IN_FLIGHT))


def needs_review(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents never reviewed, or confirmed ones with facts still pending."""
    name = unused(documents, "open")
    open_ = facts.where("verification = 'pending'").select("doc_id").distinct().withColumn(name, F.lit(True))
    out = documents.join(open_, "doc_id", "left")
    return out.where((F.col("status") == "needs_review") | ((F.col("status") == "confirmed") & F.col(name))).drop(name)


def tracked(obligations: DataFrame, documents: DataFrame) -> DataFrame:
    """Obligations of confirmed documents, by due date, those without one last."""
    confirmed = documents.where("confirmed_on is not null").select("doc_id").distinct()
    return obligations.join(confirmed, "doc_id", "left_semi").orderBy(F.asc_nulls_last("due_date"), "obligation_id")


def acceptable_together(facts: DataFrame) -> DataFrame:
    """Pending facts of high confidence that no other contradicts."""
    return facts.where("verification = 'pending' and confidence = 'high' and not coalesce(conflict, false)")


def identity_needed(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents with an accepted payment of which nobody said which party is the user."""
    paying = facts.where((F.col("kind") == "payment") & accepted(F.col("verification"))).select("doc_id").distinct()
    return documents.where("user_party is null and not coalesce(is_neither, false)").join(paying, "doc_id", "left_semi")


def reminder_candidates(obligations: DataFrame, documents: DataFrame, today: Column) -> DataFrame:
    """Open, dated obligations with reminders on, of confirmed documents; body and thread are those of the document."""
    own = documents.where("confirmed_on is not null").select("doc_id", F.col("title").alias("document_title"))
    due = obligations.where("reminders and due_date is not null").where(C.is_open(C.effective_status(F.col("status"), F.col("due_date"), today)))
    return due.join(own, "doc_id").withColumns({"body": F.coalesce("counterparty", "document_title"), "thread": F.col("doc_id").cast("string"), "is_open": F.lit(True)}).drop("document_title")


def is_user(parties: DataFrame) -> DataFrame:
    """Adds is_user to parties(name, user_party): whether the name is the chosen user's."""
    return parties.withColumn("is_user", F.coalesce(C.name_similarity(F.col("name"), F.col("user_party")) >= C.SAME_NAME, F.lit(False)))


def newest_first(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc_nulls_last("added_on"), "doc_id")


def by_due(obligations: DataFrame) -> DataFrame:
    """Adds place: where each obligation comes in its document, by due date, those without one last."""
    return obligations.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("due_date"), "obligation_id")))


def totals_listed(obligations: DataFrame) -> DataFrame:
    """Money totals in the order of their currency codes."""
    return lifecycle.money_totals(obligations).orderBy("currency")


def presented(facts: DataFrame, kinds: list[str]) -> DataFrame:
    """Adds place: where each fact is shown in its document, by the rank of its kind, then by sort_index."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return facts.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "sort_index", "no")))


def in_groups(facts: DataFrame) -> DataFrame:
    """Adds group and group_rank of the review."""
    pairs = [(kind, name, i) for i, (name, kinds) in enumerate(GROUPS.items()) for kind in kinds]
    name = F.coalesce(*(F.when(F.col("kind") == kind, group) for kind, group, _ in pairs))
    rank = F.coalesce(*(F.when(F.col("kind") == kind, i) for kind, _, i in pairs))
    return facts.withColumns({"group": name, "group_rank": rank})


def picked(facts: DataFrame, picks: DataFrame, name: str = "picked") -> DataFrame:
    """facts with a column of that name, which they lack: whether picks(doc_id, no) name them."""
    own = picks.select("doc_id", "no").distinct().withColumn(name, F.lit(True))
    return facts.join(own, ["doc_id", "no"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def confirmed(facts: DataFrame, picks: DataFrame) -> DataFrame:
    """The picked facts confirmed. Choosing one of several conflicting values rejects the pending others."""
    name = unused(facts, "picked")
    chosen = picked(facts, picks, name)
    conflicting = F.coalesce("conflict", F.lit(False))
    group = Window.partitionBy("doc_id", "kind")
    decided = F.max(F.when(conflicting, F.col(name))).over(group)
    loses = conflicting & F.coalesce(decided, F.lit(False)) & (F.col("verification") == "pending")
    return chosen.withColumn("verification", F.when(F.col(name), "confirmed").when(loses, "rejected").otherwise(F.col("verification"))).drop(name)


def rejected(facts: DataFrame, picks: DataFrame) -> DataFrame:
    name = unused(facts, "picked")
    return picked(facts, picks, name).withColumn("verification", F.when(F.col(name), "rejected").otherwise(F.col("verification"))).drop(name)


def noted(notes: str, note: str) -> Column:
    """A list of notes and one more, unless it is there."""
    return F.array_union(F.coalesce(notes, F.array().cast("array<string>")), F.array(F.lit(note)))


def edited(facts: DataFrame, edits: DataFrame) -> DataFrame:
    """Facts with the values that edits(doc_id, no, and value columns) give, now edited, of high confidence and noted as such."""
    values = [c for c in edits.columns if c not in ("doc_id", "no")]
    name = unused(facts, "edit")
    one = edits.groupBy("doc_id", "no").agg(F.min(F.struct(*values)).alias(name))
    out = facts.join(one, ["doc_id", "no"], "left")
    touched = F.col(name).isNotNull()
    new = {c: F.when(touched, F.col(f"{name}.{c}")).otherwise(F.col(c)) for c in values}
    new |= {"verification": F.when(touched, "edited").otherwise(F.col("verification")), "confidence": F.when(touched, "high").otherwise(F.col("confidence"))}
    new["notes"] = F.when(touched, noted("notes", "Edited by you.")).otherwise(F.col("notes"))
    return out.withColumns(new).drop(name)


def numbered_after(facts: DataFrame, new: DataFrame) -> DataFrame:
    """new rows with sort_index and no after the last of their document (1 where it has none), in the order of `no`."""
    last, last_no, order = (unused(new, n) for n in ("last", "last_no", "order"))
    ends = facts.groupBy("doc_id").agg(F.max("sort_index").alias(last), F.max("no").alias(last_no))
    out = new.withColumn(order, F.row_number().over(Window.partitionBy("doc_id").orderBy("no"))).join(ends, "doc_id", "left")
    return out.withColumns({"sort_index": F.coalesce(last, F.lit(0)) + F.col(order), "no": F.coalesce(last_no, F.lit(0)) + F.col(order)}).drop(last, last_no, order)


def added(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Facts and those that the user adds by hand (new: doc_id, no for their order, kind and value columns)."""
    own = new.withColumns({"origin": F.lit("user"), "verification": F.lit("confirmed"), "confidence": F.lit("high"), "notes": F.array(F.lit("Added by you."))})
    return facts.unionByName(numbered_after(facts, own), allowMissingColumns=True)


def typed_edit(edits: DataFrame) -> DataFrame:
    """What a user wrote as a typed value: edits(doc_id, no, kind, text, role, day, minor, term_value, term_unit, frequency, automatic,
    category). Blank values are left out, identifiers are upper case, and a date by hand is stated, never derived."""
    text = F.trim(F.coalesce("text", F.lit("")))
    kind, blank, amount = F.col("kind"), F.trim(F.coalesce("text", F.lit(""))) == "", F.col("minor").isNotNull()
    valid = F.when(kind.isin("title", "party", "obligation", "identifier"), ~blank).when(kind.isin("total_amount", "payment"), amount).otherwise(True)
    none = F.lit(None)
    return edits.where(valid).withColumns({
        "text": F.when(kind == "identifier", F.upper(text)).when((kind == "renewal") & blank, "Renewal terms").otherwise(F.nullif(text, F.lit(""))),
        "role": F.nullif(F.trim("role"), F.lit("")), "label": F.when(kind == "payment", F.when(blank, "Payment").otherwise(text)),
        "frequency": F.when(kind == "payment_frequency", F.coalesce("frequency", F.lit("monthly"))).otherwise(F.col("frequency")),
        "term_value": F.when((kind == "renewal") & (F.col("term_value") <= 0), none).otherwise(F.col("term_value")),
        "anchor": none.cast("string"), "after": none.cast("boolean"), "ambiguous": F.lit(False),
    })


def refreshed(facts: DataFrame) -> DataFrame:
    """Relative dates of pending facts, worked out anew from the document's dates; reviewed facts stay as they are."""
    new = lifecycle.resolve_relative(facts.withColumn("base_date", F.lit(None).cast("date")) if "base_date" not in facts.columns else facts)
    name = unused(facts, "new")
    derived = new.select("doc_id", "no", F.struct("day", "recurrence_end", "base_date").alias(name))
    pending = (F.col("verification") == "pending") & F.col(name).isNotNull()
    out = facts.join(derived, ["doc_id", "no"], "left")
    return out.withColumns({c: F.when(pending, F.col(f"{name}.{c}")).otherwise(F.col(c) if c in facts.columns else F.lit(None).cast("date")) for c in ("day", "recurrence_end", "base_date")}).drop(name)


def reapplied(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """A document read again: facts accepted, rejected or entered by the user stay; of the new ones those that say the same
    as one that stays are left out, the rest come after."""
    kept = existing.where(accepted(F.col("verification")) | F.col("origin").eqNullSafe("user") | F.col("verification").eqNullSafe("rejected"))
    both = [c for c in existing.columns if c in drafts.columns]
    said = lifecycle.alike(drafts.select(*both), kept.select(*both)).select("doc_id", F.col("l").alias("no")).distinct()
    return kept.unionByName(numbered_after(kept, drafts.join(said, ["doc_id", "no"], "left_anti")), allowMissingColumns=True)


# Names of statuses as they are shown.
STATUS_NAMES = {"upcoming": "Upcoming", "pending": "Pending", "overdue": "Overdue", "completed": "Completed", "received": "Received", "dismissed": "Dismissed"}


def history_of(name: Column, today: Column) -> Column:
    return F.array_append(F.coalesce("history", F.array().cast("array<string>")), F.concat(name, F.lit(" on "), F.date_format(today, "dd/MM/yyyy")))


def with_status(obligations: DataFrame, changes: DataFrame, today: Column) -> DataFrame:
    """Statuses as changes(obligation_id, new_status) say, with a line of history; closed ones get the day they closed."""
    own = unused(obligations, "new_status")
    out = obligations.join(changes.groupBy("obligation_id").agg(F.min("new_status").alias(own)), "obligation_id", "left")
    touched, new = F.col(own).isNotNull(), F.col(own)
    name = F.coalesce(F.create_map(*(F.lit(x) for pair in STATUS_NAMES.items() for x in pair))[new], F.initcap(new))
    return out.withColumns({
        "status": F.coalesce(new, "status"), "history": F.when(touched, history_of(name, today)).otherwise(F.col("history")),
        "completed_on": F.when(touched, F.when(~C.is_open(new), today)).otherwise(F.col("completed_on")),
    }).drop(own)


def reopened(obligations: DataFrame, ids: DataFrame, today: Column) -> DataFrame:
    """Payments are pending again and others upcoming."""
    name = unused(obligations, "again")
    out = obligations.join(ids.select("obligation_id").distinct().withColumn(name, F.lit(True)), "obligation_id", "left")
    again = F.col(name)
    status = F.when(F.col("category") == "payment", "pending").otherwise("upcoming")
    return out.withColumns({
        "status": F.when(again, status).otherwise(F.col("status")), "history": F.when(again, history_of(F.lit("Reopened"), today)).otherwise(F.col("history")),
        "completed_on": F.when(again, F.lit(None).cast("date")).otherwise(F.col("completed_on")),
    }).drop(name)


def advanced(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One step of every document named in outcomes(doc_id, failed, message): on to the next step, or failed with its message.
    What has been confirmed once stays confirmed after reading it again."""
    name = unused(documents, "outcome")
    out = documents.join(outcomes.groupBy("doc_id").agg(F.max(F.struct(F.coalesce("failed", F.lit(False)).alias("failed"), "message")).alias(name)), "doc_id", "left")
    step = F.coalesce(*(F.when(F.col("status") == a, b) for a, b in NEXT_STEP.items()), F.when(F.col("status") == "extracting", F.when(F.col("confirmed_on").isNotNull(), "confirmed").otherwise("needs_review")), "status")
    touched, failed = F.col(name).isNotNull() & F.col("status").isin(IN_FLIGHT), F.col(f"{name}.failed")
    return out.withColumns({
        "status": F.when(touched & failed, "failed").when(touched, step).otherwise(F.col("status")), "message": F.when(touched & failed, F.col(f"{name}.message")),
    }).drop(name)


def resumed(documents: DataFrame) -> DataFrame:
    """After a restart, documents that were left on their way begin anew."""
    return documents.withColumn("status", F.when(F.col("status").isin(IN_FLIGHT), "queued").otherwise(F.col("status")))


def provenance(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What reading leaves on a document: outcomes(doc_id, provider, sent_off_device, error, warnings). Only a provider without an
    error is noted; warnings are gathered, distinct and in order."""
    own = documents.withColumnRenamed("warnings", "old_warnings")
    out = own.join(outcomes.withColumnRenamed("error", "outcome_error"), "doc_id", "left")
    good = F.col("outcome_error").isNull()
    return out.withColumns({
        "sent_to_cloud": F.coalesce("sent_to_cloud", F.lit(False)) | (F.coalesce("sent_off_device", F.lit(False)) & good),
        "provider_name": F.when(good, F.coalesce("provider", "provider_name")).otherwise(F.col("provider_name")),
        "warnings": F.array_sort(F.array_union(F.coalesce("old_warnings", F.array().cast("array<string>")), F.coalesce("warnings", F.array().cast("array<string>")))), "message": F.col("outcome_error"),
    }).drop("provider", "sent_off_device", "outcome_error", "old_warnings")


def without_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table keyed by doc_id without the documents of ids: a deletion with all that hangs on it."""
    gone = ids.select("doc_id").distinct()
    return {name: table.join(gone, "doc_id", "left_anti") for name, table in tables.items()}


def text_source(sources: Column) -> Column:
    """What a document's text came from, of the set of its pages' sources."""
    own = F.array_sort(F.array_distinct(sources))
    only = lambda s: own == F.array(F.lit(s))
    return F.when(only("pdf_text"), "PDF text").when(only("ocr"), "Scanned (OCR)").when(only("none"), "No readable text").otherwise("PDF text and OCR")


# Names of types and kinds as they are shown.
KIND_NAMES = {
    "document_type": "Document type", "title": "Title", "party": "Party", "effective_date": "Effective date", "end_date": "End date", "notice_period": "Notice period", "renewal": "Renewal",
    "total_amount": "Total amount", "payment": "Payment", "payment_frequency": "Payment frequency", "obligation": "Obligation", "clause": "Clause", "identifier": "Identifier",
}


def kind_label(kind: Column, document_type: Column, agreements: list[str]) -> Column:
    """How a kind is called in a document of this type: papers that are no agreements have a document date."""
    names = F.create_map(*(F.lit(x) for pair in KIND_NAMES.items() for x in pair))
    return F.when((kind == "effective_date") & ~document_type.isin(agreements), "Document date").when((kind == "end_date") & (document_type == "quotation"), "Valid until").otherwise(names[kind])


def day_text(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def term_text(value: Column, unit: Column) -> Column:
    return F.concat(value.cast("string"), F.lit(" "), F.when(value == 1, F.regexp_replace(unit, "s$", "")).otherwise(unit))


#: What a relative date counts from, as it is shown.
ANCHORS = {"effective": "the effective date", "signing": "signing", "end": "the end date", "invoice": "the invoice date", "delivery": "delivery"}


def relative_phrase(value: Column, unit: Column, after: Column, anchor: Column, is_term: Column) -> Column:
    base = F.coalesce(F.create_map(*(F.lit(x) for pair in ANCHORS.items() for x in pair))[anchor], anchor)
    term = F.concat(F.lit("end of a "), term_text(value, unit), F.lit(" term from "), base)
    return F.when(F.coalesce(is_term, F.lit(False)), term).otherwise(F.concat(term_text(value, unit), F.when(after, " after ").otherwise(" before "), base))


def phrase_of_fact() -> Column:
    return relative_phrase(F.col("term_value"), F.col("term_unit"), F.col("after"), F.col("anchor"), F.col("is_term"))


def derivation() -> Column:
    """How a relative date of facts (with base_date) was worked out; null for stated dates and for kinds without dates."""
    base = F.when(F.col("base_date").isNull(), F.lit("; the base date is not known yet")).otherwise(F.concat(F.lit(", base date "), day_text(F.col("base_date"))))
    dated = F.col("kind").isin("effective_date", "end_date", "payment", "obligation") & F.col("anchor").isNotNull()
    return F.when(dated, F.concat(phrase_of_fact(), base))


def date_text() -> Column:
    """A date as it is shown: the day, with its derivation if it was worked out."""
    phrase = phrase_of_fact()
    known = F.concat(day_text(F.col("day")), F.lit(" ("), phrase, F.lit(": base "), day_text(F.col("base_date")), F.lit(")"))
    unknown = F.concat(F.upper(F.substring(phrase, 1, 1)), F.substring(phrase, F.lit(2), F.length(phrase)), F.lit(" (base date unknown)"))
    return F.when(F.col("anchor").isNotNull(), F.when(F.col("base_date").isNotNull() & F.col("day").isNotNull(), known).otherwise(unknown)).otherwise(F.coalesce(day_text(F.col("day")), F.lit("—")))


def words_of(name: Column) -> Column:
    """A code like half_yearly as words: Half yearly."""
    plain = F.replace(name, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, F.lit(2), F.length(plain)))


def display_text() -> Column:
    """The value of a fact as it is shown, by kind."""
    kind, has_due = F.col("kind"), F.col("day").isNotNull() | F.col("anchor").isNotNull()
    money = F.coalesce(C.money_text(F.col("minor"), F.col("currency")), F.lit("Amount not stated"))
    renewal = F.concat_ws(" ", F.when(F.col("automatic"), "Automatic renewal").when(~F.col("automatic"), "Renewal is not automatic"), F.concat(F.lit("for "), term_text(F.col("term_value"), F.col("term_unit"))))
    return (
        F.when(kind.isin("document_type", "clause"), words_of(F.col("category")))
        .when(kind == "party", F.when(F.col("role").isNotNull(), F.concat("text", F.lit(" ("), "role", F.lit(")"))).otherwise(F.col("text")))
        .when(kind.isin("effective_date", "end_date"), date_text())
        .when(kind == "total_amount", money)
        .when(kind == "notice_period", term_text(F.col("term_value"), F.col("term_unit")))
        .when(kind == "renewal", F.when(renewal == "", F.col("text")).otherwise(renewal))
        .when(kind == "payment", F.concat(money, F.when(has_due, F.concat(F.lit(" — due "), date_text())).otherwise(""), F.when(F.col("frequency").isNotNull(), F.concat(F.lit(" — "), F.lower(words_of(F.col("frequency"))))).otherwise("")))
        .when(kind == "payment_frequency", words_of(F.col("frequency")))
        .when(kind == "obligation", F.concat("text", F.when(has_due, F.concat(F.lit(" — by "), date_text())).otherwise("")))
        .when(kind == "identifier", F.concat(F.upper("category"), F.lit(": "), "text"))
        .otherwise(F.col("text"))
    )


def search_text() -> Column:
    """The words by which a fact is found."""
    shown, kind = display_text(), F.col("kind")
    more = F.when(kind == "payment", F.concat_ws(" ", "label", "payer", "payee")).when(kind == "obligation", F.coalesce("role", F.lit(""))).when(kind.isin("clause", "renewal"), F.coalesce("text", F.lit(""))).otherwise("")
    return F.rtrim(F.concat_ws(" ", shown, more))
