"""Obligations: building them from accepted facts, their totals, reminders and re-planning.

Defined results: null amounts add nothing and null currencies are a group of their own; a null due date is never
upcoming, overdue or reminded of; a null status is no open one; repeated rows are counted and planned row by row, but
reminders of one id once; null ids never match; empty tables give no rows; ties in the reminder plan go by reminder id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def money_totals(obligations: DataFrame) -> DataFrame:
    """Open payments per currency: owed_to_me, i_owe (minor units) and unassigned (a count); other duties carry no money."""
    obligations = obligations.where(F.col("category") == "payment")
    way = lambda d: F.sum(F.when(F.col("direction") == d, F.col("amount_minor")).otherwise(0))
    return obligations.where(C.is_open(F.col("status"))).groupBy("currency").agg(
        way("owed_to_me").alias("owed_to_me"), way("i_owe").alias("i_owe"), F.count_if(F.col("direction") == "unknown").alias("unassigned")
    )


def upcoming(obligations: DataFrame, today: Column, days: int) -> DataFrame:
    """Open, not overdue, due within so many days."""
    now = C.effective_status(F.col("status"), F.col("due_date"), today)
    return obligations.where(now.isin("upcoming", "pending") & (F.col("due_date") <= F.date_add(today, days)))


def build(facts: DataFrame, parties: DataFrame) -> DataFrame:
    """Obligations of accepted facts; parties(doc_id, user_party, is_neither, parties array<struct<name,role>>)."""
    accepted = facts.where(F.col("verification").isin("confirmed", "edited"))
    user = F.col("user_party")
    other = F.filter("parties", lambda p: C.name_similarity(p["name"], user) < C.SAME_NAME)
    counterparty = F.when(user.isNull(), F.get("parties", 0)["name"]).otherwise(F.get(other, 0)["name"])
    own = accepted.join(parties, "doc_id", "left").withColumn("counterparty", counterparty)
    amount = C.money_text(F.col("minor"), F.col("currency"))
    keep = ["doc_id", "no", "counterparty", "frequency", "recurrence_end"]
    none = F.lit(None).cast("string")
    payments = C.direction(own.where("kind = 'payment'").drop("role")).select(
        *keep, F.lit("payment").alias("category"),
        F.when(F.col("frequency").isNotNull(), F.concat("label", F.lit(" "), amount)).otherwise(F.concat(amount, F.lit(" "), F.lower("label"))).alias("title"),
        F.col("minor").alias("amount_minor"), "currency", F.col("day").alias("due_date"), "direction", F.lit("pending").alias("status"),
    )
    first = lambda kind: F.min_by(F.struct("day", "automatic", "term_value", "term_unit", "no"), F.when(F.col("kind") == kind, F.col("no")))
    ends = accepted.where(F.col("kind").isin("end_date", "renewal", "notice_period")).groupBy("doc_id").agg(
        first("end_date").alias("end"), first("renewal").alias("renewal"), first("notice_period").alias("notice"),
    ).where("end.day is not null")
    # names are compared once for each document that something ends in, not for each fact
    ends = ends.join(parties.dropDuplicates(["doc_id"]), "doc_id", "left").withColumn("counterparty", counterparty)
    term = F.when(F.col("renewal.term_value").isNotNull(), F.format_string(" for %d %s", "renewal.term_value", F.when(F.col("renewal.term_value") == 1, F.expr("rtrim('s', renewal.term_unit)")).otherwise(F.col("renewal.term_unit")))).otherwise("")
    rest = [none.alias("frequency"), F.lit(None).cast("date").alias("recurrence_end")]

    def dated(no: str, category: Column, title: Column, due: Column) -> list[Column]:
        return [
            F.col("doc_id"), F.col(no).alias("no"), F.col("counterparty"), *rest, category.alias("category"), title.alias("title"),
            F.lit(None).cast("long").alias("amount_minor"), none.alias("currency"), due.alias("due_date"), F.lit("unknown").alias("direction"), F.lit("upcoming").alias("status"),
        ]

    auto, any_renewal = F.coalesce("renewal.automatic", F.lit(False)), F.col("renewal").isNotNull()
    close = ends.select(*dated("end.no", F.when(any_renewal, "renewal").otherwise("contract_end"),
        F.when(auto, F.concat(F.lit("Contract renews automatically"), term)).when(any_renewal, "Contract ends — renewal decision").otherwise("Contract ends"), F.col("end.day")))
    deadline = C.shifted(F.col("end.day"), F.col("notice.term_value"), F.col("notice.term_unit"), F.lit(False))
    notice = ends.where("notice is not null").select(*dated("notice.no", F.lit("notice_deadline"), F.format_string("Notice deadline (%d %s notice)", "notice.term_value", "notice.term_unit"), deadline))
    duties = own.where("kind = 'obligation'").select(
        *keep, "category", F.col("text").alias("title"), F.lit(None).cast("long").alias("amount_minor"), none.alias("currency"), F.col("day").alias("due_date"),
        F.lit("unknown").alias("direction"), F.lit("pending").alias("status"),
    )
    return payments.unionByName(close).unionByName(notice).unionByName(duties)


def plan_reminders(candidates: DataFrame, now: Column, limit: int = 60, hour: int = 9, per_recurring: int = 6) -> DataFrame:
    """The next reminders: occurrences times offsets, strictly in the future, soonest first; at `hour` in each candidate's `zone`, if
    there is such a column, else in the session's.

    Each day with reminders has one at least, so the first `limit` of them lie in its first `limit` days, or two more, which no
    zone is behind another: only those days' reminders are told apart and sorted."""
    start = F.to_date(now)
    repeated = C.occurrences(F.col("due_date"), F.col("frequency"), F.col("every"), F.col("recurrence_end"), start, per_recurring)
    days = F.when(F.col("frequency").isNull(), F.array("due_date")).otherwise(repeated)
    zone = F.col("zone") if "zone" in candidates.columns else F.lit(None).cast("string")
    rows = candidates.where("is_open").select("obligation_id", "title", "body", zone.alias("zone"), F.explode(days).alias("due"), F.array_distinct("offsets").alias("offsets"))
    rows = rows.select("*", F.explode("offsets").alias("days_before")).where("days_before >= 0")
    rows = rows.withColumn("fire_at", C.instant_at(F.date_sub("due", F.col("days_before")), hour, 0, F.col("zone"))).where(F.col("fire_at") > now)
    rows = rows.withColumn("fire_day", F.date_sub("due", F.col("days_before")))
    first = rows.select("fire_day").distinct().orderBy("fire_day").limit(limit).agg(F.date_add(F.max("fire_day"), 2).alias("last_day"))
    rows = rows.join(F.broadcast(first), F.col("fire_day") <= F.col("last_day"))
    key = F.concat_ws(".", F.lit("reminder"), F.col("obligation_id").cast("string"), F.date_format("due", "yyyy-MM-dd"), F.col("days_before").cast("string"))
    out = rows.select(key.alias("reminder_id"), "obligation_id", "title", C.due_text(F.col("due"), F.col("days_before"), F.col("body")).alias("body"), "due", "days_before", "fire_at")
    out = out.dropDuplicates(["reminder_id"])
    return out.orderBy("fire_at", "reminder_id").limit(limit)


def replanned(pending: DataFrame, planned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to drop, to add): what is pending but no longer planned, and planned but not yet pending."""
    return pending.join(planned, "reminder_id", "left_anti"), planned.join(pending, "reminder_id", "left_anti")


def finalized(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """Closed and touched obligations stay; the open untouched ones are replaced by the drafts that none of those covers."""
    kept = existing.where(~C.is_open(F.col("status")) | (F.size("history") > 0))
    return kept.unionByName(drafts.join(kept, ["doc_id", "no", "category"], "left_anti"), allowMissingColumns=True)


def marked_done(obligations: DataFrame) -> DataFrame:
    """Recurring ones move on to their next date; others are received or completed."""
    after = C.next_occurrence(F.col("due_date"), F.col("anchor_date"), F.col("frequency"), F.lit(1), F.col("recurrence_end"))
    moves = F.col("frequency").isNotNull() & after.isNotNull()
    done = F.when((F.col("category") == "payment") & (F.col("direction") == "owed_to_me"), "received").otherwise("completed")
    return obligations.withColumn("status", F.when(moves, "pending").otherwise(done)).withColumn("due_date", F.when(moves, after).otherwise(F.col("due_date")))


def trusted_date(facts: DataFrame, kind: str) -> DataFrame:
    """Per document the accepted or most trusted date of a kind."""
    rank = F.array_position(F.array(*map(F.lit, C.LEVELS)), F.col("confidence"))
    order = Window.partitionBy("doc_id").orderBy(F.col("verification").isin("confirmed", "edited").desc(), rank.desc(), "no")
    own = facts.where((F.col("kind") == kind) & (F.col("verification") != "rejected") & F.col("day").isNotNull())
    return own.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("doc_id", F.col("day").alias(kind))


def resolve_relative(facts: DataFrame) -> DataFrame:
    """Days of relative facts from the document's trusted effective and end dates."""
    bases = facts.select("doc_id").distinct().join(trusted_date(facts, "effective_date"), "doc_id", "left").join(trusted_date(facts, "end_date"), "doc_id", "left")
    base = F.when(F.col("anchor").isin("effective", "signing", "invoice"), F.col("effective_date")).when(F.col("anchor") == "end", F.col("end_date"))
    derived = C.derived_date(base, F.col("term_value"), F.col("term_unit"), F.col("after"), F.col("is_term"))
    out = facts.join(bases, "doc_id", "left").withColumn("base_date", base)
    return out.withColumn("day", F.when(F.col("anchor").isNotNull(), derived).otherwise(F.col("day"))).withColumn(
        "recurrence_end", F.when(F.col("frequency").isNotNull(), F.coalesce("recurrence_end", "end_date"))
    ).drop("effective_date", "end_date")


SINGLE = ["document_type", "title", "effective_date", "end_date", "notice_period", "renewal", "total_amount", "payment_frequency"]


def with_words(facts: DataFrame) -> DataFrame:
    """Word and name tokens as columns, so that no comparison works them out again."""
    return facts.withColumns({"words": C.tokens(F.col("text")), "names": C.name_tokens(F.col("text"))})


def equivalent(a: str, b: str) -> Column:
    """Whether the values of two facts of one kind (struct columns a and b, made `with_words`) say the same."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    kind, days = x("kind"), lambda f: C.approximate_days(f("term_value"), f("term_unit"))
    words, others = x("words"), y("words")
    both, any_ = F.size(F.array_intersect(words, others)), F.size(F.array_union(words, others))
    same_day, two_days = x("day") == y("day"), x("day").isNotNull() & y("day").isNotNull()
    relative = (days(x) == days(y)) & (x("after") == y("after"))
    due = lambda f: f("day").isNotNull() | f("anchor").isNotNull()
    said = (
        F.when(kind.isin("document_type", "clause"), x("category") == y("category"))
        .when(kind == "title", (F.size(words) > 0) & (both / any_ >= 0.6))
        .when(kind == "party", C.name_similarity_of(x("names"), y("names")) >= C.SAME_NAME)
        .when(kind.isin("effective_date", "end_date"), F.when(two_days, same_day).otherwise(relative))
        .when(kind == "total_amount", x("minor") == y("minor"))
        .when(kind == "notice_period", days(x) == days(y))
        .when(kind == "renewal", x("automatic").eqNullSafe(y("automatic")))
        .when(
            kind == "payment",
            x("minor").eqNullSafe(y("minor"))
            & F.when(two_days, same_day).when(x("anchor").isNotNull() & y("anchor").isNotNull(), days(x) == days(y)).otherwise(~due(x) | ~due(y)),
        )
        .when(kind == "payment_frequency", x("frequency") == y("frequency"))
        .when(kind == "obligation", x("day").eqNullSafe(y("day")) & (F.size(words) > 0) & (both / F.least(F.size(F.array_distinct(words)), F.size(F.array_distinct(others))) >= 0.4))
        .when(kind == "identifier", x("text") == y("text"))
    )
    return F.coalesce((kind == y("kind")) & said, F.lit(False))


def alike(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id, kind, l and r: numbers of the facts of one document and kind that say the same."""
    side = lambda facts, name: with_words(facts).select("doc_id", "kind", F.struct(*facts.columns, "words", "names").alias(name))
    met = side(left, "l").join(side(right, "r"), ["doc_id", "kind"]).where(equivalent("l", "r"))
    return met.select("doc_id", "kind", F.col("l.no").cast("int").alias("l"), F.col("r.no").cast("int").alias("r"))


def first_come(pairs: DataFrame) -> DataFrame:
    """One-to-one among the pairs l, r of each document and kind: in the order of l, each takes its first r still free."""
    state = "struct<l:array<int>,r:array<int>>"
    take = lambda acc, p: F.when(
        F.array_contains(acc["l"], p["l"]) | F.array_contains(acc["r"], p["r"]), acc
    ).otherwise(F.struct(F.array_append(acc["l"], p["l"]).alias("l"), F.array_append(acc["r"], p["r"]).alias("r")))
    rows = pairs.groupBy("doc_id", "kind").agg(F.array_sort(F.collect_list(F.struct("l", "r"))).alias("pairs"))
    folded = F.aggregate("pairs", F.expr(f"cast(named_struct('l', array(), 'r', array()) as {state})"), take)
    return rows.select("doc_id", folded.alias("t")).select("doc_id", F.explode(F.arrays_zip("t.l", "t.r")).alias("p")).select("doc_id", "p.l", "p.r")


def first_said(facts: DataFrame) -> DataFrame:
    """Facts without those that say the same as an earlier one that stays, by document and kind."""
    before = alike(facts, facts).where("r < l").groupBy("doc_id", "kind", "l").agg(F.collect_list("r").alias("earlier"))
    order = before.groupBy("doc_id", "kind").agg(F.array_sort(F.collect_list(F.struct("l", "earlier"))).alias("order"))
    # earlier ones that aren't in `order` have no earlier equal themselves: they stay
    gone = F.aggregate(
        "order", F.expr("cast(array() as array<int>)"),
        lambda acc, p: F.when(F.size(F.array_except(p["earlier"], acc)) > 0, F.array_append(acc, p["l"])).otherwise(acc),
    )
    dropped = order.select("doc_id", F.explode(gone).alias("no"))
    return facts.join(dropped, ["doc_id", "no"], "left_anti")


#: What a rule fact takes over from the model's, where it has none itself.
FILLED = {
    "role": ("party", "obligation"), "payer": ("payment",), "payee": ("payment",), "frequency": ("payment", "obligation"), "recurrence_end": ("payment", "obligation"),
    "automatic": ("renewal",),
}
#: Columns that go together: taken over only if all of them are empty.
DUE, TERM = ("day", "term_value", "term_unit", "after", "anchor"), ("term_value", "term_unit")
PLACE = ("at", "to", "quote")


def enriched(facts: DataFrame) -> DataFrame:
    """Rule facts with the model fact they were joined with in the struct `more` (null: none)."""
    out = {c: F.when(F.col("kind").isin(*kinds), F.coalesce(F.col(c), F.col(f"more.{c}"))).otherwise(F.col(c)) for c, kinds in FILLED.items()}
    for columns, here in ((TERM, F.col("kind") == "renewal"), (DUE, F.col("kind") == "payment"), (PLACE, F.lit(True))):
        bare = here & F.coalesce(*(F.col(c).cast("string") for c in columns)).isNull()
        out |= {c: F.when(bare, F.col(f"more.{c}")).otherwise(out.get(c, F.col(c))) for c in columns if columns is not DUE or c not in TERM}
    dueless = (F.col("kind") == "payment") & F.coalesce(*(F.col(c).cast("string") for c in DUE)).isNull()
    termless = (F.col("kind") == "renewal") & F.coalesce(*(F.col(c).cast("string") for c in TERM)).isNull()
    out |= {c: F.when(dueless | termless, F.col(f"more.{c}")).otherwise(F.col(c)) for c in TERM}
    out["label"] = F.when((F.col("kind") == "payment") & (F.col("label") == "Payment"), F.coalesce("more.label", "label")).otherwise(F.col("label"))
    return facts.withColumns(out)


def merged(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Rule facts first; in the model's order, each model fact joins the first rule fact it agrees with that none
    joined before (origin both, empty values filled); of the others, those that say what an earlier one of them says
    are dropped and the rest added (origin model). Then single-valued kinds with several values: a generic contract
    of the rules yields to the other type, the document's own title to none; all else gets a conflict mark.

    Defined results: facts of null doc_ids join none; a table without rows on either side leaves the other's facts.
    """
    for name, kind in {**dict(model.dtypes), **dict(rules.dtypes), "payer": "string", "payee": "string"}.items():
        rules = rules if name in rules.columns else rules.withColumn(name, F.lit(None).cast(kind))
        model = model if name in model.columns else model.withColumn(name, F.lit(None).cast(kind))
    rules, model = rules.persist(), model.persist()  # each is read several times below; lost parts are made again
    taken = first_come(alike(model, rules)).select("doc_id", F.col("l").alias("model_no"), F.col("r").alias("no")).persist()
    more = model.select(F.col("doc_id").alias("of"), F.col("no").alias("of_no"), F.struct(*model.columns).alias("more"))
    more = taken.join(more, (F.col("doc_id") == F.col("of")) & (F.col("model_no") == F.col("of_no"))).select("doc_id", "no", "more")
    base = enriched(rules.join(more, ["doc_id", "no"], "left")).withColumn("origin", F.when(F.col("more").isNotNull(), "both").otherwise("rules")).drop("more")
    others = model.join(taken.select("doc_id", F.col("model_no").alias("no")), ["doc_id", "no"], "left_anti")
    out = base.unionByName(first_said(others).withColumn("origin", F.lit("model")))
    return single_valued(out)


def single_valued(facts: DataFrame) -> DataFrame:
    """Settle or mark kinds that a document has once."""
    own = Window.partitionBy("doc_id", "kind")
    generic = F.col("kind").eqNullSafe("document_type") & (F.col("origin") == "rules") & F.col("category").eqNullSafe("contract")
    out = facts.withColumns({
        "several": F.col("kind").isin(SINGLE) & (F.count(F.lit(1)).over(own) > 1) & F.col("doc_id").isNotNull(),
        "yields": F.min(F.when(generic, F.col("no"))).over(own), "titled": (F.col("kind") == "title") & (F.count_if(F.col("origin") != "model").over(own) > 0),
    })
    gone = F.col("several") & ((generic & (F.col("no") == F.col("yields"))) | (F.col("titled") & (F.col("origin") == "model")))
    settled = F.col("yields").isNotNull() | F.col("titled")
    return out.where(~F.coalesce(gone, F.lit(False))).withColumn("conflict", F.coalesce(F.col("several") & ~settled, F.lit(False))).drop("several", "yields", "titled")
