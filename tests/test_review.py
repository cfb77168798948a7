"""Review, profile, place and search operators on rows that tables rarely hold: nulls, repeats, unknown keys, nothing at all."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.operators import geometry, layout, profile, review
from factloom.operators import search as S

FACTS = "doc_id long, no int, kind string, text string, verification string, confidence string, conflict boolean, origin string, sort_index int, minor long, notes array<string>"


def facts(spark):
    rows = [
        (1, 0, "payment", "a", "pending", "high", None, "rules", 0, 5, None), (1, 1, "end_date", "b", "pending", "high", True, "rules", 1, None, ["x"]), (1, 2, "end_date", "c", "pending", "low", True, "model", 2, None, []),
        (1, 2, "end_date", "c", "pending", "low", True, "model", 2, None, []), (None, 3, "payment", None, None, None, None, None, None, None, None), (2, 0, "title", None, "rejected", "high", False, "user", 9, None, None),
    ]
    return spark.createDataFrame(rows, FACTS)


def keys(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, no int")


def test_choosing_one_value_rejects_the_others(spark):
    out = review.confirmed(facts(spark), keys(spark, (1, 1), (1, 1), (7, 7), (None, 3))).collect()
    assert len(out) == 6
    assert sorted(str((r.doc_id, r.no, r.verification)) for r in out) == sorted(map(str, [(1, 0, "pending"), (1, 1, "confirmed"), (1, 2, "rejected"), (1, 2, "rejected"), (None, 3, None), (2, 0, "rejected")]))
    assert review.rejected(facts(spark), keys(spark)).where("verification = 'rejected'").count() == 1
    assert sorted((r.doc_id, r.no) for r in review.acceptable_together(facts(spark)).collect()) == [(1, 0)]


def test_edits_and_additions(spark):
    edits = spark.createDataFrame([(1, 0, 7), (1, 0, 8), (5, 5, 1)], "doc_id long, no int, minor long")
    once = review.edited(facts(spark), edits)
    twice = review.edited(once, edits).where("doc_id = 1 and no = 0").first()
    assert (twice.minor, twice.verification, twice.confidence, twice.notes) == (7, "edited", "high", ["Edited by you."])
    new = spark.createDataFrame([(1, 0, "title", "t"), (1, 1, "party", "p"), (9, 0, "title", "n")], "doc_id long, no int, kind string, text string")
    out = review.added(facts(spark), new)
    assert sorted((r.doc_id, r.sort_index, r.no) for r in out.where("origin = 'user' and verification = 'confirmed'").collect()) == [(1, 3, 3), (1, 4, 4), (9, 1, 1)]
    assert out.count() == 9 and review.added(facts(spark), new.limit(0)).count() == 6


def test_typed_edits(spark):
    names = "doc_id long, no int, kind string, text string, role string, day date, minor long, term_value int, term_unit string, frequency string, automatic boolean, category string"
    rows = [
        (1, 0, "title", "  ", None, None, None, None, None, None, None, None), (1, 1, "party", " Acme ", " ", None, None, None, None, None, None, None), (1, 2, "identifier", " ab12 ", None, None, None, None, None, None, None, None),
        (1, 3, "payment", "", None, date(2024, 1, 1), 5, None, None, None, None, None), (1, 4, "payment", "x", None, None, None, None, None, None, None, None), (1, 5, "renewal", "", None, None, None, 0, "days", None, True, None),
        (1, 6, "payment_frequency", None, None, None, None, None, None, None, None, None), (1, 7, "effective_date", None, None, date(2024, 1, 1), None, None, None, None, None, None),
    ]
    got = {r.no: r for r in review.typed_edit(spark.createDataFrame(rows, names)).collect()}
    assert set(got) == {1, 2, 3, 5, 6, 7}
    assert (got[1].text, got[1].role, got[2].text, got[3].label) == ("Acme", None, "AB12", "Payment")
    assert (got[5].text, got[5].term_value, got[6].frequency, got[7].anchor) == ("Renewal terms", None, "monthly", None)


def test_derived_dates_of_pending_facts_alone(spark):
    names = "doc_id long, no int, kind string, day date, verification string, confidence string, anchor string, term_value int, term_unit string, after boolean, is_term boolean, frequency string, recurrence_end date"
    rows = [(1, 0, "effective_date", date(2024, 1, 1), "confirmed", "high", None, None, None, None, None, None, None)] + [(1, i, "payment", None, v, "high", "effective", 10, "days", True, None, None, None) for i, v in ((1, "pending"), (2, "confirmed"))]
    got = {r.no: (r.day, r.base_date) for r in review.refreshed(spark.createDataFrame(rows, names)).collect()}
    assert got == {0: (date(2024, 1, 1), None), 1: (date(2024, 1, 11), date(2024, 1, 1)), 2: (None, None)}


def test_statuses_of_unknown_ids_change_nothing(spark):
    o = spark.createDataFrame([(1, "pending", "payment", None, None), (2, None, None, ["old"], date(2020, 1, 1)), (None, "overdue", "payment", None, None)], "obligation_id long, status string, category string, history array<string>, completed_on date")
    changes = spark.createDataFrame([(1, "completed"), (1, "completed"), (5, "pending")], "obligation_id long, new_status string")
    day = F.lit("2024-05-06").cast("date")
    got = {r.obligation_id: r for r in review.with_status(o, changes, day).collect()}
    assert (got[1].status, got[1].history, got[1].completed_on) == ("completed", ["Completed on 06/05/2024"], date(2024, 5, 6))
    assert (got[2].status, got[2].history, got[2].completed_on, got[None].status) == (None, ["old"], date(2020, 1, 1), "overdue")
    again = {r.obligation_id: r for r in review.reopened(o, changes.select("obligation_id").unionByName(o.select("obligation_id").where("obligation_id = 2")), day).collect()}
    assert (again[1].status, again[2].status, again[2].completed_on, again[2].history) == ("pending", "upcoming", None, ["old", "Reopened on 06/05/2024"])


def test_profiles(spark):
    docs = spark.createDataFrame([(1, ["Acme Tools Ltd", "Zed"]), (2, ["Acme Tools", "M/s Acme Tools"]), (3, ["Acme", None]), (4, []), (5, None)], "doc_id long, parties array<string>")
    me = lambda name, business="", aliases=(): F.struct(F.lit(name).alias("name"), F.lit(business).alias("business"), F.array(*map(F.lit, aliases)).cast("array<string>").alias("aliases"))
    got = {r.doc_id: (r.outcome, r.party_index, r.candidates) for r in profile.matched(docs, me("Acme Tools", aliases=("ACME TOOLS LLP", "Nobody"))).collect()}
    assert got == {1: ("matched", 0, None), 2: ("ambiguous", None, [0, 1]), 3: ("ambiguous", None, [0]), 4: ("none", None, None), 5: ("none", None, None)}
    assert {r.outcome for r in profile.matched(docs, me(" ", "Acme Tools")).collect()} == {"none"}
    names = spark.range(1).select(profile.profile_names(F.lit(" A B "), F.lit(None), profile.alias_list(F.lit("mr a b,, C \n d"))).alias("n")).first().n
    assert [n.name for n in names] == ["A B", "C", "d"]
    chosen = docs.selectExpr("doc_id", "parties", "cast(null as string) user_party", "false is_neither", "'undetermined' identity")
    mine = profile.chosen_identity(chosen, spark.createDataFrame([(1, "Zed"), (2, None)], "doc_id long, party string"))
    after = {r.doc_id: (r.user_party, r.is_neither, r.identity) for r in profile.identified(mine, me("Acme Tools")).collect()}
    assert after[1] == ("Zed", False, "user_chosen") and after[2] == (None, True, "user_chosen") and after[4] == (None, False, "undetermined")


def test_similar_names_against_all_pairs(spark):
    from factloom.functions import columns as C

    names = ["Acme Tools", "Acme Tool", "Acmee Tools Ltd", "Zed Quarry", "Quarry", "Zedd Quary", "", None, "Acme"]
    rows = spark.createDataFrame([(n,) for n in names + names[:3]], "n string")
    got = {(r.a, r.b) for r in profile.similar_names(rows, "n", 0.6).collect()}
    both = rows.distinct().select(F.col("n").alias("a")).crossJoin(rows.distinct().select(F.col("n").alias("b")))
    assert got == {(r.a, r.b) for r in both.where(C.name_similarity(F.col("a"), F.col("b")) >= 0.6).collect()}


def test_similar_names_under_edits_and_hot_words(spark):
    """Equal to all pairs on names with one to three edits, and no more candidates than names on a word that all share."""
    import random

    from factloom.functions import columns as C

    rng = random.Random(3)
    letters = "abcdeorstuvw"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 14)))

    def edited(name):
        for _ in range(rng.randrange(1, 4)):
            i, form = rng.randrange(len(name)), rng.randrange(3)
            name = name[:i] + ("" if form == 0 else rng.choice(letters + " ")) + name[i + (form < 2) :]
        return name

    names = ["internationalisation", "intarnationalisatoon", "a b", "ab", "Services", "services ltd", "x", "Ünïted"]
    for _ in range(60):
        name = " ".join(word() for _ in range(rng.randrange(1, 5)))
        names += [name, edited(name), edited(name), " ".join(reversed(name.split())), name + " services"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").distinct()
    both = rows.select(F.col("n").alias("a")).crossJoin(rows.select(F.col("n").alias("b"))).withColumn("s", C.name_similarity(F.col("a"), F.col("b")))
    for least in (0.6, 0.85):
        assert {(r.a, r.b) for r in profile.similar_names(rows, "n", least).collect()} == {(r.a, r.b) for r in both.where(f"s >= {least}").collect()}
    hot = spark.range(3000).selectExpr("concat('services ', substring(sha2(cast(id as string), 256), 1, 12)) n").withColumn("tokens", C.name_tokens(F.col("n")))
    assert profile.by_words(hot).count() < 2 * 3000
    with pytest.raises(ValueError):
        profile.similar_names(rows, "n", 0.3)


def test_boxes_of_parts_and_of_nothing(spark):
    parts = "array<struct<at:int,to:int,x:double,y:double,w:double,h:double>>"
    lines = spark.createDataFrame(
        [(1, 0, 0, "abcdefghij", 0.0, 0.5, 1.0, 0.1, 0.9, [(0, 4, 0.0, 0.5, 0.4, 0.1), (6, 10, 0.6, 0.5, 0.4, 0.1)]), (1, 0, 1, None, 0.0, 0.4, 1.0, 0.1, 0.2, None), (1, 0, 2, "klm", 0.0, 0.3, 0.3, 0.1, None, [])],
        f"doc_id long, page int, line int, text string, x double, y double, w double, h double, confidence double, parts {parts}",
    )
    spans = spark.createDataFrame([(7, 1, 0, 2, 13), (8, 1, 0, 500, 510), (9, 2, 0, 0, 5)], "span_id long, doc_id long, page int, page_at int, page_to int")
    got = sorted((r.span_id, r.line, round(r.x, 3), round(r.w, 3)) for r in geometry.boxes(spans, lines).collect())
    assert got == [(7, 0, 0.2, 0.2), (7, 0, 0.6, 0.4), (7, 2, 0.0, 0.1)]
    assert {r.span_id: r.confidence for r in geometry.span_confidence(spans, lines).collect()} == {7: 0.9, 8: 0.0, 9: 0.0}
    assert geometry.boxes(spans.limit(0), lines).count() == 0
    extra = spark.createDataFrame([(1, 0, 5, 9), (1, 1, 6, 8), (1, 2, 8, 12), (2, 0, 1, 2)], "fact int, n int, at int, to int")
    assert sorted((r.fact, r.n) for r in geometry.extra_spans(extra).collect()) == [(1, 0), (1, 2), (2, 0)]


def test_quotes_with_pattern_marks(spark):
    docs = spark.createDataFrame([(1, r"a \E(b) one two three four five six seven. \E(b)"), (2, None), (3, "")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, r"\E(b)"), (2, "one two three four five six seven"), (3, None), (4, "e two three four five six sev"), (5, "zz")], "item_id long, quote string")
    got = {r.item_id: r.places for r in layout.quote_matches(docs, quotes).collect()}
    assert {k: len(v) for k, v in got.items()} == {1: 2, 2: 1, 4: 1}


def test_index_of_awkward_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, None), (2, "Rent deed", "deed.pdf", "rental_agreement", ["home"], "Total 1,500.00 and Rs. 20")], "doc_id long, title string, filename string, document_type string, tags array<string>, full_text string")
    empty_facts = spark.createDataFrame([], FACTS + ", role string, payer string, payee string, label string, category string, day date, anchor string, base_date date, currency string, term_value int, term_unit string, after boolean, is_term boolean, automatic boolean, frequency string")
    duties = spark.createDataFrame([], "obligation_id long, doc_id long, title string, counterparty string, status string, due_date date, amount_minor long")
    index = S.build(docs, empty_facts, duties, F.lit("2024-01-01").cast("date"))
    assert {r.doc_id: r.text_amounts for r in index.collect()} == {1: [], 2: [2000, 150000]}
    assert [tuple(r) for r in S.search(index, "home deed").collect()] == [(2, 7.0)]
    assert S.search(index, "  ").count() == 0
    hit = S.hydrated(S.search(index, "total"), docs, "total").first()
    assert hit.snippet.startswith("Total 1,500") and hit.title == "Rent deed"


def test_lists_and_badges(spark):
    parties = spark.createDataFrame([("Acme Tools Ltd", "ACME tools"), ("Zed", "ACME tools"), (None, "x"), ("x", None)], "name string, user_party string")
    assert [r.is_user for r in review.is_user(parties).collect()] == [True, False, False, False]
    docs = spark.createDataFrame([(1, date(2024, 1, 1)), (2, None), (3, date(2024, 2, 1)), (4, date(2024, 2, 1))], "doc_id long, added_on date")
    assert [r.doc_id for r in review.newest_first(docs).collect()] == [3, 4, 1, 2]
    o = spark.createDataFrame([("pending", "payment", "owed_to_me", 5, c) for c in ("USD", "INR", "EUR", "INR")], "status string, category string, direction string, amount_minor long, currency string")
    assert [(r.currency, r.owed_to_me) for r in review.totals_listed(o).collect()] == [("EUR", 5), ("INR", 10), ("USD", 5)]
    due = spark.createDataFrame([(1, 1, None), (1, 2, date(2024, 1, 1)), (None, 3, None)], "doc_id long, obligation_id long, due_date date")
    assert {r.obligation_id: r.place for r in review.by_due(due).collect()} == {1: 2, 2: 1, 3: 1}
    gone = review.without_documents({"due": due}, docs.where("doc_id = 1"))["due"].collect()
    assert [r.obligation_id for r in gone] == [3]


def test_shown_texts_of_every_kind(spark):
    names = "kind string, text string, role string, category string, minor long, currency string, day date, base_date date, anchor string, after boolean, is_term boolean, term_value int, term_unit string, automatic boolean, frequency string, label string, payer string, payee string"
    base = dict.fromkeys(c.split()[0] for c in names.split(", "))
    rows = [
        ({"kind": "party", "text": "Acme", "role": "Vendor"}, "Acme (Vendor)", "Acme (Vendor)"), ({"kind": "title", "text": "Deed"}, "Deed", "Deed"), ({"kind": "document_type", "category": "rental_agreement"}, "Rental agreement", "Rental agreement"),
        ({"kind": "renewal", "text": "may renew", "automatic": True, "term_value": 1, "term_unit": "years"}, "Automatic renewal for 1 year", "Automatic renewal for 1 year may renew"), ({"kind": "renewal", "text": "may renew"}, "may renew", "may renew may renew"),
        ({"kind": "payment", "label": "Rent", "payer": "Zed"}, "Amount not stated", "Amount not stated Rent Zed"), ({"kind": "obligation", "text": "Send it", "day": date(2024, 1, 2), "role": "Acme"}, "Send it — by 02/01/2024", "Send it — by 02/01/2024 Acme"),
        ({"kind": "end_date", "anchor": "effective", "is_term": True, "term_value": 11, "term_unit": "months"}, "End of a 11 months term from the effective date (base date unknown)",) * 1 + ("End of a 11 months term from the effective date (base date unknown)",) * 2,
        ({"kind": "end_date"}, "—", "—"), ({"kind": "payment_frequency", "frequency": "half_yearly"}, "Half yearly", "Half yearly"), ({"kind": "identifier", "text": "AB1", "category": "pan"}, "PAN: AB1", "PAN: AB1"),
    ]
    for given, *_ in rows:
        assert set(given) <= set(base)
    df = spark.createDataFrame([(i, *(base | r[0]).values()) for i, r in enumerate(rows)], "i int, " + names)
    got = {r.i: (r.shown, r.found) for r in df.select("i", review.display_text().alias("shown"), review.search_text().alias("found")).collect()}
    assert got == {i: (r[-2], r[-1]) for i, r in enumerate(rows)}


def test_columns_named_like_the_operators_own_stay(spark):
    names = ["picked", "open", "edit", "last", "last_no", "order", "new", "new_status", "again", "outcome"]
    extra = {n: F.lit(f"own {n}") for n in names}
    facts = spark.createDataFrame([(1, 1, "pending", "title", "a", "low", 1, False, None, None)], "doc_id long, no int, verification string, kind string, text string, confidence string, sort_index int, conflict boolean, notes array<string>, day date").withColumns(extra)
    picks, edits = spark.createDataFrame([(1, 1)], "doc_id long, no int"), spark.createDataFrame([(1, 1, "b")], "doc_id long, no int, text string")
    docs = spark.createDataFrame([(1, "confirmed", None)], "doc_id long, status string, confirmed_on date").withColumns(extra)
    duty = spark.createDataFrame([(1, "pending", "payment", None, None)], "obligation_id long, status string, category string, history array<string>, completed_on date").withColumns(extra)
    today, change = F.lit("2024-05-01").cast("date"), spark.createDataFrame([(1, "completed")], "obligation_id long, new_status string")
    outcomes = spark.createDataFrame([(1, True, "no")], "doc_id long, failed boolean, message string")
    for out in (
        review.confirmed(facts, picks), review.rejected(facts, picks), review.edited(facts, edits), review.needs_review(docs, facts), review.numbered_after(facts, facts),
        review.with_status(duty, change, today), review.reopened(duty, change, today), review.advanced(docs, outcomes),
    ):
        row = out.first()
        assert all(row[n] == f"own {n}" for n in names)
