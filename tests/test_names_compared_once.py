"""Names of parties are compared for documents with an end, not for every fact of every document."""

from datetime import date

from factloom.operators import lifecycle

FACTS = "doc_id long, no int, kind string, text string, role string, label string, category string, minor long, currency string, day date, automatic boolean, term_value int, term_unit string, frequency string, recurrence_end date, payer string, payee string, verification string"
PARTIES = "doc_id long, user_party string, is_neither boolean, parties array<struct<name:string,role:string>>"


def fact(doc, no, kind, **given):
    names = [c.split()[0] for c in FACTS.split(", ")]
    return tuple(({"doc_id": doc, "no": no, "kind": kind, "verification": "confirmed"} | given).get(n) for n in names)


def test_names_are_compared_above_the_grouping(spark):
    rows = [fact(1, 0, "end_date", day=date(2024, 5, 31)), fact(1, 1, "notice_period", term_value=30, term_unit="days"), fact(2, 0, "notice_period", term_value=30, term_unit="days"), fact(3, 0, "end_date", day=date(2024, 6, 30)), fact(3, 1, "notice_period", term_value=1, term_unit="months")]
    parties = [(1, "Acme Tools", False, [("Acme Tools Pvt Ltd", "Vendor"), ("Buyer House", "Client")]), (2, "Acme Tools", False, [("Buyer House", "Client")])]
    built = lifecycle.build(spark.createDataFrame(rows, FACTS), spark.createDataFrame(parties, PARTIES)).where("category = 'notice_deadline'")
    assert sorted((r.doc_id, str(r.due_date), r.counterparty) for r in built.collect()) == [(1, "2024-05-01", "Buyer House"), (3, "2024-05-30", None)]
    lines = built._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    below = [[y for j, y in enumerate(lines) if j > i and depth[j] > depth[i] and all(d > depth[i] for d in depth[i + 1 : j])] for i, x in enumerate(lines) if x.lstrip(" :+-").startswith("Aggregate")]
    assert below and any("levenshtein" in x for x in lines) and not any("levenshtein" in x for own in below for x in own)
