"""Queries read all of their input: every layout, every obligation."""

import pytest

from factloom.plans import queries
from factloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", "render_due_date render_rent render_payments render_notice render_renewal render_term_end obligations_from_facts".split())
def test_every_layout_is_read(spark, monkeypatch, name):
    read = []
    extract = queries.extract_facts
    monkeypatch.setattr(queries, "extract_facts", lambda docs: read.append(docs) or extract(docs))
    QUERIES[name](spark, DATA)
    assert len(read) == 1
    assert {r.variant for r in read[0].select("variant").distinct().collect()} == set(range(10))


def test_every_obligation_recurs(spark):
    n = queries.obligations(spark, DATA).count()
    assert QUERIES["next_occurrence"](spark, DATA).count() == n
    assert QUERIES["recurrence_occurrences"](spark, DATA).where("k = 1").count() == QUERIES["next_occurrence"](spark, DATA).where("next_day is not null").count()
