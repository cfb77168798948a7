"""Scalar semantics of the domain as Column expressions: all of it stays inside Catalyst.

Null inputs give null unless said otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Letters with marks and full-width forms, by rule, and what they fold to."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base != chr(code) and len(base) == 1 and ord(base) < 0x80:
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()
# Typographic quotes, primes and dashes and their plain forms; characters of no width.
PLAIN_FROM, PLAIN_TO = "‘’‚‛′“”„‟″‐‑‒–—―−", "'''''\"\"\"\"\"-------"
NO_WIDTH = "​‌‍⁠﻿­"


def folded(text: Column) -> Column:
    """Case, marks and width folded."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def normalized(text: Column) -> Column:
    """Comparison form: folded, plain quotes and dashes, white space runs as one space, trimmed."""
    plain = F.translate(text, PLAIN_FROM + NO_WIDTH, PLAIN_TO)
    return F.trim(F.regexp_replace(folded(plain), r"(?U)\s+", " "))


def search_key(text: Column) -> Column:
    """Index form: letters, digits and the rupee sign; anything else is one space, none at the start."""
    return F.ltrim(F.regexp_replace(folded(text), r"[^\p{L}\p{M}\p{N}₹]+", " "))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalized(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


# Words that don't tell names apart.
HONORIFICS = "mr ms mrs dr shri smt sri kumari m s messrs the".split()
COMPANY_WORDS = "pvt private ltd limited llp inc incorporated co company corp corporation opc plc llc gmbh proprietor proprietorship".split()
SAME_NAME, MAYBE_NAME = 0.85, 0.6


def name_tokens(name: Column) -> Column:
    noise = F.array(*(F.lit(w) for w in HONORIFICS + COMPANY_WORDS))
    return F.filter(tokens(name), lambda t: ~F.array_contains(noise, t))


def name_similarity_of(a: Column, b: Column) -> Column:
    """Similarity of two token arrays: equal, contained, near in spelling, or sharing words up to a typo."""
    left, right = F.array_join(a, " "), F.array_join(b, " ")
    sa, sb = F.array_distinct(a), F.array_distinct(b)
    swap = F.size(sa) > F.size(sb)
    small, large = F.when(swap, sb).otherwise(sa), F.when(swap, sa).otherwise(sb)
    ratio = 1 - F.levenshtein(left, right) / F.greatest(F.length(left), F.length(right))
    near = lambda t: F.exists(large, lambda u: (u == t) | ((F.length(u) >= 5) & (F.levenshtein(u, t) <= 1)))
    shared = F.size(F.filter(small, near))
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .when(left == right, 1.0)
        .when(
            F.size(F.array_except(small, large)) == 0,
            F.when(F.size(small) >= 2, 0.9).when(F.exists(small, lambda t: F.length(t) >= 3), 0.65).otherwise(0.4),
        )
        .when(ratio >= 0.88, 0.86)
        .otherwise(0.8 * shared / F.size(large))
    )


def name_similarity(a: Column, b: Column) -> Column:
    return name_similarity_of(name_tokens(a), name_tokens(b))


# Roles that pay, roles that are paid.
PAYER_ROLES = ["client", "customer", "buyer", "tenant", "lessee", "licensee", "purchaser", "bill to", "billed to", "company"]
PAYEE_ROLES = [
    "service provider", "freelancer", "consultant", "vendor", "contractor", "supplier", "seller",
    "landlord", "lessor", "licensor", "agency", "developer", "designer",
]


def with_name_tokens(df: DataFrame) -> DataFrame:
    """Tokens of payer, payee, user_party and the parties' names, computed once in columns of their own."""
    return df.withColumns(
        {"payer_tokens": name_tokens(F.coalesce("payer", F.lit(""))), "payee_tokens": name_tokens(F.coalesce("payee", F.lit(""))), "user_tokens": name_tokens(F.col("user_party")),
         "party_tokens": F.transform(F.coalesce("parties", F.expr("cast(array() as array<struct<name:string,role:string>>)")), lambda p: F.struct(p["role"].alias("role"), name_tokens(p["name"]).alias("tokens")))}
    )


def direction(df: DataFrame) -> DataFrame:
    """Adds direction: owed_to_me, i_owe, not_mine or unknown. Columns: payer, payee, user_party, is_neither and
    parties array<struct<name,role>>. Similarities are columns first, so that none is worked out twice."""
    rows = with_name_tokens(df)
    like = lambda a, b: F.coalesce(name_similarity_of(a, b) >= SAME_NAME, F.lit(False))
    any_party = lambda who: F.exists("party_tokens", lambda p: like(p["tokens"], F.col(who)))
    rows = rows.withColumns(
        {"user_is_payee": like(F.col("payee_tokens"), F.col("user_tokens")), "user_is_payer": like(F.col("payer_tokens"), F.col("user_tokens")),
         "payer_known": any_party("payer_tokens"), "payee_known": any_party("payee_tokens"),
         "role": F.lower(F.get(F.filter("party_tokens", lambda p: like(p["tokens"], F.col("user_tokens"))), 0)["role"])}
    )
    two = F.size("parties") == 2
    has = lambda roles: F.coalesce(F.col("role").rlike("|".join(roles)), F.lit(False))
    found = (
        F.when(F.coalesce("is_neither", F.lit(False)), "not_mine")
        .when(F.col("user_party").isNull(), "unknown")
        .when(F.col("user_is_payee"), "owed_to_me")
        .when(F.col("user_is_payer"), "i_owe")
        .when(two & F.col("payer_known"), "owed_to_me")
        .when(two & F.col("payee_known"), "i_owe")
        .when(has(PAYEE_ROLES), "owed_to_me")
        .when(has(PAYER_ROLES), "i_owe")
        .otherwise("unknown")
    )
    return rows.withColumn("direction", found).select(*df.columns, "direction")


OPEN = ["upcoming", "pending", "overdue"]


def is_open(status: Column) -> Column:
    return status.isin(OPEN)


def effective_status(status: Column, due: Column, today: Column) -> Column:
    """Closed states stay; a missed due date is overdue; a stored overdue that isn't past is pending."""
    return F.when(~is_open(status) | due.isNull(), status).when(due < today, "overdue").when(status == "overdue", "pending").otherwise(status)


def step_months(frequency: Column) -> Column:
    return F.when(frequency == "monthly", 1).when(frequency == "quarterly", 3).when(frequency == "half_yearly", 6).when(frequency == "yearly", 12)


def occurrence(n: Column, anchor: Column, frequency: Column, interval: Column) -> Column:
    """The n-th date from the anchor: the anchor's day of month is kept and clamped each time."""
    k = (n * interval).cast("int")
    return F.when(frequency == "weekly", F.date_add(anchor, k * 7)).otherwise(F.add_months(anchor, k * step_months(frequency)))


def first_step(anchor: Column, frequency: Column, interval: Column, start: Column) -> Column:
    """A step number at or before the first occurrence from start on (never below 0), without enumerating."""
    weeks = F.floor(F.datediff(start, anchor) / (7 * interval))
    months = F.floor(F.months_between(start, anchor) / (step_months(frequency) * interval))
    return F.greatest(F.lit(0), F.when(frequency == "weekly", weeks).otherwise(months).cast("int") - 1)


def occurrences(anchor: Column, frequency: Column, interval: Column, end: Column, start: Column, limit: int) -> Column:
    """Dates from start on, up to limit, not past end (null: none)."""
    at = first_step(anchor, frequency, interval, start)
    dates = F.transform(F.sequence(at, at + limit + 2), lambda n: occurrence(n, anchor, frequency, interval))
    good = F.filter(dates, lambda d: (d >= start) & (end.isNull() | (d <= end)))
    return F.slice(good, 1, limit)


def next_occurrence(current: Column, anchor: Column, frequency: Column, interval: Column, end: Column) -> Column:
    return F.get(occurrences(anchor, frequency, interval, end, F.date_add(current, 1), 1), 0)


def approximate_days(value: Column, unit: Column) -> Column:
    return value * F.when(unit == "weeks", 7).when(unit == "months", 30).when(unit == "years", 365).otherwise(1)


def shifted(day: Column, value: Column, unit: Column, after: Column) -> Column:
    """The date a duration after (or before) a day; months clamp to the month's end."""
    sign = F.when(after, value).otherwise(-value).cast("int")
    return (
        F.when(unit == "weeks", F.date_add(day, sign * 7))
        .when(unit == "months", F.add_months(day, sign))
        .when(unit == "years", F.add_months(day, sign * 12))
        .otherwise(F.date_add(day, sign))
    )


def derived_date(base: Column, value: Column, unit: Column, after: Column, is_term: Column) -> Column:
    """base shifted; a term ends the day before its anniversary."""
    day = shifted(base, value, unit, after)
    return F.when(F.coalesce(is_term, F.lit(False)), F.date_sub(day, 1)).otherwise(day)


def first_on_day(day: Column, start: Column) -> Column:
    """First date on or after start whose day of month is `day`, clamped to short months."""

    def within(month: Column) -> Column:
        return F.date_add(F.trunc(month, "month"), F.least(day, F.day(F.last_day(month))).cast("int") - 1)

    return F.when(within(start) >= start, within(start)).otherwise(within(F.add_months(start, 1)))


def minor_units(amount: Column) -> Column:
    """Amount in hundredths, halves away from zero."""
    return F.round(amount.cast("decimal(38,6)") * 100).cast("long")


# Signs of currencies.
SIGNS = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£"}


def money_text(minor: Column, currency: Column) -> Column:
    """Sign before symbol, Indian grouping for INR and western elsewhere, fraction only if there is one."""
    whole, part = F.abs(minor).cast("decimal(20,0)"), F.abs(minor) % 100
    digits = F.floor(whole / 100).cast("string")
    head = F.when(F.length(digits) > 3, F.substring(digits, F.lit(1), F.length(digits) - 3)).otherwise("")
    indian = F.when(F.length(digits) <= 3, digits).otherwise(
        F.concat(F.regexp_replace(head, r"(?<=\d)(?=(?:\d\d)+$)", ","), F.lit(","), F.substring(digits, F.length(digits) - 2, F.lit(3)))
    )
    western = F.regexp_replace(digits, r"(?<=\d)(?=(?:\d{3})+$)", ",")
    sign = F.when(minor < 0, "-").otherwise("")
    symbol = F.coalesce(F.create_map(*(F.lit(x) for pair in SIGNS.items() for x in pair))[currency], F.concat(currency, F.lit(" ")))
    fraction = F.when(part != 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 2, "0"))).otherwise("")
    return F.concat(sign, symbol, F.when(currency == "INR", indian).otherwise(western), fraction)


def instant_at(day: Column, hour: int, minute: int, zone: Column) -> Column:
    """The instant of a time of day in a zone; the session's where the zone is null. A time that a switch of clocks skips is as much
    later as clocks go forward; of one that comes twice the first is taken."""
    local = F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), F.lit(hour), F.lit(minute), F.lit(0))
    utc = F.convert_timezone(F.coalesce(zone, F.current_timezone()), F.lit("UTC"), local)
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), utc))


def due_text(due: Column, days: Column, base: Column) -> Column:
    day = F.date_format(due, "d MMM yyyy")
    when = (
        F.when(days == 0, F.concat(F.lit("Due today ("), day, F.lit(")")))
        .when(days == 1, F.concat(F.lit("Due tomorrow ("), day, F.lit(")")))
        .otherwise(F.concat(F.lit("Due in "), days.cast("string"), F.lit(" days ("), day, F.lit(")")))
    )
    return F.when(base == "", when).otherwise(F.concat(when, F.lit(" · "), base))


LEVELS = ["unverified", "low", "medium", "high"]


def confidence(origin, has_source, rule_strength, match, verified, ocr, ambiguous, base_missing, conflict) -> Column:
    """Confidence of a fact from how it was found; all arguments are columns."""
    start = (
        F.when(origin == "user", 3)
        .when(~has_source, 0)
        .when(origin == "both", 3)
        .when(origin == "rules", F.when(rule_strength == "strong", 3).otherwise(2))
        .when(F.coalesce(~verified, F.lit(False)) | match.isin("value_only", "fuzzy"), 1)
        .otherwise(2)
    )
    fixed = (origin == "user") | ~has_source
    lower = lambda x, when: F.when(when, F.greatest(x - 1, F.lit(1))).otherwise(x)
    level = lower(start, F.coalesce(ocr < 0.5, F.lit(False)))
    level = lower(level, ambiguous & (origin != "both"))
    level = F.when(base_missing | conflict, F.least(level, F.lit(2))).otherwise(level)
    return F.get(F.array(*(F.lit(x) for x in LEVELS)), F.when(fixed, start).otherwise(level))


def ocr_folded(token: Column) -> Column:
    return F.translate(F.replace(F.replace(token, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w")), "1i|!05", "llllos")


def token_close(a: Column, b: Column) -> Column:
    x, y = ocr_folded(a), ocr_folded(b)
    return (
        (a == b)
        | ((x == y) & (F.length(x) >= 2))
        | ((F.length(x) >= 5) & (F.length(y) >= 5) & (F.abs(F.length(x) - F.length(y)) <= 1) & (F.levenshtein(x, y) <= 1))
    )


def _dihedral() -> tuple[list[list[int]], list[list[int]]]:
    """Multiplication of the dihedral group of ten, and the powers of the Verhoeff permutation."""
    product = [[(a + b) % 5 if a < 5 and b < 5 else 5 + (a + b) % 5 if a < 5 else 5 + (a - b) % 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]  # fixed values: the permutation
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([step[x] for x in powers[-1]])
    return product, powers


def checksum_valid(digits: Column) -> Column:
    """Verhoeff checksum of a string of digits, by a fold over its reverse."""
    product, powers = _dihedral()
    table = F.array(*(F.array(*map(F.lit, row)) for row in product))
    power = F.array(*(F.array(*map(F.lit, row)) for row in powers))
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.get(F.get(power, i % 8), c.cast("int")))
    clean = F.filter(places, lambda x: x.isNotNull())
    return digits.rlike(r"^\d+$") & (F.aggregate(clean, F.lit(0), lambda c, x: F.get(F.get(table, c), x)) == 0)


def f1(matched: Column, expected: Column, got: Column) -> Column:
    """F1 of counts; nothing expected and nothing found is perfect."""
    return F.when((expected == 0) & (got == 0), 1.0).when((expected == 0) | (got == 0) | (matched == 0), 0.0).otherwise(2.0 * matched / (expected + got))


def rotated(x: Column, y: Column, w: Column, h: Column, degrees: Column) -> Column:
    """A box of a page scanned turned clockwise, put upright (coordinates 0..1, origin bottom left)."""
    box = lambda a, b, c, d: F.struct(a.alias("x"), b.alias("y"), c.alias("w"), d.alias("h"))
    turn = F.pmod(degrees, F.lit(360))
    return (
        F.when(turn == 90, box(1 - y - h, x, h, w))
        .when(turn == 180, box(1 - x - w, 1 - y - h, w, h))
        .when(turn == 270, box(y, 1 - x - w, h, w))
        .otherwise(box(x, y, w, h))
    )
