"""Which party of a document is the user, by the names of a profile.

Defined results: a profile without a name, or a document without parties, matches nothing; names that differ only in
honorifics and company forms are one; equal scores go to the first name and the first party; null names count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Share of a name's words that a similar one may lack; share of letters in which names spelt alike may differ.
REST, RATIO = 0.25, 0.12


def alias_list(text: Column) -> Column:
    """Names parted by commas or line ends, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,\n]"), lambda a: F.trim(a)), lambda a: a != "")


def profile_names(name: Column, business: Column, aliases: Column) -> Column:
    """All names of a profile as structs (name, tokens): without blanks, of equal canonical forms the first."""
    raw = F.concat(F.array(F.coalesce(name, F.lit("")), F.coalesce(business, F.lit(""))), F.coalesce(aliases, F.array().cast("array<string>")))
    named = F.transform(F.filter(F.transform(raw, lambda n: F.trim(n)), lambda n: n != ""), lambda n: F.struct(n.alias("name"), C.name_tokens(n).alias("tokens")))
    kind = "array<struct<name:string,tokens:array<string>>>"
    return F.aggregate(named, F.expr(f"cast(array() as {kind})"), lambda acc, n: F.when(F.exists(acc, lambda a: a["tokens"] == n["tokens"]), acc).otherwise(F.array_append(acc, n)))


def best_name(tokens: Column, names: Column) -> Column:
    """Struct (score, name) of the profile name most like a party's tokens, the first of equals."""
    scored = F.transform(names, lambda n: F.struct(C.name_similarity_of(tokens, n["tokens"]).cast("double").alias("score"), n["name"].alias("name")))
    start = F.expr("cast(named_struct('score', 0.0, 'name', '') as struct<score:double,name:string>)")
    return F.aggregate(scored, start, lambda acc, s: F.when((s["score"] > acc["score"]) | (acc["name"] == ""), s).otherwise(acc))


def matched(documents: DataFrame, profile: Column) -> DataFrame:
    """Adds outcome (matched, ambiguous or none), party_index, score, matched_name and candidates to documents(doc_id,
    parties array<string>); profile is a struct column (name, business, aliases). Only one likely party that no other
    rivals is a match."""
    rows = documents.withColumn("names", profile_names(profile["name"], profile["business"], profile["aliases"]))
    rows = rows.withColumn("party_tokens", F.transform(F.coalesce("parties", F.array().cast("array<string>")), lambda p: C.name_tokens(F.coalesce(p, F.lit("")))))
    rows = rows.withColumn("scores", F.transform("party_tokens", lambda t: best_name(t, F.col("names"))))
    strong = F.filter("scores", lambda s: s["score"] >= C.SAME_NAME)
    places = lambda least: F.filter(F.transform("scores", lambda s, i: F.when(s["score"] >= least, i)), lambda i: i.isNotNull())
    complete = F.coalesce(F.trim(profile["name"]) != "", F.lit(False))
    one = complete & (F.size(strong) == 1) & (F.size(places(C.MAYBE_NAME)) == 1)
    outcome = F.when(one, "matched").when(complete & (F.size(places(C.MAYBE_NAME)) > 0), "ambiguous").otherwise("none")
    return rows.withColumns({
        "outcome": outcome, "party_index": F.when(one, F.get(places(C.SAME_NAME), 0)), "score": F.when(one, F.get(strong, 0)["score"]), "matched_name": F.when(one, F.get(strong, 0)["name"]),
        "candidates": F.when(outcome == "ambiguous", places(C.MAYBE_NAME)),
    }).drop("names", "party_tokens", "scores")


def identified(documents: DataFrame, profile: Column) -> DataFrame:
    """Sets user_party, is_neither and identity of documents whose identity the user didn't choose; run again whenever the
    profile changes."""
    found = matched(documents, profile)
    free, hit = ~F.col("identity").eqNullSafe("user_chosen"), F.col("outcome") == "matched"
    return found.withColumns({
        "user_party": F.when(free, F.when(hit, F.get("parties", F.col("party_index")))).otherwise(F.col("user_party")),
        "is_neither": F.when(free & hit, False).otherwise(F.col("is_neither")), "identity": F.when(free, F.when(hit, "automatic").otherwise("undetermined")).otherwise(F.col("identity")),
    }).drop("outcome", "party_index", "score", "matched_name", "candidates")


def chosen_identity(documents: DataFrame, choices: DataFrame) -> DataFrame:
    """The user's own choices(doc_id, party): the party they are, or null for neither."""
    one = choices.groupBy("doc_id").agg(F.min("party").alias("party"), F.lit(True).alias("chosen"))
    out = documents.join(one, "doc_id", "left")
    return out.withColumns({
        "user_party": F.when(F.col("chosen"), F.col("party")).otherwise(F.col("user_party")), "is_neither": F.when(F.col("chosen"), F.col("party").isNull()).otherwise(F.col("is_neither")),
        "identity": F.when(F.col("chosen"), "user_chosen").otherwise(F.col("identity")),
    }).drop("party", "chosen")


def generated_title(documents: DataFrame) -> DataFrame:
    """Titles made of the first other party and the type, while the title is still the file's or a scan's."""
    base = F.regexp_replace("filename", r"\.[^./]*$", "")
    is_default = (F.col("title") == base) | F.startswith("title", F.lit("Scan "))
    user = C.name_tokens(F.col("user_party"))
    other = F.get(F.filter("parties", lambda p: F.col("user_party").isNull() | (C.name_similarity_of(C.name_tokens(p), user) < C.SAME_NAME)), 0)
    kind = F.initcap(F.replace(F.col("document_type"), F.lit("_"), F.lit(" ")))
    made = F.when(other.isNotNull() & kind.isNotNull(), F.concat(other, F.lit(" — "), kind)).when(kind.isNotNull(), kind).otherwise(F.col("title"))
    return documents.withColumn("title", F.when(is_default, made).otherwise(F.col("title")))


def word_keys(word: Column) -> Column:
    """Keys of which two words share one if they are equal or, being of four letters or more, one edit apart."""
    left_out = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) >= 4, F.array_distinct(F.concat(F.array(word), left_out))).otherwise(F.array(word))


def by_words(rows: DataFrame) -> DataFrame:
    """Candidate pairs x, y of rows(n, tokens): y holds, up to an edit, one of x's rarest words, x having no more words than y.

    Names that share words to the degree of MAYBE_NAME leave out a quarter of them at most, and one that another contains leaves
    out none; so one in the rarest quarter and one more of the shorter name's words is shared. A word of most names brings names
    together only where a name has no rarer one."""
    sets = rows.select("n", F.size(F.array_distinct("tokens")).alias("size"), F.explode(F.array_distinct("tokens")).alias("word"))
    often = sets.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    words = sets.join(often, "word")
    ranked = words.groupBy("n", "size").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("words"))
    rare = ranked.select(F.col("n").alias("x"), F.col("size").alias("nx"), F.explode(F.slice("words", F.lit(1), F.floor(F.col("size") * REST).cast("int") + 1)).alias("w"))
    rare = rare.select("x", "nx", F.explode(word_keys(F.col("w.word"))).alias("key"))
    every = sets.select(F.col("n").alias("y"), F.col("size").alias("ny"), F.explode(word_keys(F.col("word"))).alias("key"))
    return rare.join(every, "key").where("nx <= ny").select("x", "y").distinct()


def by_segments(rows: DataFrame) -> DataFrame:
    """Candidate pairs x, y of rows(n, tokens) whose joined words differ in RATIO of the longer one's letters at most.

    The longer text, of size L, may differ in k = RATIO * L edits; cut into k + 1 segments it leaves one untouched in the shorter one,
    moved by no more than the edits before it and behind it allow. Each segment of each text meets those pieces of shorter texts that
    could be it: an equi-join on (L, number of the segment, piece)."""
    texts = rows.select("n", F.array_join("tokens", " ").alias("text")).withColumn("size", F.length("text"))
    edits = lambda size: F.floor(size * RATIO + 1e-9).cast("int")
    begin = lambda i: F.floor(i * F.col("L") / (F.col("k") + 1)).cast("int")
    cut = lambda df: df.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i")).withColumns({"at": begin(F.col("i")), "piece": begin(F.col("i") + 1) - begin(F.col("i"))})
    longer = cut(texts.withColumns({"L": F.col("size"), "k": edits(F.col("size"))}).where("k > 0"))
    longer = longer.select(F.col("n").alias("y"), "L", "i", F.expr("substring(text, at + 1, piece)").alias("key"))
    reach = F.floor(F.col("size") / (1 - RATIO) + 1e-9).cast("int")
    shorter = texts.where("size > 0").select("*", F.explode(F.sequence(F.col("size"), reach)).alias("L")).withColumn("k", edits(F.col("L"))).where("k > 0 and L - size <= k")
    shorter = cut(shorter).withColumn("less", F.col("size") - F.col("L"))
    low, high = F.greatest(-F.col("i"), F.col("less") - (F.col("k") - F.col("i"))), F.least(F.col("i"), F.col("less") + F.col("k") - F.col("i"))
    shorter = shorter.where(low <= high).select("*", F.explode(F.sequence(low, high)).alias("moved")).where("at + moved >= 0 and at + moved + piece <= size")
    shorter = shorter.select(F.col("n").alias("x"), "L", "i", F.expr("substring(text, at + moved + 1, piece)").alias("key")).distinct()
    return shorter.join(longer, ["L", "i", "key"]).select("x", "y").distinct()


def similar_names(names: DataFrame, column: str, least: float) -> DataFrame:
    """Pairs a, b of distinct names whose similarity reaches `least` (both ways, each name with itself), with their score; `least` is
    MAYBE_NAME or more. No pair is lost: each way of being similar has its own candidates, `by_words` and `by_segments`;
    null names and names without any word are like none. Candidates are made distinct before they are scored."""
    if least < C.MAYBE_NAME:
        raise ValueError(f"names are compared from a similarity of {C.MAYBE_NAME}")
    rows = names.select(F.col(column).alias("n")).where("n is not null").distinct().withColumn("tokens", C.name_tokens(F.col("n")))
    some = rows.where("size(tokens) > 0")
    pairs = by_words(some).unionByName(by_segments(some)).distinct()
    pairs = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("p")).select("p.*").distinct()
    own = lambda side, tokens: rows.select(F.col("n").alias(side), F.col("tokens").alias(tokens))
    met = pairs.join(own("a", "ta"), "a").join(own("b", "tb"), "b")
    return met.withColumn("score", C.name_similarity_of(F.col("ta"), F.col("tb"))).where(F.col("score") >= least).select("a", "b", "score")
