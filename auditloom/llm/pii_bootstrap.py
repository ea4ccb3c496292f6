"""Personal data: seed entities, their lexical contexts, a scored graph, and what the best contexts reveal.

Everything is a Column expression or a join. The patterns are the contract's, written so that a
search is linear in the text: a match starts only where a run of its first class starts (or where
the last match ended), and repetitions never give back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import store, text_digest

LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Only whole chains of digits count, so a chain of another length needs no match of its own.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9](?:[ ().-]*+[0-9]++)*+"
#: What a context may reveal: chains of 9 to 19 digits, and handles.
UNSEEN = rf"(?<![0-9A-Za-z.@+])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){{8,18}}+(?![ -]?[0-9])(?![A-Za-z@])|(?<![{LOCAL}@])[{LOCAL}]++@[A-Za-z0-9-]++(?![A-Za-z0-9.@-])"

BLANK, BLACK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Characters before a match in which its two context words are looked for.
CONTEXT_CHARS = 80
KINDS = ["email", "ip", "card", "phone"]


@dataclass(frozen=True)
class Bootstrap:
    """Parameters of the graph: distinct entities a context needs, rounds, and the least score that reveals."""

    support: int = 3
    rounds: int = 3
    confidence: float = 0.6


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Doubled digits are looked up, so that only single digits are added."""
    turned = F.reverse(number)
    plain = F.regexp_replace(turned, "(.)(.?)", "$1")
    doubled = F.translate(F.regexp_replace(turned, "(.)(.?)", "$2"), "0123456789", "0246813579")
    add = lambda s: F.aggregate(F.filter(F.split(s, ""), lambda x: x != ""), F.lit(0), lambda a, x: a + x.cast("int"))
    return (add(plain) + add(doubled)) % 10 == 0


def is_valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return F.rlike(found, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return passes_luhn(digits(found))
    if kind == "phone":
        return F.length(digits(found)).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, needs: Column) -> Column:
    """All matches in order as array<struct<start, end, found, before>>; positions in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    paired = F.transform(found, lambda m, i: F.struct(
        m.alias("found"), F.length(m).alias("size"), F.length(F.get(pieces, i)).alias("gap"),
        F.right(F.get(pieces, i), F.lit(CONTEXT_CHARS)).alias("before")))
    kind = "array<struct<start:int,end:int,found:string,before:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    placed = F.aggregate(paired, start, lambda a, m: F.struct(
        (a["at"] + m["gap"] + m["size"]).alias("at"),
        F.concat(a["out"], F.array(F.struct(
            (a["at"] + m["gap"]).alias("start"), (a["at"] + m["gap"] + m["size"]).alias("end"), m["found"].alias("found"), m["before"].alias("before"),
        ))).cast(kind).alias("out"),
    ), lambda a: a["out"])
    return F.when(needs, placed).otherwise(F.array().cast(kind))


def context(before: Column) -> Column:
    """The two words before a match, lower-cased, or an empty string."""
    words = rf"(?:^|{BLANK})({BLACK}+){BLANK}+({BLACK}+){BLANK}+$"
    tail = F.lower(before)
    return F.when(F.rlike(tail, F.lit(words)), F.concat_ws(" ", F.regexp_extract(tail, words, 1), F.regexp_extract(tail, words, 2))).otherwise("")


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, email, ip, card, phone, unseen): valid base spans, and candidates outside of them; stored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = F.rlike(text, F.lit("[0-9]"))
    needs = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    patterns = dict(zip(KINDS, [EMAIL, IP, CARD, PHONE], strict=True))
    def valid(kind: str) -> Column:
        return F.filter(matches(text, patterns[kind], needs[kind]), lambda m: is_valid(kind, m["found"])).alias(kind)

    rows = docs.select("doc_id", text_digest("text")[0].alias("digest"), *map(valid, KINDS), matches(text, UNSEEN, digit | needs["email"]).alias("unseen"))
    rows = store(rows)
    base = F.concat(*KINDS)
    free = F.filter("unseen", lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return rows.withColumn("unseen", free)


def context_totals(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context, total): how often each of the given word pairs occurs in all texts, before whatever word."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), f"{BLANK}+"), lambda w: w != "")
    paired = docs.select(words.alias("w")).where(F.size("w") > 2)
    pairs = F.transform(F.expr("slice(w, 1, size(w) - 2)"), lambda x, i: F.concat_ws(" ", x, F.get(F.col("w"), i + 1)))
    return paired.select(F.explode(pairs).alias("pair")).join(contexts.select(F.col("context").alias("pair")), "pair").groupBy(
        F.col("pair").alias("context")).agg(F.count("*").alias("total"))


def best_contexts(docs: DataFrame, spans: DataFrame, how: Bootstrap) -> DataFrame:
    """(context, score) of the contexts that reveal.

    Contexts and entities form a graph with counted edges. Seeds have score 1. In each round a
    context's score is the scored share of all its occurrences, whatever word follows, and an
    unseen entity is one to the degree that any of its contexts says so. A round admits the
    contexts that touch a scored entity, so that found entities lead to further contexts.
    """
    def edges(column: Column, seed: bool) -> DataFrame:
        rows = spans.select(F.explode(column).alias("m"))
        return rows.select(context(F.col("m.before")).alias("context"), F.lower("m.found").alias("entity"), F.lit(seed).alias("seed"))

    graph = edges(F.concat(*KINDS), True).unionByName(edges(F.col("unseen"), False)).where("context <> ''")
    graph = graph.groupBy("context", "entity").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    graph = store(graph)
    known = graph.groupBy("context").agg(F.count("*").alias("entities"), F.count_if("seed").alias("seeds"))
    # A context of seeds only reveals nothing and tells nothing about other entities.
    useful = (F.col("entities") >= how.support) & (F.col("seeds") < F.col("entities"))
    graph = store(graph.join(known.where(useful).select("context"), "context"))
    entities = graph.groupBy("entity").agg(F.max("seed").cast("double").alias("score")).where("score > 0")
    totals = None
    for _ in range(how.rounds):
        reached = graph.join(entities, "entity").select("context").distinct()
        fresh = reached if totals is None else reached.join(totals, "context", "left_anti")
        counted = store(context_totals(docs, store(fresh)))
        totals = counted if totals is None else totals.unionByName(counted)
        # An entity without a score yet adds nothing to a context's sum.
        scored = store(graph.join(entities, "entity").groupBy("context").agg(F.sum(F.col("n") * F.col("score")).alias("found")).join(totals, "context").select(
            "context", F.least(F.col("found") / F.col("total"), F.lit(1.0)).alias("trust")))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))
        entities = store(graph.join(scored, "context").groupBy("entity").agg(
            F.when(F.max("seed"), F.lit(1.0)).otherwise(1 - doubt).alias("score")).where("score > 0"))
    return scored.where(F.col("trust") >= how.confidence).select("context", F.col("trust").alias("score"))


def revealed(spans: DataFrame, contexts: DataFrame) -> DataFrame:
    """(id, key, more): for each document the candidates that stand after a context that reveals."""
    rows = spans.select("doc_id", "digest", F.explode("unseen").alias("m"))
    rows = rows.select("doc_id", "digest", context(F.col("m.before")).alias("context"), F.struct("m.start", "m.end").alias("span"))
    return rows.join(contexts.select("context"), "context").groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("key")).agg(
        F.array_sort(F.collect_set("span")).alias("more"))


def written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda m: F.concat_ws(":", F.lit(kind), m["start"], m["end"]))


def personal_data(docs: DataFrame, how: Bootstrap | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context.

    Spans are kind:start:end in code points, by kind and start; those of kind ``context`` are
    identifiers that no base pattern knows. A null text counts as empty; repeated rows get the
    same result each; other columns are not used; an empty table gives an empty table.
    """
    spans = found_spans(docs)
    extra = store(revealed(spans, best_contexts(docs, spans, how or Bootstrap())))
    base = F.concat(*[written(k, F.col(k)) for k in KINDS])
    more = F.coalesce("more", F.array().cast("array<struct<start:int,end:int>>"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("key"))
    return spans.join(extra, same, "left").select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, written("context", more)), ",").alias("spans"),
        F.size(more).cast("long").alias("n_context"),
    )
