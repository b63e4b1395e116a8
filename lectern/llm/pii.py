"""Personal data: fixed forms, and terms that give a protected value away.

Fixed forms (email, ip, card, phone) are found by regex. Every value found is a
protected entity. The corpus then says how strongly a term reveals it: with the
numbers n(e), n(t), n(e,t) of all N documents that hold the entity, the term and
both, anywhere in the text,

    disclosure(t, e) = PMI(e; t) / IC(e) = log(N n(e,t) / (n(e) n(t))) / log(N / n(e)),

1 where the term occurs only with the entity, 0 where both are independent.
Every occurrence of a term at or above :data:`REMOVE_AT` is removed in the
documents that hold the entity, of one at or above :data:`GENERALISE_AT` it is
generalised. One shared document says nothing, so a pair needs
:data:`MIN_SUPPORT` documents; an entity that only one document holds discloses
nothing about its terms, and only its own form is protected.

Whole documents would make all pairs of their entities and terms; an exact bound
rules most out before any pair is made. As n(e,t) <= n(e), disclosure g needs

    n(t) <= n(e) ** g * N ** (1 - g),

so a term is paired only with entities that are frequent enough for it. Counts
combine map-side; what meets by term or entity are written tables, so a third of
all rows under one key are split among tasks at run time. Nothing is broadcast
but what Spark has measured.

Defined results: null or empty text has no spans; repeated rows count as
documents of their own; an empty table gives an empty table. Where all
documents hold the entity its information content is 0 and no term is flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SPANS, Scratch, durable, let, rows, span_text, spans_where

KINDS = ("email", "ip", "card", "phone", "remove", "generalise")
# The forms. Quantifiers are possessive and starts are bound to
# the start of a run (or the end of the last match), so long runs cost linear time.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]{3,}"
TERM_GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_SUPPORT, GENERALISE_AT, REMOVE_AT = 2, 0.75, 0.9


def digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def luhn(number: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    is_card = lambda m, _: let(digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    return F.concat(
        spans_where(text, EMAIL, "email", 0, lambda m, _: F.lit(True)),
        spans_where(text, IP, "ip", 1, lambda m, _: F.regexp_like(m, F.lit(IP_PARTS))),
        spans_where(text, CARD, "card", 2, is_card),
        spans_where(text, PHONE, "phone", 3, lambda m, _: F.length(digits(m)).between(9, 15)),
    )


def entities(text: Column, spans: Column) -> Column:
    """The distinct protected values, as kind:value; digits alone count in cards and phones, case nowhere."""
    def of(s: Column) -> Column:
        value = F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        return F.concat(s["kind"], F.lit(":"), F.when(s["kind"].isin("card", "phone"), digits(value)).otherwise(F.lower(value)))

    return F.array_distinct(F.transform(spans, of))


def terms(text: Column) -> Column:
    """The distinct words of three letters or more, in lower case."""
    return F.array_distinct(F.transform(F.filter(F.split(text, TERM_GAP, -1), lambda w: F.length(w) >= 3), F.lower))


def mentions(df: DataFrame, scratch: Scratch, every_text: bool = False) -> DataFrame:
    """One pass over the texts, kept: row id, doc_id, base spans, and of texts with such spans the entities and the text (or of all)."""
    t = df.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    some = F.size("base") > 0
    text = F.when(some | F.lit(every_text), F.col("text"))
    kept = t.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "base", F.when(some, entities(F.col("text"), F.col("base"))).alias("entities"), text.alias("text"))
    return scratch(kept, "pii")


def disclosing(df: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(rid, term, disclosure): terms of a document that disclose an entity of it, by the strongest disclosure at or above the lower threshold."""
    n = found.count()
    holds = scratch(found.where("entities is not null").select("rid", F.explode("entities").alias("entity")), "pii-holds")
    n_e = holds.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where((F.col("n_e") >= MIN_SUPPORT) & (F.col("n_e") < n))
    n_e = scratch(n_e, "pii-entities")
    held = scratch(holds.join(n_e, "entity"), "pii-held")
    # the most documents a term may be in to disclose an entity of n_e documents; one part in 10 ** 9 for the rounding of logarithms
    bound = F.pow(F.col("n_e").cast("double"), F.lit(GENERALISE_AT)) * F.pow(F.lit(float(max(n, 1))), F.lit(1 - GENERALISE_AT)) * (1 + 1e-9)
    reach = held.groupBy("rid").agg(F.max(bound).alias("reach"))
    said = scratch(found.join(reach, "rid").select("rid", "reach", F.explode(terms(F.col("text"))).alias("term")), "pii-said")
    words = df.select(F.explode(terms(F.col("text"))).alias("term"))
    n_t = scratch(words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "pii-terms")
    rare = scratch(said.join(n_t, "term").where("n_t <= reach").select("rid", "term", "n_t"), "pii-rare")
    pairs = scratch(held.join(rare, "rid").where(F.col("n_t") <= bound).select("rid", "entity", "n_e", "term", "n_t"), "pii-pairs")
    log = lambda c: F.log2(F.col(c).cast("double"))
    all_ = F.log2(F.lit(float(max(n, 1))))
    n_et = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    ratio = (all_ + log("n_et") - log("n_e") - log("n_t")) / (all_ - log("n_e"))
    scored = n_et.where(F.col("n_et") >= MIN_SUPPORT).select("entity", "term", ratio.alias("disclosure")).where(F.col("disclosure") >= GENERALISE_AT)
    scored = scratch(scored, "pii-scored")
    return pairs.select("rid", "entity", "term").join(scored, ["entity", "term"]).groupBy("rid", "term").agg(F.max("disclosure").alias("disclosure"))


def _places(text: Column, base: Column, removed: Column, generalised: Column) -> Column:
    """Spans of all occurrences of the terms outside the protected values."""
    def of(s: Column) -> Column:
        word = F.lower(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
        gone, vague = (F.array_contains(x, word) for x in (removed, generalised))
        return F.struct(s["start"].alias("start"), F.when(gone, 4).otherwise(5).alias("rank"), F.when(gone, "remove").when(vague, "generalise").alias("kind"), s["end"].alias("end"))

    hit = F.filter(F.transform(spans_where(text, TERM, "", 0, lambda m, _: F.lit(True)), of), lambda s: s["kind"].isNotNull())
    return F.filter(hit, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, base, spans[, text]): base spans, and all spans with those of disclosing terms."""
    with Scratch() as scratch:
        found = mentions(rows(df, id_col, text_col), scratch, keep_text)
        flagged = disclosing(rows(df, id_col, text_col), found, scratch)
        gone = F.col("disclosure") >= REMOVE_AT
        of = flagged.groupBy("rid").agg(F.collect_set(F.when(gone, F.col("term"))).alias("removed"), F.collect_set(F.when(~gone, F.col("term"))).alias("generalised"))
        out = found.join(scratch(of, "pii-flagged"), "rid", "left")
        more = F.when(F.col("removed").isNotNull(), _places(F.col("text"), F.col("base"), F.col("removed"), F.col("generalised"))).otherwise(F.array().cast(SPANS))
        out = out.select("doc_id", "base", F.concat("base", more).alias("spans"), *["text"] * keep_text)
        return durable(out, "pii-spans")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by base kind, a digest of the base spans, and all spans."""
    found = spans(df, id_col, text_col)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:4]),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): forms and generalised terms replaced by their kind, disclosing terms removed."""
    from lectern.llm.secret_scan import redact

    mark = lambda kind: F.when(kind == "remove", "").when(kind == "generalise", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))
    found = spans(df, id_col, text_col, keep_text=True)
    return found.select("doc_id", redact(F.col("text"), F.col("spans"), mark).alias("text"))
