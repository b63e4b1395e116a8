"""Secret scans over a trigram inverted index.

1. Each rule's regex gives a Boolean query over trigrams (:mod:`lectern.llm.trigrams`).
2. :func:`build_index` writes the postings (trigram, document) of every trigram
   that some query names, sorted by trigram within each file, so that a look-up
   reads the row groups of its trigrams and no others.
3. :func:`candidates` looks each rule's trigrams up and intersects and unites the
   postings by its query. Postings meet by document, never by trigram, so a
   trigram that stands in a third of all documents makes no hot task.
4. :func:`annotate` runs a rule's regex only over its candidates. Rules without a
   mandatory trigram scan every document. The candidates are a written table of
   numbers: while Spark finds it small, it is broadcast and no text is shuffled;
   beyond that both sides are dealt by document.

Documents are named by a hash of id and text, so null ids are no hot key. Rows
that agree in it share candidates, and a posting list may hold more than the
documents that match, never fewer: the result is the same as a full scan's.

Defined results: null or empty text has no spans; rows that share an id are
verified one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import trigrams
from lectern.llm.common import SPANS, ascii_lower, durable, folded, forget, let, rows, span_text, spans_where

MARK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    min_chars: int = 0
    #: the group that must have min_chars code points; 0: the match
    group: int = 0
    base: bool = False


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEY = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
# Forms of keys and tokens.
RULES = (
    Rule("assign", rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
)


def document_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def build_index(df: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written postings (trigram, doc) for every trigram that a rule's query names."""
    wanted = sorted(set().union(*(trigrams.trigrams(trigrams.query(r.pattern)) for r in rules)))
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    t = df.select(document_key(id_col, text_col).alias("doc"), ascii_lower(text).alias("_low"))
    held = F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in wanted)))
    return durable(t.select("doc", F.explode(held).alias("trigram")).sortWithinPartitions("trigram"), "secret-index")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc, rules): the rules whose query the document's postings satisfy."""
    found = []
    for r in rules:
        q = trigrams.query(r.pattern)
        if q is True:
            continue
        names = sorted(trigrams.trigrams(q))
        bit = {g: F.bit_or(F.when(F.col("trigram") == g, F.lit(1)).otherwise(0)) for g in names}
        posted = index.where(F.col("trigram").isin(names)).groupBy("doc").agg(*(c.alias(f"g{k}") for k, c in enumerate(bit.values())))
        place = {g: k for k, g in enumerate(names)}
        met = trigrams.holds(q, lambda g, place=place: F.col(f"g{place[g]}") == 1)
        found.append(posted.where(met).select("doc", F.lit(r.kind).alias("rule")))
    if not found:
        return index.select("doc", F.array().cast("array<string>").alias("rules")).limit(0)
    return reduce(DataFrame.unionByName, found).groupBy("doc").agg(F.collect_set("rule").alias("rules"))


def verified(text: Column, may: Column, rules=RULES) -> Column:
    """The spans of all rules; ``may`` names the rules that the index lets through."""
    out = []
    for rank, r in enumerate(rules):
        spans = spans_where(text, r.pattern, r.kind, rank, _long_enough(r.min_chars), r.group)
        if trigrams.query(r.pattern) is not True:
            spans = F.when(F.array_contains(may, r.kind), spans).otherwise(F.array().cast(SPANS))
        out.append(spans)
    return F.concat(*out)


def _long_enough(n: int):
    return lambda match, group: F.length(group) >= n


def annotate(df: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """``df`` with a column ``spans``, by way of the index; a column of that name is replaced."""
    own = build_index(df, rules, id_col, text_col) if index is None else index
    c = durable(candidates(own, rules).withColumnsRenamed({"doc": "_doc", "rules": "_may"}), "secret-candidates")
    if index is None:
        forget(own)
    t = df.drop("spans", "_doc", "_may")
    t = t.join(c, document_key(id_col, text_col) == c["_doc"], "left")
    may = F.coalesce("_may", F.array().cast("array<string>"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return t.withColumn("spans", verified(text, may, rules)).drop("_doc", "_may")


def scan(df: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, spans) for every row."""
    return annotate(rows(df, id_col, text_col), rules, index=index)


def report(df: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by base kind, a digest of the base spans, and all spans."""
    found = scan(df, rules, id_col, text_col)
    base = [r.kind for r in rules if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def redact(text: Column, spans: Column, mark=None) -> Column:
    """The text with each run of overlapping spans replaced by :data:`MARK`, or by ``mark(kind of its first span)``."""
    def parts(t: Column) -> Column:
        def add(s: Column, x: Column) -> Column:
            gap = F.substring(t, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
            fresh = (x["start"] >= s["at"]) & ((x["start"] > s["at"]) | (s["at"] == 0))
            out = F.when(fresh, F.concat(s["out"], F.array(gap, mark(x["kind"]) if mark else F.lit(MARK)))).otherwise(s["out"])
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

        rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(t, (s["at"] + 1).cast("int"), F.length(t)))
        return let(folded(F.array_sort(spans), "array<string>", add), rest)

    return F.when(F.size(spans) == 0, text).otherwise(let(text, parts))
