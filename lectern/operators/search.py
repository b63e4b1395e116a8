"""Faceted search, paging, lookup and similarity over item banks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import let

# Short names that requests use for subjects.
SUBJECT_ALIASES = {"CS": "Computer Science", "Math": "Mathematics"}
REQUIRED = ("subject", "topic", "question", "answer", "explanation")


def csv(value: str | None) -> list[str]:
    """Comma-separated parameter: trimmed, empties dropped."""
    return [x.strip() for x in (value or "").split(",") if x.strip()]


def like_needle(text: str) -> str:
    """A substring pattern in which % and _ stay wildcards and a backslash is itself."""
    return "%" + text.replace("\\", "\\\\") + "%"


def paper_synonyms(name: str) -> list[str]:
    """``Paper N`` also stands under ``HL-paperN``."""
    head, _, n = name.strip().partition(" ")
    return [name, f"HL-paper{n}"] if head.lower() == "paper" and n.isdigit() else [name]


def predicates(*, subject=None, topic=None, paper_type=None, command_term=None, category=None, exclude_category=None,
               difficulty=None, marks=None, tag=None, knowledge_point=None, q=None, text_columns: Sequence[str] = ("question",)) -> list[Column]:
    """One column per facet that is given; callers AND them."""
    out: list[Column] = []
    equal = {"topic": topic, "command_term": command_term, "category": category, "difficulty": difficulty, "marks": marks}
    if subject is not None:
        out.append(F.col("subject") == SUBJECT_ALIASES.get(subject, subject))
    if paper_type is not None:
        out.append(F.col("paper_type").isin(paper_synonyms(paper_type)))
    out += [F.col(k) == v for k, v in equal.items() if v is not None]
    if csv(exclude_category):
        out.append(F.col("category").isNull() | ~F.col("category").isin(csv(exclude_category)))
    if tag is not None:
        out.append(F.array_contains("tags", tag))
    if knowledge_point is not None:
        out.append(F.arrays_overlap("knowledge_point_ids", F.array(*map(F.lit, csv(knowledge_point)))))
    if q:
        out.append(reduce(Column.__or__, [F.col(c).ilike(like_needle(q)) for c in text_columns]))
    return out


def search(items: DataFrame, *, completed: DataFrame | None = None, **facets) -> DataFrame:
    """Items that satisfy every given facet; ``completed`` (id) are left out by an anti join."""
    out = reduce(DataFrame.where, predicates(**facets), items)
    return out.join(completed, "id", "left_anti") if completed is not None else out


def page(items: DataFrame, sort: str = "created_at", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page; ties go by id. Becomes a top-k, never a full sort."""
    order = {"created_at": F.desc_nulls_last("created_at"), "marks": F.asc_nulls_first("marks"), "difficulty": F.asc_nulls_first("difficulty")}[sort]
    return items.orderBy(order, "id").offset(offset).limit(limit)


def facets(items: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value): distinct values that are neither null nor empty, from one scan."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return items.select(pairs.alias("p")).select("p.*").where("value is not null and value <> ''").distinct()


def similar(items: DataFrame, probe_id, k: int = 12) -> DataFrame:
    """The k items that share most with one: 3 a knowledge point, 2 topic, 1 subject, command term, paper type."""
    me = items.where(F.col("id") == probe_id).limit(1).select(*(F.col(c).alias(f"p_{c}") for c in ("subject", "topic", "command_term", "paper_type", "knowledge_point_ids")))
    # one row at most
    both = items.where(F.col("id") != probe_id).crossJoin(F.broadcast(me))
    shared = F.size(F.filter("p_knowledge_point_ids", lambda x: F.array_contains("knowledge_point_ids", x)))
    flag = lambda c: c.cast("int")
    score = (3 * shared + F.coalesce(flag(F.col("subject") == F.col("p_subject")), F.lit(0)) + 2 * flag(F.col("topic").eqNullSafe(F.col("p_topic")))
             + F.coalesce(flag((F.col("command_term") == F.col("p_command_term")) & (F.col("command_term") != "")), F.lit(0)) + flag(F.col("paper_type").eqNullSafe(F.col("p_paper_type"))))
    return both.select("id", score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


#: What two items may have in common besides knowledge points, and what it is worth.
SHARED = (("subject", 1), ("topic", 2), ("command_term", 1), ("paper_type", 1))


def similar_all(items: DataFrame, k: int = 12) -> DataFrame:
    """(id, rank, similar_id, score): for every item what :func:`similar` gives for it as the probe.

    An item bears a key for each choice of its knowledge points and attributes; who bears the same one scores at least what the choice
    is worth. Of each key only the k + 1 smallest ids are kept: if an item shares just that choice with a probe and isn't among them, k
    others rank before it. So what a probe's keys hold has its k best, and the worth of the best key that an item is found
    under is its score. Items of equal attributes are one probe (a profile), ids are thinned out before they are shuffled, and no pair
    of items is ever made; the cost is keys a profile, which double with each knowledge point of an item.
    """
    known = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    # no subject and no command term are no common ground; no topic and no paper type are
    bears = {"subject": F.col("subject").isNotNull(), "topic": F.lit(True), "command_term": F.coalesce(known("command_term"), F.lit(False)), "paper_type": F.lit(True)}
    points = F.array_sort(F.coalesce("knowledge_point_ids", F.array().cast("array<string>")))
    fields = [c for c, _ in SHARED]
    rows = items.select("id", *fields, points.alias("points")).withColumn("profile", F.to_json(F.struct(*fields, "points")))
    profiles = rows.groupBy("profile", *fields, "points").agg(F.lit(1).alias("_")).drop("_")
    sets = F.aggregate(F.array_distinct("points"), F.array(F.array().cast("array<string>")), lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, x))))
    choices = []
    for mask in range(1 << len(SHARED)):
        mine = [SHARED[b] for b in range(len(SHARED)) if mask >> b & 1]
        fit = F.lit(True)
        for c, _ in mine:
            fit = fit & bears[c]
        choices.append(F.when(fit, F.struct(F.to_json(F.struct(F.lit(mask).alias("_"), *(F.col(c) for c, _ in mine))).alias("of"), F.lit(sum(w for _, w in mine)).alias("worth"))))
    choices = F.filter(F.array(*choices), lambda c: c.isNotNull())
    per = profiles.select("profile", "points", F.explode(sets).alias("s"), choices.alias("c")).select("profile", "points", "s", F.explode("c").alias("c"))
    worth = 3 * F.size(F.filter("points", lambda x: F.array_contains("s", x))) + F.col("c.worth")
    keys = per.select("profile", F.concat_ws("\n", F.to_json("s"), "c.of").alias("key"), worth.alias("worth")).where("worth > 0")
    # Spark thins ranks out before it shuffles: at most k + 1 ids a profile, and a key, leave a task
    first = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("id"))).where(F.col("_n") <= k + 1).drop("_n")
    heads = first(keys.select("profile", "key").join(first(rows.select("profile", "id"), "profile"), "profile").select("key", "id"), "key")
    heads = heads.groupBy("key").agg(F.collect_list("id").alias("ids"))
    met = keys.join(heads, "key").groupBy("profile").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("worth")).alias("less"), i.alias("id"))))).alias("met"))
    # best worth first: an id's first place is its score
    firsts = lambda m: F.slice(F.array_distinct(F.transform(m, lambda x: x["id"])), 1, k + 1)
    top = let(F.array_sort("met"), lambda m: F.transform(firsts(m), lambda i: F.element_at(F.filter(m, lambda x: x["id"] == i), 1)))
    best = met.select("profile", top.alias("best"))
    mine = rows.select("profile", "id").join(best, "profile").select("id", F.slice(F.filter("best", lambda m: m["id"] != F.col("id")), 1, k).alias("best"))
    return mine.select("id", F.posexplode("best").alias("rank", "m")).select("id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("m.id").alias("similar_id"), (-F.col("m.less")).cast("long").alias("score"))


def with_usage(items: DataFrame, usage: DataFrame) -> DataFrame:
    """Each item with its usages in time order, as ``type:ref`` joined by commas ('' if none)."""
    listed = usage.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("used_at", "usage_type", "ref_id"))).alias("u"))
    text = F.array_join(F.transform("u", lambda x: F.concat_ws(":", x["usage_type"], x["ref_id"].cast("string"))), ",")
    return items.join(listed.select(F.col("question_id").alias("id"), text.alias("usage")), "id", "left").fillna({"usage": ""})


def validation_error(required: Sequence[str] = REQUIRED, numeric: Sequence[str] = ("marks", "difficulty")) -> Column:
    """The first failure of a record, or null."""
    blank = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", f"missing {c}") for c in required]
    number = [F.when(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull(), f"{c} must be a number") for c in numeric]
    return F.coalesce(*blank, *number)


def derived_category() -> Column:
    """Explicit, else book, else ai, else topic for classified sources, else past."""
    return F.coalesce(
        F.col("category"), F.when(F.col("book_id").isNotNull(), "book"), F.when(F.col("authored_by") == "ai", "ai"),
        F.when(F.contains(F.lower("source"), F.lit("classified")), "topic"), F.lit("past"))
