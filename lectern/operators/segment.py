"""Segmentation of papers, markschemes and books: walks over numbered lines, sections, cursors that advance, and the records they give.

Lines are rows (by, pos, line) or texts are one value; a document's walk is a window over its lines, or a fold whose state is a
cursor, so documents spread over tasks and no line is met twice.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.cleaning import option_state, position_map
from lectern.functions.fold import gathered
from lectern.functions.text import let

# Headings after which the answers of a markscheme begin, and the instruction that is none of them.
ANCHORS = ("Maximum total", "Maximum mark", "Section A", "Mark allocation", "Mark Allocation", "Total 30 marks", "Total 25 marks", "Total 20 marks", "Total 15 marks", "Total 10 marks")
# A numbered line, and the declared range of an option.
NUMBERED = r"^(\d{1,3})[.):]?\s+\S"
OPTION_RANGE = r"(?i)Option\s+([A-D])\s+[—–-]\s*[^\r\n]+?(\d+)\s*[–-]\s*(\d+)"
# Fixed value: a question's number inside a line, which a capital or a bracket follows.
INLINE = r"(?<![A-Za-z0-9./])([1-9]\d{0,2})[.):]?\s+(?=[A-Z(])"
_INLINE = re.compile(INLINE, re.ASCII)
# Fixed value: the label of a question's first part.
FIRST_PART = r"(?i)(?:^|\s)(?:\((?:a|b|c|i|ii)\)|(?:a|b|c|i|ii|iii|iv|v)\.)\s"
INSTRUCTION = r"(?i)follow\s+the\s+markscheme"
#: A number between its neighbours in a walk: what a fold of one returns.
_FOUND = "array<struct<n:bigint,at:bigint>>"


def _cursor_fold(wanted: Column, start: Column, find) -> Column:
    """array<struct<n,at>>: each wanted number by ``find(n, from)``, the place at or after the end of the last one found; -1 or null: skipped."""
    begin = F.struct(start.cast("long").alias("at"), F.array().cast(_FOUND).alias("out"))

    def step(s: Column, n: Column) -> Column:
        def took(p: Column) -> Column:
            hit = F.coalesce(p >= 0, F.lit(False))
            one = F.array(F.struct(n.cast("long").alias("n"), p.cast("long").alias("at")))
            return F.struct(F.when(hit, p + 1).otherwise(s["at"]).cast("long").alias("at"), F.when(hit, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

        return let(find(n, s["at"]), took)

    return F.aggregate(wanted, begin, step, lambda s: s["out"])


def located_numbers(lines: Column, numbers: Column) -> Column:
    """Answers of the expected numbers among ``lines``: array<struct<n,content>>.

    Each number in turn is sought at the start of a line after the one found before; numbers that are not there are skipped. An
    answer ends where any later expected number starts a line.
    """
    def answers(marks: Column, wanted: Column) -> Column:
        def find(n: Column, since: Column) -> Column:
            return F.get(F.filter(marks, lambda m: (m["n"] == n) & (m["at"] >= since)), F.lit(0))["at"]

        def one(x: Column) -> Column:
            later = F.get(F.filter(marks, lambda m: (m["at"] > x["at"]) & (m["n"] > x["n"])), F.lit(0))["at"]
            end = F.coalesce(later, F.size(lines).cast("long"))
            body = F.array_join(F.slice(lines, (x["at"] + 1).cast("int"), (end - x["at"]).cast("int")), "\n")
            return F.struct(x["n"].alias("n"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("content"))

        return F.transform(_cursor_fold(wanted, F.lit(0), find), one)

    # only lines that open with an expected number are looked at again
    number = F.transform(lines, lambda x, i: F.struct(F.regexp_extract(x, NUMBERED, 1).try_cast("long").alias("n"), i.cast("long").alias("at")))
    wanted = F.array_sort(F.array_distinct(F.transform(numbers, lambda x: x.cast("long"))))
    return let(wanted, lambda w: let(F.filter(number, lambda m: F.array_contains(w, m["n"])), lambda s: answers(s, w)))


def split_by_label(questions: DataFrame, solutions: DataFrame, label: str = "label", least: int = 10) -> DataFrame:
    """Questions (label, number) with the answers that the solution lines (label, pos, line) of their label hold; answers of ``least`` characters or fewer don't count."""
    q = questions.groupBy(label).agg(F.collect_set("number").alias("numbers"))
    s = solutions.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))
    found = q.join(s, label).select(label, F.explode(located_numbers(F.col("lines"), F.col("numbers"))).alias("a"))
    return found.select(label, F.col("a.n").alias("number"), F.col("a.content").alias("answer")).where(F.length("answer") > least)


def inside_numbers(text: str, pending: list[int], every: list[int]) -> list[tuple[int, int, int]]:
    """(n, at, end) of the pending numbers inside a text, both lists in order: each is sought after the one found before, and ends
    where the least later number of ``every`` that follows it stands, else with the text. A step looks into the number's own places."""
    places: dict[int, tuple[list[int], list[int]]] = {n: ([], []) for n in every}
    for m in _INLINE.finditer(text):
        at, end = places.get(int(m[1]), ([], []))
        at.append(m.start())
        end.append(m.end())

    def after(n: int, since: int) -> tuple[int, int] | None:
        at, end = places.get(n, ([], []))
        k = bisect.bisect_left(at, since)
        return (at[k], end[k]) if k < len(at) else None

    out, since = [], 0
    for n in pending:
        if hit := after(n, since):
            since = hit[1]
            later = (after(q, since) for q in every[bisect.bisect_right(every, n) :])
            out.append((n, hit[0], next((o[0] for o in later if o), len(text))))
    return out


def _with_insides(texts: DataFrame, label: str, kept: str, least: int) -> DataFrame:
    """(label, number, answer, found): those of the array ``kept`` by line, and of ``_t`` the numbers ``_p`` inside, among ``_all``."""
    kind = pa.list_(pa.struct([("n", pa.int64()), ("content", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("_t", "_p", "_all")), strict=True)
            inside = [[{"n": n, "content": t[at:end]} for n, at, end in inside_numbers(t, p, every)] for t, p, every in rows]
            yield pa.RecordBatch.from_arrays([batch.column(label), batch.column(kept), pa.array(inside, kind)], [label, "_by_line", "_inside"])

    answers = "array<struct<n:bigint,content:string>>"
    done = texts.select(label, F.col(kept).cast(answers).alias(kept), "_t", "_p", "_all").mapInArrow(run, f"`{label}` {texts.schema[label].dataType.simpleString()}, _by_line {answers}, _inside {answers}")
    tidy = F.transform("_inside", lambda a: F.struct(a["n"].alias("n"), F.regexp_replace(a["content"], r"^\s+|\s+$", "").alias("content"), F.lit("inside").alias("found")))
    line = F.transform("_by_line", lambda a: F.struct(a["n"].alias("n"), a["content"].alias("content"), F.lit("line").alias("found")))
    told = done.select(label, F.explode(F.concat(line, tidy)).alias("a"))
    return told.select(label, F.col("a.n").alias("number"), F.col("a.content").alias("answer"), F.col("a.found").alias("found")).where(F.length("answer") > least)


def _stream(lines: Column) -> Column:
    """The lines of a label as one stream of characters; a null one is empty."""
    return F.array_join(F.transform(lines, lambda x: F.coalesce(x, F.lit(""))), "\n")


def _numbers(name: str) -> Column:
    return F.sort_array(F.collect_set(F.col("number").cast("long"))).alias(name)


def _lines() -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])


def inline_answers(pending: DataFrame, questions: DataFrame, solutions: DataFrame, label: str = "label", least: int = 10) -> DataFrame:
    """(label, number, answer) of the ``pending`` (label, number) whose numbers stand inside the solution lines (label, pos, line) of their label.

    The lines of a label are one stream of characters. Each pending number in turn is sought after the one found before, before a capital or a
    bracket and not within a word, a path or a decimal; its answer ends where the least later number of ``questions`` that follows it stands, else
    with the stream (:func:`inside_numbers`). Answers of ``least`` characters or fewer don't count, but move the cursor.
    """
    t = solutions.groupBy(label).agg(_stream(_lines()).alias("_t"))
    t = t.join(questions.groupBy(label).agg(_numbers("_all")), label).join(pending.groupBy(label).agg(_numbers("_p")), label)
    return _with_insides(t.withColumn("_none", F.array()), label, "_none", least).drop("found")


def paired_answers(questions: DataFrame, solutions: DataFrame, label: str = "label", least: int = 10) -> DataFrame:
    """(label, number, answer, found): by numbers at the start of lines, and by numbers inside them for the questions that those leave without one.

    A label is one row with its lines, so both are told there and its lines are shuffled once.
    """
    both = questions.groupBy(label).agg(_numbers("_all")).join(solutions.groupBy(label).agg(_lines().alias("_lines")), label)
    first = F.filter(located_numbers(F.col("_lines"), F.col("_all")), lambda a: F.length(a["content"]) > least)
    both = both.select(label, "_all", _stream(F.col("_lines")).alias("_t"), first.alias("_first"))
    left = F.array_except("_all", F.transform("_first", lambda a: a["n"]))
    return _with_insides(both.withColumn("_p", left), label, "_first", least)


def anchored_walk(text: Column, last: Column) -> Column:
    """Where the answers 1 to ``last`` start: array<struct<n,at>>, places from 0.

    The walk begins after the last anchor's first occurrence, at a line that opens with ``1.`` and is no instruction (or at the first such
    line if all are), and takes the next number's first line after each; it ends at the first number that is not there.
    """
    anchor = F.greatest(*(F.locate(a, text) for a in ANCHORS))

    def walk(marks: Column) -> Column:
        ones = F.filter(marks, lambda m: (m["n"] == 1) & m["dot"])
        first = F.coalesce(F.get(F.filter(ones, lambda m: ~m["told"]), F.lit(0)), F.get(ones, F.lit(0)))

        def rest(one: Column) -> Column:
            start = F.struct((one["n"] + 1).alias("e"), F.array(F.struct(one["n"].alias("n"), one["at"].alias("at"))).cast(_FOUND).alias("out"))

            def step(s: Column, m: Column) -> Column:
                ok = (m["n"] == s["e"]) & (m["at"] > one["at"]) & (s["e"] <= last)
                return F.struct(F.when(ok, s["e"] + 1).otherwise(s["e"]).alias("e"), F.when(ok, F.concat(s["out"], F.array(F.struct(m["n"].alias("n"), m["at"].alias("at"))))).otherwise(s["out"]).alias("out"))

            return F.when(one.isNotNull(), F.aggregate(marks, start, step, lambda s: s["out"])).otherwise(F.array().cast(_FOUND))

        return let(first, rest)

    def marks(lines: Column) -> Column:
        return F.filter(F.transform(lines, lambda x, i: F.struct(
            F.regexp_extract(x, r"^\s*(\d{1,2})(?:\.|\s|$)(?!\d)", 1).try_cast("long").alias("n"), i.cast("long").alias("at"),
            F.regexp_like(x, F.lit(r"^\s*\d{1,2}\.")).alias("dot"), F.regexp_like(F.substring(x, 1, 60), F.lit(INSTRUCTION)).alias("told"))), lambda m: m["n"].isNotNull())

    region = F.when(anchor > 0, F.substr(text, anchor + 1)).otherwise(text)
    shift = F.when(anchor > 0, anchor).otherwise(0).cast("long")
    # the place of a line is the length of what stands before it, measured only for the lines taken
    place = lambda lines, x: F.struct(x["n"].alias("n"), (F.length(F.array_join(F.slice(lines, F.lit(1), x["at"].cast("int")), "\n")) + (x["at"] > 0).cast("int") + shift).cast("long").alias("at"))
    return let(F.split(region, "\n"), lambda lines: F.transform(let(marks(lines), walk), lambda x: place(lines, x)))


def variant_keys(lines: DataFrame, by: Sequence[str], order: str, line: str) -> DataFrame:
    """Question starts (``7.``, ``A1.``) with a key; a prefix that starts again at 1 opens its next variant: ``1``, ``2``, ``1v2``.

    A number counts if it is one more than its prefix's last, or 1 after any: the walk of each prefix is a fold over its own numbers.
    """
    p = r"^\s*(?:([A-Z])(\d{1,2})|(\d{1,2}))\."
    d = lines.withColumn("prefix", F.regexp_extract(line, p, 1)).withColumn("n", F.coalesce(F.nullif(F.regexp_extract(line, p, 2), F.lit("")), F.nullif(F.regexp_extract(line, p, 3), F.lit(""))).cast("long")).where("n is not null")
    g = d.groupBy(*by, "prefix").agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), "n"))).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("v"), F.array().cast("array<struct<o:bigint,n:bigint,v:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        again = (x["n"] == 1) & (s["last"] >= 1)
        ok = (x["n"] == s["last"] + 1) | again
        v = s["v"] + again.cast("long")
        one = F.array(F.struct(x["o"].alias("o"), x["n"].alias("n"), v.alias("v")))
        return F.struct(F.when(ok, x["n"]).otherwise(s["last"]).alias("last"), v.alias("v"), F.when(ok, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    e = g.select(*by, "prefix", F.explode(F.aggregate("x", start, step, lambda s: s["out"])).alias("k"))
    key = F.concat("prefix", "k.n", F.when(F.col("k.v") > 0, F.concat(F.lit("v"), F.col("k.v") + 1)).otherwise(""))
    return e.select(*by, F.col("k.o").alias(order), key.alias("key"))


def block_walk(hits: DataFrame, blocks: DataFrame, by: Sequence[str], pos: str, number: str) -> DataFrame:
    """Blocks (block, start, end, lo, hi) with the places of lo..hi in order inside them, and ``ok`` if all are there."""
    j = blocks.join(hits, list(by)).where((F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("end")))
    g = j.groupBy(*by, "block", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct(F.col(pos).cast("long").alias("at"), F.col(number).cast("long").alias("n")))).alias("x"))
    start = F.struct(F.col("lo").cast("long").alias("e"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        ok = (x["n"] == s["e"]) & (s["e"] <= F.col("hi"))
        return F.struct(F.when(ok, s["e"] + 1).otherwise(s["e"]).alias("e"), F.when(ok, F.concat(s["out"], F.array(x["at"]))).otherwise(s["out"]).alias("out"))

    w = g.select(*by, "block", "lo", "hi", F.aggregate("x", start, step, lambda s: s["out"]).alias("places"))
    w = blocks.select(*by, "block", "lo", "hi").join(w, [*by, "block", "lo", "hi"], "left")
    places = F.coalesce("places", F.array().cast("array<bigint>"))
    return w.select(*by, "block", "lo", "hi", places.alias("places"), (F.size(places) == F.greatest(F.col("hi") - F.col("lo") + 1, F.lit(0))).alias("ok"))


def sections(headings: DataFrame, by: Sequence[str], order: str, kind: Column, name: str, end: Column, back_from: Column | None = None) -> DataFrame:
    """Sections (name, start, end): ``kind`` is 'practice' (opens one), 'stop' (closes it) or null.

    A practice heading that repeats the open section's name continues it, another one ends it and opens its own; what begins at or after
    ``back_from`` is back matter, which closes the last section.
    """
    d = headings.withColumn("_k", kind).where("_k is not null")
    if back_from is not None:
        d = d.withColumn("_back", back_from).where(F.col("_back").isNull() | (F.col(order) < F.col("_back")))
    w = Window.partitionBy(*by).orderBy(order)
    # what is open before a heading is told by the heading before it
    same = (F.col("_k") == "practice") & (F.lag("_k").over(w) == "practice") & (F.lag(name).over(w) == F.col(name))
    events = d.withColumn("_same", F.coalesce(same, F.lit(False))).where("not _same")
    limit = F.coalesce(F.col("_back"), end) if back_from is not None else end
    s = events.withColumn("end", F.coalesce(F.lead(order).over(w), limit)).where("_k = 'practice'")
    return s.select(*by, name, F.col(order).alias("start"), "end")


def mcq_questions(lines: DataFrame, by: Sequence[str], order: str, line: str, stem: str, drop: str, longest: int = 60) -> DataFrame:
    """Stems with their options (by, number, stem, options): a line that opens like a stem begins a question; short lines that don't ask are options,
    others go on with the stem. A question with fewer than two options is none."""
    t = F.trim(line)
    d = lines.withColumn("_t", t).where((t != "") & ~F.regexp_like(t, F.lit(drop))).withColumn("_s", F.regexp_like("_t", F.lit(stem)))
    d = d.withColumn("_q", F.sum(F.col("_s").cast("int")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).where("_q > 0")
    option = ~F.col("_s") & (F.length("_t") < longest) & ~F.endswith("_t", F.lit("?"))
    of = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct(order, "_t")))), lambda x: x["_t"])
    g = d.groupBy(*by, "_q").agg(F.array_join(of(~option), " ").alias("stem"), of(option).alias("options")).where(F.size("options") >= 2)
    return g.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy("_q")).cast("long")).drop("_q")


def located_prompts(text: Column, prompts: Column, sizes: Sequence[int] = (60, 30)) -> Column:
    """array<struct<n,at>>: where each prompt (in order, numbered from 1) starts in ``text``, compared in lower case and single spaces.

    Needles are the prompt's first ``sizes`` characters in turn, then its last 30; the cursor advances past each place found. A prompt that is not
    there takes the next line break after the cursor, which must advance it, and none after the last one.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), r"[^\S\n]+", " ")

    def find_in(hay: Column, wanted: Column) -> Column:
        def find(n: Column, since: Column) -> Column:
            p = F.trim(F.element_at(wanted, n.cast("int")))
            at = lambda needle: F.when(F.length(needle) >= 8, F.nullif(F.call_function("locate", needle, hay, (since + 1).cast("int")), F.lit(0)))
            tail = F.greatest(at(F.right(p, F.lit(30))) - F.length(p) + 30, since + 1)
            fallback = F.nullif(F.call_function("locate", F.lit("\n"), hay, (since + 1).cast("int")), F.lit(0)) + 1
            return F.coalesce(*(at(F.substring(p, 1, k)) for k in sizes), tail, fallback) - 1

        return _cursor_fold(F.sequence(F.lit(1), F.size(wanted)), F.lit(0), find)

    return let(norm(text), lambda h: let(F.transform(prompts, norm), lambda w: F.when(F.size(w) > 0, find_in(h, w)).otherwise(F.array().cast(_FOUND))))


def projected_prompts(text: Column, prompts: Column, part: int = 80, sizes: Sequence[int] = (60, 40), least: int = 8) -> Column:
    """array<struct<n,at>>: where each prompt (in order, numbered from 1) starts in ``text``, compared by letters and digits alone.

    Text and prompts are reduced to lower-case letters and digits with single spaces, so a prompt is found although the text has lost or
    changed its symbols. A prompt is sought from its first part's label (``part`` characters), then by its first ``sizes`` characters; needles of
    fewer than ``least`` count as not there. Places are those of the raw text; the cursor moves past each place found, and a prompt that is not
    there is left out.
    """
    chars = lambda c: F.array_join(F.transform(position_map(c), lambda x: x["ch"]), "")

    def needles(p: Column) -> Column:
        opened = F.regexp_instr(p, F.lit(FIRST_PART))
        from_part = F.when(opened > 0, F.substring(F.trim(chars(F.substr(p, opened))), 1, part)).otherwise("")
        return F.array(F.trim(from_part), *(F.trim(F.substring(F.trim(chars(p)), 1, k)) for k in sizes))

    def find_in(places: Column, hay: Column, wanted: Column) -> Column:
        def find(n: Column, since: Column) -> Column:
            at = lambda x: F.when(F.length(x) >= least, F.nullif(F.call_function("locate", x, hay, (since + 1).cast("int")), F.lit(0)))
            one = F.element_at(wanted, n.cast("int"))
            return F.coalesce(*(at(F.get(one, F.lit(k))) for k in range(len(sizes) + 1))) - 1

        found = _cursor_fold(F.sequence(F.lit(1), F.size(wanted)), F.lit(0), find)
        return F.transform(found, lambda x: F.struct(x["n"].alias("n"), F.get(places, x["at"].cast("int"))["at"].cast("long").alias("at")))

    there = let(position_map(text), lambda m: let(F.array_join(F.transform(m, lambda x: x["ch"]), ""), lambda h: let(F.transform(prompts, needles), lambda w: find_in(m, h, w))))
    return F.when(F.size(prompts) > 0, there).otherwise(F.array().cast(_FOUND))


def bounded_answers(text: Column, places: Column, opening: str = r"(?i)(?:markscheme|answer)s?:?", least: int = 1) -> Column:
    """array<struct<n,answer>>: a prompt's region ends where the next one starts; its answer follows the last opening mark in it, else its first
    blank line. Regions without either, or with fewer than ``least`` characters of answer, are rejected (null)."""
    def region(x: Column, i: Column) -> Column:
        end = F.coalesce(F.get(places, i + 1)["at"], F.length(text).cast("long"))
        return F.substr(text, (x["at"] + 1).cast("int"), F.greatest(end - x["at"], F.lit(0)).cast("int"))

    def answer(r: Column) -> Column:
        marked = F.split(r, opening)
        said = F.when(F.size(marked) > 1, F.element_at(marked, -1)).otherwise(F.nullif(F.regexp_extract(r, r"\n\s*\n([\s\S]*)$", 1), F.lit("")))
        a = F.regexp_replace(said, r"^\s+|\s+$", "")
        return F.when(F.length(a) >= least, a)

    return F.transform(places, lambda x, i: F.struct(x["n"].alias("n"), answer(region(x, i)).alias("answer")))


def merged_fragments(fragments: DataFrame, by: Sequence[str], order: str, text: str, at: str, echo_end: str) -> DataFrame:
    """Fragments of questions that a page break split, merged: (question, content).

    ``at`` is where the markscheme echoes a fragment (null: nowhere), ``echo_end`` where that question's answers begin. A fragment joins
    the question before it if that has no options yet and the fragment starts with options or is echoed before its answers begin.
    The text so far decides, so a document's fragments are folded in order.
    """
    o = option_state(F.col(text))
    rows = fragments.select(*by, F.col(order).cast("long").alias("o"), F.coalesce(text, F.lit("")).alias("t"), F.col(at).cast("long").alias("at"), F.col(echo_end).cast("long").alias("until"), o["starts"].alias("opens"),
                            F.regexp_count(text, F.lit(r"(?m)^\s*[A-D]\.\s")).alias("options"))
    g = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("o", "t", "at", "until", "opens", "options"))).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("q"), F.lit(3).alias("options"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("until"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        echoed = F.coalesce((s["at"] <= x["at"]) & (x["at"] < s["until"]), F.lit(False))
        joins = (s["options"] < 3) & (x["opens"] | echoed)
        q = s["q"] + (~joins).cast("long")
        return F.struct(q.alias("q"), F.when(joins, s["options"] + x["options"]).otherwise(x["options"]).alias("options"), F.when(joins, s["at"]).otherwise(x["at"]).alias("at"),
                        F.when(joins, s["until"]).otherwise(x["until"]).alias("until"), F.concat(s["out"], F.array(q)).alias("out"))

    z = F.arrays_zip(F.col("x"), F.aggregate("x", start, step, lambda s: s["out"]).alias("q"))
    e = g.select(*by, F.explode(z).alias("z")).select(*by, F.col("z.q").alias("question"), F.col("z.x.o").alias("o"), F.col("z.x.t").alias("t"))
    return e.groupBy(*by, "question").agg(F.count(F.lit(1)).alias("n_fragments"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n").alias("content"))


# Words before a number that make it a reference, what ends a sentence, how a question and a part open, and a number inside a line.
REFERENCES = ("figure", "fig.", "equation", "section", "step", "diagram", "table", "graph", "refer", "see ", "as in", "shown in", "(", "[", "e.g.", "i.e.", "eq.")
ENDS = (".", "!", "?", ")", ":", "]")
QUESTION = r"^(\d{1,2})\.(?:\s+(.*)|$)"
PART = r"^\(([a-f])\)\s*(.*)$"
INNER = r"(?<!\d)(?<!\d\.)\d{1,2}\.(?!\d)\s+(?=[A-Z(\[])"
_BLANK = r"^\s+|\s+$"
_ENTRY = "struct<question:bigint,part:string,line:string>"


def _told(line: Column) -> Column:
    """What a line says by itself: number and rest of a question it opens, a part it opens, and the number that may have bled into it."""
    strip = lambda c: F.regexp_replace(c, _BLANK, "")
    number = lambda c: F.nullif(F.regexp_extract(c, QUESTION, 1), F.lit("")).cast("long")
    lead = F.get(F.split(line, INNER, 2), F.lit(0))
    before, tail = F.regexp_replace(lead, r"\s+$", ""), F.substring(line, F.length(lead) + 1, 1 << 30)
    window = F.lower(F.substring(before, -14, 14))
    sound = F.substring(before, -1, 1).isin(*ENDS) & ~F.regexp_like(before, F.lit(r"\d:$")) & ~F.exists(F.array(*map(F.lit, REFERENCES)), lambda w: F.contains(window, w))
    bled = F.when((F.length(lead) < F.length(line)) & sound, number(tail))
    rest = strip(F.regexp_extract(F.when(number(line).isNotNull(), line).otherwise(tail), QUESTION, 2))
    part = lambda c: F.nullif(F.regexp_extract(c, PART, 1), F.lit(""))
    body = lambda c: F.when(part(c).isNotNull(), strip(F.regexp_extract(c, PART, 2))).otherwise(c)
    return F.struct(line.alias("line"), number(line).alias("n"), bled.alias("bled"), before.alias("before"), part(line).alias("part"), body(line).alias("body"),
                    part(rest).alias("rest_part"), body(rest).alias("rest"))


def paper_parts(papers: DataFrame) -> DataFrame:
    """``papers`` (doc, text) -> (doc, question, part, content); part '' is the stem, which every question has.

    ``N.`` opens a question (0 none: that line belongs to the stem) and ``(a)`` to ``(f)`` a part. A number that follows the end of a sentence
    inside a line and is no reference opens a question too, if it is one or two after the current one. What a line says by itself
    are expressions; a fold over them carries the current question and part.
    """
    def step(now: Column, x: Column) -> tuple[Column, Column]:
        current = now["question"]
        cut = x["n"].isNull() & (current > 0) & F.coalesce((x["bled"] - current).between(1, 2), F.lit(False))
        opens = cut | F.coalesce(x["n"] > 0, F.lit(False))
        question = F.when(cut, x["bled"]).when(opens, x["n"]).otherwise(current)
        part = F.when(opens, F.coalesce(x["rest_part"], F.lit(""))).when(x["n"].isNull() & (current > 0), F.coalesce(x["part"], now["part"])).otherwise(now["part"])
        entry = lambda q, p, c: F.struct(q.alias("question"), p.alias("part"), c.alias("line"))
        said = F.nullif(x["rest"], F.lit(""))
        new = F.array(entry(question, F.lit(""), F.lit(None).cast("string")), entry(question, part, said))
        inside = F.when(x["n"] == 0, entry(current, F.lit(""), x["line"])).when(x["part"].isNotNull(), entry(current, part, F.nullif(x["body"], F.lit("")))).otherwise(entry(current, part, x["line"]))
        out = F.when(cut, F.concat(F.array(entry(current, now["part"], x["before"])), new)).when(opens, new).when(current > 0, F.array(inside))
        return F.struct(question.alias("question"), part.alias("part")), F.coalesce(out, F.array().cast(f"array<{_ENTRY}>"))

    told = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: let(F.regexp_replace(x, _BLANK, ""), _told))
    begin = F.struct(F.lit(0).cast("long").alias("question"), F.lit("").alias("part"))
    kept = gathered(F.col("told"), begin, "struct<question:bigint,part:string>", _ENTRY, step)
    rows = papers.select("doc", told.alias("told")).select("doc", F.posexplode(kept).alias("k", "e"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("k", "e.line"))), lambda x: x["line"])
    return rows.groupBy("doc", F.col("e.question").alias("question"), F.col("e.part").alias("part")).agg(F.array_join(lines, "\n").alias("content"))


def segmented_papers(papers: DataFrame, by: str, question: Column, scheme: Column, few: int = 6, many: int = 25) -> DataFrame:
    """Papers with the starts of their questions and answers (arrays), their number by the markscheme, and why they are skipped (null: they are not).

    A paper counts only if its markscheme numbers ``few`` to ``many`` questions and as many are found in both.
    """
    return papers.select(by, question.alias("q"), scheme.alias("m")).withColumn("n", F.size("m").cast("long")).withColumn(
        "skip", F.when(F.col("n") < few, "too few").when(F.col("n") > many, "too many").when(F.size("q") != F.size("m"), "counts differ"))


def repaired_answers(answers: DataFrame, sign: str = "Examiners report", least: int = 40, sure: float = 0.6) -> DataFrame:
    """``answers`` (current, found, score) with ``action``: 'replace' only where the current one bleeds into the report, the found one is clean,
    long enough and surely placed; 'risk' where a clean current one would have been; else 'keep'. ``answer`` is the outcome."""
    cut = F.regexp_replace(F.when(F.contains("found", F.lit(sign)), F.substring_index("found", sign, 1)).otherwise(F.col("found")), r"^\s+|\s+$", "")
    bleeds = F.contains(F.coalesce("current", F.lit("")), F.lit(sign))
    good = F.coalesce((F.length(cut) >= least) & (F.col("score") >= sure), F.lit(False))
    action = F.when(good & bleeds, "replace").when(good, "risk").otherwise("keep")
    return answers.withColumn("action", action).withColumn("answer", F.when(F.col("action") == "replace", cut).otherwise(F.col("current")))


def declared_ranges(text: Column) -> Column:
    """array<struct<letter,lo,hi>> of ``Option A — name ... 3 – 7`` lines."""
    letter, lo, hi = (F.regexp_extract_all(text, F.lit(OPTION_RANGE), F.lit(k)) for k in (1, 2, 3))
    return F.transform(F.arrays_zip(letter.alias("a"), lo.alias("b"), hi.alias("c")), lambda x: F.struct(x["a"].alias("letter"), x["b"].cast("long").alias("lo"), x["c"].cast("long").alias("hi")))


def linked_figures(records: DataFrame, pages: DataFrame, least: int = 3) -> DataFrame:
    """Records (id, source, number, text) with the page of their figure and the outcome.

    The page is the first of the source that holds the number, else the first that holds the text's opening 30 letters; it counts only with
    ``least`` vectors (page, source, numbers, content, vectors).
    """
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    r = records.withColumn("_t", F.substring(norm(F.col("text")), 1, 30))
    j = r.join(pages.withColumn("_c", norm(F.col("content"))), "source", "left")
    by_number, by_text = F.array_contains("numbers", F.col("number")), (F.length("_t") >= 12) & F.contains("_c", F.col("_t"))
    g = j.groupBy("id").agg(F.min_by(F.struct("page", "vectors"), F.when(by_number, F.struct(F.lit(0).alias("p"), "page")).when(by_text, F.struct(F.lit(1).alias("p"), "page"))).alias("x"),
                            F.max(F.col("page").isNotNull()).alias("known"), F.max(F.coalesce(by_number, F.lit(False))).alias("numbered"))
    outcome = F.when(~F.col("known"), "no source").when(F.col("x").isNull(), "no page").when(F.col("x.vectors") < least, "no figure").when(F.col("numbered"), "by number").otherwise("by text")
    return g.select("id", outcome.alias("outcome"), F.when(outcome.isin("by number", "by text"), F.col("x.page")).alias("page"))
