"""Text normalisation and parsing as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page furniture, matched against whole trimmed lines.
FURNITURE = (
    r"(?i)^turn over\.?$", r"(?i)^please do not write on this page\.?$",
    r"(?i)^do ?n[o']?t write solutions on this page\.?( any working on this page will not be marked\.?)?$", r"(?i)^do not write in this area\.?$",
    r"(?i)^blank page\.?$", r"(?i)^this page is intentionally blank\.?$", r"(?i)^answers written on this page( will( not( be marked\.?)?)?)?$", r"(?i)^not be marked\.?$",
    r"(?i)^\(\s*(question|option)[^)]*\bcontinued\s*\)$", r"(?i)^©\s*international baccalaureate organization\s*\d{4}\.?$",
    r"^[A-Z]{1,2}\d{2}/\d/[A-Z0-9]+/[A-Z0-9]+/[A-Z0-9]{2,4}/[A-Z0-9]+/[A-Z0-9]{1,4}$", r"^[–—-]\s*\d{1,3}\s*[–—-]$",
)
# Command terms of exam questions.
COMMAND_TERMS = (
    "calculate", "show", "find", "state", "determine", "explain", "outline", "define", "describe", "suggest", "draw", "sketch", "evaluate", "solve", "deduce", "prove", "identify",
    "estimate", "distinguish", "discuss", "justify", "derive", "hence", "construct", "write", "complete", "use", "verify", "comment", "compare", "express", "simplify", "factorise",
    "factorize", "expand", "graph", "annotate", "label", "measure", "predict", "design", "plot", "tabulate", "list", "give", "form", "investigate", "transform", "convert", "apply",
    "interpret", "sketch",
)
MONTHS = {"M": "May", "N": "November", "SP": "Specimen"}


def let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once a row: the optimizer may copy an expression into a lambda, where it would run once an element."""
    return F.transform(F.array(value), body)[0]


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def alnum_key(c: Column, zero_for_o: bool = False) -> Column:
    k = F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    return F.translate(k, "o", "0") if zero_for_o else k


def drop_lines(c: Column, patterns, trimmed: bool = False) -> Column:
    """The text without the lines, trimmed if asked, that hold a pattern; idempotent."""
    # one look at each line, trimmed once
    any_of = F.lit("|".join(f"(?:{p})" for p in patterns))
    seen = F.transform(F.split(c, "\n"), lambda x: F.struct(x.alias("line"), (F.regexp_replace(x, r"^\s+|\s+$", "") if trimmed else x).alias("told")))
    return F.array_join(F.transform(F.filter(seen, lambda x: ~F.regexp_like(x["told"], any_of)), lambda x: x["line"]), "\n")


def clean_furniture(c: Column) -> Column:
    """The text without page furniture; the blank lines left behind are collapsed."""
    return collapse_newlines(drop_lines(c, FURNITURE, trimmed=True))


def half_width(c: Column) -> Column:
    """Full-width ASCII to ASCII, ideographic space to space."""
    wide = "".join(chr(0xFF01 + k) for k in range(94)) + "　"
    return F.translate(c, wide, "".join(chr(0x21 + k) for k in range(94)) + " ")


def map_glyphs(c: Column, pairs: dict[str, str], single: dict[str, str]) -> Column:
    """Multi-character replacements first, then one-to-one ones; an empty target deletes."""
    for a, b in pairs.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    kept = {a: b for a, b in single.items() if b}
    gone = [a for a, b in single.items() if not b]
    return F.translate(c, "".join([*kept, *gone]), "".join(kept.values()))


def normalise_label(c: Column) -> Column:
    """Before the middle dot P1 to P3 are written out and spacing is collapsed; from it on November becomes Nov."""
    at = F.instr(c, "·")
    head, tail = F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(c), F.when(at > 0, F.substr(c, at)).otherwise("")
    head = F.regexp_replace(F.regexp_replace(head, r"\bCS HL P([123])\b", "CS HL Paper $1"), r"\s+", " ")
    return F.concat(head, F.regexp_replace(tail, r"\bNovember\b", "Nov"))


def marks_in(c: Column) -> Column:
    """Sum of bracketed marks such as [3] or [12 marks]."""
    found = F.regexp_extract_all(c, F.lit(r"\[(\d+)(?:\s*marks?)?\]"), F.lit(1))
    return F.aggregate(F.transform(found, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def command_term(c: Column) -> Column:
    """The first word, if it is a command term, as written; else null."""
    word = F.regexp_extract(c, "[A-Za-z]+", 0)
    return F.when(F.lower(word).isin(list(COMMAND_TERMS)), word)


def parse_code(c: Column) -> Column:
    """<YY><M|N|SP>.<paper>.<level>.TZ<z>.<q> as a struct; nulls where it does not parse."""
    pattern = r"^(\d{2})(M|N|SP)\.(\d)\.(HL|SL|AHL|ASL)\.TZ(\d)\.(\d{1,2}[a-z]?)$"
    g = lambda k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    return F.struct((g(1).cast("int") + 2000).alias("year"), g(2).alias("series"), g(3).cast("int").alias("paper"), g(4).alias("level"), g(5).cast("int").alias("tz"), g(6).alias("question"))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("long")


def mcq_key(c: Column) -> Column:
    """Answer letters by question number, ``N. X``; the first of a number wins. As ``n:X`` joined by commas."""
    n = F.regexp_extract_all(c, F.lit(r"(\d{1,2})\.\s*([A-D])\b"), F.lit(1))
    x = F.regexp_extract_all(c, F.lit(r"(\d{1,2})\.\s*([A-D])\b"), F.lit(2))
    z = F.transform(F.arrays_zip(n.alias("n"), x.alias("x")), lambda p, i: F.struct(p["n"].cast("int").alias("n"), i.alias("i"), p["x"].alias("x")))
    first = let(F.sort_array(z), lambda s: F.filter(s, lambda p, i: (i == 0) | (F.get(s, i - 1)["n"] != p["n"])))
    return F.array_join(F.transform(first, lambda p: F.concat_ws(":", p["n"].cast("string"), p["x"])), ",")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def source_badge(category: Column, source: Column) -> Column:
    return (F.when(category == "ai", "AI").when(category == "topic", "Topic").when(category.isNull(), "Unlabelled")
            .when(F.startswith(source, F.lit("src1")), "Series 1").otherwise("Past"))


def drop_adjacent_repeats(tokens: Column) -> Column:
    return let(tokens, lambda t: F.filter(t, lambda x, i: (i == 0) | (F.get(t, i - 1) != x)))


def shattered(c: Column) -> Column:
    """At least four tokens of which 45 % are single characters."""
    short = lambda t: (F.size(t) >= 4) & (F.size(F.filter(t, lambda x: F.length(x) == 1)) >= 0.45 * F.size(t))
    return let(F.filter(F.split(c, r"\s+"), lambda x: x != ""), short)


def degarble(c: Column) -> Column:
    """A letter-spaced heading joined and its page number dropped; others only lose outer space."""
    t = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    short = F.size(F.filter(t, lambda x: F.length(x) == 1)) >= 0.45 * F.size(t)
    return F.when((F.size(t) >= 3) & short, F.regexp_replace(F.array_join(t, ""), r"\d+$", "")).otherwise(F.trim(c))


def break_parts(c: Column) -> Column:
    """A line break before (a), (b), ... and roman parts that stand inside a line."""
    return F.regexp_replace(c, r"(?<!^)(?<!\n)[ \t]+(?=\((?:[a-h]|i{1,3}|iv|v)\)\s)", "\n")


def option_letters(c: Column) -> Column:
    """Letters of lines that begin with A. to D."""
    return F.regexp_extract_all(c, F.lit(r"(?m)^\s*([A-D])[.)]\s"), F.lit(1))


def stem_needle(c: Column, n: int = 90) -> Column:
    """Text up to the first option or marks token, lower case, n characters."""
    return F.substring(F.lower(collapse_space(F.element_at(F.split(c, r"(?m)^\s*A[.)]\s|\[\d+(?: marks?)?\]", 2), 1))), 1, n)


def split_images(c: Column) -> Column:
    """Comma-joined paths: trimmed, empties dropped, leading / and figures/ stripped; absolute URLs kept."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(F.regexp_like(x, F.lit("^https?://")), x).otherwise(F.regexp_replace(x, r"^/?(figures/)?", "")))


def line_number(c: Column, strict: bool = True) -> Column:
    """The number that opens a line: ``7.`` or ``7)`` when strict, else a bare ``7`` as well."""
    return F.nullif(F.regexp_extract(c, r"^\s*(\d{1,3})[.)](?!\d)" if strict else r"^\s*(\d{1,3})(?:[.)]|\s|$)", 1), F.lit("")).cast("int")


def join_option_values(c: Column) -> Column:
    """``A.`` alone on a line takes the short value of the next line, unless that opens a part or an option."""
    return F.regexp_replace(c, r"(?m)^([A-D][.)])[ \t]*\n(?!\(|[A-D][.)])([^\nA-Za-z]{1,15})$", "$1 $2")


def drop_empty_answers(c: Column) -> Column:
    """Lines that only say [N/A] or hold a lone marker go."""
    return drop_lines(c, (r"^\s*\[N/A\]\s*$", r"^\s*[•▪–-]\s*$"))


def session_label(c: Column) -> Column:
    """``May 2019``, ``2019 May``, ``M19`` and ``may_2019`` as ``May 2019``; null otherwise."""
    name = F.initcap(F.regexp_extract(c, r"(?i)(may|november|specimen)", 1))
    year = F.regexp_extract(c, r"(20\d{2})", 1)
    short = F.regexp_extract(c, r"\b(M|N)(\d{2})\b", 1)
    long = F.when((name != "") & (year != ""), F.concat(name, F.lit(" "), year))
    return F.coalesce(long, F.when(short != "", F.concat(F.when(short == "M", "May").otherwise("November"), F.lit(" 20"), F.regexp_extract(c, r"\b(M|N)(\d{2})\b", 2))))


def tail_tag(c: Column, names: dict[str, str]) -> Column:
    """What the last dot-separated tag of a code stands for."""
    tag = F.element_at(F.split(c, r"\."), -1)
    return F.coalesce(*(F.when(tag == k, F.lit(v)) for k, v in names.items()))


def split_at_parts(c: Column) -> Column:
    """The pieces of a page that each begin with an ``(a)`` line; what stands before the first is the first piece."""
    return F.filter(F.split(c, r"(?m)(?=^\s*\(a\))"), lambda x: F.trim(x) != "")


def break_paragraph(c: Column, least: int = 250) -> Column:
    """A long single line broken after sentences, not after common abbreviations."""
    broken = F.regexp_replace(c, r"(?<!\b(?:e\.g|i\.e|Fig|No|vs|cf))\.\s+(?=[A-Z(])", ".\n")
    return F.when((F.length(c) >= least) & ~F.contains(c, F.lit("\n")), broken).otherwise(c)
