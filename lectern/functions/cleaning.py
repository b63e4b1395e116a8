"""Cleaning of extracted papers and books: noise, headings, labels, positions, marks and answer text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import collapse_newlines, collapse_space, drop_lines, half_width, let

# Lines that are noise, by kind of extract; matched against trimmed lines.
NOISE = {
    "papers": (
        r"^–\s*\d+\s*–.*$", r"^\d{4}\s*–\s*\d{4}[A-Z0-9]*$", r"^M\d{2}/[0-9A-Z/]+$", r"^\d+EP\d+$", r"^©.*$", r"^Turn\s+over.*$", r"^[.\s·]+$", r"(?i)^(continued|blank page).*$",
    ),
    "crops": (
        r"^$", r"^–\s*\d+\s*–.*$", r"^\d{4}\s*–\s*\d{4}[A-Z0-9]*$", r"^M\d{2}/[0-9A-Z/]+$", r"^\d+EP\d+$", r"^©.*$", r"^[Tt]urn\s+over.*$", r"^[.\s·]+$", r"(?i)^(continued|blank page).*$",
        r"(?i)^do not.*$", r"(?i)^\d+\s+pages?\s*©.*$", r"^\d+\s+pages?$",
    ),
    "computing": (
        r"^–\s*\d+\s*–", r"^\d{4}–\d{4}$", r"^(Computer science|Higher level|Paper 1|Paper 2|Paper 3|Instructions to candidates)$", r"/COMSC/|/ENG/|TZ[0-3]|/HP[123]/",
    ),
    "maths": (r"^–\s*\d+\s*–", r"MATHX/HP1", r"^\d{2}EP\d{2}$", r"M\d\d/\d/MATHX"),
    "physics": (
        r"Please do not write on this page|Answers written on this page", r"^Turn over$", r"^[-–]\s*\d+\s*[-–]", r"^\d{2}EP\d{2}$", r"(?:M|N|O)\d{2}/4/PHYSI",
    ),
}
# What a page leaves inside a line.
ARTIFACTS = (
    r"–\s*\d+\s*–", r"\b\d{4}[–-]\d{4}\b", r"(?i)\bturn over\b", r"(?i)\bend of paper\b", r"(?i)\(\s*option\s+[a-d]\s*continued\s*\)", r"(?i)\banswer\s+all\s+questions\b\.?",
    r"(?i)\bsection\s+[ab]\b", r"(?i)\bcomputer\s+science\b", r"(?i)\b(?:higher|standard)\s+level\b", r"(?i)\bpaper\s+\d+\b", r"(?i)\b(end of option [a-d]|continued)\b\.?",
)
TITLE_LEAD = r"(?i)^\s*hl\.?\s*p\w*r\s*\d+\s*p?\s*[\r\n]*"
# Kinds of sections by what their heading holds without spaces, in order.
SECTION_KINDS = (
    ("reviewset", "Review set"), ("xercis", "Exercise"), ("practicequestions", "Practice questions"), ("testyourunderstanding", "Test your understanding"),
    ("exam-stylequestions", "Exam-style questions"), ("multiplechoice", "Multiple choice questions"), ("mixedpractice", "Mixed practice"),
    ("chapterreview", "Chapter review"), ("data-?basedquestions", "Data-based questions"), ("end-of-topicquestions", "End-of-topic questions"),
    ("linkingquestions", "Linking questions"), ("topicreview", "Topic review"), ("guidingquestions", "Guiding questions"),
    ("mixedquestionsset", "Mixed questions set"), ("skillbuilder", "Skill builder questions"), ("practice", "Practice"), ("xerc", "Exercise"),
)
SECTION_TOPICS = (
    ("numberandalgebra", "Number and algebra"), ("geometryandtrigonometry", "Geometry and trigonometry"), ("statisticsandprobability", "Statistics and probability"),
    ("syllabusrevision", "Syllabus revision"), ("functions", "Functions"), ("calculus", "Calculus"),
)
# Openings that tell a new question from a continuation.
PROMPT_ANCHOR = (
    r"(This question is about|The diagram|The graph|The figure|The circuit|The sketch|The picture|The following diagram|Define |State |Calculate |Show that |Determine |Derive |"
    r"Explain |Outline |Describe |Discuss |Estimate |Measure |Sketch |Plot |Draw |Deduce |Suggest |Compare |Construct |Find |Which\b|What\b|How\b|Why\b|An |A |The )"
)
CONTINUATION = r"^\s*(Markscheme|Examiners report|\[N/A\]|\(\s*N/A\s*\)|[a-e]\.\s|\([a-e]\)|a\.i\.|b\.|c\.|d\.|e\.)"
# Command terms that open a body, the longer ones first.
OPENING_TERMS = (
    "Hence or otherwise", "Hence find", "Hence show", "Hence determine", "Hence", "Find the probability", "Find the exact", "Find the value", "Find an expression",
    "Find the coordinates", "Find the equation", "Find", "Show that", "Show", "Determine", "Write down", "Prove", "Sketch", "State", "Calculate", "Solve", "Express",
    "Describe", "Explain", "Deduce", "Verify", "Using", "Given that", "Find the",
)
# Command terms after which a long paragraph is broken, and abbreviations after which it is not.
BREAK_TERMS = (
    "Calculate", "Determine", "Explain", "State", "Outline", "Describe", "Identify", "Define", "Show", "Find", "Write", "Draw", "Sketch", "Construct", "Suggest", "Deduce", "Hence",
    "Using", "Consider", "Analyse", "Analyze", "Compare", "Evaluate", "Justify", "Predict", "Apply", "Formulate", "Derive", "Solve", "Prove", "Demonstrate", "Copy", "Complete",
    "Convert", "Estimate", "Give", "Label", "List", "Plot", "Represent", "Comment", "Discuss", "Summarise", "Summarize", "Translate", "Research", "Starting", "Award", "Accept", "Note",
)
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "St", "Prof", "Sr", "Jr", "vs", "etc", "approx", "fig", "ex", "eg", "ie", "cf", "al", "max", "min", "inf", "nan", "No")
# Ideographs that stand for operators, and digits that a font confuses.
OPERATORS = {"二": "=", "三": "≡", "十": "+", "一": "-"}
DIGIT_GLYPHS = {"&": 4, "?": 7}
TICKS = "[✓✔]|\\(cid:\\d+\\)"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_noise(c: Column, kind: str = "papers") -> Column:
    """The text without the noise lines of a kind of extract."""
    return drop_lines(c, NOISE[kind], trimmed=True)


def strip_artifacts(c: Column) -> Column:
    return _trim(reduce(lambda x, p: F.regexp_replace(x, p, " "), ARTIFACTS, _trim(c)))


def strip_title(c: Column) -> Column:
    return _trim(F.regexp_replace(c, TITLE_LEAD, ""))


def _joined(c: Column) -> Column:
    """A letter-spaced heading without its spaces and page number; null where it is not letter-spaced."""
    t = F.transform(F.filter(F.split(c, r"\s+"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    short = F.size(F.filter(t, lambda x: F.length(x).between(1, 2)))
    glued = F.regexp_replace(F.regexp_replace(F.array_join(t, ""), r"^\d{1,3}", ""), r"\d{1,3}$", "")
    return F.when((F.size(t) >= 3) & (short >= 0.45 * F.size(t)), glued)


def section_name(c: Column) -> Column:
    """A readable name of a heading: its kind and number, a known topic, ``Section 3A``, else the heading itself, 70 characters at most."""
    squeeze = lambda x: F.lower(F.regexp_replace(x, r"[\s ]+", ""))
    whole, glued = squeeze(c), squeeze(_joined(c))
    kind = F.coalesce(*(F.when(F.regexp_like(whole, F.lit(p)), F.lit(n)) for p, n in SECTION_KINDS))
    topic = F.coalesce(*(F.when(F.contains(glued, F.lit(p)), F.lit(n)) for p, n in SECTION_TOPICS))
    number = F.nullif(F.regexp_extract(c, r"\d{1,2}(?:\.\d{1,2})?[A-Z]?", 0), F.lit(""))
    lettered = F.nullif(F.regexp_extract(c, r"^(\d{1,2}[A-Z])\b", 1), F.lit(""))
    return F.coalesce(F.when(kind.isNotNull(), F.concat_ws(" ", kind, number)), F.when(kind.isNull(), topic), F.concat(F.lit("Section "), lettered), F.substring(collapse_space(c), 1, 70))


def review_label(suffix: Column) -> Column:
    """``Review set 1A``; a bare number of two digits or more that ends in 4 or 8 is a misread A or B."""
    s = F.upper(F.regexp_replace(F.coalesce(suffix, F.lit("")), r"\s+", ""))
    last = F.when(F.regexp_like(s, F.lit("^[0-9]+4$")), "A").when(F.regexp_like(s, F.lit("^[0-9]+8$")), "B")
    return F.concat(F.lit("Review set "), F.when(last.isNotNull(), F.concat(F.substr(s, F.lit(1), F.length(s) - 1), last)).otherwise(s))


def slug(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]", "-")


def disambiguated(df: DataFrame, code: str, order: str, prefix: str = "CS-", name: str = "id") -> DataFrame:
    """Ids from codes; the second of an equal base gets ``-1``, the third ``-2``."""
    d = df.withColumn("_b", F.concat(F.lit(prefix), slug(F.col(code))))
    n = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return d.withColumn(name, F.concat("_b", F.when(n > 0, F.concat(F.lit("-"), n)).otherwise(""))).drop("_b")


def position_map(c: Column) -> Column:
    """array<struct<ch,at>>: letters and digits in lower case and single spaces between them, each with its place in the raw text.

    The text is worked on whole: letters and digits stand for themselves, blanks become spaces, all else one sign.
    """
    told = F.regexp_replace(F.regexp_replace(c, r"\s", " "), r"[^\p{L}\p{N} ]", "\u0001")
    every = F.filter(F.transform(F.split(told, ""), lambda ch, i: F.struct(ch.alias("ch"), i.alias("at"))), lambda x: ~x["ch"].isin("", "\u0001"))
    # a space counts after a letter or digit only
    kept = let(every, lambda e: F.filter(e, lambda x, i: (x["ch"] != " ") | (F.get(e, i - 1)["ch"] != " ")))
    return F.transform(kept, lambda x: F.struct(F.lower(x["ch"]).alias("ch"), x["at"].alias("at")))


def math_pieces(c: Column) -> Column:
    """array<struct<kind,body>>: $$display$$, $inline$ and the text between, in order; empty text left out."""
    pattern = r"\$\$[\s\S]+?\$\$|\$[^$\n]+?\$"
    plain, math = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    def piece(t: Column, m: Column) -> Column:
        shown = F.when(F.startswith(m, F.lit("$$")) & (F.length(m) > 4), F.struct(F.lit("display").alias("kind"), F.substr(m, F.lit(3), F.length(m) - 4).alias("body")))
        line = F.struct(F.lit("inline").alias("kind"), F.substr(m, F.lit(2), F.length(m) - 2).alias("body"))
        return F.array(F.struct(F.lit("text").alias("kind"), t.alias("body")), F.when(m.isNotNull(), F.coalesce(shown, line)))

    return F.filter(F.flatten(F.zip_with(plain, math, piece)), lambda x: x.isNotNull() & ((x["kind"] != "text") | (x["body"] != "")))


def rebuilt_answer(rows: Column) -> Column:
    """Steps of answer rows (answer, notes, total), split at ticks; notes go to their steps where they are as many; the totals' sum comes last."""
    tidy = lambda parts: F.filter(F.transform(parts, collapse_space), lambda x: x != "")

    def lines(r: Column) -> Column:
        cut = tidy(F.split(r["answer"], TICKS))
        steps = F.when(F.size(cut) > 0, cut).otherwise(F.array(collapse_space(r["answer"])))
        award = F.when(F.contains(r["notes"], F.lit("Award")), tidy(F.split(r["notes"], r"(?=Award\s)")))
        notes = F.when(F.size(award) >= 2, award).otherwise(tidy(F.split(r["notes"], "\n")))
        whole = F.filter(F.array(collapse_space(r["notes"])), lambda x: x != "")
        aligned = F.when(F.size(notes) == F.size(steps), notes).otherwise(whole)

        def line(s: Column, note: Column) -> Column:
            return F.concat(F.lit("• "), s, F.when(note.isNotNull() & (F.lower(note) != "notes"), F.concat(F.lit("   ["), note, F.lit("]"))).otherwise(""))

        # a whole note that stands for all goes to the first step
        return F.filter(F.zip_with(steps, aligned, line), lambda x: x.isNotNull())

    total = F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + F.coalesce(F.regexp_replace(F.coalesce(r["total"], F.lit("")), r"\D", "").try_cast("long"), F.lit(0)))
    last = F.when(total > 0, F.array(F.concat(F.lit("[Total: "), total, F.lit(" marks]")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.flatten(F.transform(rows, lines)), last), "\n")


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0)))


def marks_by_line(c: Column) -> Column:
    """``[3 marks]`` anywhere in a line, else a bare ``[3]`` that ends the line and is its only bracketed number."""
    def of(line: Column) -> Column:
        said = F.regexp_extract_all(line, F.lit(r"(?i)\[(\d+)\s*marks?\]"), F.lit(1))
        lone = F.size(F.regexp_extract_all(line, F.lit(r"\[\d{1,2}\]"), F.lit(0))) == 1
        bare = F.regexp_extract(line, r"\[(\d{1,2})\]\s*$", 1)
        return F.when(F.size(said) > 0, _sum(said)).when(lone & (bare != ""), bare.cast("long")).otherwise(F.lit(0).cast("long"))

    return _sum(F.transform(F.split(c, "\n"), of))


def marks_or_maximum(c: Column) -> Column:
    """Bracketed numbers and ``Maximum mark: N``; null if they come to nothing."""
    return F.nullif(_sum(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1))) + _sum(F.regexp_extract_all(c, F.lit(r"[Mm]aximum\s*mark[:\s]*(\d+)"), F.lit(1))), F.lit(0))


def marks_among_lines(c: Column) -> Column:
    """A line's only bracket counts if it ends the line and follows no letter or digit; not after a figure or an upper-case name
    with an underscore, and not where a line of a bracket alone stands next to another such line (a list of indices)."""
    mark = r"\[\s*(\d+)\s*(?:mark|marks)?\s*\]"

    def told(line: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(mark), F.lit(0))
        one = F.size(found) == 1
        before = F.regexp_extract(line, r"^(.*?)\[\s*\d+\s*(?:mark|marks)?\s*\]", 1)
        word = F.regexp_extract(before, r"(\S+)\s*$", 1)
        named = F.lower(word).isin("figure", "fig") | (F.contains(word, F.lit("_")) & (F.upper(word) == word) & F.regexp_like(word, F.lit("[A-Z]")))
        ends = F.regexp_like(line, F.lit(mark + r"\s*$"))
        ok = one & ends & ~F.regexp_like(before, F.lit(r"[\p{L}\p{N}]$")) & ~named
        return F.struct((one & F.regexp_like(line, F.lit(r"^\s*" + mark + r"\s*$"))).alias("pure"), F.when(ok, F.regexp_extract(line, mark, 1).cast("long")).alias("n"))

    def counted(lines: Column) -> Column:
        beside = lambda i: F.coalesce(F.get(lines, i - 1)["pure"], F.lit(False)) | F.coalesce(F.get(lines, i + 1)["pure"], F.lit(False))
        return F.transform(lines, lambda x, i: F.when(~(x["pure"] & beside(i)), x["n"]))

    return _sum(let(F.transform(F.split(c, "\n"), told), counted))


def answer_key(c: Column) -> Column:
    """``N. X`` pairs, the last of a number counting; where fewer than five are found, ``N X`` pairs as well. As ``n:X`` joined by commas."""
    def pairs(pattern: str) -> Column:
        n, x = (F.regexp_extract_all(c, F.lit(pattern), F.lit(k)) for k in (1, 2))
        return F.zip_with(n, x, lambda a, b: F.struct(a.cast("int").alias("n"), b.alias("x")))

    def last(ps: Column) -> Column:
        s = F.sort_array(F.transform(ps, lambda p, i: F.struct(p["n"].alias("n"), i.alias("i"), p["x"].alias("x"))))
        return let(s, lambda s: F.filter(s, lambda p, i: F.get(s, i + 1).isNull() | (F.get(s, i + 1)["n"] != p["n"])))

    dotted = pairs(r"(?:^|[\s(])(\d{1,2})\s*\.\s*([A-D])\b")
    spaced = pairs(r"(?:^|[\s(])(\d{1,2})\s+([A-D])\b")
    key = let(dotted, lambda d: let(last(d), lambda k: F.when(F.size(k) >= 5, k).otherwise(last(F.concat(d, spaced)))))
    return F.array_join(F.transform(key, lambda p: F.concat_ws(":", p["n"].cast("string"), p["x"])), ",")


def opening_term(c: Column) -> Column:
    """The first of :data:`OPENING_TERMS`, in their order, that opens the body's first line or its first 80 characters."""
    body = F.when(F.regexp_like(c, F.lit(r"(?s)^\s*\d+\.\s*\[Maximum mark: \d+\].*")), F.regexp_extract(c, r"(?s)^\s*\d+\.\s*\[Maximum mark: \d+\]\s*\n?(.*)", 1)).otherwise(c)
    line = F.substring_index(_trim(body), "\n", 1)
    return F.coalesce(*(F.when(F.startswith(line, F.lit(t)) | F.startswith(body, F.lit(t)), F.lit(t)) for t in OPENING_TERMS))


def option_state(c: Column) -> Column:
    """struct<has, starts, first, last>: at least three option lines, whether the text starts with one, the first and the last letter."""
    letters = F.regexp_extract_all(c, F.lit(r"(?m)^([A-D])\.\s*"), F.lit(1))
    return F.struct((F.regexp_count(c, F.lit(r"(?m)^\s*[A-D]\.\s")) >= 3).alias("has"), F.regexp_like(c, F.lit(r"^\s*[A-D]\.\s[\s\S]*")).alias("starts"),
                    F.nullif(F.regexp_extract(c, r"^\s*([A-D])\.", 1), F.lit("")).alias("first"), F.element_at(F.when(F.size(letters) > 0, letters), -1).alias("last"))


def opens_prompt(c: Column) -> Column:
    """Whether a piece of text opens a new question: an anchor in its first three lines, and no sign of a continuation."""
    t = _trim(c)
    return (t != "") & ~F.regexp_like(t, F.lit(CONTINUATION)) & F.regexp_like(F.substring_index(t, "\n", 3), F.lit(PROMPT_ANCHOR))


def format_question(c: Column) -> Column:
    """Line breaks before parts (a) to (f) and roman parts."""
    t = F.regexp_replace(F.regexp_replace(c, r"\s+(?=\([a-f]\)\s)", "\n"), r"\s+(?=\([ivx]{1,3}\)\s)", "\n")
    return collapse_newlines(F.regexp_replace(t, r"[ \t]+\n", "\n"))


def format_answer(c: Column) -> Column:
    """Line breaks at ticks and before annotations, alternatives and parts."""
    t = F.regexp_replace(c, "[✓✔]", "\n")
    for p in (r"\s+(?=(?:\(?(?:[MAR]\d+|N\d+)\)?|AG|FT|OWTTE)\b)", r"\s+(?=(?:EITHER|OR|Note:|METHOD\s+\d+|Hence|Award\s|Do not allow)\b)"):
        t = F.regexp_replace(t, p, "\n")
    return format_question(t)


def split_paragraph(c: Column, least: int = 250, long: int = 300) -> Column:
    """A text of one long line, broken after marks, around continuation notes, before command terms, and where still long after
    sentences that don't end in an abbreviation."""
    lines = F.filter(F.split(c, "\n"), lambda x: _trim(x) != "")
    t = F.regexp_replace(F.get(lines, F.lit(0)), r"(\[\d+\])\s+(?=\S)", "$1\n")
    t = F.regexp_replace(t, r"\s*\((This question continues[^)]*|Question \d+ continued)\)\s*", "\n($1)\n")
    t = F.regexp_replace(t, r"(?<=[.\]])\s+(?=(?:" + "|".join(BREAK_TERMS) + r")\b)", "\n")
    short = "|".join(ABBREVIATIONS)
    cut = lambda p: F.when(F.length(p) > long, F.regexp_replace(p, rf"(?<!(?:^|\s)(?:{short})[.,;:!?]?)\.\s+(?=[A-Z])", ".\n")).otherwise(p)
    parts = F.split(F.array_join(F.transform(F.split(t, "\n"), cut), "\n"), "\n")
    whole = F.array_join(F.filter(F.transform(parts, _trim), lambda x: x != ""), "\n")
    return F.when((F.size(lines) == 1) & (F.length(F.get(lines, F.lit(0))) >= least), whole).otherwise(c)


def repair_text(c: Column) -> Column:
    """Half-width forms, no control characters, ideographs that stand alone for operators as these, TZO as TZ0; idempotent."""
    t = F.translate(half_width(c), "。、", ".,")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    t = F.replace(F.replace(t, F.lit("二二"), F.lit("==")), F.lit("三三"), F.lit("==="))
    # a neighbour is judged as it stood, so neighbours that are operators themselves protect each other
    for a, b in OPERATORS.items():
        t = F.regexp_replace(t, rf"(?<![一-鿿]){a}(?![一-鿿])", b)
    return F.regexp_replace(t, r"TZ[Oo](?!\d)", "TZ0")


def line_start(c: Column, strict: bool = True) -> Column:
    """The number that opens a line, with a body that is no number: strict asks for a capital, or a part letter and a word; a number alone counts."""
    pattern = r"^(\d{1,3})[.)]?\s+([\s\S]*)$"
    after = F.regexp_extract(c, pattern, 2)
    body = (_trim(after) != "") & ~F.regexp_like(after, F.lit(r"^[\d\s./]"))
    fits = body & F.regexp_like(after, F.lit(r"^(?:[A-Z\d]|[a-z]\s+[A-Za-z])")) if strict else body
    number = F.when(F.regexp_like(c, F.lit(pattern)), F.when(fits, F.regexp_extract(c, pattern, 1))).otherwise(F.nullif(F.regexp_extract(_trim(c), r"^(\d{1,3})$", 1), F.lit("")))
    return number.cast("int")


def glyph_start(c: Column) -> Column:
    """The digit that a glyph at the start of a line, before a word, was misread from."""
    return F.coalesce(*(F.when(F.regexp_like(c, F.lit(rf"^[{g}]\s+[A-Za-z]")), F.lit(n)) for g, n in DIGIT_GLYPHS.items()))
