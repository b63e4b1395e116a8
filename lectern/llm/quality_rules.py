"""Quality rules: a threshold table compiled into one projection.

:data:`RULES` names each measure with its least and greatest allowed value;
:func:`compile_rules` turns the table into a single Boolean column over the
measures of :func:`measures`. There is no user function, join or shuffle: a
document is judged inside the task that reads it.

Defined results: a null or empty text has no words and fails; repeated rows are
judged one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import let, rows

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# The commonest function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for on with as at by it was are be this from or an a "
    "le la les de des du et un une en que qui pour dans est sur par au pas "
    "der die das und den von zu mit ein eine ist nicht auf dem sich des "
    "el los las y que del se por con para una es no su al lo"
).split()
#: as they stand in a text: lower case, capitalised or all capitals
STOP_FORMS = sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())})
#: measure, least, greatest; None: no bound. Ratios are a share of words, of lines with a word or of characters in words.
RULES = (
    ("mean_word_chars", 1.5, 25.0),
    ("symbol_ratio", None, 0.2),
    ("dup_line_ratio", None, 0.5),
    ("stop_word_ratio", 0.01, None),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


#: Bits that hold a window's place in its key; the hash has the rest.
PLACE_BITS = 31


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that the text holds twice or more.

    Windows are sorted by hash, so equal ones come together and the cost is
    n log n whatever repeats. Hash and place share one long, which sorts as a
    primitive. Windows whose hashes agree are then sorted by their words, so
    what the hash does not tell apart the words do.
    """
    def places(ws: Column) -> Column:
        key = lambda i: F.shiftleft(F.xxhash64(ws[i], ws[i + 1], ws[i + 2]), PLACE_BITS).bitwiseOR(i.cast("long"))
        place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        alike = lambda g: neighbours(g, lambda x, y: F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS), place)
        return let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(ws) - 3), key)), alike)

    def neighbours(g: Column, same, place) -> Column:
        again = F.filter(F.sequence(F.lit(1), F.greatest(F.size(g) - 1, F.lit(1))), lambda k: F.coalesce(same(F.get(g, k), g[k - 1]), F.lit(False)))
        return F.array_distinct(F.flatten(F.transform(again, lambda k: F.array(place(g[k - 1]), place(g[k])))))

    def covered(ws: Column, at: Column) -> Column:
        said = F.transform(at, lambda i: F.struct(F.concat_ws(" ", ws[i], ws[i + 1], ws[i + 2]).alias("t"), i.alias("at")))
        twice = let(F.sort_array(said), lambda g: neighbours(g, lambda x, y: x["t"] == y["t"], lambda x: x["at"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

    def counted(ws: Column) -> Column:
        return let(places(ws), lambda at: F.when(F.size(at) > 0, covered(ws, at)).otherwise(0))

    return F.when(F.size(words) < 4, 0).otherwise(let(words, counted))


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of each document, as longs; one projection over the scan."""
    t = rows(df, id_col, text_col)
    text = F.col("text")
    words = F.array_remove(F.split(text, SPACE, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    t = t.select(
        "doc_id", words.alias("_words"), lines.alias("_lines"),
        (F.length(text) - F.length(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, text))).cast("long").alias("n_symbols"))
    return t.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), "n_symbols",
        F.size(F.filter("_words", lambda w: w.isin(STOP_FORMS))).cast("long").alias("n_stop_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )


def compile_rules(rules=RULES) -> Column:
    """True where every measure of the table is within its bounds."""
    share = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")
    value = {
        "mean_word_chars": share("word_chars", "n_words"), "symbol_ratio": share("n_symbols", "word_chars"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"), "stop_word_ratio": share("n_stop_words", "n_words"),
    }
    ok = F.lit(True)
    for name, low, high in rules:
        ok = ok & (value[name] >= low if low is not None else F.lit(True)) & (value[name] <= high if high is not None else F.lit(True))
    return ok


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every document."""
    m = measures(df, id_col, text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))
