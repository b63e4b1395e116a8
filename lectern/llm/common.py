"""Helpers shared by the training-data operators.

Every operator reads its input through :func:`rows`, which takes the id and the
text column by name and nothing else. Extra columns, whatever they are called,
are therefore neither read nor returned, a null text counts as an empty one and
a row with a null id is kept.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
#: What stands between words: ASCII characters that are neither digits nor letters.
WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The fallback for a session that names no shared folder (tests).
_own_dir: list[str] = []
#: The tables written inside each open :func:`swept` block.
_swept: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """The id as ``doc_id`` and the whole text as ``text`` (null: empty), and ``more`` by name."""
    return df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), *(c.alias(n) for n, c in more.items()))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """Words in their own case, as an array; built in, so it stays inside generated code.

    Lowering A-Z changes no word's extent, so callers lower only the words they look at.
    """
    return F.array_remove(F.split(text, WORD_GAP, -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value evaluated once a row, wherever body repeats it.

    The optimizer may copy a projected expression into a lambda, where it would
    run once an element; a lambda's own variable can't be copied.
    """
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset the warehouse, or in local mode a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="lectern-"))
    return f"file://{_own_dir[0]}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    path = f"{shared_dir(df.sparkSession)}/lectern-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    for tables in _swept:
        tables.append(out)
    return out


def forget(df: DataFrame) -> None:
    """Remove the files that :func:`durable` wrote for ``df``."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def swept() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes what :func:`durable` writes inside the block, but for the tables handed to the function it yields."""
    tables, kept = [], []
    _swept.append(tables)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _swept.pop()
    for df in tables:
        if not any(df is k for k in kept):
            forget(df)


class Scratch:
    """:func:`durable` for the steps of one computation, whose tables are removed on leaving the block."""

    def __init__(self) -> None:
        self._tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        self._tables.append(durable(df, label))
        return self._tables[-1]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for df in self._tables:
            forget(df)


def cut_spans(text: Column, pattern: str, min_chars: int, kind: str, rank: int) -> Column:
    """Spans of all leftmost, non-overlapping matches of at least ``min_chars`` code points.

    Between two matches stands exactly one piece of the split text, so running
    sums over both arrays give the code-point offsets.
    """
    return spans_where(text, pattern, kind, rank, lambda m, _: F.length(m) >= min_chars)


def spans_where(text: Column, pattern: str, kind: str, rank: int, keep: Callable[[Column, Column], Column], group: int = 0) -> Column:
    """Like :func:`cut_spans`, for a predicate on (match, group ``group`` of the match)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def place(x: Column) -> Column:
        step = F.transform(x["m"], lambda m, i: F.struct(
            F.length(x["p"][i]).alias("gap"), F.length(m).alias("n"), keep(m, x["g"][i]).alias("ok")))
        def add(s: Column, y: Column) -> Column:
            begin = s["at"] + y["gap"]
            end = begin + y["n"]
            one = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(y["ok"], F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

        return folded(step, SPANS, add)["out"]

    none = F.array().cast(SPANS)
    both = F.struct(found.alias("m"), inner.alias("g"), F.split(text, pattern, -1).alias("p"))
    return F.when(F.regexp_like(text, F.lit(pattern)), let(both, place)).otherwise(none)


def folded(items: Column, out_type: str, add: Callable[[Column, Column], Column]) -> Column:
    """struct<at,out> after ``add`` has taken each item in turn; it returns the new ``at`` and the longer ``out``.

    Appending copies an array, so items are folded by blocks and the blocks' arrays joined once: n items cost n times
    a block's size, not n squared.
    """
    size = 256
    begin = lambda at: F.struct(at.alias("at"), F.array().cast(out_type).alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda b: F.slice(items, b * size + 1, F.lit(size)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{out_type}>").alias("parts"))

    def block(s: Column, b: Column) -> Column:
        return let(F.aggregate(b, begin(s["at"]), add), lambda r: F.struct(r["at"].alias("at"), F.concat(s["parts"], F.array(r["out"])).alias("parts")))

    whole = F.aggregate(blocks, start, block, lambda s: F.struct(s["at"].alias("at"), F.flatten(s["parts"]).alias("out")))
    return F.when(F.size(items) > 0, whole).otherwise(begin(F.lit(0).cast("long")))


def span_text(spans: Column) -> Column:
    """kind:start:end, by start, then kind as listed, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")
