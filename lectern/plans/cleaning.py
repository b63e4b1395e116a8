"""Cleaning of extracted papers and books as queries: whole texts of the driver's tables, set between samples of what extracts hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import cleaning, text
from lectern.operators import extraction
from lectern.plans.bindings import table
from lectern.plans.registry import registry

QUERIES, ORACLES, register = registry()


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _samples(values, key: str = "doc_id") -> str:
    return "[" + ", ".join(map(_sql, values)) + f"][{key} % {len(values)} + 1]"


def _sample(values, key: str = "doc_id"):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _md5(c):
    return F.md5(c.cast("binary"))


def _any(patterns, x: str = "y") -> str:
    return " OR ".join(f"regexp_matches({x}, {_sql(p)})" for p in patterns)


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_HEADS = ("Turn over\nN20/4/COMSC/HP2/ENG/TZ0/XX\n", "– 5 –\n\n\n\nnot be marked.\n", "(Question 3 continued)\nM12/4/PHYSI/HPM/ENG\n", "12EP07\n. . . . .\n©IBO 2019\n", "")


def _kept(patterns, s: str) -> str:
    """The lines of ``s`` that hold none of the patterns, in SQL."""
    return f"array_to_string(list_filter(string_split({s}, chr(10)), lambda x: NOT ({_any(patterns, _TRIM.format('x'))})), chr(10))"


_COLLAPSED = r"regexp_replace(regexp_replace({0}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@register(f"SELECT doc_id, md5({_COLLAPSED.format(_kept(text.FURNITURE, _samples(_HEADS) + ' || text'))}) AS cleaned FROM documents")
def clean_furniture(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _md5(text.clean_furniture(F.concat(_sample(_HEADS), "text"))).alias("cleaned"))


@register(f"SELECT doc_id, {', '.join(f'md5({_kept(p, _samples(_HEADS) + chr(32) + chr(124) * 2 + chr(32) + chr(116) + chr(101) + chr(120) + chr(116))}) AS {k}' for k, p in cleaning.NOISE.items())} FROM documents")
def noise_lines(spark, sf):
    s = F.concat(_sample(_HEADS), "text")
    return table(spark, sf, "documents").select("doc_id", *(_md5(cleaning.strip_noise(s, k)).alias(k) for k in cleaning.NOISE))


_INLINE = ("see – 7 – here", "2019–2020 turn over now", "Answer all questions. Computer Science Paper 2", "( Option B continued ) higher level", "plain")


def _artifacts_sql(s: str) -> str:
    for p in cleaning.ARTIFACTS:
        s = f"regexp_replace({s}, {_sql(p)}, ' ', 'g')"
    return s


@register(f"SELECT doc_id, md5({_TRIM.format(_artifacts_sql(_TRIM.format(_samples(_INLINE) + chr(32) + '||' + chr(32) + _sql(' ') + ' || text')))}) AS stripped FROM documents")
def page_artifacts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _md5(cleaning.strip_artifacts(F.concat(_sample(_INLINE), F.lit(" "), "text"))).alias("stripped"))


_TITLES = ("HL Paper 3\nFind x", "hl. ppr 2 p\n\n", "HLPaper1", "SL Paper 1 ", "  HL Papr 12p  text")


@register(rf"SELECT doc_id, md5({_TRIM.format('regexp_replace(' + _samples(_TITLES) + ' || text, ' + _sql(cleaning.TITLE_LEAD) + ', ' + _sql('') + ')')}) AS stripped FROM documents")
def title_lead(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _md5(cleaning.strip_title(F.concat(_sample(_TITLES), "text"))).alias("stripped"))


_HEADINGS = ("E Dxerc i se 1", "Review set 3A", "84 S y ll a b us rev i s i on", "12B Vectors", "Chapter  review 4.2", "The   calculus of things", "F u nct i ons 7", "Practice questions", "5C")
_KIND_SQL = " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{k}'" for p, k in cleaning.SECTION_KINDS)
_TOPIC_SQL = " ".join(f"WHEN contains(g, '{p}') THEN '{k}'" for p, k in cleaning.SECTION_TOPICS)


@register(rf"""WITH x AS (SELECT doc_id, {_samples(_HEADINGS)} AS h FROM documents UNION ALL SELECT doc_id + 1000000, left(text, 80) FROM documents),
y AS (SELECT doc_id, h, lower(regexp_replace(h, '[\s ]+', '', 'g')) AS n, list_transform(list_filter(regexp_split_to_array(h, '\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) AS t FROM x),
z AS (SELECT *, CASE WHEN len(t) >= 3 AND len(list_filter(t, lambda w: length(w) BETWEEN 1 AND 2)) >= 0.45 * len(t) THEN lower(regexp_replace(regexp_replace(array_to_string(t, ''), '^\d{{1,3}}', ''), '\d{{1,3}}$', '')) END AS g,
  CASE {_KIND_SQL} END AS kind, nullif(regexp_extract(h, '\d{{1,2}}(?:\.\d{{1,2}})?[A-Z]?'), '') AS num FROM y)
SELECT doc_id, CASE WHEN kind IS NOT NULL THEN concat_ws(' ', kind, num) WHEN (CASE {_TOPIC_SQL} END) IS NOT NULL THEN CASE {_TOPIC_SQL} END
 WHEN regexp_matches(h, '^\d{{1,2}}[A-Z]\b') THEN 'Section ' || regexp_extract(h, '^(\d{{1,2}}[A-Z])\b', 1) ELSE left(trim(regexp_replace(h, '\s+', ' ', 'g')), 70) END AS section FROM z""")
def section_names(spark, sf):
    d = table(spark, sf, "documents")
    h = d.select("doc_id", _sample(_HEADINGS).alias("h")).unionByName(d.select(F.col("doc_id") + 1000000, F.substring("text", 1, 80)).toDF("doc_id", "h"))
    return h.select("doc_id", cleaning.section_name(F.col("h")).alias("section"))


_SUFFIXES = ("1A", "1 b", "14", "28", "4", "8", "3", "104", "")


@register(rf"""WITH x AS (SELECT doc_id, upper(regexp_replace({_samples(_SUFFIXES)}, '\s+', '', 'g')) AS s FROM documents)
SELECT doc_id, 'Review set ' || CASE WHEN regexp_matches(s, '^[0-9]{{2,}}$') AND right(s, 1) IN ('4', '8') THEN left(s, length(s) - 1) || CASE right(s, 1) WHEN '4' THEN 'A' ELSE 'B' END ELSE s END AS label FROM x""")
def review_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cleaning.review_label(_sample(_SUFFIXES)).alias("label"))


@register("""WITH x AS (SELECT o_orderkey, (o_orderkey % 25) || 'M.' || (o_orderkey % 3) || '/' || o_orderpriority AS code FROM orders), b AS (SELECT o_orderkey, 'CS-' || regexp_replace(code, '[^A-Za-z0-9]', '-', 'g') AS base FROM x),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) - 1 AS k FROM b) SELECT o_orderkey, base || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS id FROM n""")
def slug_ids(spark, sf):
    code = F.concat(F.col("o_orderkey") % 25, F.lit("M."), F.col("o_orderkey") % 3, F.lit("/"), "o_orderpriority")
    return cleaning.disambiguated(table(spark, sf, "orders").select("o_orderkey", code.alias("code")), "code", "o_orderkey").select("o_orderkey", "id")


@register(r"""WITH c AS (SELECT conv_id, turn, role, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pl FROM conversations),
k AS (SELECT *, CASE WHEN regexp_matches(ch, '^\s$') THEN 1 WHEN regexp_matches(ch, '^[\p{L}\p{N}]$') THEN 2 ELSE 0 END AS k FROM c),
p AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY conv_id, turn, role ORDER BY pl), 1) AS b FROM k WHERE k > 0)
SELECT conv_id, turn, role, md5(string_agg(CASE WHEN k = 1 THEN ' ' ELSE lower(ch) END, '' ORDER BY pl)) AS hay, md5(string_agg(pl::VARCHAR, ',' ORDER BY pl)) AS places FROM p WHERE k = 2 OR b = 2 GROUP BY 1, 2, 3""")
def position_maps(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", cleaning.position_map(F.col("text")).alias("m")).where(F.size("m") > 0)
    return c.select("conv_id", "turn", "role", _md5(F.array_join(F.transform("m", lambda x: x["ch"]), "")).alias("hay"), _md5(F.array_join(F.transform("m", lambda x: x["at"].cast("string")), ",")).alias("places"))


_MATHS = ("a $x+1$ b ", "$$\\int x$$ then $y$ end", "cost $5 only ", "$a$$b$ ", "$$x$y$$ ")


@register(rf"""WITH x AS (SELECT doc_id, {_samples(_MATHS)} || replace(text, '$', '') AS s FROM documents), p AS (SELECT doc_id, regexp_split_to_array(s, '(?s)\$\$.+?\$\$|\$[^$\n]+?\$') AS t, regexp_extract_all(s, '(?s)\$\$.+?\$\$|\$[^$\n]+?\$') AS m FROM x),
e AS (SELECT doc_id, t, m, unnest(range(1, len(t) + 1)) AS i FROM p),
u AS (SELECT doc_id, 2 * i AS o, 'text' AS kind, t[i] AS body FROM e WHERE t[i] <> '' UNION ALL SELECT doc_id, 2 * i + 1, CASE WHEN starts_with(m[i], '$$') THEN 'display' ELSE 'inline' END, CASE WHEN starts_with(m[i], '$$') THEN substr(m[i], 3, length(m[i]) - 4) ELSE substr(m[i], 2, length(m[i]) - 2) END FROM e WHERE i <= len(m))
SELECT doc_id, string_agg(kind, ',' ORDER BY o) AS kinds, md5(string_agg(body, '|' ORDER BY o)) AS bodies FROM u GROUP BY 1""")
def math_split(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", cleaning.math_pieces(F.concat(_sample(_MATHS), F.replace("text", F.lit("$"), F.lit("")))).alias("p"))
    return p.select("doc_id", F.array_join(F.transform("p", lambda x: x["kind"]), ",").alias("kinds"), _md5(F.array_join(F.transform("p", lambda x: x["body"]), "|")).alias("bodies"))


_ANSWERS = ("x = 2 ✓ so y = 3 ✔ ", "no tick here", "✓", "one (cid:12) two (cid:3) three ")
_NOTES = ("Award M1 for x Award A1 for y", "first\nsecond\nthird", "notes", "", "Award only")


@register(rf"""WITH r AS (SELECT conv_id, turn, role, {_samples(_ANSWERS, 'turn')} || text AS a, {_samples(_NOTES, '(conv_id + turn)')} AS n, CASE WHEN turn % 3 = 0 THEN '[' || (turn + 1) || ' marks]' ELSE '' END AS t FROM conversations),
s AS (SELECT *, list_filter(list_transform(regexp_split_to_array(a, '[✓✔]|\(cid:\d+\)'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS st,
  CASE WHEN contains(n, 'Award') THEN list_filter(list_transform(string_split(regexp_replace(n, 'Award\s', chr(1) || 'Award ', 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') ELSE [] END AS aw,
  list_filter(list_transform(string_split(n, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS nl FROM r),
u AS (SELECT *, CASE WHEN len(st) > 0 THEN st ELSE [trim(regexp_replace(a, '\s+', ' ', 'g'))] END AS steps, CASE WHEN len(aw) >= 2 THEN aw ELSE nl END AS ns FROM s),
v AS (SELECT *, CASE WHEN len(ns) = len(steps) THEN ns ELSE list_filter([trim(regexp_replace(n, '\s+', ' ', 'g'))], lambda x: x <> '') END AS al FROM u),
l AS (SELECT conv_id, turn, role, t, array_to_string(list_transform(range(1, len(steps) + 1), lambda i: '• ' || steps[i] || CASE WHEN al[i] IS NOT NULL AND lower(al[i]) <> 'notes' THEN '   [' || al[i] || ']' ELSE '' END), chr(10)) AS b FROM v)
SELECT conv_id, md5(string_agg(b, chr(10) ORDER BY turn, role) || CASE WHEN sum(coalesce(nullif(regexp_replace(t, '\D', '', 'g'), '')::INT, 0)) > 0 THEN chr(10) || '[Total: ' || sum(coalesce(nullif(regexp_replace(t, '\D', '', 'g'), '')::INT, 0)) || ' marks]' ELSE '' END) AS answer FROM l GROUP BY 1""")
def answer_rebuild(spark, sf):
    k = F.col("turn")
    note = F.element_at(F.array(*map(F.lit, _NOTES)), ((F.col("conv_id") + k) % len(_NOTES) + 1).cast("int"))
    row = F.struct(k, "role", F.concat(_sample(_ANSWERS, "turn"), "text").alias("answer"), note.alias("notes"), F.when(k % 3 == 0, F.concat(F.lit("["), k + 1, F.lit(" marks]"))).otherwise("").alias("total"))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return g.select("conv_id", _md5(cleaning.rebuilt_answer(F.col("rows"))).alias("answer"))


_MARKED = ("find x [3 marks]\nshow it [2]\n", "NAMES [0] [1] [2]\nso [4] \n", "Maximum mark: 12 [1]\n", "[5 Marks] and [2 mark]\n", "none\n")


@register(rf"""WITH x AS (SELECT doc_id, {_samples(_MARKED)} || text AS s FROM documents), l AS (SELECT doc_id, s, unnest(string_split(s, chr(10))) AS line FROM x),
m AS (SELECT doc_id, CASE WHEN len(regexp_extract_all(line, '(?i)\[(\d+)\s*marks?\]')) > 0 THEN list_sum(list_transform(regexp_extract_all(line, '(?i)\[(\d+)\s*marks?\]', 1), lambda x: x::BIGINT))
  WHEN len(regexp_extract_all(line, '\[\d{{1,2}}\]')) = 1 AND regexp_matches(line, '\[\d{{1,2}}\]\s*$') THEN regexp_extract(line, '\[(\d{{1,2}})\]\s*$', 1)::BIGINT ELSE 0 END AS n FROM l)
SELECT m.doc_id, sum(n)::BIGINT AS by_line, any_value(nullif(coalesce(list_sum(list_transform(regexp_extract_all(s, '\[(\d+)\]', 1), lambda x: x::BIGINT)), 0) + coalesce(list_sum(list_transform(regexp_extract_all(s, '[Mm]aximum\s*mark[:\s]*(\d+)', 1), lambda x: x::BIGINT)), 0), 0))::BIGINT AS or_maximum
FROM m JOIN x ON x.doc_id = m.doc_id GROUP BY 1""")
def marks_dialects(spark, sf):
    s = F.concat(_sample(_MARKED), "text")
    return table(spark, sf, "documents").select("doc_id", cleaning.marks_by_line(s).alias("by_line"), cleaning.marks_or_maximum(s).alias("or_maximum"))


_INDEXED = ("state two [2]\n[3]\nrest", "NAMES_A [4]\nFigure [5]\nok [6]", "[1]\n[2]\n[3]\nx [4]", "a[7]\nb [8] c\nd [9]", "see [1] and [2]\nlast [10 marks]")


@register(rf"""WITH x AS (SELECT doc_id, string_split({_samples(_INDEXED)} || chr(10) || text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM x),
f AS (SELECT *, len(regexp_extract_all(line, '\[\s*\d+\s*(?:marks|mark)?\s*\]')) = 1 AS one, regexp_matches(line, '^\s*\[\s*\d+\s*(?:marks|mark)?\s*\]\s*$') AS pure, regexp_extract(line, '^(.*?)\[\s*\d+\s*(?:marks|mark)?\s*\]', 1) AS pre FROM e),
g AS (SELECT *, regexp_extract(pre, '(\S+)\s*$', 1) AS w, coalesce(lag(one AND pure) OVER v, false) OR coalesce(lead(one AND pure) OVER v, false) AS beside FROM f WINDOW v AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, coalesce(sum(try_cast(regexp_extract(line, '\[\s*(\d+)\s*(?:marks|mark)?\s*\]', 1) AS BIGINT)) FILTER (one AND regexp_matches(line, '\[\s*\d+\s*(?:marks|mark)?\s*\]\s*$') AND NOT regexp_matches(pre, '[\p{{L}}\p{{N}}]$') AND lower(w) NOT IN ('figure', 'fig')
 AND NOT (contains(w, '_') AND upper(w) = w AND regexp_matches(w, '[A-Z]')) AND NOT (pure AND beside)), 0)::BIGINT AS marks FROM g GROUP BY 1""")
def marks_beside(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cleaning.marks_among_lines(F.concat(_sample(_INDEXED), F.lit("\n"), "text")).alias("marks"))


_KEYS = ("1. A 2. B 3. C 4. D 5. A 2. C", "1. A 2 B 3 C 1 D", "(12. B) 3 . A 7 D", "nothing 99", "1. A 1. B 1. C 2. D 3. A 4. B 5. C")


@register(rf"""WITH x AS (SELECT doc_id, {_samples(_KEYS)} || ' ' || text AS s FROM documents),
m AS (SELECT doc_id, regexp_extract_all(s, '(?:^|[\s(])(\d{{1,2}})\s*\.\s*([A-D])\b', 1) AS n, regexp_extract_all(s, '(?:^|[\s(])(\d{{1,2}})\s*\.\s*([A-D])\b', 2) AS x, regexp_extract_all(s, '(?:^|[\s(])(\d{{1,2}})\s+([A-D])\b', 1) AS n2, regexp_extract_all(s, '(?:^|[\s(])(\d{{1,2}})\s+([A-D])\b', 2) AS x2 FROM x),
e AS (SELECT doc_id, CASE WHEN len(list_distinct(list_transform(n, lambda y: y::INT))) >= 5 THEN n ELSE n || n2 END AS n, CASE WHEN len(list_distinct(list_transform(n, lambda y: y::INT))) >= 5 THEN x ELSE x || x2 END AS x FROM m),
u AS (SELECT doc_id, unnest(range(1, len(n) + 1)) AS i, n, x FROM e), f AS (SELECT doc_id, n[i]::INT AS k, arg_max(x[i], i) AS v FROM u GROUP BY 1, 2)
SELECT d.doc_id, coalesce(string_agg(k || ':' || v, ',' ORDER BY k), '') AS key FROM documents d LEFT JOIN f USING (doc_id) GROUP BY 1""")
def answer_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cleaning.answer_key(F.concat(_sample(_KEYS), F.lit(" "), "text")).alias("key"))


_OPENINGS = ("1. [Maximum mark: 5]\nHence find x", "Write down the area.\nFind", "  State two", "Hence or otherwise show", "Given that 3", "12. [Maximum mark: 7] Solve for", "The ")
_OPEN_SQL = " ".join(f"WHEN starts_with(l, '{t}') OR starts_with(b, '{t}') THEN '{t}'" for t in cleaning.OPENING_TERMS)


@register(rf"""WITH x AS (SELECT doc_id, {_samples(_OPENINGS)} || ' ' || text AS s FROM documents), y AS (SELECT doc_id, CASE WHEN regexp_matches(s, '^\s*\d+\.\s*\[Maximum mark: \d+\]') THEN regexp_extract(s, '(?s)^\s*\d+\.\s*\[Maximum mark: \d+\]\s*\n?(.*)', 1) ELSE s END AS b FROM x),
z AS (SELECT doc_id, b, string_split({_TRIM.format('b')}, chr(10))[1] AS l FROM y) SELECT doc_id, CASE {_OPEN_SQL} END AS term FROM z""")
def opening_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cleaning.opening_term(F.concat(_sample(_OPENINGS), F.lit(" "), "text")).alias("term"))


_OPTIONS = ("Which?\nA. one\nB. two\nC. three\nD. four\n", "A. 3\nB. 4\n", "  B. only\nx\n", "stem with A. inside ", "C. x\nD. y\n")


@register(rf"""WITH x AS (SELECT doc_id, {_samples(_OPTIONS)} || text AS s FROM documents), y AS (SELECT doc_id, s, regexp_extract_all(s, '(?m)^([A-D])\.\s*', 1) AS l FROM x)
SELECT doc_id, len(regexp_extract_all(s, '(?m)^\s*[A-D]\.\s')) >= 3 AS has, regexp_matches(s, '^\s*[A-D]\.\s') AS starts, nullif(regexp_extract(s, '^\s*([A-D])\.', 1), '') AS first, l[-1] AS last FROM y""")
def option_predicates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cleaning.option_state(F.concat(_sample(_OPTIONS), "text")).alias("o")).select("doc_id", "o.*")


_STARTS = ("This question is about waves. ", "Markscheme\nThe graph", "(a) Find x ", "\n\nCalculate y ", "zz\nyy\nxx\nThe diagram ", "[N/A]")


@register(rf"""WITH x AS (SELECT doc_id, {_TRIM.format(_samples(_STARTS) + ' || text')} AS t FROM documents)
SELECT doc_id, t <> '' AND NOT regexp_matches(t, {_sql(cleaning.CONTINUATION)}) AND regexp_matches(array_to_string(string_split(t, chr(10))[1:3], chr(10)), {_sql(cleaning.PROMPT_ANCHOR)}) AS opens FROM x""")
def prompt_starts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cleaning.opens_prompt(F.concat(_sample(_STARTS), "text")).alias("opens"))


_REGIONS = ("so [3marks] ", "« yes » ", "please Award it ", "[NA] ", "[n/a] ", "awarded ")


@register(f"SELECT doc_id, regexp_matches({_samples(_REGIONS)} || text, {_sql(extraction.ANSWER_SIGNS)}) AS has_answer, regexp_matches({_samples(_REGIONS)}, {_sql(extraction.ANSWER_SIGNS)}) AS sample FROM documents")
def region_answers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", extraction.region_has_answer(F.concat(_sample(_REGIONS), "text")).alias("has_answer"), extraction.region_has_answer(_sample(_REGIONS)).alias("sample"))


_BREAKS = ("Let x be (a) odd and (b) even ", "so (i) this then (ii) that  \n\n\n\nend ", "x ✓ y ✔ done ", "value M1 then A1 hence OR other ", "see Note: this METHOD 2 ok ")


def _before(s: str, p: str) -> str:
    return f"regexp_replace({s}, '\\s+({p})', chr(10) || '\\1', 'g')"


_Q = lambda s: _COLLAPSED.format(r"regexp_replace(" + _before(_before(s, r"\([a-f]\)\s"), r"\([ivx]{1,3}\)\s") + r", '[ \t]+\n', chr(10), 'g')")
_A = lambda s: _Q(_before(_before(f"regexp_replace({s}, '[✓✔]', chr(10), 'g')", r"(?:\(?(?:[MAR]\d+|N\d+)\)?|AG|FT|OWTTE)\b"), r"(?:EITHER|OR|Note:|METHOD\s+\d+|Hence|Award\s|Do not allow)\b"))


@register(f"SELECT doc_id, md5({_Q(_samples(_BREAKS) + ' || text')}) AS question, md5({_A(_samples(_BREAKS) + ' || text')}) AS answer FROM documents")
def inline_breaks(spark, sf):
    s = F.concat(_sample(_BREAKS), "text")
    return table(spark, sf, "documents").select("doc_id", _md5(cleaning.format_question(s)).alias("question"), _md5(cleaning.format_answer(s)).alias("answer"))


_CJK = ("Ａ（１）＋二Ｂ　。", "x 二 y 三 z", "中二文 十 1", "a二二b 三三 c", "TZO TZo1 TZO2\x07", "一")


@register(rf"""WITH t AS (SELECT doc_id, replace(replace(regexp_replace(translate({_samples(_CJK)} || text, '{''.join(chr(0xFF01 + k) for k in range(94))}　。、', '{(''.join(chr(0x21 + k) for k in range(94)) + ' .,').replace("'", "''")}'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '二二', '=='), '三三', '===') AS s FROM documents),
c AS (SELECT doc_id, unnest(string_split(s, '')) AS ch, generate_subscripts(string_split(s, ''), 1) AS i FROM t), n AS (SELECT *, coalesce(lag(ch) OVER w, '') AS a, coalesce(lead(ch) OVER w, '') AS b FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
o AS (SELECT doc_id, string_agg(CASE WHEN a BETWEEN '一' AND '鿿' OR b BETWEEN '一' AND '鿿' THEN ch WHEN ch = '二' THEN '=' WHEN ch = '三' THEN '≡' WHEN ch = '十' THEN '+' WHEN ch = '一' THEN '-' ELSE ch END, '' ORDER BY i) AS s FROM n GROUP BY 1)
SELECT doc_id, md5(regexp_replace(s, 'TZ[Oo]([^0-9]|$)', 'TZ0\1', 'g')) AS repaired FROM o""")
def text_repair(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _md5(cleaning.repair_text(F.concat(_sample(_CJK), "text"))).alias("repaired"))


_LINES = ("12. Find x", "3) a Draw it", "1 x = 2", "7", "0 1 2 3", "5 b Find", " 9 ", "123.4 m", "& Find x", "? why", "4. ")


@register(rf"""WITH x AS (SELECT doc_id, {_samples(_LINES)} AS s FROM documents UNION ALL SELECT doc_id + 1000000, string_split(text, chr(10))[1] FROM documents), y AS (SELECT *, regexp_matches(s, '^\d{{1,3}}[.)]?\s+') AS m, regexp_extract(s, '(?s)^\d{{1,3}}[.)]?\s+(.*)$', 1) AS a, regexp_extract(s, '^(\d{{1,3}})[.)]?\s+', 1) AS n FROM x)
SELECT doc_id, CASE WHEN m THEN CASE WHEN trim(a) <> '' AND NOT regexp_matches(a, '^[\d\s./]') AND regexp_matches(a, '^(?:[A-Z\d]|[a-z]\s+[A-Za-z])') THEN n::INT END ELSE nullif(regexp_extract(trim(s), '^(\d{{1,3}})$', 1), '')::INT END AS strict,
 CASE WHEN m THEN CASE WHEN trim(a) <> '' AND NOT regexp_matches(a, '^[\d\s./]') THEN n::INT END ELSE nullif(regexp_extract(trim(s), '^(\d{{1,3}})$', 1), '')::INT END AS relaxed, CASE WHEN regexp_matches(s, '^&\s+[A-Za-z]') THEN 4 WHEN regexp_matches(s, '^\?\s+[A-Za-z]') THEN 7 END AS glyph FROM y""")
def line_starts(spark, sf):
    d = table(spark, sf, "documents")
    s = d.select("doc_id", _sample(_LINES).alias("s")).unionByName(d.select(F.col("doc_id") + 1000000, F.substring_index("text", "\n", 1)).toDF("doc_id", "s"))
    return s.select("doc_id", cleaning.line_start(F.col("s")).alias("strict"), cleaning.line_start(F.col("s"), False).alias("relaxed"), cleaning.glyph_start(F.col("s")).alias("glyph"))


@register()
def paragraph_split(spark, sf):
    # one line of each text: line breaks become spaces
    s = F.concat(F.lit("Dr. No is here. Find x [3] and so. Explain why [2] (Question 4 continued) "), F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf, "documents").select("doc_id", _md5(cleaning.split_paragraph(s)).alias("split"))


_PATHS = (" figures/a.png, /b.png ,,https://x.org/c.png", "", "/figures/d.png", " , ", "e.png,f.png")
_SESSIONS = ("May 2019", "2019 may TZ1", "x M19 y", "nov_2020 november", "N07", "june 2011")
_TAGS = ("22M.1.HL.tz", "a.b", "x", "q.ms")


@register(rf"""WITH x AS (SELECT doc_id, {_samples(_PATHS)} AS p, {_samples(_SESSIONS)} AS s, {_samples(_TAGS)} AS t FROM documents)
SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(p, ','), lambda y: trim(y)), lambda y: y <> ''), lambda y: CASE WHEN starts_with(y, 'http') THEN y ELSE regexp_replace(y, '^/?(figures/)?', '') END), '|') AS images,
 CASE WHEN regexp_extract(s, '(?i)(may|november|specimen)', 1) <> '' AND regexp_extract(s, '20\d\d') <> '' THEN upper(left(regexp_extract(s, '(?i)(may|november|specimen)', 1), 1)) || lower(substr(regexp_extract(s, '(?i)(may|november|specimen)', 1), 2)) || ' ' || regexp_extract(s, '20\d\d')
  WHEN regexp_extract(s, '\b(M|N)\d\d\b') <> '' THEN CASE regexp_extract(s, '\b(M|N)\d\d\b', 1) WHEN 'M' THEN 'May' ELSE 'November' END || ' 20' || regexp_extract(s, '\b(M|N)(\d\d)\b', 2) END AS session,
 CASE string_split(t, '.')[-1] WHEN 'tz' THEN 'time zone' WHEN 'ms' THEN 'markscheme' END AS tag FROM x""")
def path_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.split_images(_sample(_PATHS)), "|").alias("images"), text.session_label(_sample(_SESSIONS)).alias("session"), text.tail_tag(_sample(_TAGS), {"tz": "time zone", "ms": "markscheme"}).alias("tag"))


_STEMS = ("A net force  acts.\nA. one\nB. two\n", "Find it [3 marks] now\n", "Plain ")


@register(rf"""WITH x AS (SELECT doc_id, {_samples(_STEMS)} || text AS s FROM documents) SELECT doc_id, left(lower(trim(regexp_replace(regexp_split_to_array(s, '(?m)^\s*A[.)]\s|\[\d+(?: marks?)?\]')[1], '\s+', ' ', 'g'))), 90) AS needle,
 len(list_filter(string_split(regexp_replace(s || chr(10) || '(a) x' || chr(10) || '(a) y', '(?m)^(\s*\(a\))', chr(1) || '\1', 'g'), chr(1)), lambda y: trim(y) <> ''))::INT AS pieces FROM x""")
def stem_needles(spark, sf):
    s = F.concat(_sample(_STEMS), "text")
    return table(spark, sf, "documents").select("doc_id", text.stem_needle(s).alias("needle"), F.size(text.split_at_parts(F.concat(s, F.lit("\n(a) x\n(a) y")))).alias("pieces"))


_SPELT = ("T o p i c 12", "A B C", "Topic here 3", "x y zz w 4", "")
_VALUES = ("A.\n12 m\nB.\n(b)\n", "A)\nB)\n4\n", "x [N/A]\n[N/A]\n•\n", "C.\nlong words here\n")


@register(rf"""WITH x AS (SELECT doc_id, {_samples(_SPELT)} AS s, {_samples(_VALUES)} || text AS v FROM documents), y AS (SELECT *, list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '') AS t FROM x)
SELECT doc_id, CASE WHEN len(t) >= 3 AND len(list_filter(t, lambda w: length(w) = 1)) >= 0.45 * len(t) THEN regexp_replace(array_to_string(t, ''), '\d+$', '') ELSE trim(s) END AS joined,
 md5(array_to_string(list_filter(string_split(v, chr(10)), lambda l: NOT regexp_matches(l, '^\s*\[N/A\]\s*$') AND NOT regexp_matches(l, '^\s*[•▪–-]\s*$')), chr(10))) AS kept FROM y""")
def spelt_and_empty(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.degarble(_sample(_SPELT)).alias("joined"), _md5(text.drop_empty_answers(F.concat(_sample(_VALUES), "text"))).alias("kept"))


@register(rf"""WITH x AS (SELECT doc_id, {_samples(_VALUES)} || text AS v FROM documents), l AS (SELECT doc_id, string_split(v, chr(10)) AS ls FROM x), e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
n AS (SELECT *, lead(line) OVER w AS nxt, lag(line) OVER w AS prv FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, regexp_matches(line, '^[A-D][.)][ \t]*$') AND nxt IS NOT NULL AND regexp_matches(nxt, '^[^\nA-Za-z]{{1,15}}$') AND NOT regexp_matches(nxt, '^(\(|[A-D][.)])') AS takes FROM n), g AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY i), false) AS taken FROM f)
SELECT doc_id, md5(string_agg(CASE WHEN takes THEN regexp_replace(line, '[ \t]+$', '') || ' ' || nxt ELSE line END, chr(10) ORDER BY i) FILTER (NOT taken)) AS joined FROM g GROUP BY 1""")
def option_values(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _md5(text.join_option_values(F.concat(_sample(_VALUES), "text"))).alias("joined"))


_COVERS = ("Topic one 7", "12", "Please do not write on this page ", "")


@register(rf"""WITH x AS (SELECT page_id, {_samples(_COVERS, 'page_id')} || CASE WHEN page_id % 3 = 0 THEN html ELSE '' END AS s FROM pages)
SELECT page_id, regexp_matches(s, '\d') AND length(regexp_replace(regexp_replace(s, '(?i)^\s*(topic|paper|section)\s+\w+', ''), '[^A-Za-z0-9]', '', 'g')) < 3 AS cover, contains(s, '{extraction.SPACER_PHRASE}') AND length(s) < {extraction.SPACER_CHARS} AS spacer FROM x""")
def page_kinds(spark, sf):
    s = F.concat(_sample(_COVERS, "page_id"), F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(""))
    return table(spark, sf, "pages").select("page_id", extraction.is_cover(s).alias("cover"), extraction.is_spacer(s).alias("spacer"))
