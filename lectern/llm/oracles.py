"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from lectern.llm import decontamination, license_scan, pii, quality_rules, secret_scan, warc

WORDS = r"""
words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents)"""


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_quote(x) for x in xs) + "]"


def license_sql() -> str:
    templates = []
    for k, t in enumerate(license_scan.TEMPLATES):
        first, n = t.key_span
        templates.append(f"({k}, {_quote(t.label)}, {_list(t.words)}, {first}, {_list(t.words[first:first + n])}, {n}, {str(t.base).lower()})")
    return f"""
WITH {WORDS},
t(k, label, tw, first, phrase, n, base) AS (VALUES {', '.join(templates)}),
place AS (SELECT rid, ws, unnest(range(len(ws))) AS p FROM words),
found AS (
  SELECT rid, label, base, p AS start,
         list_sum(list_transform(range(len(tw)), lambda i: CASE WHEN p - first + i >= 0 AND ws[p - first + i + 1] = tw[i + 1] THEN 1 ELSE 0 END))::DOUBLE / len(tw) AS support
  FROM place JOIN t ON ws[p + 1] = phrase[1] AND ws[p + 1 : p + n] = phrase),
hit AS (SELECT * FROM found WHERE support >= {license_scan.MIN_SUPPORT}),
a AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         list_sort(list_distinct(list(label) FILTER (base))) AS bl, list_sort(list_distinct(list(label))) AS al, max(support) AS score
  FROM hit GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(al, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN a USING (rid)
"""


def quality_sql() -> str:
    bounds = []
    ratio = {
        "mean_word_chars": "word_chars::DOUBLE / greatest(n_words, 1)", "symbol_ratio": "n_symbols::DOUBLE / greatest(word_chars, 1)",
        "dup_line_ratio": "n_dup_lines::DOUBLE / greatest(n_lines, 1)", "stop_word_ratio": "n_stop_words::DOUBLE / greatest(n_words, 1)",
    }
    for name, low, high in quality_rules.RULES:
        bounds += [f"{ratio[name]} >= {low}"] if low is not None else []
        bounds += [f"{ratio[name]} <= {high}"] if high is not None else []
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
g AS (SELECT rid, unnest(range(len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= 3),
g2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i + 1], ws[i + 2], ws[i + 3]) AS c FROM g),
r AS (SELECT rid, count(DISTINCT i + j) AS n FROM g2, (VALUES (0), (1), (2)) v(j) WHERE c >= 2 GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(list_filter(ws, lambda x: list_contains({_list(quality_rules.STOP_FORMS)}, x)))::BIGINT AS n_stop_words,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {' AND '.join(bounds)} AS kept FROM f
"""


def secret_sql() -> str:
    rules = secret_scan.RULES
    found = ",\n".join(
        f"""list_transform(range(len(m{k})), lambda i: {{'s': list_sum(list_transform(p{k}[1 : i + 1], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m{k}[1 : i], lambda x: length(x))), 0)::BIGINT,
         'k': {k}, 'n': '{r.kind}', 'l': length(m{k}[i + 1])::BIGINT, 'ok': length(g{k}[i + 1]) >= {r.min_chars}}})"""
        for k, r in enumerate(rules))
    cut = ", ".join(f"regexp_extract_all(t, {_quote(r.pattern)}) AS m{k}, regexp_extract_all(t, {_quote(r.pattern)}, {r.group}) AS g{k}, regexp_split_to_array(t, {_quote(r.pattern)}) AS p{k}" for k, r in enumerate(rules))
    base = [r.kind for r in rules if r.base]
    text = "array_to_string(list_transform({0}, lambda x: x.n || ':' || x.s || ':' || (x.s + x.l)), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, {cut} FROM d),
s AS (SELECT doc_id, list_sort(list_filter(flatten([{found}]), lambda x: x.ok)) AS sp FROM c),
b AS (SELECT doc_id, sp, list_filter(sp, lambda x: list_contains({_list(base)}, x.n)) AS bs FROM s)
SELECT doc_id, {', '.join(f"len(list_filter(bs, lambda x: x.n = '{k}'))::BIGINT AS n_{k}" for k in base)},
       sha256({text.format('bs')}) AS base_sha256, {text.format('sp')} AS spans
FROM b
"""


def pii_sql() -> str:
    email, ip = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr({digits}, length({digits}) - i + 1, 1)::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr({digits}, length({digits}) - i + 1, 1)::INT + 1] END)) % 10 = 0"
    forms = (("email", email, "true"), ("ip", ip, "list_bool_and(list_transform(string_split(m, '.'), lambda x: coalesce(try_cast(x AS HUGEINT) <= 255, false)))"),
             ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 12 AND 19 AND {luhn}"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"))

    def found(kind: str, k: int, pattern: str, source: str) -> str:
        place = "list_sum(list_transform(p[1 : i + 1], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(a[1 : i], lambda x: length(x))), 0)::BIGINT"
        return (f"SELECT rid, {k} AS k, '{kind}' AS kind, {place} AS s, a[i + 1] AS m FROM (SELECT rid, a, p, unnest(range(len(a))) AS i FROM "
                f"(SELECT rid, regexp_extract_all(t, {_quote(pattern)}) AS a, regexp_split_to_array(t, {_quote(pattern)}) AS p FROM {source}))")

    base = " UNION ALL ".join(f"SELECT rid, k, kind, s, s + length(m) AS e, m FROM ({found(kind, k, pattern, 'd')}) WHERE {ok}" for k, (kind, pattern, ok) in enumerate(forms))
    text = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '')"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM d),
b AS MATERIALIZED ({base}),
held AS (SELECT DISTINCT rid, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN regexp_replace(m, '[^0-9]', '', 'g') ELSE lower(m) END AS entity FROM b),
ne AS (SELECT entity, count(*) AS n_e FROM held GROUP BY 1 HAVING count(*) >= {pii.MIN_SUPPORT} AND count(*) < (SELECT n FROM n)),
w AS MATERIALIZED (SELECT DISTINCT rid, lower(w) AS term FROM (SELECT rid, unnest(regexp_split_to_array(t, {_quote(pii.TERM_GAP)})) AS w FROM d) WHERE length(w) >= 3),
nt AS (SELECT term, count(*) AS n_t FROM w GROUP BY 1),
p AS MATERIALIZED (SELECT held.rid, entity, n_e, term, n_t FROM held JOIN ne USING (entity) JOIN w USING (rid) JOIN nt USING (term)),
et AS (SELECT entity, term, count(*) AS n_et, any_value(n_e) AS n_e, any_value(n_t) AS n_t FROM p GROUP BY 1, 2 HAVING count(*) >= {pii.MIN_SUPPORT}),
sc AS (SELECT entity, term, (log2(n) + log2(n_et) - log2(n_e) - log2(n_t)) / (log2(n) - log2(n_e)) AS x FROM et, n),
fl AS (SELECT rid, term, max(x) AS x FROM p JOIN sc USING (entity, term) WHERE x >= {pii.GENERALISE_AT} GROUP BY 1, 2),
pl AS ({found("", 0, pii.TERM, "(SELECT * FROM d WHERE rid IN (SELECT rid FROM fl))")}),
mo AS (SELECT pl.rid, CASE WHEN x >= {pii.REMOVE_AT} THEN 4 ELSE 5 END AS k, CASE WHEN x >= {pii.REMOVE_AT} THEN 'remove' ELSE 'generalise' END AS kind, s, s + length(m) AS e FROM pl JOIN fl ON fl.rid = pl.rid AND fl.term = lower(m)
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rid = pl.rid AND b.s < pl.s + length(pl.m) AND pl.s < b.e)),
x AS (SELECT rid, k, kind, s, e FROM b UNION ALL SELECT rid, k, kind, s, e FROM mo),
g AS (SELECT rid, {text} AS spans, {text.replace(" ORDER BY s, k)", " ORDER BY s, k) FILTER (k < 4)")} AS bs, {', '.join(f"count(*) FILTER (k = {k})::BIGINT AS n_{kind}" for k, (kind, _, _) in enumerate(forms))} FROM x GROUP BY 1)
SELECT doc_id, {', '.join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind, _, _ in forms)}, sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""


def decontamination_sql() -> str:
    n = decontamination.WINDOW
    return rf"""
WITH {WORDS},
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS bw FROM benchmark),
i AS (SELECT item_id, bw, least(len(bw), {n}) AS m, unnest(range(greatest(len(bw) - {n} + 1, 1))) AS p FROM b WHERE len(bw) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(bw[p + 1 : p + m], ' ') AS g FROM i),
d AS (SELECT rid, ws, unnest(range(len(ws))) AS p FROM words),
dw AS (SELECT rid, p, m, array_to_string(ws[p + 1 : p + m], ' ') AS g FROM d, (SELECT DISTINCT m FROM win) WHERE p + m <= len(ws)),
hit AS (SELECT rid, p, m, item_id FROM dw JOIN win USING (m, g)),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM hit) GROUP BY rid),
t AS (SELECT rid, list_sort(list_distinct(list(item_id::VARCHAR))) AS its FROM hit GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(its), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(its, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {decontamination.SHARE} * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM words LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""


def warc_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM q WHERE n >= {warc.REVISIT_BYTES} GROUP BY h)
SELECT page_id, n AS payload_bytes, q.h AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM q LEFT JOIN f ON q.h = f.h AND n >= {warc.REVISIT_BYTES}
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_sql(), "op2_secret_scan": secret_sql(), "op3_warc": warc_sql(), "op6_quality_rules": quality_sql(), "op9_pii": pii_sql(), "op10_decontamination": decontamination_sql()}
