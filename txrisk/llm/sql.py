"""DuckDB SQL for the queries of this package that SQL can express."""

from txrisk.llm import quality


def _shares(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def _texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _distance(counts: str, total: str, reference: str) -> str:
    """Jensen-Shannon distance of counts / total to a list of shares."""
    p, q = f"({counts}[i] / {total}::DOUBLE)", f"{reference}[i]"
    return (
        f"sqrt(greatest(list_sum(list_transform(range(1, len({reference}) + 1), lambda i: "
        f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0.0::DOUBLE END + "
        f"CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0.0::DOUBLE END)) / 2, 0.0::DOUBLE))"
    )


def op1() -> str:
    langs = list(quality.COMMON_WORDS)
    histograms, means = [], []
    for lang in langs:
        words = sorted(quality.COMMON_WORDS[lang])
        histograms.append(
            f"list_append([len(list_filter(common, lambda c: c = w)) FOR w IN {_texts(words)}], "
            f"n_tokens - len(list_filter(common, lambda c: list_contains({_texts(words)}, c)))) AS h_{lang}"
        )
        means.append(
            f"({_distance(f'h_{lang}', 'n_tokens', _shares(quality.word_reference(lang)))} + "
            f"{_distance('classes', 'n_chars', _shares(quality.CHARACTER_SHARES[lang]))}) / 2"
        )
    return rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
a AS (
  SELECT doc_id, r, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    list_filter(string_split_regex(lower(text), '{quality.BREAKS.replace("'", "''")}'), lambda x: x <> '') AS tokens
  FROM t),
windows AS (SELECT r, i, words[i : i + 4] AS win FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM a)),
repeats AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM repeats) GROUP BY r),
b AS (
  SELECT doc_id, r, len(words) AS n_words, length(text) AS n_chars,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(tokens) AS n_tokens,
    list_filter(tokens, lambda x: list_contains({_texts(quality.ALL_COMMON)}, x)) AS common,
    length(regexp_replace(text, '[^\p{{Ll}}]+', '', 'g')) AS low, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS up,
    length(regexp_replace(text, '[^\p{{Nd}}]+', '', 'g')) AS digits,
    length(regexp_replace(text, '[^.,;:!?''"()-]+', '', 'g')) AS marks
  FROM a),
c AS (
  SELECT *, [low, up, digits, n_chars - word_chars, marks, word_chars - low - up - digits - marks] AS classes,
    {", ".join(histograms)}
  FROM b),
d AS (
  SELECT *, CASE WHEN n_words >= {quality.MIN_WORDS} AND n_chars >= {quality.MIN_CHARS} AND n_tokens > 0
    THEN least({", ".join(means)}) END AS divergence
  FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words)
    AND (divergence IS NULL OR divergence <= {quality.LIMIT}) AS kept
FROM d LEFT JOIN covered USING (r)
"""


OP2 = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, r, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line
  FROM (SELECT doc_id, r, string_split(text, chr(10)) AS lines FROM t)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
shared AS (
  SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3),
marked AS (
  SELECT k.*, shared.key IS NOT NULL AND k.doc_id IS DISTINCT FROM largest AS lost FROM k LEFT JOIN shared USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY r
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, w[i : i + n - 1] AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, w[i : i + n - 1] AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT r, n, i, item_id FROM dw JOIN bw USING (n, win)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN items USING (r)
"""


# SHA-1 in base 32: five hex digits are twenty bits, which are four letters.
OP6 = r"""
WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top FROM t),
d AS (
  SELECT *, list_transform(range(0, 8), lambda k: list_reduce(list_transform(string_split(substr(hex, 5 * k + 1, 5), ''),
    lambda c: instr('0123456789abcdef', c) - 1), lambda a, b: 16 * a + b)) AS bits
  FROM g)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(bits, lambda v: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::BIGINT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM d
"""


OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)::INT AS failed
  FROM d LEFT JOIN l USING (doc_id)),
t AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
    coalesce(list_sum([1 << (ascii(substr(filter_order, i, 1)) - 65) FOR i IN range(1, step)]), 0)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER ((failed & (before | own)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((failed & before) = 0 AND (failed & own) <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((failed & before) <> 0 AND (failed & own) <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER ((failed & before) = 0 AND (failed & own) <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER ((failed & before) = 0 AND (failed & own) <> 0), 0)::BIGINT AS toxic_lost
  FROM s, t GROUP BY part, filter_order, step, own, before)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
  FROM documents),
c AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
         WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, text, len(u)::BIGINT AS n, form, array_to_string(u[1 : least(a, b)], '') AS prefix,
    array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1 :], '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": op1(),
        "op2_line_dedup": OP2,
        "op6_warc": OP6,
        "op10_benchmark_decontamination": OP10,
        "op11_filter_audit": OP11,
        "op12_fill_in_middle": OP12,
    }
