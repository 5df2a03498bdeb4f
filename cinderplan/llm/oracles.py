"""SQL of the corpus operators that SQL can express, for DuckDB; plain statements of the results, not of the methods."""

from __future__ import annotations

from cinderplan.llm import license_scan, mixing, quality_rules
from cinderplan.llm.registry import HOSTILE

WORD = r"[^\x20\x09-\x0D]+"
WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"


def jaccard() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 9 * i >= 4 * (p.n + q.n)),
 reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce(c.m, d.doc_id)) AS class_id, coalesce(k.n, 0) AS n_links FROM documents d
 LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = d.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = d.doc_id"""


def rules() -> str:
    plain = quality_rules.PLAIN.replace("'", "''")
    for code, char in (("\\u201c", "“"), ("\\u201e", "„"), ("\\u00ab", "«"), ("\\u00bf", "¿"), ("\\u00a1", "¡"), ("\\u2019", "’"), ("\\u201d", "”"), ("\\u00bb", "»")):
        plain = plain.replace(code, char)
    count = lambda keep: f"length(regexp_replace(t, '[^{keep}]+', '', 'g'))"
    kinds = quality_rules.KINDS
    digit = [f"(votes // {3**j}) % 3" for j in range(len(kinds))]
    guess = lambda which: "[" + ", ".join(f"{k[which][v]!r}::DOUBLE" for k in kinds for v in range(3)) + "]"
    logit = "ln(prior / (1 - prior))" + "".join(f" + ln(good[{3 * j + 1} + {digit[j]}] / bad[{3 * j + 1} + {digit[j]}])" for j in range(len(kinds)))
    q = f"1 / (1 + exp(-({logit})))"

    def shares(of: str, which: int) -> str:
        return "[" + ", ".join(f"(coalesce(sum({of}) FILTER (WHERE {digit[j]} = {v}), 0) + {quality_rules.STRENGTH * kinds[j][which][v]!r}) / (sum({of}) + {quality_rules.STRENGTH})" for j in range(len(kinds)) for v in range(3)) + "]"

    bad = lambda c: f"WHEN {c} THEN 0"
    votes = [
        bad("n_symbols * 10 > word_chars"),
        bad("n_repeat_words * 5 > n_words"),
        bad("n_dup_lines * 3 > n_lines"),
        bad("n_letters >= 20 AND n_upper * 2 > n_letters"),
        bad("word_chars > n_words * 15 OR word_chars < n_words * 2"),
        bad("n_words >= 20 AND n_distinct * 5 < n_words") + " WHEN n_words >= 20 AND n_distinct * 5 > n_words * 2 THEN 2",
        bad("n_words >= 40 AND (n_stops * 100 < n_words OR n_stops > n_words)") + " WHEN n_words >= 20 AND n_stops * 40 >= n_words AND n_stops * 3 <= n_words THEN 2",
        bad("n_words >= 20 AND n_plain * 10 < n_words * 6") + " WHEN n_words >= 20 AND n_plain * 10 >= n_words * 9 THEN 2",
    ]
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
 g AS (SELECT id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
 r AS (SELECT id, count(DISTINCT i + k) AS n FROM (SELECT id, i FROM g QUALIFY count(*) OVER (PARTITION BY id, g) > 1), (SELECT unnest(range(8)) AS k) GROUP BY id),
 l AS (SELECT id, len(x) AS n_lines, len(x) - len(list_distinct(x)) AS n_dup_lines FROM (SELECT id, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '{WORD}')) AS x FROM d)),
 f AS (SELECT d.id, doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, {count('#*$%&|<>')} AS n_symbols, n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, n_lines,
  len(list_distinct(w)) AS n_distinct, {count(chr(92) + 'p{L}')} AS n_letters, {count(chr(92) + 'p{Lu}')} AS n_upper, {count('.!?;:。')} AS n_stops, len(list_filter(w, lambda y: regexp_matches(y, '{plain}'))) AS n_plain
  FROM d LEFT JOIN r ON r.id = d.id JOIN l ON l.id = d.id),
 v AS (SELECT *, {' + '.join(f'{3**j} * CASE {x} ELSE 1 END' for j, x in enumerate(votes))} AS votes, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
 p AS (SELECT votes, count(*)::DOUBLE AS n FROM v GROUP BY votes),
 em(i, prior, good, bad) AS (SELECT 0, {quality_rules.PRIOR}::DOUBLE, {guess(0)}, {guess(1)}
  UNION ALL SELECT i + 1, (sum(n * q) + 1) / (sum(n) + 2), {shares('n * q', 0)}, {shares('n * (1 - q)', 1)} FROM (SELECT p.*, i, {q} AS q FROM p, em WHERE i < {quality_rules.ROUNDS}) GROUP BY i),
 z AS (SELECT votes, {q} AS q FROM p, em WHERE i = {quality_rules.ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept, votes, floor(q * 1e6 + 0.5) / 1e6 AS posterior FROM v JOIN z USING (votes)"""


def licenses() -> str:
    rows = ", ".join("('" + n + f"', {k}, ['" + "', '".join(b) + "'])" for n, k, b in license_scan.templates())
    t = license_scan.THRESHOLD_PERCENT
    return f"""WITH u AS (SELECT doc_id, 0 AS line_no, coalesce(text, '') AS x FROM documents UNION ALL
 SELECT doc_id, unnest(range(1, len(l) + 1)), unnest(l) FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) WHERE len(l) > 1),
 w AS (SELECT doc_id, line_no, regexp_extract_all(lower(x), '[a-z0-9]+') AS w FROM u),
 b AS (SELECT doc_id, line_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
 s AS (SELECT *, len(b) AS n_bigrams, len(g) AS k FROM b JOIN (VALUES {rows}) t(license, template_no, g) ON len(b) * {200 - t} >= {t} * len(g) AND len(b) * {t} <= {200 - t} * len(g)),
 m AS (SELECT *, len(list_intersect(b, g)) AS n_shared FROM s)
SELECT doc_id, line_no, license, template_no, n_bigrams, n_shared, 2 * n_shared / (n_bigrams + k) AS dice FROM m WHERE 200 * n_shared >= {t} * (n_bigrams + k)"""


def mix() -> str:
    most, w = mixing.MOST, ", ".join(map(str, mixing.WEIGHTS))
    draw = "(('0x' || substr(md5(concat_ws('|', m, coalesce(doc_id::VARCHAR, ''))), 1, 8))::BIGINT / 4294967296.0)"
    return f"""WITH d AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, [{w}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM d GROUP BY source),
 o AS (SELECT *, row_number() OVER r AS k, sum(source_size) OVER ()::BIGINT AS everything, (sum(weight) OVER () - coalesce(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
  {most} * coalesce(sum(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped FROM s WINDOW r AS (ORDER BY source_size / weight, source NULLS LAST)),
 v AS (SELECT arg_min((everything - capped)::DOUBLE / rest, k) AS level FROM o WHERE weight * ((everything - capped)::DOUBLE / rest) <= {most} * source_size),
 t AS (SELECT source, source_size, least(({most} * source_size)::DOUBLE, coalesce(weight * level, ({most} * source_size)::DOUBLE)) AS target FROM o, v),
 r AS (SELECT *, CASE WHEN source_size > 0 THEN least({most}::DOUBLE, target / source_size) ELSE 1.0 END AS rate FROM t),
 e AS (SELECT r.source, m, sum(CASE WHEN {draw} < rate - floor(rate) THEN size ELSE 0 END)::BIGINT AS extra FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, (SELECT unnest(range({mixing.SEEDS})) AS m) GROUP BY r.source, m),
 b AS (SELECT r.source, r.source_size, target, rate, arg_min(m, (abs(floor(rate) * r.source_size + extra - target), m)) AS m FROM r JOIN e ON e.source IS NOT DISTINCT FROM r.source GROUP BY ALL)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN {draw} < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken, d.source FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source"""


def warc() -> str:
    return """WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages), f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM p LEFT JOIN f ON f.h = p.h"""


def top_k() -> str:
    return """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.z, e.z)::BIGINT AS score FROM e, e q WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""


def chat() -> str:
    odd = r"(<\|im_start\|>|<\|im_end\|>|<\\+\|)"
    more = r"len(regexp_extract_all({}, '<\\*\|'))"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{HOSTILE}' UNION ALL SELECT -1, 1, 'assistant', '{HOSTILE}'),
 c AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(24 + length(role) + length(text)) AS plain, sum({more.format('role')} + {more.format('text')} + 4 * len(regexp_extract_all(role, chr(10)))) AS extra, bool_or(regexp_matches(role, '{odd}') OR regexp_matches(text, '{odd}') OR contains(role, chr(10)) OR contains(role, '<|n|>')) AS odd FROM t GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, (plain + CASE WHEN odd THEN extra ELSE 0 END)::BIGINT AS formatted_chars FROM c"""


def all_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": jaccard(),
        "op3_quality_rules": rules(),
        "op4_license_scan": licenses(),
        "op5_source_mixing": mix(),
        "op7_warc": warc(),
        "op8_exact_top_k": top_k(),
        "op10_chat_formatting": chat(),
    }
