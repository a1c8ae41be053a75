"""DuckDB SQL of the operators that SQL can express over the test tables."""

from __future__ import annotations

from memlake.llm import filter_audit, lexical_index, quality_rules, url_filter

WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
UPPER, LOWER = url_filter.UPPER, url_filter.LOWER


def op2_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
    listed = ", ".join(f"('{h}')" for h in url_filter.BLOCKED_HOSTS)
    return f"""WITH rules(verdict, rhost, rpath) AS (VALUES {rules}), listed(bhost) AS (VALUES {listed}),
      u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
      h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
      p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
      m AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
        FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
      b AS (SELECT DISTINCT page_id FROM p JOIN listed ON host = bhost OR ends_with(host, '.' || bhost))
      SELECT p.page_id, host, path, rule, coalesce(m.verdict, CASE WHEN b.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
      FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.n = 1 LEFT JOIN b ON b.page_id = p.page_id"""


def op3_sql() -> str:
    folded = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(folded)} AS words FROM documents),
      s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles FROM w),
      t AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
      p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS both_ FROM t x JOIN t y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
      l AS (SELECT a, b FROM p WHERE 100 * both_ >= 80 * (na + nb - both_)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
      reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
      c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
      SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON c.a = doc_id"""


def op7_sql() -> str:
    normal = "lower(regexp_replace(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g'))"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
      w AS (SELECT r, doc_id, host, text, {WORDS.format('text')} AS words FROM d),
      g AS (SELECT r, i, words[i:i+2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
      rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
      cov AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM rep) GROUP BY r),
      l AS (SELECT r, host, line FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
      dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
      nl AS (SELECT r, host, {normal} AS norm, len({WORDS.format('line')}) AS w FROM l),
      above AS (SELECT host, norm FROM nl GROUP BY host, norm HAVING count(DISTINCT r) > {quality_rules.MAX_DOCS}),
      lost AS (SELECT r, sum(w) AS n FROM nl SEMI JOIN above ON above.host = nl.host AND above.norm = nl.norm GROUP BY r),
      q AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS removed_words
        FROM w LEFT JOIN cov ON cov.r = w.r LEFT JOIN dup ON dup.r = w.r LEFT JOIN lost ON lost.r = w.r),
      f AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND removed_words * 2 <= n_words AS kept,
        CAST(removed_words AS BIGINT) AS removed_words FROM f"""


def op11_sql() -> str:
    bits = ", ".join(f"('{f}', {1 << k})" for k, f in enumerate(filter_audit.FILTERS))
    return f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
      firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
      w AS (SELECT d.doc_id, part, d.text, {WORDS.format('d.text')} AS words, d.doc_id > first AS copied FROM d JOIN firsts ON firsts.text = d.text),
      m AS (SELECT part, CASE WHEN len(words) < {filter_audit.MIN_WORDS} THEN 1 ELSE 0 END
          + CASE WHEN 100 * len(list_distinct(words)) < {filter_audit.DISTINCT_PERCENT} * len(words) THEN 2 ELSE 0 END
          + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > {filter_audit.CAPITAL_PERCENT} * length(text) THEN 4 ELSE 0 END
          + CASE WHEN regexp_matches(text, '{filter_audit.SIGNS}') THEN 8 ELSE 0 END + CASE WHEN copied THEN 16 ELSE 0 END AS mask,
        EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = w.doc_id AND quality = 1) AS good,
        EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = w.doc_id AND toxic = 1) AS toxic FROM w),
      c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
      f(x, b) AS (VALUES {bits}),
      o AS (SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits
        FROM f f1, f f2, f f3, f f4, f f5 WHERE len(list_distinct([f1.b, f2.b, f3.b, f4.b, f5.b])) = 5),
      s AS (SELECT filter_order, step, bits[step] AS b, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM o, range(1, 6) r(step)),
      r AS (SELECT part, filter_order, step, b,
        coalesce(sum(n) FILTER (mask & (before + b) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (mask & before = 0 AND mask & b <> 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & before <> 0 AND mask & b <> 0), 0) AS redundant,
        coalesce(sum(n) FILTER (mask = b), 0) AS unique_fails,
        coalesce(sum(good) FILTER (mask & before = 0 AND mask & b <> 0), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & b <> 0), 0) AS toxic_lost
        FROM (SELECT part, mask, n, good, toxic, filter_order, step, b, CAST(before AS INTEGER) AS before FROM c, s) GROUP BY part, filter_order, step, b)
      SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
        CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
        CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley FROM r"""


def op13_sql() -> str:
    terms = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{lexical_index.TERM}')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS terms FROM documents WHERE text IS NOT NULL),
      t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
      s AS (SELECT count(*) FILTER (len(terms) > 0) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d),
      q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({terms}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
      w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term),
      m AS (SELECT r, doc_id, 25 + (75 * len(terms) * s.n) // s.l AS m FROM d, s),
      x AS (SELECT q.item_id, t.r, any_value(m.doc_id) AS doc_id, CAST(sum(repeats * w.w * ((1000000000 * tf) // (1000 * tf + 8 * m.m))) AS BIGINT) AS score
        FROM q JOIN w ON w.term = q.term JOIN t ON t.term = q.term JOIN m ON m.r = t.r GROUP BY q.item_id, t.r),
      k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
      SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {lexical_index.TOP}"""


ORACLE_SQL = {
    "op2_url_digests": op2_sql(), "op3_jaccard_join": op3_sql(), "op7_line_frequency": op7_sql(),
    "op11_filter_audit": op11_sql(), "op13_lexical_search": op13_sql(),
}
