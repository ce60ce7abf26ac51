"""SQL that a second engine runs on the same tables, for the operators that SQL can express."""

from __future__ import annotations

from ticketlake.llm.mixing import DOMAINS, LEVELS, Mixture

_WORDS = r"[^\x20\x09-\x0D]+"


def mixing_sql(mixture: Mixture | None = None) -> str:
    """The whole selection: levels, budgets from the root down, the order of the last epoch."""
    mixture = mixture or Mixture()

    def weight(level: str) -> str:
        cases = "".join(f" WHEN {level} = '{v}' THEN {w}" for v, w in mixture.weights.get(level, {}).items())
        return f"CASE{cases} ELSE 1 END" if cases else "1"

    domains = ", ".join(f"'{d}'" for d in DOMAINS)
    number = r"regexp_extract(coalesce(source, ''), '([0-9]{1,9})[^0-9]*$', 1)"
    parts = [
        f"""docs AS (
  SELECT doc_id, [{domains}][coalesce(nullif({number}, '')::BIGINT, 0) % {len(DOMAINS)} + 1] AS domain,
    coalesce(lang, '') AS language, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS tokens
  FROM documents)""",
        "leaves AS (SELECT domain, language, source, sum(tokens)::HUGEINT AS leaf_tokens FROM docs GROUP BY ALL)",
    ]
    budget = mixture.budget if mixture.budget is not None else "(SELECT sum(leaf_tokens) FROM leaves)"
    parents: list[str] = []
    for depth, level in enumerate(LEVELS):
        keys = [*parents, level]
        by = f"PARTITION BY {', '.join(parents)}" if parents else ""
        above = f"JOIN share{depth - 1} USING ({', '.join(parents)})" if parents else ""
        given = "budget" if parents else f"{budget}::HUGEINT AS budget"
        able = " AND ".join(f"({weight(x)}) > 0" for x in LEVELS)
        parts += [
            f"""node{depth} AS (
  SELECT {', '.join(keys)}, capacity, {given}, ({weight(level)})::HUGEINT AS w
  FROM (SELECT {', '.join(keys)}, sum(leaf_tokens * {mixture.max_epochs})::HUGEINT AS capacity
    FROM leaves WHERE {able} GROUP BY ALL) {above})""",
            f"""full{depth} AS (
  SELECT *, capacity * (sum(w) OVER ({by}) - coalesce(sum(w) OVER before, 0))
    <= w * (budget - coalesce(sum(capacity) OVER before, 0)) AS is_full
  FROM node{depth}
  WINDOW before AS ({by} ORDER BY capacity::DOUBLE / w::DOUBLE, {level}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
            f"""share{depth} AS (
  SELECT {', '.join(keys)}, CASE WHEN is_full THEN capacity ELSE
    w * (budget - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({by}), 0))::HUGEINT
    // (sum(w) OVER ({by}) - coalesce(sum(CASE WHEN is_full THEN w END) OVER ({by}), 0))::HUGEINT
    END::HUGEINT AS budget
  FROM full{depth})""",
        ]
        parents = keys
    levels = ", ".join(LEVELS)
    parts += [
        f"""planned AS (
  SELECT docs.*, CASE WHEN leaf_tokens > 0 THEN coalesce(budget, 0) // leaf_tokens ELSE 0 END::BIGINT AS whole,
    CASE WHEN leaf_tokens > 0 THEN coalesce(budget, 0) % leaf_tokens ELSE 0 END::BIGINT AS part
  FROM docs JOIN leaves USING ({levels}) LEFT JOIN share{len(LEVELS) - 1} USING ({levels}))""",
        f"""keyed AS (
  SELECT *, ('0x' || substr(md5('{mixture.seed}:' || (whole + 1)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM planned)""",
        f"""placed AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {levels} ORDER BY key, doc_id, tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM keyed)""",
    ]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, {levels}, epoch::INTEGER AS epoch, tokens,
  (CASE WHEN epoch <= whole THEN tokens ELSE least(tokens, part - start) END)::BIGINT AS taken
FROM (SELECT *, unnest(range(1, whole + (start < part)::BIGINT + 1)) AS epoch FROM placed)"""


#: Every pair that shares a shingle, then the transitive closure of the links.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * c >= 85 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(x, y) AS (
  SELECT x, y FROM both_ways
  UNION SELECT r.x, b.y FROM reached r JOIN both_ways b ON r.y = b.x),
least AS (SELECT x, min(y) AS y FROM reached GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(y, doc_id)) AS kept
FROM sets LEFT JOIN least ON x = doc_id"""


#: Base 32 by five hexadecimal digits, that is four characters, at a time.
WARC_TRANSACTIONS = """
WITH held AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
marked AS (SELECT *, sha1(payload) AS digest, max(page_id) OVER (PARTITION BY payload) AS first FROM held)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    (('0x' || substr(digest, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) % 32 + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM marked"""


COLLOCATIONS = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM cut),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM placed, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
found AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS k FROM found),
scored AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.w, c.k, x.f AS l, y.f AS r,
    (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_pairs AS (
  SELECT lang, array_to_string(w[j:j + 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, unnest([1, 2]) AS j FROM found WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inner_pairs i USING (lang, phrase)
  WHERE size = 3 OR i.longer IS NULL OR 100 * i.longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""
