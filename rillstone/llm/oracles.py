"""SQL for the queries that SQL can express, for DuckDB with a view ``documents``."""

from __future__ import annotations

from .quality import CUTOFF, DIMS, FLOOR, KEEP, LEAST, MAX_REPEAT_PERCENT, MIN_WORDS, PAIRS, STEPS, _consistency

#: Every window of 400 bytes by its MD5; windows that occur twice, merged to spans, are cut out.
SUFFIX_DEDUP = """
    WITH texts AS (
        SELECT doc_id, coalesce(encode(text), ''::BLOB) AS b FROM documents
    ), starts AS (
        SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS p FROM texts
    ), windows AS (
        SELECT doc_id, p, md5_number(array_slice(b, p, p + 399)) AS h FROM starts
    ), twice AS (
        SELECT h FROM windows GROUP BY h HAVING count(*) > 1
    ), hits AS (
        SELECT doc_id, p FROM windows SEMI JOIN twice USING (h)
    ), marked AS (
        SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS opens FROM hits
    ), numbered AS (
        SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked
    ), spans AS (
        SELECT doc_id, min(p) AS first, max(p) + 399 AS last FROM numbered GROUP BY doc_id, span
    ), gaps AS (
        SELECT doc_id, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) + 1 AS first, first - 1 AS last FROM spans
        UNION ALL
        SELECT doc_id, coalesce(max(last), 0) + 1, max(octet_length(b)) FROM texts LEFT JOIN spans USING (doc_id) GROUP BY doc_id
    ), kept AS (
        SELECT doc_id, string_agg(hex(array_slice(b, first, last)), '' ORDER BY first) FILTER (WHERE last >= first) AS hex FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
    ), removed AS (
        SELECT doc_id, sum(last - first + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
    )
    SELECT
        doc_id,
        octet_length(b)::BIGINT AS n_bytes,
        coalesce(n_removed, 0)::BIGINT AS n_removed,
        coalesce(n_spans, 0)::BIGINT AS n_spans,
        sha256(unhex(coalesce(hex, ''))) AS kept_sha256
    FROM texts LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _estimate(mean: list[str], cov: dict[tuple[int, int], str]) -> str:
    """Columns m0.. and l00.., the Cholesky factor of a covariance with its floor."""
    columns = [f"{m} AS m{i}" for i, m in enumerate(mean)]
    for i, j in PAIRS:
        rest = f"({cov[i, j]})" + (f" + {FLOOR[i] ** 2}e0" if i == j else "") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        columns.append(f"sqrt(greatest({rest}, {FLOOR[i] ** 2 / 4}e0)) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return ", ".join(columns)


def _distance() -> str:
    """Columns y0.. and d, the squared distance of x0.. from m0.. by l00.."""
    y = [f"(x{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i} AS y{i}" for i in range(DIMS)]
    return ", ".join([*y, " + ".join(f"y{i} * y{i}" for i in range(DIMS)) + " AS d"])


def _sums(of: str, out: str, weight: str = "1e0") -> str:
    return ", ".join([*[f"sum({weight} * {of}{i}) AS {out}{i}" for i in range(DIMS)], *[f"sum({weight} * {of}{i} * {of}{j}) AS {out}{i}{j}" for i, j in PAIRS]])


def _moments(n: str, scale: float = 1.0) -> str:
    return _estimate([f"s{i} / {n}" for i in range(DIMS)], {(i, j): f"(s{i}{j} / {n} - s{i} / {n} * (s{j} / {n})) * {scale}e0" for i, j in PAIRS})


def quality_rules() -> str:
    """The counts by lists of words and lines, and the estimates step by step from each of the three starts."""
    dims, x = range(DIMS), ", ".join(f"x{i}" for i in range(DIMS))
    quantile = lambda i, q: f"min((bin + 0.5e0) / 256) FILTER (WHERE dim = {i} AND upto >= {q})"
    quart = ", ".join(f"{quantile(i, 0.5)} AS q{i}, pow(({quantile(i, 0.75)} - {quantile(i, 0.25)}) / 1.349e0, 2) AS v{i}" for i in dims)
    own = ", ".join(f"q{i}, v{i}" for i in dims)
    units = ", ".join(f"(x{i} - q{i}) / sqrt(v{i} + {FLOOR[i] ** 2}e0) AS z{i}" for i in dims)
    size = "greatest(sqrt(" + " + ".join(f"z{i} * z{i}" for i in dims) + "), 1e-9)"
    medians = [f"q{i}" for i in dims]
    spreads = _estimate(medians, {(i, j): f"v{i}" if i == j else "0e0" for i, j in PAIRS})
    signs = _estimate(medians, {(i, j): f"{DIMS} * t{i}{j} / n * sqrt(v{i} + {FLOOR[i] ** 2}e0) * sqrt(v{j} + {FLOOR[j] ** 2}e0)" for i, j in PAIRS})
    steps = ""
    for k in range(STEPS):
        steps += f"""
, near{k} AS MATERIALIZED (
    SELECT key, start, n, {x}, {_distance()}, floor(32 * log2(d + pow(2, -16))) AS bin FROM rows JOIN est{k} USING (key)
), counts{k} AS (
    SELECT key, start, n, bin, count(*) AS c FROM near{k} GROUP BY ALL
), upto{k} AS (
    SELECT *, sum(c) OVER (PARTITION BY key, start ORDER BY bin) AS upto FROM counts{k}
), reach{k} AS (
    SELECT key, start, min(bin) AS reach, arg_min(1 - (upto - {KEEP}e0 * n) / c, bin) AS part FROM upto{k} WHERE upto >= {KEEP}e0 * n GROUP BY ALL
), chosen{k} AS (
    SELECT *, CASE WHEN bin < reach THEN 1e0 ELSE part END AS w FROM near{k} JOIN reach{k} USING (key, start) WHERE bin <= reach
), sums{k} AS (
    SELECT key, start, n, sum(w) AS c, {_sums("x", "s", "w")} FROM chosen{k} GROUP BY key, start, n
), est{k + 1} AS MATERIALIZED (
    SELECT key, start, n, {_moments("c", _consistency() if k == STEPS - 1 else 1.0)} FROM sums{k}
)"""
    return rf"""
WITH texts AS (
    SELECT doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents)
), places AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts
), windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS c FROM places
), covered AS (
    SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM windows WHERE c > 1) GROUP BY doc_id
), counted AS (
    SELECT
        doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM texts LEFT JOIN covered USING (doc_id)
), marked AS MATERIALIZED (
    SELECT
        doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        [{{'lang': lang, 'source': source, 'level': 0}}, {{'lang': lang, 'source': NULL, 'level': 1}}, {{'lang': NULL, 'source': NULL, 'level': 2}}] AS keys,
        ln(greatest(word_chars / greatest(n_words, 1), 1)) AS x0, sqrt(n_symbols / greatest(word_chars, 1)) AS x1,
        sqrt(n_dup_lines / greatest(n_lines, 1)) AS x2, sqrt(n_repeat_words / greatest(n_words, 1)) AS x3
    FROM counted
), rows AS MATERIALIZED (
    SELECT unnest(keys)::VARCHAR AS key, {x} FROM marked WHERE NOT base_failed
), bins AS (
    SELECT key, unnest([{", ".join(f"{{'dim': {i}, 'bin': floor(x{i} * 256)}}" for i in dims)}], recursive := true) FROM rows
), shares AS (
    SELECT key, dim, bin, c, sum(c) OVER (PARTITION BY key, dim ORDER BY bin) / sum(c) OVER (PARTITION BY key, dim) AS upto
    FROM (SELECT key, dim, bin, count(*) AS c FROM bins GROUP BY ALL)
), quart AS (
    SELECT key, sum(c) FILTER (WHERE dim = 0)::DOUBLE AS n, {quart} FROM shares GROUP BY key
), units AS (
    SELECT key, n, {own}, {x}, {units}, {size} AS size, {", ".join(f"z{i} / size AS u{i}" for i in dims)} FROM rows JOIN quart USING (key)
), whole AS MATERIALIZED (
    SELECT key, n, {own}, {_sums("x", "s")}, {_sums("u", "t")} FROM units GROUP BY key, n, {own}
), est0 AS MATERIALIZED (
    SELECT key, 0 AS start, n, {spreads} FROM whole
    UNION ALL SELECT key, 1, n, {_moments("n")} FROM whole
    UNION ALL SELECT key, 2, n, {signs} FROM whole
){steps}, best AS (
    SELECT * FROM est{STEPS} WHERE n >= {LEAST} QUALIFY row_number() OVER (PARTITION BY key ORDER BY {" + ".join(f"ln(l{i}{i})" for i in dims)}, start) = 1
), levels AS (
    SELECT doc_id, k.level AS level, k::VARCHAR AS key, {x} FROM (SELECT doc_id, unnest(keys) AS k, {x} FROM marked)
), distances AS (
    SELECT doc_id, level, {_distance()} FROM levels JOIN best USING (key)
), verdicts AS (
    SELECT doc_id, arg_min(d, level) AS d FROM distances GROUP BY doc_id
)
SELECT
    doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce(d, 0) <= {CUTOFF} AS kept
FROM marked LEFT JOIN verdicts USING (doc_id)
"""


QUALITY_RULES = quality_rules()
