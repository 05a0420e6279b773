"""DuckDB SQL of the queries of this package that SQL can express; plain forms without hashes, sketches or blocks."""

from __future__ import annotations

from quillspark.llm import lines, merkle, phrases

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES = rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
    g AS (SELECT row, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT row, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
    t AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1),
    r AS (SELECT row, count(DISTINCT i + k) AS n FROM t, (VALUES (0), (1), (2)) AS s(k) GROUP BY row),
    b AS (SELECT w.row, doc_id, source, text, len(w) AS n_words, length(list_aggregate(list_concat([''], w), 'string_agg', '')) AS word_chars,
        length(text) - length(translate(text, '{lines.SYMBOLS}', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
        FROM w LEFT JOIN r USING (row)),
    x AS (SELECT row, source, text, unnest(string_split(text, chr(10))) AS line FROM b),
    y AS (SELECT row, source, text, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM x),
    n AS (SELECT source, line, count(DISTINCT text) AS n FROM y WHERE line <> '' GROUP BY ALL),
    h AS (SELECT source, count(DISTINCT text) AS n FROM b GROUP BY source),
    f AS (SELECT n.source, line FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source WHERE n.n > {lines.LEAST_DOCS} AND n.n > {lines.DOC_SHARE} * h.n),
    c AS (SELECT row, sum(len(string_split(y.line, ' '))) AS n FROM y JOIN f ON y.line = f.line AND y.source IS NOT DISTINCT FROM f.source GROUP BY row),
    e AS (SELECT *, coalesce(c.n, 0) AS n_removed, n_words < {lines.LEAST_WORDS} OR 100 * n_repeat_words > {lines.REPEAT_PERCENT} * n_words AS base_failed FROM b LEFT JOIN c USING (row))
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
        CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT (n_removed > 0 AND (n_words - n_removed < {lines.KEPT_WORDS} OR n_words - n_removed < {lines.KEPT_SHARE} * n_words)) AS kept,
        CAST(n_removed AS BIGINT) AS n_removed FROM e"""


def _tree(name: str, source: str, levels: int) -> tuple[str, str]:
    """(common table expressions, name of the last one): level by level over source (tree, place, n, hash), with the path of each node.

    The last one has tree, place, own (the node's place at the level reached), path (an array of
    the siblings before and after, level by level) and hash (the root's).
    """
    f, out = merkle.FANOUT, [f"{name}0 AS (SELECT tree, place, place AS own, n, hash, [] :: STRUCT(b VARCHAR, a VARCHAR)[] AS path FROM {source})"]
    for k in range(levels):
        out.append(f"{name}r{k} AS (SELECT tree, own // {f} AS run, string_agg(hash, '' ORDER BY own) AS whole FROM (SELECT DISTINCT tree, own, hash FROM {name}{k} WHERE n > 1) GROUP BY ALL)")
        out.append(
            f"""{name}{k + 1} AS (SELECT s.tree, s.place, CASE WHEN n > 1 THEN own // {f} ELSE own END AS own, CASE WHEN n > 1 THEN (n + {f - 1}) // {f} ELSE n END AS n,
            CASE WHEN n > 1 THEN sha256(whole) ELSE hash END AS hash, CASE WHEN n > 1 THEN list_append(path, {{'b': substr(whole, 1, 64 * (own % {f})), 'a': substr(whole, 64 * (own % {f} + 1) + 1)}}) ELSE path END AS path
            FROM {name}{k} s LEFT JOIN {name}r{k} r ON s.tree IS NOT DISTINCT FROM r.tree AND s.own // {f} = r.run)"""
        )
    return ", ".join(out), f"{name}{levels}"


def _merkle() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(concat(" + ", ".join(part(text if f == "text" else f) for f in merkle.FIELDS) + "))"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = f"""xor(list_reduce(list_prepend(4294967295 :: BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda a, x: list_reduce(list_prepend(xor(a, x), [0 :: BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: {step})), 4294967295)"""
    inner, leaves = _tree("t", "p", 8)
    outer, tops = _tree("u", "q", 3)
    fold = lambda start, path: f"list_reduce(list_prepend({{'b': '', 'a': '', 'h': {start}}}, list_transform({path}, lambda s: {{'b': s.b, 'a': s.a, 'h': ''}})), lambda x, s: {{'b': '', 'a': '', 'h': sha256(concat(s.b, x.h, s.a))}}).h"
    return f"""WITH d AS (SELECT *, doc_id IS NOT NULL AND {crc} % {merkle.TAMPERED_EACH} = 0 AS hit FROM documents),
        l AS (SELECT lang AS tree, doc_id, {leaf('text')} AS hash, CASE WHEN hit THEN {leaf(_LOWER.format('text'))} ELSE {leaf('text')} END AS tampered FROM d),
        p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM l),
        {inner}, s AS (SELECT tree, any_value(hash) AS hash FROM {leaves} GROUP BY tree),
        q AS (SELECT 0 AS tree, tree AS name, hash, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM s),
        {outer},
        z AS (SELECT p.doc_id, p.hash AS leaf, p.tampered, q.hash AS subroot, v.hash AS root, list_concat(w.path, v.path) AS path
            FROM p JOIN {leaves} w ON p.tree IS NOT DISTINCT FROM w.tree AND p.place = w.place JOIN q ON q.name IS NOT DISTINCT FROM p.tree JOIN {tops} v ON v.place = q.place),
        f AS (SELECT *, {fold('tampered', 'path')} AS folded_root FROM z)
        SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: concat(s.b, s.a)), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f"""


MERKLE = _merkle()

PHRASES = rf"""WITH t AS (SELECT coalesce(lang, '{phrases.NO_LANG}') AS lang, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
    p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
    s AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
    i AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM p),
    g AS (SELECT lang, w[i : i + k - 1] AS g, count(*) AS f FROM i, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
    c AS (SELECT lang, g, f AS a, unnest(generate_series(1, len(g) - 1)) AS k FROM g WHERE len(g) > 1),
    u AS (SELECT c.lang, c.g, a, k, l.f AS l, r.f AS r, CAST(2000000 :: HUGEINT * a // (l.f + r.f) AS BIGINT) AS score FROM c JOIN g l ON l.lang = c.lang AND l.g = c.g[: k] JOIN g r ON r.lang = c.lang AND r.g = c.g[k + 1 :]),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS nth FROM u),
    m AS (SELECT lang, g[i : i + n - 1] AS g, max(f) AS f FROM (SELECT lang, g, f, n, unnest(generate_series(1, len(g) - n + 1)) AS i FROM g, (VALUES (2), (3)) AS inner_sizes(n) WHERE len(g) > n) GROUP BY ALL),
    k AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN m ON m.lang = b.lang AND m.g = b.g WHERE nth = 1 AND (m.f IS NULL OR 100 * m.f < {phrases.INSIDE_PERCENT} * a)),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM k)
    SELECT o.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM o JOIN s ON s.lang = o.lang WHERE rank <= {phrases.TOP}"""
