"""The operators' queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, collocations, jaccard, langid, licences, neighbours, packing, pii, quality, secret_scans, suffixes, toxicity, variants

QUERIES = {
    "op1_license_scan": licences.op1_license_scan,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_hilbert_packing": packing.op4_hilbert_packing,
    "op5_language_mixture": langid.op5_language_mixture,
    "op6_multi_index": neighbours.op6_multi_index,
    "op7_bpe_encoding": bpe.op7_bpe_encoding,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_pii": pii.op10_pii,
    "op11_phrase_collocations": collocations.op11_phrase_collocations,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_secret_scans": secret_scans.op13_secret_scans,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links (a, b) to each node's least reachable node, the node itself included.
REACH = """reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
component AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""


def secrets_sql(rules: tuple[secret_scans.Rule, ...]) -> str:
    """Matches by kind: places are sums of the lengths of gaps and matches."""
    parts = []
    for rank, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i:
 {{'a': CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'm': m[i]}}),
 lambda x: length(regexp_extract(x.m, '{pattern}', {r.group})) >= {r.least})) AS x
 FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d)""")
    joined = "sha256(coalesce(string_agg(kind || ':' || x.a || ':' || (x.a + length(x.m)), ',' ORDER BY x.a, rank) FILTER (WHERE {}), ''))"
    base = len(secret_scans.BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secret_scans.BASE)
    every = joined.format("kind IS NOT NULL").removeprefix("sha256(").removesuffix(")")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts}, {joined.format(f"rank < {base}")} AS base_sha256, {every} AS spans, count(kind) AS n_spans FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op6_multi_index": f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
 WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), nodes AS (SELECT DISTINCT a AS id FROM both_ways), {REACH}
SELECT v.vec_id, (SELECT count(*) FROM both_ways l WHERE l.a = v.vec_id) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id,
 coalesce(c.component_id, v.vec_id) = v.vec_id AS kept FROM v LEFT JOIN component c ON c.id = v.vec_id""",
    "op8_ngram_jaccard": rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM u x JOIN u y ON x.g = y.g AND x.doc_id < y.doc_id
 GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), nodes AS (SELECT DISTINCT a AS id FROM both_ways), {REACH}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id FROM s LEFT JOIN component c ON c.id = s.doc_id""",
    "op11_phrase_collocations": rf"""WITH p AS (SELECT row_number() OVER () AS piece, lang, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda w: w <> '') AS w
 FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM p GROUP BY lang),
occurrence AS ({" UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) AS phrase, {k} AS k FROM p WHERE len(w) >= {k}" for k in range(1, 6))}),
f AS (SELECT lang, phrase, k, count(*) AS f FROM occurrence GROUP BY lang, phrase, k HAVING count(*) >= 100),
c AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.*, j, array_to_string(w[1:j], ' ') AS p1, array_to_string(w[j + 1:k], ' ') AS p2 FROM c, range(1, 5) AS t(j) WHERE j < k),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, x.f AS l, y.f AS r, n.n, j, (1000 * CAST(cuts.a AS HUGEINT) * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS score FROM cuts
 JOIN f x ON x.lang = cuts.lang AND x.phrase = p1 JOIN f y ON y.lang = cuts.lang AND y.phrase = p2 JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT c.lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM c, range(1, 5) AS t(i), range(2, 5) AS u(m) WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2),
alone AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM alone QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
    "op12_spelling_variants": rf"""WITH RECURSIVE t AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) AS r(b))),
r AS (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM r WHERE length(w) >= 6 GROUP BY doc_id, w),
h AS (SELECT w, k, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2), lambda i: CAST(('0x' || x[2 * i + 1:2 * i + 2]) AS BIGINT))),
 lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS h FROM d, t),
c AS (SELECT CASE WHEN h % 199 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM c WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
less AS (SELECT word, n, i, word[1:i - 1] AS p, word[i + 1:] AS q FROM v, range(1, (SELECT max(length(word)) + 1 FROM v)) AS s(i) WHERE i <= length(word)),
pairs AS (SELECT DISTINCT a.word AS a, b.word AS b, b.n AS bn FROM less a JOIN less b ON a.i = b.i AND a.p = b.p AND a.q = b.q AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON b.word = a.p || a.q UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON b.word = a.p || a.q),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-bn, b)) AS b, max(bn) AS bn FROM pairs GROUP BY a),
form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 5 * v.n THEN b END AS form, CASE WHEN bn >= 5 * v.n THEN bn END AS form_n FROM v LEFT JOIN best ON a = v.word),
follow(word, reached, form) AS (SELECT word, word, form FROM form UNION ALL SELECT f.word, g.word, g.form FROM follow f JOIN form g ON g.word = f.form)
SELECT f.word, f.form, o.reached AS root, f.n, f.n_near, f.form_n FROM form f JOIN follow o ON o.word = f.word AND o.form IS NULL""",
    "op13_secret_scans": secrets_sql(secret_scans.RULES),
}
