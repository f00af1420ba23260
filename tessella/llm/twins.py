"""SQL twins of the numbered queries that SQL can express."""

from __future__ import annotations

from tessella.llm import chats, secrets, urls


def _spans(rule: secrets.Rule) -> str:
    """A list of (start, number, kind, end) of one rule's matches in the column ``t``."""
    pattern = rule.pattern.replace("'", "''")
    number = secrets.RULES.index(rule)
    return f"""list_filter(list_transform(
        list_zip(string_split_regex(t, '{pattern}'), regexp_extract_all(t, '{pattern}', 0), regexp_extract_all(t, '{pattern}', {rule.group}),
                 range(1, len(string_split_regex(t, '{pattern}')) + 1)),
        lambda x: {{'start': list_sum(list_transform(string_split_regex(t, '{pattern}')[1:x[4]], lambda y: length(y)))
                        + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}', 0)[1:x[4] - 1], lambda y: length(y))), 0),
               'number': {number}, 'kind': '{rule.kind}', 'size': length(x[2]), 'tested': length(x[3])}}),
        lambda x: x.size IS NOT NULL AND x.tested >= {rule.least})"""


def secrets_sql() -> str:
    name = "lambda x: x.kind || ':' || CAST(x.start AS BIGINT) || ':' || CAST(x.start + x.size AS BIGINT)"
    every = ",\n      ".join(_spans(r) for r in secrets.RULES)
    counts = ", ".join(f"CAST(len(list_filter(s, lambda x: x.kind = '{r.kind}')) AS BIGINT) AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, list_sort(flatten([
      {every}])) AS s FROM d)
SELECT doc_id, {counts},
  sha256(coalesce(array_to_string(list_transform(list_filter(s, lambda x: x.number < {len(secrets.BASE)}), {name}), ','), '')) AS base_sha256,
  coalesce(array_to_string(list_transform(s, {name}), ','), '') AS spans
FROM found"""


def urls_sql(levels: int = 8) -> str:
    """Paths of up to ``levels`` segments: every prefix of a page's template is worked out from the one before."""
    order = sorted(urls.RULES, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in order) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in order) + " END"
    ending = r"regexp_extract(s, '(\.[a-z]{1,5})$', 1)"
    general = rf"""list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE
      WHEN regexp_matches(s, '^[0-9]+(\.[a-z]{{1,5}})?$') THEN '<n>' || {ending}
      WHEN regexp_matches(s, '^[0-9a-fA-F-]{{8,}}(\.[a-z]{{1,5}})?$') THEN '<h>' || {ending}
      WHEN regexp_matches(s, '[0-9]{{4,}}') THEN '<m>' || {ending} ELSE s END)"""
    steps = []
    for d in range(levels):
        steps.append(f"""
c{d} AS (SELECT t{d} AS node, g[{d + 1}] AS seg, count(*) AS n, count(ruled) AS l, count(*) FILTER (ruled = 'block') AS b
  FROM k{d} WHERE live GROUP BY ALL),
m{d} AS (SELECT node, seg, CASE WHEN seg IS NULL THEN NULL WHEN n < {urls.LEAST_PAGES} THEN '<*>' ELSE seg END AS name, n, l, b FROM c{d}),
f{d} AS (SELECT node, name, sum(l) AS l, sum(b) AS b FROM m{d} WHERE name IS NOT NULL GROUP BY ALL HAVING sum(l) >= {urls.LEAST_LABELLED}),
p{d} AS (SELECT x.node, x.name, x.l, x.b, x.b / x.l AS q, sum(y.l) AS pl, sum(y.b) AS pb FROM f{d} x LEFT JOIN f{d} y
  ON x.node = y.node AND (y.b / y.l, y.name) < (x.b / x.l, x.name) GROUP BY ALL),
z{d} AS (SELECT *, pl IS NULL OR q - pb / pl > {urls.LEAST_Z} * sqrt((b + pb) / (l + pl) * (1 - (b + pb) / (l + pl)) * (1.0 / l + 1.0 / pl)) AS fresh FROM p{d}),
w{d} AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY node ORDER BY q, name) AS grp FROM z{d}),
v{d} AS (SELECT node, name, CASE WHEN count(*) OVER (PARTITION BY node, grp) > 1 THEN '<' || grp || '>' ELSE name END AS child FROM w{d}),
j{d} AS (SELECT k{d}.*, CASE WHEN NOT live THEN t{d} ELSE t{d} || '/' || coalesce(v{d}.child, m{d}.name, '') END AS t{d + 1}, live AND g[{d + 1}] IS NOT NULL AS moved
  FROM k{d} LEFT JOIN m{d} ON live AND m{d}.node = t{d} AND m{d}.seg IS NOT DISTINCT FROM g[{d + 1}] LEFT JOIN v{d} ON live AND v{d}.node = t{d} AND v{d}.name = m{d}.name),
k{d + 1} AS (SELECT * EXCLUDE (live, moved), moved AND count(ruled) FILTER (moved) OVER (PARTITION BY t{d + 1}) >= {urls.LEAST_LABELLED} AS live FROM j{d})""")
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT page_id, host, path, {rule} AS rule, {ruled} AS ruled, {general} AS g FROM u),
k0 AS (SELECT *, host AS t0, count(ruled) OVER (PARTITION BY host) >= {urls.LEAST_LABELLED} AS live FROM r),{",".join(steps)},
s AS (SELECT *, (count(*) FILTER (ruled = 'block') OVER (PARTITION BY t{levels}) + {urls.WEIGHT / 2}) / (count(ruled) OVER (PARTITION BY t{levels}) + {urls.WEIGHT}) AS p FROM k{levels})
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN p >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, t{levels} AS template, round(p, 6) AS purity FROM s"""


def chats_sql() -> str:
    return f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text, md5(coalesce(length(role) || 'r' || role, '-') || coalesce('t' || text, '-')) AS digest FROM conversations),
p AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n, md5(string_agg(digest, '') OVER w) AS h
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT n, h, min(conv_id) AS conv_id FROM p WHERE place = n GROUP BY n, h),
kept AS (SELECT conv_id FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n AND p.place = whole.n AND p.h = whole.h))
SELECT conv_id, n AS conv_turns, CAST((place - 1) // {chats.PART_TURNS} AS BIGINT) AS part, count(*) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM p WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id, n, part"""


def _crc32(text: str) -> str:
    """crc32 of a short ASCII string, bit by bit."""
    step = "xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)"
    eight = f"list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::UBIGINT)), lambda c, i: {step})"
    ords = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {ords}), lambda a, b: {eight}), 4294967295::UBIGINT)"


def manifest_sql() -> str:
    part = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', n, 'text')))})"
    tree = lambda name, leaves: f"""
{name} AS (SELECT g, 0 AS level, place, n, h FROM {leaves}
  UNION ALL SELECT g, level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY g, level, place // 2)"""  # noqa: E731
    walk = lambda name, start, source: f"""
{name} AS (SELECT id, g, 0 AS level, place, n, folded, '' AS proof FROM {start}
  UNION ALL SELECT w.id, w.g, w.level + 1, w.place // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.place % 2 = 1 THEN coalesce(t.h, '') || w.folded ELSE w.folded || coalesce(t.h, '') END), w.proof || coalesce(t.h, '')
  FROM {name} w LEFT JOIN {source} t ON t.g = w.g AND t.level = w.level AND t.place = xor(w.place, 1) WHERE w.n > 1)"""  # noqa: E731
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, *, {leaf('n_chars')} AS h,
    CASE WHEN doc_id IS NOT NULL AND {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {leaf('n_chars + 1')} ELSE {leaf('n_chars')} END AS tampered FROM documents),
names AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS groups FROM (SELECT DISTINCT lang FROM documents)),
leaves AS (SELECT d.id, d.doc_id, names.g, names.groups, h, tampered, row_number() OVER (PARTITION BY names.g ORDER BY d.doc_id NULLS FIRST, h) - 1 AS place,
    count(*) OVER (PARTITION BY names.g) AS n FROM d JOIN names ON d.lang IS NOT DISTINCT FROM names.lang),{tree('low', 'leaves')},
subroots AS (SELECT 0 AS g, low.g AS place, names.groups AS n, h FROM low JOIN names USING (g) WHERE low.n = 1),{tree('high', 'subroots')},
starts AS (SELECT *, tampered AS folded FROM leaves),{walk('inner_path', 'starts', 'low')},
tops AS (SELECT id, 0 AS g, inner_path.g AS place, names.groups AS n, folded, proof AS low_proof FROM inner_path JOIN names USING (g) WHERE inner_path.n = 1),{walk('upper_path', 'tops', 'high')}
SELECT leaves.doc_id, leaves.h AS leaf, subroots.h AS subroot, high.h AS root, sha256(tops.low_proof || upper_path.proof) AS proof_sha256,
  upper_path.folded AS folded_root, upper_path.folded = high.h AS verified
FROM leaves JOIN subroots ON subroots.place = leaves.g JOIN tops USING (id) JOIN upper_path ON upper_path.id = leaves.id AND upper_path.n = 1 JOIN high ON high.n = 1"""


def hard_negatives_sql() -> str:
    return """
WITH e AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.id AS anchor_id, a.label AS own, b.id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.id % 100 = 0 AND len(a.v) = len(b.v) AND (a.id <> b.id OR a.label <> b.label)),
best AS (SELECT anchor_id, own, id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id, own ORDER BY score DESC, id) AS place FROM pairs WHERE label = own),
fits AS (SELECT best.anchor_id, positive_id, pairs.id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY best.anchor_id, best.own, positive_id ORDER BY score DESC, pairs.id) AS INTEGER) AS rank
  FROM best JOIN pairs ON best.anchor_id = pairs.anchor_id AND best.own = pairs.own AND pairs.label <> pairs.own
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WHERE place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM fits WHERE rank <= 10"""


def minhash_sql() -> str:
    words = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    return f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS id, doc_id, {words} AS words FROM documents),
s AS (SELECT id, doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingles FROM w),
sets AS (SELECT list_sort(shingles) AS shingles, len(shingles) AS n, min(id) AS sid FROM s WHERE len(shingles) > 0 GROUP BY ALL),
flat AS (SELECT sid, n, unnest(shingles) AS x FROM sets),
links AS (SELECT a.sid AS a, b.sid AS b FROM flat a JOIN flat b ON a.x = b.x AND a.sid < b.sid GROUP BY a.sid, b.sid, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT sid, sid AS other FROM sets UNION SELECT reach.sid, edges.b FROM reach JOIN edges ON reach.other = edges.a),
own AS (SELECT s.id, s.doc_id, len(s.shingles) AS n, sets.sid FROM s LEFT JOIN sets ON sets.shingles = list_sort(s.shingles)),
least AS (SELECT sid, min(doc_id) AS doc_id FROM own WHERE sid IS NOT NULL GROUP BY sid),
named AS (SELECT reach.sid, min(least.doc_id) AS component_id FROM reach JOIN least ON least.sid = reach.other GROUP BY reach.sid)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id,
  coalesce(doc_id = CASE WHEN n = 0 THEN doc_id ELSE component_id END, false) AS kept
FROM own LEFT JOIN named USING (sid)"""


def ledger_sql() -> str:
    """Blobs are distinct texts; each scan takes those, or the rule, that are new to it."""
    every = ",\n      ".join(_spans(r) for r in secrets.RULES)
    rules = ", ".join(f"('{r.kind}', {r.version})" for r in secrets.RULES)
    return f"""
WITH b AS (SELECT coalesce(text, '') AS t, coalesce(bool_or(doc_id % 2 = 0), false) AS early FROM documents GROUP BY 1),
f AS (SELECT early, flatten([
      {every}]) AS s FROM b),
r AS (SELECT * FROM (VALUES {rules}) v(rule, version)),
x AS (SELECT CASE WHEN early THEN 1 ELSE 2 END AS scan, rule, version, s FROM f, r UNION ALL SELECT 3, rule, version + 1, s FROM f, r WHERE rule = 'hex')
SELECT scan, rule, version, count(*) AS pairs, CAST(sum(len(list_filter(s, lambda y: y.kind = rule))) AS BIGINT) AS n_spans FROM x GROUP BY ALL"""
