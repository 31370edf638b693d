"""SQL for the queries that SQL can express, written without the operators' methods.

Language identification, the pipeline and the spans that contexts add have none: tests
hold them against brute force and held-out rows.
"""

from __future__ import annotations

from . import mixing, secretscan, sharding

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = r"[^\x20\x09-\x0D]+"


def _fold(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATE = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_fold("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_fold('text')}, '{_WORDS}') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
n AS (SELECT item, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM n)),
p AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k),
h AS (SELECT p.doc_id, p.s, p.k, v.item FROM (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM p) p JOIN v USING (k, g)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _secrets() -> str:
    quoted = {r.name: r.pattern.replace("'", "''") for r in secretscan.RULES}
    kinds = [f"SELECT doc_id, {k} AS k, '{name}' AS kind, text, regexp_extract_all(text, '{p}') AS ms FROM d" for k, (name, p) in enumerate(quoted.items())]
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({' UNION ALL '.join(kinds)}),
r AS (SELECT doc_id, k, kind, ms, 0::BIGINT AS i, 0::BIGINT AS place, text AS rest, 0::BIGINT AS s FROM f WHERE len(ms) > 0
UNION ALL SELECT doc_id, k, kind, ms, i + 1, place + instr(rest, ms[i + 1]) - 1 + length(ms[i + 1]), substr(rest, instr(rest, ms[i + 1]) + length(ms[i + 1])), place + instr(rest, ms[i + 1]) - 1 FROM r WHERE i < len(ms)),
x AS (SELECT doc_id, k, kind, s, place AS e FROM r WHERE i > 0 AND (k <> 0 OR length(regexp_extract(ms[i], '{quoted['assign']}', 2)) >= 8)),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in secretscan.RULES)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM x GROUP BY 1)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.name}, 0) AS n_{r.name}' for r in secretscan.RULES)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


SECRETS = _secrets()

SUBSTRINGS = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACES}') AS w FROM documents),
p AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, s FROM p WHERE g IN (SELECT g FROM p GROUP BY g HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS j FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN c USING (doc_id, j) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""

SUFFIX_ARRAY = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 800)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS s FROM d WHERE length(h) >= 800)),
r AS (SELECT doc_id, s FROM p WHERE g IN (SELECT g FROM p GROUP BY g HAVING count(*) > 1)),
e AS (SELECT doc_id, s, CASE WHEN s > coalesce(max(s + 400) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM r),
q AS (SELECT doc_id, min(s) AS lo, max(s) + 400 AS hi FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM e) GROUP BY doc_id, run),
p2 AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 512)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 255)) AS s FROM d WHERE length(h) >= 512)),
r2 AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS following FROM p2 WHERE g IN (SELECT g FROM p2 GROUP BY g HAVING count(*) > 1)),
n2 AS (SELECT doc_id, sum(least(256, coalesce(following - s, 256)))::BIGINT AS n_passage FROM r2 GROUP BY 1),
n AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last FROM q GROUP BY 1),
k AS (SELECT q.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept FROM (SELECT *, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM q) q JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(n_passage, 0) AS n_passage FROM d LEFT JOIN n USING (doc_id) LEFT JOIN n2 USING (doc_id) LEFT JOIN k USING (doc_id)"""


def _mixing() -> str:
    topic = "CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'icensed under') THEN 'licensed' WHEN contains(text, '@') THEN 'contact' WHEN length(text) < 800 THEN 'short' ELSE 'prose' END"
    names = ("source", "lang", "topic")
    parts = [
        f"d AS (SELECT doc_id, coalesce(source, '\\N') AS source, coalesce(lang, '\\N') AS lang, {topic} AS topic, source AS s0, lang AS l0, coalesce(len(regexp_extract_all(text, '{_SPACES}')), 0) AS n FROM documents)",
        "f0 AS MATERIALIZED (SELECT source, lang, topic, sum(n)::DOUBLE AS n, 0.9::DOUBLE * sum(n)::DOUBLE AS w FROM d GROUP BY ALL)",
    ]
    for name in names:
        # the level at which tempered shares fill the budget: values of which there are fewer are kept whole
        parts.append(f"h_{name} AS MATERIALIZED (SELECT {name}, n AS have, pow(n, {mixing.TEMPER}) / sum(pow(n, {mixing.TEMPER})) OVER () AS share FROM (SELECT {name}, sum(n) AS n FROM f0 GROUP BY 1) WHERE n > 0)")
        parts.append(f"l_{name} AS MATERIALIZED (SELECT arg_min(level, ratio) AS level FROM (SELECT have / share AS ratio, (0.9::DOUBLE * (SELECT sum(n) FROM f0) - coalesce(sum(have) OVER (ORDER BY have / share, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(share) OVER (ORDER BY have / share, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM h_{name}) WHERE level < ratio)")
        parts.append(f"t_{name} AS MATERIALIZED (SELECT {name}, least(have, share * (SELECT level FROM l_{name})) AS goal FROM h_{name})")
    last = 0
    for _ in range(mixing.ROUNDS):
        for name in names:
            parts.append(
                f"f{last + 1} AS MATERIALIZED (SELECT source, lang, topic, n, CASE WHEN s > 0 AND g > s THEN CASE WHEN w >= n THEN n ELSE least(n, coalesce(w * (g - f) / nullif(s - f, 0), 0)) END WHEN s > 0 THEN w * g / s ELSE 0 END AS w FROM (SELECT x.*, coalesce(goal, 0) AS g FROM (SELECT *, sum(w) OVER (PARTITION BY {name}) AS s, sum(CASE WHEN w >= n THEN w ELSE 0 END) OVER (PARTITION BY {name}) AS f FROM f{last}) x LEFT JOIN t_{name} USING ({name})))"
            )
            last += 1
    parts.append(f"p AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN n > 0 THEN least(1, w / n) ELSE 1 END AS p FROM f{last})")
    each = " UNION ALL ".join(f"SELECT max(abs(coalesce(got, 0) - coalesce(goal, 0) / (SELECT sum(goal) FROM t_{name}))) AS off FROM (SELECT {name}, sum(w) / (SELECT sum(w) FROM f{last}) AS got FROM f{last} GROUP BY 1) FULL JOIN t_{name} USING ({name})" for name in names)
    parts.append(f"r AS MATERIALIZED (SELECT max(off) AS off FROM ({each}))")
    draw = "('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '\\N')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    return f"WITH {', '.join(parts)} SELECT doc_id, s0 AS source, l0 AS lang, round(p, 9) AS probability, round(off, 9) AS residual FROM d JOIN p USING (source, lang, topic), r WHERE {draw} < p"


MIXING = _mixing()


def _sharding() -> str:
    m, n = sharding.SLOTS, sharding.SHARDS
    number = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT list({number.format("'shard-' || k || ':offset'")} % {m} ORDER BY k) AS o, list({number.format("'shard-' || k || ':skip'")} % {m - 1} + 1 ORDER BY k) AS s FROM range({n}) r(k)),
f AS (SELECT 0 AS turn, list_transform(range({m}), lambda x: -1) AS t, list_transform(range({n}), lambda x: 0) AS nth, -1 AS slot FROM w
UNION ALL SELECT turn + 1, list_concat(t[:c], [k], t[c + 2:]), list_concat(nth[:k], [j + 1], nth[k + 2:]), c FROM (
SELECT *, (o[k + 1] + j * s[k + 1]) % {m} AS c FROM (SELECT *, list_filter(range(nth[k + 1], {m}), lambda j: t[(o[k + 1] + j * s[k + 1]) % {m} + 1] < 0)[1] AS j FROM (SELECT *, turn % {n} AS k FROM f, w WHERE turn < {m})))),
l AS MATERIALIZED (SELECT slot, (turn - 1) % {n} AS shard FROM f WHERE turn > 0)
SELECT doc_id, d.slot::INTEGER AS slot, shard::INTEGER AS shard FROM (SELECT doc_id, {number.format("coalesce(doc_id::VARCHAR, chr(92) || 'N')")} % {m} AS slot FROM documents) d JOIN l ON d.slot = l.slot"""


SHARDING = _sharding()


def _components(edges: str, ids: str) -> str:
    """Reachability over ``edges`` (a, b, both ways), which stay within small groups here."""
    return f"{edges}, reach AS (SELECT {ids} AS a, {ids} AS b FROM base UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)"


EMBEDDINGS = f"""WITH RECURSIVE base AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
ok AS (SELECT vec_id, v FROM base WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: abs(x))) > 0),
{_components("e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.9)", "vec_id")}
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept FROM base JOIN comp ON comp.a = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) c ON c.a = vec_id"""

NEAR_DUPLICATES = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_fold("coalesce(text, '')")}, '{_SPACES}') AS w FROM documents),
sh AS (SELECT doc_id, md5(array_to_string(w[s:s + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS s FROM words WHERE len(w) > 0)),
x AS (SELECT DISTINCT doc_id, g FROM sh), base AS (SELECT doc_id, count(g) AS n FROM words LEFT JOIN x USING (doc_id) GROUP BY 1),
{_components("e AS (SELECT c.a, c.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM x p JOIN x q USING (g) WHERE p.doc_id <> q.doc_id GROUP BY ALL) c JOIN base i ON i.doc_id = a JOIN base j ON j.doc_id = b WHERE 100 * c.n >= 85 * (i.n + j.n - c.n))", "doc_id")}
SELECT doc_id, n AS n_shingles, component_id, component_id = doc_id AS kept FROM base JOIN comp ON comp.a = doc_id"""

_URL = r"(?s)^.*?://"


def _urls() -> str:
    rules = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")))
    query = f"list_sort(list_filter(string_split(regexp_extract(u, '{_URL}[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')))"
    return f"""WITH p AS (SELECT page_id, html, coalesce(url, '') AS u, {_fold(f"regexp_extract(u, '{_URL}([^/?#]*)', 1)")} AS host, regexp_extract(u, '{_URL}[^/?#]*([^?#]*)', 1) AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^www\\.|:(80|443)\\z', '', 'g') || rtrim(regexp_replace(path, '(/index)?\\.html?\\z', ''), '/') || CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END AS whole FROM p),
l AS (SELECT DISTINCT whole FROM c WHERE whole <> '' AND contains(html, '%%%') AND contains(html, '$$$') AND contains(html, '***')),
r(verdict, host, path) AS (VALUES {rules}),
f AS (SELECT page_id, u, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict FROM (SELECT DISTINCT page_id, u, host, path FROM c) c JOIN r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path) GROUP BY 1, 2)
SELECT c.page_id, c.host, c.path, rule, coalesce(f.verdict, CASE WHEN l.whole IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, nullif(c.whole, '') AS canonical, l.whole IS NOT NULL AS listed
FROM c LEFT JOIN f ON f.page_id = c.page_id AND f.u = c.u LEFT JOIN l ON l.whole = c.whole"""


URLS = _urls()

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RANKED = f"""WITH d AS (SELECT doc_id, {_fold("unnest(regexp_extract_all(text, '" + _TERMS + "'))")} AS term FROM documents),
i AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, {_fold("unnest(regexp_extract_all(text, '" + _TERMS + "'))")} AS term FROM benchmark) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM n),
p AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), s),
g AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))))::BIGINT AS score FROM p JOIN w USING (term) JOIN n USING (doc_id) JOIN i USING (term), s GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM g WHERE score > 0) WHERE rank <= 20"""


def _merkle() -> str:
    """Both trees with their levels written out: six of 16 a source, five over the sources."""
    def field(x: str) -> str:
        return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {step}), 4294967295)"
    lower = _fold("text")
    parts = [f"d AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS other FROM documents)"]
    parts.append("a0 AS MATERIALIZED (SELECT coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, leaf AS h, doc_id, other FROM d)")
    levels = {"a": 6, "b": 5}
    for t, deep in levels.items():
        if t == "b":
            parts.append("b0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n, h, g AS name FROM a6)")
        for k in range(deep):
            parts.append(f"{t}{k + 1} AS MATERIALIZED (SELECT g, i // 16 AS i, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {t}{k} GROUP BY g, i // 16)")
    # every row carries its place, its hash as recomputed, and the siblings so far
    parts.append("m0 AS (SELECT g, i, doc_id, h AS leaf, coalesce(other, h) AS f, '' AS proof FROM a0)")
    last = 0
    for t, deep in levels.items():
        if t == "b":
            parts.append(f"m{last + 1} AS (SELECT b0.g, b0.i, m.g AS name, doc_id, leaf, f, proof FROM m{last} m JOIN b0 ON b0.name = m.g)")
            last += 1
        for k in range(deep):
            keep = "doc_id, leaf" + (", name" if t == "b" else "")
            parts.append(f"""m{last + 1} AS MATERIALIZED (SELECT m.g, m.i // 16 AS i, {', '.join('m.' + c for c in keep.split(', '))}, CASE WHEN any_value(x.n) = 1 THEN any_value(m.f) ELSE sha256(string_agg(CASE WHEN x.i = m.i THEN m.f ELSE x.h END, '' ORDER BY x.i)) END AS f,
any_value(m.proof) || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i <> m.i), '') AS proof FROM (SELECT *, row_number() OVER () AS r FROM m{last}) m JOIN {t}{k} x ON x.g = m.g AND x.i // 16 = m.i // 16 GROUP BY m.r, m.g, m.i, {', '.join('m.' + c for c in keep.split(', '))})""")
            last += 1
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, a6.h AS subroot, b5.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b5.h AS verified FROM m{last} JOIN a6 ON a6.g = name, b5"


MERKLE = _merkle()

SQL = {
    "op2_secrets": SECRETS,
    "op3_substrings": SUBSTRINGS,
    "op4_mixing": MIXING,
    "op5_suffix_array": SUFFIX_ARRAY,
    "op7_sharding": SHARDING,
    "op8_embeddings": EMBEDDINGS,
    "op10_near_duplicates": NEAR_DUPLICATES,
    "op1_decontaminate": DECONTAMINATE,
    "op11_urls": URLS,
    "op12_ranked": RANKED,
    "op13_merkle": MERKLE,
}
