"""DuckDB SQL that gives the same rows as the queries of this subpackage, for those that SQL can express."""

from __future__ import annotations

from lattica.llm import licenses, secrets, urlfilter

#: The six characters that the contracts strip or split at.
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(f.keeper <> l.doc_id, FALSE) AS gone
  FROM keyed l LEFT JOIN frequent f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MATCHES = " UNION ALL ".join(
    f"""SELECT doc_id, {_quoted(r.kind)} AS kind, {place} AS place, {r.least} AS least,
               unnest(string_split_regex(t, {_quoted(r.pattern)})) AS gap,
               unnest(regexp_extract_all(t, {_quoted(r.pattern)}) || [NULL]) AS hit,
               unnest(regexp_extract_all(t, {_quoted(r.pattern)}, {r.group}) || [NULL]) AS counts,
               unnest(range(len(regexp_extract_all(t, {_quoted(r.pattern)})) + 1)) AS k
        FROM texts WHERE regexp_matches(t, {_quoted(r.pattern)})"""
    for place, r in enumerate(secrets.RULES)
)
SECRET_SCAN = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), hits AS ({_MATCHES}
), placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, place ORDER BY k) AS stop FROM hits WHERE hit IS NOT NULL
), spans AS (
  SELECT doc_id, kind, place, CAST(stop - length(hit) AS BIGINT) AS start,
         kind || ':' || CAST(CAST(stop - length(hit) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) AS span
  FROM placed WHERE length(counts) >= least
), found AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS c,
         count(*) FILTER (WHERE kind = 'hex') AS h,
         string_agg(span, ',' ORDER BY start, place) FILTER (WHERE place < 3) AS base,
         string_agg(span, ',' ORDER BY start, place) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_SHINGLES = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))"
DECONTAMINATION = f"""
WITH item AS (
  SELECT item_id, {_SHINGLES} AS sh, len(w) - 4 AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) >= 5
), doc AS (
  SELECT doc_id, {_SHINGLES} AS sh, len(w) - 4 AS total FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= 5
), ish AS (SELECT item_id, n, unnest(sh) AS h FROM item
), icount AS (SELECT item_id, n, h, count(*) AS c FROM ish GROUP BY ALL
), dsh AS (SELECT doc_id, total, unnest(sh) AS h, unnest(range(len(sh))) AS pos FROM doc
), hit AS (SELECT doc_id, total, item_id, n, pos, i.h, c FROM dsh d JOIN icount i ON d.h = i.h
), win AS (SELECT DISTINCT doc_id, item_id, n, least(n, total) AS m, least(pos, greatest(total - n, 0)) AS start FROM hit
), inside AS (
  SELECT w.doc_id, w.item_id, w.n, w.m, w.start, h.h, least(count(*), any_value(h.c)) AS common
  FROM win w JOIN hit h ON w.doc_id = h.doc_id AND w.item_id = h.item_id AND h.pos >= w.start AND h.pos < w.start + w.n
  GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, start, CAST(sum(common) AS DOUBLE) / CAST(any_value(m) + any_value(n) - sum(common) AS DOUBLE) AS similarity
  FROM inside GROUP BY doc_id, item_id, start
)
SELECT doc_id, item_id, max(similarity) AS similarity,
       CAST(min(start) FILTER (WHERE similarity = best) AS INTEGER) AS start
FROM (SELECT *, max(similarity) OVER (PARTITION BY doc_id, item_id) AS best FROM scored)
WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""


#: Levels of the tree that the SQL spells out; the paths of the test tables have fewer segments.
_LEVELS = 8


def _differs(labels: str, bad: str, n: str, b: str) -> str:
    share = f"({b} / {n})"
    return f"""coalesce({labels} >= {urlfilter.MIN_LABELS} AND abs({bad} / {labels} - {share}) >
        {urlfilter.MAX_Z} * sqrt(({share} * (1 - {share}) + 1 / ({n} + 4)) / {labels}), FALSE)"""


def _levels() -> str:
    """The template tree, a step for each level: tree0 to treeN."""
    steps = ["tree0 AS (SELECT host, shape, pages, labels, bad, string_split(shape, '/') AS s, '' AS t FROM shapes)"]
    for k in range(_LEVELS):
        segment = f"s[{k + 2}]"
        steps.append(
            f"""node{k} AS (
              SELECT host, t, {segment} AS seg, sum(pages) AS pages, sum(labels)::DOUBLE AS labels, sum(bad)::DOUBLE AS bad FROM tree{k} GROUP BY ALL
            ), above{k} AS (
              SELECT *, sum(pages) OVER w AS ap, sum(labels) OVER w AS al, sum(bad) OVER w AS ab FROM node{k} WHERE seg IS NOT NULL
              WINDOW w AS (PARTITION BY host, t)
            ), lit{k} AS (
              SELECT *, NOT contains(seg, '#') AND seg <> '' AND pages >= {urlfilter.MIN_PAGES}
                AND (pages >= {urlfilter.MIN_SHARE} * ap OR {_differs("labels", "bad", "al", "ab")}) AS literal FROM above{k}
            ), prev{k} AS (
              SELECT host, t, seg, labels, bad, lag(labels) OVER w AS n, lag(bad) OVER w AS b FROM lit{k}
              WHERE literal AND labels >= {urlfilter.MIN_LABELS} WINDOW w AS (PARTITION BY host, t ORDER BY bad / labels, seg)
            ), begin{k} AS (
              SELECT *, coalesce(abs(bad / labels - b / n) > {urlfilter.MAX_Z} * sqrt(((bad + b) / (labels + n) * (1 - (bad + b) / (labels + n))
                + 1 / (labels + n + 4)) * (1 / labels + 1 / n)), TRUE) AS begins FROM prev{k}
            ), grp{k} AS (
              SELECT *, sum(begins::INT) OVER (PARTITION BY host, t ORDER BY bad / labels, seg) AS g FROM begin{k}
            ), merged{k} AS (
              SELECT host, t, seg, min(seg) OVER w AS first, count(*) OVER w AS size, sum(('0x' || substr(md5(seg), 1, 8))::BIGINT) OVER w AS code FROM grp{k} WINDOW w AS (PARTITION BY host, t, g)
            ), named{k} AS (
              SELECT l.host, l.t, l.seg, CASE WHEN l.seg = '' THEN '/' WHEN size > 1 THEN '/{{' || first || '+' || (size - 1) || '~' || code || '}}'
                WHEN literal THEN '/' || CASE WHEN l.seg[1] IN ('{{', '*', chr(92)) THEN chr(92) ELSE '' END || l.seg ELSE '/*' END AS step
              FROM lit{k} l LEFT JOIN merged{k} m ON l.host = m.host AND l.t = m.t AND l.seg = m.seg
            ), tree{k + 1} AS (
              SELECT a.host, shape, a.pages, a.labels, a.bad, s, a.t || coalesce(step, '') AS t
              FROM tree{k} a LEFT JOIN named{k} n ON a.host = n.host AND a.t = n.t AND {segment} = seg
            )"""
        )
    return ",\n".join(steps)


_RULE = " ".join(
    f"""WHEN (host = {_quoted(r.split("/", 1)[0])} OR ends_with(host, {_quoted("." + r.split("/", 1)[0])}))
        AND starts_with(path, {_quoted("/" + r.split("/", 1)[1])}) THEN {_quoted(r)}"""
    for r in sorted(urlfilter.RULES, key=lambda r: (-len(r), r))
)
_BLOCKED = ", ".join(_quoted(r) for r, v in urlfilter.RULES.items() if v == "block")
URL_FILTERS = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 2) AS path FROM cut
), ruled AS (SELECT *, CASE {_RULE} END AS rule, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM parsed
), shapes AS (
  SELECT host, shape, count(*) AS pages, count(rule) AS labels, count(*) FILTER (WHERE rule IN ({_BLOCKED})) AS bad FROM ruled GROUP BY ALL
), {_levels()},
single AS (SELECT host, t AS template, sum(labels) AS labels, sum(bad) AS bad FROM tree{_LEVELS} GROUP BY ALL
), overall AS (SELECT coalesce(sum(bad) / nullif(sum(labels), 0), 0) AS prior FROM single
), site AS (SELECT template, regexp_extract(host, '([^.]*\\.)?[^.]*$') AS site, sum(bad) / sum(labels) AS share FROM single WHERE labels > 0 GROUP BY ALL
), pool AS (SELECT template, count(*) AS sites, sum(share) AS total FROM site GROUP BY template
), stats AS (
  SELECT host, template, round((bad + {urlfilter.PRIOR_WEIGHT}::DOUBLE * (coalesce(total, 0) + prior) / (coalesce(sites, 0) + 1)) / (labels + {urlfilter.PRIOR_WEIGHT}::DOUBLE), 9) AS purity,
         labels > 0 OR coalesce(sites, 0) >= {urlfilter.MIN_SITES} AS evident
  FROM single LEFT JOIN pool USING (template), overall
)
SELECT page_id, r.host, path, rule, CASE WHEN coalesce(rule IN ({_BLOCKED}), evident AND purity >= {urlfilter.MIN_PURITY}) THEN 'block' ELSE 'allow' END AS verdict,
       g.template, CAST(purity AS DOUBLE) AS purity
FROM ruled r JOIN tree{_LEVELS} p ON r.host = p.host AND r.shape = p.shape JOIN stats g ON p.host = g.host AND p.t = g.template
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ASCII_PARTED = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: n, label, base, k, length, near of each template, and its words.
_TEMPLATES = ", ".join(
    f"({n}, '{t.label}', {t.base}, {t.k}, {len(t.words)}, {t.near}, '{' '.join(t.words)}')" for n, t in enumerate(licenses.TEMPLATES)
)

LICENSE_SCAN = f"""
WITH template(n, label, base, k, length, near, text) AS (VALUES {_TEMPLATES}),
gram AS (
  SELECT n, k, t, array_to_string(list_slice(string_split(text, ' '), t + 1, t + k), ' ') AS gram
  FROM (SELECT *, unnest(range(length - k + 1)) AS t FROM template)
), worded AS (
  SELECT row_number() OVER () AS row, doc_id, {_ASCII_PARTED} AS words FROM documents
), window_ AS (
  SELECT row, k, p, array_to_string(list_slice(words, p + 1, p + k), ' ') AS gram
  FROM (SELECT row, words, k, unnest(range(greatest(len(words) - k + 1, 0))) AS p
        FROM worded, (VALUES ({licenses.SHORT}), ({licenses.LONG})) AS size(k))
), hit AS (
  SELECT row, n, p, t, p - t AS diagonal FROM window_ JOIN gram USING (k, gram)
), diagonal AS (
  SELECT row, n, diagonal, min(p) AS start, max(p) + any_value(k) AS stop, list(t) AS ts
  FROM hit JOIN template USING (n) GROUP BY row, n, diagonal
), stepped AS (
  SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY row, n ORDER BY diagonal) AS step FROM diagonal
), islanded AS (
  SELECT s.*, sum(CASE WHEN step <= near THEN 0 ELSE 1 END) OVER (PARTITION BY row, n ORDER BY diagonal) AS island
  FROM stepped s JOIN template USING (n) WHERE near > 0
), candidate AS (
  SELECT row, n, start, stop, ts FROM diagonal
  UNION ALL
  SELECT row, n, min(start), max(stop), flatten(list(ts)) FROM islanded GROUP BY row, n, island HAVING count(*) > 1
), rated AS (
  SELECT row, n, start, label, base, length, near,
         len(list_distinct(flatten(list_transform(ts, lambda t: range(t, t + k))))) AS matched,
         greatest(length, stop - start) AS longer
  FROM candidate JOIN template USING (n)
), span AS (
  SELECT row, label, base, start, (matched::DOUBLE / longer) * matched / (matched + {licenses.HALF}) AS score
  FROM rated WHERE CASE WHEN near = 0 THEN matched = length ELSE matched::DOUBLE / longer >= {licenses.LEAST} END
)
SELECT doc_id, any_value(len(words))::BIGINT AS n_words, count(start) FILTER (WHERE base) AS n_base,
       (min(start) FILTER (WHERE base))::BIGINT AS first_word, (max(start) FILTER (WHERE base))::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0) AS score
FROM worded LEFT JOIN span USING (row) GROUP BY row, doc_id
"""

#: The table of CRC-32 comes from its polynomial; the words of both tables are summed up once each.
IMPORTANCE = f"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM range(256) AS r(i)
), document AS (
  SELECT row_number() OVER () AS row, doc_id, {_ASCII_PARTED} AS words FROM documents
), source AS (
  SELECT row, unnest(words) AS word FROM document
), target AS (
  SELECT unnest({_ASCII_PARTED}) AS word FROM benchmark
), bytes AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM source UNION SELECT word FROM target)
), hashed AS (
  SELECT word, xor(list_reduce(
           list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT)),
           lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc
), s AS (
  SELECT bucket, count(*) AS n FROM source JOIN hashed USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM target JOIN hashed USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM source) + 10000)::DOUBLE
                     / ((s.n + 1.0::DOUBLE) * ((SELECT count(*) FROM target) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), weighed AS (
  SELECT row, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM source JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY row
), scored AS (
  SELECT row, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM document LEFT JOIN weighed USING (row)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (WHERE n_features >= 20) OVER () AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""
