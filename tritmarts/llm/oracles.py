"""The queries that SQL can state, in SQL."""

OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
hashed AS (
  SELECT *, md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size::VARCHAR || '|' || md5(coalesce(text, ''))) AS h
  FROM sized),
d AS (
  SELECT doc_id, source, size, ('0x' || substr(h, 1, 6))::BIGINT % 1024 AS block, ('0x' || substr(h, 7, 15))::BIGINT AS fine,
         row_number() OVER (PARTITION BY source, h) AS nth
  FROM hashed),
s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, source_size * 2 AS cap,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s0),
s2 AS (
  SELECT *, row_number() OVER o AS place,
         (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM s1 WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
s3 AS (
  SELECT *, min(CASE WHEN cap > level * weight THEN place END) OVER () AS opened FROM s2),
goal AS (
  SELECT source, source_size,
         CASE WHEN opened IS NULL OR place < opened THEN cap::DOUBLE
              ELSE weight * (SELECT level FROM s3 x WHERE x.place = x.opened) END AS target FROM s3),
parts AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM goal),
blocks AS (
  SELECT source, block, words, target - epochs * source_size AS rest,
         sum(words) OVER (PARTITION BY source ORDER BY block) - words AS ahead
  FROM (SELECT source, block, sum(size) AS words FROM d GROUP BY ALL) JOIN parts USING (source)
  WHERE source IS NOT NULL
  UNION ALL
  SELECT NULL, block, words, target - epochs * source_size, sum(words) OVER (ORDER BY block) - words
  FROM (SELECT block, sum(size) AS words FROM d WHERE source IS NULL GROUP BY ALL), parts WHERE source IS NULL),
fines AS (
  SELECT d.source, d.fine, count(*) AS n, sum(d.size) AS words,
         b.rest - b.ahead - sum(sum(d.size)) OVER (PARTITION BY d.source ORDER BY d.fine) + sum(d.size) AS room
  FROM d JOIN blocks b ON d.block = b.block AND d.source IS NOT DISTINCT FROM b.source
  WHERE b.ahead < b.rest AND b.ahead + b.words > b.rest GROUP BY d.source, d.fine, b.rest, b.ahead),
cuts AS (
  SELECT source, fine, CASE WHEN words > 0 THEN floor(room * n / words + 0.5) WHEN room >= 0 THEN n ELSE 0 END AS fits FROM fines)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.epochs + CASE WHEN b.ahead + b.words <= b.rest THEN 1
                                  WHEN b.ahead < b.rest AND d.nth <= c.fits THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
JOIN blocks b ON d.block = b.block AND d.source IS NOT DISTINCT FROM b.source
LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source AND d.fine = c.fine
"""


def _kind(no: int, kind: str, pattern: str, keep: str = "true") -> str:
    return f"""
SELECT doc_id, {no} AS no, '{kind}' AS kind, s AS start, s + length(m) AS stop FROM (
  SELECT doc_id, m, gap_sum + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (
    SELECT rid, doc_id, i, hits[i] AS m, sum(length(gaps[i])) OVER (PARTITION BY rid ORDER BY i) AS gap_sum
    FROM (SELECT rid, doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
          FROM (SELECT rid, doc_id, regexp_extract_all(text, '{pattern}') AS hits,
                       regexp_split_to_array(text, '{pattern}') AS gaps FROM t))))
WHERE {keep}"""


_WORDS = ("[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
          "|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]")
_HEAD = rf"""(?:{_WORDS})["'']?\x20*[:=]\x20*["'']?"""

OP5 = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join([
    _kind(0, "assign", _HEAD + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(m, '^{_HEAD}', '')) >= 6"),
    _kind(1, "access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    _kind(2, "hex", "[0-9a-f]+", "length(m) >= 24"),
    _kind(3, "private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    _kind(4, "github", "gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
    _kind(5, "slack", "xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 15"),
    _kind(6, "google", "AIza[A-Za-z0-9_-]{35}"),
    _kind(7, "jwt", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}")])}),
joined AS (
  SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access,
         count(*) FILTER (no = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no, stop) FILTER (no < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no, stop) AS spans
  FROM spans GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN joined ON documents.doc_id = joined.doc_id
"""

_USABLE = ("vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"
           " AND len([x for x in embedding if x <> 0]) > 0")

OP3 = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_USABLE}),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP9 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN counts ON vec_id = counts.a WHERE vec_id IS NOT NULL
"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM f
"""

OP7 = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, (i - 1)::INT AS paragraph, coalesce(list_sum([length(x) + 1 for x in parts[1:i - 1]]), 0)::BIGINT AS start, parts[i] AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
p AS (
  SELECT *, len(w) AS n_words, array_to_string(w, ' ') AS joined FROM (
    SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM lines)
  WHERE len(w) >= 50),
c AS (SELECT joined, row_number() OVER () AS cid, any_value(w) AS w FROM p GROUP BY joined),
s AS (SELECT DISTINCT cid, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT cid, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM c)),
n AS (SELECT cid, count(*) AS n FROM s GROUP BY cid),
links AS (
  SELECT a, b FROM (SELECT x.cid AS a, y.cid AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.cid <> y.cid GROUP BY ALL)
  JOIN n na ON na.cid = a JOIN n nb ON nb.cid = b WHERE k >= 0.8 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT cid, cid FROM c UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
root AS (SELECT a AS cid, min(b) AS root FROM reach GROUP BY a),
m AS (SELECT p.*, root FROM p JOIN c USING (joined) JOIN root USING (cid)),
k AS (SELECT root, min((doc_id, paragraph)) AS kept FROM m GROUP BY root HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, paragraph, start, start + length(line) AS "end", n_words, kept[1] AS kept_doc_id, kept[2] AS kept_paragraph,
       (doc_id, paragraph) <> kept AS removed
FROM m JOIN k USING (root)
"""

# every window of 50 words is looked up in all documents; a word belongs to the least first place of the windows over it
OP7_RUNS = r"""
WITH t AS (
  SELECT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w,
         regexp_split_to_array(text, '[^\x20\x09-\x0D]+') AS gaps FROM documents WHERE text IS NOT NULL),
win AS (SELECT doc_id, i AS pos, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM t WHERE len(w) >= 50)),
firsts AS (SELECT h, min((doc_id, pos)) AS f FROM win GROUP BY h HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, pos, f[1] AS first_id, f[2] AS first_at, f[1] = doc_id AND pos - f[2] < 50 AS stays FROM win JOIN firsts USING (h)),
word AS (
  SELECT doc_id, x, min((stays, first_id, step)) AS k FROM (
    SELECT doc_id, stays, CASE WHEN stays THEN doc_id ELSE first_id END AS first_id, CASE WHEN stays THEN 0 ELSE first_at - pos END AS step,
           unnest(range(pos, pos + 50)) AS x FROM hit) GROUP BY doc_id, x),
stretch AS (
  SELECT doc_id, k, min(x) AS word, count(*) AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY doc_id, k ORDER BY x) AS island FROM word)
  GROUP BY doc_id, k, island),
spot AS (
  SELECT doc_id, word, n, k, list_sum(list_transform(gaps[1:word + 1], lambda g: len(g))) + coalesce(list_sum(list_transform(w[1:word], lambda g: len(g))), 0) AS start,
         list_sum(list_transform(gaps[1:word + n], lambda g: len(g))) + list_sum(list_transform(w[1:word + n], lambda g: len(g))) AS stop
  FROM stretch JOIN t USING (doc_id))
SELECT doc_id, 'run' AS unit, word::INT AS place, start::BIGINT AS start, stop::BIGINT AS "end", n::INT AS n_words, k[2] AS kept_doc_id,
       (word + k[3])::INT AS kept_place, NOT k[1] AS removed
FROM spot
"""

OP7_PASSAGES = f"""
SELECT doc_id, 'line' AS unit, paragraph AS place, start, "end", n_words::INT AS n_words, kept_doc_id, kept_paragraph AS kept_place, removed FROM ({OP7})
UNION ALL SELECT * FROM ({OP7_RUNS})
"""

_RUN = f"[A-Za-z{chr(0xC0)}-{chr(0xFF)}]+"

OP12 = f"""
WITH RECURSIVE crc_steps(b, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_steps WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '{_RUN}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hexed AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM counted),
summed AS (
  SELECT run, k, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM hexed, crc_table),
made AS (
  SELECT CASE WHEN crc % 31 = 0 THEN left(run, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, k
  FROM summed),
w AS (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (
  SELECT DISTINCT word, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM w)),
near AS (
  SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT cut.word, w.word FROM cut JOIN w ON cut.rest = w.word
  UNION SELECT w.word, cut.word FROM cut JOIN w ON cut.rest = w.word),
best AS (
  SELECT a, count(*) AS n_near, max(w.n) AS most, min((-w.n, b)) AS pick FROM near JOIN w ON w.word = b GROUP BY a),
told AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN most >= 10 * w.n THEN pick[2] END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n
  FROM w LEFT JOIN best ON a = w.word),
walk(word, place, step) AS (
  SELECT word, word, 0 FROM told
  UNION ALL SELECT walk.word, told.form, step + 1 FROM walk JOIN told ON told.word = walk.place WHERE told.form IS NOT NULL),
roots AS (SELECT word, max_by(place, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM told JOIN roots USING (word)
"""

#: runs of letters A to Z in either case and of all that is not ASCII
_TERM = "[^" + "".join(rf"\x{c:02X}" for c in range(0x80) if not chr(c).isalpha()) + "]+"

OP11 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS terms
  FROM documents),
t AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
lang_sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (
  SELECT lang, source, coalesce(x.n, 0) AS n, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM cells GROUP BY ALL) x USING (lang, source)
  LEFT JOIN lang_sizes USING (lang)),
p AS (
  SELECT grp.lang, grp.source, kept.term, coalesce(cells.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(cells.n, 0) + 1) // (grp.n + grp.v)::HUGEINT AS p,
         1 + 1000000000::HUGEINT * (kept.n + 1) // (s.n + s.v)::HUGEINT AS usual
  FROM grp JOIN kept ON grp.lang = kept.lang JOIN lang_sizes s ON s.lang = grp.lang
  LEFT JOIN cells ON cells.lang = grp.lang AND cells.source = grp.source AND cells.term = kept.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
told AS (
  SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, ((p - usual) * (p - usual) // usual)::BIGINT FROM p WHERE n > 0 AND p > usual),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM told)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
