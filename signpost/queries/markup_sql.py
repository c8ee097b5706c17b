"""Element tree of the benchmark pages in plain SQL: a stack machine over markup tokens.

Independent of the page reader; used only to state expected results.
"""

NODES = r"""
WITH RECURSIVE
tok0 AS (
  SELECT page_id, unnest(regexp_extract_all(html,
      '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]+>|[^<]+')) AS token,
    generate_subscripts(regexp_extract_all(html,
      '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]+>|[^<]+'), 1) AS i
  FROM pages
),
tok AS MATERIALIZED (
  SELECT page_id, CAST(i AS INTEGER) AS i, token,
    lower(regexp_extract(token, '^</?([a-zA-Z0-9]+)', 1)) AS tag,
    CASE WHEN token LIKE '<!%' THEN 'skip'
         WHEN token LIKE '<script%' OR token LIKE '<style%' THEN 'leaf'
         WHEN regexp_matches(token, '^<(br|meta|img|hr|input|link)\b') THEN 'leaf'
         WHEN token LIKE '</%' THEN 'close'
         WHEN token LIKE '<%' THEN 'open'
         ELSE 'text' END AS kind
  FROM tok0
),
run AS (
  SELECT page_id, 0 AS i, CAST([] AS STRUCT(seq INTEGER, tag VARCHAR)[]) AS stack, 0 AS n,
    CAST([] AS INTEGER[]) AS popped, -1 AS parent, 'skip' AS kind
  FROM pages
  UNION ALL
  SELECT page_id, i,
    CASE WHEN kind = 'open' THEN list_append(stack, {'seq': n, 'tag': tag})
         WHEN kind = 'close' AND k IS NOT NULL THEN stack[1:len(stack) - k]
         ELSE stack END,
    CASE WHEN kind IN ('open', 'leaf') THEN n + 1 ELSE n END,
    CASE WHEN kind = 'leaf' THEN [n]
         WHEN kind = 'close' AND k IS NOT NULL
           THEN list_transform(stack[len(stack) - k + 1:], lambda x: x.seq)
         ELSE CAST([] AS INTEGER[]) END,
    CASE WHEN len(stack) > 0 THEN stack[len(stack)].seq ELSE -1 END,
    kind
  FROM (
    SELECT r.page_id, t.i, r.stack, r.n, t.kind, t.tag,
      list_position(list_reverse(list_transform(r.stack, lambda x: x.tag)), t.tag) AS k
    FROM run r JOIN tok t ON t.page_id = r.page_id AND t.i = r.i + 1
  )
),
done AS MATERIALIZED (SELECT page_id, i, n, popped, parent, kind FROM run),
closed AS (SELECT page_id, i AS close_i, n - 1 AS end_seq, unnest(popped) AS seq FROM done),
total AS (SELECT page_id, max(n) AS n FROM done GROUP BY page_id),
pieces AS MATERIALIZED (
  SELECT page_id, i, piece FROM (
    SELECT page_id, i, trim(regexp_replace(
      regexp_replace(replace(replace(replace(token, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp(;|$)', '&', 'g'),
      '[\s\p{Z}\x0B\x1c-\x1f\x{85}]+', ' ', 'g')) AS piece
    FROM tok WHERE kind = 'text')
  WHERE piece <> ''
),
opened AS (
  SELECT d.page_id, d.n - 1 AS seq, d.i AS open_i, d.parent AS parent_seq, t.tag, t.token
  FROM done d JOIN tok t USING (page_id, i) WHERE d.kind IN ('open', 'leaf')
),
span AS (
  SELECT o.page_id, o.seq, COALESCE(c.end_seq, total.n - 1) AS end_seq, o.parent_seq, o.tag, o.open_i,
    COALESCE(c.close_i, 1000000000) AS close_i,
    CASE WHEN o.tag = 'a' AND o.token LIKE '%href=%'
         THEN regexp_extract(o.token, 'href="([^"]*)"', 1) END AS href
  FROM opened o JOIN total USING (page_id) LEFT JOIN closed c USING (page_id, seq)
),
nodes AS MATERIALIZED (
  SELECT s.page_id, s.seq, s.end_seq, s.parent_seq, s.tag, s.href,
    COALESCE(string_agg(p.piece, ' ' ORDER BY p.i), '') AS node_text
  FROM span s LEFT JOIN pieces p ON p.page_id = s.page_id AND p.i > s.open_i AND p.i < s.close_i
  GROUP BY ALL
),
page_text AS (
  SELECT g.page_id, COALESCE(string_agg(p.piece, ' ' ORDER BY p.i), '') AS whole
  FROM pages g LEFT JOIN pieces p USING (page_id) GROUP BY g.page_id
),
body AS (
  SELECT page_id, arg_min(seq, seq) AS seq, arg_min(end_seq, seq) AS end_seq, arg_min(node_text, seq) AS node_text
  FROM nodes WHERE tag = 'body' GROUP BY page_id
),
inside AS MATERIALIZED (
  SELECT n.* FROM nodes n JOIN body b USING (page_id) WHERE n.seq > b.seq AND n.seq <= b.end_seq
),
facts AS MATERIALIZED (
  SELECT g.page_id, g.url, 'https://' || regexp_extract(g.url, '//([^/?#]*)', 1) AS site,
    COALESCE(
      (SELECT arg_min(node_text, seq) FROM inside n WHERE n.page_id = g.page_id AND tag = 'h1'),
      (SELECT arg_min(node_text, seq) FROM nodes n WHERE n.page_id = g.page_id AND tag = 'h1'),
      (SELECT arg_min(node_text, seq) FROM nodes n WHERE n.page_id = g.page_id AND tag = 'title'), '') AS page_title,
    sha256(COALESCE((SELECT node_text FROM body b WHERE b.page_id = g.page_id), '')) AS content_hash
  FROM pages g
)
"""
