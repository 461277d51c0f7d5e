"""SQL twins of the registered queries."""

from __future__ import annotations

from .op7_sharding import DIGITS, SHARDS, SLOTS, lookup_table

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP7 = f"""
WITH slots AS (SELECT unnest({lookup_table(SHARDS, SLOTS)}) AS shard, unnest(range({SLOTS})) AS slot),
placed AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {DIGITS}) AS BIGINT) % {SLOTS} AS INTEGER) AS slot
  FROM documents)
SELECT placed.doc_id, placed.slot, slots.shard FROM placed JOIN slots USING (slot)
"""

OP10 = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), '')
    || '/' || md5(coalesce(text, '')) || '/' || row_number() OVER (PARTITION BY doc_id, source, coalesce(text, ''))) AS digest
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source),
w AS (SELECT *, CAST([5.0, 2.0, 1.0][CAST(rank % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, rank, source_size, CASE WHEN cap / weight <= level THEN CAST(cap AS DOUBLE)
    ELSE weight * (SELECT arg_min(level, (cap / weight, rank)) FROM l WHERE cap / weight > level) END AS target
  FROM l),
r AS (
  SELECT d.doc_id, d.size, d.digest, t.rank, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.digest, d.doc_id, d.size) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT r.*, turn, CAST(turn * source_size + upto AS DOUBLE) / target AS finish
  FROM r CROSS JOIN (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0),
k AS (
  SELECT rank, digest, sum(size) OVER (ORDER BY finish, rank, turn, digest, doc_id, size) <= (SELECT sum(target) FROM t) AS fits
  FROM q),
c AS (SELECT rank, digest, count(*) FILTER (WHERE fits) AS copies FROM k GROUP BY ALL)
SELECT r.doc_id, r.size, r.source_size, r.target, CAST(r.size * coalesce(c.copies, 0) AS BIGINT) AS taken
FROM r LEFT JOIN c USING (rank, digest)
"""


OP4 = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\\\*\\|')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

OP6 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS bytes, sha1(payload) AS digest, sha256(payload) AS strong FROM p),
g AS (SELECT digest, strong, max(page_id) AS first FROM d WHERE bytes >= 1000 GROUP BY ALL)
SELECT d.page_id, CAST(d.bytes AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN g.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.first <> d.page_id THEN g.first END AS refers_to
FROM d LEFT JOIN g ON d.digest = g.digest AND d.strong = g.strong AND d.bytes >= 1000
"""



def _crc_table() -> list[int]:
    """The table of CRC-32 with the reversed polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


def _edit(state: str, cost: str, letter: str, put: str | None) -> str:
    text = f"{state}.r || chr(10) || {put}" if put else f"{state}.r"
    return f"{{'c': CAST({state}.c + {cost} AS BIGINT), 'a': {state}.a || '{letter}', 'r': {text}}}"


def _least(*found: str) -> str:
    return f"list_min([{', '.join(found)}])"


def _insert(state: str, role: str) -> str:
    return _edit(state, "5", "I", f"'{role}:'")


FAR = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'r': ''}"
CLOSED = f"""SELECT * REPLACE ({_least("s3", _insert("s2", "assistant"))} AS s3) FROM (
    SELECT * REPLACE ({_least("s2", *[_insert(s, "user") for s in ("s0", "s1", "s3")])} AS s2) FROM r)"""


def _after(state: str, *more: str) -> str:
    """The state after a row: deletion, or one of ``more`` where the row may stay."""
    kept = _least(_edit(state, "2", "D", None), *more)
    return f"CASE WHEN gone THEN {_edit(state, '2', 'D', None)} ELSE {kept} END AS {state}"


def _keep(state: str, code: str) -> str:
    return f"CASE WHEN code = '{code}' THEN {_edit(state, 'more', 'K', 'line')} END"


def _rerole(state: str, role: str) -> str:
    return _edit(state, "1 + more", "R", f"'{role}:' || text")


OP13 = f"""
WITH RECURSIVE crc AS (SELECT {_crc_table()}::BIGINT[] AS places),
c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
f AS (
  SELECT c.*, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: xor(a >> 8, places[(xor(a, b) & 255) + 1]))) % 20 AS fault
  FROM c, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM f WHERE fault <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
k AS (
  SELECT *, substr(role, 1, 1) AS code, role || ':' || text AS line, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS kind
  FROM n),
x AS (SELECT *, kind IN ('blank', 'duplicate') AS gone, CASE WHEN kind = 'truncated' THEN 5 ELSE 0 END AS more FROM k),
r AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}} AS s0, {FAR} AS s1, {FAR} AS s2, {FAR} AS s3
  FROM conversations
  UNION ALL
  SELECT q.conv_id, x.i, {_after("s0")}, {_after("s1", _keep("s0", "s"))},
    {_after("s2", *[f(s, a) for s in ("s0", "s1", "s3") for f, a in ((_keep, "u"), (_rerole, "user"))])},
    {_after("s3", _keep("s2", "a"), _rerole("s2", "assistant"))}
  FROM ({CLOSED}) q JOIN x ON x.conv_id IS NOT DISTINCT FROM q.conv_id AND x.i = q.i + 1),
e AS (
  SELECT conv_id, {_least("s0", "s3")} AS best FROM ({CLOSED}) q QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE kind = 'blank') AS blank,
    count(*) FILTER (WHERE kind = 'duplicate') AS duplicate, count(*) FILTER (WHERE kind = 'truncated') AS truncated,
    count(*) FILTER (WHERE i > 1 AND previous || code NOT IN ('su', 'ua', 'au')) AS illegal
  FROM x GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(substr(best.r, 2)) AS repaired_sha256
FROM e LEFT JOIN g ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""

#: The true nearest rows: the hashing misses one with a chance of some 1e-5 per neighbour at most.
OP11 = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))
    AND list_bool_or(list_transform(embedding, lambda c: c <> 0))),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""

ORACLE: dict[str, str] = {"op4_chat": OP4, "op6_warc": OP6, "op7_sharding": OP7, "op10_mixing": OP10, "op11_neighbours": OP11, "op13_repair": OP13}
