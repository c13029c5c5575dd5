"""DuckDB statements for the numbered queries that SQL can express."""

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH n AS (SELECT doc_id, {_LOWER.format('text')} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def _shingles(table: str, key: str, word: str) -> str:
    """Distinct five-word shingles (key, g) of a table's texts."""
    return f"""
  SELECT DISTINCT {key}, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
         ELSE array_to_string(w[k:k + 4], ' ') END AS g
  FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM (
    SELECT {key}, regexp_extract_all({_LOWER.format('text')}, '{word}') AS w FROM {table})
    WHERE len(w) > 0)"""


NGRAM_JOIN = f"""
WITH RECURSIVE s AS MATERIALIZED ({_shingles('documents', 'doc_id', '[^ \\t\\n\\x0B\\f\\r]+')}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
                        GROUP BY ALL) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * o >= 80 * (na.n + nb.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, link.b FROM reach r JOIN link ON link.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY ALL
"""

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
DECONTAMINATION = f"""
WITH q AS MATERIALIZED ({_shingles('benchmark', 'item_id', _WORD)}),
short AS (SELECT DISTINCT len(string_split(g, ' ')) AS m FROM q WHERE len(string_split(g, ' ')) < 5),
s AS MATERIALIZED ({_shingles('documents', 'doc_id', _WORD)}
  UNION SELECT doc_id, array_to_string(w[k:k + m - 1], ' ') FROM (
    SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM (
      SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '{_WORD}') AS w FROM documents) CROSS JOIN short)),
n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id),
c AS (SELECT s.doc_id, q.item_id, count(*) AS n_common FROM s JOIN q ON q.g = s.g GROUP BY ALL)
SELECT c.doc_id, c.item_id, n.n_item, c.n_common FROM c JOIN n ON n.item_id = c.item_id WHERE 100 * n_common >= 80 * n_item
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""



def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _crc32(text: str) -> str:
    """CRC-32 bit by bit, with inverted start and end."""
    bit = "list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), " \
          "lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda t: ascii(t)::BIGINT), " \
           f"lambda c, x: {bit}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _merkle(below: int = 6, above: int = 4) -> str:
    """Levels written out: groups of up to 16 ** below leaves, up to 16 ** above groups."""
    run = "PARTITION BY tree, place // 16 ORDER BY place ROWS BETWEEN"
    level = f"""SELECT *, count(*) OVER (PARTITION BY tree) AS cnt,
      coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM"""
    up = "SELECT tree, place // 16 AS place, sha256(string_agg(d, '' ORDER BY place)) AS d FROM"

    def tower(name, start, height):
        out = [f"{name}0 AS MATERIALIZED ({level} {start})"]
        out += [f"{name}{k + 1} AS MATERIALIZED ({level} ({up} {name}{k} WHERE cnt > 1 GROUP BY ALL))" for k in range(height)]
        last = " UNION ALL ".join(f"SELECT tree, d FROM {name}{k} WHERE cnt = 1" for k in range(height + 1))
        return ",\n".join([*out, f"{name}_last AS MATERIALIZED ({last})"])

    tables = [f"n{k}" for k in range(below)] + [f"t{k}" for k in range(above)]
    joins = "".join(f"\nLEFT JOIN n{k} ON n{k}.tree = f.tree AND n{k}.place = f.place // {16 ** k} AND n{k}.cnt > 1" for k in range(below))
    joins += "".join(f"\nLEFT JOIN t{k} ON t{k}.place = f.tree // {16 ** k} AND t{k}.cnt > 1" for k in range(above))
    folded, proof = "shown", " || ".join(f"coalesce({t}.l || {t}.r, '')" for t in tables)
    steps = []
    for i, t in enumerate(tables):
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT *, CASE WHEN l{i} IS NULL THEN f{i} ELSE sha256(l{i} || f{i} || r{i}) END AS f{i + 1} FROM s{i})")
        folded = f"f{i + 1}"
    sides = ", ".join(f"{t}.l AS l{i}, {t}.r AS r{i}" for i, t in enumerate(tables))
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    values = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
    return f"""
WITH leaf AS (SELECT doc_id, source, sha256({values} || {_field('text')}) AS leaf,
  CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN sha256({values} || {_field(text)}) END AS other FROM documents),
f AS MATERIALIZED (SELECT doc_id, leaf, coalesce(other, leaf) AS shown, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaf),
{tower('n', '(SELECT tree, place, leaf AS d FROM f)', below)},
{tower('t', '(SELECT -1 AS tree, tree AS place, d FROM n_last)', above)},
s0 AS MATERIALIZED (SELECT f.doc_id, f.leaf, f.tree, f.shown AS f0, sha256({proof}) AS proof_sha256, {sides} FROM f {joins}),
{", ".join(steps)}
SELECT s.doc_id, s.leaf, n_last.d AS subroot, t_last.d AS root, s.proof_sha256, s.{folded} AS folded_root,
       s.{folded} = t_last.d AS verified
FROM s{len(tables)} s JOIN n_last ON n_last.tree = s.tree JOIN t_last ON true
"""


SQL = {
    "op2_exact_dedup": EXACT_DEDUP,
    "op3_decontamination": DECONTAMINATION,
    "op4_ngram_join": NGRAM_JOIN,
    "op10_warc": WARC,
    "op11_merkle": _merkle(),
}
