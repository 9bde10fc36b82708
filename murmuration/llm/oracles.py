"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from murmuration.llm.chat import CHAT

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
r AS (SELECT t, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY t)
SELECT d.doc_id, r.keep_id, r.group_size, d.doc_id = r.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN r ON d.t = r.t
"""

DECONTAMINATION = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
iwin AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM iwin),
dwin AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
m AS (SELECT dwin.doc_id, dwin.k, dwin.i, iwin.item_id FROM dwin JOIN iwin USING (k, s)),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in CHAT.control:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


def _chat() -> str:
    around = len(CHAT.open) + len(CHAT.close)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_escaped('text')}) + {len(CHAT.sep)}
                + CASE WHEN opens THEN length({_escaped('role')}) + {around} ELSE 0 END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""


LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT r, i, ls[i] AS line, translate(trim(ls[i], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
s AS (
  SELECT r, count(*) - count(stay) AS n_dropped, string_agg(stay, chr(10) ORDER BY i) AS kept
  FROM (SELECT r, i, CASE WHEN c.k IS NULL THEN line END AS stay FROM l LEFT JOIN c ON l.k = c.k) GROUP BY r)
SELECT doc_id, len(ls) AS n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN s USING (r)
"""

PHRASES = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS head, array_to_string(list_slice(w, j + 1, k), ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, j, h.f AS l, t.f AS r, CAST((CAST(a AS HUGEINT) * 2000000) // (h.f + t.f) AS BIGINT) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS f FROM (
    SELECT lang, a, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase
    FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM c WHERE k > 2)))
  GROUP BY lang, phrase),
ranked AS (
  SELECT lowest.*, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, lowest.phrase) AS rank
  FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE inside.f IS NULL OR 100 * inside.f < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def oracles() -> dict[str, str]:
    return {
        "op3_exact_dedup": EXACT_DEDUP,
        "op4_decontamination": DECONTAMINATION,
        "op10_chat_formatting": _chat(),
        "op11_line_dedup": LINE_DEDUP,
        "op12_phrases": PHRASES,
    }
