"""DuckDB SQL of the queries that SQL can express; the tables are views of the same names."""

from __future__ import annotations

_CONTROLS = r"\|(?:turn|text|end|image|audio|document)\|>|/?s>|/?INST\]|</?SYS>>"


def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, '([<\[])(\\*)({_CONTROLS})', '\1\\\2\3', 'g')"


CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, length({_escaped('role')}) + length({_escaped('text')}) + 23 AS shown_chars FROM turns),
chats AS (
  SELECT conv_id, count(*) AS n_turns, CAST(sum(shown_chars) AS BIGINT) AS formatted_chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned
  FROM shown GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learned) AS loss_chars,
  sha256(learned) AS loss_sha256, formatted_chars
FROM chats
"""


WORD = r"[^\x20\x09-\x0D]+"

#: Runs of lines with 50 words, or whole texts: from each line on and up to each line the shortest such
#: run, told by its text; all but the earliest place of a run lose its lines.
LINE_SQL = f"""
WITH texts AS (SELECT doc_id, string_split(text, chr(10)) AS said FROM documents),
counted AS (
  SELECT doc_id, said, unnest(range(len(said))) AS line,
    unnest(list_transform(said, lambda x: len(regexp_extract_all(x, '{WORD}')))) AS words FROM texts),
lines AS (
  SELECT doc_id, said, line, words, sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM counted),
spans AS (
  SELECT a.doc_id, a.line AS a, min(b.line) AS b FROM lines a JOIN lines b
    ON a.doc_id = b.doc_id AND b.line >= a.line AND b.upto - a.upto + a.words >= 50 GROUP BY ALL
  UNION
  SELECT a.doc_id, max(a.line) AS a, b.line AS b FROM lines a JOIN lines b
    ON a.doc_id = b.doc_id AND b.line >= a.line AND b.upto - a.upto + a.words >= 50 GROUP BY a.doc_id, b.line
  UNION
  SELECT doc_id, 0, max(line) FROM lines GROUP BY doc_id HAVING sum(words) > 0),
runs AS (
  SELECT s.doc_id, a, b, md5(array_to_string(said[a + 1 : b + 1], chr(10))) AS name FROM spans s JOIN texts t USING (doc_id)),
later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, b - a ORDER BY doc_id, a) AS place FROM runs) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS line FROM later),
islands AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM gone),
sizes AS (SELECT doc_id, run, count(*) AS n FROM islands GROUP BY doc_id, run),
totals AS (SELECT doc_id, sum(n)::BIGINT AS n_removed, count(*) AS n_runs, max(n) AS longest_run FROM sizes GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, string_agg(l.said[l.line + 1], chr(10) ORDER BY l.line) AS kept
  FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0) AS longest_run, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN totals USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SUBSTRING_SQL = f"""
WITH split_texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
windows AS (
  SELECT doc_id, place, array_to_string(words[place + 1 : place + 13], ' ') AS said
  FROM (SELECT doc_id, words, unnest(range(len(words) - 12)) AS place FROM split_texts)),
firsts AS (SELECT said, min(doc_id) AS first FROM windows GROUP BY said),
gone AS (
  SELECT doc_id, list(DISTINCT place) AS places FROM (
    SELECT w.doc_id, unnest(range(w.place, w.place + 13)) AS place
    FROM windows w JOIN firsts f USING (said) WHERE f.first < w.doc_id) GROUP BY doc_id),
judged AS (
  SELECT t.doc_id, words, list_filter(range(len(words)), lambda i: NOT list_contains(coalesce(places, []), i)) AS kept
  FROM split_texts t LEFT JOIN gone g USING (doc_id))
SELECT doc_id, len(words) AS n_words, len(words) - len(kept) AS n_removed,
  sha256(array_to_string(list_transform(kept, lambda i: words[i + 1]), ' ')) AS kept_sha256
FROM judged
"""

JACCARD_SQL = f"""
WITH RECURSIVE split_texts AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
    ELSE array_to_string(words[place + 1 : place + 5], ' ') END AS shingle
  FROM (SELECT doc_id, words, unnest(range(greatest(1, len(words) - 4))) AS place FROM split_texts WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT a AS node, a AS other FROM edges
  UNION SELECT r.node, e.b FROM reached r JOIN edges e ON e.a = r.other),
found AS (SELECT node, min(other) AS component FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN found ON node = d.doc_id
"""

#: Unsigned crc32 of an integer's decimal digits, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    return f"""
{name} AS (
  SELECT tree, 0 AS level, place, digest, total FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (total + 7) // 8
  FROM {name} WHERE total > 1 GROUP BY tree, level, place // 8, total)"""


def _runs(name: str, nodes: str) -> str:
    """Siblings before and after each node of its run."""
    return f"""
{name} AS (
  SELECT tree, level, place,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {nodes} WHERE total > 1 WINDOW w AS (PARTITION BY tree, level, place // 8 ORDER BY place))"""


MERKLE_SQL = f"""
WITH RECURSIVE given AS (
  SELECT doc_id, coalesce('v' || lang, 'n') AS tree, {_leaf('text')} AS digest,
    CASE WHEN {CRC_SQL.format('doc_id')} % 3 = 0
      THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS struck
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS total FROM given),{_tree('nodes', 'leaves')},
tops AS (
  SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS place, digest, count(*) OVER () AS total
  FROM nodes WHERE total = 1),{_tree('uppers', 'tops')},{_runs('runs', 'nodes')},{_runs('upper_runs', 'uppers')},
folded AS (
  SELECT doc_id, l.tree, l.place AS leaf_place, 0 AS step, l.place AS at, coalesce(struck, digest) AS digest, '' AS proof, false AS over
  FROM leaves l
  UNION ALL
  SELECT f.doc_id, f.tree, f.leaf_place, CASE WHEN r.tree IS NULL AND NOT f.over THEN 0 ELSE f.step + 1 END,
    CASE WHEN r.tree IS NOT NULL THEN f.at // 8 WHEN NOT f.over THEN t.place ELSE f.at // 8 END,
    CASE WHEN r.tree IS NOT NULL THEN sha256(r.before || f.digest || r.after) WHEN NOT f.over THEN f.digest
      ELSE sha256(u.before || f.digest || u.after) END,
    CASE WHEN r.tree IS NOT NULL THEN f.proof || r.before || r.after WHEN NOT f.over THEN f.proof
      ELSE f.proof || u.before || u.after END,
    r.tree IS NULL
  FROM folded f
  LEFT JOIN runs r ON NOT f.over AND r.tree = f.tree AND r.level = f.step AND r.place = f.at
  LEFT JOIN tops t ON t.name = f.tree
  LEFT JOIN upper_runs u ON f.over AND u.level = f.step AND u.place = f.at
  WHERE r.tree IS NOT NULL OR NOT f.over OR u.tree IS NOT NULL),
ends AS (
  SELECT tree, leaf_place, arg_max(digest, step) AS digest, arg_max(proof, step) AS proof
  FROM folded WHERE over GROUP BY tree, leaf_place)
SELECT l.doc_id, l.digest AS leaf, t.digest AS subroot, (SELECT digest FROM uppers WHERE total = 1) AS root,
  sha256(e.proof) AS proof_sha256, e.digest AS folded_root, e.digest = (SELECT digest FROM uppers WHERE total = 1) AS verified
FROM leaves l JOIN tops t ON t.name = l.tree JOIN ends e ON e.tree = l.tree AND e.leaf_place = l.place
"""
