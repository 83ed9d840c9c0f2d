"""Query catalogue: every operator on the driver's tables, with its check SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom import fixed
from turnloom.functions import arrays, text
from turnloom.functions.hashing import sha256, text_key
from turnloom.operators import (
    batching, bootstrap, choice, digest_tree, ordered, pairs, phrases, profile, report, resume, similarity, split, transcript, validate,
)
from turnloom.plans import bindings as b
from turnloom.plans import sql_parts as sql
from turnloom.session import checkpoint_dir
from turnloom.sources import files
from turnloom.sources import pages as page_source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if check:
            CHECKS[function.__name__] = check
        return function

    return register


def _rounded(*names: str) -> dict[str, Column]:
    return {n: F.round(n, 6) for n in names}


# --- text ---

@query(f"""
WITH t AS (SELECT doc_id, {sql.clean('text')} AS txt FROM documents)
SELECT doc_id, length(txt) AS chars, {sql.words('txt')} AS words, md5(lower(txt)) AS key FROM t""")
def text_clean_wc(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = b.table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("txt"))
    return cleaned.select(
        "doc_id", F.length("txt").alias("chars"), text.words_of_clean(F.col("txt")).alias("words"),
        F.md5(F.lower("txt")).alias("key"))


@query(f"SELECT page_id, md5({sql.normalize('html')}) AS normal_md5 FROM pages")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select(
        "page_id", F.md5(text.normalize(F.col("html"))).alias("normal_md5"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", sha256(F.col("text")).alias("sha256"))


_NAMED = """CASE role WHEN 'user' THEN 'Penny (off): ' WHEN 'assistant' THEN 'Magnets: '
            ELSE 'Mrs Cooper : ' END || text"""


@query(f"""
WITH t AS (SELECT conv_id, turn, {_NAMED} AS line FROM conversations)
SELECT conv_id, turn, lower(trim(regexp_extract(
         line, '^([A-Z][A-Za-z.''\\- ]{{0,28}}?)\\s*(?:\\([^)]{{0,40}}\\))?\\s*:\\s', 1)))
       IN ({', '.join(repr(c) for c in fixed.CAST)}) AS leaked FROM t""")
def speaker_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    opening = F.when(F.col("role") == "user", "Penny (off): ").when(
        F.col("role") == "assistant", "Magnets: ").otherwise("Mrs Cooper : ")
    return b.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.leaked_speaker(F.concat(opening, "text")).alias("leaked"))


# --- pages ---

@query(f"""
SELECT page_id, {sql.canonical('url')} AS canonical_url FROM pages
QUALIFY row_number() OVER (PARTITION BY {sql.canonical('url')} ORDER BY page_id) = 1""")
def url_canonical_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = b.table(spark, sf_dir, "pages").select("page_id", "url")
    return transcript.first_per_url(found, "url", ["page_id"]).select("page_id", "canonical_url")


@query("""
WITH tags AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS a FROM pages),
t AS (SELECT page_id, i - 1 AS place, a[i] AS a FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM tags))
SELECT page_id, place::INTEGER AS place, regexp_extract(a, '<a href="([^"]*)">', 1) AS href,
       replace(regexp_extract(a, '>([^<]*)</a>', 1), '&amp;', '&') AS text FROM t""")
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_source.anchors(b.table(spark, sf_dir, "pages"), ["page_id"])


@query(CHECKS["page_anchors"])
def page_anchors_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as SQL text, by a table function called for each page."""
    page_source.register_functions(spark)
    return spark.sql(
        "SELECT page_id, place, href, text FROM {pages}, LATERAL page_elements(html, 'a')",
        pages=b.table(spark, sf_dir, "pages"))


@query(f"""
SELECT page_id, 'series 1 Episode ' || page_id || ' Part' AS title, {sql.canonical('url')} AS url FROM pages
QUALIFY row_number() OVER (PARTITION BY {sql.canonical('url')} ORDER BY page_id) = 1""")
def episode_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_source.anchors(b.link_pages(spark, sf_dir), ["page_id"])
    return transcript.episode_links(found, ["page_id", "place"]).select("page_id", "title", "url")


@query(f"""
WITH bodies AS (
  SELECT page_id, regexp_extract_all(
    regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<[^>]*>|[^<]+') AS toks FROM pages),
toks AS (SELECT page_id, i, toks[i] AS tok FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM bodies)),
depths AS (
  SELECT *, sum(CASE tok WHEN '<p>' THEN 1 WHEN '</p>' THEN -1 ELSE 0 END)
    OVER (PARTITION BY page_id ORDER BY i) AS depth FROM toks),
opens AS (
  SELECT page_id, i, depth, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS place
  FROM depths WHERE tok = '<p>'),
closes AS (
  SELECT o.page_id, o.place, o.i, coalesce(min(d.i), 1000000000) AS stop
  FROM opens o LEFT JOIN depths d ON d.page_id = o.page_id AND d.i > o.i AND d.depth < o.depth
  GROUP BY o.page_id, o.place, o.i),
texts AS (
  SELECT c.page_id, c.place, string_agg(t.tok, '' ORDER BY t.i) AS raw
  FROM closes c LEFT JOIN toks t ON t.page_id = c.page_id AND t.i > c.i AND t.i < c.stop AND t.tok[1] <> '<'
  GROUP BY c.page_id, c.place),
plain AS (
  SELECT page_id, place, {sql.normalize("replace(replace(replace(coalesce(raw, ''), '&quot;', chr(34)), '&lt;', '<'), '&amp;', '&')")} AS txt
  FROM texts)
SELECT page_id, place::INTEGER AS place, length(txt) AS chars, {sql.words('txt')} AS words, md5(txt) AS text_md5
FROM plain""")
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_source.paragraphs(b.table(spark, sf_dir, "pages"), ["page_id"])
    normal = found.select("page_id", "place", text.normalize(F.col("full_text")).alias("txt"))
    return normal.select(
        "page_id", "place", F.length("txt").alias("chars"),
        text.words_of_clean(F.col("txt")).alias("words"), F.md5("txt").alias("text_md5"))


@query(f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
k AS (SELECT doc_id, i - 1 AS i, (i - 1) % 7 AS kind, l[i] AS l
      FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l)),
s AS (SELECT *, sum((kind = 3)::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS scene FROM k),
d AS (SELECT doc_id, i, scene, CASE WHEN kind = 0 THEN 'Alpha' ELSE 'Mrs. Beta' END AS speaker,
        trim(regexp_replace({sql.normalize("CASE WHEN kind = 0 THEN l || ' ()' ELSE l END")}, '\\(\\s*\\)', '', 'g')) AS text
      FROM s WHERE kind NOT IN (3, 5, 6))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS line, speaker,
       scene::INTEGER AS scene, text FROM d WHERE text <> ''""")
def html_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_source.paragraph_arrays(b.document_pages(spark, sf_dir), ["doc_id"])
    return transcript.page_dialogue(found, ["doc_id"])


@query(f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
k AS (SELECT doc_id, (i - 1)::INTEGER AS line, l[i] AS text
      FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l)),
w AS (SELECT *, {sql.words(sql.clean('text'))} < 4 AS is_header FROM k),
s AS (SELECT *, sum(is_header::INTEGER) OVER (PARTITION BY doc_id ORDER BY line) AS scene FROM w)
SELECT doc_id, scene::INTEGER AS scene, line, text FROM s WHERE NOT is_header""")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = b.table(spark, sf_dir, "documents")
    return transcript.explode_scenes(
        documents, ["doc_id"], F.split("text", "\n"), lambda line: text.word_count(line) < 4)


@query("""
SELECT conv_id, turn, sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS scene
FROM conversations""")
def scene_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = b.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ordered.running_total(
        turns, ["conv_id"], "turn", (F.col("role") == "user").cast("int"), "scene").drop("role")


@query("""
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS line FROM documents""")
def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = b.table(spark, sf_dir, "documents").select("source", "doc_id")
    return ordered.dense_position(documents, ["source"], "doc_id", "line")


# --- pairs ---

@query("""
WITH l AS (
  SELECT conv_id, turn, lower(role) = 'assistant' AS is_target,
         list(text) OVER w AS c, lag(lower(role) = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS p
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, coalesce(len(c), 0)::INTEGER AS depth, coalesce(p, false) AS after_target,
       md5(coalesce(array_to_string(c, '|'), '')) AS context_md5 FROM l""")
def dialogue_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = b.conversation_lines(spark, sf_dir).withColumn(
        "is_target", F.lower("speaker") == b.PAIR_RULES.target)
    looked = ordered.look_back(
        lines, ["episode_id"], "line", {"c": F.col("text"), "t": F.col("is_target")}, 3)
    return looked.select(
        F.col("episode_id").alias("conv_id"), F.col("line").alias("turn"), F.size("c").alias("depth"),
        F.coalesce(arrays.last(F.col("t")), F.lit(False)).alias("after_target"),
        F.md5(F.concat_ws("|", "c")).alias("context_md5"))


@query(f"""
WITH {sql.judged('turn // 3')}, {sql.prompts("(SELECT * FROM judged WHERE len(c) > 0)")}
SELECT conv_id, turn, messages::INTEGER AS messages, prompt FROM prompts""")
def turn_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = b.judged_lines(spark, sf_dir, b.SHORT_SCENES)
    merged = judged.select(
        F.col("episode_id").alias("conv_id"), F.col("line").alias("turn"),
        pairs.merge_turns(F.col("context_flags"), F.col("context_text")).alias("m"))
    return merged.filter(F.size("m") > 0).select(
        "conv_id", "turn", F.size("m").alias("messages"), b.shown("m").alias("prompt"))


def _pairs_check(scene: str) -> str:
    return f"""
WITH {sql.kept(scene)}, {sql.prompts('kept')}
SELECT k.conv_id, k.turn, k.scene, k.words AS target_words, p.messages::INTEGER AS messages, p.prompt, k.txt AS target
FROM kept k JOIN prompts p USING (conv_id, turn)"""


def _pairs(spark: SparkSession, sf_dir: str, scene: str) -> DataFrame:
    return b.conversation_pairs(spark, sf_dir, scene).select(
        F.col("episode_id").alias("conv_id"), F.col("line").alias("turn"), "scene", "target_words",
        F.size("prompt").alias("messages"), b.shown("prompt").alias("prompt"), "target")


@query(_pairs_check("0"))
def pairs_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, b.CONST_SCENE)


@query(_pairs_check("turn // 3"))
def pairs_build_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, b.SHORT_SCENES)


@query(f"""
WITH {sql.judged('turn // 3')},
r AS (SELECT coalesce(reason, 'kept') AS reason, count(*) AS rows,
             count(DISTINCT CASE WHEN reason IS NULL THEN lower(txt) END) AS uniq FROM judged GROUP BY 1)
SELECT reason, CASE WHEN reason = 'kept' THEN uniq ELSE rows END AS rows FROM r
UNION ALL SELECT 'duplicate', rows - uniq FROM r WHERE reason = 'kept' AND rows > uniq""")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.drop_reasons(b.judged_lines(spark, sf_dir, b.SHORT_SCENES))


@query(f"""
WITH altered AS (SELECT conv_id, turn, {b.ALTERED_ROLE} AS role, {b.ALTERED_TEXT} AS text FROM conversations),
{sql.judged('turn // 3', 'altered', b.ALL_RULES)},
r AS (SELECT coalesce(reason, 'kept') AS reason, count(*) AS rows,
             count(DISTINCT CASE WHEN reason IS NULL THEN lower(txt) END) AS uniq FROM judged GROUP BY 1)
SELECT reason, CASE WHEN reason = 'kept' THEN uniq ELSE rows END AS rows FROM r
UNION ALL SELECT 'duplicate', rows - uniq FROM r WHERE reason = 'kept' AND rows > uniq""")
def drop_reasons_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every outcome of the pair rules."""
    return pairs.drop_reasons(b.altered_lines(spark, sf_dir))


@query("""
SELECT doc_id, source, md5(text) AS text_md5 FROM documents
QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) = 1""")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = b.table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.md5("text").alias("text_md5"), text_key(F.col("text")).alias("reply_key"))
    return ordered.first_per_key(documents, F.col("reply_key"), ["doc_id"]).drop("reply_key")


@query(f"""
WITH {sql.kept('0')}, {sql.split_of('kept', 'conv_id::VARCHAR')}
SELECT k.conv_id, k.turn, g.split FROM kept k JOIN groups g ON g.episode = k.conv_id::VARCHAR""")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_pairs(b.settled_pairs(spark, sf_dir)).select(
        F.col("episode_id").alias("conv_id"), F.col("line").alias("turn"), "split")


@query(f"""
WITH {sql.kept('0')}, {sql.split_of('kept', 'conv_id::VARCHAR')},
s AS (SELECT k.conv_id, k.words, g.split FROM kept k JOIN groups g ON g.episode = k.conv_id::VARCHAR)
SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS scope, count(*) AS pairs,
       count(DISTINCT conv_id) AS episodes, round(avg(words), 6) AS mean_target_words
FROM s GROUP BY GROUPING SETS ((split), ())""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_summary(split.split_pairs(b.settled_pairs(spark, sf_dir))).withColumns(
        _rounded("mean_target_words"))


@query("""
SELECT count(DISTINCT conv_id) AS episodes, count(*) AS lines,
       count(*) FILTER (lower(role) = 'assistant') AS target_lines FROM conversations""")
def dialogue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dialogue_totals(b.conversation_lines(spark, sf_dir), "assistant")


# --- validation ---

_TURN_ERRORS = f"""
c AS (SELECT conv_id, count(*) AS n, arg_max(role, turn) AS ending FROM conversations GROUP BY conv_id),
m AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS wanted
      FROM conversations JOIN c USING (conv_id) WHERE n >= 2),
errors AS (
SELECT conv_id, -1 AS position, '{validate.TOO_FEW}' AS rule, 'only ' || n || ' messages' AS detail FROM c WHERE n < 2
UNION ALL SELECT conv_id, -1, '{validate.LAST_ROLE}', 'ends with ' || ending || ', expected assistant'
  FROM c WHERE n >= 2 AND ending <> 'assistant'
UNION ALL SELECT conv_id, turn, '{validate.EMPTY}', 'message ' || turn || ' is empty'
  FROM m WHERE {sql.clean('text')} = ''
UNION ALL SELECT conv_id, turn, '{validate.ORDER}', 'message ' || turn || ' has role ' || role || ', expected ' || wanted
  FROM m WHERE role <> wanted)"""


@query(f"WITH {_TURN_ERRORS} SELECT conv_id, position::INTEGER AS position, rule, detail FROM errors")
def shape_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.turn_errors(b.table(spark, sf_dir, "conversations"), "conv_id")


@query(f"""
WITH {_TURN_ERRORS}
SELECT conv_id, position::INTEGER AS position, rule, detail FROM errors
ORDER BY conv_id, position, rule LIMIT {fixed.ERROR_REPORT_ROWS}""")
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = validate.turn_errors(b.table(spark, sf_dir, "conversations"), "conv_id")
    return validate.error_report(errors, ["conv_id", "position", "rule"])[0]


@query(f"""
WITH l AS (
  SELECT conv_id, turn, list(role) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS r FROM conversations),
m AS (SELECT conv_id, turn, r, unnest(range(1, len(r) + 1)) AS i FROM l WHERE len(r) >= 2),
e AS (SELECT conv_id, turn, i - 1 AS position, r[i] AS role,
        CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END AS wanted FROM m)
SELECT conv_id, turn, -1 AS position, '{validate.TOO_FEW}' AS rule, 'only 1 messages' AS detail FROM l WHERE len(r) < 2
UNION ALL SELECT conv_id, turn, -1, '{validate.LAST_ROLE}', 'ends with ' || r[-1] || ', expected assistant'
  FROM l WHERE len(r) >= 2 AND r[-1] <> 'assistant'
UNION ALL SELECT conv_id, turn, position::INTEGER, '{validate.ORDER}',
  'message ' || position || ' has role ' || role || ', expected ' || wanted FROM e WHERE role <> wanted""")
def chat_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.row_errors(b.raw_chats(spark, sf_dir), ["conv_id", "turn"])


def _isolation_check(split_sql: str) -> str:
    return f"""
WITH {split_sql},
s AS (SELECT d.source, lower(d.text) AS t, g.split FROM documents d JOIN groups g ON g.episode = d.key),
e AS (SELECT source, bool_or(split = 'train') AS a, bool_or(split = 'heldout') AS h FROM s GROUP BY source),
l AS (SELECT bool_or(split = 'train') AS a, count(*) FILTER (split = 'heldout') AS n FROM s GROUP BY t)
SELECT 'train_episodes' AS "check", count(*) FILTER (a) AS rows FROM e
UNION ALL SELECT 'heldout_episodes', count(*) FILTER (h) FROM e
UNION ALL SELECT 'shared_episodes', count(*) FILTER (a AND h) FROM e
UNION ALL SELECT 'leaked_targets', coalesce(sum(n) FILTER (a), 0)::BIGINT FROM l"""


def _isolation(spark: SparkSession, sf_dir: str, group: str) -> DataFrame:
    documents = b.table(spark, sf_dir, "documents").select(
        "source", "text", F.col(group).cast("string").alias("key"))
    return validate.isolation_report(
        split.split_pairs(documents, "key"), episode="source", target="text")


@query(_isolation_check(sql.split_of("documents", "source")).replace("d.key", "d.source"))
def split_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _isolation(spark, sf_dir, "source")


@query(_isolation_check(sql.split_of("documents", "doc_id::VARCHAR")).replace("d.key", "d.doc_id::VARCHAR"))
def split_isolation_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split by row instead of by source, which the isolation rules must flag."""
    return _isolation(spark, sf_dir, "doc_id")


def _profile_check(source: str, key: str) -> str:
    return f"""
WITH t AS (SELECT {key}, {sql.clean('text')} AS txt FROM {source}),
w AS (SELECT {key}, {sql.words('txt')} AS w FROM t),
s AS (SELECT {key}, list_sort(list(w)) AS s FROM w GROUP BY {key})
SELECT {key}, len(s) AS rows, s[1] AS min,
       s[CAST(floor(len(s) * 0.25::DOUBLE) AS BIGINT) + 1] AS p25,
       s[CAST(floor(len(s) * 0.5::DOUBLE) AS BIGINT) + 1] AS p50,
       s[CAST(floor(len(s) * 0.75::DOUBLE) AS BIGINT) + 1] AS p75, s[-1] AS max FROM s"""


def _profile(spark: SparkSession, sf_dir: str, source: str, key: str) -> DataFrame:
    rows = b.table(spark, sf_dir, source)
    return profile.truncated_index_profile(rows, [key], text.word_count(F.col("text")))


@query(_profile_check("conversations", "role"))
def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, "conversations", "role")


@query(_profile_check("documents", "lang"))
def length_profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, "documents", "lang")


@query(f"""
WITH {sql.kept('0')}, {sql.prompts('kept')}
SELECT (messages + 1)::INTEGER AS messages, count(*) AS rows FROM prompts GROUP BY 1""")
def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.message_counts(pairs.pair_documents(b.conversation_pairs(spark, sf_dir)), [])


_HIT = ["contains(lower(text), '{}')".format(p) for p in b.PHRASES]


@query(" UNION ALL ".join(
    f"SELECT '{p}' AS phrase, count(*) AS rows FROM documents WHERE {h} HAVING count(*) > 0"
    for p, h in zip(b.PHRASES, _HIT)))
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.phrase_hits(b.table(spark, sf_dir, "documents"), F.col("text"), b.PHRASES)


@query(f"""
WITH h AS (SELECT {' + '.join(f'({h})::INTEGER' for h in _HIT)} AS h FROM documents)
SELECT sum(h)::BIGINT AS hits, count(*) FILTER (h > 0) AS rows_with_hit, count(*) AS rows,
       round(100.0::DOUBLE * count(*) FILTER (h > 0) / count(*), 6) AS percent FROM h""")
def phrase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.phrase_summary(
        b.table(spark, sf_dir, "documents"), F.col("text"), b.PHRASES).withColumns(_rounded("percent"))


_WORDS = """
words AS (
  SELECT DISTINCT phrase FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS phrase FROM benchmark)
  WHERE length(phrase) >= 8),
met AS (SELECT doc_id, phrase FROM documents JOIN words ON contains(lower(text), phrase))"""


@query(f"WITH {_WORDS} SELECT phrase, count(*) AS rows FROM met GROUP BY phrase")
def phrase_table_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.table_hits(b.table(spark, sf_dir, "documents"), F.col("text"), b.benchmark_words(spark, sf_dir))


@query(f"""
WITH {_WORDS}
SELECT lang, count(phrase) AS hits, count(DISTINCT doc_id) FILTER (phrase IS NOT NULL) AS rows_with_hit,
       count(DISTINCT doc_id) AS rows,
       round(100.0::DOUBLE * count(DISTINCT doc_id) FILTER (phrase IS NOT NULL) / count(DISTINCT doc_id), 6) AS percent
FROM documents LEFT JOIN met USING (doc_id) GROUP BY lang""")
def phrase_table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.table_summary(
        b.table(spark, sf_dir, "documents"), F.col("text"), b.benchmark_words(spark, sf_dir), ["lang"],
    ).withColumns(_rounded("percent"))


@query("""
WITH t AS (SELECT source, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END * (n_chars * 1000003000 + doc_id) AS v FROM documents),
s AS (SELECT source, list_sort(list(v)) AS s FROM t GROUP BY source)
SELECT source, len(s) AS rows, s[1] AS min,
       s[CAST(floor(len(s) * 0.25::DOUBLE) AS BIGINT) + 1] AS p25,
       s[CAST(floor(len(s) * 0.5::DOUBLE) AS BIGINT) + 1] AS p50,
       s[CAST(floor(len(s) * 0.75::DOUBLE) AS BIGINT) + 1] AS p75, s[-1] AS max FROM s""")
def wide_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics of numbers too wide for one digit."""
    value = F.expr("(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) * (n_chars * 1000003000 + doc_id)")
    return profile.truncated_index_profile(b.table(spark, sf_dir, "documents"), ["source"], value)


@query("""
WITH t AS (SELECT doc_id, greatest(n_chars, 1) AS one, n_chars FROM documents),
u AS (SELECT *, 1::BIGINT << greatest(0, length(bin(one - 1)) - 4) AS unit FROM t),
c AS (SELECT doc_id, n_chars, (one + unit - 1) // unit * unit AS padded FROM u),
p AS (SELECT *, row_number() OVER (PARTITION BY padded ORDER BY doc_id) - 1 AS place FROM c),
b AS (SELECT *, place // greatest(1, 65536 // padded) AS batch FROM p)
SELECT doc_id, padded, batch, max(n_chars) OVER (PARTITION BY padded, batch) AS longest FROM b""")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in batches of 65,536 padded characters at most, with each batch's longest."""
    rows = b.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    batched = batching.token_batches(rows, F.col("n_chars"), "doc_id", 1 << 16)
    longest = F.max("n_chars").over(Window.partitionBy("padded", "batch"))
    return batched.select("doc_id", "padded", "batch", longest.alias("longest"))


@query("""
WITH e AS (
  SELECT conv_id, count(*) AS lines, md5(string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS said
  FROM conversations GROUP BY conv_id)
SELECT row_number() OVER (ORDER BY conv_id) - 1 AS episode_id, conv_id::VARCHAR AS title, '/' || conv_id AS url, lines, said FROM e""")
def json_array_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON array documents and read back by byte ranges."""
    episodes = files.read_episodes(spark, b.array_documents(spark, sf_dir))
    said = F.transform("lines", lambda x: F.concat(x["speaker"], F.lit(":"), F.coalesce(x["text"], F.lit(""))))
    return episodes.select(
        "episode_id", "title", "url", F.size("lines").cast("long").alias("lines"),
        F.md5(F.array_join(said, "\n").cast("binary")).alias("said"))


# --- training rows ---

@query(f"""
WITH {sql.kept('0')}, {sql.prompts('kept')}
SELECT k.conv_id, k.turn, p.prompt, 'assistant: ' || k.txt AS completion
FROM kept k JOIN prompts p USING (conv_id, turn)""")
def prompt_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = pairs.pair_documents(b.conversation_pairs(spark, sf_dir))
    trainable = validate.require_trainable(documents, F.col("line"))
    return validate.prompt_completion(trainable, ["episode_id", "line"]).select(
        F.col("episode_id").alias("conv_id"), F.col("line").alias("turn"),
        b.shown("prompt").alias("prompt"), b.shown("completion").alias("completion"))


_TOKENS = f"""
{sql.kept('0')}, {sql.prompts('kept')},
ids AS (
  SELECT k.conv_id, k.turn, [length(x) + 10 FOR x IN string_split(p.prompt, ' ')] AS prompt_ids,
         [length(x) + 10 FOR x IN string_split(k.txt, ' ')] AS reply_ids, k.words
  FROM kept k JOIN prompts p USING (conv_id, turn)),
full_rows AS (
  SELECT *, CASE WHEN words % 7 = 0 THEN [0] ELSE [] END || prompt_ids || reply_ids
         || CASE WHEN words % 5 = 0 THEN [] ELSE [2] END AS full_ids FROM ids)"""


@query(f"""
WITH {_TOKENS}
SELECT conv_id, turn, len(full_ids)::INTEGER AS tokens, CASE
  WHEN full_ids[:len(prompt_ids)] <> prompt_ids THEN 'prompt_not_a_prefix'
  WHEN len(full_ids) > 200 THEN 'too_many_tokens'
  WHEN NOT list_contains(full_ids[len(prompt_ids) + 1:], 2) THEN 'no_end_token' ELSE 'ok' END AS outcome
FROM full_rows""")
def token_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = validate.token_error(F.col("prompt_ids"), F.col("full_ids"), b.END_TOKEN, 200)
    return b.tokenized_pairs(spark, sf_dir).select(
        "conv_id", "turn", F.size("full_ids").alias("tokens"),
        F.coalesce(error, F.lit("ok")).alias("outcome"))


@query(f"""
WITH {_TOKENS}
SELECT conv_id, turn, len(prompt_ids)::INTEGER AS masked,
       list_sum(full_ids[len(prompt_ids) + 1:])::BIGINT AS trained_sum, true AS right_mask,
       false AS shifted_mask FROM full_rows""")
def loss_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.size("prompt_ids")
    full = F.col("full_ids")
    masked = b.tokenized_pairs(spark, sf_dir).withColumns({
        "labels": validate.masked_labels(full, size),
        "shifted": validate.masked_labels(full, size + 1),
    })
    return masked.select(
        "conv_id", "turn",
        F.size(F.filter("labels", lambda x: x == fixed.MASKED_LABEL)).alias("masked"),
        F.aggregate(F.filter("labels", lambda x: x != fixed.MASKED_LABEL), F.lit(0).cast("long"),
                    lambda acc, x: acc + x).alias("trained_sum"),
        validate.mask_is_right(F.col("labels"), full, size).alias("right_mask"),
        validate.mask_is_right(F.col("shifted"), full, size).alias("shifted_mask"))


@query(f"""
WITH t AS (SELECT doc_id, [length(x) FOR x IN string_split({sql.clean('text')}, ' ')] AS toks FROM documents),
p AS (SELECT *, list_position([x IN {b.STOPS} FOR x IN toks], true) AS pos FROM t),
s AS (SELECT *, CASE WHEN pos > 0 THEN pos - 1 ELSE len(toks) END AS stop FROM p)
SELECT doc_id, stop::INTEGER AS tokens, (stop = len(toks) AND len(toks) = {b.TOKEN_CAP}) AS hit_token_limit,
       coalesce(list_sum(toks[:stop]), 0)::BIGINT AS kept_sum FROM s""")
def eos_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "documents").select(
        "doc_id", b.word_lengths(F.col("text")).alias("toks"))
    toks = F.col("toks")
    return rows.select(
        "doc_id", arrays.stop_position(toks, b.STOPS).alias("tokens"),
        arrays.hit_token_limit(toks, b.STOPS, b.TOKEN_CAP).alias("hit_token_limit"),
        F.aggregate(arrays.cut_at_stop(toks, b.STOPS), F.lit(0).cast("long"),
                    lambda acc, x: acc + x).alias("kept_sum"))


# --- paired similarity ---

@query(f"""
WITH {sql.SCORED}
SELECT vec_id, round(base_cosine, 6) AS base_cosine, round(sft_cosine, 6) AS sft_cosine,
       round(sft_cosine - base_cosine, 6) AS difference FROM scored""")
def cosine_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.scored_vectors(spark, sf_dir).drop("label").withColumns(
        _rounded("base_cosine", "sft_cosine", "difference"))


@query(f"""
WITH {sql.SCORED}
SELECT 'base' AS model, round(avg(base_cosine), 6) AS mean_cosine_similarity,
       round(avg(label * 3), 6) AS mean_generated_tokens, count(*) FILTER (label = 0) AS empty_responses,
       count(*) FILTER (label = 9) AS generation_limit_hits,
       count(*) FILTER (label * 50 > 384) AS embedding_truncations FROM scored
UNION ALL
SELECT 'sft', round(avg(sft_cosine), 6), round(avg((label + 1) * 3), 6), 0,
       count(*) FILTER (label >= 8), count(*) FILTER (label * 60 > 384) FROM scored""")
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = similarity.long_form(b.generation_rows(spark, sf_dir), ["vec_id"])
    return similarity.model_metrics(long, 384).withColumns(
        _rounded("mean_cosine_similarity", "mean_generated_tokens"))


@query(f"""
WITH {sql.SCORED}
SELECT count(*) AS examples, round(avg(sft_cosine - base_cosine), 6) AS mean_paired_difference,
       round(avg((sft_cosine > base_cosine)::INTEGER), 6) AS fraction_sft_higher FROM scored""")
def paired_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.paired_summary(b.scored_vectors(spark, sf_dir)).withColumns(
        _rounded("mean_paired_difference", "fraction_sft_higher"))


@query(f"""
WITH {sql.SCORED}
SELECT label AS cluster, round(sum(sft_cosine - base_cosine), 6) AS total, count(*) AS members
FROM scored GROUP BY label""")
def cluster_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cluster_totals(b.scored_vectors(spark, sf_dir), "label").withColumns(_rounded("total"))


@query(f"""
WITH {sql.SCORED},
clusters AS (
  SELECT label, sum(sft_cosine - base_cosine) AS total, count(*) AS members,
         row_number() OVER (ORDER BY md5('0:' || label), label) - 1 AS slot, count(*) OVER () AS n
  FROM scored GROUP BY label),
size AS (SELECT max(n) AS n FROM clusters),
draws AS (
  SELECT sample, {sql.draw("md5('0:' || sample || ':' || (i // 4))", '(i % 4)', 'n')} AS slot
  FROM size, range({fixed.BOOTSTRAP_SAMPLES}) s(sample), (SELECT unnest(range(n)) AS i FROM size)),
estimates AS (
  SELECT sample, sum(total) / sum(members) AS e FROM draws JOIN clusters USING (slot) GROUP BY sample)
SELECT count(*) AS samples, round(quantile_cont(e, 0.025), 6) AS low, round(quantile_cont(e, 0.975), 6) AS high
FROM estimates""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = similarity.cluster_totals(b.scored_vectors(spark, sf_dir), "label")
    return bootstrap.interval(bootstrap.cluster_estimates(totals)).withColumns(_rounded("low", "high"))


@query(f"""
WITH t AS (SELECT n_chars AS x, {sql.words(sql.clean('text'))} AS y FROM documents),
r AS (
  SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx,
         rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM t)
SELECT count(*) AS rows, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""")
def length_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "documents")
    return similarity.correlations(rows, F.col("n_chars"), text.word_count(F.col("text"))).withColumns(
        _rounded("pearson", "spearman"))


@query(f"""
WITH t AS (SELECT lang, n_chars AS x, {sql.words(sql.clean('text'))} AS y FROM documents),
r AS (
  SELECT lang, x, y,
         rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0::DOUBLE AS rx,
         rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2.0::DOUBLE AS ry
  FROM t)
SELECT lang, count(*) AS rows, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman
FROM r GROUP BY lang""")
def length_corr_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "documents")
    return similarity.correlations(
        rows, F.col("n_chars"), text.word_count(F.col("text")), ["lang"]).withColumns(_rounded("pearson", "spearman"))


@query(f"""
WITH t AS (SELECT role, {sql.clean('text')} AS txt FROM conversations)
SELECT role AS model, round(avg({sql.words('txt')}), 6) AS mean_words FROM t GROUP BY role""")
def mean_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "conversations").withColumnRenamed("role", "model")
    return similarity.mean_words(rows).withColumns(_rounded("mean_words"))


# --- multiple choice ---

@query(f"""
WITH {sql.ITEMS}
SELECT subject, split, count(*) AS items, min(idx) AS first, max(idx) AS last FROM items GROUP BY subject, split""")
def manifest_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.manifest_summary(choice.freeze_manifest(b.choice_items(spark, sf_dir)))


@query(f"""
WITH {sql.ITEMS},
q AS (SELECT *, question || chr(10) || 'A. ' || w || chr(10) || 'B. ' || (w + 1) || chr(10)
        || 'C. ' || (w + 2) || chr(10) || 'D. ' || (w + 3) AS asked, 'ABCD'[answer + 1] AS letter FROM items),
d AS (SELECT subject, string_agg('user: ' || asked || chr(10) || 'assistant: ' || letter, chr(10) ORDER BY idx) AS demos
      FROM q WHERE split = 'dev' GROUP BY subject)
SELECT subject, idx, letter AS answer, 12 AS messages,
       'system: {fixed.CHOICE_INSTRUCTION}' || chr(10) || demos || chr(10) || 'user: ' || asked AS prompt
FROM q JOIN d USING (subject) WHERE split = 'test'""")
def fewshot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = b.choice_items(spark, sf_dir)
    examples = choice.few_shot_examples(items, choice.freeze_manifest(items), b.SUBJECTS)
    return examples.select(
        "subject", "idx", "answer", F.size("messages").alias("messages"), b.shown("messages").alias("prompt"))


@query("""
WITH l AS (SELECT 'dev' AS split, unnest(string_split(text, chr(10))) AS q FROM benchmark
           UNION ALL SELECT 'test', unnest(string_split(text, chr(10))) FROM documents)
SELECT sha256(q) AS question_key, count(*) FILTER (split = 'dev') AS dev_items,
       count(*) FILTER (split = 'test') AS test_items FROM l GROUP BY q
HAVING count(*) FILTER (split = 'dev') > 0 AND count(*) FILTER (split = 'test') > 0""")
def question_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.question_overlap(b.exact_lines(spark, sf_dir))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS z FROM embeddings),
e AS (SELECT vec_id, z, list_max(z[:4]) AS m4, list_max(z) AS m FROM v),
x AS (SELECT *, [exp(q - m4) FOR q IN z[:4]] AS x4, list_sum([exp(q - m) FOR q IN z]) AS s FROM e),
p AS (SELECT *, list_sum(x4) AS s4, [q / list_sum(x4) FOR q IN x4] AS p FROM x)
SELECT vec_id, 'ABCD'[list_position(p, list_max(p))] AS prediction, round(p[1], 6) AS p_a, round(p[2], 6) AS p_b,
       round(p[3], 6) AS p_c, round(p[4], 6) AS p_d, round(exp(m4 + ln(s4) - m - ln(s)), 6) AS mass,
       (list_position(z, m) - 1)::INTEGER AS top FROM p""")
def choice_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = choice.predict(b.logit_rows(spark, sf_dir), ["vec_id"], "logits", (0, 1, 2, 3))
    p = F.col("choice_probabilities")
    return found.select(
        "vec_id", "prediction", *[F.round(p[x], 6).alias(f"p_{x.lower()}") for x in fixed.LETTERS],
        F.round("answer_letter_probability_mass", 6).alias("mass"),
        F.col("unconstrained_top_token").alias("top"))


_ACCURACY = """round(base_correct::DOUBLE / questions, 6) AS base_accuracy,
       round(sft_correct::DOUBLE / questions, 6) AS sft_accuracy"""


@query(f"""
WITH {sql.GRADED}
SELECT scope, questions, base_correct, sft_correct, {_ACCURACY},
       round((sft_correct - base_correct)::DOUBLE / questions, 6) AS accuracy_difference,
       base_correct_sft_wrong, base_wrong_sft_correct FROM scopes""")
def accuracy_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.accuracy_by_subject(b.graded_documents(spark, sf_dir)).withColumns(
        _rounded("base_accuracy", "sft_accuracy", "accuracy_difference"))


@query(f"""
WITH graded AS (
  SELECT lang AS subject, coalesce((quality = CASE WHEN n_chars % 5 > 0 THEN (n_chars > 1500)::INTEGER END)::INTEGER, 0)
           AS base_right,
         coalesce((quality = CASE WHEN n_chars % 7 > 0 THEN (n_chars > 300)::INTEGER END)::INTEGER, 0) AS sft_right
  FROM labels JOIN documents USING (doc_id)),
scopes AS (
  SELECT CASE WHEN grouping(subject) = 1 THEN 'overall' ELSE subject END AS scope, count(*) AS questions,
    sum(base_right)::BIGINT AS base_correct, sum(sft_right)::BIGINT AS sft_correct,
    count(*) FILTER (base_right > sft_right) AS base_correct_sft_wrong,
    count(*) FILTER (base_right < sft_right) AS base_wrong_sft_correct
  FROM graded GROUP BY GROUPING SETS ((subject), ()))
SELECT scope, questions, base_correct, sft_correct, {_ACCURACY},
       round((sft_correct - base_correct)::DOUBLE / questions, 6) AS accuracy_difference,
       base_correct_sft_wrong, base_wrong_sft_correct FROM scopes""")
def accuracy_missing_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some predictions are missing, which counts as wrong."""
    documents = b.table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("lang").alias("subject"))
    joined = b.table(spark, sf_dir, "labels").select("doc_id", "quality").join(documents, "doc_id")
    chars = F.col("n_chars")
    marked = choice.mark_correct(
        joined, F.col("quality"), F.when(chars % 5 > 0, (chars > 1500).cast("int")),
        F.when(chars % 7 > 0, (chars > 300).cast("int")))
    return choice.accuracy_by_subject(marked).withColumns(
        _rounded("base_accuracy", "sft_accuracy", "accuracy_difference"))


@query("""
WITH m AS (
  SELECT label::VARCHAR AS subject, count(*) AS questions, sum(list_sum(embedding[1:4])::DOUBLE) AS b,
         sum(list_sum(embedding[2:5])::DOUBLE) AS s FROM embeddings GROUP BY label)
SELECT subject AS scope, questions, round(b / questions, 4) AS base_mass, round(s / questions, 4) AS sft_mass FROM m
UNION ALL SELECT 'overall', sum(questions)::BIGINT, round(sum(b) / sum(questions), 4), round(sum(s) / sum(questions), 4)
FROM m""")
def letter_mass_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean letter masses per subject; sums of vector entries stand in for the masses."""
    def total(first: int) -> Column:
        return F.aggregate(F.slice("embedding", first, 4), F.lit(0.0), lambda a, x: a + x.cast("double"))

    rows = b.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("subject"), F.lit(1).alias("base_right"), F.lit(1).alias("sft_right"),
        F.lit(0).alias("difference"), total(1).alias("base_mass"), total(2).alias("sft_mass"))
    return choice.accuracy_by_subject(rows, masses=True).select(
        "scope", "questions", *[
            F.round(f"{m}_mean_answer_letter_probability_mass", 4).alias(f"{m}_mass") for m in fixed.MODELS])


@query(f"""
WITH {sql.GRADED},
strata AS (
  SELECT subject, count(*) AS n, count(*) FILTER (sft_right < base_right) AS minus,
         count(*) FILTER (sft_right = base_right) AS zero FROM graded GROUP BY subject),
slots AS (SELECT *, unnest(range(n)) AS i FROM strata),
draws AS (
  SELECT sample, minus, zero,
         {sql.draw("md5('0:' || sample || ':' || subject || ':' || (i // 4))", '(i % 4)', 'n')} AS u
  FROM slots, range({fixed.BOOTSTRAP_SAMPLES}) s(sample)),
estimates AS (
  SELECT sample, sum(CASE WHEN u < minus THEN -1 WHEN u < minus + zero THEN 0 ELSE 1 END)::DOUBLE
                 / (SELECT sum(n) FROM strata) AS e FROM draws GROUP BY sample)
SELECT count(*) AS samples, round(quantile_cont(e, 0.025), 6) AS low, round(quantile_cont(e, 0.975), 6) AS high
FROM estimates""")
def stratified_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bootstrap.stratum_counts(b.graded_documents(spark, sf_dir), "subject", "difference")
    return bootstrap.interval(bootstrap.stratified_estimates(counts)).withColumns(_rounded("low", "high"))


def _fit(drawn: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whether drawn mean ``m`` and spread ``s`` are within five of their standard errors of the wanted ones."""
    both = drawn.withColumns({name: wanted.select(name).scalar() for name in ("wanted_mean", "wanted_spread")})
    return both.select(
        "samples", F.round("wanted_mean", 6).alias("wanted_mean"), F.round("wanted_spread", 6).alias("wanted_spread"),
        (F.abs(F.col("m") - F.col("wanted_mean")) < 5 * F.col("wanted_spread") / F.sqrt("samples")).alias("mean_fits"),
        (F.abs(F.col("s") / F.col("wanted_spread") - 1) < 5 / F.sqrt(2 * F.col("samples"))).alias("spread_fits"))


@query(f"""
WITH {sql.GRADED},
strata AS (
  SELECT subject, count(*) AS n, avg(sft_right - base_right) AS m, var_pop(sft_right - base_right) AS v
  FROM graded GROUP BY subject)
SELECT {fixed.BOOTSTRAP_SAMPLES}::BIGINT AS samples, round(sum(n * m) / sum(n), 6) AS wanted_mean,
       round(sqrt(sum(n * v)) / sum(n), 6) AS wanted_spread, true AS mean_fits, true AS spread_fits FROM strata""")
def stratified_bootstrap_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of the drawn estimates next to those that follow from the strata."""
    counts = bootstrap.stratum_counts(b.graded_documents(spark, sf_dir), "subject", "difference")
    n = F.col("members")
    mean = (n - F.col("minus") - F.col("zero") - F.col("minus")) / n
    variance = (n - F.col("zero")) / n - mean * mean
    wanted = counts.agg(
        (F.sum(n * mean) / F.sum(n)).alias("wanted_mean"), (F.sqrt(F.sum(n * variance)) / F.sum(n)).alias("wanted_spread"))
    drawn = bootstrap.stratified_estimates_multinomial(counts).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("estimate").alias("m"), F.stddev_pop("estimate").alias("s"))
    return _fit(drawn, wanted)


@query(f"""
WITH {sql.GRADED.replace('SELECT d.lang', 'SELECT d.doc_id % 499 AS cluster, d.lang')},
clusters AS (SELECT cluster, sum(sft_right - base_right) AS t, count(*) AS m FROM graded GROUP BY cluster),
whole AS (SELECT sum(t) / sum(m) AS r, sum(m) AS n FROM clusters)
SELECT {fixed.BOOTSTRAP_SAMPLES}::BIGINT AS samples, round(max(r), 6) AS wanted_mean,
       round(sqrt(sum((t - r * m) * (t - r * m))) / max(n), 6) AS wanted_spread, true AS mean_fits, true AS spread_fits
FROM clusters, whole""")
def cluster_bootstrap_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of one-pass estimates next to those that follow from the clusters."""
    rows = b.graded_documents(spark, sf_dir).withColumn("cluster", F.col("doc_id") % 499)
    totals = rows.groupBy("cluster").agg(F.sum("difference").alias("t"), F.count(F.lit(1)).alias("m"))
    sums = totals.agg(
        F.sum("t").alias("t"), F.sum("m").alias("m"), F.sum(F.col("t") * F.col("t")).alias("tt"),
        F.sum(F.col("t") * F.col("m")).alias("tm"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    r = F.col("t") / F.col("m")
    wanted = sums.select(r.alias("wanted_mean"), (F.sqrt(F.col("tt") - 2 * r * F.col("tm") + r * r * F.col("mm")) / F.col("m")).alias("wanted_spread"))
    drawn = bootstrap.cluster_estimates_poisson(rows, F.col("cluster"), F.col("difference")).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("estimate").alias("m"), F.stddev_pop("estimate").alias("s"))
    return _fit(drawn, wanted)


# --- resume, checksums, samples ---

@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.remaining(
        b.table(spark, sf_dir, "documents").select("doc_id"), b.table(spark, sf_dir, "labels"), ["doc_id"])


_PREFIX = """SELECT '{t}' AS source, count(*) AS saved, count(DISTINCT doc_id) AS "distinct", max(doc_id) AS highest,
  min(doc_id) AS lowest, count(*) = count(DISTINCT doc_id) AND count(*) = max(doc_id) + 1 AND min(doc_id) = 0
  AS is_prefix FROM {t}"""


@query(_PREFIX.format(t="documents") + " UNION ALL " + _PREFIX.format(t="labels"))
def prefix_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    def status(name: str) -> DataFrame:
        return resume.prefix_status(b.table(spark, sf_dir, name), "doc_id").withColumn("source", F.lit(name))

    return status("documents").unionByName(status("labels"))


@query(f"""
SELECT doc_id::VARCHAR AS path, sha256(text) AS left_sha256, sha256({sql.clean('text')}) AS right_sha256
FROM documents WHERE text <> {sql.clean('text')}""")
def checksum_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(value: Column) -> DataFrame:
        return b.table(spark, sf_dir, "documents").select(
            F.col("doc_id").cast("string").alias("path"), sha256(value).alias("sha256"))

    return resume.compare_checksums(digests(F.col("text")), digests(text.clean(F.col("text"))))


@query(CHECKS["checksum_compare"])
def digest_tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from two saved digest trees, of which only differing buckets are read."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    documents = b.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    depth = digest_tree.depth_for(documents.count())
    for side, value in (("left", F.col("text")), ("right", text.clean(F.col("text")))):
        digest_tree.save_tree(documents.select("path", sha256(value).alias("sha256")), f"{folder}/{side}", depth)
    return digest_tree.compare_trees(spark, f"{folder}/left", f"{folder}/right")


@query("SELECT doc_id, source FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 10")
def spot_check_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.spot_check(b.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 10)


# --- plot frames ---

@query(f"""
WITH {sql.SCORED},
m AS (SELECT avg(base_cosine) AS b, avg(sft_cosine) AS s FROM scored),
r AS (SELECT *, greatest(0.32::DOUBLE, greatest(b, s) * 1.6::DOUBLE) AS upper FROM m)
SELECT 0 AS place, 'Base' AS model, round(b, 6) AS value, round(upper, 6) AS axis_upper, printf('%.4f', b) AS label FROM r
UNION ALL SELECT 1, 'SFT', round(s, 6), round(upper, 6), printf('%.4f', s) FROM r""")
def similarity_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = b.scored_vectors(spark, sf_dir).agg(
        F.avg("base_cosine").alias("base_cosine"), F.avg("sft_cosine").alias("sft_cosine"),
        F.avg("difference").alias("difference"), F.min("difference").alias("low"),
        F.max("difference").alias("high"))
    return report.similarity_bars(metrics).select("place", "model", "value", "axis_upper", "label").withColumns(
        _rounded("value", "axis_upper"))


@query("""
WITH m AS (SELECT avg(label * 3)::DOUBLE AS b, avg((label + 1) * 3)::DOUBLE AS s FROM embeddings)
SELECT 0 AS place, 'Base' AS model, round(b, 6) AS value, round(greatest(b, s) * 1.3::DOUBLE, 6) AS axis_upper,
       printf('%.1f', b) AS label FROM m
UNION ALL SELECT 1, 'SFT', round(s, 6), round(greatest(b, s) * 1.3::DOUBLE, 6), printf('%.1f', s) FROM m""")
def length_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = b.table(spark, sf_dir, "embeddings").agg(
        F.avg(F.col("label") * 3).alias("base_tokens"), F.avg((F.col("label") + 1) * 3).alias("sft_tokens"))
    return report.length_bars(metrics).select("place", "model", "value", "axis_upper", "label").withColumns(
        _rounded("value", "axis_upper"))


@query(f"""
WITH {sql.GRADED},
a AS (SELECT *, {_ACCURACY.replace('round(', 'round(100 * ')},
        list_position(['en', 'fr', 'de', 'es', 'overall'], scope) - 1 AS place FROM scopes)
SELECT place::INTEGER AS place, CASE scope WHEN 'overall' THEN 'Overall' ELSE scope END AS subject,
       questions, 'Base' AS model, base_accuracy AS percent FROM a
UNION ALL SELECT place::INTEGER, CASE scope WHEN 'overall' THEN 'Overall' ELSE scope END, questions, 'SFT',
       sft_accuracy FROM a""")
def accuracy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = choice.accuracy_by_subject(b.graded_documents(spark, sf_dir))
    return report.accuracy_bars(scopes, b.LANGUAGES, {}).drop("label").withColumns(_rounded("percent"))


@query(f"""
WITH {sql.GRADED},
g AS (SELECT 100 * (sft_correct - base_correct)::DOUBLE / questions AS d FROM scopes WHERE scope = 'overall'),
i AS (SELECT d, d - 1 AS low, d + 1 AS high FROM g)
SELECT round(d, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high,
       printf('SFT minus base: %+.2f points', d) || chr(10) || printf('95%% CI [%+.2f, %+.2f]', low, high) AS caption
FROM i""")
def accuracy_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall gain in points; a point to either side stands in for the interval."""
    overall = choice.accuracy_by_subject(b.graded_documents(spark, sf_dir)).filter("scope = 'overall'")
    share = F.col("accuracy_difference")
    return report.accuracy_gain(overall.select(
        share.alias("difference"), (share - 0.01).alias("low"), (share + 0.01).alias("high"))).withColumns(
            _rounded("difference", "low", "high"))


# --- rules that the bindings above do not reach ---

_JUNK = "(?i)^(?:" + "|".join(fixed.JUNK_WORDS) + ")[.!?]?$"
_POINTING = r"(?i)(?:^|[^\p{L}\p{N}_])(?:" + "|".join(fixed.POINTING_PHRASES) + r")(?:$|[^\p{L}\p{N}_])"


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, unnest(string_split(line, ' ')) AS word FROM l),
j AS (SELECT doc_id, count(*) FILTER (regexp_matches(replace(replace(word, 'the', 'Oh'), 'and', 'right'), '{_JUNK}')) AS junk
      FROM w GROUP BY doc_id),
p AS (SELECT doc_id, count(*) FILTER (regexp_matches(replace(replace(line, 'in ', 'This one '), 'to ', 'those '), '{_POINTING}'))
        AS pointing FROM l GROUP BY doc_id)
SELECT doc_id, junk, pointing FROM j JOIN p USING (doc_id)""")
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filler words and lines that point at a picture; some common words are replaced to make them."""
    lines = F.split("text", "\n")
    words = F.flatten(F.transform(lines, lambda x: F.split(x, " ")))

    def filler(word: Column) -> Column:
        return text.is_junk(F.replace(F.replace(word, F.lit("the"), F.lit("Oh")), F.lit("and"), F.lit("right")))

    def pointing(line: Column) -> Column:
        return text.points_at_picture(
            F.replace(F.replace(line, F.lit("in "), F.lit("This one ")), F.lit("to "), F.lit("those ")))

    return b.table(spark, sf_dir, "documents").select(
        "doc_id", F.size(F.filter(words, filler)).cast("long").alias("junk"),
        F.size(F.filter(lines, pointing)).cast("long").alias("pointing"))


_CHAT = """
c AS (
  SELECT conv_id, turn, role, CASE WHEN turn % 5 = 2 THEN ' ' WHEN turn % 5 = 1 THEN 'Penny: ' || text ELSE text END AS text
  FROM conversations),
l AS (
  SELECT conv_id, turn, list(role) OVER w AS r, list(text) OVER w AS t FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
m AS (SELECT conv_id, turn, r, t, unnest(range(1, len(r) + 1)) AS i FROM l WHERE len(r) >= 2),
e AS (SELECT conv_id, turn, i - 1 AS position, r[i] AS role, t[i] AS text,
        CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END AS wanted FROM m)"""


@query(f"""
WITH {_CHAT}, found AS (
  SELECT '{validate.TOO_FEW}' AS rule FROM l WHERE len(r) < 2
  UNION ALL SELECT '{validate.LAST_ROLE}' FROM l WHERE len(r) >= 2 AND r[-1] <> 'assistant'
  UNION ALL SELECT '{validate.EMPTY}' FROM e WHERE trim(text) = ''
  UNION ALL SELECT '{validate.LEAK}' FROM e WHERE starts_with(text, 'Penny: ')
  UNION ALL SELECT '{validate.ORDER}' FROM e WHERE role <> wanted)
SELECT rule, count(*) AS errors, greatest(count(*) - {fixed.ERROR_REPORT_ROWS}, 0) AS not_shown FROM found GROUP BY rule""")
def chat_errors_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five rules: some turns are blanked and some open with a speaker's name."""
    lines = b.conversation_lines(spark, sf_dir).withColumn("text", F.when(F.col("line") % 5 == 2, " ").when(
        F.col("line") % 5 == 1, F.concat(F.lit("Penny: "), "text")).otherwise(F.col("text")))
    errors = validate.row_errors(b.chats_of(lines), ["conv_id", "turn"])
    return errors.groupBy("rule").agg(F.count(F.lit(1)).alias("errors")).withColumn(
        "not_shown", F.greatest(F.col("errors") - fixed.ERROR_REPORT_ROWS, F.lit(0).cast("long")))


@query("""
SELECT conv_id, turn, sha256(role || chr(10) || text) AS sha256 FROM conversations""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as JSON text and read back."""
    told = b.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("j"))
    back = told.withColumn("t", F.from_json("j", "role string, text string", {"mode": "FAILFAST"}))
    return back.select("conv_id", "turn", sha256(F.concat("t.role", F.lit("\n"), "t.text")).alias("sha256"))


@query(f"""
WITH f AS (
  SELECT page_id, {sql.canonical('url')} AS url FROM pages
  QUALIFY row_number() OVER (PARTITION BY {sql.canonical('url')} ORDER BY page_id) = 1)
(SELECT 'first' AS side, page_id, url FROM f ORDER BY page_id LIMIT 7)
UNION ALL SELECT 'without last', page_id, url FROM f
WHERE page_id NOT IN (SELECT page_id FROM f ORDER BY page_id DESC LIMIT 9)""")
def episode_links_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first links, and all but the last ones."""
    found = page_source.anchors(b.link_pages(spark, sf_dir), ["page_id"])
    sides = [transcript.episode_links(found, ["page_id", "place"], limit).select(F.lit(name).alias("side"), "page_id", "url")
             for name, limit in (("first", 7), ("without last", -9))]
    return sides[0].unionAll(sides[1])


@query("""
SELECT doc_id FROM documents WHERE doc_id % 11 = 3 OR lower(source) <> source""")
def prefix_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved rows that differ from the inputs at their index: every eleventh row was saved with another source."""
    rows = b.table(spark, sf_dir, "documents").select("doc_id", "source")
    saved = rows.withColumn("source", F.when(F.col("doc_id") % 11 == 3, "other").otherwise(F.lower("source")))
    return resume.prefix_mismatches(saved, rows, "doc_id", ["source"]).select("doc_id")


@query("""
SELECT source AS episode FROM documents GROUP BY source
HAVING count(*) FILTER (doc_id % 97 = 0) > 0 AND count(*) FILTER (doc_id % 97 <> 0) > 0""")
def shared_episode_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources on both sides of a split by row."""
    rows = b.table(spark, sf_dir, "documents").select(
        F.col("source").alias("episode"), F.when(F.col("doc_id") % 97 == 0, "heldout").otherwise("train").alias("split"))
    return validate.shared_episodes(rows)
