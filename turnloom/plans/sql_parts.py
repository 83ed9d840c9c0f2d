"""Pieces of the check SQL that several queries share (DuckDB dialect)."""

from turnloom import fixed
from turnloom.operators.pairs import PairRules
from turnloom.plans.bindings import PAIR_RULES as R

CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def clean(expr: str) -> str:
    return CLEAN.format(expr)


def words(expr: str) -> str:
    """Word count of cleaned text."""
    return f"(CASE WHEN {expr} = '' THEN 0 ELSE len(string_split({expr}, ' ')) END)"


def normalize(expr: str) -> str:
    for char, plain in zip(fixed.PUNCT_FROM, fixed.PUNCT_TO):
        expr = f"replace({expr}, '{char}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return clean(f"replace({expr}, '{fixed.ELLIPSIS[0]}', '{fixed.ELLIPSIS[1]}')")


def canonical(expr: str) -> str:
    return f"regexp_replace(split_part({expr}, '#', 1), '/+$', '') || '/'"


def draw(digest: str, position: str, bound: str) -> str:
    return f"(('0x' || substr({digest}, 1 + 8 * {position}, 8))::BIGINT % {bound})"


def judged(scene: str, source: str = "conversations", R: PairRules = R) -> str:
    """CTEs up to the judged candidate lines of a table like the conversations."""
    junk = "|".join(fixed.JUNK_WORDS)
    pointing = "|".join(fixed.POINTING_PHRASES)
    return f"""
    lines AS (
      SELECT conv_id, turn, CAST({scene} AS INTEGER) AS scene, lower(role) = '{R.target}' AS is_target,
             {clean('text')} AS txt FROM {source}),
    counted AS (SELECT *, {words('txt')} AS words FROM lines),
    looked AS (
      SELECT *, list(struct_pack(r := is_target, w := words, t := txt)) OVER (
        PARTITION BY conv_id, scene ORDER BY turn
        ROWS BETWEEN {R.context_turns} PRECEDING AND 1 PRECEDING) AS c FROM counted),
    judged AS (
      SELECT *, CASE
        WHEN words < {R.min_target_words} THEN '{fixed.TOO_SHORT}'
        WHEN words > {R.max_target_words} THEN '{fixed.TOO_LONG}'
        WHEN regexp_matches(txt, '^({junk})[.!?]?$', 'i') THEN '{fixed.JUNK}'
        WHEN regexp_matches(txt, '\\b({pointing})\\b', 'i') THEN '{fixed.NEEDS_VISUAL}'
        WHEN coalesce(len(c), 0) = 0 THEN '{fixed.NO_CONTEXT}'
        WHEN c[-1].r THEN '{R.follows_target}'
        WHEN list_sum([CASE WHEN x.r THEN 0 ELSE x.w END FOR x IN c]) < {R.min_prompt_words}
          THEN '{fixed.PROMPT_TOO_SHORT}' END AS reason
      FROM looked WHERE is_target)"""


def kept(scene: str) -> str:
    """CTEs up to the deduplicated kept candidates."""
    return judged(scene) + """,
    kept AS (
      SELECT * FROM judged WHERE reason IS NULL
      QUALIFY row_number() OVER (PARTITION BY lower(txt) ORDER BY conv_id, turn) = 1)"""


def prompts(source: str) -> str:
    """CTEs that merge the context ``c`` of ``source`` into messages and show them as one string."""
    return f"""
    turns AS (
      SELECT conv_id, turn, i, c[i].r AS r, c[i].t AS t
      FROM (SELECT conv_id, turn, c, unnest(range(1, len(c) + 1)) AS i FROM {source})),
    trimmed AS (
      SELECT * FROM turns
      QUALIFY sum(CASE WHEN r THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) > 0),
    marked AS (
      SELECT *, lag(r) OVER (PARTITION BY conv_id, turn ORDER BY i) AS prev FROM trimmed),
    islands AS (
      SELECT *, sum(CASE WHEN r IS DISTINCT FROM prev THEN 1 ELSE 0 END)
        OVER (PARTITION BY conv_id, turn ORDER BY i) AS island FROM marked),
    msgs AS (
      SELECT conv_id, turn, island, bool_or(r) AS r, string_agg(t, ' ' ORDER BY i) AS content
      FROM islands GROUP BY conv_id, turn, island),
    prompts AS (
      SELECT conv_id, turn, count(*) AS messages, string_agg(
        CASE WHEN r THEN 'assistant: ' ELSE 'user: ' END || content, chr(10) ORDER BY island) AS prompt
      FROM msgs GROUP BY conv_id, turn)"""


def split_of(source: str, episode: str, fraction: float = fixed.HELDOUT_FRACTION, seed: int = fixed.SEED) -> str:
    """CTEs ``groups`` (episode, split) of the seeded digest order."""
    return f"""
    titles AS (SELECT DISTINCT {episode} AS episode FROM {source}),
    placed AS (
      SELECT episode, row_number() OVER (ORDER BY md5('{seed}:' || episode), episode) AS place,
             count(*) OVER () AS n FROM titles),
    groups AS (
      SELECT episode, CASE WHEN place <= greatest(1, CAST(floor(n * {fraction}::DOUBLE) AS BIGINT))
        THEN 'heldout' ELSE 'train' END AS split FROM placed)"""


SCORED = """
    v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    n AS (SELECT count(*) AS n FROM v),
    scored AS (
      SELECT r.vec_id, r.label, list_cosine_similarity(b.e, r.e) AS base_cosine,
             list_cosine_similarity(s.e, r.e) AS sft_cosine
      FROM v r, n, v b, v s
      WHERE b.vec_id = (r.vec_id + 1) % n.n AND s.vec_id = (r.vec_id + 2) % n.n)"""

GRADED = """
    graded AS (
      SELECT d.lang AS subject, (l.quality = CAST(d.n_chars > 1500 AS INTEGER))::INTEGER AS base_right,
             (l.quality = CAST(d.n_chars > 300 AS INTEGER))::INTEGER AS sft_right
      FROM labels l JOIN documents d USING (doc_id)),
    scopes AS (
      SELECT CASE WHEN grouping(subject) = 1 THEN 'overall' ELSE subject END AS scope,
             count(*) AS questions, sum(base_right)::BIGINT AS base_correct,
             sum(sft_right)::BIGINT AS sft_correct,
             count(*) FILTER (base_right = 1 AND sft_right = 0) AS base_correct_sft_wrong,
             count(*) FILTER (base_right = 0 AND sft_right = 1) AS base_wrong_sft_correct
      FROM graded GROUP BY GROUPING SETS ((subject), ()))"""

ITEMS = """
    items AS (
      SELECT 'subject_' || (item_id % 3) AS subject, CASE WHEN item_id // 3 < 5 THEN 'dev' ELSE 'test' END AS split,
             (CASE WHEN item_id // 3 < 5 THEN item_id // 3 ELSE item_id // 3 - 5 END)::INTEGER AS idx,
             text AS question, {words} AS w, length(text) % 4 AS answer
      FROM (SELECT *, {cleaned} AS txt FROM benchmark))""".format(
    words=words("txt"), cleaned=clean("text"))
