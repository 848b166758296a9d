"""Catalogue: keyword tables over whole question texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrade.catalog.registry import items, label_verdicts, query
from sparkgrade.functions import wordlists as wl
from sparkgrade.operators import keywords
from sparkgrade.plans.reports import KeywordReport, keyword_report


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(words)))


def _renamed(column: str, aliases: dict[str, str]) -> str:
    branches = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in aliases.items())
    return f"CASE {column} {branches} ELSE {column} END"


_STOP = wl.STOPWORDS + wl.ITEM_STOPWORDS + wl.GENERIC_STOPWORDS

# Tokens as rows with their place; phrases by looking one and two tokens ahead.
_PHRASES_SQL = rf"""
    cleaned AS (
      SELECT CAST(doc_id AS VARCHAR) AS id, lang AS split, replace(
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
          '\\(?:texttt|textbf|textit|emph|mathrm|mathbf|mathit)\s*\{{([^{{}}]*)\}}', ' \1 ', 'g'),
          '\\(?:begin|end)\s*\{{[^{{}}]*\}}', ' ', 'g'), '\\[a-zA-Z]+\*?', ' ', 'g'), '[_^{{}}$&%#~\\]', ' ', 'g'), '-', ' ') AS body
      FROM documents),
    words AS (
      SELECT id, split, unnest(regexp_extract_all(body, '[A-Za-z][A-Za-z0-9_]*')) AS word,
             generate_subscripts(regexp_extract_all(body, '[A-Za-z][A-Za-z0-9_]*'), 1) AS place
      FROM cleaned),
    bare AS (
      SELECT id, split, place, regexp_replace(trim(lower(word), '_'), '^[0-9]+|[0-9]+$', '', 'g') AS tok FROM words),
    tokens AS (
      SELECT id, split, place, CASE WHEN length(tok) >= 3 AND tok NOT IN ({_quoted(_STOP)})
        THEN {_renamed('tok', wl.TOKEN_ALIASES)} END AS t1
      FROM bare),
    ahead AS (SELECT *, lead(t1, 1) OVER w AS t2, lead(t1, 2) OVER w AS t3 FROM tokens WINDOW w AS (PARTITION BY id ORDER BY place)),
    grams AS (
      SELECT id, split, t1 AS gram FROM ahead
      UNION ALL SELECT id, split, t1 || ' ' || t2 FROM ahead WHERE t1 <> t2
      UNION ALL SELECT id, split, t1 || ' ' || t2 || ' ' || t3 FROM ahead WHERE t1 <> t2 AND t1 <> t3 AND t2 <> t3),
    found AS (
      SELECT DISTINCT id, split, {_renamed('gram', wl.PHRASE_ALIASES)} AS keyword FROM grams WHERE gram IS NOT NULL),
    phrases AS MATERIALIZED (SELECT * FROM found WHERE keyword NOT IN ({_quoted(wl.CANDIDATE_STOPWORDS)}))"""

_STATS_SQL = f"""
    {_PHRASES_SQL},
    wrong AS (
      SELECT CAST(doc_id AS VARCHAR) AS id, 'quality' AS model FROM labels WHERE quality = 0
      UNION ALL SELECT CAST(doc_id AS VARCHAR), 'toxic' FROM labels WHERE toxic = 1),
    totals AS (SELECT model, count(*) AS total_wrong FROM wrong JOIN cleaned USING (id) GROUP BY 1),
    corpus AS (SELECT keyword, count(*) AS all_question_count FROM phrases GROUP BY 1),
    hits AS (SELECT model, keyword, count(*) AS wrong_question_count FROM phrases JOIN wrong USING (id) GROUP BY 1, 2),
    stats AS MATERIALIZED (
      SELECT model, keyword, wrong_question_count, total_wrong,
             round(wrong_question_count / total_wrong, 6) AS wrong_coverage, all_question_count,
             (SELECT count(*) FROM cleaned) AS all_total,
             round(all_question_count / (SELECT count(*) FROM cleaned), 6) AS all_coverage,
             round((wrong_question_count / total_wrong) / (all_question_count / (SELECT count(*) FROM cleaned)), 6) AS lift
      FROM hits JOIN corpus USING (keyword) JOIN totals USING (model))"""

_RANK_SQL = (
    "wrong_question_count DESC, wrong_coverage DESC, len(string_split(keyword, ' ')) DESC, lift DESC, keyword"
)

_PRUNED_SQL = f"""
    {_STATS_SQL},
    ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {_RANK_SQL}) AS rn FROM stats),
    nested AS (
      SELECT p.model, p.keyword, c.container
      FROM (SELECT model, rn, keyword AS container, unnest(CASE len(w)
              WHEN 2 THEN [w[1], w[2]] WHEN 3 THEN [w[1], w[2], w[3], w[1] || ' ' || w[2], w[2] || ' ' || w[3]]
              ELSE [] END) AS part
            FROM (SELECT *, string_split(keyword, ' ') AS w FROM ranked)) c
      JOIN ranked p ON p.model = c.model AND p.keyword = c.part AND p.rn > c.rn),
    sets AS MATERIALIZED (SELECT model, keyword, list(id) AS ids FROM phrases JOIN wrong USING (id) GROUP BY 1, 2),
    covered AS (
      SELECT DISTINCT n.model, n.keyword FROM nested n
      JOIN sets a ON a.model = n.model AND a.keyword = n.keyword
      JOIN sets b ON b.model = n.model AND b.keyword = n.container
      WHERE list_has_all(b.ids, a.ids)),
    kept AS (SELECT * FROM stats ANTI JOIN covered USING (model, keyword))"""

_COLUMNS = "model, keyword, wrong_question_count, total_wrong, wrong_coverage, all_question_count, all_total, all_coverage, lift"


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return keywords.question_phrases(items(spark, folder), "question_final", **keywords.default_word_lists())


def _wrong(spark: SparkSession, folder: str) -> DataFrame:
    splits = items(spark, folder).select("id", "split")
    return label_verdicts(spark, folder).filter(~F.col("is_correct")).join(splits, "id").select("model", "split", "id")


def _report(spark: SparkSession, folder: str) -> KeywordReport:
    """The whole job: phrases, statistics, pruning, top three, links."""
    questions = items(spark, folder).withColumn("question_type", F.col("chapter"))
    evals = _wrong(spark, folder).withColumn("is_correct", F.lit(False))
    return keyword_report(questions, evals, "question_final")


@query(f"WITH {_PHRASES_SQL} SELECT keyword, count(*) AS question_count FROM phrases GROUP BY 1")
def keyword_df(spark: SparkSession, folder: str) -> DataFrame:
    """Number of questions that hold each phrase of one to three words."""
    return keywords.keyword_frequency(_found(spark, folder))


@query(f"WITH {_STATS_SQL} SELECT {_COLUMNS} FROM stats")
def keyword_lift(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage and lift of every phrase per model."""
    return keywords.keyword_stats(_found(spark, folder), _wrong(spark, folder))


@query(f"""
    WITH {_STATS_SQL}
    SELECT {_COLUMNS}, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY {_RANK_SQL}) AS INT) AS rank FROM stats) WHERE rank <= 10
""")
def keyword_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Top ten phrases per model."""
    return keywords.top_keywords(keyword_lift(spark, folder), 10)


@query(f"WITH {_PRUNED_SQL} SELECT {_COLUMNS} FROM kept")
def keyword_pruned(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases left after dropping those a better-ranked longer phrase covers."""
    return _report(spark, folder).stats


_SELECTED = ["tion", "discount factor", "inan", "nowhere at all"]


@query(f"""
    WITH {_STATS_SQL},
    named AS (SELECT unnest([{', '.join(f"'{s}'" for s in _SELECTED)}]) AS keyword),
    rows AS (
      SELECT t.model, n.keyword, t.total_wrong, coalesce(h.wrong_question_count, 0) AS w,
             coalesce(c.all_question_count, 0) AS a, (SELECT count(*) FROM cleaned) AS all_total
      FROM named n CROSS JOIN totals t LEFT JOIN hits h ON h.model = t.model AND h.keyword = n.keyword
      LEFT JOIN corpus c ON c.keyword = n.keyword)
    SELECT model, keyword, w AS wrong_question_count, total_wrong, round(w / total_wrong, 6) AS wrong_coverage,
           a AS all_question_count, all_total, round(a / all_total, 6) AS all_coverage,
           CASE WHEN a = 0 THEN 'infinity'::DOUBLE ELSE round((w / total_wrong) / (a / all_total), 6) END AS lift
    FROM rows
""")
def keyword_selected(spark: SparkSession, folder: str) -> DataFrame:
    """Named keywords per model, also where they never occur (infinite lift)."""
    selected = keywords.parse_selected("Tion, discount, inan , nowhere at all, tion")
    return keywords.keyword_stats(_found(spark, folder), _wrong(spark, folder), selected=selected)


@query(f"""
    WITH {_PRUNED_SQL},
    top AS (SELECT model, keyword FROM kept QUALIFY row_number() OVER (PARTITION BY model ORDER BY {_RANK_SQL}) <= 3)
    SELECT t.model, t.keyword, p.split, p.id, p.split AS chapter, d.source AS question_type,
           left(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), 500) AS question_preview
    FROM top t JOIN wrong w USING (model) JOIN phrases p ON p.id = w.id AND p.keyword = t.keyword
    JOIN documents d ON CAST(d.doc_id AS VARCHAR) = p.id
""")
def keyword_links(spark: SparkSession, folder: str) -> DataFrame:
    """Wrong questions behind each of the top three phrases per model."""
    return _report(spark, folder).links.select("model", "keyword", "split", "id", "chapter", "question_type", "question_preview")
