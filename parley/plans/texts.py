"""Queries on text normalisation, splitting, classification and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import gate as G
from parley.operators.rules import cascade_sql
from parley.sources.tables import table


def _statements(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "statements", "stmt_id", *columns).distinct()


def txt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of clean texts without stop words."""
    rows = _statements(spark, sf_dir, "clean_text").where("clean_text is not null").withColumn("t", T.tokens(F.col("clean_text")))
    return rows.select("stmt_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def txt_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of stems."""
    stems = _statements(spark, sf_dir, "clean_text").where("clean_text is not null").select(F.explode(T.tokens(F.col("clean_text"), stem=True)).alias("stem"))
    return stems.groupBy("stem").agg(F.count("*").alias("n"))


def txt_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of meeting items, with their number."""
    rows = table(spark, sf_dir, "meeting_items", "id", "content").distinct().where("content is not null")
    return rows.select("id", F.posexplode(T.sentences(F.col("content"))).alias("sentence_no", "sentence"))


def txt_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts without time marks and markup."""
    return _statements(spark, sf_dir, "raw_text").select("stmt_id", T.without_markup(F.col("raw_text")).alias("cleaned"))


def txt_stutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts without hesitation sounds and repeated words."""
    return _statements(spark, sf_dir, "raw_text").select("stmt_id", T.without_stutter(T.without_markup(F.col("raw_text"))).alias("cleaned"))


def txt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker labels, cleaned, with the number of statements."""
    return _statements(spark, sf_dir, "speaker").where("speaker is not null").groupBy(T.speaker_label(F.col("speaker")).alias("label")).agg(F.count("*").alias("n"))


def txt_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task descriptions with a capital first letter and a final stop."""
    text = T.cap_first(F.trim("full_description"))
    rows = table(spark, sf_dir, "task_nodes", "node_id", "full_description").distinct().where("full_description is not null")
    return rows.select("node_id", F.when(text.rlike(r"[.!?]$"), text).otherwise(F.concat(text, F.lit("."))).alias("description"))


def gen_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of clean texts, split at contrastive connectives."""
    return G.clauses(_statements(spark, sf_dir, "clean_text"), "clean_text").select("stmt_id", "clause_idx", "clause")


METRIC = r"\$?\d+(?:,\d{3})*(?:\.\d+)?(?: ?(?:percent|units|points|dollars|%))?"


def gen_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics that clean texts name."""
    rows = _statements(spark, sf_dir, "clean_text").select("stmt_id", F.posexplode(F.regexp_extract_all("clean_text", F.lit(METRIC), F.lit(0))).alias("metric_no", "metric"))
    return rows


def gen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word candidates of topics: neighbouring tokens, the most frequent twenty."""
    toks = _statements(spark, sf_dir, "clean_text").where("clean_text is not null").select("stmt_id", T.tokens(F.col("clean_text")).alias("t")).where(F.size("t") >= 2)
    pairs = toks.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.element_at("t", i), F.element_at("t", i + 1)))).alias("phrase"))
    return pairs.groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(20)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "statements", "meeting_id", "turn_idx", "stmt_id", "clean_text").distinct()
    # several cleanings of one statement: the longest counts, of equals the last by the alphabet
    rows = rows.where("clean_text is not null").groupBy("meeting_id", "turn_idx", "stmt_id").agg(F.max_by("clean_text", F.struct(F.length("clean_text"), "clean_text")).alias("clean_text"))
    return G.classified(G.clauses(rows, "clean_text"), "meeting_id", ["turn_idx", "stmt_id", "clause_idx"])


def cls_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's category of each clause."""
    return _classified(spark, sf_dir).select("meeting_id", "turn_idx", "stmt_id", "clause_idx", "clause", "category", "confidence", "is_retained")


def agg_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement audit of each meeting."""
    return G.audit(_classified(spark, sf_dir), "meeting_id")


def agg_gate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses by the gate's category, kept or not."""
    return _classified(spark, sf_dir).groupBy("category", "is_retained").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


# Kinds of temporal expressions in order, and what tells the past; results depend on each.
_MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_DAY = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
TEMPORAL = (
    ("event_trigger", r"\b(?:before|prior to)\s+(?:the\s+)?(?:demo|deployment|release|meeting|launch|review|testing|migration)\b"),
    ("event_trigger", r"\b(?:after|following)\s+(?:the\s+)?(?:approval|sign-off|testing|demo|review|release)\b"),
    ("conditional", r"\b(?:once|as soon as)\s+[a-z0-9_\s\-]+?(?:passes|is verified|is approved|completes|is available|lands)\b"),
    ("conditional", r"\buntil\s+[a-z0-9_\s\-]+?(?:happens|completes|is resolved|finishes)\b"),
    ("relative", r"\b(?:(?:by|before|due|within)\s*)?(?:today|tomorrow|this afternoon|this evening|tonight|this week|next week|by eod|end of day|end of week|this friday)\b"),
    ("duration", r"\b(?:within|in)\s+(?:one|two|three|four|five|\d+)\s+(?:working\s+|business\s+)?(?:days?|weeks?|hours?|months?)\b"),
    ("day_of_week", rf"\b(?:by|on|at|before)\s+(?:{_DAY})(?:\s+(?:morning|afternoon|evening|\d{{1,2}}(?::\d{{2}})?\s*(?:am|pm)?))?\b"),
    ("clock_time", r"\b(?:by|at|before)\s+\d{1,2}(?::\d{2})?\s*(?:am|pm)\b"),
    ("calendar_date", rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_MONTH})\b"),
)
PAST = r"\b(?:fixed|completed|finished|shipped|resolved|closed|built|went|was|were|happened|occurred|deployed|merged)\b.*\b(?:yesterday|last\s+week|on\s+(?:monday|tuesday|wednesday|thursday|friday)|earlier)\b"
AHEAD = r"\b(?:will|can|need to|should|by tomorrow|today|this week|next week)\b"


def ext_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first temporal expression of each clean text by the order of its types; none where the past is told."""
    low = F.lower("clean_text")
    past = low.rlike(PAST) & ~low.rlike(AHEAD)
    kind, expr = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(TEMPORAL):
        found = low.rlike(pattern)
        kind, expr = F.when(found, F.lit(name)).otherwise(kind), F.when(found, F.trim(F.regexp_extract(low, pattern, 0))).otherwise(expr)
    rows = _statements(spark, sf_dir, "clean_text").where(F.col("clean_text").isNotNull() & ~past).select("stmt_id", kind.alias("kind"), expr.alias("expr"))
    return rows.where("kind is not null")


def ext_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of task descriptions, with the number of tasks and of owners."""
    rows = table(spark, sf_dir, "task_nodes", "node_id", "full_description", "owner").where("full_description is not null")
    return rows.groupBy(F.lower(F.regexp_extract("full_description", r"^\W*(\w+)", 1)).alias("verb")).agg(F.countDistinct("node_id").alias("n_tasks"), F.countDistinct("owner").alias("n_owners"))


NUMBERS = ("two hundred five", "two million five hundred thousand", "ninety nine point five", "twelve", "one thousand and one", "forty two apples")


def txt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of spoken numbers."""
    rows = spark.createDataFrame([(t,) for t in NUMBERS], "spoken string")
    return rows.select("spoken", T.spoken_number(F.split("spoken", " ")).alias("value"))


def _sql_tokens(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    parts = f"string_split(trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\\s_-]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')"
    strip = f"list_transform({parts}, lambda w: regexp_replace(regexp_replace(w, '^-+|-+$', '', 'g'), '^_+|_+$', '', 'g'))"
    return f"list_filter({strip}, lambda w: length(w) >= 2 AND w NOT IN ({stop}))"


def _sql_stem(w: str) -> str:
    cases = "\n".join(f"WHEN ends_with({w}, '{s}') AND length({w}) - {len(s)} >= 3 THEN {w}[1:length({w}) - {len(s)}] || '{r}'" for s, r in (x.split(":") for x in T.SUFFIXES))
    return f"CASE WHEN length({w}) <= 3 THEN {w} {cases} ELSE {w} END"


def _sql_markup(c: str) -> str:
    out = f"translate(translate({c}, '’‘', ''''''), '“”', '\"\"')"
    for p, r in T.MARKUP:
        out = f"regexp_replace({out}, '{p}', '{r.replace('$', chr(92))}', 'g')"
    return f"trim({out})"


_ST = "(SELECT DISTINCT stmt_id, {0} FROM statements)"
_TOK = f"(SELECT stmt_id, {_sql_tokens('clean_text')} AS t FROM {_ST.format('clean_text')} WHERE clean_text IS NOT NULL)"
_CLAUSES = f"""
base AS (SELECT meeting_id, turn_idx, stmt_id, clean_text FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, turn_idx, stmt_id ORDER BY length(clean_text) DESC, clean_text DESC) AS rn FROM statements WHERE clean_text IS NOT NULL) WHERE rn = 1),
parts AS (SELECT meeting_id, turn_idx, stmt_id, list_filter(list_transform(string_split_regex(trim(clean_text), '(?i){G.CONNECTIVES}'), lambda c: trim(c)), lambda c: c <> '') AS p FROM base WHERE clean_text IS NOT NULL),
clauses AS (SELECT meeting_id, turn_idx, stmt_id, unnest(range(len(p)))::INT AS clause_idx, unnest(p) AS clause FROM parts),
lagged AS (SELECT *, lower(clause) AS low, lower(lag(clause) OVER (PARTITION BY meeting_id ORDER BY turn_idx, stmt_id, clause_idx)) AS prev, len(string_split_regex(trim(clause), '\\s+')) AS n FROM clauses),
gated AS (SELECT meeting_id, turn_idx, stmt_id, clause_idx, clause,
  {cascade_sql(G.RULES, 'low', 'prev', 'n', G.OTHER, 'category')} AS category,
  {cascade_sql(G.RULES, 'low', 'prev', 'n', G.OTHER, 'confidence')} AS confidence,
  {cascade_sql(G.RULES, 'low', 'prev', 'n', G.OTHER, 'is_retained')} AS is_retained FROM lagged)
"""
_n = lambda *c: f"count(*) FILTER (category IN ({', '.join(repr(x) for x in c)}))"
_TEMP = lambda what: "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN " + (f"'{k}'" if what == "kind" else f"trim(regexp_extract(low, '{p}', 0))") for k, p in TEMPORAL) + " END"

QUERIES = {f.__name__: f for f in (txt_tokens, txt_stems, txt_sentences, txt_markup, txt_stutter, txt_labels, txt_capitals, txt_numbers, gen_clauses, gen_metrics, gen_phrases, cls_gate, agg_audit, agg_gate_classes, ext_temporal, ext_verbs)}
SQL = {
    "txt_tokens": f"SELECT stmt_id, len(t)::INT AS n_tokens, array_to_string(t, ' ') AS tokens FROM {_TOK}",
    "txt_stems": f"SELECT {_sql_stem('w')} AS stem, count(*) AS n FROM (SELECT unnest(t) AS w FROM {_TOK}) GROUP BY ALL",
    "txt_sentences": """SELECT id, (unnest(range(len(s))))::INT AS sentence_no, unnest(s) AS sentence FROM
      (SELECT id, list_filter(list_transform(string_split_regex(content, '[.!?\\n]+'), lambda x: trim(x)), lambda x: length(x) > 3) AS s FROM (SELECT DISTINCT id, content FROM meeting_items WHERE content IS NOT NULL))""",
    "txt_markup": f"SELECT stmt_id, {_sql_markup('raw_text')} AS cleaned FROM {_ST.format('raw_text')}",
    "txt_labels": """SELECT CASE WHEN b = '' THEN 'Speaker' ELSE b END AS label, count(*) AS n FROM
      (SELECT trim(regexp_replace(trim(regexp_replace(speaker, '[*_\\[\\]():]', '', 'g')), '^\\d+', '')) AS b FROM (SELECT DISTINCT stmt_id, speaker FROM statements WHERE speaker IS NOT NULL)) GROUP BY ALL""",
    "txt_capitals": """SELECT node_id, CASE WHEN regexp_matches(d, '[.!?]$') THEN d ELSE d || '.' END AS description FROM
      (SELECT DISTINCT node_id, upper(trim(full_description)[1]) || trim(full_description)[2:] AS d FROM task_nodes WHERE full_description IS NOT NULL)""",
    "txt_numbers": "SELECT * FROM (VALUES ('two hundred five', 205.0::DOUBLE), ('two million five hundred thousand', 2500000.0), ('ninety nine point five', 99.5), ('twelve', 12.0), ('one thousand and one', 1001.0), ('forty two apples', NULL)) v(spoken, value)",
    "gen_clauses": f"SELECT stmt_id, (unnest(range(len(p))))::INT AS clause_idx, unnest(p) AS clause FROM (SELECT stmt_id, list_filter(list_transform(string_split_regex(trim(clean_text), '(?i){G.CONNECTIVES}'), lambda c: trim(c)), lambda c: c <> '') AS p FROM {_ST.format('clean_text')} WHERE clean_text IS NOT NULL)",
    "gen_metrics": f"SELECT stmt_id, (unnest(range(len(m))))::INT AS metric_no, unnest(m) AS metric FROM (SELECT stmt_id, regexp_extract_all(clean_text, '{METRIC}') AS m FROM {_ST.format('clean_text')} WHERE clean_text IS NOT NULL)",
    "gen_phrases": f"SELECT phrase, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS phrase FROM {_TOK}) GROUP BY ALL ORDER BY n DESC, phrase LIMIT 20",
    "cls_gate": f"WITH {_CLAUSES} SELECT meeting_id, turn_idx, stmt_id, clause_idx, clause, category, confidence::DOUBLE AS confidence, is_retained FROM gated",
    "agg_audit": f"""WITH {_CLAUSES} SELECT meeting_id, count(*) AS total, count(*) FILTER (is_retained) AS kept, count(*) FILTER (NOT is_retained) AS discarded,
      round(100.0 * count(*) FILTER (is_retained) / count(*), 1) AS retention_pct, {_n('DECISION')} AS decisions, {_n('CONFIRMED_ACTION', 'CONDITIONAL_ACTION', 'OWNER_ASSIGNMENT')} AS actions, {_n('BLOCKER')} AS blockers,
      {_n('QUESTION')} AS questions, {_n('TARGET', 'CURRENT_VALUE', 'HISTORICAL_VALUE', 'PROFESSIONAL_FACT')} AS facts, {_n('CASUAL', 'GOSSIP', 'SARCASM', 'BADMOUTHING', 'EMOTIONAL_VENTING')} AS casual FROM gated GROUP BY ALL""",
    "agg_gate_classes": f"WITH {_CLAUSES} SELECT category, is_retained, count(*) AS n, round(avg(confidence::DOUBLE), 6) AS mean_confidence FROM gated GROUP BY ALL",
    "ext_temporal": f"SELECT * FROM (SELECT stmt_id, {_TEMP('kind')} AS kind, {_TEMP('expr')} AS expr FROM (SELECT stmt_id, lower(clean_text) AS low FROM {_ST.format('clean_text')} WHERE clean_text IS NOT NULL) WHERE NOT (regexp_matches(low, '{PAST}') AND NOT regexp_matches(low, '{AHEAD}'))) WHERE kind IS NOT NULL",
    "ext_verbs": "SELECT lower(regexp_extract(full_description, '^\\W*(\\w+)', 1)) AS verb, count(DISTINCT node_id) AS n_tasks, count(DISTINCT owner) AS n_owners FROM task_nodes WHERE full_description IS NOT NULL GROUP BY ALL",
}
