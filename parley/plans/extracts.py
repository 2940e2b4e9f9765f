"""Queries that test, score and take apart single statements and tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators.rules import word
from parley.plans.texts import _sql_tokens
from parley.sources.tables import table

# Openings that carry no content, in the order in which they are taken off; \x27 is an apostrophe.
PREAMBLES = (
    r"^\s*[\*_\[\]\(\)]+\s*",
    r"^(?:(?:yes|no|yeah|yep|sure|ok|alright|good morning|good morning everyone)[,\s\-]+)+",
    r"^(?:(?:arsenal|real madrid|barcelona|chelsea|liverpool|india|australia) (?:won|played well|played amazingly)[.!?,\s\-]+)+",
    r"^(?:(?:it was (?:great|good|fun)|went hiking|had fun|great match|great game)[.!?,\s\-]+)+",
    r"^(?:(?:but )?(?:speaking of|getting to|getting back to|talking about|regarding) [^.!?]+?[,\s\-]+)+",
    r"^(?:(?:honestly|frankly|personally|to be honest|look|listen|man|dude|gosh|damn|ugh)[,\s\-]+)+",
    r"^(?:i (?:really )?(?:hate|dislike|can\x27t stand) (?:this|the|our|working with) [a-zA-Z0-9_\s\-]+?(?:,| but| yet|\.|;)\s*)",
    r"^(?:this (?:terrible|horrible|annoying|frustrating|broken|stupid|ridiculous) [a-zA-Z0-9_\s\-]+? is (?:so |really )?(?:bad|terrible|annoying|frustrating|ridiculous)[,\s\-]+)+",
    r"^(?:(?:the |our )?(?:manager|lead|boss|management|finance|team|developer) (?:is|are) (?:being )?(?:useless|incompetent|ridiculous|impossible|lazy|annoying|terrible|stupid|awful)[^.!?]*?(?:because|since|as|\.|;)\s*)",
    r"^(?:(?:management|leadership|they) (?:doesn\x27t|don\x27t) understand (?:this|the) (?:project|work)[.!?,\s\-]+)+",
    r"^(?:(?:everyone is|people are) (?:frustrated|upset|angry) with [^.!?]+?[.!?,\s\-]+)+",
    r"^(?:(?:she|he) (?:never listens|is terrible at (?:her|his) job|never approves anything)[.!?,\s\-]+)+",
    r"^(?:(?:anyway|anyways|on another note|by the way|excellent|perfect|great)[,\s\-:\.]+)+",
    r"^(?:(?:this|the) (?:stupid|broken|terrible|annoying) [a-zA-Z0-9_\s\-]+? (?:keeps|is) [^.!?]+?(?:driving everyone crazy|driving us crazy|annoying everyone)[.!?,\s\-]+)",
    r"^(?:after (?:lunch|dinner|coffee|the break|my break|work)[,\s\-]+)",
    r"^(?:did you (?:watch|see|hear about) [^.!?]+?[.!?]\s*(?:yes|no|yeah)?[^.!?]*?[.!?]\s*(?:but|speaking of work|anyway)?[,\s\-]+)",
)
#: Cues at the start or anywhere in a statement, by kind.
CUES = {
    "agreement": r"^(?:agreed|approved|yes|sounds good|ok|exactly|both )",
    "acceptance": word("i will|we will|i can|let me"),
    "out_of_scope": word("out of scope|not part of|rather than|after the freeze|does not"),
    "administration": word("take the minutes|let's move on|hold on|meet at"),
    "commitment": word("must be|has to|needs? a|have to"),
    "uncertain": word("maybe|there is a risk|somebody|do you know"),
}
# Words that tell a meeting's domain; of equals the first domain counts.
DOMAINS = {"engineering": ("firmware", "sensor", "pipeline", "gateway", "cluster", "parser"), "logistics": ("pallet", "conveyor", "warehouse", "container", "label", "packing"), "business": ("budget", "contract", "tender", "invoice", "costs", "proposal")}
#: Kinds of content that a statement may have, several at once.
KINDS = {"issue": word("risk|fails?|missing|mixed up|overheats"), "condition": word("if|before|until|once"), "requirement": word("must|needs?|has to"), "status": word("is|was|stays|stands"), "action": word("will|please|let us")}


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "statements", "stmt_id", "meeting_id", "semantic_type", "clean_text").where("clean_text is not null")
    return rows.groupBy("stmt_id", "meeting_id").agg(F.max(F.struct("clean_text", "semantic_type")).alias("r")).select("stmt_id", "meeting_id", "r.*").withColumn("low", F.lower("clean_text"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "task_nodes", "node_id", "full_description", "owner").groupBy("node_id").agg(F.max(F.struct("full_description", "owner")).alias("r")).select("node_id", "r.*")


def txt_preambles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements without openings that carry nothing, capitalised again."""
    bare = F.trim(reduce(lambda t, p: F.regexp_replace(t, "(?i)" + p, ""), PREAMBLES, F.trim("clean_text")))
    return _texts(spark, sf_dir).select("stmt_id", T.cap_first(bare).alias("content"))


def flt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with each cue, by semantic type."""
    hit = [F.when(F.col("low").rlike(p), F.lit(k)) for k, p in CUES.items()]
    return _texts(spark, sf_dir).select("semantic_type", F.explode(F.array_compact(F.array(*hit))).alias("cue")).groupBy("semantic_type", "cue").agg(F.count("*").alias("n"))


def flt_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that only tell: three past verbs or more, more than fifteen words and no modal."""
    past = F.size(F.regexp_extract_all("low", F.lit(r"[a-z]+ed\b"), F.lit(0)))
    rows = _texts(spark, sf_dir).where((past >= 3) & (F.size(F.split("low", r"\s+")) > 15) & ~F.col("low").rlike(word("will|must|should|can|need|has to")))
    return rows.select("stmt_id", past.alias("n_past"))


def cls_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of each statement: .80, more for a full sentence, less for noise, fragments and vague subjects."""
    n = F.size(F.split(F.trim("clean_text"), r"\s+"))
    score = F.lit(0.80) + F.when(F.col("clean_text").rlike(r"[.!?]$"), 0.1).otherwise(0.0) + F.when(n >= 8, 0.1).otherwise(0.0)
    score = score - F.when(F.col("low").rlike(word("uh|um|er|hmm|speaker_\\d+")), 0.4).otherwise(0.0) - F.when(n < 4, 0.3).otherwise(0.0) - F.when(F.col("low").rlike(r"^(?:this|that|it|they) "), 0.1).otherwise(0.0)
    return _texts(spark, sf_dir).select("stmt_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 2).alias("quality"))


def agg_transcript_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrupted and fragmentary statements of each meeting, a score and its level."""
    n = F.size(F.split(F.trim("clean_text"), r"\s+"))
    bad = F.count_if(F.col("clean_text").rlike(r"[<>{}*]|-->|\n"))
    cut = F.count_if((n < 4) | ~F.col("clean_text").rlike(r"[.!?]$"))
    score = F.round(1 - (0.25 * bad + 0.10 * cut) / F.count("*"), 6)
    rows = _texts(spark, sf_dir).groupBy("meeting_id").agg(bad.alias("corrupted"), cut.alias("fragments"), score.alias("score"))
    return rows.withColumn("level", F.when(F.col("score") >= 0.85, "HIGH").when(F.col("score") >= 0.60, "MEDIUM").otherwise("LOW"))


def cls_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of each meeting: most of its words found, the first of equals; confidence grows with their number."""
    rows = _texts(spark, sf_dir)
    found = rows.groupBy("meeting_id").agg(*[sum((F.max(F.col("low").contains(w)).cast("int") for w in ws), F.lit(0)).alias(d) for d, ws in DOMAINS.items()])
    best = F.greatest(*DOMAINS)
    name = F.when(best == 0, "general")
    for d in DOMAINS:
        name = name.when(F.col(d) == best, d)
    return found.select("meeting_id", name.alias("domain"), F.round(F.least(F.lit(0.95), 0.6 + 0.05 * best), 6).alias("confidence"))


def cls_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by all kinds of content that they have."""
    rows = _texts(spark, sf_dir).select("stmt_id", F.explode(F.array_compact(F.array(*[F.when(F.col("low").rlike(p), F.lit(k)) for k, p in KINDS.items()]))).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def ext_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is to act in a statement: the speaker, the group, somebody addressed or nobody."""
    low = F.col("low")
    actor = F.when(low.rlike("^i (?:will|can|am)"), "speaker").when(low.rlike("^(?:we|let us|our) "), "group").when(low.rlike("^(?:please|could|can|would) |^keep "), "addressee").when(low.rlike(r"^(?:the )?[a-z]+ ?[a-z]* (?:asked|found|will|has to) "), "third")
    return _texts(spark, sf_dir).groupBy(F.coalesce(actor, F.lit("none")).alias("actor"), "semantic_type").agg(F.count("*").alias("n"))


def flt_deliverables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of three words or more that name something to deliver."""
    words = T.tokens(F.col("full_description"))
    things = F.array(*[F.lit(x) for x in ("report", "contract", "pipeline", "runbook", "dashboard", "budget", "manifest", "survey", "policy", "invoice-feed")])
    return _tasks(spark, sf_dir).where((F.size(words) >= 3) & F.arrays_overlap(words, things)).select("node_id", F.size(words).alias("n_words"))


def flt_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners that can be names: 2 to 20 letters in the first word, none of the words that name nobody."""
    first = F.regexp_extract(F.trim("owner"), r"^([A-Za-z]+)", 1)
    ok = (F.length(first) >= 2) & (F.length(first) <= 20) & ~F.lower(first).isin("team", "unclear", "tbd", "unspecified", "speaker", "qa", "whoever", "the")
    return _tasks(spark, sf_dir).where(F.col("owner").isNotNull() & ok).groupBy(T.cap_first(F.lower(first)).alias("name")).agg(F.count("*").alias("n"))


def jn_subsumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a meeting that aren't part of a longer one of it."""
    e = table(spark, sf_dir, "statements", "meeting_id", "entity").where("entity is not null").select("meeting_id", F.lower("entity").alias("entity")).distinct()
    longer = e.select(F.col("meeting_id").alias("m"), F.col("entity").alias("whole"))
    return e.join(longer, (F.col("meeting_id") == F.col("m")) & (F.length("whole") > F.length("entity")) & F.col("whole").contains(F.col("entity")), "left_anti")


def rpt_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of each meeting: up to five statements of each kind on one card."""
    kinds = F.when(F.col("semantic_type").isin("DECISION", "SCOPE_CHANGE"), "decisions").when(F.col("semantic_type").isin("CONFIRMED_ACTION", "CONDITIONAL_ACTION"), "tasks").when(F.col("semantic_type").isin("RISK", "BLOCKER"), "risks").when(F.col("semantic_type") == "QUESTION", "open")
    rows = _texts(spark, sf_dir).withColumn("card", kinds).where("card is not null")
    card = Window.partitionBy("meeting_id", "card")
    first = rows.select("meeting_id", "card", "stmt_id", "clean_text", F.count("*").over(card).alias("n"), F.row_number().over(card.orderBy("stmt_id", "clean_text")).alias("k")).where("k <= 5")
    return first.groupBy("meeting_id", "card", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "clean_text"))), lambda x: x["clean_text"]), "\n").alias("items"))


def gen_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping frames of 32 of the 64 values of each embedding, every 16, with their energy."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    rows = e.select("vec_id", F.explode(F.sequence(F.lit(0), F.size("embedding") - 32, F.lit(16))).alias("start"), "embedding")
    frame = F.transform(F.slice("embedding", F.col("start") + 1, 32), lambda x: x.cast("double") * x.cast("double"))
    return rows.select("vec_id", "start", F.round(F.aggregate(frame, F.lit(0.0), lambda a, x: a + x) / 32, 6).alias("energy"))


_TX = "tx AS (SELECT stmt_id, meeting_id, semantic_type, clean_text, lower(clean_text) AS low FROM (SELECT *, row_number() OVER (PARTITION BY stmt_id, meeting_id ORDER BY clean_text DESC, semantic_type DESC NULLS LAST) AS rn FROM statements WHERE clean_text IS NOT NULL) WHERE rn = 1)"
_TK = "tk AS (SELECT node_id, full_description, owner FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY full_description DESC NULLS LAST, owner DESC NULLS LAST) AS rn FROM task_nodes) WHERE rn = 1)"
_m = lambda p, c="low": "regexp_matches(" + c + ", '" + p.replace("'", "''") + "')"
_bare = reduce(lambda t, p: f"regexp_replace({t}, '(?i){p}', '', 'g')", PREAMBLES, "trim(clean_text)")
_n = "len(string_split_regex(trim(clean_text), '\\s+'))"
_greatest = f"greatest({', '.join(DOMAINS)})"

QUERIES = {f.__name__: f for f in (txt_preambles, flt_cues, flt_narrative, cls_quality, agg_transcript_quality, cls_domains, cls_kinds, ext_actors, flt_deliverables, flt_names, jn_subsumed, rpt_notes, gen_frames)}
SQL = {
    "txt_preambles": f"WITH {_TX} SELECT stmt_id, upper(b[1]) || b[2:] AS content FROM (SELECT stmt_id, trim({_bare}) AS b FROM tx)",
    "flt_cues": f"WITH {_TX} SELECT semantic_type, cue, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT semantic_type, '{k}' AS cue FROM tx WHERE {_m(p)}" for k, p in CUES.items()) + ") GROUP BY 1, 2",
    "flt_narrative": f"WITH {_TX} SELECT stmt_id, len(regexp_extract_all(low, '[a-z]+ed\\b'))::INT AS n_past FROM tx WHERE len(regexp_extract_all(low, '[a-z]+ed\\b')) >= 3 AND len(string_split_regex(low, '\\s+')) > 15 AND NOT {_m(word('will|must|should|can|need|has to'))}",
    "cls_quality": f"WITH {_TX} SELECT stmt_id, round(least(1.0, greatest(0.0, 0.8::DOUBLE + CASE WHEN {_m('[.!?]$', 'clean_text')} THEN 0.1 ELSE 0 END + CASE WHEN {_n} >= 8 THEN 0.1 ELSE 0 END - CASE WHEN {_m(word('uh|um|er|hmm|speaker_\\d+'))} THEN 0.4 ELSE 0 END - CASE WHEN {_n} < 4 THEN 0.3 ELSE 0 END - CASE WHEN {_m('^(?:this|that|it|they) ')} THEN 0.1 ELSE 0 END)), 2) AS quality FROM tx",
    "agg_transcript_quality": f"""WITH {_TX}, q AS (SELECT meeting_id, count(*) FILTER ({_m('[<>{}*]|-->|\\n', 'clean_text')}) AS corrupted, count(*) FILTER ({_n} < 4 OR NOT {_m('[.!?]$', 'clean_text')}) AS fragments, count(*) AS n FROM tx GROUP BY 1), s AS (SELECT meeting_id, corrupted, fragments, round(1 - (0.25::DOUBLE * corrupted + 0.10::DOUBLE * fragments) / n, 6) AS score FROM q)
      SELECT *, CASE WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s""",
    "cls_domains": f"WITH {_TX}, d AS (SELECT meeting_id, " + ", ".join("(" + " + ".join(f"max(contains(low, '{w}')::INT)" for w in ws) + f") AS {d}" for d, ws in DOMAINS.items()) + f" FROM tx GROUP BY 1) SELECT meeting_id, CASE WHEN {_greatest} = 0 THEN 'general' " + " ".join(f"WHEN {d} = {_greatest} THEN '{d}'" for d in DOMAINS) + f" END AS domain, round(least(0.95, 0.6 + 0.05 * {_greatest})::DOUBLE, 6) AS confidence FROM d",
    "cls_kinds": f"WITH {_TX} SELECT kind, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind FROM tx WHERE {_m(p)}" for k, p in KINDS.items()) + ") GROUP BY 1",
    "ext_actors": f"WITH {_TX} SELECT CASE WHEN {_m('^i (?:will|can|am)')} THEN 'speaker' WHEN {_m('^(?:we|let us|our) ')} THEN 'group' WHEN {_m('^(?:please|could|can|would) |^keep ')} THEN 'addressee' WHEN {_m('^(?:the )?[a-z]+ ?[a-z]* (?:asked|found|will|has to) ')} THEN 'third' ELSE 'none' END AS actor, semantic_type, count(*) AS n FROM tx GROUP BY 1, 2",
    "flt_deliverables": f"WITH {_TK}, w AS (SELECT node_id, {_sql_tokens('full_description')} AS t FROM tk WHERE full_description IS NOT NULL) SELECT node_id, len(t)::INT AS n_words FROM w WHERE len(t) >= 3 AND list_has_any(t, ['report', 'contract', 'pipeline', 'runbook', 'dashboard', 'budget', 'manifest', 'survey', 'policy', 'invoice-feed'])",
    "flt_names": f"WITH {_TK}, f AS (SELECT regexp_extract(trim(owner), '^([A-Za-z]+)', 1) AS w FROM tk WHERE owner IS NOT NULL) SELECT upper(lower(w)[1]) || lower(w)[2:] AS name, count(*) AS n FROM f WHERE length(w) BETWEEN 2 AND 20 AND lower(w) NOT IN ('team', 'unclear', 'tbd', 'unspecified', 'speaker', 'qa', 'whoever', 'the') GROUP BY 1",
    "jn_subsumed": "WITH e AS (SELECT DISTINCT meeting_id, lower(entity) AS entity FROM statements WHERE entity IS NOT NULL) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e l WHERE l.meeting_id = e.meeting_id AND length(l.entity) > length(e.entity) AND contains(l.entity, e.entity))",
    "rpt_notes": f"WITH {_TX}, c AS (SELECT *, CASE WHEN semantic_type IN ('DECISION', 'SCOPE_CHANGE') THEN 'decisions' WHEN semantic_type IN ('CONFIRMED_ACTION', 'CONDITIONAL_ACTION') THEN 'tasks' WHEN semantic_type IN ('RISK', 'BLOCKER') THEN 'risks' WHEN semantic_type = 'QUESTION' THEN 'open' END AS card FROM tx) SELECT meeting_id, card, count(*) AS n, array_to_string(list(clean_text ORDER BY stmt_id, clean_text)[1:5], chr(10)) AS items FROM c WHERE card IS NOT NULL GROUP BY 1, 2",
    "gen_frames": "WITH v AS (SELECT vec_id, start, embedding FROM embeddings, (VALUES (0), (16), (32)) t(start)) SELECT vec_id, start::INT AS start, round(list_sum(list_transform(embedding[start + 1:start + 32], lambda x: x::DOUBLE * x::DOUBLE)) / 32, 6) AS energy FROM v",
}
