"""Queries on stored records, neighbouring turns, joins, aggregates, set operations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.operators.sequence import asof_join, islands, last_value_before, machine, numbered, streaks
from parley.sources.tables import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meeting items, each delivery but the first dropped, with categories spelled alike."""
    rows = table(spark, sf_dir, "meeting_items", "id", "meeting_id", "item_ts", "category", "speaker", "confidence", "loaded_at")
    rows = rows.groupBy("id", "meeting_id", "item_ts", "category", "speaker", "confidence").agg(F.min("loaded_at").alias("loaded_at"))
    return rows.withColumn("category", F.regexp_replace(F.lower(F.trim("category")), r"[\s-]+", "_"))


def _whole(rows: DataFrame, keys: tuple, columns: tuple) -> DataFrame:
    """One delivery of each key, whole: the greatest by `columns` in their order."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_r")).select(*keys, "_r.*")


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "statements", "meeting_id", "turn_idx", "stmt_id", "semantic_type", "entity", "stated_value", "speaker")
    return _whole(rows, ("meeting_id", "turn_idx", "stmt_id"), ("semantic_type", "entity", "stated_value", "speaker"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "task_nodes", "node_id", "meeting_id", "action_verb", "target_object", "owner", "deadline")
    return _whole(rows, ("node_id", "meeting_id"), ("action_verb", "target_object", "owner", "deadline"))


ORDER = ("turn_idx", "stmt_id")


def _w() -> Window:
    return Window.partitionBy("meeting_id").orderBy(*ORDER)


def rel_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each meeting in the order of their ids."""
    rows = numbered(_items(spark, sf_dir).where("meeting_id is not null"), ["meeting_id"], ["id", "item_ts", "category", "speaker"], width=65536)
    return rows.select("meeting_id", F.col("pos").cast("int").alias("pos"), "id", "category")


def rel_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each meeting and category."""
    return _items(spark, sf_dir).where("meeting_id is not null").groupBy("meeting_id", "category").agg(F.countDistinct("id").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def rel_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of each meeting."""
    rows = table(spark, sf_dir, "meetings", "id", "session_name", "start_time", "total_segments_analyzed", "professional_segments_retained", "discarded_segments_count", "loaded_at")
    new = F.struct("loaded_at", "total_segments_analyzed", "professional_segments_retained", "discarded_segments_count", "session_name", "start_time")
    return rows.groupBy("id").agg(F.max(new).alias("m")).select("id", "m.session_name", "m.start_time", "m.total_segments_analyzed", "m.professional_segments_retained", "m.discarded_segments_count")


def rel_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty meetings that started last."""
    return rel_meetings(spark, sf_dir).where("start_time is not null").orderBy(F.desc("start_time"), F.desc("id")).limit(20).select("id", "start_time")


def rel_latest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last summary of each meeting."""
    rows = table(spark, sf_dir, "meeting_summaries", "id", "meeting_id", "generated_at", "topics_json").where("meeting_id is not null")
    return rows.groupBy("meeting_id").agg(F.max(F.struct("id", "generated_at", F.array_join("topics_json", "|").alias("topics"))).alias("s")).select("meeting_id", F.col("s.id").alias("summary_id"), "s.generated_at", "s.topics")


def rel_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a cascade from the stored meetings keeps and drops, by category."""
    items, meetings = _items(spark, sf_dir), table(spark, sf_dir, "meetings", "id").distinct().withColumnRenamed("id", "meeting_id")
    kept = items.join(meetings, "meeting_id", "left_semi").groupBy("category").agg(F.count("*").alias("n")).withColumn("fate", F.lit("kept"))
    return kept.unionByName(items.where("meeting_id is not null").join(meetings, "meeting_id", "left_anti").groupBy("category").agg(F.count("*").alias("n")).withColumn("fate", F.lit("dropped")))


def snk_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that a session's close would store: derived from statements instead of kept up in place."""
    kept = ~F.col("semantic_type").isin("CASUAL", "OPINION", "UNCERTAINTY", "PROPOSAL")
    return _statements(spark, sf_dir).groupBy("meeting_id").agg(F.count("*").alias("analyzed"), F.count_if(kept).alias("retained"), F.count_if(~kept).alias("discarded"))


def win_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement with the one before."""
    return _statements(spark, sf_dir).select("meeting_id", "stmt_id", F.lag("stmt_id").over(_w()).alias("prev_stmt"), (F.col("turn_idx") - F.lag("turn_idx").over(_w())).alias("gap"))


def win_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the statement that answers: the next one, unless it is a question too."""
    nxt = _statements(spark, sf_dir).select("*", F.lead("stmt_id").over(_w()).alias("answer_stmt"), F.lead("semantic_type").over(_w()).alias("answer_type"))
    return nxt.where("semantic_type = 'QUESTION' AND answer_type <> 'QUESTION'").select("meeting_id", "stmt_id", "answer_stmt", "answer_type")


def win_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals that another speaker's action follows at once: the speaker takes the task on."""
    nxt = _statements(spark, sf_dir).select("*", F.lead("stmt_id").over(_w()).alias("next_stmt"), F.lead("semantic_type").over(_w()).alias("next_type"), F.lead("speaker").over(_w()).alias("owner"))
    return nxt.where("semantic_type = 'PROPOSAL' AND next_type = 'CONFIRMED_ACTION' AND owner <> speaker").select("meeting_id", "stmt_id", "next_stmt", "owner")


def win_agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals with the first decision among the next three statements, if no change of scope comes before it."""
    ahead = F.collect_list(F.struct("stmt_id", "semantic_type")).over(_w().rowsBetween(1, 3))
    rows = _statements(spark, sf_dir).withColumn("ahead", ahead).where("semantic_type = 'PROPOSAL'")
    first = F.get(F.filter("ahead", lambda x: x["semantic_type"].isin("DECISION", "SCOPE_CHANGE")), F.lit(0))
    return rows.select("meeting_id", "stmt_id", first.alias("f")).where("f.semantic_type = 'DECISION'").select("meeting_id", "stmt_id", F.col("f.stmt_id").alias("decision_stmt"))


def win_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated values with the nearest differing one among the three statements before."""
    behind = F.reverse(F.collect_list(F.struct("stmt_id", "stated_value")).over(_w().rowsBetween(-3, -1)))
    rows = _statements(spark, sf_dir).withColumn("behind", behind).where("stated_value is not null")
    first = F.get(F.filter("behind", lambda x: x["stated_value"] != F.col("stated_value")), F.lit(0))
    return rows.select("meeting_id", "stmt_id", "stated_value", first.alias("f")).where("f is not null").select("meeting_id", "stmt_id", "stated_value", F.col("f.stated_value").alias("old_value"), F.col("f.stmt_id").alias("old_stmt"))


def win_last_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity that a statement without one refers to: the last named before."""
    rows = last_value_before(_statements(spark, sf_dir), "entity", ["meeting_id"], list(ORDER), "antecedent")
    return rows.where("entity is null and antecedent is not null").select("meeting_id", "stmt_id", "antecedent")


def win_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks of professional and of casual statements; uncertain ones neither end nor lengthen one."""
    kind = F.when(F.col("semantic_type") == "CASUAL", "casual").when(F.col("semantic_type").isin("OPINION", "UNCERTAINTY"), None).otherwise("professional")
    rows = _statements(spark, sf_dir).withColumn("kind", kind).where("kind is not null")
    return streaks(rows, "kind", ["meeting_id"], list(ORDER)).select("meeting_id", "stmt_id", "kind", "streak")


def win_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one speaker's neighbouring statements."""
    rows = islands(_statements(spark, sf_dir).where("speaker <> ''"), "speaker", ["meeting_id"], list(ORDER), "run_no")
    return rows.groupBy("meeting_id", "run_no", "speaker").agg(F.count("*").alias("n"), F.min("turn_idx").alias("first_turn"), F.max("turn_idx").alias("last_turn"))


def win_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct entities of each meeting in the order in which they came up."""
    low = F.lower("entity")
    first = _statements(spark, sf_dir).where("entity is not null").groupBy("meeting_id", low.alias("entity")).agg(F.min(F.struct(*ORDER)).alias("at"))
    return first.select("meeting_id", "entity", F.row_number().over(Window.partitionBy("meeting_id").orderBy("at")).alias("pos"))


def win_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic of each meeting: its most frequent entity, the earlier of equals."""
    counts = _statements(spark, sf_dir).where("entity is not null").groupBy("meeting_id", "entity").agg(F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("at"))
    return counts.groupBy("meeting_id").agg(F.min_by("entity", F.struct(-F.col("n"), "at")).alias("topic"), F.max("n").alias("n"))


def fold_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated values of an entity, with whether a later one in the meeting supersedes them."""
    w = Window.partitionBy("meeting_id", "entity").orderBy(*ORDER)
    rows = _statements(spark, sf_dir).where("entity is not null and stated_value is not null")
    later = F.lead("stated_value").over(w)
    return rows.select("meeting_id", "entity", "stmt_id", "stated_value", (later.isNotNull() & (later != F.col("stated_value"))).alias("is_superseded"))


def fold_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context boost of each statement, which depends on the classes that earlier ones were given, boosts included.

    A statement starts from .68, from .55 if it is uncertain or .4 if it is casual; the streaks of earlier classes move
    that, and the result decides its class, which the next statement sees. Streaks count up to two, so the recurrence is
    a finite machine of nine states (three of work by three of other talk), run in chunks.
    """
    boost = lambda work, other: round((0.12 if work >= 2 else 0.05 if work == 1 else 0.0) + (-0.10 if other >= 2 else 0.0), 6)
    score = lambda base, s: round(min(1.0, max(0.0, base + boost(s // 3, s % 3))), 6)

    def after(base: float, s: int) -> int:
        work, other, x = s // 3, s % 3, score(base, s)
        work, other = (min(2, work + 1), 0) if x >= 0.70 else (0, min(2, other + 1)) if x < 0.50 else (work, other)
        return 3 * work + other

    kinds = {"casual": 0.40, "uncertain": 0.55, "other": 0.68}
    kind = F.when(F.col("semantic_type") == "CASUAL", "casual").when(F.col("semantic_type").isin("OPINION", "UNCERTAINTY"), "uncertain").otherwise("other")
    by = lambda f: F.element_at(F.create_map(*[x for k, base in kinds.items() for x in (F.lit(k), F.array(*[F.lit(f(base, s)) for s in range(9)]))]), F.col("kind"))
    rows = numbered(_statements(spark, sf_dir).select("meeting_id", *ORDER, kind.alias("kind")), ["meeting_id"], list(ORDER))
    states = machine(rows, ["meeting_id"], "pos", 9, by(after))
    at = F.col("state") + 1
    return states.select("meeting_id", "stmt_id", F.element_at(F.array(*[F.lit(boost(s // 3, s % 3)) for s in range(9)]), at).alias("boost"), F.element_at(by(score), at).alias("score"))


def jn_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose owner speaks in the meeting, by meeting."""
    spoke = _items(spark, sf_dir).where("speaker <> ''").select("meeting_id", F.lower("speaker").alias("who")).distinct()
    return _tasks(spark, sf_dir).withColumn("who", F.lower("owner")).join(spoke, ["meeting_id", "who"], "left_semi").groupBy("meeting_id").agg(F.count("*").alias("n_tasks"))


def jn_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of each meeting with their items and their first four tasks."""
    who = _items(spark, sf_dir).where("speaker <> '' and meeting_id is not null").groupBy("meeting_id", "speaker").agg(F.countDistinct("id").alias("n_items"))
    tasks = _tasks(spark, sf_dir).where("owner is not null").groupBy("meeting_id", F.col("owner").alias("speaker")).agg(F.slice(F.array_sort(F.collect_list("node_id")), 1, 4).alias("t"))
    return who.join(tasks, ["meeting_id", "speaker"], "left").select("meeting_id", "speaker", "n_items", F.coalesce(F.array_join("t", ","), F.lit("")).alias("tasks"))


def jn_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of statements on one entity that lie within three turns, counted by meeting."""
    rows = _statements(spark, sf_dir).where("entity is not null").select("meeting_id", "entity", "turn_idx")
    near = rows.alias("a").join(rows.alias("b"), ["meeting_id", "entity"]).where("b.turn_idx > a.turn_idx and b.turn_idx <= a.turn_idx + 3")
    return near.groupBy("meeting_id").agg(F.count("*").alias("n_pairs"))


def jn_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each summary with the last item of its meeting before it."""
    s = table(spark, sf_dir, "meeting_summaries", "id", "meeting_id", "generated_at").distinct().where("meeting_id is not null").withColumnRenamed("id", "summary_id")
    i = _items(spark, sf_dir).where("meeting_id is not null").groupBy("meeting_id", "item_ts").agg(F.max("id").alias("item_id"))
    return asof_join(s, i, ["meeting_id"], "generated_at", "item_ts", "item_id").select("summary_id", "meeting_id", "item_id")


def jn_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label whose centroid is nearest to each embedding, and whether it is the embedding's own."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    flat = e.select("label", F.posexplode("embedding").alias("i", "x"))
    centre = flat.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c")).withColumnRenamed("label", "near")
    centres = centre.agg(F.collect_list(F.struct("near", "c"))).scalar()  # one for each label
    met = e.select("vec_id", "label", "embedding", F.explode(centres).alias("x")).select("vec_id", "label", "embedding", "x.*")
    d = F.aggregate(F.zip_with("embedding", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    best = met.groupBy("vec_id", "label").agg(F.min_by("near", F.struct(d.alias("d"), "near")).alias("near"))
    return best.groupBy("label", "near").agg(F.count("*").alias("n"))


def agg_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of each meeting and speaker, subtotals of each meeting and the total."""
    rows = _statements(spark, sf_dir).withColumn("speaker", F.coalesce("speaker", F.lit("")))
    return rows.rollup("meeting_id", "speaker").agg(F.count("*").alias("n"))


def agg_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysed, retained and discarded segments by privacy mode, spelled alike, from the newest versions."""
    rows = table(spark, sf_dir, "meetings", "id", "privacy_mode", "loaded_at", "total_segments_analyzed", "professional_segments_retained", "discarded_segments_count")
    new = rows.groupBy("id").agg(F.max(F.struct("loaded_at", "total_segments_analyzed", "professional_segments_retained", "discarded_segments_count", "privacy_mode")).alias("m")).select("m.*")
    mode = F.coalesce(F.upper(F.trim("privacy_mode")), F.lit("UNKNOWN"))
    return new.groupBy(mode.alias("mode")).agg(F.count("*").alias("n"), F.sum("total_segments_analyzed").alias("analyzed"), F.sum("professional_segments_retained").alias("retained"), F.sum("discarded_segments_count").alias("discarded"))


def agg_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords with the number of items and meetings that have them."""
    rows = table(spark, sf_dir, "meeting_items", "id", "meeting_id", "keywords_json").select("id", "meeting_id", F.explode("keywords_json").alias("keyword"))
    return rows.groupBy("keyword").agg(F.countDistinct("id").alias("n_items"), F.countDistinct("meeting_id").alias("n_meetings"))


def top_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six statements of each kind in each meeting's report."""
    kinds = {"FACT": "facts", "RISK": "issues", "BLOCKER": "issues", "DECISION": "decisions", "CONFIRMED_ACTION": "actions"}
    section = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("semantic_type")]
    rows = _statements(spark, sf_dir).withColumn("section", section).where("section is not null")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("meeting_id", "section").orderBy(*ORDER))).where("pos <= 6").select("meeting_id", "section", "pos", "stmt_id")


def set_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that speak and own tasks, that only speak and that only own."""
    a = _items(spark, sf_dir).where("speaker <> ''").select(F.col("speaker").alias("name"))
    b = _tasks(spark, sf_dir).where("owner <> ''").select(F.col("owner").alias("name"))
    parts = (("both", a.intersect(b)), ("speaks", a.subtract(b)), ("owns", b.subtract(a)))
    out = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def rpt_responsibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by owner, in order; owners that name nobody are left out."""
    rows = _tasks(spark, sf_dir).where("owner <> '' and lower(owner) not in ('unclear', 'speaker', 'team', 'tbd', 'unspecified')")
    return rows.groupBy("owner").agg(F.count("*").alias("n_tasks"), F.array_join(F.slice(F.array_sort(F.collect_list(F.struct("node_id", "action_verb")))["action_verb"], 1, 5), ", ").alias("first_verbs"))


def rpt_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six distinct deadlines of each meeting's tasks."""
    rows = _tasks(spark, sf_dir).where("deadline <> '' and lower(deadline) <> 'unspecified'").groupBy("meeting_id", "deadline").agg(F.min("node_id").alias("node_id"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("meeting_id").orderBy("node_id"))).where("pos <= 6").select("meeting_id", "pos", "deadline")


def rpt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report of each meeting: a line for each section with the numbers of its first statements."""
    top = top_sections(spark, sf_dir)
    line = top.groupBy("meeting_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stmt_id"))), lambda x: x["stmt_id"].cast("string")), " ").alias("ids"))
    text = F.concat(F.upper("section"), F.lit(": "), "ids")
    return line.groupBy("meeting_id").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("report"))


_ITEMS = "items AS (SELECT id, meeting_id, item_ts, regexp_replace(lower(trim(category)), '[\\s-]+', '_', 'g') AS category, speaker, confidence FROM meeting_items GROUP BY id, meeting_id, item_ts, meeting_items.category, speaker, confidence)"
_one = lambda t, keys, cols: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {', '.join(c + ' DESC NULLS LAST' for c in cols)}) AS rn FROM {t}) WHERE rn = 1)"
_ST = f"st AS (SELECT meeting_id, turn_idx, stmt_id, semantic_type, entity, stated_value, speaker FROM {_one('statements', 'meeting_id, turn_idx, stmt_id', ('semantic_type', 'entity', 'stated_value', 'speaker'))})"
_TASK = f"task AS (SELECT node_id, meeting_id, action_verb, owner, deadline FROM {_one('task_nodes', 'node_id, meeting_id', ('action_verb', 'target_object', 'owner', 'deadline'))})"
_W = "OVER (PARTITION BY meeting_id ORDER BY turn_idx, stmt_id)"
_NEW = "new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, total_segments_analyzed DESC NULLS LAST, professional_segments_retained DESC NULLS LAST, discarded_segments_count DESC NULLS LAST, {0}) AS rn FROM meetings) WHERE rn = 1)"
_SEC = f"{_ST}, sec AS (SELECT meeting_id, section, row_number() OVER (PARTITION BY meeting_id, section ORDER BY turn_idx, stmt_id) AS pos, stmt_id FROM (SELECT *, CASE semantic_type WHEN 'FACT' THEN 'facts' WHEN 'RISK' THEN 'issues' WHEN 'BLOCKER' THEN 'issues' WHEN 'DECISION' THEN 'decisions' WHEN 'CONFIRMED_ACTION' THEN 'actions' END AS section FROM st) WHERE section IS NOT NULL QUALIFY pos <= 6)"

QUERIES = {
    f.__name__: f
    for f in (rel_items, rel_categories, rel_meetings, rel_recent, rel_latest_summary, rel_cascade, snk_counters, win_previous, win_answers, win_requests, win_agreements, win_corrections, win_last_entity, win_streaks, win_islands, win_dedupe, win_topics,
              fold_values, fold_context, jn_owners, jn_participants, jn_band, jn_asof, jn_nearest, agg_participation, agg_retention, agg_keywords, top_sections, set_people, rpt_responsibilities, rpt_milestones, rpt_summary)
}
SQL = {
    "rel_items": f"WITH {_ITEMS} SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY id, item_ts NULLS FIRST, category NULLS FIRST, speaker NULLS FIRST)::INT AS pos, id, category FROM items WHERE meeting_id IS NOT NULL",
    "rel_categories": f"WITH {_ITEMS} SELECT meeting_id, category, count(DISTINCT id) AS n, round(avg(confidence), 6) AS mean_confidence FROM items WHERE meeting_id IS NOT NULL GROUP BY 1, 2",
    "rel_meetings": f"WITH {_NEW.format('session_name DESC NULLS LAST, start_time DESC NULLS LAST')} SELECT id, session_name, start_time, total_segments_analyzed, professional_segments_retained, discarded_segments_count FROM new",
    "rel_recent": f"WITH {_NEW.format('session_name DESC NULLS LAST, start_time DESC NULLS LAST')} SELECT id, start_time FROM new WHERE start_time IS NOT NULL ORDER BY start_time DESC, id DESC LIMIT 20",
    "rel_latest_summary": "SELECT meeting_id, id AS summary_id, generated_at, coalesce(array_to_string(topics_json, '|'), NULL) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY id DESC, generated_at DESC, array_to_string(topics_json, '|') DESC NULLS LAST) AS rn FROM meeting_summaries WHERE meeting_id IS NOT NULL) WHERE rn = 1",
    "rel_cascade": f"WITH {_ITEMS} SELECT category, CASE WHEN meeting_id IN (SELECT id FROM meetings) THEN 'kept' ELSE 'dropped' END AS fate, count(*) AS n FROM items WHERE meeting_id IS NOT NULL GROUP BY ALL",
    "snk_counters": f"WITH {_ST} SELECT meeting_id, count(*) AS analyzed, count(*) FILTER (semantic_type NOT IN ('CASUAL', 'OPINION', 'UNCERTAINTY', 'PROPOSAL')) AS retained, count(*) FILTER (semantic_type IN ('CASUAL', 'OPINION', 'UNCERTAINTY', 'PROPOSAL')) AS discarded FROM st GROUP BY 1",
    "win_previous": f"WITH {_ST} SELECT meeting_id, stmt_id, lag(stmt_id) {_W} AS prev_stmt, turn_idx - lag(turn_idx) {_W} AS gap FROM st",
    "win_answers": f"WITH {_ST}, n AS (SELECT *, lead(stmt_id) {_W} AS answer_stmt, lead(semantic_type) {_W} AS answer_type FROM st) SELECT meeting_id, stmt_id, answer_stmt, answer_type FROM n WHERE semantic_type = 'QUESTION' AND answer_type <> 'QUESTION'",
    "win_requests": f"WITH {_ST}, n AS (SELECT *, lead(stmt_id) {_W} AS next_stmt, lead(semantic_type) {_W} AS next_type, lead(speaker) {_W} AS owner FROM st) SELECT meeting_id, stmt_id, next_stmt, owner FROM n WHERE semantic_type = 'PROPOSAL' AND next_type = 'CONFIRMED_ACTION' AND owner <> speaker",
    "win_agreements": f"""WITH {_ST}, o AS (SELECT *, row_number() {_W} AS r FROM st), c AS (SELECT a.meeting_id, a.stmt_id, b.stmt_id AS decision_stmt, b.semantic_type, row_number() OVER (PARTITION BY a.meeting_id, a.r ORDER BY b.r) AS k
      FROM o a JOIN o b ON a.meeting_id = b.meeting_id AND b.r BETWEEN a.r + 1 AND a.r + 3 WHERE a.semantic_type = 'PROPOSAL' AND b.semantic_type IN ('DECISION', 'SCOPE_CHANGE')) SELECT meeting_id, stmt_id, decision_stmt FROM c WHERE k = 1 AND semantic_type = 'DECISION'""",
    "win_corrections": f"""WITH {_ST}, o AS (SELECT *, row_number() {_W} AS r FROM st), c AS (SELECT a.meeting_id, a.stmt_id, a.stated_value, b.stated_value AS old_value, b.stmt_id AS old_stmt, row_number() OVER (PARTITION BY a.meeting_id, a.r ORDER BY b.r DESC) AS k
      FROM o a JOIN o b ON a.meeting_id = b.meeting_id AND b.r BETWEEN a.r - 3 AND a.r - 1 WHERE b.stated_value <> a.stated_value) SELECT meeting_id, stmt_id, stated_value, old_value, old_stmt FROM c WHERE k = 1""",
    "win_last_entity": f"WITH {_ST} SELECT meeting_id, stmt_id, antecedent FROM (SELECT *, last_value(entity IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY turn_idx, stmt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antecedent FROM st) WHERE entity IS NULL AND antecedent IS NOT NULL",
    "win_streaks": f"""WITH {_ST}, k AS (SELECT *, CASE WHEN semantic_type = 'CASUAL' THEN 'casual' WHEN semantic_type IN ('OPINION', 'UNCERTAINTY') THEN NULL ELSE 'professional' END AS kind FROM st), f AS (SELECT *, (kind IS DISTINCT FROM lag(kind) {_W})::INT AS s FROM k WHERE kind IS NOT NULL),
      g AS (SELECT *, sum(s) {_W} AS isl FROM f) SELECT meeting_id, stmt_id, kind, row_number() OVER (PARTITION BY meeting_id, isl ORDER BY turn_idx, stmt_id) AS streak FROM g""",
    "win_islands": f"WITH {_ST}, f AS (SELECT *, (speaker IS DISTINCT FROM lag(speaker) {_W})::INT AS s FROM st WHERE speaker <> ''), g AS (SELECT *, sum(s) {_W} AS run_no FROM f) SELECT meeting_id, run_no::BIGINT AS run_no, speaker, count(*) AS n, min(turn_idx) AS first_turn, max(turn_idx) AS last_turn FROM g GROUP BY 1, 2, 3",
    "win_dedupe": f"WITH {_ST}, d AS (SELECT meeting_id, lower(entity) AS entity, min((turn_idx, stmt_id)) AS place FROM st WHERE entity IS NOT NULL GROUP BY 1, 2) SELECT meeting_id, entity, row_number() OVER (PARTITION BY meeting_id ORDER BY place) AS pos FROM d",
    "win_topics": f"WITH {_ST}, c AS (SELECT meeting_id, entity, count(*) AS n, min((turn_idx, stmt_id)) AS place FROM st WHERE entity IS NOT NULL GROUP BY 1, 2) SELECT meeting_id, entity AS topic, n FROM c QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY n DESC, place) = 1",
    "fold_values": f"WITH {_ST}, v AS (SELECT *, lead(stated_value) OVER (PARTITION BY meeting_id, entity ORDER BY turn_idx, stmt_id) AS nxt FROM st WHERE entity IS NOT NULL AND stated_value IS NOT NULL) SELECT meeting_id, entity, stmt_id, stated_value, nxt IS NOT NULL AND nxt <> stated_value AS is_superseded FROM v",
    "fold_context": f"""WITH RECURSIVE {_ST}, o AS (SELECT *, row_number() {_W} AS r, CASE WHEN semantic_type = 'CASUAL' THEN 0.40 WHEN semantic_type IN ('OPINION', 'UNCERTAINTY') THEN 0.55 ELSE 0.68 END::DOUBLE AS base FROM st),
      f(meeting_id, r, stmt_id, boost, score, work, other) AS (
        SELECT meeting_id, r, stmt_id, 0.0::DOUBLE, base, CASE WHEN base >= 0.7 THEN 1 ELSE 0 END, CASE WHEN base < 0.5 THEN 1 ELSE 0 END FROM o WHERE r = 1
        UNION ALL SELECT meeting_id, r, stmt_id, boost, score, CASE WHEN score >= 0.7 THEN work + 1 WHEN score < 0.5 THEN 0 ELSE work END, CASE WHEN score >= 0.7 THEN 0 WHEN score < 0.5 THEN other + 1 ELSE other END
        FROM (SELECT *, round(least(1.0, greatest(0.0, base + boost)), 6) AS score FROM (SELECT o.meeting_id, o.r, o.stmt_id, o.base, f.work, f.other, round((CASE WHEN work >= 2 THEN 0.12 WHEN work = 1 THEN 0.05 ELSE 0 END + CASE WHEN other >= 2 THEN -0.10 ELSE 0 END)::DOUBLE, 6) AS boost FROM f JOIN o ON o.meeting_id = f.meeting_id AND o.r = f.r + 1)))
      SELECT meeting_id, stmt_id, boost, score FROM f""",
    "jn_owners": f"WITH {_ITEMS}, {_TASK} SELECT meeting_id, count(*) AS n_tasks FROM task t WHERE EXISTS (SELECT 1 FROM items i WHERE i.meeting_id = t.meeting_id AND i.speaker <> '' AND lower(i.speaker) = lower(t.owner)) GROUP BY 1",
    "jn_participants": f"WITH {_ITEMS}, {_TASK}, w AS (SELECT meeting_id, speaker, count(DISTINCT id) AS n_items FROM items WHERE speaker <> '' AND meeting_id IS NOT NULL GROUP BY 1, 2), t AS (SELECT meeting_id, owner, list_sort(list(node_id))[1:4] AS t FROM task WHERE owner IS NOT NULL GROUP BY 1, 2) SELECT w.meeting_id, speaker, n_items, coalesce(array_to_string(t, ','), '') AS tasks FROM w LEFT JOIN t ON t.meeting_id = w.meeting_id AND t.owner = w.speaker",
    "jn_band": f"WITH {_ST} SELECT a.meeting_id, count(*) AS n_pairs FROM st a JOIN st b ON a.meeting_id = b.meeting_id AND a.entity = b.entity AND b.turn_idx > a.turn_idx AND b.turn_idx <= a.turn_idx + 3 GROUP BY 1",
    "jn_asof": f"WITH {_ITEMS}, s AS (SELECT DISTINCT id AS summary_id, meeting_id, generated_at FROM meeting_summaries WHERE meeting_id IS NOT NULL), i AS (SELECT meeting_id, item_ts, max(id) AS item_id FROM items WHERE meeting_id IS NOT NULL GROUP BY 1, 2) SELECT summary_id, s.meeting_id, item_id FROM s ASOF LEFT JOIN i ON s.meeting_id = i.meeting_id AND s.generated_at >= i.item_ts",
    "jn_nearest": "WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2), e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), d AS (SELECT vec_id, e.label, c.label AS near, sum((e.x - c.x) ** 2) AS d FROM e JOIN c USING (i) GROUP BY 1, 2, 3) SELECT label, near, count(*) AS n FROM (SELECT vec_id, label, arg_min(near, (d, near)) AS near FROM d GROUP BY 1, 2) GROUP BY 1, 2",
    "agg_participation": f"WITH {_ST}, x AS (SELECT meeting_id, coalesce(speaker, '') AS speaker FROM st) SELECT meeting_id, speaker, count(*) AS n FROM x GROUP BY ROLLUP (meeting_id, speaker)",
    "agg_retention": f"WITH {_NEW.format('privacy_mode DESC NULLS LAST')} SELECT coalesce(upper(trim(privacy_mode)), 'UNKNOWN') AS mode, count(*) AS n, sum(total_segments_analyzed)::BIGINT AS analyzed, sum(professional_segments_retained)::BIGINT AS retained, sum(discarded_segments_count)::BIGINT AS discarded FROM new GROUP BY 1",
    "agg_keywords": "SELECT keyword, count(DISTINCT id) AS n_items, count(DISTINCT meeting_id) AS n_meetings FROM (SELECT id, meeting_id, unnest(keywords_json) AS keyword FROM meeting_items) GROUP BY 1",
    "top_sections": f"WITH {_SEC} SELECT * FROM sec",
    "set_people": f"WITH {_ITEMS}, {_TASK}, a AS (SELECT DISTINCT speaker AS name FROM items WHERE speaker <> ''), b AS (SELECT DISTINCT owner AS name FROM task WHERE owner <> '') SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'speaks', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'owns', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "rpt_responsibilities": f"WITH {_TASK} SELECT owner, count(*) AS n_tasks, array_to_string(list(action_verb ORDER BY node_id, action_verb)[1:5], ', ') AS first_verbs FROM task WHERE owner <> '' AND lower(owner) NOT IN ('unclear', 'speaker', 'team', 'tbd', 'unspecified') GROUP BY 1",
    "rpt_milestones": f"WITH {_TASK}, d AS (SELECT meeting_id, deadline, min(node_id) AS node_id FROM task WHERE deadline <> '' AND lower(deadline) <> 'unspecified' GROUP BY 1, 2) SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY node_id) AS pos, deadline FROM d QUALIFY pos <= 6",
    "rpt_summary": f"WITH {_SEC} SELECT meeting_id, array_to_string(list_sort(list(line)), chr(10)) AS report FROM (SELECT meeting_id, upper(section) || ': ' || array_to_string(list(stmt_id ORDER BY pos), ' ') AS line FROM sec GROUP BY meeting_id, section) GROUP BY 1",
}
