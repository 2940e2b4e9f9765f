"""The meeting state machine: clauses to procedures, corrections, gates, facts, issues, decisions and actions.

Steps are tried in order for each clause and the first that fits decides what it yields and how many clauses it takes
(a question takes its answer, a request its acceptance, a proposal the discussion up to the agreement). What is taken
counts no more; that recurrence is a finite machine, run in chunks. Later passes drop what a correction supersedes, add
metrics not yet told, and clear repeats.

Clauses come from the statements; as their sentences hardly hold such talk, a made dialogue is mixed in: each statement
is followed by one of its lines. Every text is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import gate as G
from parley.operators.rules import cascade_sql
from parley.operators.sequence import machine, neighbours, numbered
from parley.plans.dialect import DUCK, SPARK, Spark, sql
from parley.sources.tables import cut, table

#: The dialogue that is mixed in: speaker and line.
DIALOGUE = (
    ("Ingrid", "Good morning everyone"), ("Rhys", "The approved budget is $42,000 for the harbour sensor."), ("Ingrid", "Actually the latest confirmed budget is $45,000 for the harbour sensor."),
    ("Sven", "Can you send the audit report by 5 pm?"), ("Rhys", "Yes, I will do it"), ("Ingrid", "How long will the database migration take?"), ("Sven", "About three working days for the pipeline"),
    ("Rhys", "Olga, prepare the vendor contract tomorrow"), ("Sven", "Review the security model before the release."), ("Ingrid", "We decided to ship the client without the export feature, and defer the export feature to phase two."),
    ("Rhys", "Let us move the dashboard to the next release, the report agrees."), ("Sven", "Sounds good to me, the test plan agrees"), ("Ingrid", "The upload is failing because of the expired certificate of the server."),
    ("Rhys", "Olga owns the vendor review."), ("Sven", "I will fix it by friday for the pipeline"), ("Ingrid", "The cpu is 82% and the warning threshold is 85% for the server."), ("Rhys", "The error rate of the api has improved since the last patch."),
    ("Sven", "The launch can begin only after the security audit."), ("Ingrid", "Response time of the api went from 40 seconds to 12 seconds"), ("Rhys", "The offline mode of the client is out of scope"),
    ("Sven", "If the nightly test fails, we roll back the branch"), ("Ingrid", "The vendor approval is pending"), ("Rhys", "The launch cannot proceed until the firmware test passes."), ("Sven", "The motion passed and the audit report was approved."),
    ("Ingrid", "To recap: the primary blocker is the firmware test"), ("Rhys", "What caused the server failure?"), ("Sven", "A full disk of the database"), ("Ingrid", "The office seating is a separate topic for the vendor"),
    ("Rhys", "The release is not ready because of the bug"), ("Sven", "The pipeline serves 1,200 users and 14% of the requests"),
)

# Cues of the steps, as patterns in lower case.
VOTE = r"\b(?:motion (?:passed|passes|carried|failed|denied)|voted to approve|moves? to adjourn|second(?:s|ed) the motion|roll call)\b"
RECAP = r"(?:to summarize|final recap|in summary|to recap):"
CORRECTS = r"\b(?:no|sorry|correction|actually|outdated|latest confirmed|latest result|latest measurement|latest value|the latest|current value|not yet|still pending|revised|wait|instead|rather|we confirmed|turns out|in fact|approved)\b"
UNRELATED = r"unrelated to (?:this|our) meeting|not part of this meeting|separate topic|not on the agenda|lunch today|office seating"
SCOPE = r"\b(?:outside (?:the )?(?:current )?(?:release\s+scope|release|scope)|out of scope)\b"
GATES = r"requires|cannot proceed until|can proceed only after|must (?:succeed|pass) before|required (?:before|for) release|release conditions"
AFTER = r"\b(?:can begin only after|can proceed only after|only after)\b"
CHANGED = r"\b([a-z0-9_\s\-]+?)\s+(?:went|increased|dropped|changed)\s+from\s+(\d+\s*(?:hours?|minutes?|seconds?|%)?)\s+to\s+(\d+\s*(?:hours?|minutes?|seconds?|%)?)"
FAILS = r"\bif\s+([a-z0-9_\s\-]+?)\s+fails,\s*(?:we\s+)?([a-z0-9_\s\-]+)"
ASKS = r"\?|^(?:is the|is this|are there|what is|what happens|how long|who is|when can|when will)"
REQUEST = r"\b(?:can you|could you|would you|please)\s+([a-z0-9_\s,\-]{4,150})"
ACCEPTS = r"\b(?:yes|sure|i will|i'll|will do|i can|i am on it|perfect)\b"
AGREES = r"^(?:agreed|i agree|sounds good|that works|good idea|fair enough|definitely|perfect|exactly|confirmed|approved|will do|yep|yeah|yes)\b"
REJECTS = r"do not record|not approved|i disagree|not possible|^no[.,]|ignore that"
VERBS = "investigate|send|prepare|book|schedule|deploy|fix|create|review|audit|finalize|draft|organize|write|coordinate|complete|notify|publish|configure|implement|build|run|test|launch|obtain|submit|pull|record|update|handle"
COMMAND = rf"^([A-Z][a-z]+)[,\s\-]+(?:please\s+)?({VERBS})\s+([A-Za-z0-9_\s,\-]{{3,120}})"
IMPERATIVE = rf"^(?:please\s+)?({VERBS})\s+([a-z0-9_\s,\-]{{3,120}})\.?$"
PROPOSES = r"we decided|we have decided|let's move|let us move|let's defer|we should|i recommend|how about|what if we|ship the|ship without|let's keep"
SHIP = r"\bship\s+(?:the\s+)?([a-z0-9_\s\-]+?)\s+without\s+([a-z0-9_\s\-]+?)(?:,|\.|\band\b|$)"
DEFER = r"\b(?:defer|moves?)\s+(?:the\s+)?([a-z0-9_\s\-]+?)\s+to\s+(?:the\s+)?([a-z0-9_\s\-]+)"
OWNS = r"\b([A-Z][a-z]+)\s+(?:owns|is taking over|takes over)\s*(?:the\s+)?([A-Za-z0-9_\s\-]+)?"
COMMITS = r"\b(?:i will|i'll|i can|i am going to)\s+([a-z0-9_\s,\-]{4,150})"
OTHERS = r"\b([A-Z][a-z]+)\s+will\s+([A-Za-z0-9_\s,\-]{4,150})"
RISKS = r"warning threshold|cpu is|capacity|approaching"
BETTER = r"improved|decreased|dropped|fixed|resolved|under control|better now"
ISSUES = r"discrepancy|differs from|failing|failed|failure|crash|timeout|error|exhaustion|below target|slowdown|caused by|caused the"
CAUSE = r"(?:due to|caused by|because of|because)\s+([a-z0-9_\s\-]+)"
DOUBT = r"suspect|might|could|possibly|may be|appears to be|likely|perhaps|probabl|potentially"
WAITS = r"approval is|is blocked because|is pending"
METRIC = r"\$\s*\d+(?:,\d{3})*(?:\.\d+)?k?|\d+(?:\.\d+)?%|\d+\s*(?:minutes?|seconds?|hours?|ms|users|requests|candidates|participants)|\d+,\d{3}"
MONEY = r"\$\s*\d+(?:,\d{3})*(?:\.\d+)?k?|\d+(?:\.\d+)?%"
PRONOUN = r"^(?:draft|investigate|create|review|fix|update|test|deploy|do|handle|defer|add|send)\s+(?:it|this|that|those)\b"
NOUNS = "report|contract|model|client|feature|dashboard|plan|server|review|rate|api|audit|database|migration|pipeline|test|sensor|budget|certificate|branch|approval|firmware|bug|requests"
ENTITY = rf"\b(?:[a-z]+ )?(?:{NOUNS})\b"


def _near_sql() -> str:
    """Clauses with their gate's decision and their neighbours, as DuckDB computes them."""
    d, case = DUCK, lambda f: cascade_sql(G.RULES, "low", "lower(p1)", "n_words", G.OTHER, f)
    near = ", ".join(f"lag(clause, {i}) OVER w AS p{i}, lead(clause, {i}) OVER w AS n{i}, lead(speaker, {i}) OVER w AS s{i}" for i in (1, 2, 3))
    return f"""st AS (SELECT * FROM (SELECT meeting_id, turn_idx, stmt_id, speaker, clean_text, row_number() OVER (PARTITION BY meeting_id, turn_idx, stmt_id ORDER BY length(clean_text) DESC, clean_text DESC, speaker DESC NULLS LAST) AS rn FROM statements WHERE clean_text IS NOT NULL) WHERE rn = 1),
talk AS (SELECT meeting_id, turn_idx, stmt_id, 0 AS src, coalesce(speaker, '') AS speaker, clean_text AS text FROM st UNION ALL SELECT meeting_id, turn_idx, stmt_id, 1, d.speaker, d.text FROM st JOIN {d.values([(i, *x) for i, x in enumerate(DIALOGUE)], "n, speaker, text")} d ON d.n = turn_idx % {len(DIALOGUE)}),
parts AS (SELECT *, list_filter(list_transform(string_split_regex(trim(text), '(?i){G.CONNECTIVES}'), lambda c: trim(c)), lambda c: c <> '') AS p FROM talk),
cl AS (SELECT meeting_id, turn_idx, stmt_id, src, speaker, unnest(range(len(p)))::INT AS clause_idx, unnest(p) AS clause FROM parts),
ne AS (SELECT *, row_number() OVER w AS pos, {near} FROM cl WINDOW w AS (PARTITION BY meeting_id ORDER BY turn_idx, stmt_id, src, clause_idx)),
lo AS (SELECT *, lower(clause) AS low, len(string_split_regex(trim(clause), '\\s+')) AS n_words FROM ne),
near AS (SELECT *, {case('category')} AS category, {case('is_retained')} AS is_retained FROM lo)"""


NEAR = {f"{n}{i}": (c, s * i) for i in (1, 2, 3) for n, c, s in (("p", "clause", -1), ("n", "clause", 1), ("s", "speaker", 1))}


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with their gate's decision, their place in the meeting and their neighbours within three places."""
    rows = table(spark, sf_dir, "statements", "meeting_id", "turn_idx", "stmt_id", "speaker", "clean_text").where("clean_text is not null")
    best = F.max(F.struct(F.length("clean_text").alias("n"), "clean_text", "speaker"))
    st = rows.groupBy("meeting_id", "turn_idx", "stmt_id").agg(best.alias("b")).select("meeting_id", "turn_idx", "stmt_id", "b.speaker", "b.clean_text")
    line = F.element_at(F.array(*[F.struct(F.lit(s).alias("speaker"), F.lit(t).alias("text")) for s, t in DIALOGUE]), (F.col("turn_idx") % len(DIALOGUE) + 1).cast("int"))
    both = F.array(F.struct(F.coalesce("speaker", F.lit("")).alias("speaker"), F.col("clean_text").alias("text")), line)
    talk = st.select("meeting_id", "turn_idx", "stmt_id", F.posexplode(both).alias("src", "t")).select("meeting_id", "turn_idx", "stmt_id", "src", "t.speaker", "t.text")
    cl = G.clauses(talk, "text").drop("text")
    ne = neighbours(numbered(cl, ["meeting_id"], ["turn_idx", "stmt_id", "src", "clause_idx"]), ["meeting_id"], "pos", NEAR)
    g = G.gate(F.lower("clause"), F.lower("p1"), F.size(F.split(F.trim("clause"), r"\s+")))
    return ne.select("*", F.lower("clause").alias("low"), g.alias("g")).select("*", "g.category", "g.is_retained").drop("g")


def steps_sql(d: Spark) -> str:
    """near to stepped: the step that decides each clause, how many clauses it takes, and its older value if it corrects one."""
    has = lambda p, c="low": d.has(c, p)
    older = "coalesce(" + ", ".join(f"CASE WHEN nullif({d.get(f'lower(p{i})', MONEY, 0)}, '') <> {d.get('low', MONEY, 0)} THEN {d.get(f'lower(p{i})', MONEY, 0)} END" for i in (1, 2, 3)) + ")"
    agrees = lambda i: f"({has(AGREES, f'lower(n{i})')} OR {has(ACCEPTS, f'lower(n{i})')})"
    ends = lambda i: f"({has(REJECTS, f'lower(n{i})')} OR {has(UNRELATED, f'lower(n{i})')})"
    outcome = "CASE " + " ".join(f"WHEN coalesce({ends(i)}, false) THEN -{i} WHEN coalesce({agrees(i)}, false) THEN {i}" for i in (1, 2, 3)) + " ELSE 0 END"
    accepted = f"({has(REQUEST)} AND coalesce({has(ACCEPTS, 'lower(n1)')}, false))"
    answered = f"(n1 IS NOT NULL AND {has('how long|timeline|what is causing|why is|what caused|has |have |is ')})"
    return f"""older AS (SELECT *, CASE WHEN {d.get('low', MONEY, 0)} <> '' AND {has(CORRECTS)} THEN {older} END AS old_value, {outcome} AS outcome FROM near),
stepped AS (SELECT *, CASE WHEN length(clause) < 3 THEN 'short' WHEN NOT is_retained THEN 'dropped' WHEN {has(VOTE)} THEN 'procedure' WHEN {has(RECAP)} THEN 'recap'
  WHEN old_value IS NOT NULL THEN 'correction' WHEN {has(UNRELATED)} THEN 'unrelated' WHEN {has(SCOPE)} THEN 'scope' WHEN {has(FAILS)} THEN 'failure'
  WHEN {has('currently not ready|release is not ready')} THEN 'not_ready'
  WHEN {has(ASKS)} AND NOT {accepted} THEN CASE WHEN {answered} THEN 'answered' ELSE 'question' END
  WHEN {has(REQUEST)} THEN CASE WHEN {accepted} THEN 'accepted' ELSE 'request' END
  WHEN {d.has('clause', COMMAND)} THEN 'command' WHEN {has(IMPERATIVE)} THEN 'imperative'
  WHEN {has(PROPOSES)} AND {has(SHIP)} THEN 'ship' WHEN {has(PROPOSES)} AND outcome > 0 THEN 'agreed' WHEN {has(PROPOSES)} AND outcome < 0 THEN 'rejected'
  WHEN {d.has('clause', OWNS)} THEN 'ownership' WHEN {has(COMMITS)} OR {d.has('clause', OTHERS)} THEN 'commitment'
  WHEN {has(RISKS)} THEN 'risk' WHEN {has(BETTER)} THEN 'better' WHEN {has(ISSUES)} THEN 'issue' WHEN {has(WAITS)} THEN 'waiting' WHEN {has(METRIC)} THEN 'metric' ELSE 'other' END AS step FROM older),
taken AS (SELECT *, CASE WHEN step IN ('answered', 'accepted') THEN 2 WHEN step IN ('agreed', 'rejected') THEN abs(outcome) + 1 ELSE 1 END AS takes FROM stepped)"""


#: Steps that stop before the parsers of gates, dependencies and changes are tried.
EARLY = "('short', 'dropped', 'procedure', 'recap', 'correction', 'unrelated', 'scope')"


def yields_sql(d: Spark) -> str:
    """live (clauses that count, with their step and the antecedent of a pronoun) to out: (meeting_id, pos, kind, text, owner, status, value)."""
    cap = lambda x: f"concat(upper(substring({x}, 1, 1)), substring({x}, 2))"
    has, get = (lambda p: d.has("low", p)), (lambda p, g=1: f"trim({d.get('low', p, g)})")
    bare = lambda x: "trim(" + d.sub(d.sub(x, r"^(?:i will|i can|we will|please|take care of|to)\s+", ""), r"\b(?:by \d+ ?[ap]m|by friday|tomorrow|today|tonight|this morning)\b.*$", "") + ")"
    whole = lambda x: f"CASE WHEN {d.has(x, PRONOUN)} THEN CASE WHEN antecedent IS NULL THEN 'referenced task unclear' ELSE concat({d.get(x, '^([a-z]+)')}, ' the ', antecedent) END ELSE {x} END"
    deadline = (
        f"CASE WHEN {d.get('low', r'(\d{1,2}(?::\d{2})?\s*(?:am|pm))\b')} <> '' THEN concat('by ', upper({d.get('low', r'(\d{1,2}(?::\d{2})?\s*(?:am|pm))\b')})) WHEN {has(r'\btomorrow\b')} THEN 'tomorrow' WHEN {has(r'\bthis morning\b')} THEN 'this morning' "
        f"WHEN {has(r'\btonight\b')} THEN 'tonight' WHEN {has(r'\b(?:by|on|this) friday\b')} THEN 'by Friday' WHEN {has(r'\btoday\b')} THEN 'today' ELSE 'unspecified' END"
    )
    row = lambda kind, where, text, owner="NULL", status="NULL", value="NULL": f"SELECT meeting_id, pos, '{kind}' AS kind, {text} AS text, {owner} AS owner, {status} AS status, {value} AS value FROM live WHERE {where}"
    task = lambda kind, where, x, owner: row(kind, where, cap(bare(f"({whole(x)})")), owner, "'CONFIRMED'", deadline)
    cause = get(CAUSE)
    parts = [
        row("procedure", "step = 'procedure'", "clause", status=f"CASE WHEN {has('failed|denied')} THEN 'REJECTED' ELSE 'ADOPTED' END"),
        row("gate", "step = 'recap' AND " + has("blocker is"), f"concat({cap(get(r'blocker is (?:the )?([a-z0-9_ \-]+)'))}, ' must be resolved before release')", status="'BLOCKED'"),
        row("correction", "step = 'correction'", f"concat({d.get('low', MONEY, 0)}, ' (revised from earlier ', old_value, ')')", status="old_value", value=d.get("low", MONEY, 0)),
        row("out_of_scope", "step = 'unrelated'", "clause"),
        row("decision", "step = 'scope'", "clause", "speaker", "'OUT_OF_SCOPE'"),
        row("gate", f"step NOT IN {EARLY} AND {has(GATES)}", "clause", status="'BLOCKED'", value=f"nullif({get(r'(?:cannot proceed until|requires|only after)\s+([a-z0-9_\s\-]+)')}, '')"),
        row("dependency", f"step NOT IN {EARLY} AND {has(AFTER)}", get(AFTER[:-2] + r"\s+([^.]+)"), value=get(r"^(.*?)\s*" + AFTER)),
        row("fact", f"step NOT IN {EARLY} AND {has(CHANGED)}", f"concat({get(CHANGED)}, ': ', {get(CHANGED, 2)}, ' -> ', {get(CHANGED, 3)})", status="'METRIC'", value=get(CHANGED, 3)),
        row("fact", "step = 'failure'", f"concat('If ', {get(FAILS)}, ' fails, ', {get(FAILS, 2)})", status="'STATUS'"),
        row("gate", "step = 'not_ready'", "'Release is not ready'", status="'BLOCKED'"),
        row("fact", "step = 'answered' AND " + has("how long|timeline"), "concat('Estimated duration: ', n1)", "s1", "'STATUS'"),
        row("fact", "step = 'answered' AND " + has("what is causing|why is|what caused") + " AND NOT " + has("how long|timeline"), "concat('Root cause: ', n1)", "s1", "'STATUS'"),
        row("unresolved", "step = 'question' AND " + has("blocking|broken|failing|timeline|who is"), "concat(speaker, ': ', clause)"),
        task("action", "step = 'accepted'", get(REQUEST), "s1"),
        task("action", "step = 'request'", get(REQUEST), "'Unassigned'"),
        task("action", "step = 'command'", f"lower(concat({d.get('clause', COMMAND, 2)}, ' ', {d.get('clause', COMMAND, 3)}))", d.get("clause", COMMAND, 1)),
        task("action", "step = 'imperative'", f"concat({get(IMPERATIVE)}, ' ', {get(IMPERATIVE, 2)})", "'Unassigned'"),
        row("decision", "step = 'ship'", f"concat('Ship the ', {get(SHIP)}, ' without ', {get(SHIP, 2)}, '.')", "speaker", "'ADOPTED'"),
        row("decision", "step = 'ship' AND " + has(DEFER), f"concat('Defer ', {get(DEFER)}, ' to ', {get(DEFER, 2)}, '.')", "speaker", "'DEFERRED'"),
        row("decision", "step = 'agreed'", f"CASE WHEN {has(DEFER)} THEN concat('Defer ', {get(DEFER)}, ' to ', {get(DEFER, 2)}, '.') ELSE clause END", "speaker", f"CASE WHEN {has(DEFER)} THEN 'DEFERRED' ELSE 'ADOPTED' END", "CASE outcome WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END"),
        task("action", "step = 'ownership'", f"lower(trim({d.get('clause', OWNS, 2)}))", d.get("clause", OWNS, 1)),
        task("action", "step = 'commitment'", f"CASE WHEN {has(COMMITS)} THEN {get(COMMITS)} ELSE lower(trim({d.get('clause', OTHERS, 2)})) END", f"CASE WHEN {has(COMMITS)} THEN speaker ELSE {d.get('clause', OTHERS, 1)} END"),
        row("issue", "step = 'risk'", "clause", status="'CAPACITY_RISK'", value=f"nullif({get(r'threshold(?: is)?\s*(\d+%)')}, '')"),
        row("fact", "step = 'better'", "clause", status="'STATUS'"),
        row("issue", "step = 'issue'", "clause", f"nullif({cause}, '')", f"CASE WHEN {cause} = '' THEN 'unknown' WHEN {has(DOUBT)} THEN 'suspected' ELSE 'confirmed' END", f"nullif({get(METRIC, 0)}, '')"),
        row("fact", "step = 'waiting' AND NOT " + has("is blocked because|rejected"), "clause", status="'STATUS'"),
        row("issue", "step = 'waiting' AND " + has("is blocked because|rejected"), "clause", status="'BLOCKER'"),
        row("fact", "step = 'metric'", "clause", status="'METRIC'", value=get(METRIC, 0)),
    ]
    return "out AS (" + "\nUNION ALL ".join(parts) + ")"


def antecedents_sql(d: Spark) -> str:
    """taken to live_ready: with the last entity that came up for the first time, up to each clause."""
    first = "row_number() OVER (PARTITION BY meeting_id, entity ORDER BY pos, k)"
    at = "last_value({0}) OVER (PARTITION BY meeting_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    last = at.format("entity IGNORE NULLS") if d is DUCK else at.format("entity").replace("(entity) OVER", "(entity) IGNORE NULLS OVER")
    named = "SELECT * FROM counted WHERE live AND step NOT IN ('short', 'dropped', 'procedure')"
    return f"""ent AS ({d.exploded('meeting_id, pos', d.found('low', ENTITY), 'k', 'entity', f'({named}) x')}),
fresh AS (SELECT meeting_id, pos, entity, k FROM (SELECT *, {first} AS rn FROM ent) y WHERE rn = 1),
tops AS (SELECT meeting_id, pos, entity FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, pos ORDER BY k DESC) AS rk FROM fresh) z WHERE rk = 1),
live AS (SELECT q.* FROM (SELECT c.*, {last} AS antecedent FROM (SELECT counted.*, tops.entity FROM counted LEFT JOIN tops ON tops.meeting_id = counted.meeting_id AND tops.pos = counted.pos) c) q WHERE live)"""


def final_sql(d: Spark) -> str:
    """out to final: facts told before a correction of their value give way to the corrected one, repeats count once, and a task within a longer one of its owner is dropped."""
    word = lambda x: "lower(trim(" + d.sub(x, r"[.\s]+$", "") + "))"
    return f"""fixed AS (SELECT o.* FROM out o WHERE o.kind <> 'fact' OR NOT EXISTS (SELECT 1 FROM out c WHERE c.meeting_id = o.meeting_id AND c.kind = 'correction' AND c.pos > o.pos AND contains(lower(o.text), c.status))
  UNION ALL SELECT meeting_id, pos, 'fact', concat('Confirmed at ', value), owner, 'METRIC', value FROM out WHERE kind = 'correction'),
once AS (SELECT * FROM (SELECT *, {word('text')} AS norm, row_number() OVER (PARTITION BY meeting_id, kind, {word('text')} ORDER BY pos, owner NULLS FIRST, value NULLS FIRST) AS rn FROM fixed) r WHERE rn = 1),
final AS (SELECT a.meeting_id, a.pos, a.kind, a.text, a.owner, a.status, a.value FROM once a WHERE a.kind <> 'action' OR NOT EXISTS (SELECT 1 FROM once b WHERE b.meeting_id = a.meeting_id AND b.kind = 'action' AND b.owner = a.owner AND length(b.norm) > length(a.norm) AND contains(b.norm, a.norm)))"""


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = sql(spark, f"WITH near AS (SELECT * FROM @near), {steps_sql(SPARK)} SELECT * FROM taken", near=near(spark, sf_dir))
    step = F.array(F.col("takes") - 1, F.lit(0), F.lit(1), F.lit(2)).cast("array<int>")
    return machine(taken, ["meeting_id"], "pos", 4, step, "skip").withColumn("live", F.col("skip") == 0)


_COUNTED = f"""{_near_sql()}, {steps_sql(DUCK)},
counted AS (SELECT t.*, r.skip, r.skip = 0 AS live FROM taken t JOIN run r ON r.meeting_id = t.meeting_id AND r.pos = t.pos)""".replace("\ncounted AS", """
run AS (WITH RECURSIVE run(meeting_id, pos, skip, takes) AS (SELECT meeting_id, pos, 0, takes FROM taken WHERE pos = 1
  UNION ALL SELECT t.meeting_id, t.pos, CASE WHEN r.skip > 0 THEN r.skip - 1 ELSE r.takes - 1 END, t.takes FROM run r JOIN taken t ON t.meeting_id = r.meeting_id AND t.pos = r.pos + 1) SELECT * FROM run),
counted AS""")  # noqa: E501


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses that count, with the antecedent of a pronoun; kept in a checkpoint, as each kind of result reads them."""
    return cut(sql(spark, f"WITH counted AS (SELECT * FROM @counted), {antecedents_sql(SPARK)} SELECT * FROM live", counted=cut(_counted(spark, sf_dir))))


def _filled(select: str, d: Spark) -> str:
    return select.replace("@joined", d.joined("line", "\\n" if d is SPARK else "\n", "section_no, line_no")).replace("@metric", d.has("l.low", METRIC))


def _query(select: str, *parts, frame: str = "live"):  # noqa: ANN002, ANN202
    """A query and its DuckDB statement over the clauses that count (or over all, `counted`), with the given parts added."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _live(spark, sf_dir) if frame == "live" else _counted(spark, sf_dir)
        select_ = _filled(select, SPARK)
        with_ = ", ".join([f"{frame} AS (SELECT * FROM @rows)", *(p(SPARK) for p in parts)])
        return sql(spark, f"WITH {with_} {select_}", rows=rows)

    before = [_COUNTED, antecedents_sql(DUCK)] if frame == "live" else [_COUNTED]
    return run, f"WITH {', '.join([*before, *(p(DUCK) for p in parts)])} {_filled(select, DUCK)}"


#: Sections of the report in order: title, kind of result and most lines.
SECTIONS = (("KEY FACTS", "fact", 15), ("ISSUES AND RISKS", "issue", 6), ("DECISIONS", "decision", 6), ("RELEASE GATES", "gate", 6), ("DEPENDENCIES", "dependency", 6), ("ACTIONS", "action", 6), ("CORRECTIONS", "correction", 6), ("UNRESOLVED", "unresolved", 4), ("OUT OF SCOPE", "out_of_scope", 4), ("PROCEDURES", "procedure", 4))


def report_sql(d: Spark) -> str:
    """final to lines: the numbered lines of each section of each meeting's report; sections without results are left out."""
    named = d.values([(i, t, k, n) for i, (t, k, n) in enumerate(SECTIONS)], "section_no, title, kind, most")
    line = "concat('- ', text, CASE WHEN owner IS NOT NULL AND kind = 'action' THEN concat(' (', owner, ', ', value, ')') ELSE '' END)"
    return f"""ranked AS (SELECT f.meeting_id, s.section_no, s.title, s.most, {line.replace('kind', 'f.kind')} AS line, row_number() OVER (PARTITION BY f.meeting_id, f.kind ORDER BY f.pos, f.text, f.owner NULLS FIRST) AS k, count(*) OVER (PARTITION BY f.meeting_id, f.kind) AS n FROM final f JOIN {named} s ON s.kind = f.kind),
lines AS (SELECT meeting_id, section_no, k AS line_no, line FROM ranked WHERE k <= most UNION ALL SELECT meeting_id, section_no, 0, concat(title, ' (', n, ')') FROM ranked WHERE k = 1)"""


_OUT = "SELECT meeting_id, pos, text, owner, status, value FROM out WHERE kind = '{0}'"
_ALL = {
    "fold_steps": _query("SELECT step, live, takes, count(*) AS n FROM counted GROUP BY step, live, takes", frame="counted"),
    "fold_facts": _query(_OUT.format("fact"), yields_sql),
    "fold_issues": _query(_OUT.format("issue"), yields_sql),
    "fold_decisions": _query(_OUT.format("decision"), yields_sql),
    "fold_actions": _query(_OUT.format("action"), yields_sql),
    "fold_gates": _query(_OUT.format("gate"), yields_sql),
    "fold_corrections": _query(_OUT.format("correction"), yields_sql),
    "fold_dependencies": _query(_OUT.format("dependency"), yields_sql),
    "rpt_executive": _query("SELECT meeting_id, report_of AS report FROM (SELECT meeting_id, @joined AS report_of FROM lines GROUP BY meeting_id) q", yields_sql, final_sql, report_sql),
    "rpt_analysis": _query("SELECT meeting_id, kind, count(*) AS n, min(pos) AS first_pos, count(DISTINCT owner) AS n_owners FROM final GROUP BY meeting_id, kind", yields_sql, final_sql),
    "fold_recall": _query("SELECT l.meeting_id, l.pos, l.clause FROM live l WHERE @metric AND NOT EXISTS (SELECT 1 FROM final f WHERE f.meeting_id = l.meeting_id AND contains(lower(f.text), l.low)) AND l.is_retained", yields_sql, final_sql),
    "fold_unresolved": _query(_OUT.format("unresolved"), yields_sql),
    "fold_final": _query("SELECT meeting_id, pos, kind, text, owner, status, value FROM final", yields_sql, final_sql),
}
QUERIES = {}
for _name, (_run, _sql) in _ALL.items():
    _run.__name__ = _name
    QUERIES[_name] = _run
SQL = {n: s for n, (_, s) in _ALL.items()}
