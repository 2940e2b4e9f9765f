"""Queries on single clauses and on neighbours of the mixed talk of plans.state: cleaning, validation, roles and cross-turn links.

Each is one SQL statement, written for both engines by plans.dialect. The rules' cue words are fixed values, stated with
the query that uses them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import SCALES, TENS, UNITS, spoken_number
from parley.operators.sequence import machine
from parley.plans.dialect import DUCK, SPARK, Spark, sql
from parley.plans.state import _near_sql, near
from parley.sources.tables import cut, table

_NUMBER = "|".join([*UNITS, *TENS, *SCALES])


def _chain(d: Spark, text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        text = d.sub(text, pattern, by)
    return f"trim({text})"


# What opens an utterance without content, taken off in order.
OPENERS = [(r"^(?:okay|ok|so|well|right|and|also|yes|sure|agreed)[,\s\-:]+", ""), (r"^(?:i think|i guess|i believe|actually|basically)[,\s]+", ""), (r"\s+", " "), (r"\s+([.,!?])", "$1")]
# Spellings that recognisers write in lower case.
SPELLED = [(r"\bapi\b", "API"), (r"\bcpu\b", "CPU"), (r"\bqa\b", "QA"), (r"\bmonday\b", "Monday"), (r"\bfriday\b", "Friday"), (r"\bi\b", "I"), (r"\s+", " ")]
TECH = r"\b(?:api|database|service|endpoint|server|auth|migration|deploy|pipeline|test|bug|error|failing|failed|timeout|latency|script|permission|security|dashboard|feature|export|release|version|build|branch|commit|fix|schedule|task|requirement|upload|network|crash|connection)\b"
SOCIAL = r"weekend plans|grab coffee|have lunch|dinner tonight|good morning|good afternoon|see you later|how was your weekend|\b(?:lunch|dinner|coffee break|heading out|bye|goodbye)\b"
VENTS = r"^i (?:really )?(?:hate|dislike|am sick of|am tired of) |^this is (?:so )?(?:terrible|annoying|frustrating|stupid)"
METRICS = r"\b\d+(?:\.\d+)?%|\b\d+\s*(?:ms|users|requests|units|kb|mb|gb|rpm|am|pm)\b"
ADMIN = r"give me (?:a|one) (?:minute|moment|second)|let me finish|go ahead|can you hear me|moving on|next topic|hold on|say that again"
VAGUE = r"^(?:do|handle|fix|review|update|check)\s+(?:it|this|that|things?|stuff)\b"
VERB = r"^(?:investigate|send|prepare|book|schedule|deploy|fix|create|review|audit|finalize|draft|write|coordinate|complete|notify|publish|implement|build|run|test|submit|update|record|repaint|rename|measure|merge|split|trace|publish|document|replace|inspect|retire|revert|approve|publish|benchmark|translate|compare|measure|extend|relabel|calibrate|encrypt|isolate|rehearse|reprint|outline|draft|catalogue|escalate|estimate|freeze|migrate|optimise|package|recharge|reconcile|refactor|renumber|reorder|resample|restore|rewire|rewrite|shorten|simplify|validate)\b"
DANGLES = r"\b(?:and|or|but|the|a|an|to|of|for|with|because|that|which|in|on|at)[.\s]*$"
RANT_WORDS = "hate|terrible|awful|angry|furious|disgusting|ridiculous|stupid|useless|incompetent|liar|shame|corrupt"
WEIGHTS = (("budget", 1.0), ("release", 0.9), ("deploy", 0.9), ("deadline", 0.95), ("risk", 0.8), ("audit", 0.7), ("contract", 0.7), ("pipeline", 0.8), ("server", 0.8), ("report", 0.7), ("review", 0.7), ("sensor", 0.8), ("approved", 0.9), ("vendor", 0.6), ("weekend", -0.9), ("coffee", -0.7))
REJECTED_ACTION = r"committee|motion|minutes were|roll call"


def txt_utterances(d: Spark) -> str:
    """Clauses without openings that carry nothing, capitalised."""
    x = _chain(d, "low", OPENERS)
    return f"SELECT meeting_id, pos, concat(upper(substring(x, 1, 1)), substring(x, 2)) AS cleaned FROM (SELECT meeting_id, pos, {x} AS x FROM near) q"


def txt_restored(d: Spark) -> str:
    """Recognised text with acronyms, weekdays and a final stop."""
    x = _chain(d, "low", SPELLED)
    return f"SELECT meeting_id, pos, CASE WHEN {d.has('x', '[.!?]$')} THEN concat(upper(substring(x, 1, 1)), substring(x, 2)) ELSE concat(upper(substring(x, 1, 1)), substring(x, 2), '.') END AS restored FROM (SELECT meeting_id, pos, {x} AS x FROM near) q"


def txt_guarded(d: Spark) -> str:
    """Statements without marks, leading connectives and a dangling tail."""
    x = _chain(d, "clause", [(r"\[?\(?\b\d{1,2}:\d{2}(?::\d{2})?\b\)?\]?", ""), (r"[*_#`]", ""), (r"(?i)^(?:and|so|but|then|also)\s+", ""), (rf"(?i)\s*{DANGLES}", ""), (r"\s+", " ")])
    return f"SELECT meeting_id, pos, {x} AS statement FROM near"


def txt_casual(d: Spark) -> str:
    """Whether a clause is wholly casual or venting; metrics and technical words veto both."""
    return f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN {d.has('low', METRICS)} OR {d.has('low', TECH)} THEN 'professional' WHEN {d.has('low', SOCIAL)} THEN 'casual' WHEN {d.has('low', VENTS)} THEN 'venting' ELSE 'neutral' END AS kind FROM near) q GROUP BY kind"


def gen_entities(d: Spark) -> str:
    """Entity candidates of each clause: a noun of the trade with the word before it, without articles."""
    from parley.plans.state import ENTITY

    return f"SELECT DISTINCT meeting_id, pos, entity FROM (SELECT meeting_id, pos, trim({d.sub('e', r'^(?:the|a|an|our|this|that|and|of|for)\s+', '')}) AS entity FROM ({d.exploded('meeting_id, pos', d.found('low', ENTITY), 'k', 'e', 'near')}) x) y WHERE entity <> ''"


def gen_actors(d: Spark) -> str:
    """Clauses cut further at sentence ends and before a new actor, with who is to act."""
    pieces = d.keep(d.each(d.parts("low", r"[.!?]\s+|;\s*|\s+then\s+"), "x", "trim(x)"), "x", "length(x) >= 6")
    actor = f"CASE WHEN {d.has('piece', r'^(?:i|we) ')} THEN speaker WHEN {d.has('piece', r'^(?:you|can you|could you|please) ')} THEN 'addressee' WHEN {d.has('piece', r'^[a-z]+ (?:will|owns|has to) ')} THEN {d.get('piece', '^([a-z]+)')} WHEN {d.has('piece', VERB)} THEN 'imperative' ELSE 'none' END"
    return f"SELECT meeting_id, pos, k, piece, {actor} AS actor FROM ({d.exploded('meeting_id, pos, speaker', pieces, 'k', 'piece', 'near')}) q"


def gen_facts(d: Spark) -> str:
    """Atomic facts: a clause of up to fifteen words gives one for each metric, with the words before it."""
    metric = r"\$?\d+(?:,\d{3})*(?:\.\d+)?(?:%| ?(?:percent|units|points|seconds|minutes|hours|days))?"
    return f"SELECT meeting_id, pos, k, metric, trim({d.sub('low', r'\s+', ' ')}) AS fact FROM ({d.exploded('meeting_id, pos, low', d.found('low', metric), 'k', 'metric', f'(SELECT * FROM near WHERE {d.size(d.parts("trim(low)", r"\s+"))} <= 15) n')}) q"


def flt_rants(d: Spark) -> str:
    """Public comments and rants: three emotional words or more, or two in more than twenty words."""
    n, words = d.size(d.found("low", rf"\b(?:{RANT_WORDS})\b")), d.size(d.parts("trim(low)", r"\s+"))
    return f"SELECT meeting_id, pos, n_emotional FROM (SELECT meeting_id, pos, {n} AS n_emotional, {words} AS n_words FROM near) q WHERE n_emotional >= 3 OR (n_emotional >= 2 AND n_words > 20)"


def flt_classes(d: Spark) -> str:
    """Which kinds of results the gate's class of a clause allows: issues, decisions, actions, or facts alone."""
    not_in = lambda *c: "category NOT IN (" + ", ".join(f"'{x}'" for x in c) + ")"
    return f"""SELECT category, {not_in('QUESTION', 'PROPOSAL', 'CASUAL', 'TARGET')} AS allows_issues, {not_in('QUESTION', 'CURRENT_VALUE', 'HISTORICAL_VALUE', 'CASUAL')} AS allows_decisions,
      {not_in('CURRENT_VALUE', 'HISTORICAL_VALUE', 'TARGET', 'CASUAL')} AS allows_actions, category IN ('CURRENT_VALUE', 'HISTORICAL_VALUE', 'TARGET', 'PROFESSIONAL_FACT') AS facts_only, count(*) AS n FROM near GROUP BY category"""


def flt_topics(d: Spark) -> str:
    """Topics of good quality among the first words of clauses: two to five words, no verb first, no dangling end."""
    t = d.get("low", r"^((?:[a-z]+ ){1,4}[a-z]+)")
    return f"SELECT topic, count(*) AS n FROM (SELECT {t} AS topic FROM near) q WHERE topic <> '' AND NOT {d.has('topic', DANGLES)} AND NOT {d.has('topic', VERB)} AND NOT {d.has('topic', r'^(?:i|we|you|it|they|he|she) ')} GROUP BY topic HAVING count(*) >= 3"


def flt_procedure(d: Spark) -> str:
    """Procedural clauses: the motion or act, and whether it is a vote."""
    act = d.get("low", r"\b(motion (?:passed|carried|failed)|voted to [a-z]+|roll call|seconded the motion)\b")
    return f"SELECT meeting_id, pos, {act} AS act, {d.has('low', 'vote|motion (?:passed|carried|failed)')} AS is_vote FROM near WHERE {act} <> ''"


def flt_blockers(d: Spark) -> str:
    """Blockers that are verified: said to block, not denied, and about something named."""
    return f"SELECT meeting_id, pos, clause FROM near WHERE {d.has('low', r'block|cannot proceed|prevents')} AND NOT {d.has('low', r'not (?:a )?block|non-blocking|does not block')} AND {d.has('low', TECH)}"


def flt_dangling(d: Spark) -> str:
    """Clauses that break off."""
    return f"SELECT meeting_id, pos, clause FROM near WHERE {d.has('low', DANGLES)}"


def flt_view(d: Spark) -> str:
    """What the views all, kept and discarded show of each meeting."""
    return "SELECT meeting_id, count(*) AS n_all, sum(CASE WHEN is_retained THEN 1 ELSE 0 END) AS n_kept, sum(CASE WHEN is_retained THEN 0 ELSE 1 END) AS n_discarded FROM near GROUP BY meeting_id"


def cls_wrapped(d: Spark) -> str:
    """The gate's outcome with all kept classes as one."""
    return "SELECT CASE WHEN is_retained THEN 'RELEVANT' ELSE category END AS category, count(*) AS n FROM near GROUP BY 1" if d is DUCK else "SELECT CASE WHEN is_retained THEN 'RELEVANT' ELSE category END AS category, count(*) AS n FROM near GROUP BY CASE WHEN is_retained THEN 'RELEVANT' ELSE category END"


def cls_roles(d: Spark) -> str:
    """Tokens with a weight: role, weight, and stress from .85 on, or from .75 for words of more than four letters."""
    tokens = d.keep(d.parts(d.sub("low", r"[^a-z0-9\s]", " "), r"\s+"), "x", "length(x) >= 2")
    return f"""SELECT t.token, CASE WHEN l.weight < 0 THEN 'CASUAL_TERM' WHEN l.token IN ('deadline') THEN 'DEADLINE_CUE' WHEN l.token IN ('approved') THEN 'DECISION_CUE' ELSE 'PROFESSIONAL_TERM' END AS role, abs(l.weight) AS weight,
      abs(l.weight) >= 0.85e0 OR (length(t.token) > 4 AND abs(l.weight) >= 0.75e0) AS is_stressed, count(*) AS n FROM ({d.exploded('meeting_id, pos', tokens, 'k', 'token', 'near')}) t JOIN {d.values(list(WEIGHTS), 'token, weight')} l ON l.token = t.token GROUP BY t.token, l.token, l.weight"""


def agg_emitted_weights(d: Spark) -> str:
    """Word weights as sent to a client: the lexicon's, .85 at least for cues, raised by half for stressed ones, at most 1; the 45 greatest of each meeting's first fifty tokens."""
    tokens = d.keep(d.parts(d.sub("low", r"[^a-z0-9\s]", " "), r"\s+"), "x", "length(x) >= 2")
    return f"""SELECT meeting_id, token, weight FROM (SELECT meeting_id, token, weight, row_number() OVER (PARTITION BY meeting_id ORDER BY weight DESC, token) AS rk FROM (SELECT meeting_id, t.token, max(round(least(1.0e0, CASE WHEN t.token IN ('deadline', 'approved') THEN greatest(l.weight, 0.85e0) ELSE l.weight END * CASE WHEN l.weight >= 0.85e0 THEN 1.5e0 ELSE 1.0e0 END), 6)) AS weight
      FROM (SELECT meeting_id, token, row_number() OVER (PARTITION BY meeting_id ORDER BY pos, k) AS rn FROM ({d.exploded('meeting_id, pos', tokens, 'k', 'token', 'near')}) x) t JOIN {d.values(list(WEIGHTS), 'token, weight')} l ON l.token = t.token WHERE t.rn <= 50 AND l.weight > 0 GROUP BY meeting_id, t.token) y) z WHERE rk <= 45"""


def cls_acts(d: Spark) -> str:
    """The speech act of each clause, the first that fits."""
    acts = (("QUESTION", r"\?|^(?:what|why|how|where|who|when) "), ("REQUEST", r"\b(?:can you|could you|please)\b"), ("AGREEMENT", r"^(?:agreed|yes|sounds good|exactly|perfect)\b"), ("DISAGREEMENT", r"i disagree|not possible|^no\b"), ("COMMITMENT", r"\b(?:i will|i'll|we will)\b"), ("PROPOSAL", r"\b(?:let us|let's|we should|how about)\b"),
            ("DECISION", r"\bdecided|approved\b"), ("WARNING", r"\brisk|threshold|careful\b"), ("PROBLEM", r"\bfail|error|broken|missing\b"), ("STATUS", r"\b(?:is|are|was|has|have) [a-z]+ed\b"), ("GREETING", r"^(?:good morning|hello|hi)\b"), ("CORRECTION", r"\bactually|correction|sorry\b"))
    return "SELECT act, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {d.has('low', p)} THEN '{a}'" for a, p in acts) + " ELSE 'STATEMENT' END AS act FROM near) q GROUP BY act"


def cls_intents(d: Spark) -> str:
    """Intent, its evidence and its status for each clause that has one."""
    intents = (("ACTION", r"\b(?:will|please|must|needs? to) [a-z]+", "OPEN"), ("DECISION", r"\b(?:decided|agreed|approved) [a-z]+", "CONFIRMED"), ("BLOCKER", r"\b(?:blocks|cannot proceed|is a blocker)\b", "BLOCKED"), ("DEADLINE", r"\b(?:by|before|until) (?:friday|tomorrow|noon|[0-9]+ ?[ap]m)\b", "SCHEDULED"))
    case = lambda f: "CASE " + " ".join(f"WHEN {d.has('low', p)} THEN {f(i, p, s)}" for i, p, s in intents) + " END"
    return f"SELECT meeting_id, pos, intent, evidence, status FROM (SELECT meeting_id, pos, {case(lambda i, p, s: repr(i))} AS intent, {case(lambda i, p, s: d.get('low', p, 0))} AS evidence, {case(lambda i, p, s: repr(s))} AS status FROM near) q WHERE intent IS NOT NULL"


def cls_types(d: Spark) -> str:
    """The semantic type of each clause by cues, beside the gate's class."""
    types = (("QUESTION", r"\?"), ("BLOCKER", r"cannot proceed|blocks|is a blocker"), ("RISK", r"risk|threshold"), ("CONDITIONAL_ACTION", r"^if .*(?:will|we )"), ("SCOPE_CHANGE", r"out of scope|defer"), ("DECISION", r"decided|decision|approved"), ("CONFIRMED_ACTION", r"\b(?:i|we|[a-z]+) will\b"), ("PROPOSAL", r"let us|we should"),
             ("HISTORICAL_VALUE", r"went from|previously"), ("CURRENT_VALUE", r"\d"), ("DEADLINE", r"by friday|tomorrow"), ("OPINION", r"i think|in my opinion"), ("UNCERTAINTY", r"maybe|not sure"), ("CASUAL", SOCIAL))
    return "SELECT semantic_type, category, count(*) AS n FROM (SELECT category, CASE " + " ".join(f"WHEN {d.has('low', p)} THEN '{a}'" for a, p in types) + " ELSE 'FACT' END AS semantic_type FROM near) q GROUP BY semantic_type, category"


def win_vocatives(d: Spark) -> str:
    """Names that clauses give to speakers: the speaker's own by an introduction, the next speaker's by an address; the first counts."""
    own, other = d.get("clause", r"\b(?:I'm|I am|[Tt]his is|[Mm]y name is)\s+([A-Z][a-z]{2,15})\b"), d.get("clause", r"\b(?:[Hh]ey|[Hh]i|[Hh]ello|[Tt]hanks|[Tt]hank you)\s+([A-Z][a-z]{2,15})\b|^([A-Z][a-z]{2,15}), (?:prepare|can you|could you)")
    first = d.get("clause", r"^([A-Z][a-z]{2,15}), (?:prepare|can you|could you|please)")
    return f"""SELECT meeting_id, speaker, name FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY pos, name) AS rn FROM (
      SELECT meeting_id, pos, speaker, {own} AS name FROM near UNION ALL SELECT meeting_id, pos, s1, {other} FROM near UNION ALL SELECT meeting_id, pos, s1, {first} FROM near) x WHERE name <> '' AND speaker IS NOT NULL AND {d.has('lower(speaker)', r'^(?:speaker|\(?speaker_?\d*\)?|sven|ingrid|rhys|)$')}) y WHERE rn = 1"""


def win_why(d: Spark) -> str:
    """Tasks with the last problem told before them, where they speak of one."""
    problem = f"CASE WHEN {d.has('low', r'fail|error|threshold|missing|risk')} THEN clause END"
    last = "last_value({0}) OVER (PARTITION BY meeting_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    last = last.format("problem IGNORE NULLS") if d is DUCK else last.format("problem").replace("(problem) OVER", "(problem) IGNORE NULLS OVER")
    return f"SELECT meeting_id, pos, why FROM (SELECT meeting_id, pos, low, {last} AS why FROM (SELECT *, {problem} AS problem FROM near) x) y WHERE why IS NOT NULL AND {d.has('low', r'\b(?:will|please|fix|review|prepare)\b.*\b(?:investigation|load|ticket|task|fix|memory|cpu|server|test|slowdown)\b')}"


def _tasks_sql(d: Spark) -> str:
    return "tk AS (SELECT node_id, meeting_id, full_description, owner, deadline, why_reason FROM (SELECT *, row_number() OVER (PARTITION BY node_id, meeting_id ORDER BY full_description DESC NULLS LAST, owner DESC NULLS LAST, deadline DESC NULLS LAST) AS rn FROM task_nodes) q WHERE rn = 1 AND full_description IS NOT NULL)"


def cls_actions(d: Spark) -> str:
    """The action gate: procedure, vagueness, a missing verb or fewer than three words reject; an owner who is named raises the confidence."""
    low = "lower(full_description)"
    status = f"CASE WHEN {d.has(low, REJECTED_ACTION)} OR {d.has(low, ADMIN)} THEN 'procedure' WHEN {d.has(low, VAGUE)} THEN 'vague' WHEN {d.size(d.parts(f'trim({low})', r'\s+'))} < 3 THEN 'short' WHEN NOT {d.has(low, VERB)} THEN 'no verb' ELSE 'confirmed' END"
    named = f"owner IS NOT NULL AND owner <> '' AND NOT {d.has('lower(trim(owner))', r'^(?:team|unclear|tbd|unspecified|speaker|somebody|someone|all|unassigned)')}"
    return f"WITH {_tasks_sql(d)} SELECT reason, CASE WHEN reason = 'confirmed' THEN 'CONFIRMED' ELSE 'REJECTED' END AS status, confidence, count(*) AS n FROM (SELECT {status} AS reason, CASE WHEN {named} THEN 0.95e0 ELSE 0.85e0 END AS confidence FROM tk) q GROUP BY reason, confidence"


def cls_decisions(d: Spark) -> str:
    """The decision gate: the first outcome that fits each clause about a decision."""
    out = (("OPINION", r"i think|in my opinion|i feel|personally"), ("QUESTION", r"\?"), ("HISTORICAL_DECISION", r"last (?:week|month|year)|previously"), ("REJECTED", r"not approved|rejected|denied|do not record"), ("DEFERRED", r"defer|pushed to|moved to"), ("OUT_OF_SCOPE", r"out of scope"), ("PROPOSAL", r"let us|we should|how about"), ("VOTE", r"motion|voted"), ("CONFIRMED", r"decided|agreed|approved|decision"), ("INFORMATION", r"budget|cost|\d"))
    return "SELECT outcome, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {d.has('low', p)} THEN '{a}'" for a, p in out) + f" ELSE 'REJECTED' END AS outcome FROM near WHERE {d.has('low', r'decid|decision|agree|approv|defer|scope|motion|rejected')}) q GROUP BY outcome"


def flt_guardrails(d: Spark) -> str:
    """Tasks and deadlines that pass the guardrails: three words or more, a verb, no dangling end; a deadline that says something."""
    low = "lower(full_description)"
    return f"WITH {_tasks_sql(d)} SELECT meeting_id, count(*) AS n_tasks, sum(CASE WHEN {d.size(d.parts(f'trim({low})', r'\s+'))} >= 3 AND {d.has(low, VERB)} AND NOT {d.has(low, DANGLES)} THEN 1 ELSE 0 END) AS n_valid, sum(CASE WHEN deadline IS NOT NULL AND deadline <> '' AND lower(deadline) <> 'unspecified' THEN 1 ELSE 0 END) AS n_deadlines FROM tk GROUP BY meeting_id"


def ext_deadlines(d: Spark) -> str:
    """Deadlines in one form: without 'due by' and the like, 'unspecified' where there is none."""
    x = f"trim({d.sub('deadline', r'(?i)^(?:due\s+(?:by|on|at|in|before)\s*|due\s*:?\s*)', '')})"
    return f"WITH {_tasks_sql(d)} SELECT deadline, count(*) AS n FROM (SELECT CASE WHEN deadline IS NULL OR trim(deadline) = '' THEN 'unspecified' ELSE {x} END AS deadline FROM tk) q GROUP BY deadline"


def ext_tasks(d: Spark) -> str:
    """Task texts as directives: lead-ins off, the first verb by its standard word."""
    verbs = {"look": "investigate", "check": "verify", "do": "complete", "make": "create", "get": "obtain", "repaint": "repaint", "redo": "rework"}
    bare = _chain(d, "lower(full_description)", [(r"^(?:i will|we will|please|need to|have to|going to|to)\s+", ""), (r"[.\s]+$", "")])
    case = "CASE " + " ".join(f"WHEN verb = '{a}' THEN '{b}'" for a, b in verbs.items()) + " ELSE verb END"
    return f"WITH {_tasks_sql(d)} SELECT node_id, concat(upper(substring(v, 1, 1)), substring(v, 2), substring(t, length(verb) + 1)) AS task FROM (SELECT node_id, t, verb, {case} AS v FROM (SELECT node_id, t, {d.get('t', r'^([a-z0-9\-]+)')} AS verb FROM (SELECT node_id, {bare} AS t FROM tk) a) b) c"


def ext_synthesised(d: Spark) -> str:
    """Decisions as directives: what is decided, after the cue that tells it."""
    x = d.get("low", r"(?:decided to|agreed to|decision (?:is|on)|approved)\s+(.+?)[.!]?$")
    return f"SELECT meeting_id, pos, concat(upper(substring(x, 1, 1)), substring(x, 2), '.') AS decision FROM (SELECT meeting_id, pos, {x} AS x FROM near) q WHERE x <> ''"


def ext_when(d: Spark) -> str:
    """Deadline, duration and condition that a clause names; those without any are left out."""
    duration, condition = d.get("low", r"\b((?:about |within )?(?:\d+|one|two|three) (?:working )?(?:days?|weeks?|hours?))\b"), d.get("low", r"\b((?:once|if|wait until|after reviewing|unless) [a-z0-9 \-]+)")
    deadline = d.get("low", r"\b(by \d{1,2} ?[ap]m|by friday|tomorrow|tonight|this morning|today|by end of day|before noon|this quarter)\b")
    return f"SELECT meeting_id, pos, deadline, duration, cond FROM (SELECT meeting_id, pos, {deadline} AS deadline, {duration} AS duration, {condition} AS cond FROM near) q WHERE deadline <> '' OR duration <> '' OR cond <> ''"


def ext_scope(d: Spark) -> str:
    """What is declared out of scope or stays out of it."""
    return f"SELECT meeting_id, pos, trim({d.get('low', r'(?:the )?([a-z0-9 \-]+?) (?:is|are|stays?|stay) (?:out of scope|outside (?:the )?(?:current )?(?:release|scope))')}) AS item FROM near WHERE {d.has('low', r'(?:is|are|stays?) (?:out of scope|outside)')}"


def ext_owners(d: Spark) -> str:
    """Owners against the meeting's own speakers: the task's owner if they speak there, by their first word; else unassigned."""
    first = lambda c: f"lower({d.get(f'trim({c})', r'^[^A-Za-z]*([A-Za-z]+)')})"
    return f"""WITH {_tasks_sql(d)}, spoke AS (SELECT DISTINCT meeting_id, {first('speaker')} AS who FROM statements WHERE speaker IS NOT NULL), own AS (SELECT node_id, meeting_id, {first('owner')} AS who FROM tk)
      SELECT CASE WHEN s.who IS NULL THEN 'Unassigned' ELSE concat(upper(substring(o.who, 1, 1)), substring(o.who, 2)) END AS owner, count(*) AS n FROM own o LEFT JOIN spoke s ON s.meeting_id = o.meeting_id AND s.who = o.who AND o.who <> '' GROUP BY CASE WHEN s.who IS NULL THEN 'Unassigned' ELSE concat(upper(substring(o.who, 1, 1)), substring(o.who, 2)) END"""


def jn_merged(d: Spark) -> str:
    """Stored meetings with what was counted while they ran; the counted value wins."""
    return """SELECT m.id AS meeting_id, coalesce(r.n_statements, m.total) AS total, r.n_statements IS NOT NULL AS is_counted FROM (SELECT id, max(total_segments_analyzed) AS total FROM meetings GROUP BY id) m LEFT JOIN (SELECT meeting_id, count(DISTINCT stmt_id) AS n_statements FROM statements GROUP BY meeting_id) r ON r.meeting_id = m.id"""


def jn_cosine(d: Spark) -> str:
    """The cosine of the word counts of neighbouring clauses; 0 without a shared word, left out where both have none."""
    words = d.keep(d.parts(d.sub("low", r"[^a-z0-9\s]", " "), r"\s+"), "x", "length(x) >= 2")
    return f"""SELECT meeting_id, pos, round(dot / sqrt(na * nb), 6) AS cosine FROM (SELECT a.meeting_id, a.pos, sum(a.c * b.c) AS dot FROM tf a JOIN tf b ON b.meeting_id = a.meeting_id AND b.pos = a.pos + 1 AND b.w = a.w GROUP BY a.meeting_id, a.pos) s
      JOIN (SELECT meeting_id AS m1, pos AS p1, sum(c * c) AS na FROM tf GROUP BY meeting_id, pos) x ON x.m1 = s.meeting_id AND x.p1 = s.pos JOIN (SELECT meeting_id AS m2, pos AS p2, sum(c * c) AS nb FROM tf GROUP BY meeting_id, pos) y ON y.m2 = s.meeting_id AND y.p2 = s.pos + 1""".replace(
        "SELECT meeting_id, pos, round", f"WITH tf AS (SELECT meeting_id, pos, w, CAST(count(*) AS DOUBLE) AS c FROM ({d.exploded('meeting_id, pos', words, 'k', 'w', 'near')}) e GROUP BY meeting_id, pos, w) SELECT meeting_id, pos, round", 1)


def agg_block(d: Spark) -> str:
    """The audit block of each meeting's report, with defaults where a count is missing."""
    return "SELECT m.id AS meeting_id, coalesce(a.kept, 0) AS kept, coalesce(a.total - a.kept, 0) AS discarded, coalesce(round(100.0e0 * a.kept / a.total, 1), 0.0e0) AS retention_pct FROM (SELECT DISTINCT id FROM meetings) m LEFT JOIN (SELECT meeting_id, count(*) AS total, sum(CASE WHEN is_retained THEN 1 ELSE 0 END) AS kept FROM near GROUP BY meeting_id) a ON a.meeting_id = m.id"


def top_topics(d: Spark) -> str:
    """The four most frequent entities of each meeting among its twenty most frequent that aren't part of a longer one, capitalised."""
    from parley.plans.state import ENTITY

    return f"""WITH e AS (SELECT meeting_id, trim(e) AS entity, count(*) AS n, min(pos) AS first_pos FROM ({d.exploded('meeting_id, pos', d.found('low', ENTITY), 'k', 'e', 'near')}) x GROUP BY meeting_id, trim(e)),
      t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY n DESC, first_pos, entity) AS rk FROM e) y WHERE rk <= 20),
      w AS (SELECT a.* FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.meeting_id = a.meeting_id AND length(b.entity) > length(a.entity) AND contains(b.entity, a.entity)))
      SELECT meeting_id, concat(upper(substring(entity, 1, 1)), substring(entity, 2)) AS topic, n FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY n DESC, first_pos, entity) AS r FROM w) z WHERE r <= 4"""


def _sentences(d: Spark) -> str:
    """Every sentence of every clause, in lower case."""
    return f"({d.exploded('meeting_id, pos', d.parts('low', r'[.!?]+(?:\s+|$)'), 'k', 's', 'near')})"


_QUANTITY = r"(\$?\d[\d,.]*\s*(?:%|percent|units|points|hours?|minutes?|seconds?|days?|users|requests)?)"
MOVED = rf"(.+?)\s+(?:went|increased|decreased|dropped|changed|rose|fell|moved|grew)\s+from\s+{_QUANTITY}\s*to\s+{_QUANTITY}"
NEEDS = r"(.+?)\s+(?:depends on|needs|requires|relies on|can (?:begin|proceed|start) only after|only after)\s+(.+)"
GATED = r"(?:before|until)\s+(.+?)\s+(?:goes live|starts|ships|launches|is released|opens),?\s+(?:we need|we must|it needs)\s+(.+)|(.+?)\s+(?:must (?:pass|succeed|be (?:granted|done|completed))|is required)\s+(?:before|for)\s+(.+)|(.+?)\s+cannot (?:proceed|ship|start|launch) until\s+(.+)"
RISKY = r"(?:risk that|danger that|worried that|may fail if)\s+(.+?)(?:\s+(?:since|because|as|due to)\s+(.+))?$"


def ext_changes(d: Spark) -> str:
    """What changed from which value to which, in every sentence."""
    part = lambda i: f"trim({d.get('s', MOVED, i)})"
    return f"SELECT meeting_id, pos, k, {part(1)} AS subject, {part(2)} AS old_value, {part(3)} AS new_value FROM {_sentences(d)} q WHERE {d.has('s', MOVED)}"


def ext_dependencies(d: Spark) -> str:
    """Edges from an outcome to each of the things that it needs, in every sentence."""
    things = d.keep(d.each(d.parts("things", r"\s*(?:,|;|\band (?:on )?)\s*"), "x", "trim(x)"), "x", "x <> ''")
    inner = f"(SELECT meeting_id, pos, k, trim({d.get('s', NEEDS, 1)}) AS outcome, {d.get('s', NEEDS, 2)} AS things FROM {_sentences(d)} q WHERE {d.has('s', NEEDS)}) p"
    return d.exploded("meeting_id, pos, k, outcome", things, "n", "prerequisite", inner)


def ext_gates(d: Spark) -> str:
    """Release gates in every sentence: the target and each condition that it waits for."""
    first = lambda *g: "concat(" + ", ".join(d.get("s", GATED, i) for i in g) + ")"
    conditions = d.keep(d.each(d.parts("c", r"\s*(?:,|;|\bplus\b|\band\b)\s*"), "x", "trim(x)"), "x", "x <> ''")
    inner = f"(SELECT meeting_id, pos, k, trim({first(1, 4, 5)}) AS target, {first(2, 3, 6)} AS c FROM {_sentences(d)} q WHERE {d.has('s', GATED)}) p"
    return d.exploded("meeting_id, pos, k, target", conditions, "n", "cond", inner)


def ext_risks(d: Spark) -> str:
    """Risks in every sentence, with their cause where one is told."""
    return f"SELECT meeting_id, pos, k, trim({d.get('s', RISKY, 1)}) AS problem, nullif(trim({d.get('s', RISKY, 2)}), '') AS cause FROM {_sentences(d)} q WHERE {d.has('s', RISKY)}"


_NEAR = (ext_changes, ext_dependencies, ext_gates, ext_risks, txt_utterances, txt_restored, txt_guarded, txt_casual, gen_entities, gen_actors, gen_facts, flt_rants, flt_classes, flt_topics, flt_procedure, flt_blockers, flt_dangling, flt_view, cls_wrapped, cls_roles, agg_emitted_weights, cls_acts, cls_intents, cls_types,
         win_vocatives, win_why, cls_decisions, ext_synthesised, ext_when, ext_scope, jn_cosine, agg_block, top_topics)
_STORED = (cls_actions, flt_guardrails, ext_deadlines, ext_tasks, ext_owners, jn_merged)
_TABLES = ("statements", "task_nodes", "meetings")


def _over_near(f):  # noqa: ANN001, ANN202
    """The query over the clauses with their neighbours, which several branches read: they are kept in a checkpoint."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = f(SPARK)
        head, body = ("WITH near AS (SELECT * FROM @near), ", text[5:]) if text.startswith("WITH ") else ("WITH near AS (SELECT * FROM @near) ", text)
        frames = {"near": cut(near(spark, sf_dir))} | ({"meetings": table(spark, sf_dir, "meetings", "id")} if " FROM meetings" in text else {})
        return sql(spark, (head + body).replace(" FROM meetings", " FROM @meetings"), **frames)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    text = f(DUCK)
    return run, f"WITH {_near_sql()}, {text[5:]}" if text.startswith("WITH ") else f"WITH {_near_sql()} {text}"


def _over_tables(f):  # noqa: ANN001, ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = f(SPARK)
        used = [t for t in _TABLES if f" FROM {t}" in text]
        for t in used:
            text = text.replace(f" FROM {t}", f" FROM @{t}")
        return sql(spark, text, **{t: table(spark, sf_dir, t) for t in used})

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run, f(DUCK)


def win_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreements with the proposal that they take: the last of up to four that are pending, by a machine over the number pending.

    A proposal is pushed, an agreement pops; which one it takes follows from the depth, as the last pushed at that depth.
    """
    rows = near(spark, sf_dir)
    pushes, pops = F.col("low").rlike(PROPOSAL), F.col("low").rlike(AGREEMENT)
    step = F.when(pushes & pops, F.array(*[F.lit(x) for x in (1, 1, 2, 3, 4)])).when(pushes, F.array(*[F.lit(x) for x in (1, 2, 3, 4, 4)])).when(pops, F.array(*[F.lit(x) for x in (0, 0, 1, 2, 3)])).otherwise(F.array(*[F.lit(x) for x in range(5)]))
    depth = machine(rows.select("meeting_id", "pos", "low"), ["meeting_id"], "pos", 5, step, "depth")
    return depth.where(pops & (F.col("depth") > 0)).select("meeting_id", "pos", "depth")


PROPOSAL, AGREEMENT = r"let us|we should|i recommend|how about", r"^(?:agreed|sounds good|that works|good idea|exactly|perfect|yes)\b"


def txt_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with runs of number words as digits, with their unit's sign.

    Tokens are numbered, runs of number words are islands, each run is folded to its value, and the text is put together
    again; 'two hundred' and 'zero two' give one run each.
    """
    spoken = near(spark, sf_dir).select("meeting_id", "pos", F.concat_ws(" ", "low", F.element_at(F.array(*[F.lit(x) for x in SPOKEN]), (F.col("pos") % len(SPOKEN) + 1).cast("int"))).alias("low"))
    words = F.split(F.trim(F.regexp_replace("low", r"([.,!?;:])", " $1 ")), r"\s+")
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("run"))

    def closed(a):  # noqa: ANN001, ANN202
        return F.when(F.size(a["run"]) == 0, a["out"]).otherwise(F.concat(a["out"], F.array(F.regexp_replace(spoken_number(a["run"]).cast("string"), r"\.0$", ""))))

    is_number = lambda w: w.rlike(rf"^(?:{_NUMBER})$")
    fold = F.aggregate(words, zero, lambda a, w: F.when(is_number(w), F.struct(a["out"].alias("out"), F.concat(a["run"], F.array(w)).alias("run"))).otherwise(F.struct(F.concat(closed(a), F.array(w)).alias("out"), F.array().cast("array<string>").alias("run"))), lambda a: closed(a))
    text = F.regexp_replace(F.regexp_replace(F.array_join(fold, " "), r"(\d) percent\b", "$1%"), r"(\d+) dollars\b", "\\$$1")
    return spoken.select("meeting_id", "pos", text.alias("text")).where(F.col("text").rlike(r"\d"))


SPOKEN = ("twelve people came", "about two hundred five dollars", "ninety nine percent of them", "no number", "one thousand two hundred units")

QUERIES, SQL = {}, {}
for _f, _wrap in (*((f, _over_near) for f in _NEAR), *((f, _over_tables) for f in _STORED)):
    QUERIES[_f.__name__], SQL[_f.__name__] = _wrap(_f)
QUERIES["win_stacks"], QUERIES["txt_spoken"] = win_stacks, txt_spoken
_MOVE = "CASE WHEN push AND pop THEN greatest(1, depth) WHEN push THEN least(4, depth + 1) WHEN pop THEN greatest(0, depth - 1) ELSE depth END"
SQL["win_stacks"] = f"""WITH RECURSIVE {_near_sql()}, m AS (SELECT meeting_id, pos, regexp_matches(low, '{PROPOSAL}') AS push, regexp_matches(low, '{AGREEMENT}') AS pop FROM near),
run(meeting_id, pos, depth, push, pop) AS (SELECT meeting_id, pos, 0, push, pop FROM m WHERE pos = 1 UNION ALL SELECT m.meeting_id, m.pos, {_MOVE.replace('push', 'r.push').replace('pop', 'r.pop').replace('depth', 'r.depth')}, m.push, m.pop FROM run r JOIN m ON m.meeting_id = r.meeting_id AND m.pos = r.pos + 1)
SELECT meeting_id, pos, depth FROM run WHERE pop AND depth > 0"""
