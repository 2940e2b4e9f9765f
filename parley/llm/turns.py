"""Speech transcripts into clean speaker turns.

A conditional random field tags each token as speech, speaker label, time mark, annotation, filler or broken-off
beginning; Viterbi gives the best tags of each line. What is left as speech makes up segments, one for each speaker
label; labels are resolved to people within a meeting; and neighbouring segments of one speaker make a turn.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm import corpus as C
from parley.llm.crf import Crf, stored
from parley.operators.skew import salted_join
from parley.sources.tables import cut

LABELS = ["SPEECH", "B-LABEL", "I-LABEL", "TIME", "NOISE", "FILLER", "CUT"]
START = "\n"
#: Statements of one meeting in a chunk; a meeting of any length is worked on in chunks.
CHUNK = 4096
_TOKEN = re.compile(r" - |-(?= )|[^\W_]+|[^\w\s]|_")
# Sounds of hesitation and filler phrases, for training and as a feature.
HESITATIONS = "um uh er erm ah hmm mm uhm uhh ummm umm eh ahm hm mhm uhmm".split()
PHRASES = ("you know", "I mean", "kind of", "sort of", "like", "well")
# Sounds that transcribers note.
SOUNDS = "laughter|noise|typing|crosstalk|coughs|door slams|background noise|sighs|music|laughs|inaudible|pause 3s|phone ringing|silence|applause|unclear|cough|breathing|static|chuckles".split("|")


def features(token: str) -> list[str]:
    """What the field sees of a token."""
    if token in (START, " - ", "- "):
        return ["w=" + token]
    low = token.lower()
    shape = re.sub(r"[^\W\d_]+", lambda m: "x" if m[0].islower() else "X" if m[0].isupper() else "Xx", re.sub(r"\d", "9", token))
    out = ["w=" + low, "s=" + shape[:6]]
    if token.isalpha():
        out.append(f"l{min(len(token), 5)}")
        if low in _HES:
            out.append("hes")
        elif low in _GIVEN and low not in C.COMMON:
            return [*out[1:], "given"]
        elif low in C.COMMON:
            out.append("common")
    return out


_HES, _GIVEN = set(HESITATIONS), {g.lower() for g in C.GIVEN}


def tokens(line: str) -> list[tuple[str, int, int]]:
    """Tokens of a line with their places, behind a start mark. A dash before a blank differs from one within a word."""
    out = [(START, 0, 0)]
    for m in _TOKEN.finditer(line):
        t = m[0]
        if t == "-" and line[m.end() : m.end() + 1] == " ":
            t = "- "
        out.append((t, m.start(), m.end()))
    return out


#: Sentences in which what sounds like a filler or looks like a mark is spoken.
SAID = """That kind of {n} is {d} in a sort of {a} way.
We do well when you know what I mean.
You know well that I mean the {a} {n}.
Do you know what they mean by {cap}?
It looks like {cap}, like {cap} and like a {n}.
Well water is {a}, well cooked {n} is not.
The {n} opens at {clock} and shuts at {clock}.
See you at {clock} or at {clock} {t}.
{clock} is too early, {clock} too late.
He came ({num} minutes late) and {d} it.
The {n} (as everybody can see) is {a}.
All of them, about {num} (or {num}), were {d}.
It is {d} (we hope) {t}.
The {n}, {g} and a {a}, {a} {n} were {d}.
A {a}-{a} {n} needs {x}.
I will {v} it, {v} it and {v} it {t}.
Edition {ver} of the {n} is {a}.
With {ver} and {ver} the {n} was {d}.
The {n}-{n} and the {a} {n}-{n} of {cap} are {d}.
A {n}-{n} by {g} is {a}.
This kind of {n} and this sort of {n} like {cap}.
Is the {n} on {date}, or on {date}?""".splitlines()
OFTEN = "in out up off on by over to only end half".split()
#: Noisy lines of each sentence in the labelled table.
LINES, STEPS = 18, 110
_FILL = {"PHONE": C.phone, "EMAIL": C.email, "ID": C.identity, "ADDR": C.address, "NAME": C.name}


def labelled(n: int = LINES, seed: int = 11, sentences: list[str] = [*C.MARKED, *SAID * 5]) -> list[list[tuple[str, str]]]:  # noqa: B006
    """The labelled table: n noisy lines of each sentence, as (token, tag) lists."""
    r, out = random.Random(seed), []

    def said(line: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: _FILL[m[1]](r) if m[1] in _FILL else compound() if m[1] in "an" and r.random() < 0.1 else C.invented(r, 1, 3).lower() if m[1] in "anvd" and r.random() < 0.4 else C.slot(r, m[1]), line)

    def compound() -> str:
        return "-".join(r.choice([C.invented(r, 1, 2).lower(), r.choice(C.WORDS["n"]), r.choice(OFTEN)]) for _ in range(2))

    def sound() -> str:
        form = r.choice(["[{}]", "<{}>", "*{}*", "({})", "{{{}}}", "(({}))"])
        return form.format(r.choice(SOUNDS) if r.random() < 0.8 else C.invented(r).lower())

    for line in sentences:
        for _ in range(n):
            row, first = [(START, "SPEECH")], True
            add = lambda text, tag: row.extend((t, ("B-" if tag == "LABEL" and not i else "I-" if tag == "LABEL" else "") + tag) for i, (t, _, _) in enumerate(tokens(text)[1:]))  # noqa: E731, B023
            if r.random() < 0.45:
                add(C.stamp(r), "TIME")
            if r.random() < 0.55:
                form = C.label(r, 0.35)[1]
                add(form + (" " if form[-1] == "-" else ""), "LABEL")
                if r.random() < 0.2:
                    add(C.stamp(r), "TIME")
            noise = r.choice([0, 0.05, 0.12, 0.2])
            sentence = said(line)
            if r.random() < 0.25:
                sentence = sentence.rstrip("." if r.random() < 0.3 else "") + " " + said(r.choice(sentences))
            for w in sentence.split(" "):
                if r.random() < noise:
                    k = r.random()
                    if k < 0.4:
                        h = r.choice(HESITATIONS)
                        h = h.capitalize() if r.random() < 0.1 else h
                        add(r.choice([h, h, h + ",", ", " + h + ",", h + "..."]), "FILLER")
                    elif k < 0.6:
                        add(", " + r.choice(PHRASES) + ",", "FILLER")
                    elif k < 0.75:
                        add(sound(), "NOISE")
                    elif k < 0.88 and w[:2].isalpha():
                        f = w[: r.choice([1, 2, 2, 3])]
                        add(r.choice([f, f + "-" + f.lower()]) + "- ", "CUT")
                    elif w.isalpha():
                        add(r.choice([w, w + ", " + w]), "SPEECH")
                if first and r.random() < 0.03:
                    add(sound(), "NOISE")
                first = False
                add(w, "SPEECH")
            if r.random() < 0.15:
                add(r.choice(["...", " .", "..."]), "SPEECH")
            if r.random() < 0.05:
                row = row[:2]
            out.append(row)
    for _ in range(n * 8):
        row = [(START, "SPEECH")]
        if r.random() < 0.4:
            row += [(t, "TIME") for t, _, _ in tokens(C.stamp(r))[1:]]
        row += [(t, "NOISE") for t, _, _ in tokens(sound())[1:]] if r.random() < 0.6 else [(t, "FILLER") for t, _, _ in tokens("uh, er")[1:]]
        out.append(row)
    return out


def model(spark: SparkSession) -> Crf:
    """The trained field, stored in the shared folder."""
    return stored(spark, "turns", Crf(LABELS, features, window=3), labelled, STEPS)


_TAG = {x: i for i, x in enumerate(LABELS)}


def normal(name: str | None) -> str:
    """A speaker's label without marks, remarks in brackets, accents or case: '**Yusuf G.:**' is 'yusuf g'."""
    if not name:
        return ""
    inner = re.sub(r"(?<=\w)[.\s*]*[(\[][^)\]]*[)\]]", "", name)
    plain = unicodedata.normalize("NFKD", inner.replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("ß", "ss"))
    plain = "".join(c for c in plain if not unicodedata.combining(c))
    found = re.findall(r"[^\W_]+", plain.lower())
    return " ".join(found if generic(" ".join(found)) else [w for w in found if not w.isdigit()])


def generic(who: str) -> bool:
    """Whether a normal label tells a machine's speaker, such as 'speaker 01'."""
    return bool(re.fullmatch(r"(?:speaker|spk|person|participant)(?: ?(?:\d+|[a-z]))?", who))


def settled(toks: list[tuple[str, int, int]], tags: list[int]) -> list[int]:
    """The tags after checks of each run: an annotation is bracketed and has letters, a broken-off beginning ends in a dash,
    fillers are known ones, and labels and time marks stand before the line's first word. What fails is speech."""
    out, begun, labelled, i = list(tags), False, False, 0
    while i < len(toks):
        tag, j = tags[i], i + 1
        group = 1 if tag == 2 else tag
        while j < len(toks) and tags[j] != 1 and (1 if tags[j] == 2 else tags[j]) == group:
            j += 1
        run = [t for t, _, _ in toks[i:j]]
        lettered = any(t[0].isalpha() for t in run)
        if group == 1 and not begun and "- " in run and not any(t in ":])*" for t in run):
            out[i:j] = [6] * (j - i)  # no label, whose dash has blanks on both sides
        elif group == 1 and (begun or labelled and not any(t in ":])*" for t in run) or not lettered):
            out[i:j] = [0 if lettered else 3] * (j - i)
        elif group == 1:
            labelled, named, closed = True, False, False
            for k, t in enumerate(run):  # what follows the label's end is speech
                if closed and t[0].isalnum():
                    out[i + k] = 0 if t[0].isalpha() else 3
                named = named or t[0].isalpha()
                closed = closed or named and t in ("-", " - ", "- ", ":", ")", "]")
        elif group == 3 and lettered:
            names = not begun and not labelled and any(t == ":" for t in run[max(k for k, t in enumerate(run) if t[0].isalpha()) :])
            out[i:j] = [(2 if names else 0) if t[0].isalpha() else 3 for t in run]
            labelled = labelled or names
        elif group == 3 and begun and (":" not in run or run[0] not in "[(<"):
            out[i:j] = [0] * (j - i)
        elif group == 4 and not (lettered and any(t in "[(<{*" for t in run)) or group == 6 and not any(t in ("- ", "-", " - ") for t in run):
            out[i:j] = [0] * (j - i)
        elif group == 4:
            depth = star = 0
            for k, t in enumerate(run):
                depth += (t in "[(<{") - (t in "])>}")
                star ^= t == "*"
                if t[0].isalnum() and not depth and not star:
                    out[i + k] = 0
        elif group == 5:
            low = " ".join(t.lower() for t in run if t[0].isalnum())
            for k, t in enumerate(run):
                if t[0].isalnum() and t.lower() not in _FILLERS or t[0].isalnum() and t.lower() in _PART and not any(f in low for f in _PHRASE):
                    out[i + k] = 0
        for k in range(i, j):
            if out[k] == 0 and toks[k][0].lower() in _HES:
                out[k] = 5
            begun = begun or out[k] == 0 and toks[k][0][0].isalnum()
        i = j
    spoken = [k for k, (t, _, _) in enumerate(toks) if out[k] == 0 and t[0].isalnum()]
    for a, b in zip(spoken, spoken[1:], strict=False):  # a beginning that the next word completes
        if a + 1 < len(toks) and toks[a + 1][0] == "- " and len(toks[a][0]) < len(toks[b][0]) and toks[b][0].lower().startswith(toks[a][0].lower()):
            out[a] = 6
    return out


_PHRASE = {p.lower() for p in PHRASES}
_PART = {w for p in _PHRASE for w in p.split()}
_FILLERS = _HES | _PART


def said(line: str, toks: list[tuple[str, int, int]], tags: np.ndarray) -> list[tuple[str, list[str]]]:
    """(label, words) for each part of a line: '' is the part before any label. Immediate repeats of a word are dropped."""
    parts: list[tuple[str, list[str]]] = [("", [])]
    label: list[tuple[int, int]] = []
    ended = False
    for (t, a, b), tag in zip(toks, settled(toks, tags.tolist()), strict=True):
        if tag in (1, 2) and t != START:
            label.append((a, b))
            continue
        if label:
            parts.append((line[label[0][0] : label[-1][1]], []))
            label, ended = [], False
        if tag == 0 and t[0].isalnum():
            w, words = t.lower(), parts[-1][1]
            if not (words and words[-1] == w and w.isalpha() and not (ended and t[0].isupper())):
                words.append(w)
            ended = False
        elif tag == 0 and t in ".?!":
            ended = True
    if label:
        parts.append((line[label[0][0] : label[-1][1]], []))
    return parts


def segments(df: DataFrame) -> DataFrame:
    """(meeting_id, turn_idx, stmt_id, seg, who, shown, words) of statements (meeting_id, turn_idx, stmt_id, speaker, raw_text).

    A statement gives a segment for each speaker label in its text, and one for what stands before. `who` is the normal
    label, that in the text before that of the column; '' is none. `shown` is the other one of the two where one is a
    machine's label, else ''. Of a statement delivered several times the greatest text counts; null texts have no words.
    """
    field = model(df.sparkSession)
    names = ["meeting_id", "turn_idx", "stmt_id", "seg", "who", "shown", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = list(zip(*(b.column(c).to_pylist() for c in ("meeting_id", "turn_idx", "stmt_id", "speaker", "raw_text")), strict=True))
            lines, owner = [], []
            for k, row in enumerate(given):
                for line in (row[4] or "").split("\n"):
                    lines.append((line, tokens(line)))
                    owner.append(k)
            tags = field.decode([t for _, toks in lines for t, _, _ in toks], np.array([len(toks) for _, toks in lines]))
            found: list[list[tuple[str, list[str]]]] = [[] for _ in given]
            at, before = 0, ""
            for k, (line, toks) in zip(owner, lines, strict=True):
                for who, words in said(line, toks, tags[at : at + len(toks)]):
                    if who or not found[k]:
                        found[k].append((normal(who), words))
                    else:
                        last = found[k][-1][1]
                        again = bool(last and words) and last[-1] == words[0] and words[0].isalpha() and before[-1:] not in ".?!"
                        last.extend(words[again:])  # a repeat over a line break
                at, before = at + len(toks), line.rstrip()
            out = []
            for (meeting, turn, stmt, speaker, _), parts in zip(given, found, strict=True):
                column = normal(speaker)
                if len(parts) > 1 and not parts[0][1]:
                    parts = parts[1:]
                for n, (who, words) in enumerate(parts):
                    shown = ""
                    if n == 0 and who and column and generic(who) != generic(column):
                        shown = column
                    out.append((meeting, turn, stmt, n, who or (column if n == 0 else ""), shown, " ".join(words)))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    rows = df.groupBy("meeting_id", F.col("turn_idx").cast("int").alias("turn_idx"), "stmt_id").agg(F.max(F.struct("raw_text", "speaker")).alias("r")).select("meeting_id", "turn_idx", "stmt_id", "r.speaker", "r.raw_text")
    return rows.mapInArrow(run, "meeting_id long, turn_idx int, stmt_id long, seg int, who string, shown string, words string")


def speakers(segs: DataFrame, roster: DataFrame) -> DataFrame:
    """(meeting_id, who, speaker): the roster person whom a label means within a meeting.

    People named in full take part; a given name, with or without an initial, means the one of them it fits; a machine's
    label means the person most often shown beside it. Labels that fit nobody, or several, are left out.
    roster: (entity_kind, full_name).
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("full_name"), pa.array([normal(x) for x in b.column("full_name").to_pylist()], pa.string())], names=["speaker", "full"])

    people = roster.where("entity_kind = 'person' and full_name is not null").select("full_name").distinct().mapInArrow(folded, "speaker string, full string").where("full <> ''")
    pairs = cut(segs.groupBy("meeting_id", "who", "shown").agg(F.count("*").alias("n")))  # a row for each label of a meeting, read three times
    labels = pairs.select("meeting_id", "who").unionByName(pairs.select("meeting_id", F.col("shown").alias("who"))).where("who <> ''").distinct()
    present = labels.join(people, F.col("who") == F.col("full")).select("meeting_id", "speaker", "full")
    first, last = F.split("full", " ")[0], F.element_at(F.split("full", " "), -1)
    forms = present.select("meeting_id", "speaker", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("full").alias("who")), F.struct(F.lit(1).alias("rank"), first.alias("who")), F.struct(F.lit(1).alias("rank"), F.concat_ws(" ", first, F.substring(last, 1, 1)).alias("who")), F.struct(F.lit(1).alias("rank"), last.alias("who")))).alias("f"))
    named = cut(forms.select("meeting_id", "speaker", "f.who").groupBy("meeting_id", "who").agg(F.min("speaker").alias("speaker"), F.max("speaker").alias("other")).where("speaker = other").drop("other"))
    # beside a machine's label stands a name, in the text or in the column
    beside = pairs.where("shown <> ''")
    is_machine = F.col("who").rlike(r"^(speaker|spk|person|participant)( ?(\d+|[a-z]))?$")
    beside = beside.select("meeting_id", F.when(is_machine, F.col("who")).otherwise(F.col("shown")).alias("machine"), F.when(is_machine, F.col("shown")).otherwise(F.col("who")).alias("who"), "n")
    votes = beside.join(named, ["meeting_id", "who"]).groupBy("meeting_id", "machine", "speaker").agg(F.sum("n").alias("n"))
    chosen = votes.groupBy("meeting_id", F.col("machine").alias("who")).agg(F.max_by("speaker", F.struct("n", "speaker")).alias("speaker"))
    return named.unionByName(chosen)


def turns(df: DataFrame, roster: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(meeting_id, turn_no, speaker, turn_words) of statements; see segments() and speakers() for the inputs.

    Segments without words make no turn and part none; segments without a speaker go on with the turn; those before a
    meeting's first known speaker, which no turn precedes, are left out. Meetings are worked on in chunks of turn_idx,
    whose summaries carry the last speaker and the number of turns to the next chunk, so no task holds a long meeting.
    Labels of nobody count as no label. Empty tables give no rows. Statements without turn_idx come last in their
    meeting, by stmt_id, in chunks of it; those without meeting_id belong to no meeting and are left out.
    """
    segs = cut(segments(df.where("meeting_id is not null")))  # tagged once, read by several joins
    known = speakers(segs, roster)
    rows = salted_join(segs.where("words <> ''").drop("shown"), known, ["meeting_id", "who"], "left")
    rows = rows.withColumn("late", F.col("turn_idx").isNull()).withColumn("chunk", F.floor(F.coalesce("turn_idx", "stmt_id", F.lit(0)) / chunk))
    order = Window.partitionBy("meeting_id", "late", "chunk").orderBy("turn_idx", "stmt_id", "seg")
    rows = rows.withColumn("now", F.last("speaker", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("step", ((F.lag("now").over(order) != F.col("now"))).cast("int"))
    rows = rows.withColumn("inner_no", F.sum(F.coalesce("step", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("turn_idx", "stmt_id", "seg")
    heads = rows.groupBy("meeting_id", "late", "chunk").agg(F.min_by("now", F.when(F.col("now").isNotNull(), place)).alias("first_now"), F.max_by("now", place).alias("last_now"), F.max("inner_no").alias("steps"))
    across = Window.partitionBy("meeting_id").orderBy("late", "chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("carry", F.last("last_now", True).over(before))
    heads = heads.withColumn("opens", F.when(F.col("first_now").isNull(), 0).otherwise((F.col("carry").isNull() | (F.col("carry") != F.col("first_now"))).cast("int")))
    heads = heads.withColumn("done", F.coalesce(F.sum(F.col("steps") + F.col("opens")).over(before), F.lit(0))).select("meeting_id", "late", "chunk", "carry", "opens", "done")
    full = rows.join(heads, ["meeting_id", "late", "chunk"])
    full = full.withColumn("turn_no", (F.col("done") + F.when(F.col("now").isNull(), 0).otherwise(F.col("inner_no") + F.col("opens"))).cast("int")).withColumn("speaker", F.coalesce("now", "carry")).where("speaker is not null")
    return full.groupBy("meeting_id", "turn_no", "speaker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("late", "turn_idx", "stmt_id", "seg", "words"))), lambda x: x["words"]), " ").alias("turn_words"))
