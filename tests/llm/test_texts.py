from __future__ import annotations

import base64
import email
import quopri
import random
import re
import tracemalloc

import numpy as np
import pytest

from parley.llm import corpus, crf, leaks, mail, pii, spam, turns
from parley.llm.crf import Crf

ST = "meeting_id long, turn_idx int, stmt_id long, speaker string, raw_text string"


def test_viterbi_finds_the_best_path():
    field = Crf(["O", "A", "B"], lambda t: ["w=" + t]).fit([[("x", "O"), ("a", "A"), ("b", "B")], [("x", "O"), ("x", "O")], [("a", "A"), ("b", "B"), ("x", "O")]] * 4, steps=40, least=1)
    toks = "x a b x a x b".split()
    lab = field.decode(toks, np.array([4, 3]))
    w = field.window
    best = []
    for sent in (toks[:4], toks[4:]):
        code = [0] * w + field.code(sent).tolist() + [0] * w
        E = np.array([sum(field.table[code[i + o], o] for o in range(2 * w + 1)) for i in range(len(sent))])
        paths = [(sum(E[i, p[i]] for i in range(len(sent))) + sum(field.trans[p[i], p[i + 1]] for i in range(len(sent) - 1)), p) for p in np.ndindex(*[3] * len(sent))]
        best += max(paths)[1]
    assert lab.tolist() == best
    assert field.decode([], np.array([], int)).tolist() == []


def test_a_long_sentence_does_not_pad_the_short_ones():
    field = Crf(["O", "A", "B"], lambda t: ["w=" + t]).fit([[("x", "O"), ("a", "A"), ("b", "B")], [("x", "O"), ("x", "O")]] * 4, steps=40, least=1)
    long, toks = ["x", "a", "b"] * 1000, ["a", "b"] * 3999
    apart = field.decode(toks, np.full(3999, 2)).tolist() + field.decode(long, np.array([3000])).tolist()
    tracemalloc.start()
    together = field.decode(toks + long, np.array([2] * 3999 + [3000])).tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert together == apart and peak < 1e8


@pytest.fixture(scope="module")
def field(spark):
    return pii.model(spark)


def test_models_are_stored(spark, field):
    again = Crf(pii.LABELS, pii.features).from_bytes(field.to_bytes())
    toks = "Give it to Dr. Berg now".split()
    assert again.decode(toks, np.array([6])).tolist() == field.decode(toks, np.array([6])).tolist()
    crf._TRAINED.clear()
    assert pii.model(spark).index == field.index  # read back


KEPT, HELD = [[x for i, x in enumerate(corpus.MARKED) if (i % 6 == 0) == held] for held in (False, True)]


def test_pii_in_sentences_of_other_frames():
    """The frames of the test aren't those of the training; recall and precision of whole pieces, by the field alone and with its checks."""
    field = Crf(pii.LABELS, pii.features).fit(pii.labelled(sentences=KEPT), steps=pii.STEPS)
    alone, checked = [0, 0, 0], [0, 0, 0]
    for sent in pii.labelled(12, seed=99, sentences=HELD):
        toks = [t for t, _ in sent]
        pieces = [set(), set()]
        for k, tags in enumerate(([pii.LABELS[i] for i in field.decode(toks, np.array([len(toks)]))], [x for _, x in sent])):
            i = 0
            while i < len(tags):
                j = i + 1
                if tags[i] != "O" and "LABEL" not in tags[i]:
                    while j < len(tags) and tags[j] == "I" + tags[i][1:]:
                        j += 1
                    pieces[k].add((tags[i][2:], i, j))
                i = j
        for n, x in enumerate((pieces[0] & pieces[1], pieces[1], pieces[0])):
            alone[n] += len(x)
    r = random.Random(3)
    for line in HELD * 12:
        want, text = set(), ""
        for piece in re.split(r"(\{\w+\})", line):
            kind = piece[1:-1] if piece.startswith("{") else None
            filling = piece if kind is None else pii._MAKE[kind](r) if kind in pii._MAKE else corpus.slot(r, kind)
            if kind in pii._MAKE:
                want.add((pii._KIND[kind], len(text), len(text) + len(filling)))
            text += filling
        got = set(pii.found_in([text], field)[0])
        for n, x in enumerate((got & want, want, got)):
            checked[n] += len(x)
    print("field alone, recall and precision:", alone[0] / alone[1], alone[0] / alone[2], "with checks:", checked[0] / checked[1], checked[0] / checked[2])
    assert min(checked[0] / checked[1], checked[0] / checked[2]) > 0.85 and min(alone[0] / alone[1], alone[0] / alone[2]) > 0.75


def test_tags_in_sentences_of_other_frames():
    field = Crf(turns.LABELS, turns.features).fit(turns.labelled(sentences=[*KEPT, *turns.SAID * 5]), steps=turns.STEPS)
    right = total = lines = whole = 0
    for sent in turns.labelled(10, seed=99, sentences=HELD):
        toks = [t for t, _ in sent]
        tags = [turns.LABELS[i] for i in field.decode(toks, np.array([len(toks)]))]
        same = [a == b or not any(c.isalnum() for c in t) for t, a, b in zip(toks, tags, [x for _, x in sent], strict=True)]
        right, total, whole, lines = right + sum(same), total + len(same), whole + all(same), lines + 1
    print("tags right:", right / total, "lines right:", whole / lines)
    assert right / total > 0.97


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Call +44 20 7946 0481 if the remote relay stops.", [("PHONE", "+44 20 7946 0481")]),
        ("Send a spare key to olga.harron@kelumska.test before noon.", [("EMAIL", "olga.harron@kelumska.test")]),
        ("The spare relay is stored at Harlowstrasse 248, Yaristzac 12345 since the move.", [("STREET_ADDRESS", "Harlowstrasse 248")]),
        ("We owe Dr. Peltez a reply on INC-44213.", [("PERSON_NAME", "Dr. Peltez")]),
        ("Please call Jean-Luc Moreau about the relay.", [("PERSON_NAME", "Jean-Luc Moreau")]),
        ("We owe O'Brien, Anna a reply.", [("PERSON_NAME", "O'Brien, Anna")]),
        ("Maria de Souza called about the invoice.", [("PERSON_NAME", "Maria de Souza")]),
        ("We owe van der Berg, Anna a reply.", [("PERSON_NAME", "van der Berg, Anna")]),
        ("Haruka will take the minutes.", []),
        ("Build 2025-03-19 passed.", []),
        ("", []),
    ],
)
def test_pii_pieces(field, text, want):
    assert [(k, text[i:j]) for k, i, j in pii.found_in([text], field)[0]] == want


def test_pii_operators(spark):
    rows = [("t", 1, "Call 713-555-0191 now."), ("t", 2, None), ("t", 3, ""), ("t", 4, "Nothing here. " * 3000 + "Call 713-555-0191 if the remote relay stops.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "tbl string, row_id long, text string, piece string")
    got = {(r["row_id"], r["piece"]) for r in pii.find_pii(df).collect()}
    assert (4, "713-555-0191") in got and not {2, 3} & {i for i, _ in got}
    masked = {r["row_id"]: r["text"] for r in pii.masked(df).collect()}
    assert masked[2] is None and masked[3] == "" and masked[4].endswith("Call [PHONE] if the remote relay stops.")


def _turns(spark, rows, **kw):
    roster = spark.createDataFrame([("person", "Yusuf Garenlo"), ("person", "Olga Harron"), ("person", "Olga Wenistlo"), ("organisation", "Yusuf plc")], "entity_kind string, full_name string")
    out = turns.turns(spark.createDataFrame(rows, ST), roster, **kw).orderBy("meeting_id", "turn_no").collect()
    return [(r["turn_no"], r["speaker"], r["turn_words"]) for r in out]


ROWS = [
    (1, 2, 11, "Yusuf Garenlo", "[00:12] SPEAKER_01: The um budget budget is, you know, ready."),
    (1, 1, 10, "Olga Harron", "We will pu- publish the relay (laughs) at 13:00."),
    (1, 1, 10, "Olga Harron", "We will pu- publish the relay (laughs) at 13:00."),
    (1, 3, 12, None, "It went from 5 units to 7 percent."),
    (1, 4, 13, "OLGA", "hmm..."),
    (1, 6, 14, "SPEAKER_01", "Please review the old minutes."),
    (1, 7, 15, "", "**Olga H.:** Let us merge the scanner.\n>> Yusuf: Legal found 4 percent of rows wrong."),
    (2, 1, 20, None, None),
]


@pytest.mark.parametrize("chunk", [4096, 2, 1])
def test_turns(spark, chunk):
    assert _turns(spark, ROWS, chunk=chunk) == [
        (1, "Olga Harron", "we will publish the relay at 13 00"),
        (2, "Yusuf Garenlo", "the budget is ready it went from 5 units to 7 percent please review the old minutes"),
        (3, "Olga Harron", "let us merge the scanner"),
        (4, "Yusuf Garenlo", "legal found 4 percent of rows wrong"),
    ]


@pytest.mark.parametrize("chunk", [4096, 1])
def test_turns_without_an_index_come_last(spark, chunk):
    rows = [(1, None, 9, None, "Then the scanner failed."), *ROWS, (1, None, 8, "Yusuf Garenlo", "Ready."), (None, 1, 30, "Yusuf Garenlo", "Lost words.")]
    assert _turns(spark, rows, chunk=chunk)[3:] == [(4, "Yusuf Garenlo", "legal found 4 percent of rows wrong ready then the scanner failed")]


def test_turns_of_nothing(spark):
    assert _turns(spark, []) == []
    assert turns.normal("**Yusuf G.:**") == "yusuf g" and turns.normal(None) == "" and turns.normal("Olga (host)") == "olga"


BODY = "Größe: the relay = fine & <b>bold</b>\nnext line"


def _message(kind, encoding, body, extra=""):
    return f"From: A <a@x.test>\nContent-Type: {kind}; charset=utf-8\nContent-Transfer-Encoding: {encoding}\n{extra}\n{body}"


@pytest.mark.parametrize("nl", ["\n", "\r\n"])
@pytest.mark.parametrize("encoding", ["8bit", "quoted-printable", "base64"])
def test_parts_undo_encodings(encoding, nl):
    body = {"8bit": BODY, "quoted-printable": quopri.encodestring(BODY.encode()).decode(), "base64": base64.encodebytes(BODY.encode()).decode()}[encoding]
    m = _message("text/plain", encoding, body).replace("\n", nl)
    assert [p.text.strip() for p in mail.parts(m)] == [BODY]


def test_parts_of_multiparts():
    part = lambda kind, text, extra="": f"--b\nContent-Type: {kind}\n{extra}\n{text}\n"
    m = 'From x\nSubject: s\nContent-Type: multipart/mixed;\n boundary="b"\n\npreamble\n' + part("text/plain", "one") + part("text/html", "<p>two<br>lines</p>") + part("application/pdf", "x", "Content-Disposition: attachment\n") + part("text/plain", "file", 'Content-Disposition: attachment; filename="f.txt"\n')
    got = mail.parts(m)  # the last boundary is missing
    assert [(p.kind, p.attached) for p in got] == [("plain", False), ("html", False), ("plain", True)]
    assert mail.plain(got[1].text).split() == ["two", "lines"]
    assert sum(p.get_content_maintype() == "text" for p in email.message_from_string(m.partition("\n")[2]).walk()) == 3
    assert mail.parts(None) == [] and mail.parts("") == []


def test_leaks_match_brute_force(spark):
    r = random.Random(8)
    words = [f"v{i}" for i in range(150)]
    items = [(i, " ".join(r.choices(words, k=r.choice([5, 12, 30, 60])))) for i in range(40)] + [(98, None), (99, "")]
    docs = []
    for k in range(60):
        body = r.choices(words, k=r.choice([0, 10, 200]))
        if k % 3:
            w = r.choice(items[:40])[1].split()
            n = r.choice([11, 12, 20])
            a = r.randrange(max(1, len(w) - n + 1))
            at = r.randrange(len(body) + 1)
            body[at:at] = w[a : a + n]
        docs.append((k, _message("text/plain", "8bit", ", ".join(body).upper())))
    docs += [(900, None), (901, ""), docs[1]]
    want = set()
    for k, m in docs:
        for w in leaks.message_words(m):
            for i, t in items:
                x = leaks.words(t or "")
                if any(w[j : j + 12] == x[s : s + 12] for j in range(len(w) - 11) for s in range(len(x) - 11)):
                    want.add((k, i))
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, "s") for x in items], "item_id long, item_text string, text string")
    assert {tuple(x) for x in leaks.find_leaks(d, e).collect()} == want and len(want) > 10
    assert leaks.find_leaks(d, e.limit(0)).count() == 0


def test_leaks_over_several_indexes(spark):
    text = " ".join(f"u{i}" for i in range(30))
    items = spark.createDataFrame([(i, text if i == 4 else " ".join(f"z{i}x{j}" for j in range(20))) for i in range(5)], "item_id long, item_text string")
    docs = spark.createDataFrame([(1, _message("text/plain", "8bit", text))], "doc_id long, text string")
    for size, at_once in ((5000, 16), (1, 2), (2, 1)):
        assert [tuple(r) for r in leaks.find_leaks(docs, items, size=size, at_once=at_once).collect()] == [(1, 4)]


STUFFED = [
    "cheap central relay / discount remote sensor / cheap central relay / buy signed scanner / cheap central relay / discount remote sensor / buy signed scanner",
    "\n".join(f"https://a{i}.example/shop/x{i}.html" for i in range(20)),
    "\n".join(f"cheap relay SKU{1000 + i} {i}.99" for i in range(20)),
    " ".join(f"#tag{i}" for i in range(40)),
]
FINE = ["The relay in Ulondi went from 4 units to 7 percent and the lab noticed. We will send a spare key to legal by Friday.", "See https://a.example/x for the sign-off sheet that the lab asked us to review before the freeze.", ""]


def test_stuffed_messages(spark):
    quoted = "I agree with the plan for the relay and will send it to the lab.\n\n> " + "\n> ".join(STUFFED[1].split("\n")) + "\n-- \n" + STUFFED[3]
    docs = [(i, _message("text/plain", "8bit", t)) for i, t in enumerate(STUFFED * 2)] + [(100 + i, _message("text/plain", "8bit", t)) for i, t in enumerate([*FINE, quoted])] + [(200, None), (201, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r[0] for r in spam.stuffed(df).collect()} == set(range(8))
    assert spam.stuffed(df.limit(0)).count() == 0


def test_hosts_are_counted_exactly(spark):
    say = lambda who, text: _message("text/plain", "8bit", text).replace("From: ", f"From: {who}@x.example, ", 1)
    docs = [(i, say(f"s{i % 5}", STUFFED[0])) for i in range(12)] + [(50, say("s9", STUFFED[2]))]
    rows = {r["doc_id"]: r for r in spam.evidence(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    hosts = len({spam.mail.sender(m) for i, m in docs if i < 12})
    assert {rows[i]["hosts"] for i in range(12)} == {hosts} and rows[0]["stitched"] == (1.0 if hosts > 1 else 0.0)
    assert rows[50]["hosts"] == 1 and rows[50]["stitched"] == 0 and rows[50]["replicated"] > 0.2


def test_own_text():
    m = _message("text/plain", "8bit", "Own words here.\nOn 2025-02-15 00:30:34, Olga Harron wrote:\n> quoted\nmore own\n-- \nOlga\n________________\nThis message is confidential.")
    assert spam.own_text(m).split("\n")[:2] == ["Own words here.", "more own"] and "Olga" not in spam.own_text(m) and "confidential" not in spam.own_text(m)
    assert spam.own_text(_message("text/plain", "8bit", "a\n-----Original Message-----\nb")).strip() == "a"
