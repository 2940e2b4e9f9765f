"""Personal information in free text: found by a conditional random field, replaced by typed placeholders.

The field is trained on the labelled sentences of `corpus`, filled by rule, and stored in the shared folder.
Decoding runs over Arrow batches of whole texts.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parley.llm import corpus as C
from parley.llm.crf import Crf, stored

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "STREET_ADDRESS", "PERSON_NAME")
#: LABEL marks a speaker label at the start of a line, which is no personal information here.
LABELS = ["O", *(f"{p}-{k}" for k in (*KINDS, "LABEL") for p in "BI")]
START = "\n"
# Titles before names, and sounds of hesitation.
_HONORIFICS = {"dr", "prof", "mr", "mrs", "ms", "miss", "sir", "herr", "frau", "mme", "sr", "sra"}
_HESITATIONS = {"um", "uh", "er", "erm", "ah", "hmm", "mm", "uhm", "uhh", "ummm", "eh", "hm"}
_TOKEN = re.compile(r"\n|[^\W_]+|[^\w\s]|_")
#: A sentence may end here, unless an initial or one of these stands before.
_END = re.compile(r"[.?!] +(?=[A-Z(\[*<{])|(?=\n)")
_SHORT = re.compile(r"(?:\b\w|\b(?:Dr|Mr|Mrs|Ms|Prof|St|Rd|No|Nr)|str)$")

_GIVEN = {g.lower() for g in C.GIVEN}
# Usual endings of street names.
_STREETS = {"street", "lane", "road", "rd", "ave", "avenue", "close", "boulevard", "drive", "way", "court", "place", "rue", "calle", "via", "square", "blvd", "st"}


def features(token: str) -> list[str]:
    """What the field sees of a token: the word unless it is a given name, its shape, length, ending and a few lists."""
    if token == START:
        return ["start"]
    low = token.lower()
    shape = re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", re.sub(r"\d", "9", token))
    brief = re.sub(r"(.)\1+", r"\1+", shape)
    given = low in _GIVEN and low not in C.COMMON
    out = ["b=" + brief]
    if not given:  # names are told by being names, not one by one
        out.append("w=" + low)
    if len(token) <= 12 and any(c.isdigit() for c in token):
        out += ["s=" + shape, "digit"]
        if token[0] == "0":
            out.append("zero")
    if token.isdigit():
        out.append(f"n{min(len(token), 12)}")
    if token.isalpha():
        out.append(f"l{min(len(token), 9)}")
        if token[0].isupper() and len(token) > 1:
            out.append("cap")
            if token.isupper():
                out.append("allcap")
        if low in C.COMMON:
            out.append("common")
        elif given:
            out.append("given" + ("C" if token[0].isupper() else ""))
        if low in _STREETS:
            out.append("street")
        if low in _HONORIFICS and token[0].isupper():
            out.append("title")
        if low in _HESITATIONS:
            out.append("hes")
        if re.search(r"(?:stra(?:ss|ß)e|str|weg|gasse|platz|allee)$", low) and token[0].isupper():
            out.append("strasse")
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """Begin and end of the sentences of a text; a line break starts one."""
    out, last = [], 0
    for m in _END.finditer(text):
        at = m.start()
        if at > last and (text[at] == "\n" or not _SHORT.search(text, max(last, at - 6), at)):
            out.append((last, m.end()))
            last = m.end()
    out.append((last, len(text)))
    return out


_MAKE = {"EMAIL": C.email, "PHONE": C.phone, "ID": C.identity, "ADDR": C.address, "NAME": C.name}
_KIND = {"EMAIL": "EMAIL", "PHONE": "PHONE", "ID": "ID_NUMBER", "ADDR": "STREET_ADDRESS", "NAME": "PERSON_NAME"}
# What disturbs spoken sentences, for training.
_NOISE = "um|uh,|Um,|er|erm|uhm|uhh|, hmm,|hm...|ah,|, mm,|, like,|*laughs*|<cough>|[pause]|(sighs)|[noise]|, well,|, I guess,|...".split("|")
#: Fillings of each sentence in the labelled table.
FILLINGS = 18
STEPS = 120


def labelled(n: int = FILLINGS, seed: int = 5, sentences: list[str] = C.MARKED) -> list[list[tuple[str, str]]]:
    """The labelled table: n fillings of each sentence, half of them disturbed as spoken ones are, as (token, label) lists."""
    r, out = random.Random(seed), []
    for line in sentences:
        for _ in range(n):
            row, noisy = [(START, "O")] if r.random() < 0.5 else [], r.random() < 0.5
            text = line.rstrip(".") + " " + r.choice(sentences) if r.random() < 0.12 else line  # a full stop that wasn't written
            add = lambda text, k=None: row.extend((t, "O" if k is None else ("B-" if i == 0 else "I-") + k) for i, t in enumerate(_TOKEN.findall(text)))  # noqa: E731, B023
            if r.random() < 0.2:
                row = [(START, "O")]
                time, form = C.label(r, 0.7)
                parts = [(time, None), (form, "LABEL")]
                for text, k in parts if r.random() < 0.8 else parts[::-1]:
                    add(text, k)
            for piece in re.split(r"(\{\w+\})", text):
                kind = piece[1:-1] if piece.startswith("{") else None
                if kind is None:
                    words = piece.split(" ")
                    for i, w in enumerate(words):
                        if noisy and i and r.random() < (0.18 if w else 0.4):
                            add(r.choice([*_NOISE, words[i - 1], words[i - 1] + ", " + words[i - 1], words[i - 1][:2] + "-"]))
                        add(C.invented(r, 1, 2).lower() if w.isalpha() and w.islower() and w not in C.COMMON and r.random() < 0.2 else w)
                elif kind in _MAKE:
                    add(_MAKE[kind](r), _KIND[kind])
                elif kind in ("a", "n", "v", "d") and r.random() < 0.4:
                    add(C.invented(r, 1, 3).lower())
                else:
                    filling = C.slot(r, kind)
                    add(filling)
                    if noisy and kind in ("cap", "given", "town") and r.random() < 0.25:
                        add(r.choice([filling, ", " + filling, ", I mean,", ", I guess,", ", you see,"]))
            if r.random() < 0.15:
                row = row[:-1]
            if r.random() < 0.04:
                row = [(t.upper(), lab) for t, lab in row]
            if row:
                out.append(row)
    return out


def model(spark: SparkSession) -> Crf:
    """The trained field; the same at every call, as its table and its start are fixed. It is stored in the shared folder."""
    return stored(spark, "pii", Crf(LABELS, features), labelled, STEPS)


#: Small words within or before a surname, in lower case.
_PARTICLE = r"(?:de|del|della|der|den|di|da|das|do|dos|du|la|le|van|von|zu|zur|ter|ten|bin|ibn|al|el)"
_BEFORE = re.compile(rf"(?:(?<![\w'-])(?!do\b|den\b){_PARTICLE}\s+|(?<![\w'-])[dl]['’])+$")
_CAPITAL = r"(?:[dl]['’])?[A-ZÀ-ÞŁŠŽ][^\W\d_]*(?:['’-](?!s\b)[^\W\d_]+)*"
_GLUED = re.compile(r"(?<![\w'’-])(?:(?:[A-ZÀ-ÞŁŠŽ][^\W\d_]*|[dl])['’-])+$")
_STEM = re.compile(r"(?<![\w'’-])[A-ZÀ-ÞŁŠŽ][^\W\d_]*$")
_OPENS = re.compile(rf"(?:{_PARTICLE}\s|[dl]['’])")
_FIRST = re.compile(rf"{_CAPITAL}\s+$")
_REST = re.compile(rf"\s+(?:{_PARTICLE}\s+)*{_CAPITAL}")

_SHAPE = {
    "EMAIL": re.compile(r"(?i)\S.*(?:@|\(at\)|\[at\]|\bat\b).*\S"),
    "PHONE": re.compile(r"[+(\d](?:\D{0,3}\d){6,14}$"),
    "ID_NUMBER": re.compile(r"(?=(?:\D*\d){6})[A-Za-z0-9][A-Za-z0-9 /-]{5,}$"),
    "STREET_ADDRESS": re.compile(r"(?=.*\d)(?=.*[^\W\d_]{3})"),
    "PERSON_NAME": re.compile(rf"(?!.*\d)(?=.*[^\W\d_]{{2}})(?:{_PARTICLE}\s+)*[^\W\d_]+(?:['’-][^\W\d_]+)*[.,]*(?:(?:\s+{_PARTICLE})*\s+(?:[A-ZÀ-ÞŁŠŽ]|[dl]['’][A-ZÀ-ÞŁŠŽ])[\w'’.-]*,?)+$"),
}


def found_in(texts: list[str], field: Crf) -> list[list[tuple[str, int, int]]]:
    """(kind, begin, end) of the personal information in each text, in order."""
    toks: list[str] = []
    sizes: list[int] = []
    where: list[tuple[int, int, int]] = []  # text, begin, end of each sentence
    for k, text in enumerate(texts):
        for i, j in sentences(text):
            part = _TOKEN.findall(text, i, j)
            if i == 0 and text[:1] != START:
                part.insert(0, START)
            if part:
                toks += part
                sizes.append(len(part))
                where.append((k, i, j))
    lab = field.decode(toks, np.array(sizes, np.int64))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    bases = np.cumsum(sizes) - sizes
    hits = np.flatnonzero(lab)
    for s in np.unique(np.searchsorted(bases, hits, side="right") - 1).tolist():
        k, i, j = where[s]
        text, base = texts[k], int(bases[s])
        places = [(m.start(), m.end()) for m in _TOKEN.finditer(text, i, j)]
        if toks[base] == START and text[i : i + 1] != START:
            places.insert(0, (i, i))
        open_kind = None
        rows: list[list] = []
        for t, (a, b) in enumerate(places):
            prefix, _, kind = LABELS[lab[base + t]].partition("-")
            if kind and toks[base + t] != START:
                if prefix == "I" and kind == open_kind:
                    rows[-1][2] = b
                else:
                    rows.append([kind, a, b])
            open_kind = kind if kind and toks[base + t] != START else None
        for kind, a, b in rows:
            if kind != "LABEL" and (x := _checked(text, kind, a, b)) and x not in out[k]:
                out[k].append(x)
    return out


_DATE = re.compile(r"(?:19|20)\d\d-[01]\d-[0-3]\d$")
_LABELLED = re.compile(r"[.*)\]]{0,3} ?:")
_RUN = {
    "PHONE": re.compile(r"[+(]?\d[\d().-]*(?: ?[\d().-]*\d)*"),
    "ID_NUMBER": re.compile(r"(?:\b[A-Z]{1,3} ?)?\d[\d/-]*(?:[ /-]\d+)*(?: ?[A-Z]\b)?"),
    "EMAIL": re.compile(r"[\w.+-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?:(?:\.|\[dot\]|\(dot\))[\w-]+)+|\w+(?: (?:dot|underscore|plus|dash) [\w-]+)* at [\w-]+(?: dot [\w-]+)+"),
    "STREET_ADDRESS": re.compile(r"(?!)"),
    "PERSON_NAME": re.compile(r"(?!)"),
}


def _checked(text: str, kind: str, i: int, j: int) -> tuple[str, int, int] | None:
    """The piece with its edges put right, or None if it can't be of its kind.

    A piece that overlaps a longer run of the characters that numbers and addresses of its kind are made of, takes it all.
    """
    for m in _RUN[kind].finditer(text, max(0, i - 40), min(len(text), j + 40)):
        if m.start() < j + 2 * (kind in ("PHONE", "ID_NUMBER")) and m.end() > i:
            i, j = m.start(), m.end()
            break
    if kind == "PERSON_NAME":
        while (m := re.match(r"[^\W\d_]+\s+(?=\S)", text[i:j])) and m.group().strip().lower() in C.COMMON - _HONORIFICS:
            i += m.end()  # a word that begins the sentence
        i, j = _whole_name(text, i, j)
        first = next((k for k in range(i, j) if text[k].isupper()), j)
        i = first - len(m.group()) if (m := _BEFORE.search(text[i:first])) else first
        j = i + len(re.sub(r"(?:\s+[a-z](?!['’][A-Z])\S*)+$", "", text[i:j]))
    tail = {"PERSON_NAME": r"(?:[\s,;:-]+|(?<=\w\w\w)\.)$", "STREET_ADDRESS": r"(?:[\s,;:-]+|(?<!Rd)(?<!str)(?<!St)\.)$", "EMAIL": r"[\s.,;:]+$"}.get(kind, r"[\s.,;:)-]+$")
    j = i + len(re.sub(tail, "", text[i:j]))
    if kind == "STREET_ADDRESS" and text[j : j + 1] == "." and text[j - 2 : j] == "Rd":
        j += 1
    if kind == "PERSON_NAME" and (_LABELLED.match(text, j) or text[max(0, i - 1) : i] in ("", "\n") and text.startswith(" - ", j)):
        return None
    if kind == "ID_NUMBER" and _DATE.match(text[i:j]) or kind == "PERSON_NAME" and len(set(re.findall(r"\w+", text[i:j].lower()))) == 1:
        return None
    return (kind, i, j) if _SHAPE[kind].match(text[i:j]) else None


def _whole_name(text: str, i: int, j: int) -> tuple[int, int]:
    """The piece with the rest of a compound name that it cuts: a hyphen or an apostrophe within a word, or small particles."""
    before = text[max(0, i - 60) : i]
    if m := (_STEM if text[i] in "-'’" else _GLUED).search(before):
        i -= len(m.group())
    elif _OPENS.match(text, i, j) and "," not in text[i:j] and (m := _FIRST.search(before)):
        i -= len(m.group())
    if m := _BEFORE.search(text[max(0, i - 60) : i]):
        i -= len(m.group())
    piece = text[i:j]
    if re.match(r"[A-Z]\. [A-Z]", piece) and (m := _FIRST.search(before)) and i == len(text[:i].rstrip()) + 1 and m.group().strip().lower() not in C.COMMON and len(m.group().strip()) > 1:
        i -= len(m.group())  # a given name before an initial
        piece = text[i:j]
    if re.search(rf"\s{_PARTICLE}$", piece) or re.fullmatch(r"[^\W\d_]+(?:['’-][^\W\d_]+)+", piece):
        j = m.end() if (m := _REST.match(text, j)) else j
    return i, j


def find_pii(df: DataFrame) -> DataFrame:
    """(tbl, row_id, pii_kind, piece) of the texts of df (tbl, row_id, text); null and empty texts have none."""
    field = model(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at, kinds, pieces = [], [], []
            for k, rows in enumerate(found_in(texts, field)):
                for kind, i, j in rows:
                    at.append(k)
                    kinds.append(kind)
                    pieces.append(texts[k][i:j])
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("tbl").take(where), batch.column("row_id").take(where), pa.array(kinds, pa.string()), pa.array(pieces, pa.string())], names=["tbl", "row_id", "pii_kind", "piece"])

    return df.select("tbl", "row_id", "text").mapInArrow(run, "tbl string, row_id long, pii_kind string, piece string")


def masked(df: DataFrame) -> DataFrame:
    """df (tbl, row_id, text) with `text` in which each piece is replaced by its kind in brackets; null stays null, the rest is untouched."""
    field = model(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("text").to_pylist()
            out = []
            for text, rows in zip(given, found_in([t or "" for t in given], field), strict=True):
                for kind, i, j in reversed(rows):
                    text = f"{text[:i]}[{kind}]{text[j:]}"
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("tbl"), batch.column("row_id"), pa.array(out, pa.string())], names=["tbl", "row_id", "text"])

    return df.select("tbl", "row_id", "text").mapInArrow(run, "tbl string, row_id long, text string")
