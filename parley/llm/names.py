"""Variant spellings of names: typed names linked to the roster entry they mean.

Every entry gives the forms in which its name is usually written; a typed name, cleaned, means the entry whose form is
nearest within a radius, if there is just one. The radius join partitions the metric space: names go to the cell of
their nearest pivot, forms also to every cell whose names they may reach by the triangle inequality, and the join
inside a cell is exact under the unrestricted Damerau-Levenshtein distance, which is a metric.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.skew import salted_join
from parley.sources.tables import cut

#: Pivots; typed names, and forms of the roster, that a task compares at once.
PIVOTS, TASK = 16, 4000
#: Forms, by the order of a hash, of which the pivots are chosen; all forms are placed and joined.
SAMPLE = 5000
#: Greatest radius; short forms have a smaller one, see radius().
RADIUS = 2
# Usual short forms of given names.
_SHORT = """alexander: alex sandy xander lex; andrew: andy drew; anthony: tony; benjamin: ben benny; christopher: chris kit topher;
daniel: dan danny; deborah: deb debbie debby; edward: ed eddie ned ted teddy; elizabeth: liz lizzie beth betty eliza lisa;
frederick: fred freddie freddy; gregory: greg; jennifer: jen jenny; joseph: joe joey; katherine: kate kathy katie kath kat;
margaret: maggie meg peggy marge margie; matthew: matt; matteo: teo; michael: mike mick mikey; nicholas: nick nicky;
patricia: pat patty tricia trish; rebecca: becky becca; robert: bob rob bobby robbie bert; samantha: sam sammy;
susannah: sue susie suzy susan; theodore: ted theo teddy; thomas: tom tommy; timothy: tim timmy; victoria: vicky vicki tori vic;
william: will bill billy willy liam; valentin: val; gwen: gwendolyn; quentin: quin; rafael: rafa raf; ulrike: uli; lukas: luke luca;
jonathan: jon; james: jim jimmy jamie; richard: rick dick richie; charles: charlie chuck; david: dave; steven: steve; laura: laurie;
beatriz: bea; camila: cami; agnieszka: aga; stephen: steve; peter: pete; john: johnny jack""".replace("\n", " ")
SHORT = {full.strip(): short.split() for full, _, short in (x.partition(":") for x in _SHORT.split(";"))}
# Usual legal forms of companies, as written without dots.
LEGAL = {"ltd", "limited", "plc", "inc", "incorporated", "gmbh", "ag", "sarl", "bv", "sa", "llc", "corp", "co", "kg", "oy", "ab", "nv", "spa"}
_LETTERS = "abcdefghijklmnopqrstuvwxyz "


def folded(text: str) -> str:
    """Lower case, without accents."""
    out = unicodedata.normalize("NFKD", text.lower().replace("ø", "o").replace("ł", "l").replace("ß", "ss").replace("đ", "d").replace("æ", "ae"))
    return "".join(c for c in out if not unicodedata.combining(c))


def cleaned(typed: str | None) -> str:
    """The words of a typed name, of any script, without remarks: '' if there are none.

    Remarks stand in brackets, behind a slash or a dash between blanks, or behind a comma that follows two words or more.
    """
    if not typed:
        return ""
    text = re.sub(r"\([^)]*\)?|\[[^\]]*\]?|\{[^}]*\}?|<[^>]*>?", " ", typed)
    text = re.split(r"\s+/|/\s+|\s+[-–—|]\s+", text.strip())[0]
    head, comma, tail = text.partition(",")
    low = folded(tail)
    if comma and len(head.split()) > 1 and not any(w.replace(".", "") in LEGAL for w in low.split()):
        text = head
    low = folded(text).replace("b.v", "bv").replace("s.a.r.l", "sarl").replace("&", " ")
    words = re.findall(r"[^\W\d_]+", low)
    if words and words[0] == "the":
        words = words[1:]
    words = [w for w in words if w != "and"]
    if len(words) > 1 and words[-1] in LEGAL:
        words = words[:-1]
    return " ".join(words)


def forms_of(kind: str, full_name: str) -> dict[str, int]:
    """The forms of a name, cleaned, and how many edits away from each a typed name may be at most."""
    words = cleaned(full_name).split()
    out: dict[str, int] = {}

    def add(form: str, most: int) -> None:
        out[form] = max(out.get(form, 0), min(most, radius(form)))

    if not words:
        return out
    if kind == "person" and len(words) > 1:
        family, rest = words[-1], words[:-1]
        given = " ".join(rest)
        for g in [given, *SHORT.get(rest[0], [])]:
            add(f"{g} {family}", RADIUS)
            add(f"{family} {g}", RADIUS)
            add(f"{g} {family[0]}", 0)
            for k in range(2, min(6, len(family))):
                add(f"{g} {family[:k]}", 0)
            add(g, 0)
        for k in range(2, min(6, len(given))):
            add(f"{given[:k]} {family}", 1 if k > 2 else 0)
        add(f"{given[0]} {family}", RADIUS)
        add(f"{family} {given[0]}", RADIUS)
        add(given[0] + family, 1)
        add(family + given[0], 0)
        add(given + family, 1)
        add(family, 1)
    else:
        add(" ".join(words), RADIUS)
        for k in range(1, len(words)):  # in another order
            add(" ".join(words[k:] + words[:k]), RADIUS)
        add(" ".join(reversed(words)), RADIUS)
        if len(words) > 1:
            core, rest = words[0], words[1:]
            add("".join(w[0] for w in words), 0)
            add(core, 1)
            for w in rest:  # one of its trades
                add(f"{core} {w}", RADIUS)
                add(f"{w} {core}", RADIUS)
                for k in (3, 4, 5):
                    add(f"{core} {w[:k]}", 0)
            for cut in product((1, 3, 4, 5, 99), repeat=len(rest)):  # trades cut short
                add(" ".join([core, *(w[:k] for w, k in zip(rest, cut, strict=True))]), 0)
            legal = re.sub(r"[^a-z]", "", folded(full_name.split()[-1]))
            if legal in LEGAL:
                add("".join(w[0] for w in words) + legal[0], 0)
    return out


def radius(form: str) -> int:
    """Edits allowed for a form: 2 from 10 letters on, 1 from 6 on, else none."""
    n = len(form.replace(" ", ""))
    return 2 if n >= 10 else 1 if n >= 6 else 0


def alphabet() -> dict[int, int]:
    """Code points to small numbers; coded() adds those that it meets."""
    return {ord(c): k for k, c in enumerate(_LETTERS, 1)}


def coded(names: list[str], letters: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Letters as numbers, padded with 0, and lengths. Names to be compared take one alphabet."""
    letters = alphabet() if letters is None else letters
    size = np.array([len(x) for x in names], np.int64)
    out = np.zeros((len(names), max(1, int(size.max(initial=1)))), np.int16)
    kinds, at = np.unique(np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    numbers = np.array([letters.setdefault(c, len(letters) + 1) for c in kinds.tolist()], np.int16)
    if len(at):
        out[np.arange(out.shape[1]) < size[:, None]] = numbers[at]
    return out, size


def distances(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distances of a[k] and b[k]: insertions, deletions, substitutions and transpositions cost 1."""
    n, la, lb = len(a), a.shape[1], b.shape[1]
    far = la + lb
    rows = np.arange(n)
    D = np.full((n, la + 2, lb + 2), far, np.int16)
    D[:, 1, 1:] = np.arange(lb + 1)
    D[:, 1:, 1] = np.arange(la + 1)
    last = np.zeros((n, 1 + max(a.max(initial=0), b.max(initial=0))), np.int16)  # row in which a letter stood last
    for i in range(1, la + 1):
        match = np.zeros(n, np.int64)  # column of the last match in this row
        for j in range(1, lb + 1):
            k = last[rows, b[:, j - 1]]
            same = a[:, i - 1] == b[:, j - 1]
            swap = D[rows, k, match] + (i - k - 1) + 1 + (j - match - 1)
            best = np.minimum(D[:, i, j] + ~same, np.minimum(D[:, i + 1, j], D[:, i, j + 1]) + 1)
            D[:, i + 1, j + 1] = np.minimum(best, swap)
            match[same] = j
        last[rows, a[:, i - 1]] = i
    return D[rows, na + 1, nb + 1]


def _to_pivots(names: list[str], pivots: list[str]) -> np.ndarray:
    """Distances [names, pivots]."""
    letters = alphabet()
    a, na = coded(names, letters)
    b, nb = coded(pivots, letters)
    out = np.zeros((len(names), len(pivots)), np.int16)
    for lo in range(0, len(names), 5000):
        x, nx = a[lo : lo + 5000], na[lo : lo + 5000]
        for p in range(len(pivots)):
            out[lo : lo + 5000, p] = distances(x, nx, np.repeat(b[p : p + 1, : nb[p]], len(x), 0), np.full(len(x), nb[p]))
    return np.minimum(out, 127).astype(np.int8)


def pivots_of(forms: list[str], count: int = PIVOTS) -> list[str]:
    """Forms far from each other: each is the one farthest from those before it."""
    forms = sorted(forms, key=lambda f: (-len(f), f))
    if not forms:
        return ["a"]
    out = [forms[0]]
    near = _to_pivots(forms, out)[:, 0].astype(int)
    while len(out) < min(count, len(forms)) and near.max() > 0:
        out.append(forms[int(near.argmax())])
        near = np.minimum(near, _to_pivots(forms, out[-1:])[:, 0])
    return out


def within(queries: pd.DataFrame, forms: pd.DataFrame) -> pd.DataFrame:
    """(name, entity_id, d): the forms (form, entity_id, most, v) at most `most` edits from the names (name, v); v are distances to the pivots."""
    out = []
    if len(queries) and len(forms):
        names, texts = queries["name"].tolist(), forms["form"].tolist()
        letters = alphabet()
        a, na = coded(names, letters)
        b, nb = coded(texts, letters)
        va = np.stack([np.frombuffer(v, np.int8) for v in queries["v"]]).astype(np.int16)
        vb = np.stack([np.frombuffer(v, np.int8) for v in forms["v"]]).astype(np.int16)
        most = forms["most"].to_numpy().astype(np.int16)
        bag = lambda x: np.stack([(x == c).sum(axis=1) for c in range(1, len(letters) + 1)], axis=1).astype(np.int16)
        ba, bb = bag(a), bag(b)
        for lo in range(0, len(names), 400):
            q = slice(lo, lo + 400)
            fit = np.abs(na[q, None] - nb[None]) <= most
            for p in range(va.shape[1]):
                fit &= np.abs(va[q, None, p] - vb[None, :, p]) <= most
            x, y = np.nonzero(fit)
            keep = np.abs(ba[lo + x] - bb[y]).sum(axis=1) <= 2 * most[y]
            x, y = x[keep] + lo, y[keep]
            for k in range(0, len(x), 20000):
                i, j = x[k : k + 20000], y[k : k + 20000]
                d = distances(a[i], na[i], b[j], nb[j])
                ok = d <= most[j]
                out.append(pd.DataFrame({"name": queries["name"].to_numpy()[i[ok]], "entity_id": forms["entity_id"].to_numpy()[j[ok]], "d": d[ok].astype(np.int32)}))
    return pd.concat(out) if out else pd.DataFrame({"name": pd.Series(dtype=str), "entity_id": pd.Series(dtype="int64"), "d": pd.Series(dtype="int32")})


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(form, e, most) for e, kind, name in zip(*(b.column(c).to_pylist() for c in ("entity_id", "entity_kind", "full_name")), strict=True) for form, most in forms_of(kind, name).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32()))], names=["form", "entity_id", "most"])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        given = b.column("typed").to_pylist()
        yield pa.RecordBatch.from_arrays([b.column("typed"), pa.array([cleaned(t) for t in given], pa.string())], names=["typed", "name"])


def _split(rows: DataFrame, counts: DataFrame, own: str, other: str, task: int, by: str) -> DataFrame:
    """rows with the parts of their cell on both sides: spread over as many as hold `task` rows each, and repeated for those of the other side."""
    parts = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / task).cast("int")
    sized = rows.join(F.broadcast(counts.select("cell", parts(own).alias("mine"), parts(other).alias("theirs"))), "cell").where("theirs > 0")
    return sized.withColumn(f"part_{own}", F.pmod(F.hash(by), "mine")).withColumn(f"part_{other}", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1))).drop("mine", "theirs")


def resolved(typed: DataFrame, roster: DataFrame, count: int = PIVOTS, task: int = TASK) -> DataFrame:
    """(typed, entity_id): the typed names (typed) that mean exactly one roster entry (entity_id, entity_kind, full_name).

    The nearest entry counts; a name as near to several, or within no form's radius, is left out, as are null and empty
    names. An entry listed twice under one id is one entry. Forms are made and placed by tasks; the driver sees a sample
    of SAMPLE forms, of which it takes the pivots, and the sizes of the cells. Within a cell both sides are split into
    parts of about `task`, and each part of one meets each of the other in a task, so no cell is gathered.
    """
    entries = roster.where("full_name is not null").select("entity_id", "entity_kind", "full_name").distinct()
    forms = entries.mapInArrow(_forms, "form string, entity_id long, most int").groupBy("form", "entity_id").agg(F.max("most").alias("most"))
    pivots = pivots_of([r[0] for r in forms.select("form").distinct().orderBy(F.xxhash64("form"), "form").limit(SAMPLE).collect()], count)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _to_pivots(b.column("name").to_pylist(), pivots)
                yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(v.argmin(axis=1).astype(np.int32)), pa.array([x.tobytes() for x in v], pa.binary())], names=["name", "cell", "v"])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _to_pivots(b.column("form").to_pylist(), pivots)
                row, cell = np.nonzero(v <= v.min(axis=1, keepdims=True) + 2 * np.asarray(b.column("most"))[:, None])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("form", "entity_id", "most")), pa.array([v[k].tobytes() for k in row], pa.binary()), pa.array(cell.astype(np.int32))], names=["form", "entity_id", "most", "v", "cell"])

    # few bytes but much work: a fixed number of partitions isn't coalesced
    spread = typed.sparkSession.sparkContext.defaultParallelism * 2
    even = lambda df, c: df.repartitionById(spread, F.pmod(F.hash(c), F.lit(spread)))
    names = cut(even(typed.select("typed").where("typed is not null").distinct(), "typed").mapInArrow(_cleaned, "typed string, name string").where("name <> ''"))
    queries = cut(even(names.select("name").distinct(), "name").mapInArrow(placed, "name string, cell int, v binary"))
    right = cut(even(forms, "form").mapInArrow(reached, "form string, entity_id long, most int, v binary, cell int"))
    counts = cut(queries.groupBy("cell").agg(F.count("*").alias("q")).join(right.groupBy("cell").agg(F.count("*").alias("f")), "cell", "full"))  # a row for each pivot
    left = _split(queries, counts, "q", "f", task, "name")
    other = _split(right, counts, "f", "q", task, "form")
    keys = ["cell", "part_q", "part_f"]
    left, other = left.repartition(2 * spread, *keys), other.repartition(2 * spread, *keys)
    hits = left.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInPandas(within, "name string, entity_id long, d int")
    near = hits.groupBy("name", "entity_id").agg(F.min("d").alias("d")).groupBy("name").agg(F.min_by("entity_id", "d").alias("entity_id"), F.min("d").alias("d"), F.collect_list("d").alias("ds"))
    one = near.where(F.size(F.filter("ds", lambda x: x == F.col("d"))) == 1).select("name", "entity_id")
    return names.join(one, "name").select("typed", "entity_id")


def linked(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """(tbl, row_id, entity_id) of rows (tbl, row_id, typed) whose name means one entry but isn't written as its full_name."""
    exact = roster.select(F.col("full_name").alias("typed"), F.lit(True).alias("exact")).distinct()
    typed = rows.select("typed").where("typed is not null").groupBy("typed").count().select("typed")
    found = resolved(typed.join(exact, "typed", "left_anti"), roster)
    return salted_join(rows.where("typed is not null"), found, ["typed"], "inner").select("tbl", "row_id", "entity_id").distinct()
