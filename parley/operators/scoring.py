"""Lexicon scores, naive Bayes, the ensemble of both, and quality of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of words by kind, for the lexicon score.
LEXICON = {
    "professional": {"budget": 1.0, "release": 0.9, "sensor": 0.8, "firmware": 0.9, "pipeline": 0.8, "audit": 0.7, "contract": 0.7, "migration": 0.8, "cutover": 0.8, "model": 0.7, "report": 0.7, "ticket": 0.6, "review": 0.6, "deploy": 0.9, "release": 0.9, "risk": 0.8, "decision": 0.9, "broker": 0.5, "scheduler": 0.5, "threshold": 0.6},
    "personal": {"minutes": 0.6, "flat": 0.9, "passport": 1.0, "licence": 0.8, "complaint": 0.7, "billing": 0.6},
    "casual": {"lunch": 0.8, "weekend": 0.9, "holiday": 0.6, "coffee": 0.7, "know": 0.3, "street": 0.4},
}
PHRASES = {"action": ("i will", "we will", "please", "let us"), "decision": ("decision on", "decided to", "agreed with", "stands"), "deadline": ("by friday", "by end of day", "before noon", "next tuesday", "this quarter", "until further notice")}


def lexicon_table(df: DataFrame) -> DataFrame:
    """(kind, term, weight): the lexicon as a dimension table of a few rows."""
    rows = [(k, t, w) for k, terms in LEXICON.items() for t, w in terms.items()]
    return df.sparkSession.createDataFrame(rows, "kind string, term string, weight double")


def sub_scores(df: DataFrame, key: str, text: str, tokens: str, stem: str) -> DataFrame:
    """(key, professional, personal, casual, action, decision, deadline): sums of lexicon weights, of stems at nine tenths, and half a point for each phrase present.

    df: one row per key with its lower-cased text and arrays of tokens and of their stems. The lexicon is fixed and is
    broadcast; the sums are combined on the map side. Keys without tokens score 0.
    """
    lex = F.broadcast(lexicon_table(df))
    words = df.select(key, F.explode(F.arrays_zip(F.col(tokens).alias("t"), F.col(stem).alias("s"))).alias("z")).select(key, "z.t", "z.s")
    hit = words.join(lex, F.col("t") == F.col("term")).select(key, "kind", "weight")
    only = words.join(lex.select("term").distinct().withColumnRenamed("term", "_known"), F.col("t") == F.col("_known"), "left_anti")
    by_stem = only.join(lex.where("kind = 'professional'"), F.col("s") == F.col("term")).select(key, "kind", (F.col("weight") * 0.9).alias("weight"))
    total = lambda k: F.round(F.sum(F.when(F.col("kind") == k, F.col("weight")).otherwise(0.0)), 6).alias(k)
    sums = hit.unionByName(by_stem).groupBy(key).agg(*[total(k) for k in LEXICON])
    phrase = lambda k: sum((F.col(text).contains(p).cast("int") for p in PHRASES[k]), F.lit(0)) * 0.5
    out = df.join(sums, key, "left")
    return out.select(key, *[F.coalesce(k, F.lit(0.0)).alias(k) for k in LEXICON], *[phrase(k).alias(k) for k in PHRASES])


def rule_score(professional: Column, personal: Column, casual: Column) -> Column:
    """A score in [0, 1] from positive, personal and casual sums: six cases, high where only work is talked of."""
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    return (
        F.when((personal > 0) & (professional == 0), F.least(F.lit(0.25), sigmoid(-(1.2 + 0.8 * personal))))
        .when(personal > 0, sigmoid(0.5 * (professional - 1.5 * personal)))
        .when((casual > 0) & (professional == 0), 0.38 - F.least(F.lit(0.06), 0.02 * casual))
        .when((professional > 0) & (casual == 0), F.greatest(F.lit(0.72), sigmoid(0.9 + 0.7 * professional)))
        .when(professional > 0, sigmoid(0.7 + 0.6 * (professional - 0.3 * casual)))
        .otherwise(F.lit(0.5))
    )


def naive_bayes(tokens: DataFrame, label: str, token: str, doc: str, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(priors (label, lp), likelihoods (label, token, lp)) of rows (doc, label, token).

    Priors aren't smoothed; likelihoods are, over the vocabulary of all classes. Tokens that a class never has keep
    their row, so scoring is one join. Classes and vocabulary come from counts combined on the map side.
    """
    docs = tokens.select(doc, label).distinct().groupBy(label).agg(F.count("*").alias("n"))
    total = docs.agg(F.sum("n"))
    priors = docs.select(label, F.log(F.col("n") / total.scalar()).alias("lp"))
    counts = tokens.groupBy(label, token).agg(F.count("*").alias("c"))
    # every class meets every word through the list of classes, which is a few values
    classes = docs.agg(F.sort_array(F.collect_set(label))).scalar()
    spine = counts.select(token).distinct().select(token, F.explode(classes).alias(label))
    sums = counts.groupBy(label).agg(F.sum("c").alias("n_words"))
    size = counts.select(token).distinct().agg(F.count("*"))
    full = spine.join(counts, [label, token], "left").join(F.broadcast(sums), label)
    return priors, full.select(label, token, F.log((F.coalesce("c", F.lit(0)) + alpha) / (F.col("n_words") + alpha * size.scalar())).alias("lp"))


def nb_probabilities(tokens: DataFrame, model: tuple[DataFrame, DataFrame], label: str, token: str, doc: str, docs: DataFrame | None = None) -> DataFrame:
    """(doc, label, p, matched): posterior of each class for documents (doc, token) with a known token; for others of `docs` (doc) all classes are alike."""
    priors, like = model
    sums = tokens.select(doc, token).join(like, token).groupBy(doc, label).agg(F.sum("lp").alias("s"), F.count("*").alias("matched"))
    scored = sums.join(F.broadcast(priors.withColumnRenamed("lp", "prior")), label).withColumn("lp", F.col("s") + F.col("prior"))
    w = Window.partitionBy(doc)
    scored = scored.withColumn("e", F.exp(F.col("lp") - F.max("lp").over(w)))
    out = scored.select(doc, label, (F.col("e") / F.sum("e").over(w)).alias("p"), "matched")
    if docs is None:
        return out
    classes = priors.agg(F.sort_array(F.collect_set(label))).scalar()  # a few values
    rest = docs.join(sums.select(doc).distinct(), doc, "left_anti").select(doc, F.explode(classes).alias(label), (1 / F.size(classes)).alias("p"), F.lit(0).cast("long").alias("matched"))
    return out.unionByName(rest)


def ensemble(rule: Column, nb: Column, matched: Column, boost: Column | float = 0.0) -> Column:
    """The score of both: naive Bayes weighs .45 from two known tokens on, .25 with one and nothing with none."""
    score = F.when(matched >= 2, 0.55 * rule + 0.45 * nb).when(matched == 1, 0.75 * rule + 0.25 * nb).otherwise(rule)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score + boost))


def category(score: Column) -> Column:
    return F.when(score >= 0.70, "professional").when(score < 0.30, "personal").when(score < 0.50, "casual").otherwise("uncertain")


def confidence(score: Column) -> Column:
    raw = F.when(score >= 0.70, score).when(score < 0.30, 1 - score).when(score < 0.50, 1 - F.abs(score - 0.40) / 0.15).otherwise(1 - F.abs(score - 0.60) / 0.20)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def retention(label: Column, conf: Column, mode: str, custom: float = 0.7) -> Column:
    """RETAIN, DELETE or ASK_USER for a class and its confidence under a privacy mode: STRICT, BALANCED or CUSTOM."""
    least = {"STRICT": 0.85, "BALANCED": 0.70}.get(mode, custom)
    strict = F.lit(mode == "STRICT")
    return F.when((label == "professional") & ((conf >= least) | ~strict), "RETAIN").when((label == "uncertain") & ~strict, "ASK_USER").otherwise("DELETE")


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n)."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def class_metrics(counts: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) over the classes that occur as truth or guess; 0 where a ratio has no base."""
    sides = counts.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(True).alias("is_truth")), F.struct(F.col("guess").alias("label"), F.lit(False).alias("is_truth")))).alias("s"), "truth", "guess", "n").select("s.*", "truth", "guess", "n")
    t = sides.groupBy("label").agg(F.sum(F.when(F.col("is_truth"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("is_truth"), F.col("n")).otherwise(0)).alias("guessed"), F.sum(F.when(F.col("is_truth") & (F.col("truth") == F.col("guess")), F.col("n")).otherwise(0)).alias("hits"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hits"), F.col("guessed")), ratio(F.col("hits"), F.col("support"))
    return t.select("label", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"), "support")


def inverse_frequencies(tokens: DataFrame, doc: str, token: str) -> DataFrame:
    """(token, df, idf) with idf = ln((1 + N) / (1 + df)) + 1."""
    n = tokens.agg(F.countDistinct(doc))
    return tokens.groupBy(token).agg(F.countDistinct(doc).alias("df")).withColumn("idf", F.log((1 + n.scalar()) / (1 + F.col("df"))) + 1)


def tfidf(tokens: DataFrame, doc: str, token: str) -> DataFrame:
    """(doc, token, weight): (1 + ln tf) * idf, to length 1 in each document."""
    counts = tokens.groupBy(doc, token).agg(F.count("*").alias("tf"))
    raw = counts.join(inverse_frequencies(tokens, doc, token), token).select(doc, token, ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    return raw.select(doc, token, (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))).alias("weight"))
