"""Queries on lexicon scores, naive Bayes, privacy policy, quality metrics and term weights.

Labels come from the statements' semantic types: CASUAL is casual, OPINION and UNCERTAINTY are uncertain, the rest is
professional.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import scoring as S
from parley.plans.texts import _sql_stem, _sql_tokens
from parley.sources.tables import cut, table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "statements", "stmt_id", "clean_text", "semantic_type").where("clean_text is not null")
    rows = rows.groupBy("stmt_id").agg(F.max(F.struct("clean_text", "semantic_type")).alias("r")).select("stmt_id", "r.*")
    label = F.when(F.col("semantic_type") == "CASUAL", "casual").when(F.col("semantic_type").isin("OPINION", "UNCERTAINTY"), "uncertain").otherwise("professional")
    return rows.select("stmt_id", label.alias("label"), F.lower("clean_text").alias("low"), T.tokens(F.col("clean_text")).alias("t"))


def _tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements with their tokens and stems, made once and kept in a checkpoint, as several branches read them."""
    return cut(_rows(spark, sf_dir).withColumn("s", F.transform("t", T.stemmed)))


def _words(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return (_rows(spark, sf_dir) if rows is None else rows).select("stmt_id", "label", F.explode("t").alias("token"))


def _scored(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    sub = S.sub_scores(_tokenised(spark, sf_dir) if rows is None else rows, "stmt_id", "low", "t", "s")
    return sub.withColumn("score", S.rule_score(F.col("professional") + F.col("action") + F.col("decision") + F.col("deadline"), F.col("personal"), F.col("casual")))


def _posteriors(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(stmt_id, label, p, matched) of every statement, by the model trained on the statements of the other parity."""
    out = []
    for half in (0, 1):
        model = S.naive_bayes(words.where(F.col("stmt_id") % 2 == half), "label", "token", "stmt_id")
        other = F.col("stmt_id") % 2 != half
        out.append(S.nb_probabilities(words.where(other), model, "label", "token", "stmt_id", rows.where(other).select("stmt_id")))
    return out[0].unionByName(out[1])


def cls_subscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon and phrase scores of each statement."""
    return _scored(spark, sf_dir).drop("score")


def cls_rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule score of each statement."""
    return _scored(spark, sf_dir).select("stmt_id", F.round("score", 6).alias("score"))


def cls_nb_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihoods of the naive Bayes model."""
    return S.naive_bayes(_words(spark, sf_dir), "label", "token", "stmt_id")[1].select("label", "token", F.round("lp", 6).alias("lp"))


def cls_nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors of every statement by a model that was trained on the other half of them; without known tokens all classes are alike."""
    rows = cut(_rows(spark, sf_dir))
    return _posteriors(rows, _words(spark, sf_dir, rows)).select("stmt_id", "label", F.round("p", 6).alias("p"), "matched")


def _ensembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tokenised(spark, sf_dir)
    nb = _posteriors(rows, _words(spark, sf_dir, rows)).where("label = 'professional'").select("stmt_id", "p", "matched")
    scored = _scored(spark, sf_dir, rows).select("stmt_id", "score").join(nb, "stmt_id").join(rows.select("stmt_id", "label"), "stmt_id")
    scored = scored.withColumn("final", F.round(S.ensemble(F.col("score"), F.col("p"), F.col("matched")), 6))
    return scored.select("stmt_id", "label", "final", S.category(F.col("final")).alias("category"), F.round(S.confidence(F.col("final")), 6).alias("confidence"))


def cls_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, class and confidence of each statement by both scorers."""
    return _ensembled(spark, sf_dir)


def agg_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion matrix of the ensemble; naive Bayes scores no statement that it was trained on."""
    return S.confusion(_ensembled(spark, sf_dir), "label", "category")


def agg_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each class."""
    return S.class_metrics(agg_confusion(spark, sf_dir))


def agg_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, and precision, recall and F1 as means over the classes that occur as truth or guess."""
    counts = cut(agg_confusion(spark, sf_dir))
    right = counts.agg(F.round(F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("accuracy"), F.sum("n").alias("samples"))
    macro = S.class_metrics(counts).agg(*[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    return right.select("*", F.lit(1).alias("k")).join(macro.withColumn("k", F.lit(1)), "k").drop("k")


def rpt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality report as text lines, one for each class."""
    row = F.format_string("%-15s P=%.4f R=%.4f F1=%.4f n=%d", "label", "precision", "recall", "f1", "support")
    return agg_class_metrics(spark, sf_dir).select("label", row.alias("line"))


def _actions(*modes: str) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), S.retention(F.col("category"), F.col("confidence"), m).alias("action")) for m in modes])).alias("x")


def flt_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each privacy mode does with the statements, by class."""
    return _ensembled(spark, sf_dir).select("category", _actions("STRICT", "BALANCED", "CUSTOM")).groupBy("x.mode", "category", "x.action").agg(F.count("*").alias("n"))


def agg_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of casual statements that each mode would keep, and of professional ones."""
    share = lambda k: F.round(F.count_if((F.col("x.action") == "RETAIN") & (F.col("label") == k)) / F.count_if(F.col("label") == k), 6)
    return _ensembled(spark, sf_dir).select("label", _actions("STRICT", "BALANCED")).groupBy("x.mode").agg(share("casual").alias("leakage"), share("professional").alias("retention"))


def flt_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three outputs of the balanced policy: kept rows, rows pending a person's answer, and the audit, which has no text."""
    rows = _ensembled(spark, sf_dir).select("stmt_id", "category", "confidence", _actions("BALANCED")).select("stmt_id", "category", "confidence", "x.action")
    outputs = F.when(F.col("action") == "RETAIN", F.array(F.lit("kept"), F.lit("audit"))).when(F.col("action") == "ASK_USER", F.array(F.lit("pending"))).otherwise(F.array(F.lit("audit")))
    return rows.select(F.explode(outputs).alias("output"), "stmt_id", "action", "category", "confidence")


def flt_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending statements after answers arrived for those of even number, of which every second is approved: approved, refused or still pending."""
    pending = flt_streams(spark, sf_dir).where("output = 'pending'").select("stmt_id")
    answers = table(spark, sf_dir, "statements", "stmt_id").distinct().where("stmt_id % 2 = 0").select("stmt_id", (F.col("stmt_id") % 4 == 0).alias("approved"))
    fate = F.when(F.col("approved").isNull(), "pending").when(F.col("approved"), "approved").otherwise("refused")
    return pending.join(answers, "stmt_id", "left").groupBy(fate.alias("fate")).agg(F.count("*").alias("n"))


def agg_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies and inverse document frequencies of tokens."""
    return S.inverse_frequencies(_words(spark, sf_dir), "stmt_id", "token").select("token", "df", F.round("idf", 6).alias("idf"))


def agg_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest term of each statement."""
    w = S.tfidf(cut(_words(spark, sf_dir).select("stmt_id", "token")), "stmt_id", "token").withColumn("weight", F.round("weight", 6))
    return w.groupBy("stmt_id").agg(F.min_by("token", F.struct(-F.col("weight"), F.col("token"))).alias("token"), F.max("weight").alias("weight"))


def agg_word_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 45 tokens of greatest mean weight among those in at least five statements."""
    w = S.tfidf(cut(_words(spark, sf_dir).select("stmt_id", "token")), "stmt_id", "token").groupBy("token").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("weight"))
    return w.where("n >= 5").orderBy(F.desc("weight"), "token").limit(45)


def jn_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each statement's entity and evidence to its text, over distinct tokens."""
    rows = table(spark, sf_dir, "statements", "stmt_id", "evidence", "clean_text").where("clean_text is not null and evidence is not null")
    rows = rows.groupBy("stmt_id").agg(F.max(F.struct("clean_text", "evidence")).alias("r")).select("stmt_id", "r.*")
    d = lambda c: F.array_distinct(T.tokens(F.col(c)))
    return rows.select("stmt_id", F.round(T.jaccard(d("evidence"), d("clean_text")), 6).alias("jaccard"))


_ROWS = f"""rows_ AS (SELECT stmt_id, CASE WHEN st = 'CASUAL' THEN 'casual' WHEN st IN ('OPINION', 'UNCERTAINTY') THEN 'uncertain' ELSE 'professional' END AS label, lower(ct) AS low, {_sql_tokens('ct')} AS t
  FROM (SELECT stmt_id, clean_text AS ct, semantic_type AS st FROM (SELECT *, row_number() OVER (PARTITION BY stmt_id ORDER BY clean_text DESC, semantic_type DESC NULLS LAST) AS rn FROM statements WHERE clean_text IS NOT NULL) WHERE rn = 1)),
words AS (SELECT stmt_id, label, unnest(t) AS token FROM rows_)"""
_LEX = "lex(kind, term, weight) AS (VALUES " + ", ".join(f"('{k}', '{t}', {w}::DOUBLE)" for k, terms in S.LEXICON.items() for t, w in terms.items()) + ")"
_phr = lambda k: "(" + " + ".join(f"contains(low, '{p}')::INT" for p in S.PHRASES[k]) + ") * 0.5::DOUBLE"
_SUB = f"""{_ROWS}, {_LEX}, hits AS (
  SELECT stmt_id, kind, weight FROM words JOIN lex ON token = term
  UNION ALL SELECT stmt_id, kind, weight * 0.9 FROM (SELECT stmt_id, token, {_sql_stem('token')} AS s FROM words WHERE token NOT IN (SELECT term FROM lex)) JOIN lex ON s = term AND kind = 'professional'),
sums AS (SELECT stmt_id, {', '.join(f"round(coalesce(sum(weight) FILTER (kind = '{k}'), 0), 6) AS {k}" for k in S.LEXICON)} FROM hits GROUP BY 1),
sub AS (SELECT r.stmt_id, {', '.join(f'coalesce({k}, 0.0) AS {k}' for k in S.LEXICON)}, {', '.join(f'{_phr(k)} AS {k}' for k in S.PHRASES)} FROM rows_ r LEFT JOIN sums USING (stmt_id)),
ruled AS (SELECT stmt_id, CASE WHEN personal > 0 AND pos = 0 THEN least(0.25, 1 / (1 + exp(1.2 + 0.8 * personal))) WHEN personal > 0 THEN 1 / (1 + exp(-0.5 * (pos - 1.5 * personal)))
  WHEN casual > 0 AND pos = 0 THEN 0.38 - least(0.06, 0.02 * casual) WHEN pos > 0 AND casual = 0 THEN greatest(0.72, 1 / (1 + exp(-(0.9 + 0.7 * pos)))) WHEN pos > 0 THEN 1 / (1 + exp(-(0.7 + 0.6 * (pos - 0.3 * casual)))) ELSE 0.5 END AS score
  FROM (SELECT *, professional + action + decision + deadline AS pos FROM sub))"""


def _nb(words: str, p: str = "") -> str:
    return f"""{p}docs AS (SELECT label, count(*) AS n FROM (SELECT DISTINCT stmt_id, label FROM {words}) GROUP BY 1), {p}priors AS (SELECT label, ln(n / (SELECT sum(n) FROM {p}docs)) AS lp FROM {p}docs),
{p}counts AS (SELECT label, token, count(*) AS c FROM {words} GROUP BY ALL), {p}nw AS (SELECT label, sum(c) AS nw FROM {p}counts GROUP BY 1), {p}vocab AS (SELECT DISTINCT token FROM {p}counts),
{p}model AS (SELECT d.label, v.token, ln((coalesce(c, 0) + 1.0) / (nw + (SELECT count(*) FROM {p}vocab))) AS lp FROM {p}vocab v, {p}docs d LEFT JOIN {p}counts k ON k.label = d.label AND k.token = v.token JOIN {p}nw w ON w.label = d.label)"""


_HALVES = f"""even AS (SELECT * FROM words WHERE stmt_id % 2 = 0), odd AS (SELECT * FROM words WHERE stmt_id % 2 = 1), {_nb('even', 'e_')}, {_nb('odd', 'o_')},
sc AS (SELECT stmt_id, m.label, sum(m.lp) + any_value(p.lp) AS lp, count(*) AS matched FROM odd w JOIN e_model m USING (token) JOIN e_priors p ON p.label = m.label GROUP BY 1, 2
  UNION ALL SELECT stmt_id, m.label, sum(m.lp) + any_value(p.lp), count(*) FROM even w JOIN o_model m USING (token) JOIN o_priors p ON p.label = m.label GROUP BY 1, 2),
post AS (SELECT stmt_id, label, exp(lp - mx) / sum(exp(lp - mx)) OVER (PARTITION BY stmt_id) AS p, matched FROM (SELECT *, max(lp) OVER (PARTITION BY stmt_id) AS mx FROM sc)
  UNION ALL SELECT r.stmt_id, d.label, 1.0 / (SELECT count(*) FROM e_docs), 0 FROM rows_ r, e_docs d WHERE r.stmt_id % 2 = 1 AND r.stmt_id NOT IN (SELECT stmt_id FROM sc)
  UNION ALL SELECT r.stmt_id, d.label, 1.0 / (SELECT count(*) FROM o_docs), 0 FROM rows_ r, o_docs d WHERE r.stmt_id % 2 = 0 AND r.stmt_id NOT IN (SELECT stmt_id FROM sc))"""
_ENS = f"""{_SUB}, {_HALVES},
ens0 AS (SELECT r.stmt_id, x.label, round(least(1, greatest(0, CASE WHEN matched >= 2 THEN 0.55 * score + 0.45 * p WHEN matched = 1 THEN 0.75 * score + 0.25 * p ELSE score END)), 6) AS final
  FROM ruled r JOIN rows_ x USING (stmt_id) JOIN post ON post.stmt_id = r.stmt_id AND post.label = 'professional'),
ens AS (SELECT stmt_id, label, final, CASE WHEN final >= 0.7 THEN 'professional' WHEN final < 0.3 THEN 'personal' WHEN final < 0.5 THEN 'casual' ELSE 'uncertain' END AS category,
  round(least(1.0, greatest(0.0, CASE WHEN final >= 0.7 THEN final WHEN final < 0.3 THEN 1 - final WHEN final < 0.5 THEN 1 - abs(final - 0.4) / 0.15 ELSE 1 - abs(final - 0.6) / 0.2 END)), 6) AS confidence FROM ens0)"""
_act = lambda m, least: f"CASE WHEN category = 'professional' AND (confidence >= {least} OR '{m}' <> 'STRICT') THEN 'RETAIN' WHEN category = 'uncertain' AND '{m}' <> 'STRICT' THEN 'ASK_USER' ELSE 'DELETE' END"
_CONF = f"{_ENS}, conf AS (SELECT label AS truth, category AS guess, count(*) AS n FROM ens GROUP BY ALL)"
_IDF = f"{_ROWS}, idf AS (SELECT token, count(DISTINCT stmt_id) AS df, ln((1 + (SELECT count(DISTINCT stmt_id) FROM words)) / (1 + count(DISTINCT stmt_id))) + 1 AS idf FROM words GROUP BY 1)"
_TFIDF = f"{_IDF}, tf AS (SELECT stmt_id, token, (1 + ln(count(*))) * any_value(idf) AS w FROM words JOIN idf USING (token) GROUP BY 1, 2), wt AS (SELECT stmt_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY stmt_id)) AS weight FROM tf)"

_METRICS = f"""{_CONF}, labels AS (SELECT truth AS label FROM conf UNION SELECT guess FROM conf),
      t AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM conf WHERE truth = label)::BIGINT AS support, (SELECT coalesce(sum(n), 0) FROM conf WHERE guess = label) AS guessed, (SELECT coalesce(sum(n), 0) FROM conf WHERE truth = label AND guess = label) AS hits FROM labels),
      r AS (SELECT label, support, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS c FROM t),
      cm AS (SELECT label, round(p, 4) AS precision, round(c, 4) AS recall, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END, 4) AS f1, support FROM r)"""

QUERIES = {f.__name__: f for f in (agg_quality, rpt_metrics, flt_streams, flt_resolved, cls_subscores, cls_rule_score, cls_nb_model, cls_nb_predict, cls_ensemble, agg_confusion, agg_class_metrics, flt_privacy, agg_leakage, agg_idf, agg_tfidf, agg_word_weights, jn_jaccard)}
SQL = {
    "cls_subscores": f"WITH {_SUB} SELECT * FROM sub",
    "cls_rule_score": f"WITH {_SUB} SELECT stmt_id, round(score, 6) AS score FROM ruled",
    "cls_nb_model": f"WITH {_ROWS}, {_nb('words')} SELECT label, token, round(lp, 6) AS lp FROM model",
    "cls_nb_predict": f"WITH {_ROWS}, {_HALVES} SELECT stmt_id, label, round(p, 6) AS p, matched FROM post",
    "cls_ensemble": f"WITH {_ENS} SELECT * FROM ens",
    "agg_confusion": f"WITH {_CONF} SELECT * FROM conf",
    "agg_class_metrics": f"WITH {_METRICS} SELECT * FROM cm",
    "agg_quality": f"WITH {_METRICS} SELECT (SELECT round(sum(CASE WHEN truth = guess THEN n ELSE 0 END) / sum(n), 4) FROM conf) AS accuracy, (SELECT sum(n)::BIGINT FROM conf) AS samples, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM cm",
    "rpt_metrics": f"WITH {_METRICS} SELECT label, printf('%-15s P=%.4f R=%.4f F1=%.4f n=%d', label, precision::DOUBLE, recall::DOUBLE, f1::DOUBLE, support) AS line FROM cm",
    "flt_streams": f"WITH {_ENS}, a AS (SELECT stmt_id, category, confidence, {_act('BALANCED', 0.7)} AS action FROM ens) SELECT unnest(CASE action WHEN 'RETAIN' THEN ['kept', 'audit'] WHEN 'ASK_USER' THEN ['pending'] ELSE ['audit'] END) AS output, stmt_id, action, category, confidence FROM a",
    "flt_resolved": f"WITH {_ENS}, a AS (SELECT stmt_id, {_act('BALANCED', 0.7)} AS action FROM ens) SELECT CASE WHEN stmt_id % 2 <> 0 THEN 'pending' WHEN stmt_id % 4 = 0 THEN 'approved' ELSE 'refused' END AS fate, count(*) AS n FROM a WHERE action = 'ASK_USER' GROUP BY 1",
    "flt_privacy": f"WITH {_ENS} SELECT mode, category, action, count(*) AS n FROM (SELECT 'STRICT' AS mode, category, {_act('STRICT', 0.85)} AS action FROM ens UNION ALL SELECT 'BALANCED', category, {_act('BALANCED', 0.7)} FROM ens UNION ALL SELECT 'CUSTOM', category, {_act('CUSTOM', 0.7)} FROM ens) GROUP BY ALL",
    "agg_leakage": f"WITH {_ENS} SELECT mode, round(count(*) FILTER (action = 'RETAIN' AND label = 'casual') / count(*) FILTER (label = 'casual'), 6) AS leakage, round(count(*) FILTER (action = 'RETAIN' AND label = 'professional') / count(*) FILTER (label = 'professional'), 6) AS retention FROM (SELECT 'STRICT' AS mode, label, {_act('STRICT', 0.85)} AS action FROM ens UNION ALL SELECT 'BALANCED', label, {_act('BALANCED', 0.7)} FROM ens) GROUP BY 1",
    "agg_idf": f"WITH {_IDF} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "agg_tfidf": f"WITH {_TFIDF} SELECT stmt_id, arg_min(token, (-round(weight, 6), token)) AS token, max(round(weight, 6)) AS weight FROM wt GROUP BY 1",
    "agg_word_weights": f"WITH {_TFIDF} SELECT token, count(*) AS n, round(avg(weight), 6) AS weight FROM wt GROUP BY 1 HAVING count(*) >= 5 ORDER BY weight DESC, token LIMIT 45",
    "jn_jaccard": f"""SELECT stmt_id, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS jaccard FROM
      (SELECT stmt_id, list_distinct({_sql_tokens('e')}) AS a, list_distinct({_sql_tokens('c')}) AS b FROM (SELECT stmt_id, evidence AS e, clean_text AS c FROM (SELECT *, row_number() OVER (PARTITION BY stmt_id ORDER BY clean_text DESC, evidence DESC) AS rn FROM statements WHERE clean_text IS NOT NULL AND evidence IS NOT NULL) WHERE rn = 1))""",
}
