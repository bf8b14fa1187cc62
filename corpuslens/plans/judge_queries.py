"""Queries on verdicts: parsing answers, votes, debates, reflection, verification, repair, and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import code as C
from corpuslens.operators import evaluate as E
from corpuslens.operators import judge as J
from corpuslens.plans.catalogue import query
from corpuslens.plans.tables import ATTEMPTS, OPINIONS, RESPONSES, attempts, opinions, responses, samples, table, with_samples

_OBJECT = r"CASE WHEN kind = 3 THEN NULL ELSE regexp_extract(answer, '(?s)\{.*\}', 0) END"


@query("parse_judgements", f"WITH {RESPONSES}, o AS (SELECT *, {_OBJECT} AS obj FROM responses) SELECT sample_id, persona, obj IS NOT NULL AS parsed, coalesce(obj ->> '$.has_vulnerability' = 'true', false) AS has_vulnerability, obj ->> '$.vulnerability_type' AS vulnerability_type, CASE WHEN obj IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(TRY_CAST(obj ->> '$.confidence' AS DOUBLE), 0.5::DOUBLE))) END AS confidence FROM o")
def parse_judgements(spark, sf):
    return responses(spark, sf).select("sample_id", "persona", *(e.alias(n) for n, e in J.detection(F.col("answer")).items()))


_NAMED = "CASE " + " ".join(f"WHEN regexp_matches(upper(answer), '{c}([^0-9]|$)') THEN '{c}'" for c in C.TARGET_CLASSES) + " END"
_LIST = ", ".join(f"'{c}'" for c in C.TARGET_CLASSES)


@query("route_answers", f"WITH {RESPONSES}, o AS (SELECT *, {_OBJECT} AS obj FROM responses), r AS (SELECT sample_id, persona, obj, CASE WHEN obj IS NULL THEN coalesce({_NAMED}, 'OTHER') WHEN (obj ->> '$.primary') IN ({_LIST}) THEN obj ->> '$.primary' ELSE 'OTHER' END AS primary, CASE WHEN obj IS NULL THEN CASE WHEN {_NAMED} IS NOT NULL THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(TRY_CAST(obj ->> '$.confidence' AS DOUBLE), 0.5::DOUBLE))) END AS confidence FROM o) SELECT sample_id, persona, primary, confidence, obj IS NOT NULL AND confidence >= 0.6 AND primary <> 'OTHER' AS use_filter FROM r".replace(" AS primary", ' AS "primary"').replace(" primary,", ' "primary",').replace(" primary <>", ' "primary" <>'))
def route_answers(spark, sf):
    return responses(spark, sf).select("sample_id", "persona", *(e.alias(n) for n, e in J.route(F.col("answer")).items()))


_VOTE = """
{0}c AS (SELECT {1}, count_if(coalesce(has_vuln, false)) AS n_yes, count_if(NOT coalesce(has_vuln, false)) AS n_no, avg(CASE WHEN has_vuln THEN coalesce(confidence, 0.5) END) AS cy, avg(CASE WHEN NOT coalesce(has_vuln, false) THEN coalesce(confidence, 0.5) END) AS cn,
  arg_min(reason, persona) FILTER (WHERE has_vuln) AS ry, arg_min(reason, persona) FILTER (WHERE NOT coalesce(has_vuln, false)) AS rn FROM {2} GROUP BY ALL),
{0}k AS (SELECT {1}, cwe FROM (SELECT {1}, cwe, row_number() OVER (PARTITION BY {1} ORDER BY count(*) DESC, cwe) AS r FROM {2} WHERE has_vuln AND cwe IS NOT NULL GROUP BY {1}, cwe) WHERE r = 1),
{0}v AS (SELECT {1}, n_yes > n_no AS has_vulnerability, CASE WHEN n_yes > n_no THEN cwe END AS vulnerability_type, round(CASE WHEN n_yes > n_no THEN cy ELSE cn END * (greatest(n_yes, n_no) / (n_yes + n_no)), 4) AS confidence, CASE WHEN n_yes > n_no THEN ry ELSE rn END AS reason, n_yes, n_no, round(greatest(n_yes, n_no) / (n_yes + n_no), 4) AS agreement FROM {0}c LEFT JOIN {0}k USING ({1}))"""
_MAJORITY = f"{OPINIONS}, {_VOTE.format('m', 'sample_id', 'opinions')}"


@query("majority_vote", f"WITH {_MAJORITY} SELECT * FROM mv")
def majority_vote(spark, sf):
    return J.vote(opinions(spark, sf), ["sample_id"])


@query("persona_fanout_vote", f"WITH {OPINIONS}, fan AS (SELECT sample_id, p.persona, (('0x' || left(md5(sample_id), 8))::UBIGINT * (p.persona + 1)) % 7 < 3 AS has_vuln, confidence, cwe, reason FROM opinions CROSS JOIN (VALUES (0), (1), (2)) p(persona) WHERE opinions.persona = 'full'), {_VOTE.format('f', 'sample_id', 'fan')} SELECT * FROM fv")
def persona_fanout_vote(spark, sf):
    base = opinions(spark, sf).where("persona = 'full'").drop("persona", "has_vuln")
    h = F.conv(F.left(F.md5("sample_id"), F.lit(8)), 16, 10).cast("bigint")
    fan = base.withColumn("persona", F.explode(F.array(*(F.lit(i) for i in range(3))))).withColumn("has_vuln", (h * (F.col("persona") + 1)) % 7 < 3)
    return J.vote(fan, ["sample_id"])


_ROUNDS = f"{OPINIONS}, ro AS (SELECT *, ('0x' || left(md5(persona || sample_id), 8))::UBIGINT % 4 + 1 AS round FROM opinions), {_VOTE.format('d', 'sample_id, round', '(SELECT * FROM ro WHERE round <= 3)')}"


@query("debate_last_round", f"WITH {_ROUNDS}, l AS (SELECT sample_id, coalesce(min(CASE WHEN round >= 2 AND agreement >= 0.99 THEN round END), max(round))::INTEGER AS debate_rounds FROM dv GROUP BY sample_id) SELECT dv.* EXCLUDE (round), debate_rounds FROM dv JOIN l ON l.sample_id = dv.sample_id AND dv.round = l.debate_rounds")
def debate_last_round(spark, sf):
    r = (F.conv(F.left(F.md5(F.concat("persona", "sample_id")), F.lit(8)), 16, 10).cast("bigint") % 4 + 1).cast("int")
    return J.debate(opinions(spark, sf).withColumn("round", r), ["sample_id"])


_REFLECT = "CASE ('0x' || left(md5('r' || sample_id), 8))::UBIGINT % 4 WHEN 0 THEN 'reject' WHEN 1 THEN 'revise' WHEN 2 THEN 'confirm' END"


@query("reflect_adjust", f"WITH {_MAJORITY}, x AS (SELECT *, {_REFLECT} AS decision, length(sample_id) % 10 / 10 AS revised FROM mv), y AS (SELECT *, NOT has_vulnerability OR confidence >= 0.85 OR decision IS NULL AS skip FROM x) SELECT sample_id, NOT skip AS applied, CASE WHEN skip THEN has_vulnerability ELSE decision <> 'reject' END AS has_vulnerability, CASE WHEN skip THEN confidence WHEN decision = 'reject' THEN revised WHEN decision = 'revise' THEN least(revised, confidence) ELSE greatest(confidence, revised) END AS confidence FROM y")
def reflect_adjust(spark, sf):
    k = (F.conv(F.left(F.md5(F.concat(F.lit("r"), "sample_id")), F.lit(8)), 16, 10).cast("bigint") % 4).cast("int")
    decision = F.when(k == 0, "reject").when(k == 1, "revise").when(k == 2, "confirm")
    v = J.vote(opinions(spark, sf), ["sample_id"])
    return v.select("sample_id", *(e.alias(n) for n, e in J.reflect(F.col("has_vulnerability"), F.col("confidence"), decision, F.length("sample_id") % 10 / 10).items()))


_VERIFY = f"""{ATTEMPTS}, st AS (SELECT *, CASE WHEN compile_failed THEN 'unverifiable' WHEN evidence THEN 'confirmed' WHEN timed_out THEN 'timeout' WHEN exit_code <> 0 THEN 'exit' ELSE 'not_reproduced' END AS s FROM attempts WHERE attempt <= 3),
ve AS (SELECT user_id, hour, coalesce(arg_min(s, attempt) FILTER (WHERE s IN ('confirmed', 'timeout', 'exit')), arg_max(s, attempt)) AS s, coalesce(min(attempt) FILTER (WHERE s IN ('confirmed', 'timeout', 'exit')), max(attempt)) AS attempts FROM st GROUP BY ALL),
verified AS (SELECT user_id, hour, CASE WHEN s IN ('timeout', 'exit') THEN 'suspected' ELSE s END AS verified, CASE s WHEN 'unverifiable' THEN 0.3::DOUBLE WHEN 'confirmed' THEN 0.95::DOUBLE WHEN 'timeout' THEN 0.5::DOUBLE WHEN 'exit' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS verify_confidence, attempts FROM ve)"""


@query("verify_first_terminal", f"WITH {_VERIFY} SELECT * FROM verified")
def verify_first_terminal(spark, sf):
    return J.verify(attempts(spark, sf), ["user_id", "hour"], "attempt")


@query("finalize_verdict", f"WITH {_VERIFY}, x AS (SELECT *, user_id % 3 <> 0 AS has, round(user_id % 10 / 10, 1) AS confidence FROM verified) SELECT user_id, hour, CASE verified WHEN 'confirmed' THEN 'vulnerable_verified' WHEN 'not_reproduced' THEN 'vulnerable_unverified' WHEN 'unverifiable' THEN 'vulnerable_unverifiable' ELSE CASE WHEN has THEN 'vulnerable' ELSE 'clean' END END AS final_label, CASE verified WHEN 'confirmed' THEN greatest(confidence, verify_confidence) WHEN 'not_reproduced' THEN confidence * 0.5::DOUBLE ELSE confidence END AS final_confidence, coalesce(verified, 'not_run') AS verification_status FROM x")
def finalize_verdict(spark, sf):
    x = J.verify(attempts(spark, sf), ["user_id", "hour"], "attempt")
    out = J.finalise(F.col("user_id") % 3 != 0, F.round(F.col("user_id") % 10 / 10, 1), F.col("verified"), F.col("verify_confidence"))
    return x.select("user_id", "hour", *(e.alias(n) for n, e in out.items()))


# ---- repair -----------------------------------------------------------------------------------------


def _rounds(spark, sf):
    a = attempts(spark, sf)
    return a.select("user_id", "hour", F.col("attempt").alias("round"), (~F.col("compile_failed")).alias("compiled"), F.col("evidence").alias("still_vulnerable"), (F.col("event_type") != "purchase").alias("approved"), (F.col("value") % 1).alias("similarity"))


_ROUND = f"""{ATTEMPTS}, rr AS (SELECT user_id, hour, attempt AS round, NOT compile_failed AS compiled, evidence AS still_vulnerable, event_type <> 'purchase' AS approved, NOT compile_failed AND NOT evidence AND event_type <> 'purchase' AS good FROM attempts WHERE attempt <= 3),
lr AS (SELECT *, row_number() OVER (PARTITION BY user_id, hour ORDER BY good DESC, CASE WHEN good THEN round ELSE -round END) AS k, bool_or(good) OVER (PARTITION BY user_id, hour) AS fixed FROM rr),
repaired AS (SELECT user_id, hour, round AS rounds_used, fixed, compiled, still_vulnerable, approved, CASE WHEN NOT approved THEN 'debate_rejected' WHEN NOT compiled THEN 'compilation_failed' WHEN still_vulnerable THEN 'unverified' ELSE 'verified_fixed' END AS status FROM lr WHERE k = 1)"""


@query("repair_rounds", f"WITH {_ROUND} SELECT * FROM repaired")
def repair_rounds(spark, sf):
    return J.repair_rounds(_rounds(spark, sf), ["user_id", "hour"], "round")


@query("repair_summary", f"WITH {_ROUND} SELECT status, count(*) AS total, round(avg(compiled::INT), 6) AS compiled_rate, round(avg(fixed::INT), 6) AS fixed_rate, round(avg(approved::INT), 6) AS approved_rate, round(avg(user_id % 10 / 10), 6) AS avg_similarity FROM repaired GROUP BY status")
def repair_summary(spark, sf):
    x = J.repair_rounds(_rounds(spark, sf), ["user_id", "hour"], "round").withColumn("similarity", F.col("user_id") % 10 / 10)
    return E.repair_summary(x, "status")


@query("self_check_all", f"WITH {ATTEMPTS} SELECT user_id, hour, bool_and(coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE event_type <> 'error' END, false)) AS all_passed, count(*) AS roles FROM attempts WHERE attempt <= 3 GROUP BY ALL")
def self_check_all(spark, sf):
    a = attempts(spark, sf).where("attempt <= 3").withColumn("passed", F.when(F.col("event_type") != "view", F.col("event_type") != "error"))
    return J.self_check(a, ["user_id", "hour"])


@query("repair_gate", f"WITH {ATTEMPTS}, g AS (SELECT user_id, hour, max(CASE WHEN attempt = 1 THEN event_type END) AS attack, max(CASE WHEN attempt = 2 THEN event_type END) AS defence, max(CASE WHEN attempt = 3 THEN CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'approved' END END) AS verdict FROM attempts GROUP BY ALL) SELECT user_id, hour, attack IS NULL OR defence IS NULL OR coalesce(verdict, 'approved') <> 'rejected' AS approved FROM g")
def repair_gate(spark, sf):
    at = lambda i, v=F.col("event_type"): F.max(F.when(F.col("attempt") == i, v))
    g = attempts(spark, sf).groupBy("user_id", "hour").agg(at(1).alias("attack"), at(2).alias("defence"), at(3, F.when(F.col("event_type") == "error", "rejected").otherwise("approved")).alias("verdict"))
    return g.select("user_id", "hour", J.gate(F.col("attack"), F.col("defence"), F.col("verdict")).alias("approved"))


@query("repair_confidence", f"WITH {OPINIONS} SELECT sample_id, persona, round(0.4::DOUBLE * coalesce(confidence, 0.7) + 0.3::DOUBLE * coalesce(nullif(elapsed % 1, 0), 0.7) + 0.2::DOUBLE * CASE WHEN has_vuln THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END + 0.1::DOUBLE, 3) AS confidence FROM opinions")
def repair_confidence(spark, sf):
    return opinions(spark, sf).select("sample_id", "persona", J.repair_confidence(F.col("confidence"), F.nullif(F.col("elapsed") % 1, F.lit(0.0)), F.coalesce("has_vuln", F.lit(False))).alias("confidence"))


@query("plan_steps_collect", f"WITH {ATTEMPTS} SELECT user_id, hour, count(*) AS steps, string_agg(attempt || ':' || event_type, ',' ORDER BY attempt) AS plan FROM attempts WHERE attempt <= 3 GROUP BY ALL")
def plan_steps_collect(spark, sf):
    """Up to three steps in their order; the group is bounded before it is collected."""
    x = attempts(spark, sf).where("attempt <= 3").groupBy("user_id", "hour").agg(F.count("*").alias("steps"), F.sort_array(F.collect_list(F.struct("attempt", "event_type"))).alias("s"))
    return x.select("user_id", "hour", "steps", F.array_join(F.transform("s", lambda r: F.concat(r["attempt"].cast("string"), F.lit(":"), r["event_type"])), ",").alias("plan"))


# ---- scores -------------------------------------------------------------------------------------------

_CONF = """cm AS (SELECT {0}, count_if(t AND p) AS tp, count_if(NOT t AND p) AS fp, count_if(NOT t AND NOT p) AS tn, count_if(t AND NOT p) AS fn FROM ({1}) WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY ALL),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END AS pp, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END AS rr FROM cm),
scores AS (SELECT {0}, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy, round(pp, 4) AS "precision", round(rr, 4) AS recall, round(CASE WHEN pp + rr = 0 THEN 0.0::DOUBLE ELSE 2 * pp * rr / (pp + rr) END, 4) AS f1 FROM pr)"""


@query("confusion_metrics", f"WITH {OPINIONS}, {_CONF.format('persona', 'SELECT persona, true_label = 1 AS t, has_vuln AS p FROM opinions')} SELECT * FROM scores")
def confusion_metrics(spark, sf):
    return E.confusion(opinions(spark, sf), "true_label", F.col("has_vuln"), "persona")


@query("recall_by_class", f"WITH {OPINIONS} SELECT coalesce(nullif(trim(true_cwe), ''), 'unknown') AS cwe, count(*) AS total, count_if(has_vuln) AS found, round(count_if(has_vuln) / count(*), 4) AS recall FROM opinions WHERE true_label = 1 AND has_vuln IS NOT NULL GROUP BY ALL")
def recall_by_class(spark, sf):
    return E.recall_by_class(opinions(spark, sf), "true_label", F.col("has_vuln"), "true_cwe")


_THRESH = "SELECT th AS threshold, true_label = 1 AS t, raw_predicted_vuln AND confidence >= th AS p FROM opinions CROSS JOIN (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) v(th)"


@query("ablation_delta", f"WITH {OPINIONS}, {_CONF.format('threshold', _THRESH)} SELECT *, round(f1 - lag(f1) OVER (ORDER BY threshold), 4) AS delta FROM scores")
def ablation_delta(spark, sf):
    x = opinions(spark, sf).withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in (0.0, 0.25, 0.5, 0.75)))))
    return E.deltas(E.confusion(x, "true_label", F.col("raw_predicted_vuln") & (F.col("confidence") >= F.col("threshold")), "threshold"), "threshold", "f1")


@query("best_configuration", f"WITH {OPINIONS}, {_CONF.format('persona', 'SELECT persona, true_label = 1 AS t, has_vuln AS p FROM opinions')} SELECT arg_max(persona, f1) AS by_f1, arg_max(persona, \"precision\") AS by_precision, arg_max(persona, recall) AS by_recall FROM (SELECT * FROM scores ORDER BY persona)")
def best_configuration(spark, sf):
    s = E.confusion(opinions(spark, sf), "true_label", F.col("has_vuln"), "persona")
    # ties go to the first name
    best = lambda c: F.min_by("persona", F.struct(-F.col(c), F.col("persona")))
    return s.agg(best("f1").alias("by_f1"), best("precision").alias("by_precision"), best("recall").alias("by_recall"))


@query("e2e_summary", f"WITH {OPINIONS} SELECT persona, count(*) AS total, count_if(raw_predicted_vuln AND confidence >= 0.5) AS detected, count_if(verification_status = 'confirmed') AS confirmed, round(coalesce(count_if(verification_status = 'confirmed') / nullif(count_if(raw_predicted_vuln AND confidence >= 0.5), 0), 0), 6) AS confirmed_rate, round(avg(elapsed), 6) AS avg_elapsed FROM opinions GROUP BY persona")
def e2e_summary(spark, sf):
    found, ok = F.count_if(F.col("raw_predicted_vuln") & (F.col("confidence") >= 0.5)), F.count_if(F.col("verification_status") == "confirmed")
    return opinions(spark, sf).groupBy("persona").agg(F.count("*").alias("total"), found.alias("detected"), ok.alias("confirmed"), F.round(F.coalesce(F.try_divide(ok, found), F.lit(0.0)), 6).alias("confirmed_rate"), F.round(F.avg("elapsed"), 6).alias("avg_elapsed"))


_TEMPLATES = [("CWE-119", "bounds"), ("CWE-476", "null"), ("CWE-401", "release"), ("CWE-362", "locking"), ("CWE-416", "lifetime"), ("CWE-190", "range"), ("CWE-134", "format"), ("CWE-78", "command")]


@query("template_lookup", with_samples(", t(cls, template) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TEMPLATES) + ") SELECT coalesce(template, 'generic') AS template, count(*) AS n FROM samples LEFT JOIN t ON t.cls = regexp_extract(cwe, 'CWE-[0-9]+') GROUP BY ALL"))
def template_lookup(spark, sf):
    dim = spark.createDataFrame(_TEMPLATES, "cls string, template string")
    x = samples(spark, sf).withColumn("cls", F.regexp_extract("cwe", "CWE-[0-9]+", 0)).join(F.broadcast(dim), "cls", "left")  # eight rows
    return x.groupBy(F.coalesce("template", F.lit("generic")).alias("template")).agg(F.count("*").alias("n"))


@query("failed_runs", "SELECT run_config, count(*) AS runs, count_if(error IS NOT NULL) AS failed, count_if(coalesce(predicted_vuln, false)) AS positive, round(avg(coalesce(confidence, 0.0)), 6) AS confidence FROM predictions GROUP BY run_config")
def failed_runs(spark, sf):
    """Failed runs count as negative with confidence 0."""
    return table(spark, sf, "predictions").groupBy("run_config").agg(F.count("*").alias("runs"), F.count("error").alias("failed"), F.count_if(F.coalesce("predicted_vuln", F.lit(False))).alias("positive"), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("confidence"))
