"""Reduction of model judgements to verdicts: parsing, votes, debates, reflection, verification, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import code as C
from corpuslens.functions import text as T

#: Fixed values of the rules.
FILTER_FROM, ROUTE_FALLBACK, ROUTE_ELSE = 0.6, 0.4, 0.3
REFLECT_BELOW = 0.85
VERDICTS = {"unverifiable": 0.3, "confirmed": 0.95, "timeout": 0.5, "exit": 0.6, "not_reproduced": 0.4}
REPAIR_WEIGHTS = (0.4, 0.3, 0.2, 0.1)


def _get(obj: Column, key: str) -> Column:
    return F.get_json_object(obj, f"$.{key}")


def _confidence(obj: Column, key: str = "confidence", default: float = 0.5) -> Column:
    return T.clamp(F.coalesce(_get(obj, key).try_cast("double"), F.lit(default)))


def detection(answer: Column) -> dict[str, Column]:
    """Fields of a detector's answer; an answer without a JSON object is clean with confidence 0."""
    obj = T.json_object(answer)
    failed = obj.isNull()
    return {
        "parsed": ~failed,
        "has_vulnerability": F.coalesce(_get(obj, "has_vulnerability") == "true", F.lit(False)),
        "vulnerability_type": F.nullif(_get(obj, "vulnerability_type"), F.lit("null")),
        "confidence": F.when(failed, 0.0).otherwise(_confidence(obj)),
    }


def route(answer: Column) -> dict[str, Column]:
    """primary class, confidence and use_filter of a router's answer; free text is searched for a class name."""
    obj = T.json_object(answer)
    named = _get(obj, "primary")
    primary = F.when(obj.isNull(), F.coalesce(C.named_class(answer), F.lit("OTHER"))).when(named.isin(*C.TARGET_CLASSES), named).otherwise("OTHER")
    confidence = F.when(obj.isNull(), F.when(C.named_class(answer).isNotNull(), ROUTE_FALLBACK).otherwise(ROUTE_ELSE)).otherwise(_confidence(obj))
    return {"primary": primary, "confidence": confidence, "use_filter": obj.isNotNull() & (confidence >= FILTER_FROM) & (primary != "OTHER")}


def vote(opinions: DataFrame, by: list[str], persona: str = "persona") -> DataFrame:
    """Majority verdict per group of opinions (has_vuln, confidence, cwe, reason, persona).

    More yes than no votes are needed; a null vote is a no.  The confidence is
    the winning side's mean times the agreement, the class is the most frequent
    one among the yes votes (ties: the smallest), the reason is the winning
    side's first by persona.  Counted by partial aggregation; the class votes
    are counted per class first, so no list of opinions is gathered.
    """
    yes = F.coalesce(F.col("has_vuln"), F.lit(False))
    conf = F.coalesce(F.col("confidence"), F.lit(0.5))
    counts = opinions.groupBy(*by).agg(
        F.count_if(yes).alias("n_yes"),
        F.count_if(~yes).alias("n_no"),
        F.avg(F.when(yes, conf)).alias("_yes"),
        F.avg(F.when(~yes, conf)).alias("_no"),
        F.min_by(F.when(yes, F.col("reason")), F.when(yes, F.col(persona))).alias("_ry"),
        F.min_by(F.when(~yes, F.col("reason")), F.when(~yes, F.col(persona))).alias("_rn"),
    )
    classes = opinions.where(yes & F.col("cwe").isNotNull()).groupBy(*by, "cwe").agg(F.count("*").alias("_n"))
    top = classes.groupBy(*by).agg(F.min_by("cwe", F.struct(-F.col("_n"), F.col("cwe"))).alias("_cwe"))
    won = F.col("n_yes") > F.col("n_no")
    agreement = F.greatest("n_yes", "n_no") / (F.col("n_yes") + F.col("n_no"))
    return counts.join(top, by, "left").select(
        *by,
        won.alias("has_vulnerability"),
        F.when(won, F.col("_cwe")).alias("vulnerability_type"),
        F.round(F.when(won, F.col("_yes")).otherwise(F.col("_no")) * agreement, 4).alias("confidence"),
        F.when(won, F.col("_ry")).otherwise(F.col("_rn")).alias("reason"),
        "n_yes",
        "n_no",
        F.round(agreement, 4).alias("agreement"),
    )


def debate(opinions: DataFrame, by: list[str], round_: str = "round", most: int = 3, consensus: float = 0.99) -> DataFrame:
    """Verdict of the last round held: the first from round 2 on with consensus, else the last of at most `most`."""
    rounds = vote(opinions.where(F.col(round_) <= most), [*by, round_])
    ended = F.when((F.col(round_) >= 2) & (F.col("agreement") >= consensus), F.col(round_))
    last = rounds.groupBy(*by).agg(F.coalesce(F.min(ended), F.max(round_)).alias("debate_rounds"))
    return rounds.join(last, by).where(F.col(round_) == F.col("debate_rounds")).drop(round_)


def reflect(has: Column, confidence: Column, decision: Column, revised: Column) -> dict[str, Column]:
    """A verdict after reflection; clean and confident ones are left as they are."""
    skip = ~has | (confidence >= REFLECT_BELOW) | decision.isNull()
    conf = F.when(decision == "reject", F.coalesce(revised, F.lit(0.2))).when(decision == "revise", F.least(F.coalesce(revised, confidence * 0.6), confidence)).otherwise(F.greatest(confidence, F.coalesce(revised, confidence)))
    return {"applied": ~skip, "has_vulnerability": F.when(skip, has).otherwise(has & (decision != "reject")), "confidence": F.when(skip, confidence).otherwise(conf)}


def verify(attempts: DataFrame, by: list[str], order: str, most: int = 3) -> DataFrame:
    """Verdict of verification attempts (compile_failed, evidence, timed_out, exit_code), the first that decides.

    A failed compilation is retried; if the last attempt fails so, it is
    unverifiable.  An attempt that ran without a sign decides nothing.
    """
    state = F.when(F.col("compile_failed"), "unverifiable").when(F.col("evidence"), "confirmed").when(F.col("timed_out"), "timeout").when(F.col("exit_code") != 0, "exit").otherwise("not_reproduced")
    x = attempts.where(F.col(order) <= most).withColumn("_s", state)
    decides = F.col("_s").isin("confirmed", "timeout", "exit")
    x = x.groupBy(*by).agg(F.min_by(F.when(decides, F.col("_s")), F.when(decides, F.col(order))).alias("_d"), F.min(F.when(decides, F.col(order))).alias("_a"), F.max_by("_s", order).alias("_l"), F.max(order).alias("_n"))
    s = F.coalesce("_d", "_l")
    conf = F.coalesce(*(F.when(s == k, F.lit(v)) for k, v in VERDICTS.items()))
    return x.select(*by, F.when(s.isin("timeout", "exit"), "suspected").otherwise(s).alias("verified"), conf.alias("verify_confidence"), F.coalesce("_a", "_n").alias("attempts"))


def finalise(has: Column, confidence: Column, verified: Column, verify_confidence: Column) -> dict[str, Column]:
    """Label and confidence after verification."""
    label = F.when(verified == "confirmed", "vulnerable_verified").when(verified == "not_reproduced", "vulnerable_unverified").when(verified == "unverifiable", "vulnerable_unverifiable").when(has, "vulnerable").otherwise("clean")
    conf = F.when(verified == "confirmed", F.greatest(confidence, verify_confidence)).when(verified == "not_reproduced", confidence * 0.5).otherwise(confidence)
    return {"final_label": label, "final_confidence": conf, "verification_status": F.coalesce(verified, F.lit("not_run"))}


def self_check(checks: DataFrame, by: list[str]) -> DataFrame:
    """Whether all roles passed; a missing answer is not passed."""
    return checks.groupBy(*by).agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("all_passed"), F.count("*").alias("roles"))


def repair_rounds(rounds: DataFrame, by: list[str], order: str, most: int = 3) -> DataFrame:
    """Outcome of repair rounds (compiled, still_vulnerable, approved): the first success, else the last round."""
    good = F.col("compiled") & ~F.col("still_vulnerable") & F.col("approved")
    x = rounds.where(F.col(order) <= most).withColumn("_g", good)
    at = F.when(F.col("_g"), F.col(order))
    out = x.groupBy(*by).agg(F.coalesce(F.min(at), F.max(order)).alias("rounds_used"), F.bool_or("_g").alias("fixed"), F.max_by("compiled", F.struct(F.col("_g"), F.when(F.col("_g"), -F.col(order)).otherwise(F.col(order)))).alias("compiled"), F.max_by("still_vulnerable", F.struct(F.col("_g"), F.when(F.col("_g"), -F.col(order)).otherwise(F.col(order)))).alias("still_vulnerable"), F.max_by("approved", F.struct(F.col("_g"), F.when(F.col("_g"), -F.col(order)).otherwise(F.col(order)))).alias("approved"))
    status = F.when(~F.col("approved"), "debate_rejected").when(~F.col("compiled"), "compilation_failed").when(F.col("still_vulnerable"), "unverified").otherwise("verified_fixed")
    return out.withColumn("status", status)


def repair_confidence(base: Column, debate_: Column, passed: Column) -> Column:
    a, b, c, d = REPAIR_WEIGHTS
    return F.round(a * F.coalesce(base, F.lit(0.7)) + b * F.coalesce(debate_, F.lit(0.7)) + c * F.when(passed, 1.0).otherwise(0.5) + d, 3)


def gate(attack: Column, defence: Column, verdict: Column) -> Column:
    """Approval by a judge; a missing answer of any role falls back to approval."""
    return attack.isNull() | defence.isNull() | (F.coalesce(verdict, F.lit("approved")) != "rejected")
