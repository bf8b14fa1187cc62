"""Queries on the structure of snippets, commits, knowledge answers, builds, analyser findings and reranking by scorers and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import code as C
from corpuslens.functions import text as T
from corpuslens.operators import diff
from corpuslens.operators import evaluate as E
from corpuslens.operators import model as M
from corpuslens.operators import retrieval as R
from corpuslens.plans.catalogue import query
from corpuslens.plans.corpus_queries import _CODE, _MARK, _RISK, _SIGNALS, _STRIP, coded, patches
from corpuslens.plans.retrieval_queries import _BM25, _with_texts, lexical
from corpuslens.plans.stats_queries import _API, _COMPLEX, model_input
from corpuslens.plans.tables import OPINIONS, opinions, table, with_samples
from corpuslens.sources import files

# ---- structure of snippets ---------------------------------------------------------------------------

_S = C.STRUCTURE_LINES
_ANY = lambda words: "(" + " OR ".join(f"contains(code, '{w}')" for w in words) + ")"
_STRUCTURE = f""", c AS ({_CODE}), k AS (SELECT sample_id, code, ({_SIGNALS}) >= 2 AS py, regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1) AS calls,
  list_filter(list_transform(string_split(regexp_extract(code, '\\(([^)]{{0,200}})\\)', 1), ','), lambda p: {_STRIP.format('p')}), lambda p: p <> '') AS given FROM c),
s AS (SELECT *, CASE WHEN py THEN flatten(list_transform(calls, lambda c: {_RISK(C.RISKY_PYTHON)})) ELSE flatten(list_transform(calls, lambda c: {_RISK(C.RISKY_C)})) END AS risky, concat_ws(', ', CASE WHEN {_ANY(C.NULL_CHECKS)} THEN '{_S['null']}' END, CASE WHEN {_ANY(C.BOUNDS_CHECKS)} THEN '{_S['bounds']}' END) AS guards FROM k)"""


@query("structure_text", with_samples(_STRUCTURE + f""" SELECT sample_id, concat_ws(chr(10), '{_S['head']}', CASE WHEN len(risky) > 0 THEN '{_S['risky']}' || chr(10) || array_to_string(list_transform(risky[1:5], lambda x: '  - ' || split_part(x, '>', 1) || '() → risk: ' || split_part(x, '>', 2)), chr(10)) ELSE '{_S['none']}' END,
  CASE WHEN len(given) > 0 THEN '{_S['parameters']}' || array_to_string(given[1:3], ', ') END, '{_S['guards']}' || CASE WHEN guards = '' THEN '{_S['no_guards']}' ELSE guards END, '{_S['loc']}' || len(string_split(code, chr(10))), '{_S['end']}') AS text FROM s"""))
def structure_text(spark, sf):
    """The text on a snippet's structure that precedes it in a prompt."""
    return coded(spark, sf).select("sample_id", C.structure_text(F.col("code"), C.language_guess(F.col("code"))).alias("text"))


@query("structure_verdict", with_samples(_STRUCTURE + "," + OPINIONS + f" SELECT sample_id, persona, has_vuln, len(risky) AS risky_calls, {_ANY(C.NULL_CHECKS)} AS null_check, {_ANY(C.BOUNDS_CHECKS)} AS bounds_check, 'regex' AS parse_method FROM s JOIN opinions USING (sample_id)"))
def structure_verdict(spark, sf):
    """Verdicts with the structure of the snippet they are on."""
    x = F.col("code")
    facts = coded(spark, sf).select("sample_id", F.size(C.risky_calls(x, C.language_guess(x))).alias("risky_calls"), C.any_of(x, C.NULL_CHECKS).alias("null_check"), C.any_of(x, C.BOUNDS_CHECKS).alias("bounds_check"), F.lit("regex").alias("parse_method"))
    return opinions(spark, sf).select("sample_id", "persona", "has_vuln").join(facts, "sample_id")


# ---- commits and patches -------------------------------------------------------------------------------

_SECURITY = "NOT (" + " OR ".join(f"contains(lower(commit_message), '{w}')" for w in C.NOISE_WORDS) + ") AND (" + " OR ".join(f"contains(lower(commit_message), '{w}')" for w in C.SECURITY_WORDS) + ")"
DENIED = ("unknown",)


@query("commit_unnest", f"WITH f AS (SELECT DISTINCT repo, sample_id AS sha, CASE WHEN label = 1 THEN 'Security fix: ' || coalesce(commit_message, '') ELSE commit_message END AS commit_message, unnest([{{'name': file_path, 'patch': vulnerable_code}}, {{'name': 'notes.md', 'patch': fixed_code}}]) AS f FROM test_v2 WHERE sample_id IS NOT NULL AND repo IS NOT NULL AND repo NOT IN ('unknown')), g AS (SELECT repo, sha, f.name AS filename, CASE WHEN regexp_matches(lower(f.name), '\\.(c|cpp|cc|cxx|h|hpp)$') THEN 'C++' WHEN regexp_matches(lower(f.name), '\\.py$') THEN 'Python' END AS language, f.patch AS patch FROM f WHERE {_SECURITY}) SELECT repo, sha, filename, language, md5(patch) AS patch_md5 FROM g WHERE language IS NOT NULL AND patch <> ''")
def commit_unnest(spark, sf):
    """Commits as a service gives them, nested, to one row per source file of those on a security fix."""
    t = table(spark, sf, "test_v2").where("sample_id is not null and repo is not null")
    file = lambda name, patch: F.struct(name.alias("filename"), F.col(patch).alias("patch"))
    nested = t.select("repo", F.col("sample_id").alias("sha"), F.struct(F.when(F.col("label") == 1, F.concat(F.lit("Security fix: "), F.coalesce("commit_message", F.lit("")))).otherwise(F.col("commit_message")).alias("message")).alias("commit"), F.array(file(F.col("file_path"), "vulnerable_code"), file(F.lit("notes.md"), "fixed_code")).alias("files"))
    return diff.commit_files(nested, DENIED).select("repo", "sha", "filename", "language", F.md5("patch").alias("patch_md5"))


def _whole_side(drop: str, take: str) -> str:
    other = f"(starts_with(l, '{drop}') AND NOT starts_with(l, '{drop * 3}'))"
    own = f"(starts_with(l, '{take}') AND NOT starts_with(l, '{take * 3}'))"
    return _STRIP.format(f"array_to_string(list_transform(list_filter(string_split(patch, chr(10)), lambda l: NOT starts_with(l, '@@') AND NOT {other}), lambda l: CASE WHEN {own} OR starts_with(l, ' ') THEN substr(l, 2) ELSE l END), chr(10))")


@query("patch_sides", with_samples(f", p AS (SELECT sample_id, '@@ -1 +1 @@' || chr(10) || {_MARK.format('code')} || coalesce(chr(10) || '@@ -9 +9 @@' || chr(10) || {_MARK.format('fixed_code')}, '') AS patch FROM samples WHERE code IS NOT NULL) SELECT sample_id, md5({_whole_side('+', '-')}) AS before_md5, md5({_whole_side('-', '+')}) AS after_md5 FROM p"))
def patch_sides(spark, sf):
    """Both sides of whole patches."""
    before, after = diff.patch_sides(F.col("patch"))
    return patches(spark, sf).select("sample_id", F.md5(before).alias("before_md5"), F.md5(after).alias("after_md5"))


# ---- answers, builds and findings ----------------------------------------------------------------------

_KIND = "('0x' || left(md5(sample_id || persona), 8))::UBIGINT % 4"
_FACETS = f""", a AS (SELECT sample_id, persona, {_KIND} AS kind, '{{"functional_semantics": " reads ' || coalesce(cwe, 'none') || ' ", "root_cause": ' || CASE WHEN {_KIND} = 2 THEN '3' ELSE '"no check"' END || ', "trigger_condition": "' || CASE WHEN {_KIND} = 3 THEN '  ' ELSE 'input of ' || persona END || '", "fix_pattern": "check first"}}' AS body FROM opinions)
SELECT sample_id, persona, """ + ", ".join(f"trim(json_extract_string(body, '$.{f}')) AS {f}" for f in T.FACETS) + " FROM a WHERE " + " AND ".join(f"json_type(body, '$.{f}') = 'VARCHAR' AND trim(json_extract_string(body, '$.{f}')) <> ''" for f in T.FACETS)


@query("knowledge_facets", f"WITH {OPINIONS}{_FACETS}")
def knowledge_facets(spark, sf):
    """Answers on the knowledge behind a finding: those with four facets that are filled texts, in whatever wrapping."""
    o = opinions(spark, sf)
    kind = (F.conv(F.left(F.md5(F.concat("sample_id", "persona")), F.lit(8)), 16, 10).cast("bigint") % 4).cast("int")
    body = F.concat(F.lit('{"functional_semantics": " reads '), F.coalesce("cwe", F.lit("none")), F.lit(' ", "root_cause": '), F.when(kind == 2, "3").otherwise('"no check"'), F.lit(', "trigger_condition": "'), F.when(kind == 3, "  ").otherwise(F.concat(F.lit("input of "), F.col("persona"))), F.lit('", "fix_pattern": "check first"}'))
    answer = F.when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.length("persona") % 2 == 0, F.concat(F.lit("Here: "), body, F.lit(" done."))).otherwise(body)
    x = o.select("sample_id", "persona", T.knowledge_facets(answer).alias("k")).where("k is not null")
    return x.select("sample_id", "persona", "k.*")


_LOG = "CASE event_type WHEN 'error' THEN 'a.c:1: error: x' WHEN 'click' THEN 'AddressSanitizer error: y' WHEN 'purchase' THEN 'error: z' ELSE '' END"


@query("compile_failures", f"SELECT event_id, contains({_LOG}, 'error:') AND CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END <> 0 AND NOT contains({_LOG}, 'AddressSanitizer') AS failed FROM events")
def compile_failures(spark, sf):
    t = F.col("event_type")
    log = F.when(t == "error", "a.c:1: error: x").when(t == "click", "AddressSanitizer error: y").when(t == "purchase", "error: z").otherwise("")
    return table(spark, sf, "events").select("event_id", C.compile_failed(log, F.when(t == "purchase", 0).otherwise(1)).alias("failed"))


@query("severity_gate", "WITH i AS (SELECT CASE event_type WHEN 'error' THEN 'nullPointer' WHEN 'click' THEN 'memleak' WHEN 'purchase' THEN 'noValidConfiguration' WHEN 'signup' THEN 'other' ELSE 'unusedVariable' END AS id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'error' WHEN 'view' THEN 'style' ELSE 'warning' END AS severity, CASE event_type WHEN 'click' THEN '' ELSE '476' END AS cwe FROM events) SELECT id, severity, CASE id WHEN 'nullPointer' THEN 'CWE-476' WHEN 'memleak' THEN 'CWE-401' END AS cwe_mapped, CASE WHEN cwe <> '' THEN 'CWE-' || cwe END AS cwe_reported, count(*) AS n FROM i WHERE severity IN ('error', 'warning') AND id <> 'noValidConfiguration' GROUP BY ALL")
def severity_gate(spark, sf):
    """Findings of analyser reports that count, with the class they stand for."""
    t = F.col("event_type")
    id_ = F.when(t == "error", "nullPointer").when(t == "click", "memleak").when(t == "purchase", "noValidConfiguration").when(t == "signup", "other").otherwise("unusedVariable")
    level = F.when(t.isin("error", "purchase"), "error").when(t == "view", "style").otherwise("warning")
    xml = F.concat(F.lit('<results><errors><error id="'), id_, F.lit('" severity="'), level, F.lit('" msg="m" cwe="'), F.when(t == "click", "").otherwise("476"), F.lit('"/></errors></results>'))
    x = files.parse_xml_issues(table(spark, sf, "events").select("event_id", xml.alias("report")), "report")
    return files.severity_gate(x).groupBy("id", "severity", "cwe_mapped", "cwe_reported").agg(F.count("*").alias("n"))


@query("elimination_by_class", f"WITH {OPINIONS} SELECT coalesce(true_cwe, 'unknown') AS cwe, count(*) AS total, count_if(coalesce(NOT has_vuln AND verification_status IS NOT NULL, false)) AS eliminated, round(count_if(coalesce(NOT has_vuln AND verification_status IS NOT NULL, false)) / count(*), 4) AS rate FROM opinions GROUP BY ALL")
def elimination_by_class(spark, sf):
    return E.elimination_by_class(opinions(spark, sf), "true_cwe", ~F.col("has_vuln") & F.col("verification_status").isNotNull())


# ---- reranking and resumption --------------------------------------------------------------------------


def shared_words(queries: list[str], texts: list[str]) -> list[float]:
    """A scorer: distinct words in common, cut at blanks."""
    return [float(len(set(q.lower().split(" ")) & set(t.lower().split(" ")))) for q, t in zip(queries, texts)]


_ORDER = "SELECT query_id, doc_id, rank, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 5 THEN -rank ELSE s END DESC, rank, doc_id) AS new_rank FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM sc)) WHERE new_rank <= 5"


@query("rerank_scored", f"WITH {_BM25}, sc AS (SELECT f.query_id, f.doc_id, f.rank, len(list_intersect(list_distinct(string_split(lower(left(e.item_text, 512)), ' ')), list_distinct(string_split(lower(left(d.text, 512)), ' ')))) AS s FROM lex f JOIN eval_items e ON e.item_id = f.query_id JOIN documents d USING (doc_id)) {_ORDER}")
def rerank_scored(spark, sf):
    """The lexical list ordered anew by a scorer object on Arrow batches."""
    return R.rerank_by(_with_texts(spark, sf, lexical(spark, sf)), 5, shared_words, "item_text").select("query_id", "doc_id", "rank", "new_rank")


@query("rerank_answers", f"WITH {_BM25}, sc AS (SELECT query_id, doc_id, rank, CASE WHEN doc_id % 5 = 0 THEN 0.5::DOUBLE ELSE (doc_id % 11) / 10 END AS s FROM lex) {_ORDER}")
def rerank_answers(spark, sf):
    """The lexical list ordered anew by a judge's answers from 0 to 10, some of which say nothing."""
    hits = lexical(spark, sf)
    answer = F.when(F.col("doc_id") % 5 == 0, "no number").otherwise(F.concat((F.col("doc_id") % 11).cast("string"), F.lit(" of 10")))
    return R.rerank_by_answers(hits, hits.select("query_id", "doc_id", answer.alias("answer")), 5).select("query_id", "doc_id", "rank", "new_rank")


@query("resume_quota", "WITH d AS (SELECT DISTINCT sample_id FROM predictions WHERE sample_id IS NOT NULL AND error IS NULL AND run_config = (SELECT min(run_config) FROM predictions)) SELECT sample_id FROM (SELECT DISTINCT sample_id FROM train_v2 WHERE sample_id IS NOT NULL) WHERE sample_id NOT IN (SELECT sample_id FROM d) ORDER BY sample_id LIMIT greatest(0, 400 - (SELECT count(*) FROM d))")
def resume_quota(spark, sf):
    """Records still to be run where a quota counts those that are done."""
    p = table(spark, sf, "predictions")
    first = p.agg(F.min("run_config")).first()[0]
    done = p.where((F.col("run_config") == first) & F.col("sample_id").isNotNull() & F.col("error").isNull())
    return files.pending(table(spark, sf, "train_v2").where("sample_id is not null").select("sample_id").distinct(), done, "sample_id", 400)


@query("lr_ranked")
def lr_ranked(spark, sf):
    """Features by the size of their coefficient."""
    return M.ranked_coefficients(model_input(spark, sf), [*_COMPLEX, *_API], "label")
