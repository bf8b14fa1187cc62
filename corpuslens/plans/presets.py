"""Named configurations of retrieval and judgement, and the plans they stand for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import retrieval as R

RETRIEVALS = ("none", "lexical", "topical", "hybrid", "weighted")


@dataclass(frozen=True)
class Preset:
    """retrieval: one of RETRIEVALS; k: final size; wide: candidates per list; the flags switch stages on."""

    name: str
    retrieval: str = "none"
    k: int = 5
    wide: int = 20
    rerank: bool = False
    vote: bool = False
    debate: bool = False
    plan: bool = False
    structure: bool = False
    reflect: bool = False
    verify: bool = False
    route: bool = False
    rewrite: bool = False
    retry: bool = False

    def __post_init__(self) -> None:
        if self.retrieval not in RETRIEVALS:
            raise ValueError(f"retrieval must be one of {RETRIEVALS}")

    @property
    def detector(self) -> str:
        """The stage that decides: plan over structure over debate over vote over plain."""
        return next((n for n in ("plan", "structure", "debate", "vote") if getattr(self, n)), "plain")


class Presets(dict):
    """Presets by name; a name can be taken once."""

    def register(self, preset: Preset) -> Preset:
        if preset.name in self:
            raise ValueError(f"preset {preset.name} exists")
        self[preset.name] = preset
        return preset


PRESETS = Presets()
for _p in (
    Preset("naive"),
    Preset("lexical", "lexical"),
    Preset("topical", "topical"),
    Preset("hybrid", "hybrid"),
    Preset("hybrid_rerank", "hybrid", rerank=True),
    Preset("dual", "weighted", rerank=True),
    Preset("dual_vote", "weighted", rerank=True, vote=True),
    Preset("dual_debate", "weighted", rerank=True, debate=True),
    Preset("dual_structure", "weighted", rerank=True, structure=True),
    Preset("dual_plan", "weighted", rerank=True, plan=True),
    Preset("full", "weighted", rerank=True, plan=True, reflect=True, verify=True),
):
    PRESETS.register(_p)


#: The stages that configurations of an evaluation switch on, and the configurations by name:
#: those of single evaluations, of the stepwise ablation, and of the long ablation with its estimated seconds per sample.
STAGES = ("router", "hybrid", "hyde", "reranker", "crag", "verifier", "voting", "debate", "kl_rag", "reflection", "plan_and_solve", "ast_tool")
EVALUATIONS = {
    "naive": "",
    "rag_only": "hybrid hyde reranker crag",
    "agent_only": "router",
    "full": "router hybrid hyde reranker crag",
    "full_with_voting": "router hybrid hyde reranker crag voting",
    "full_with_debate": "router hybrid hyde reranker crag debate",
    "full_with_verifier": "router hybrid hyde reranker crag verifier",
    "kl_rag_only": "kl_rag",
    "kl_rag_full": "router reranker kl_rag",
    "kl_rag_full_voting": "router reranker voting kl_rag",
    "kl_rag_full_reflection": "router reranker kl_rag reflection",
    "kl_rag_plan_and_solve": "router reranker kl_rag plan_and_solve",
    "kl_rag_ast": "router reranker kl_rag ast_tool",
    "kl_rag_full_verifier": "router reranker verifier kl_rag",
    "kl_rag_ast_voting": "router reranker voting kl_rag ast_tool",
}
ABLATIONS = {
    "1_naive": "",
    "2_rag_basic": "",
    "3_hybrid": "hybrid",
    "4_hybrid_hyde": "hybrid hyde",
    "5_hybrid_hyde_rerank": "hybrid hyde reranker",
    "6_hybrid_hyde_rerank_crag": "hybrid hyde reranker crag",
    "7_full_no_verifier": "router hybrid hyde reranker crag",
    "8_full_with_voting": "router hybrid hyde reranker crag voting",
    "9_full_with_debate": "router hybrid hyde reranker crag debate",
    "10_full_with_verifier": "router hybrid hyde reranker crag verifier",
}
LONG_ABLATIONS = {
    "ON_01_naive": ("", 8),
    "ON_02_rag_basic": ("", 10),
    "ON_03_full_crag": ("hybrid hyde reranker crag", 14),
    "ON_04_kl_rag_only": ("kl_rag", 16),
    "ON_05_kl_rag_ast": ("router reranker kl_rag ast_tool", 20),
    "ON_06_kl_rag_plan": ("router reranker kl_rag plan_and_solve", 45),
    "ON_07_kl_rag_verifier": ("router reranker verifier kl_rag", 50),
    "ON_08_kl_rag_ast_vote": ("router reranker voting kl_rag ast_tool", 30),
}


def staged(name: str, stages: str) -> Preset:
    """The preset that switches these stages on.

    Retrieval by knowledge is the topical list, hybrid retrieval fuses both;
    every configuration but the bare one retrieves lexically at least.
    """
    on = set(stages.split())
    if on - set(STAGES):
        raise ValueError(f"unknown stages {sorted(on - set(STAGES))}")
    retrieval = "topical" if "kl_rag" in on else "hybrid" if "hybrid" in on else "none" if name.endswith(("naive", "agent_only")) else "lexical"
    return Preset(name, retrieval, rerank="reranker" in on, vote="voting" in on, debate="debate" in on, plan="plan_and_solve" in on, structure="ast_tool" in on, reflect="reflection" in on, verify="verifier" in on, route="router" in on, rewrite="hyde" in on, retry="crag" in on)


CONFIGURATIONS = Presets()
for _name, _stages in {**EVALUATIONS, **ABLATIONS, **{n: s for n, (s, _) in LONG_ABLATIONS.items()}}.items():
    CONFIGURATIONS.register(staged(_name, _stages))


def estimated_seconds(name: str, samples: int) -> int | None:
    """Seconds that a configuration of the long ablation is expected to take; None for one without an estimate."""
    return LONG_ABLATIONS[name][1] * samples if name in LONG_ABLATIONS else None


def retrieve(preset: Preset, lexical: DataFrame, topical: DataFrame, texts: DataFrame | None = None) -> DataFrame | None:
    """The preset's ranked list (query_id, doc_id, score, rank) from the two base lists; None without retrieval.

    texts (query_id, doc_id, query, text) is needed for reranking.
    """
    k = preset.wide if preset.rerank else preset.k
    cut = lambda df: df.where(F.col("rank") <= preset.wide)
    if preset.retrieval == "none":
        return None
    if preset.retrieval in ("lexical", "topical"):
        out = (lexical if preset.retrieval == "lexical" else topical).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")
    else:
        a, b = (1.0, 1.0) if preset.retrieval == "hybrid" else (0.3, 0.7)
        out = R.rrf([(cut(lexical), a), (cut(topical), b)], k).drop("lists")
    if preset.rerank:
        out = R.rerank(out.join(texts, ["query_id", "doc_id"]), preset.k, R.token_overlap(F.col("query"), F.col("text"))).select("query_id", "doc_id", F.col("new_score").alias("score"), F.col("new_rank").alias("rank"))
    return out
