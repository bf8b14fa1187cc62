"""The reports of the study as a whole: selection by number, Markdown, LaTeX tables and figures."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.plans.catalogue import QUERIES
from corpuslens.sources import figures as V
from corpuslens.sources import render

#: Queries of each report by its number.
REPORTS = {
    1: ("report_r1", "report_r1_diversity", "chi2_gof"),
    2: ("report_r2", "report_r2_tests"),
    3: ("report_r3", "report_r3_tests", "high_corr_pairs"),
    4: ("report_r4", "report_r4_tests"),
    5: ("report_r5", "report_r5_tests", "top_pmi"),
    6: ("report_r6", "antipattern_tests"),
    7: ("report_r7", "report_r7_tests", "report_r7_levels"),
    8: ("report_r8", "report_r8_concentration", "report_r8_tests"),
    9: ("report_r9", "report_r9_clusters"),
    10: ("report_r10", "rf_ranked_importance"),
}
#: The eight LaTeX tables: label, caption, query, columns.
TABLES = {
    "overview": ("Samples by origin and label", "label_partition_counts", None),
    "classes": ("Classes of weakness", "report_r1", ("cwe", "n", "share", "layer", "external_rank")),
    "components": ("Density per component", "report_r2", ("component", "total", "positive", "density", "ci_low", "ci_high", "odds_ratio")),
    "complexity": ("Complexity of vulnerable and clean samples", "report_r3", None),
    "languages": ("Density per language", "report_r4", ("family", "total", "positive", "density", "odds_ratio")),
    "features": ("Interface features and the label", "report_r5_tests", ("feature", "odds_ratio", "or_low", "or_high", "p", "p_bh")),
    "antipatterns": ("Anti-patterns of vulnerable samples", "report_r6", None),
    "models": ("Prediction by nested feature sets", "report_r10", None),
}
#: Rows of a figure or table at most; the largest come first.
TOP = 40

#: The figures: title, query, order, and the drawing of its rows.
FIGURES = {
    "classes_pareto": ("Classes of weakness", "report_r1", "place", lambda t, r: V.bars(t, [x.cwe for x in r], [x.n for x in r], _running([x.share for x in r]))),
    "classes_lorenz": ("Concentration of classes", "gini_lorenz", "i", lambda t, r: V.lines(t, [x.x for x in r], [x.y for x in r], True)),
    "component_density": ("Density per component", "report_r2", "component", lambda t, r: V.bars(t, [x.component for x in r], [x.density for x in r])),
    "component_forest": ("Odds ratio per component", "report_r2", "component", lambda t, r: V.intervals(t, [x.component for x in r], [x.odds_ratio for x in r], [x.or_low for x in r], [x.or_high for x in r], 1.0)),
    "component_intervals": ("Density with its interval", "report_r2", "component", lambda t, r: V.intervals(t, [x.component for x in r], [x.density for x in r], [x.ci_low for x in r], [x.ci_high for x in r])),
    "complexity_delta": ("Cliff's delta of the metrics", "report_r3_tests", "metric", lambda t, r: V.bars(t, [x.metric for x in r], [x.delta for x in r])),
    "complexity_correlation": ("Rank correlations of the metrics above 0.7", "high_corr_pairs", "a", lambda t, r: V.heat(t, [x.a for x in r], [x.b for x in r], [x.rho for x in r])),
    "language_density": ("Density per language", "report_r4", "family", lambda t, r: V.intervals(t, [x.family for x in r], [x.density for x in r], [x.ci_low for x in r], [x.ci_high for x in r])),
    "feature_pmi": ("Features and classes, mutual information", "top_pmi", "feature", lambda t, r: V.heat(t, [x.feature for x in r], [x.cwe for x in r], [x.pmi for x in r])),
    "feature_forest": ("Odds ratio per feature", "report_r5_tests", "feature", lambda t, r: V.intervals(t, [x.feature for x in r], [x.odds_ratio for x in r], [x.or_low for x in r], [x.or_high for x in r], 1.0)),
    "antipattern_heat": ("Anti-patterns and their dominant class", "report_r6", "pattern", lambda t, r: V.heat(t, [x.pattern for x in r], [x.dominant_class for x in r], [x.dominant_n for x in r])),
    "severity_levels": ("Severity of vulnerable samples", "report_r7_levels", "severity", lambda t, r: V.bars(t, [x.severity for x in r], [x.n for x in r])),
    "repository_tiles": ("Samples per repository", "report_r8", "total desc", lambda t, r: V.tiles(t, [x.repo for x in r], [x.total for x in r])),
    "feature_importance": ("Importance in the forest", "rf_ranked_importance", "rank", lambda t, r: V.bars(t, [x.feature for x in r], [x.importance for x in r])),
    "model_comparison": ("AUC of nested feature sets", "report_r10", "features", lambda t, r: V.intervals(t, [x.model for x in r], [x.auc for x in r], [x.auc - x.deviation for x in r], [x.auc + x.deviation for x in r])),
}


def _running(values: list[float]) -> list[float]:
    out, total = [], 0.0
    for v in values:
        total += v
        out.append(total)
    return out


def selected(numbers: str | Iterable[int] | None = None) -> list[int]:
    """Numbers of reports from a list such as "1,3" or an iterable, all of them by default; unknown ones raise."""
    wanted = sorted(REPORTS) if not numbers else sorted({int(n) for n in (numbers.split(",") if isinstance(numbers, str) else numbers)})
    if set(wanted) - set(REPORTS):
        raise ValueError(f"reports are numbered {min(REPORTS)} to {max(REPORTS)}")
    return wanted


def _rows(spark: SparkSession, sf_dir: str, query: str, order: str | None = None) -> DataFrame:
    df = QUERIES[query](spark, sf_dir)
    first = order or df.columns[0]
    return df.orderBy(F.desc(first.split()[0]) if first.endswith(" desc") else F.asc(first)).limit(TOP)  # figures and tables show so many rows


def markdown(spark: SparkSession, sf_dir: str, numbers: str | Iterable[int] | None = None) -> str:
    """The selected reports as one Markdown text."""
    parts = ["# Report"]
    for n in selected(numbers):
        parts.append(f"## R{n}")
        for q in REPORTS[n]:
            parts += [f"### {q}", (QUERIES[q].__doc__ or "").strip(), render.markdown(_rows(spark, sf_dir, q))]
    return "\n\n".join(p for p in parts if p) + "\n"


def latex(spark: SparkSession, sf_dir: str) -> str:
    """The eight tables as LaTeX."""
    out = []
    for label, (caption, query, columns) in TABLES.items():
        df = _rows(spark, sf_dir, query)
        out.append(render.latex(df.select(*columns) if columns else df, caption, f"tab:{label}"))
    return "\n\n".join(out) + "\n"


def figure(spark: SparkSession, sf_dir: str, name: str) -> str:
    """One figure as SVG."""
    title, query, order, draw = FIGURES[name]
    return draw(title, _rows(spark, sf_dir, query, order).collect())


def write_all(spark: SparkSession, sf_dir: str, folder: str, numbers: str | Iterable[int] | None = None) -> list[str]:
    """Writes report.md, tables.tex and the figures to a folder of the driver; returns the names."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "report.md").write_text(markdown(spark, sf_dir, numbers), encoding="utf-8")
    (out / "tables.tex").write_text(latex(spark, sf_dir), encoding="utf-8")
    for name in FIGURES:
        (out / f"{name}.svg").write_text(figure(spark, sf_dir, name), encoding="utf-8")
    return sorted(p.name for p in out.iterdir())
