"""Result tables as Markdown and LaTeX; for reports of bounded size only."""

from __future__ import annotations

from pyspark.sql import DataFrame

MAX_ROWS = 2_000
_LATEX = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}


def _cells(df: DataFrame) -> list[list[str]]:
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a report of more than {MAX_ROWS} rows isn't rendered")
    return [["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in rows]


def markdown(df: DataFrame) -> str:
    safe = lambda x: x.replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *_cells(df)]
    return "\n".join("| " + " | ".join(map(safe, line)) + " |" for line in lines)


def latex(df: DataFrame, caption: str, label: str) -> str:
    safe = lambda x: "".join(_LATEX.get(c, c) for c in x)
    row = lambda cells: " & ".join(map(safe, cells)) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{safe(caption)}}}\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", row(df.columns), r"\hline", *map(row, _cells(df)), r"\hline", r"\end{tabular}", r"\end{table}"])
