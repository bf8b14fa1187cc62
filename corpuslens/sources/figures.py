"""Result tables as figures: SVG text of bars, lines, points with intervals, heat maps and tiles, for reports of bounded size.

SVG is text, so a figure needs no library and can be read by any browser or
typesetter.  Every function takes rows that were collected from a report table;
empty tables give an empty frame, null values are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

WIDTH, HEIGHT, LEFT, BOTTOM = 720, 400, 150, 60
INK, FILL, SECOND, PALE = "#222222", "#3b6ea5", "#c4552d", "#e9eef5"


def _frame(title: str, body: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif" font-size="11">'
    return "\n".join([head, f'<text x="{WIDTH // 2}" y="18" text-anchor="middle" font-size="14" fill="{INK}">{escape(title)}</text>', *body, "</svg>"])


def _text(x: float, y: float, s: object, anchor: str = "end") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" fill="{INK}">{escape("" if s is None else f"{s:.3g}" if isinstance(s, float) else str(s))}</text>'


def _rect(x: float, y: float, w: float, h: float, fill: str, label: str = "") -> str:
    return f'<rect x="{x:.1f}" y="{y:.1f}" width="{max(w, 0):.1f}" height="{max(h, 0):.1f}" fill="{fill}"><title>{escape(label)}</title></rect>'


def _scale(values: Sequence[float], start: float, end: float, zero: bool = True):
    """Function from values to places; a single value lies in the middle."""
    low, high = min(values, default=0.0), max(values, default=1.0)
    low, high = (min(low, 0.0), max(high, 0.0)) if zero else (low, high)
    return lambda v: start + (end - start) * ((v - low) / (high - low) if high > low else 0.5)


def bars(title: str, names: Sequence[object], values: Sequence[float], line: Sequence[float] | None = None) -> str:
    """Horizontal bars, and a second series as a line over them (a Pareto chart)."""
    rows = [(n, v, None if line is None else line[i]) for i, (n, v) in enumerate(zip(names, values)) if v is not None]
    x, step = _scale([v for _, v, _ in rows], LEFT, WIDTH - 40), (HEIGHT - 30 - BOTTOM) / max(1, len(rows))
    body = []
    for i, (n, v, _) in enumerate(rows):
        y = 30 + i * step
        body += [_rect(min(x(0), x(v)), y, abs(x(v) - x(0)), step * 0.8, FILL, f"{n}: {v}"), _text(LEFT - 6, y + step * 0.6, n), _text(max(x(0), x(v)) + 4, y + step * 0.6, v, "start")]
    if line is not None and rows:
        z = _scale([c for *_, c in rows if c is not None], LEFT, WIDTH - 40)
        body.append(f'<polyline fill="none" stroke="{SECOND}" points="' + " ".join(f"{z(c):.1f},{30 + (i + 0.4) * step:.1f}" for i, (*_, c) in enumerate(rows) if c is not None) + '"/>')
    return _frame(title, body)


def lines(title: str, xs: Sequence[float], ys: Sequence[float], diagonal: bool = False) -> str:
    """A line through points, with the diagonal for a Lorenz curve."""
    pts = sorted((a, b) for a, b in zip(xs, ys) if a is not None and b is not None)
    x, y = _scale([a for a, _ in pts], LEFT, WIDTH - 40), _scale([b for _, b in pts], HEIGHT - BOTTOM, 30)
    body = [f'<polyline fill="none" stroke="{FILL}" stroke-width="2" points="' + " ".join(f"{x(a):.1f},{y(b):.1f}" for a, b in pts) + '"/>']
    if diagonal and pts:
        body.append(f'<line x1="{x(pts[0][0]):.1f}" y1="{y(pts[0][1]):.1f}" x2="{x(pts[-1][0]):.1f}" y2="{y(pts[-1][1]):.1f}" stroke="{SECOND}" stroke-dasharray="4"/>')
    return _frame(title, body)


def intervals(title: str, names: Sequence[object], points: Sequence[float], low: Sequence[float], high: Sequence[float], reference: float | None = None) -> str:
    """Points with their intervals (a forest plot) and a line at the value of no effect."""
    rows = [r for r in zip(names, points, low, high) if None not in r[1:]]
    values = [v for r in rows for v in r[1:]] + ([] if reference is None else [reference])
    x, step = _scale(values, LEFT, WIDTH - 40, False), (HEIGHT - 30 - BOTTOM) / max(1, len(rows))
    body = [] if reference is None else [f'<line x1="{x(reference):.1f}" x2="{x(reference):.1f}" y1="28" y2="{HEIGHT - BOTTOM}" stroke="{SECOND}" stroke-dasharray="4"/>']
    for i, (n, p, a, b) in enumerate(rows):
        y = 30 + (i + 0.5) * step
        body += [f'<line x1="{x(a):.1f}" x2="{x(b):.1f}" y1="{y:.1f}" y2="{y:.1f}" stroke="{INK}"/>', f'<circle cx="{x(p):.1f}" cy="{y:.1f}" r="4" fill="{FILL}"><title>{escape(f"{n}: {p} [{a}, {b}]")}</title></circle>', _text(LEFT - 6, y + 4, n)]
    return _frame(title, body)


def heat(title: str, rows: Sequence[object], columns: Sequence[object], values: Sequence[float]) -> str:
    """Cells (row, column, value) as a heat map; cells that don't occur stay empty."""
    cells = [c for c in zip(rows, columns, values) if c[2] is not None]
    ys, xs = sorted({str(r) for r, _, _ in cells}), sorted({str(c) for _, c, _ in cells})
    h, w, most = (HEIGHT - 40 - BOTTOM) / max(1, len(ys)), (WIDTH - LEFT - 30) / max(1, len(xs)), max((abs(v) for *_, v in cells), default=0) or 1
    body = [_rect(LEFT, 30, WIDTH - LEFT - 30, HEIGHT - 40 - BOTTOM, PALE)]
    for r, c, v in cells:
        colour = FILL if v >= 0 else SECOND
        body.append(f'<g fill-opacity="{0.1 + 0.9 * abs(v) / most:.2f}">' + _rect(LEFT + xs.index(str(c)) * w, 30 + ys.index(str(r)) * h, w - 1, h - 1, colour, f"{r}, {c}: {v}") + "</g>")
    body += [_text(LEFT - 6, 30 + (i + 0.7) * h, r) for i, r in enumerate(ys)] + [_text(LEFT + (i + 0.5) * w, HEIGHT - BOTTOM + 8, c, "middle") for i, c in enumerate(xs)]
    return _frame(title, body)


def tiles(title: str, names: Sequence[object], values: Sequence[float]) -> str:
    """Areas in proportion to values, cut off in turn along the longer side (a tree map)."""
    rows = sorted(((n, v) for n, v in zip(names, values) if v and v > 0), key=lambda r: (-r[1], str(r[0])))
    x, y, w, h, left, body = 20.0, 30.0, WIDTH - 40.0, HEIGHT - 60.0, float(sum(v for _, v in rows)), []
    for n, v in rows:
        part = v / left
        a, b = (w * part, h) if w >= h else (w, h * part)
        body += [_rect(x, y, a - 1, b - 1, FILL, f"{n}: {v}"), _text(x + 4, y + 14, n, "start") if a > 60 and b > 16 else ""]
        x, y, w, h, left = (x + a, y, w - a, h, left - v) if w >= h else (x, y + b, w, h - b, left - v)
    return _frame(title, body)
