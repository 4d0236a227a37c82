"""Figures as SVG and one page as HTML, from tables small enough to read."""

from __future__ import annotations

import html

COLOURS = ("#4c78a8", "#f58518", "#54a24b", "#e45756", "#72b7b2", "#b279a2")


def bar_chart(bars: list[tuple[str, float | None, float | None]], title: str, width: int = 640) -> str:
    """An SVG of named bars, each with a mark at its level."""
    top = max((x for b in bars for x in b[1:] if x is not None), default=0.0) or 1.0
    px = lambda x: 90 + (width - 160) * max(x or 0.0, 0.0) / top
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{30 + 24 * len(bars)}" font-family="sans-serif" font-size="11"><text x="6" y="16" font-size="13">{html.escape(title)}</text>']
    for i, (name, x, level) in enumerate(bars):
        y = 28 + 24 * i
        out.append(f'<text x="6" y="{y + 12}">{html.escape(name)}</text><rect x="90" y="{y}" width="{px(x) - 90:.1f}" height="15" fill="{COLOURS[i % len(COLOURS)]}"/><text x="{px(x) + 4:.1f}" y="{y + 12}">{"" if x is None else f"{x:.3g}"}</text>')
        if level is not None:
            out.append(f'<line x1="{px(level):.1f}" x2="{px(level):.1f}" y1="{y - 2}" y2="{y + 17}" stroke="#000" stroke-dasharray="3 2"/>')
    return "".join([*out, "</svg>"])


def line_chart(series: dict[str, list[tuple[float, float]]], title: str, width: int = 640, height: int = 260, bands: dict[str, list[tuple[float, float, float]]] | None = None) -> str:
    """An SVG of named lines over (x, y), with bands (x, low, high) behind them where given; null points are left out."""
    bands = bands or {}
    pts = [p for s in series.values() for p in s if p[1] is not None] + [(x, y) for b in bands.values() for x, *ys in b for y in ys]
    if not pts:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="10" y="20">{html.escape(title)}: no data</text></svg>'
    x0, x1 = min(p[0] for p in pts), max(p[0] for p in pts)
    y0, y1 = min(0.0, *(p[1] for p in pts)), max(p[1] for p in pts) or 1.0
    px = lambda x: 45 + (width - 60) * ((x - x0) / ((x1 - x0) or 1))
    py = lambda y: height - 30 - (height - 60) * ((y - y0) / ((y1 - y0) or 1))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11">', f'<text x="45" y="16" font-size="13">{html.escape(title)}</text>']
    for v in (y0, (y0 + y1) / 2, y1):
        out.append(f'<line x1="45" x2="{width - 15}" y1="{py(v):.1f}" y2="{py(v):.1f}" stroke="#ddd"/><text x="4" y="{py(v) + 4:.1f}">{v:.3g}</text>')
    for i, (name, s) in enumerate(series.items()):
        c = COLOURS[i % len(COLOURS)]
        if bands.get(name):
            edge = [(x, lo) for x, lo, _ in sorted(bands[name])] + [(x, hi) for x, _, hi in sorted(bands[name], reverse=True)]
            around = " ".join(f"{px(x):.1f},{py(y):.1f}" for x, y in edge)
            out.append(f'<polygon points="{around}" fill="{c}" opacity="0.2"/>')
        path = " ".join(f"{px(x):.1f},{py(y):.1f}" for x, y in sorted(p for p in s if p[1] is not None))
        out.append(f'<polyline points="{path}" fill="none" stroke="{c}" stroke-width="1.6"/><text x="{width - 150}" y="{30 + 14 * i}" fill="{c}">{html.escape(name)}</text>')
    out.append(f'<text x="45" y="{height - 8}">{x0:g}</text><text x="{width - 40}" y="{height - 8}">{x1:g}</text></svg>')
    return "".join(out)


def table(rows: list[dict], columns: list[str]) -> str:
    cell = lambda v: html.escape("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(r.get(c))}</td>" for c in columns) + "</tr>" for r in rows) + "</table>"


def page(title: str, banner: str, parts: list[str]) -> str:
    """A page without outside references; everything from data is escaped."""
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:3px 8px}.banner{padding:8px;background:#eef}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1><p class="banner">{html.escape(banner)}</p>{"".join(parts)}</body></html>'


def markdown(rows: list[dict], columns: list[str]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("" if r.get(c) is None else str(r[c]) for c in columns) + " |" for r in rows]) + "\n"
