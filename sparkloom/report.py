"""A self-contained HTML report from small collected results."""

from __future__ import annotations

from html import escape

_STYLE = "body{font-family:sans-serif;max-width:60rem;margin:auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2rem .5rem;text-align:left}"


def table(rows: list[dict], limit: int = 200) -> str:
    if not rows:
        return "<p>None.</p>"
    names = list(rows[0])
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    body = "".join("<tr>" + "".join(f"<td>{escape(show(r.get(n)))}</td>" for n in names) + "</tr>" for r in rows[:limit])
    return "<table><tr>" + "".join(f"<th>{escape(n)}</th>" for n in names) + f"</tr>{body}</table>"


def bars(labels: list[str], values: list[float], width: int = 400) -> str:
    """Horizontal bars as SVG."""
    top = max((abs(v) for v in values), default=0) or 1
    rows = "".join(f'<text x="0" y="{18 * k + 13}" font-size="11">{escape(str(n))[:24]}</text><rect x="150" y="{18 * k + 3}" width="{abs(v) / top * width:.1f}" height="13" fill="#47a"/>' for k, (n, v) in enumerate(zip(labels, values)))
    return f'<svg width="{width + 160}" height="{18 * len(values)}">{rows}</svg>'


def lines(series: dict[str, list[float]], width: int = 600, height: int = 160) -> str:
    """Lines over a shared scale as SVG."""
    every = [v for s in series.values() for v in s if v is not None]
    if not every:
        return ""
    lo, span = min(every), (max(every) - min(every)) or 1
    colours = ("#47a", "#a54", "#5a5", "#a5a")
    paths = "".join(
        f'<polyline fill="none" stroke="{colours[k % 4]}" points="' + " ".join(f"{i * width / max(1, len(s) - 1):.1f},{height - (v - lo) / span * height:.1f}" for i, v in enumerate(s) if v is not None) + '"/>' for k, s in enumerate(series.values())
    )
    return f'<svg width="{width}" height="{height}">{paths}</svg>'


def build(title: str, sections: dict[str, list[dict] | str]) -> str:
    """A page with a heading for each section; lists of rows become tables, strings are taken as HTML that this module made."""
    body = "".join(f"<h2>{escape(h)}</h2>{s if isinstance(s, str) else table(s)}" for h, s in sections.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{_STYLE}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>"
