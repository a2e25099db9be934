"""Word clouds and dot plots of small results as SVG."""

from __future__ import annotations

import html
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.spread import positions

#: Rows that a picture takes at most: significant concepts and trends.
TOP, TRENDS = 60, 25
#: Width of a letter and height of a line against the size of the font.
LETTER, LINE = 0.58, 1.3
#: Colours by the number of doublings in the fold, from none to five and more.
RAMP = {
    "light": ("#7aa6a1", "#4f8f9d", "#3b6f9e", "#47509b", "#6a3690", "#8c1d62"),
    "dark": ("#5f8f8a", "#63b0b5", "#6cb4e4", "#93a5f2", "#c39bf0", "#f28ac2"),
}
PAPER = {"light": ("#ffffff", "#20262c", "#8b949c"), "dark": ("#161a1e", "#e9edf0", "#717b84")}


def cloud_rows(described: DataFrame, layers: tuple[str, ...] | None = None, top: int = TOP, trends: int = TRENDS) -> dict[str, list[dict]]:
    """Of each set the representatives that its cloud shows, significant ones first; at most top + trends rows a set."""
    rows = described.where("representative AND status <> ''")
    if layers:
        rows = rows.where(rows["layer"].isin(*layers))
    placed = positions(rows.withColumn("kind", F.concat_ws("|", "status", "set_id")), "kind", [F.col("rank")], "place")
    out: dict[str, list[dict]] = {}
    for row in placed.where(F.col("place") <= F.when(F.col("status") == "significant", top).otherwise(trends)).orderBy("set_id", "status", "place").collect():
        out.setdefault(row["set_id"], []).append(row.asDict())
    return out


def strength(rate: float) -> float:
    """-log10 of a false discovery rate."""
    return -math.log10(max(rate, 1e-300))


def shade(fold: float, theme: str) -> str:
    return RAMP[theme][min(int(math.log2(max(fold, 1.0))), len(RAMP[theme]) - 1)]


def in_lines(words: list[tuple[str, float]], width: float, height: float) -> list[tuple[float, float, float, float] | None]:
    """A box (x, y, w, h) for each (text, size): lines filled in order, the first in the middle and the others above and below in turn.

    None for the words of lines that have no room, and for words wider than a line.
    """
    lines: list[list[int]] = []
    left = 0.0
    for i, (text, size) in enumerate(words):
        wide = (len(text) + 1) * size * LETTER
        if wide > width:
            continue
        if not lines or wide > left:
            lines.append([])
            left = width
        lines[-1].append(i)
        left -= wide
    out: list[tuple[float, float, float, float] | None] = [None] * len(words)
    up = down = None
    for no, line in enumerate(lines):
        tall = max(words[i][1] for i in line) * LINE
        if up is None:
            top = (height - tall) / 2
            up, down = top, top + tall
        elif no % 2:
            top = up = up - tall
        else:
            top, down = down, down + tall
        if top < 0 or top + tall > height:
            continue
        x = (width - sum((len(words[i][0]) + 1) * words[i][1] * LETTER for i in line)) / 2
        for i in line:
            wide = (len(words[i][0]) + 1) * words[i][1] * LETTER
            out[i] = (x, top, wide, tall)
            x += wide
    return out


def cloud_svg(rows: list[dict], title: str = "", width: int = 900, height: int = 520, theme: str = "light", largest: float = 42, smallest: float = 9) -> str:
    """The cloud of a set: size by significance, colour by fold, keywords in italics, trends grey.

    The greatest scale is taken at which every word has room; at the smallest size what has none is left out.
    """
    paper, ink, soft = PAPER[theme]
    strong = [r for r in rows if r["status"] == "significant"]
    weak = [r for r in rows if r["status"] != "significant"]
    head, foot = 46, 40
    scores = [strength(r["fdr"]) for r in strong]
    top = max(scores, default=1.0) or 1.0
    low, high = 0.0, 1.0
    for scale in [1.0] + [None] * 8:
        share = (low + high) / 2 if scale is None else scale
        sizes = [smallest + (largest - smallest) * share * math.sqrt(s / top) for s in scores] + [smallest] * len(weak)
        words = [(r["display"], s) for r, s in zip(strong + weak, sizes)]
        boxes = in_lines(words, width, height - head - foot)
        if all(boxes):
            if scale is not None:
                break
            low = share
        else:
            high = share
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" font-family="sans-serif"><rect width="100%" height="100%" fill="{paper}"/>']
    out.append(f'<text x="12" y="22" font-size="16" font-weight="bold" fill="{ink}">{html.escape(title)}</text>')
    if rows:
        first = rows[0]
        out.append(f'<text x="12" y="38" font-size="9" fill="{soft}">{first["n_study"]:,} of {first["n_bg"]:,} background entities; size by -log10 of the false discovery rate, colour by fold</text>')
    for i, (row, (text, size), box) in enumerate(zip(strong + weak, words, boxes)):
        if box:
            x, y, w, h = box
            colour = soft if i >= len(strong) else shade(row["fold"], theme)
            style = ' font-style="italic"' if row["layer"] == "keyword" else ""
            out.append(f'<text class="word" data-i="{i}" x="{x + w / 2:.1f}" y="{head + y + h * 0.75:.1f}" font-size="{size:.1f}" fill="{colour}" text-anchor="middle"{style}>{html.escape(text)}</text>')
    if not strong:
        out.append(f'<text x="{width / 2}" y="{height / 2}" font-size="12" fill="{soft}" text-anchor="middle">no concept is significant</text>')
    for i, colour in enumerate(RAMP[theme] if strong else ()):
        out.append(f'<rect x="{12 + 54 * i}" y="{height - 30}" width="50" height="8" fill="{colour}"/><text x="{12 + 54 * i}" y="{height - 10}" font-size="8" fill="{soft}">fold {2**i}{"+" if i == len(RAMP[theme]) - 1 else ""}</text>')
    notes = [n for n, on in (("italic: keyword", any(r["layer"] == "keyword" for r in rows)), ("grey: trend, not significant", bool(weak))) if on]
    out.append(f'<text x="{width - 12}" y="{height - 10}" font-size="8" fill="{soft}" text-anchor="end">{"; ".join(notes)}</text>')
    return "\n".join([*out, "</svg>"])


def dots_svg(grid: list[dict], theme: str = "light") -> str:
    """The comparison as dots: sets across, concepts down; size by significance, colour by fold, filled where significant.

    Raises ValueError where nothing is significant.
    """
    if not grid:
        raise ValueError("no significant concept in any set")
    paper, ink, soft = PAPER[theme]
    names = {name: i for i, name in enumerate(sorted({r["set_id"] for r in grid}))}
    labels = {label: i for i, label in enumerate(dict.fromkeys(r["label"] for r in grid))}
    left, cell, line = 230, 84, 22
    width, height = left + cell * len(names) + 20, 50 + line * len(labels)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" font-family="sans-serif" font-size="11"><rect width="100%" height="100%" fill="{paper}"/>']
    for r in grid:
        if r["k_study"]:
            radius = 2.5 + 0.75 * min(strength(r["fdr"]), 10)
            colour = shade(r["fold"] or 1, theme)
            out.append(f'<circle cx="{left + cell * (names[r["set_id"]] + 0.5):.0f}" cy="{40 + line * labels[r["label"]]}" r="{radius:.1f}" stroke="{colour}" fill="{colour if r["significant"] else "none"}"/>')
    shown = {r["label"]: r["concept"] for r in grid}
    out += [f'<text x="{left - 8}" y="{44 + line * i}" text-anchor="end" fill="{ink}">{html.escape(shown[label])}</text>' for label, i in labels.items()]
    out += [f'<text x="{left + cell * (i + 0.5):.0f}" y="18" text-anchor="middle" fill="{soft}">{html.escape(name)}</text>' for name, i in names.items()]
    return "\n".join([*out, "</svg>"])
