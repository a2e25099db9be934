"""A page of its own around a cloud: the concepts and the entities of the set as tables that sort by a click."""

from __future__ import annotations

import html
import json

COLUMNS = ("display", "layer", "k_study", "n_study", "k_bg", "fold", "p_value", "fdr", "merged", "symbols")
#: Entities that a page lists at most; it says how many more there are.
ENTITIES = 5000
STYLE = "body{font-family:sans-serif;max-width:70em;margin:1em auto}table{border-collapse:collapse}td,th{padding:.2em .6em;border-bottom:1px solid #ccc;text-align:left}th{cursor:pointer}.on{background:#fff3c4}"
SCRIPT = """
for (const table of document.querySelectorAll("table")) table.querySelectorAll("th").forEach((head, at) => head.onclick = () => {
  const body = table.tBodies[0], sign = head.dataset.up = head.dataset.up === "1" ? "-1" : "1";
  const value = row => { const text = row.cells[at].textContent, number = Number(text); return text !== "" && !isNaN(number) ? number : text; };
  [...body.rows].map(row => [value(row), row]).sort((a, b) => (a[0] < b[0] ? -1 : a[0] > b[0] ? 1 : 0) * sign).forEach(pair => body.append(pair[1]));
});
const rows = JSON.parse(document.getElementById("rows").textContent);
document.querySelectorAll("text.word").forEach(word => word.onclick = () => {
  const carried = new Set(rows[word.dataset.i].genes.split(", "));
  document.querySelectorAll("#entities tbody tr").forEach(row => row.classList.toggle("on", carried.has(row.cells[0].textContent)));
});
"""


def _table(name: str, columns: tuple[str, ...], rows: list[dict]) -> str:
    cell = lambda x: html.escape(f"{x:.4g}" if isinstance(x, float) else str(x))
    head = "".join(f"<th>{c}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in columns) + "</tr>" for r in rows)
    return f'<table id="{name}"><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>'


def page(title: str, picture: str, rows: list[dict], entities: list[dict] = (), n_entities: int | None = None) -> str:
    """rows: those of the cloud in its order; entities: id, symbol, name. No text in them can close a tag or run."""
    data = json.dumps([{c: r[c] for c in (*COLUMNS, "genes")} for r in rows]).replace("<", "\\u003c")
    more = (n_entities or len(entities)) - len(entities)
    note = f"<p>and {more} more</p>" if more > 0 else ""
    return (
        f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{picture}'
        f'<h2>Concepts</h2>{_table("concepts", COLUMNS, rows)}<h2>Entities</h2>{_table("entities", ("id", "symbol", "name"), list(entities))}{note}'
        f'<script type="application/json" id="rows">{data}</script><script>{SCRIPT}</script></body></html>'
    )
