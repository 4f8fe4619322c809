"""Graphs as text: Mermaid, HTML and the grids of a console or dashboard. Lines are built by Spark; only the finished,
small page is put together on the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import closure_counts
from .impact import one_decimal
from .merge import coverage

# Fixed values of the Mermaid output.
SOURCE_STYLE = "    classDef source fill:#d4edda,stroke:#28a745,color:#155724"
DERIVED_STYLE = "    classDef derived fill:#cce5ff,stroke:#004085,color:#004085"


#: Nodes, and edges, that a page is put together for at most; larger graphs are for ``mermaid_lines`` or ``graph.as_json``.
MOST = 20_000
#: Colours of the systems in the drawing.
COLOURS = {"sql": "#3b7dd8", "spark": "#d9822b", "dbt": "#b5483a", "airflow": "#2e8b57", "cross": "#8e44ad"}


def page_rows(df: DataFrame, most: int, *order) -> list:
    """The rows of a page, in order. A relation of more than ``most`` is an error rather than a page without the rest."""
    rows = (df.orderBy(*order) if order else df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for one page; write mermaid_lines or as_json, or raise the bound")
    return rows


def mermaid_id(name: Column) -> Column:
    return F.translate(name, ".- ", "___")


def mermaid_lines(nodes: DataFrame, edges: DataFrame, direction: str = "LR") -> DataFrame:
    """(part, seq, line) of the flowchart; ordered by (part, seq, line) they are the text."""
    spark = nodes.sparkSession
    fixed = spark.createDataFrame([(0, f"flowchart {direction}"), (2, ""), (4, ""), (5, SOURCE_STYLE), (6, DERIVED_STYLE)], "part int, line string").select("part", F.array().cast("array<bigint>").alias("seq"), "line")
    nid = mermaid_id(F.col("node"))
    shape = F.when(F.col("is_source"), F.concat(F.lit("    "), nid, F.lit('["'), "node", F.lit('"]'))).otherwise(F.concat(F.lit("    "), nid, F.lit('("'), "node", F.lit('")')))
    kind = F.coalesce("transformation_type", F.lit(""))
    label = F.when(kind == "", "").otherwise(F.concat(F.lit("|"), kind, F.lit("|")))
    arrows = edges.select(F.lit(3).alias("part"), "seq", F.concat(F.lit("    "), mermaid_id(F.col("src")), F.lit(" -->"), label, F.lit(" "), mermaid_id(F.col("dst"))).alias("line"))
    shapes = nodes.select(F.lit(1).alias("part"), "seq", shape.alias("line"))
    classes = nodes.select(F.lit(7).alias("part"), "seq", F.concat(F.lit("    class "), nid, F.when(F.col("is_source"), " source").otherwise(" derived")).alias("line"))
    return fixed.unionByName(shapes).unionByName(arrows).unionByName(classes)


def mermaid(nodes: DataFrame, edges: DataFrame, direction: str = "LR", most: int = 4 * MOST) -> str:
    """The flowchart as one string, for graphs that a page can show."""
    return "\n".join(r["line"] for r in page_rows(mermaid_lines(nodes, edges, direction), most, "part", "seq", "line"))


def inventory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, is_source, upstream_count, downstream_count)."""
    return nodes.select("node", "is_source", "seq").join(closure_counts(nodes, edges), "node").select("node", "is_source", "upstream_count", "downstream_count", "seq")


def mapping_preview(mappings: Column, shown: int = 3) -> Column:
    """The first mappings as "target <- source", and how many more there are."""
    first = F.array_join(F.transform(F.slice(mappings, 1, shown), lambda m: F.concat(m["target_col"], F.lit(" ← "), m["source_expression"])), "; ")
    rest = F.size(mappings) - shown
    return F.concat(first, F.when(rest > 0, F.format_string(" +%d more", rest)).otherwise(""))


def _table(head: list[str], rows) -> str:
    cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in row) + "</tr>"
    return f"<table><thead>{cells('th', head)}</thead><tbody>{''.join(cells('td', r) for r in rows)}</tbody></table>"


def _page(title: str, *parts: str) -> str:
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}.chip{display:inline-block;margin-right:1em}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>"


def html_report(nodes: DataFrame, edges: DataFrame, title: str = "Data lineage report", most: int = MOST) -> str:
    """Counts, tables with the size of their closures, edges with their first mappings, and the flowchart; escaped."""
    links = page_rows(edges.select("src", "dst", "transformation_type", "pipeline_name", mapping_preview(F.col("column_mappings")).alias("m"), "seq"), most, "seq")
    page_rows(nodes.select("node"), most)  # before any closure is worked out
    tables = page_rows(inventory(nodes, edges), most, "seq")
    n_source = sum(t["is_source"] for t in tables)
    chips = "".join(f"<span class='chip'><b>{v}</b> {k}</span>" for k, v in (("tables", len(tables)), ("edges", len(links)), ("sources", n_source), ("derived", len(tables) - n_source)))
    return _page(
        title, f"<p>{chips}</p>", "<h2>Tables</h2>",
        _table(["Table", "Kind", "Upstream", "Downstream"], [(t["node"], "source" if t["is_source"] else "derived", t["upstream_count"], t["downstream_count"]) for t in tables]),
        "<h2>Edges</h2>", _table(["Source", "Target", "Kind", "Pipeline", "Columns"], [(e["src"], e["dst"], e["transformation_type"], e["pipeline_name"], e["m"]) for e in links]),
        f"<h2>Diagram</h2><pre class='mermaid'>{html.escape(mermaid(nodes, edges))}</pre>",
    )


def stats_chips(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, n): nodes of each system, then cross edges."""
    cross = edges.agg(F.lit("cross").alias("name"), F.count_if(F.col("system") == "cross").alias("n"))
    return coverage(nodes).withColumnRenamed("system", "name").unionByName(cross)


def _columns_of(nodes: list[str], links: list[tuple[str, str]]) -> dict[str, int]:
    """The column of each node in the drawing: the longest way from a start; nodes on a cycle share the last ones."""
    into = dict.fromkeys(nodes, 0)
    onward: dict[str, list[str]] = {n: [] for n in nodes}
    for s, d in links:
        if s in into and d in into and s != d:
            into[d] += 1
            onward[s].append(d)
    column = dict.fromkeys(nodes, 0)
    ready = [n for n in nodes if not into[n]]
    for n in ready:
        for d in onward[n]:
            column[d] = max(column[d], column[n] + 1)
            into[d] -= 1
            if not into[d]:
                ready.append(d)
    return column


def _drawing(nodes: list[dict], edges: list[dict]) -> str:
    """The graph as SVG: nodes in columns, a tooltip on each node and edge, cross-system edges dashed and named."""
    column = _columns_of([n["node"] for n in nodes], [(e["src"], e["dst"]) for e in edges])
    filled: dict[int, int] = {}
    at: dict[str, tuple[int, int]] = {}
    shapes, lines = [], []
    for n in nodes:
        c = column[n["node"]]
        x, y = 20 + 270 * c, 20 + 44 * filled.get(c, 0)
        filled[c] = filled.get(c, 0) + 1
        at[n["node"]] = x, y
        tip = "\n".join([n["full"], f"System: {n['system']}", f"Type: {n['node_type']}", *(f"{k}: {n[v]}" for k, v in (("Table", "table"), ("Format", "format")) if n[v])])
        shapes.append(
            f"<g class='node' tabindex='0' data-id='{html.escape(n['node'])}'><title>{html.escape(tip)}</title><rect x='{x}' y='{y}' width='210' height='30' rx='5' fill='{COLOURS.get(n['system'], '#999')}'/>"
            f"<text x='{x + 8}' y='{y + 20}'>{html.escape(n['label'])}</text></g>"
        )
    for e in edges:
        if e["src"] in at and e["dst"] in at:
            (x1, y1), (x2, y2) = at[e["src"]], at[e["dst"]]
            cross = e["system"] == "cross"
            style = "stroke-dasharray='6 4' stroke-width='2'" if cross else "stroke-width='1'"
            tip = html.escape(f"System: {e['system']}\nTransform: {e['transformation_type'] or ''}")
            lines.append(f"<path d='M{x1 + 210} {y1 + 15} C{x1 + 240} {y1 + 15} {x2 - 30} {y2 + 15} {x2} {y2 + 15}' fill='none' stroke='{COLOURS.get(e['system'], '#999')}' {style} marker-end='url(#arrow)'><title>{tip}</title></path>")
            if cross:
                lines.append(f"<text class='edge' x='{(x1 + 210 + x2) // 2}' y='{(y1 + y2) // 2 + 10}'>{html.escape(e['transformation_type'] or '')}</text>")
    width, height = 270 * (max(filled, default=0) + 1), 44 * max(filled.values(), default=1) + 30
    arrow = "<defs><marker id='arrow' viewBox='0 0 8 8' refX='8' refY='4' markerWidth='7' markerHeight='7' orient='auto'><path d='M0 0L8 4L0 8z'/></marker></defs>"
    return f"<svg id='graph' width='{width}' height='{height}' font-size='12'>{arrow}{''.join(lines)}{''.join(shapes)}</svg>"


#: Shows the facts, the neighbours and the code of a node that is picked in the drawing.
_SIDEBAR = """
const d=JSON.parse(document.getElementById('lineage-data').textContent),by=new Map(d.nodes.map(n=>[n.node,n])),box=document.getElementById('sidebar');
function line(t,v){const p=document.createElement('p'),b=document.createElement('b');b.textContent=t+': ';p.append(b,v||'none');box.append(p)}
function show(id){const n=by.get(id);box.replaceChildren();line('Node',n.label);line('System',n.system);line('Type',n.node_type);
line('From',d.edges.filter(e=>e.dst===id).map(e=>e.src).join(', '));line('To',d.edges.filter(e=>e.src===id).map(e=>e.dst).join(', '));
const c=document.createElement('pre');c.textContent=n.code||'';box.append(c)}
document.querySelectorAll('g.node').forEach(g=>{g.onclick=g.onfocus=()=>show(g.dataset.id)});
"""


def unified_html(nodes: DataFrame, edges: DataFrame, system: str | list[str] | None = None, title: str = "Cross-system lineage", hide_intermediate: bool = False, most: int = MOST) -> str:
    """A page with the nodes and edges of all systems or some: a drawing with tooltips, a sidebar for the node picked in it, and
    the same as tables for readers without scripts. ``hide_intermediate`` leaves out nodes of that type."""
    if system:
        nodes = nodes.where(F.col("system").isin([system] if isinstance(system, str) else system))
    if hide_intermediate:
        nodes = nodes.where(F.col("node_type") != "intermediate")
    if system or hide_intermediate:
        ids = nodes.select(F.col("node").alias("id"))
        edges = edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
    label = F.when(F.length("label") > 30, F.concat(F.substring("label", 1, 27), F.lit("..."))).otherwise(F.col("label"))
    about = lambda k: F.try_element_at("metadata", F.lit(k))
    shown = nodes.select("node", label.alias("label"), F.col("label").alias("full"), "system", "node_type", about("warehouse_table").alias("table"), about("format").alias("format"), F.substring(about("raw_sql"), 1, 3000).alias("code"), "seq")
    n = [r.asDict() for r in page_rows(shown, most, "seq")]
    e = [r.asDict() for r in page_rows(edges.select("src", "dst", "system", "transformation_type", "shared_path", "seq"), most, "seq")]
    chips = "".join(f"<span class='chip'><b>{r['n']}</b> {html.escape(r['name'])}</span>" for r in stats_chips(nodes, edges).orderBy("name").collect())
    data = json.dumps({"nodes": [{k: r[k] for k in ("node", "label", "system", "node_type", "code")} for r in n], "edges": [{k: r[k] for k in ("src", "dst", "system")} for r in e]}).replace("<", "\\u003c")
    return _page(
        title, f"<p>{chips}</p>", f"<div style='display:flex;gap:1em'><div style='overflow:auto;flex:3'>{_drawing(n, e)}</div><aside id='sidebar' style='flex:1'>Pick a node.</aside></div>",
        "<h2>Nodes</h2>", _table(["Id", "Label", "System", "Type"], [(r["node"], r["label"], r["system"], r["node_type"]) for r in n]),
        "<h2>Edges</h2>", _table(["Source", "Target", "System", "Kind", "Shared path"], [(r["src"], r["dst"], r["system"], r["transformation_type"], r["shared_path"]) for r in e]),
        f"<script type='application/json' id='lineage-data'>{data}</script><script>{_SIDEBAR}</script>",
    )


def node_grid(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.substring("node", 1, 40).alias("id"), F.substring("label", 1, 40).alias("label"), F.upper("system").alias("system"), F.col("node_type").alias("type"))


def edge_grid(edges: DataFrame) -> DataFrame:
    return edges.select(F.substring("src", 1, 40).alias("source"), F.substring("dst", 1, 40).alias("target"), F.upper("system").alias("system"), F.col("transformation_type").alias("type"))


def mapping_grid(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.inline("column_mappings"))


def impact_grid(impacted: DataFrame) -> DataFrame:
    return impacted.select(
        F.substring("label", 1, 40).alias("node"), F.upper("system").alias("system"), "severity", F.col("hop_distance").alias("hop"), F.substring("reason", 1, 60).alias("reason"), one_decimal(F.col("fix_hours")).alias("hours")
    )


def default_target(nodes: DataFrame) -> DataFrame:
    """The node offered first: the first whose id contains "source", else the first."""
    return nodes.select("node", "seq", F.contains(F.lower("node"), F.lit("source")).alias("s")).orderBy(F.desc("s"), "seq").limit(1).select("node")


def console_report(nodes: DataFrame, edges: DataFrame, impact: DataFrame, most: int = MOST) -> str:
    """Edges and the impact listing as lines of text."""
    lines = [f"{r['src']} -> {r['dst']} [{r['transformation_type']}]" for r in page_rows(edges, most, "seq")]
    lines += [f"hop {r['hop']}: {r['node']} ({' -> '.join(r['path'])})" for r in page_rows(impact, most, "hop", "node")]
    return "\n".join(lines)
