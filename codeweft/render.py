"""A graph as one self-contained HTML page."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions import lexical as L

#: A drawing of more nodes or edges can't be read; it is refused rather than cut.
MOST_NODES, MOST_EDGES = 20_000, 100_000

_PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>__TITLE__</title>
<style>body{margin:0;font:13px sans-serif}canvas{display:block}#tip{position:fixed;background:#fff;border:1px solid #999;padding:2px 6px;display:none}</style></head>
<body><canvas id="c"></canvas><div id="tip"></div><script>
const graph = __DATA__;
const canvas = document.getElementById('c'), tip = document.getElementById('tip'), ctx = canvas.getContext('2d');
const byId = new Map(graph.nodes.map((n, i) => { n.x = Math.cos(i * 2.4) * Math.sqrt(i + 1) * 14; n.y = Math.sin(i * 2.4) * Math.sqrt(i + 1) * 14; return [n.id, n]; }));
const links = graph.edges.map(e => ({ a: byId.get(e.src), b: byId.get(e.dst), type: e.type })).filter(e => e.a && e.b);
let scale = 1, ox = 0, oy = 0, heat = 1;
function step() {
  for (const e of links) { const dx = e.b.x - e.a.x, dy = e.b.y - e.a.y, d = Math.hypot(dx, dy) || 1, f = (d - 60) / d * 0.02 * heat; e.a.x += dx * f; e.a.y += dy * f; e.b.x -= dx * f; e.b.y -= dy * f; }
  heat *= 0.99;
}
function draw() {
  canvas.width = innerWidth; canvas.height = innerHeight; ctx.translate(innerWidth / 2 + ox, innerHeight / 2 + oy); ctx.scale(scale, scale);
  ctx.strokeStyle = '#bbb'; ctx.beginPath(); for (const e of links) { ctx.moveTo(e.a.x, e.a.y); ctx.lineTo(e.b.x, e.b.y); } ctx.stroke();
  for (const n of graph.nodes) { ctx.fillStyle = n.color; ctx.beginPath(); ctx.arc(n.x, n.y, 5, 0, 7); ctx.fill(); if (scale > 1.2) { ctx.fillStyle = '#222'; ctx.fillText(n.label, n.x + 7, n.y + 3); } }
  if (heat > 0.05) step(); requestAnimationFrame(draw);
}
onwheel = e => { scale *= e.deltaY < 0 ? 1.1 : 0.9; };
onmousemove = e => { if (e.buttons) { ox += e.movementX; oy += e.movementY; }
  const x = (e.clientX - innerWidth / 2 - ox) / scale, y = (e.clientY - innerHeight / 2 - oy) / scale, n = graph.nodes.find(n => Math.hypot(n.x - x, n.y - y) < 6);
  tip.style.display = n ? 'block' : 'none'; if (n) { tip.textContent = n.title; tip.style.left = e.clientX + 12 + 'px'; tip.style.top = e.clientY + 12 + 'px'; } };
draw();
</script></body></html>
"""


def html(nodes: DataFrame, edges: DataFrame, title: str = "code graph") -> str:
    """Label is the name, the tip `kind : file`, the colour that of the kind. Reads the graph to the driver, up to the
    limits above; one more raises."""
    n = nodes.select("id", F.col("name").alias("label"), F.concat_ws(" : ", "kind", "file_path").alias("title"), L.kind_colour(F.col("kind")).alias("color")).limit(MOST_NODES + 1).collect()
    e = edges.select("src", "dst", "type").limit(MOST_EDGES + 1).collect()
    if len(n) > MOST_NODES or len(e) > MOST_EDGES:
        raise ValueError(f"the graph is too large to draw (more than {MOST_NODES} nodes or {MOST_EDGES} edges); draw a part of it")
    data = json.dumps({"nodes": [r.asDict() for r in n], "edges": [r.asDict() for r in e]}).replace("</", "<\\/")
    return _PAGE.replace("__TITLE__", title.replace("<", "&lt;")).replace("__DATA__", data)
