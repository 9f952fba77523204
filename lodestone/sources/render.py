"""Small result tables as text: CSV, Markdown, HTML, LaTeX and JSON."""

from __future__ import annotations

import csv
import html
import io
import json

from pyspark.sql import DataFrame

#: Rows that a rendered table holds at most; larger results are for ``df.write``.
MOST = 10_000


def render(df: DataFrame, kind: str = "markdown", digits: int = 4) -> str:
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rows; write the table instead")
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    head, body = df.columns, [[cell(v) for v in r] for r in rows]
    if kind == "json":
        return json.dumps([r.asDict(recursive=True) for r in rows], default=str)
    if kind == "csv":
        out = io.StringIO()
        csv.writer(out).writerows([head, *body])
        return out.getvalue()
    if kind == "markdown":
        return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *body])
    if kind == "html":
        line = lambda tag, r: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in r) + "</tr>"
        return "<table>" + line("th", head) + "".join(line("td", r) for r in body) + "</table>"
    if kind == "latex":
        safe = lambda c: "".join("\\" + x if x in "&%$#_{}" else x for x in c)
        return "\\begin{tabular}{" + "l" * len(head) + "}\n" + "\n".join(" & ".join(map(safe, r)) + r" \\" for r in [head, *body]) + "\n\\end{tabular}"
    raise ValueError(f"{kind}: unknown format")
