"""Golden vectors: results in JSON files that a later run is compared with, and a card of a data set in HTML."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame


def rendered(value) -> str:
    """JSON that is the same for the same value: keys sorted, floats at full length, one newline at the end."""
    return json.dumps(value, sort_keys=True, indent=1, allow_nan=False) + "\n"


def write(folder: str | Path, vectors: dict[str, object]) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, value in vectors.items():
        (Path(folder) / f"{name}.json").write_text(rendered(value), encoding="utf-8", newline="\n")


def differences(folder: str | Path, vectors: dict[str, object]) -> list[str]:
    """Names whose file is missing or holds something else; line ends do not count."""
    out = []
    for name, value in vectors.items():
        path = Path(folder) / f"{name}.json"
        if not path.exists() or path.read_text(encoding="utf-8").replace("\r\n", "\n") != rendered(value):
            out.append(name)
    return out


def card(title: str, tables: dict[str, DataFrame], notes: list[str] = (), rows: int = 200) -> str:
    """A page that shows aggregated tables; the first rows of each in its order, and how many there are."""
    text = lambda v: "—" if v is None else html.escape(f"{v:.6g}" if isinstance(v, float) else str(v))
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    parts += [f"<p>{html.escape(n)}</p>" for n in notes]
    for name, df in tables.items():
        shown = df.limit(rows + 1).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{text(v)}</td>" for v in r) + "</tr>" for r in shown[:rows])
        more = f"<p>first {rows} rows</p>" if len(shown) > rows else ""
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>{more}")
    return "".join([*parts, "</body></html>\n"])
