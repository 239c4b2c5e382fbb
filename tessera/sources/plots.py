"""Figures as HTML with JSON traces, fed by small collected results."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path


def _numbers(values) -> list:
    return [None if v is None or v != v or v in (float("inf"), float("-inf")) else v for v in values]


def _same(**series) -> None:
    if len({len(v) for v in series.values() if v is not None}) > 1:
        raise ValueError(f"lengths differ: {', '.join(series)}")


def _rectangular(z) -> list[list]:
    if len({len(r) for r in z}) > 1:
        raise ValueError("rows of different lengths")
    return [_numbers(r) for r in z]


def _clean(d: dict) -> dict:
    """Without what is unset."""
    return {k: v for k, v in d.items() if v not in (None, {}, "")}


@dataclass
class Layout:
    title: str = ""
    width: int | None = None
    height: int | None = None
    xaxis: dict = field(default_factory=dict)
    yaxis: dict = field(default_factory=dict)
    annotations: list[dict] = field(default_factory=list)

    def json(self) -> dict:
        return _clean({"title": {"text": self.title} if self.title else None, "width": self.width, "height": self.height, "xaxis": self.xaxis, "yaxis": self.yaxis, "annotations": self.annotations or None})


class Figure:
    """Traces of 18 kinds and a layout."""

    def __init__(self) -> None:
        self.traces: list[dict] = []
        self.layout = Layout()

    def add(self, kind: str, **parts) -> "Figure":
        self.traces.append({"type": kind, **_clean(parts)})
        return self

    def scatter(self, x, y, name: str = "", mode: str = "markers", marker: dict | None = None) -> "Figure":
        _same(x=x, y=y)
        return self.add("scatter", x=_numbers(x), y=_numbers(y), name=name, mode=mode, marker=marker)

    def line(self, x, y, name: str = "", line: dict | None = None) -> "Figure":
        _same(x=x, y=y)
        return self.add("scatter", x=_numbers(x), y=_numbers(y), name=name, mode="lines", line=line)

    def bar(self, x, y, name: str = "", horizontal: bool = False) -> "Figure":
        _same(x=x, y=y)
        return self.add("bar", x=list(y if horizontal else x), y=list(x if horizontal else y), name=name, orientation="h" if horizontal else None)

    def heatmap(self, z, x=None, y=None, colorscale: str = "Viridis") -> "Figure":
        return self.add("heatmap", z=_rectangular(z), x=x, y=y, colorscale=colorscale)

    def pie(self, labels, values) -> "Figure":
        _same(labels=labels, values=values)
        return self.add("pie", labels=list(labels), values=_numbers(values))

    def surface(self, z) -> "Figure":
        return self.add("surface", z=_rectangular(z))

    def contour(self, z) -> "Figure":
        return self.add("contour", z=_rectangular(z))

    def box(self, y, name: str = "") -> "Figure":
        return self.add("box", y=_numbers(y), name=name)

    def violin(self, y, name: str = "") -> "Figure":
        return self.add("violin", y=_numbers(y), name=name)

    def histogram(self, x) -> "Figure":
        return self.add("histogram", x=_numbers(x))

    def histogram2d(self, x, y) -> "Figure":
        _same(x=x, y=y)
        return self.add("histogram2d", x=_numbers(x), y=_numbers(y))

    def ohlc(self, open_, high, low, close, x, kind: str = "ohlc") -> "Figure":
        _same(open=open_, high=high, low=low, close=close, x=x)
        return self.add(kind, open=_numbers(open_), high=_numbers(high), low=_numbers(low), close=_numbers(close), x=list(x))

    def candlestick(self, open_, high, low, close, x) -> "Figure":
        return self.ohlc(open_, high, low, close, x, "candlestick")

    def waterfall(self, x, y, measure) -> "Figure":
        _same(x=x, y=y, measure=measure)
        return self.add("waterfall", x=list(x), y=_numbers(y), measure=list(measure))

    def sunburst(self, ids, labels, parents, values, kind: str = "sunburst") -> "Figure":
        _same(ids=ids, labels=labels, parents=parents, values=values)
        return self.add(kind, ids=list(ids), labels=list(labels), parents=list(parents), values=_numbers(values))

    def treemap(self, ids, labels, parents, values) -> "Figure":
        return self.sunburst(ids, labels, parents, values, "treemap")

    def sankey(self, labels, source, target, value) -> "Figure":
        _same(source=source, target=target, value=value)
        return self.add("sankey", node={"label": list(labels)}, link={"source": list(source), "target": list(target), "value": _numbers(value)})

    def table(self, header, cells) -> "Figure":
        if any(len(r) != len(header) for r in cells):
            raise ValueError("a row differs from the header's length")
        return self.add("table", header={"values": list(header)}, cells={"values": [list(c) for c in zip(*cells)]})

    def set_layout(self, layout: Layout) -> "Figure":
        self.layout = layout
        return self

    def to_html(self) -> str:
        safe = lambda v: json.dumps(v).replace("</", "<\\/")
        title = (self.layout.title or "Figure").replace("&", "&amp;").replace("<", "&lt;")
        return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{title}</title><script src="plotly.min.js"></script></head><body><div id="figure"></div><script>Plotly.newPlot("figure", {safe(self.traces)}, {safe(self.layout.json())});</script></body></html>\n'

    def save_html(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(self.to_html(), encoding="utf-8")


def confusion_matrix_figure(matrix: Sequence[Sequence[int]], names: Sequence[str]) -> Figure:
    return Figure().heatmap(matrix, x=list(names), y=list(names)).set_layout(Layout("Confusion matrix", xaxis={"title": "Predicted"}, yaxis={"title": "True"}))


def roc_figure(fpr, tpr, auc: float) -> Figure:
    return Figure().line(fpr, tpr, name=f"AUC = {auc:.3f}").line([0, 1], [0, 1], name="chance", line={"dash": "dash"}).set_layout(Layout("ROC curve"))


def precision_recall_figure(precision, recall) -> Figure:
    return Figure().line(recall, precision, name="precision")


def feature_importance_figure(values, names, top: int) -> Figure:
    _same(values=values, names=names)
    best = sorted(range(len(values)), key=lambda i: -values[i])[:top]
    return Figure().bar([names[i] for i in best], [values[i] for i in best], horizontal=True)
