"""Pipelines and graphs of components: one lazy plan, with a small job per component that learns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from tidewatch.operators.component import BaseAggregator, BaseDetector, BaseScorer, BaseThreshold, BaseTransformer, Component, Configurable, pack, unpack
from tidewatch.sources.series import Series

KINDS = ((BaseTransformer, "series"), (BaseScorer, "scores"), (BaseThreshold, "labels"), (BaseDetector, "labels"), (BaseAggregator, "labels"))
VERBS = {"transform": ("series",), "score": ("scores",), "detect": ("labels",)}


class Composite(Component):
    """The verb is that of the last part."""

    multivariate = True

    def _last(self) -> Component:
        raise NotImplementedError

    @property
    def output_kind(self) -> str:
        last = self._last()
        if isinstance(last, Composite):
            return last.output_kind
        return next(k for c, k in KINDS if isinstance(last, c))

    def _need(self, verb: str) -> None:
        if self.output_kind not in VERBS[verb]:
            raise TypeError(f"this {type(self).__name__} gives {self.output_kind}; it cannot {verb}")

    def transform(self, data: Any) -> Series:
        self._need("transform")
        return self.run(data)

    def score(self, data: Any) -> Series:
        self._need("score")
        return self.run(data)

    def detect(self, data: Any) -> Series:
        self._need("detect")
        return self.run(data)

    def fit_transform(self, data: Any) -> Series:
        self._need("transform")
        return self.fit_run(data)

    def fit_score(self, data: Any) -> Series:
        self._need("score")
        return self.fit_run(data)

    def fit_detect(self, data: Any) -> Series:
        self._need("detect")
        return self.fit_run(data)


class Pipeline(Composite):
    """Steps one after another: (name, component) pairs, or components."""

    def __init__(self, steps: Sequence[Any]):
        self.steps = list(steps)
        if not self.steps:
            raise ValueError("a pipeline has one step at least")
        names = [n for n, _ in self._named()]
        if len(set(names)) != len(names):
            raise ValueError("steps need distinct names")
        if any(isinstance(c, BaseAggregator) for _, c in self._named()):
            raise TypeError("an aggregator has several inputs; use a graph")

    def _named(self) -> list[tuple[str, Component]]:
        return [s if isinstance(s, tuple) else (f"{type(s).__name__.lower()}_{i}", s) for i, s in enumerate(self.steps)]

    @property
    def named_steps(self) -> dict[str, Component]:
        return dict(self._named())

    def _last(self) -> Component:
        return self._named()[-1][1]

    def _learn(self, series: Series) -> None:
        for name, c in (named := self._named()):
            c.fit(series)
            if (name, c) != named[-1]:
                series = c.run(series)

    def _compute(self, series: Series) -> Series:
        for _, c in self._named():
            series = c.run(series)
        return series

    def trace(self, data: Any) -> dict[str, Series]:
        series, out = Series.of(data), {}
        for name, c in self._named():
            out[name] = series = c.run(series)
        return out

    def summary(self) -> str:
        return "\n".join(f"{i + 1}. {n}: {c!r}" for i, (n, c) in enumerate(self._named()))

    def to_mermaid(self) -> str:
        names = ["input", *[n for n, _ in self._named()]]
        return "\n".join(["flowchart LR", *[f"    {a} --> {b}" for a, b in zip(names, names[1:], strict=False)]])


@dataclass
class Node(Configurable):
    """A component, where its input comes from, and which columns of it."""

    name: str
    model: Component
    inputs: tuple[str, ...] = ("input",)
    columns: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        self.inputs = (self.inputs,) if isinstance(self.inputs, str) else tuple(self.inputs)

    def clone(self) -> Node:
        return Node(self.name, self.model.clone(), self.inputs, self.columns)


class Graph(Composite):
    """Nodes that read the input or one another; just one feeds no other, and gives the result.

    Columns of several inputs are named ``{source}__{column}`` and joined on time."""

    def __init__(self, nodes: Sequence[Node]):
        self.nodes = list(nodes)
        self._order()

    def _order(self) -> list[Node]:
        names = [n.name for n in self.nodes]
        if not names or len(set(names)) != len(names) or "input" in names:
            raise ValueError("nodes need distinct names other than input")
        by = {n.name: n for n in self.nodes}
        for n in self.nodes:
            if unknown := [i for i in n.inputs if i != "input" and i not in by]:
                raise ValueError(f"{n.name} reads unknown {', '.join(unknown)}")
        used = {i for n in self.nodes for i in n.inputs}
        ends = [n.name for n in self.nodes if n.name not in used]
        order: list[Node] = []
        left = list(self.nodes)
        while left:
            ready = [n for n in left if all(i == "input" or any(o.name == i for o in order) for i in n.inputs)]
            if not ready:
                raise ValueError("the graph has a cycle")
            order += ready
            left = [n for n in left if n not in ready]
        if len(ends) != 1:
            raise ValueError(f"one node gives the result; here {len(ends)} do: {', '.join(ends)}")
        self._end = ends[0]
        return order

    @property
    def named_nodes(self) -> dict[str, Component]:
        return {n.name: n.model for n in self.nodes}

    def _last(self) -> Component:
        self._order()
        return self.named_nodes[self._end]

    def _input(self, node: Node, held: dict[str, Series]) -> Series:
        if len(node.inputs) == 1:
            series = held[node.inputs[0]]
            return series.select(*node.columns) if node.columns else series
        parts = [held[i].rename({c: f"{i}__{c}" for c in held[i].values}) for i in node.inputs]
        series = parts[0].join(*parts[1:])
        return series.select(*node.columns) if node.columns else series

    def _learn(self, series: Series) -> None:
        held = {"input": series}
        uses = [i for n in self.nodes for i in n.inputs]
        for node in self._order():
            given = self._input(node, held)
            node.model.fit(given)
            out = node.model.run(given)
            held[node.name] = out.persisted() if uses.count(node.name) > 1 else out

    def trace(self, data: Any) -> dict[str, Series]:
        """Every node's result."""
        held = {"input": Series.of(data)}
        for node in self._order():
            held[node.name] = node.model.run(self._input(node, held))
        del held["input"]
        return held

    def _compute(self, series: Series) -> Series:
        return self.trace(series)[self._end]

    def summary(self) -> str:
        return "\n".join(f"{n.name} <- {', '.join(n.inputs)}: {n.model!r}" for n in self._order())

    def to_mermaid(self) -> str:
        return "\n".join(["flowchart LR", *[f"    {i} --> {n.name}" for n in self._order() for i in n.inputs]])


__all__ = ["Graph", "Node", "Pipeline", "pack", "unpack"]
