"""Taxonomy similarity: pairs of names are scored once on the driver (the tree is small) and looked up in the plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .measures import Measure, static_table


@dataclass(frozen=True)
class Entry:
    name: str
    weight: float
    depth: int
    path: tuple[str, ...]

    @property
    def level(self) -> int:
        return self.depth + 1


class Taxonomy:
    """A rooted tree ``{"name", "weight"?, "children"?}``; children may be plain names, a name met again replaces the former."""

    def __init__(self, root):
        self.entries: dict[str, Entry] = {}

        def add(node, path):
            node = {"name": node} if isinstance(node, str) else node
            name = node["name"]
            path = (*path, name)
            self.entries[name] = Entry(name, float(node.get("weight", 1.0)), len(path) - 1, path)
            for child in node.get("children") or ():
                add(child, path)

        add(root, ())
        self.max_depth = max(e.depth for e in self.entries.values())

    def lca(self, a: Entry, b: Entry) -> Entry:
        name = [p for p, q in zip(a.path, b.path) if p == q][-1]
        return self.entries[name]


def wu_palmer() -> Callable:
    def f(tree, a, b):
        if a.depth + b.depth == 0:
            return 1.0
        return 2 * tree.lca(a, b).depth / (a.depth + b.depth)

    return f


def weights(source: str = "user", strategy: str = "optimistic") -> Callable:
    """``source``: ``user`` weights or ``auto`` (depth ratios); ``strategy`` decides where one node is above the other."""

    def f(tree, a, b):
        of = (lambda e: e.weight) if source == "user" else (lambda e: e.depth / tree.max_depth)
        top = tree.lca(a, b)
        if top.name in (a.name, b.name) and strategy != "pessimistic":
            return 1.0 if strategy == "optimistic" else (of(a) + of(b)) / 2
        return of(top)

    return f


def levels(strategy: str = "optimistic") -> Callable:
    def f(tree, a, b):
        low, high = sorted((a.level, b.level))
        return tree.lca(a, b).level / {"optimistic": low, "pessimistic": high, "average": (low + high) / 2}[strategy]

    return f


def paths(weight_up: float = 1.0, weight_down: float = 1.0) -> Callable:
    def f(tree, a, b):
        top, whole = tree.lca(a, b), tree.max_depth * (weight_up + weight_down)
        return (whole - ((a.depth - top.depth) * weight_up + (b.depth - top.depth) * weight_down)) / whole

    return f


def build(root, measure: Callable | None = None) -> Measure:
    """A measure of two names; a name that the tree does not have is an error."""
    tree, measure = Taxonomy(root), measure or wu_palmer()
    names = tree.entries.values()
    return static_table([(a.name, b.name, measure(tree, a, b)) for a in names for b in names], symmetric=False)
