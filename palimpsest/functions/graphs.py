"""Drawing order of a directed graph: which edges go back, in which layer a node stands, and the order within layers."""

from __future__ import annotations

from collections import defaultdict

Edge = tuple[str, str]


def back_edges(edges: list[Edge], roots: list[str]) -> set[Edge]:
    """Edges to a node that is still open in a depth-first search; without them the graph has no cycle."""
    after: dict[str, list[str]] = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
    state: dict[str, int] = {}
    out: set[Edge] = set()
    for start in [*roots, *sorted(after)]:
        if start in state:
            continue
        state[start] = 1
        stack = [(start, iter(after[start]))]
        while stack:
            node, rest = stack[-1]
            nxt = next(rest, None)
            if nxt is None:
                state[node] = 2
                stack.pop()
            elif state.get(nxt) == 1:
                out.add((node, nxt))
            elif nxt not in state:
                state[nxt] = 1
                stack.append((nxt, iter(after[nxt])))
    return out


def layers(edges: list[Edge], roots: list[str]) -> dict[str, int]:
    """The longest way from a node without incoming edges, back edges left out."""
    back = back_edges(edges, roots)
    nodes = sorted({n for e in edges for n in e} | set(roots))
    waits, after = dict.fromkeys(nodes, 0), defaultdict(list)
    for a, b in set(edges) - back:
        waits[b] += 1
        after[a].append(b)
    out, free = dict.fromkeys(nodes, 0), [n for n in nodes if not waits[n]]
    while free:
        a = free.pop()
        for b in after[a]:
            out[b] = max(out[b], out[a] + 1)
            waits[b] -= 1
            if not waits[b]:
                free.append(b)
    return out


def order(edges: list[Edge], roots: list[str], sweeps: int = 4) -> list[list[str]]:
    """Nodes by layer; within a layer by the mean place of their neighbours above, then below, in turns."""
    layer = layers(edges, roots)
    rows: list[list[str]] = [[] for _ in range(max(layer.values(), default=-1) + 1)]
    for n in sorted(layer):
        rows[layer[n]].append(n)
    beside: dict[str, list[str]] = defaultdict(list)
    for a, b in edges:
        beside[a].append(b)
        beside[b].append(a)
    for sweep in range(sweeps):
        step = 1 if sweep % 2 == 0 else -1
        for i in range(len(rows)) if step > 0 else reversed(range(len(rows))):
            if 0 <= i - step < len(rows):
                at = {n: k for k, n in enumerate(rows[i - step])}
                own = {n: k for k, n in enumerate(rows[i])}

                def mean(n, at=at, own=own):
                    near = [at[m] for m in beside[n] if m in at]
                    return sum(near) / len(near) if near else own[n]

                rows[i].sort(key=lambda n: (mean(n), n))
    return rows
