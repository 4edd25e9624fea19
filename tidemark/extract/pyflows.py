"""Where values go within one scope of a Python file: rows that joins turn into a graph of values.

A place is (how, chain, part).  ``how`` is ``node`` for a local of the scope, whose chain is complete, or the way in which the chain is
to be resolved (``name``, ``absolute``, ``self``).  ``part`` is empty for a value, ``return`` for what a call gives, and for what a
call is given ``0``, ``1``, ..., ``k:name`` for keywords, ``@`` for the receiver and ``*`` for starred arguments.  What is part of a value is
taken for the value: an item, an attribute, an element that a loop binds.  Copies are new values.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

Place = tuple[str, str, str]

#: Methods that give a part of what they are called on, and built-in functions that give parts of their arguments.
PARTS_OF = frozenset({"get", "setdefault", "values", "items", "pop", "popitem", "popleft", "__getitem__"})
PASSED_ON = frozenset({"enumerate", "iter", "next", "reversed", "zip", "filter"})
#: Functions that change their first argument in place.
SETTERS = frozenset({"setattr", "delattr", "setitem", "delitem"})


class Scope:
    """The values of one function (or module, whose locals are its variables)."""

    def __init__(self, owner: str, hidden: set[str], globals_: set[str], local: dict[str, str], cls: str | None, me: str | None, mutators: frozenset[str]):
        self.owner, self.hidden, self.globals, self.local, self.cls, self.me, self.mutators = owner, hidden, globals_, local, cls, me, mutators
        self.bound: set[str] = set()  # locals that are bound mutators

    def named(self, chain: list[str]) -> Place:
        """The value behind a dotted chain."""
        head = chain[0]
        if head == self.me or (head in self.hidden and head not in self.globals):
            return "node", f"{self.owner}::{head}", ""
        if head in self.local:
            return "absolute", ".".join([self.local[head], *chain[1:]]), ""
        return "name", ".".join(chain), ""

    def callee(self, func: ast.expr) -> tuple[str, str] | None:
        """How a called function is to be resolved, and its chain; methods of unknown values are told by their name."""
        chain = _chain(func)
        if chain and len(chain) == 2 and chain[0] == self.me and self.cls:
            return "self", f"{self.cls}.{chain[1]}"
        if chain and not (chain[0] == self.me or (chain[0] in self.hidden and chain[0] not in self.globals)):
            how, full, _ = self.named(chain)
            return how, full
        return ("method", func.attr) if isinstance(func, ast.Attribute) else None

    def sources(self, e: ast.expr | None) -> list[Place]:
        """The places whose values an expression may give, or parts of them."""
        if isinstance(e, (ast.Name, ast.Attribute)):
            chain = _chain(e)
            return [self.named(chain)] if chain else self.sources(e.value)
        if isinstance(e, ast.Subscript):
            if isinstance(e.value, ast.Call) and getattr(e.value.func, "id", "") == "globals" and isinstance(e.slice, ast.Constant):
                return [("name", str(e.slice.value), "")]
            return self.sources(e.value)
        if isinstance(e, (ast.Await, ast.NamedExpr, ast.YieldFrom)):
            return self.sources(e.value)
        if isinstance(e, ast.IfExp):
            return self.sources(e.body) + self.sources(e.orelse)
        if isinstance(e, ast.BoolOp):
            return [s for x in e.values for s in self.sources(x)]
        if isinstance(e, (ast.Tuple, ast.List, ast.Set)):
            return [s for x in e.elts if not isinstance(x, ast.Starred) for s in self.sources(x)]
        if isinstance(e, ast.Dict):
            return [s for k, x in zip(e.keys, e.values, strict=True) if k is not None for s in self.sources(x)]
        if isinstance(e, (ast.ListComp, ast.SetComp, ast.GeneratorExp)):
            return self.sources(e.elt)
        if isinstance(e, ast.Call):
            name = getattr(e.func, "id", "")
            if isinstance(e.func, ast.Attribute) and e.func.attr in PARTS_OF:
                found = self.callee(e.func)  # it may be a function of a module that has such a name
                return self.sources(e.func.value) + ([(*found, "return")] if found and found[0] != "method" else [])
            if name in PASSED_ON and name not in self.hidden:
                return [s for x in e.args for s in self.sources(x)]
            if name == "getattr" and e.args:
                chain = _chain(e.args[0])
                if chain and len(e.args) > 1 and isinstance(e.args[1], ast.Constant):
                    return [self.named([*chain, str(e.args[1].value)])]
                return self.sources(e.args[0])
            found = self.callee(e.func)
            return [(*found, "return")] if found else []
        return []

    def flows(self, n: ast.AST) -> Iterator[tuple[Place, Place]]:
        """What a statement or expression hands from place to place, its inner ones left out."""
        if isinstance(n, (ast.Assign, ast.AnnAssign, ast.NamedExpr)) and n.value is not None:
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                yield from self._into(t, n.value)
        elif isinstance(n, (ast.For, ast.AsyncFor, ast.comprehension)):
            yield from self._into(n.target, n.iter)
        elif isinstance(n, ast.withitem) and n.optional_vars is not None:
            yield from self._into(n.optional_vars, n.context_expr)
        elif isinstance(n, (ast.Return, ast.Yield)):
            yield from ((s, ("node", f"{self.owner}::return", "")) for s in self.sources(n.value))
        elif isinstance(n, ast.Call):
            yield from self._given(n)

    def _into(self, target: ast.expr, value: ast.expr) -> Iterator[tuple[Place, Place]]:
        if isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                yield from self._into(t, value)
            return
        if isinstance(target, ast.Name) and isinstance(value, ast.Attribute) and value.attr in self.mutators:
            self.bound.add(target.id)
        for to in self.sources(target.value if isinstance(target, ast.Starred) else target):
            yield from ((s, to) for s in self.sources(value) if s != to)

    def _given(self, n: ast.Call) -> Iterator[tuple[Place, Place]]:
        if isinstance(n.func, ast.Attribute) and n.func.attr in self.mutators:  # what is put in becomes a part
            for to in self.sources(n.func.value):
                yield from ((s, to) for x in n.args if not isinstance(x, ast.Starred) for s in self.sources(x))
        found = self.callee(n.func)
        if not found:
            return
        for i, x in enumerate(n.args):
            part, value = ("*", x.value) if isinstance(x, ast.Starred) else (str(i), x)
            yield from ((s, (*found, part)) for s in self.sources(value))
        for k in n.keywords:
            yield from ((s, (*found, f"k:{k.arg}" if k.arg else "*")) for s in self.sources(k.value))
        if isinstance(n.func, ast.Attribute):
            yield from ((s, (*found, "@")) for s in self.sources(n.func.value))

    def writes(self, n: ast.AST, changed: list[ast.expr]) -> Iterator[Place]:
        """Places that hold what a statement or call changes in place; ``changed`` are the expressions that it does that to."""
        for x in changed:
            yield from self.sources(x)
        if isinstance(n, ast.Call):
            name = n.func.attr if isinstance(n.func, ast.Attribute) else getattr(n.func, "id", "")
            if name in SETTERS and n.args:
                yield from self.sources(n.args[0])
            if name in self.bound and isinstance(n.func, ast.Name):
                yield "node", f"{self.owner}::{name}", ""
        if isinstance(n, ast.AugAssign) and isinstance(n.target, ast.Name) and isinstance(n.value, (ast.List, ast.Set, ast.Dict, ast.ListComp, ast.SetComp)):
            yield self.named([n.target.id])


def _chain(node: ast.expr) -> list[str] | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return [node.id, *reversed(parts)] if isinstance(node, ast.Name) else None
