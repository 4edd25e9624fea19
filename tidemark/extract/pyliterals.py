"""Which texts come to which places within one scope of a Python file: rows that joins turn into a graph of literals.

Places are those of ``pyflows``; a ``[]`` behind their part stands for the elements of a container (the keys of a dict as well).  A value is
(how, chain, part, before, after): ``how`` is ``lit`` for a text, ``any`` for what is not followed, or that of a place whose texts get ``before`` and
``after`` around them.  Every way to bind a name that is not followed binds it to any, so a set of texts is never too small.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from tidemark.extract.pyflows import Scope, _chain

Value = tuple[str, str, str, str, str]
ANY: Value = ("any", "", "", "", "")
#: Built-in functions that give a container of their argument's elements, and those that do not change what they are given.
COPIES = frozenset({"sorted", "list", "tuple", "set", "frozenset", "reversed", "iter"})
HARMLESS = COPIES | frozenset({"len", "print", "isinstance", "dict", "enumerate", "zip", "any", "all", "min", "max", "sum", "repr", "str", "bool", "hasattr", "getattr", "type", "id", "map", "filter", "range"})
#: Mutators that put their arguments in, that put the elements of their arguments in, and that put nothing in.
PUT, SPREAD = frozenset({"append", "add", "insert", "appendleft", "setdefault"}), frozenset({"extend", "update", "extendleft"})
#: Calls that replace what their texts name, as tests do, and those that change the container they are given.
REPLACE, CHANGE = frozenset({"setattr", "delattr", "patch", "object", "multiple"}), frozenset({"setitem", "delitem", "dict"})
TAKE = frozenset({"pop", "popitem", "popleft", "clear", "remove", "discard", "sort", "reverse", "difference_update", "intersection_update", "rotate"})


def site(owner: str, n: ast.Call) -> str:
    """The node of the name that a lookup asks for."""
    return f"{owner}::?{n.lineno}.{n.col_offset}"


def asked_by(n: ast.Call) -> tuple[str, ast.expr | None] | None:
    """(function, the name it looks up) of a lookup whose name is no constant."""
    name = n.func.attr if isinstance(n.func, ast.Attribute) else getattr(n.func, "id", "")
    place = {"getattr": 1, "import_module": 0, "__import__": 0}.get(name)
    if place is None:
        return None
    return name, n.args[place] if len(n.args) > place and not any(isinstance(x, ast.Starred) for x in n.args) else None


class Literals:
    def __init__(self, scope: Scope, mutators: frozenset[str]):
        self.scope, self.mutators = scope, mutators

    def named(self, chain: list[str], part: str = "") -> list[Value]:
        how, full, _ = self.scope.named(chain)
        return [ANY] if how == "node" and len(chain) > 1 else [(how, full, part, "", "")]

    def values(self, e: ast.expr | None) -> list[Value]:
        """What texts an expression gives; numbers and the like are the text they are formatted as, containers none."""
        if e is None or isinstance(e, (ast.Tuple, ast.List, ast.Set, ast.Dict)):
            return []
        if isinstance(e, ast.Constant):
            return [("lit", e.value if isinstance(e.value, str) else str(e.value), "", "", "")]
        if isinstance(e, (ast.Name, ast.Attribute)):
            chain = _chain(e)
            return self.named(chain) if chain else [ANY]
        if isinstance(e, ast.Subscript):
            return [ANY] if isinstance(e.slice, ast.Slice) else self.elements(e.value)
        if isinstance(e, ast.NamedExpr):
            return self.values(e.value)
        if isinstance(e, ast.IfExp):
            return self.values(e.body) + self.values(e.orelse)
        if isinstance(e, ast.BoolOp):
            return [v for x in e.values for v in self.values(x)]
        if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Add):
            for text, other, left in ((e.left, e.right, True), (e.right, e.left, False)):
                if isinstance(text, ast.Constant) and isinstance(text.value, str):
                    return self.around(self.values(other), text.value if left else "", "" if left else text.value)
        if isinstance(e, ast.JoinedStr):
            holes = [i for i, x in enumerate(e.values) if isinstance(x, ast.FormattedValue)]
            if len(holes) < 2 and all(e.values[i].format_spec is None and e.values[i].conversion in (-1, 115) for i in holes):
                at = holes[0] if holes else len(e.values)
                text = lambda xs: "".join(str(x.value) for x in xs)
                return self.around(self.values(e.values[at].value), text(e.values[:at]), text(e.values[at + 1 :])) if holes else [("lit", text(e.values), "", "", "")]
        if isinstance(e, ast.Call):
            if isinstance(e.func, ast.Attribute) and e.func.attr in ("get", "pop") and e.args:
                return self.elements(e.func.value) + [v for x in e.args[1:] for v in self.values(x)]
            found = self.scope.callee(e.func)
            return [(*found, "return", "", "")] if found and found[0] != "method" else [ANY]
        return [ANY]

    @staticmethod
    def around(values: list[Value], before: str, after: str) -> list[Value]:
        return [v if v[0] == "any" else ("lit", before + v[1] + after, "", "", "") if v[0] == "lit" else (*v[:3], before + v[3], v[4] + after) for v in values]

    def elements(self, e: ast.expr) -> list[Value]:
        """What texts the elements of a container are."""
        if isinstance(e, ast.Constant) and not isinstance(e.value, (str, bytes)):
            return []
        if isinstance(e, (ast.Tuple, ast.List, ast.Set)):
            return [v for x in e.elts for v in (self.elements(x.value) if isinstance(x, ast.Starred) else self.values(x))]
        if isinstance(e, ast.Dict):
            return [v for k, x in zip(e.keys, e.values, strict=True) for v in (self.elements(x) if k is None else self.values(k) + self.values(x))]
        if isinstance(e, (ast.ListComp, ast.SetComp, ast.GeneratorExp)):
            return self.values(e.elt)
        if isinstance(e, ast.DictComp):
            return self.values(e.key) + self.values(e.value)
        if isinstance(e, (ast.Name, ast.Attribute)):
            chain = _chain(e)
            return self.named(chain, "[]") if chain else [ANY]
        if isinstance(e, ast.NamedExpr):
            return self.elements(e.value)
        if isinstance(e, ast.IfExp):
            return self.elements(e.body) + self.elements(e.orelse)
        if isinstance(e, ast.BoolOp):
            return [v for x in e.values for v in self.elements(x)]
        if isinstance(e, ast.BinOp) and isinstance(e.op, (ast.Add, ast.BitOr)):
            return self.elements(e.left) + self.elements(e.right)
        if isinstance(e, ast.Call):
            name = getattr(e.func, "id", "")
            if name in COPIES and name not in self.scope.hidden:
                return self.elements(e.args[0]) if e.args else []
            if isinstance(e.func, ast.Attribute) and e.func.attr in ("keys", "values", "copy") and not e.args:
                return self.elements(e.func.value)
            found = self.scope.callee(e.func)
            return [(*found, "return[]", "", "")] if found and found[0] != "method" else [ANY]
        return [ANY]

    def into(self, place: tuple[str, str, str], value: ast.expr | None) -> Iterator[tuple[Value, tuple[str, str, str]]]:
        """A place takes a value; a container has one set of elements, whatever name it goes by."""
        how, chain, part = place
        yield from ((v, place) for v in self.values(value))
        inner = (how, chain, f"{part}[]")
        for v in self.elements(value) if value is not None else []:
            yield v, inner
            if v[2].endswith("[]"):
                yield (*inner, "", ""), v[:3]

    def unknown(self, place: tuple[str, str, str]) -> Iterator[tuple[Value, tuple[str, str, str]]]:
        yield ANY, place
        yield ANY, (place[0], place[1], f"{place[2]}[]")

    def rows(self, nodes: list[ast.AST]) -> Iterator[tuple[Value, tuple[str, str, str]]]:
        """(value, the place that takes it) of all statements and expressions of a scope."""
        done: set[int] = set()
        for n in nodes:
            if isinstance(n, (ast.Assign, ast.AnnAssign, ast.NamedExpr)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        done.add(id(t))
                        yield from self.into(self.scope.named([t.id]), n.value)
                    elif isinstance(t, (ast.Subscript, ast.Attribute)):
                        yield from self.stored(t, n.value)
            elif isinstance(n, (ast.For, ast.comprehension)) and isinstance(n.target, ast.Name):
                done.add(id(n.target))
                to = self.scope.named([n.target.id])
                yield from ((v, to) for v in self.elements(n.iter))
                yield ANY, (to[0], to[1], "[]")
            elif isinstance(n, (ast.For, ast.comprehension)) and (pairs := self.paired(n.target, n.iter)):
                for t, values in pairs:
                    done.add(id(t))
                    to = self.scope.named([t.id])
                    yield from ((v, to) for v in values)
                    yield ANY, (to[0], to[1], "[]")
            elif isinstance(n, ast.AugAssign):
                if isinstance(n.target, ast.Name):
                    done.add(id(n.target))
                    to = self.scope.named([n.target.id])
                    yield ANY, to
                    yield from ((v, (to[0], to[1], "[]")) for v in self.elements(n.value))
                else:
                    yield from self.stored(n.target, None)
            elif isinstance(n, (ast.Return, ast.Yield, ast.YieldFrom)):
                to = ("node", f"{self.scope.owner}::return", "")
                yield from self.into(to, n.value) if isinstance(n, ast.Return) else self.unknown(to)
            elif isinstance(n, ast.Call):
                yield from self.call(n)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):  # nested ones: who calls them is not followed
                a = n.args
                for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]:
                    yield from self.unknown(("node", f"{self.scope.owner}::{x.arg}", ""))
                if not isinstance(n, ast.Lambda):
                    yield from self.unknown(self.scope.named([n.name]))
            elif (name := getattr(n, "name", None) or getattr(n, "rest", None)) and isinstance(name, str) and not isinstance(n, ast.alias):
                yield from self.unknown(self.scope.named([name]))  # exceptions, patterns, nested classes
        for n in nodes:
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store) and id(n) not in done:
                yield from self.unknown(self.scope.named([n.id]))

    def paired(self, target: ast.expr, source: ast.expr) -> list[tuple[ast.Name, list[Value]]]:
        """What the two names of a loop over ``enumerate(x)`` or ``x.items()`` take."""
        if not (isinstance(target, ast.Tuple) and len(target.elts) == 2 and all(isinstance(x, ast.Name) for x in target.elts) and isinstance(source, ast.Call)):
            return []
        if getattr(source.func, "id", "") == "enumerate" and "enumerate" not in self.scope.hidden and source.args:
            return [(target.elts[0], [ANY]), (target.elts[1], self.elements(source.args[0]))]
        if isinstance(source.func, ast.Attribute) and source.func.attr == "items" and not source.args:
            return [(x, self.elements(source.func.value)) for x in target.elts]
        return []

    def stored(self, t: ast.expr, value: ast.expr | None) -> Iterator[tuple[Value, tuple[str, str, str]]]:
        """What an assignment to an item or attribute puts in."""
        holder = t.value if isinstance(t, ast.Subscript) else t
        chain = _chain(holder)
        if not chain:
            if isinstance(holder, ast.Attribute):
                yield ANY, ("titled", holder.attr, "")
            return
        how, full, _ = self.scope.named(chain)
        if how == "node" and len(chain) > 1:  # it may be a variable of a module
            yield ANY, ("titled", chain[-1], "")
        elif isinstance(t, ast.Attribute):  # a variable of a module, or a function that another takes the place of
            yield ANY, ("titled", chain[-1], "")
        else:
            given = self.values(t.slice) + self.values(value) if value is not None and not isinstance(t.slice, ast.Slice) else [ANY]
            yield from ((v, (how, full, "[]")) for v in given)
        if isinstance(value, (ast.Name, ast.Attribute)) and (isinstance(t, ast.Subscript) or how == "node"):  # a container goes where it is not followed
            yield from ((ANY, v[:3]) for v in self.elements(value) if v[2])

    def call(self, n: ast.Call) -> Iterator[tuple[Value, tuple[str, str, str]]]:
        name = getattr(n.func, "id", "")
        if (asked := asked_by(n)) is not None:
            to = ("node", site(self.scope.owner, n), "")
            yield from ((v, to) for v in (self.values(asked[1]) if asked[1] is not None else [ANY]))
        last = n.func.attr if isinstance(n.func, ast.Attribute) else name
        if last in REPLACE:
            texts = [x.value for x in n.args[:2] if isinstance(x, ast.Constant) and isinstance(x.value, str)] + [k.arg for k in n.keywords if last == "multiple" and k.arg]
            yield from ((ANY, ("titled", x.rpartition(".")[2], "")) for x in texts)
            if not texts and n.args and (chain := _chain(n.args[0])) and self.scope.named(chain)[0] != "node":
                yield ANY, ("titled", "*", "")
        if last in CHANGE and isinstance(n.func, ast.Attribute) and n.args:
            yield from ((ANY, v[:3]) for v in self.elements(n.args[0]) if v[2])
            yield from ((ANY, ("titled", x.value.rpartition(".")[2], "")) for x in n.args[:1] if isinstance(x, ast.Constant) and isinstance(x.value, str))
        if name in HARMLESS and name not in self.scope.hidden:
            return
        if isinstance(n.func, ast.Attribute) and n.func.attr in self.mutators:
            chain = _chain(n.func.value)
            how, full, _ = self.scope.named(chain) if chain else ("", "", "")
            if not chain or (how == "node" and len(chain) > 1):
                last = n.func.value.attr if isinstance(n.func.value, ast.Attribute) else ""
                yield ANY, ("titled", last, "")
            else:
                kind = n.func.attr
                given = [] if kind in TAKE else [ANY]
                if kind in PUT:
                    given = [v for x in n.args for v in self.values(x)]
                elif kind in SPREAD:
                    given = [v for x in n.args for v in self.elements(x)] + [v for k in n.keywords for v in ([("lit", k.arg, "", "", "")] + self.values(k.value) if k.arg else self.elements(k.value))]
                yield from ((v, (how, full, "[]")) for v in given)
        found = self.scope.callee(n.func)
        for i, x in enumerate(n.args):
            if isinstance(x, ast.Starred) or any(isinstance(y, ast.Starred) for y in n.args[:i]):
                if found:
                    yield from self.unknown((*found, "*"))
            elif found:
                yield from self.into((*found, str(i)), x)
            else:
                yield from ((ANY, v[:3]) for v in self.elements(x) if v[2].endswith("[]"))
        for k in n.keywords:
            if found and k.arg:
                yield from self.into((*found, f"k:{k.arg}"), k.value)
            elif found:
                yield from self.unknown((*found, "*"))
            else:
                yield from ((ANY, v[:3]) for v in self.elements(k.value) if v[2].endswith("[]"))
