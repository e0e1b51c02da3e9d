"""Python sources to symbols and unresolved references (EXT-2 to EXT-8, EXT-15/16), with the standard parser."""

from __future__ import annotations

import ast

FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPED = (*FUNCTION, ast.Lambda)
COMPREHENSION = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def empty() -> dict:
    return {"symbols": [], "imports": [], "calls": [], "bases": [], "values": [], "reexports": [], "locals": [], "aliases": [], "default_export": None, "error": None}


def first_line(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


def dotted(node: ast.AST) -> str | None:
    """a.b.c of plain names, `super` of super(), or None."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return head and f"{head}.{node.attr}"
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "super":
        return "super"
    return None


def reference(node: ast.AST) -> tuple[str, str | None] | None:
    """(name, receiver) of a name or attribute; the receiver of anything but plain names is `?`."""
    while isinstance(node, ast.Subscript):
        node = node.value
    if isinstance(node, ast.Name):
        return node.id, None
    return (node.attr, dotted(node.value) or "?") if isinstance(node, ast.Attribute) else None


def bound_names(node: ast.AST) -> set[str]:
    """Names that a function binds in its own scope, less those it declares global or nonlocal."""
    names: set[str] = set()
    free: set[str] = set()
    args = node.args
    for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg]:
        if a:
            names.add(a.arg)
    todo = list(node.body) if isinstance(node.body, list) else [node.body]
    while todo:
        n = todo.pop()
        if isinstance(n, (ast.Global, ast.Nonlocal)):
            free |= set(n.names)
        elif isinstance(n, (*FUNCTION, ast.ClassDef)):
            names.add(n.name)
            continue
        elif isinstance(n, (ast.Lambda, *COMPREHENSION)):
            continue
        elif isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del)):
            names.add(n.id)
        elif isinstance(n, ast.ExceptHandler) and n.name:
            names.add(n.name)
        elif isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name:
            names.add(n.name)
        todo += ast.iter_child_nodes(n)
    return names - free


def blocks(node: ast.stmt) -> list[list[ast.stmt]]:
    """The bodies of a statement: of if, try, with, for, while, match and their clauses."""
    own = [getattr(node, f, None) for f in ("body", "orelse", "finalbody")]
    clauses = [c.body for f in ("handlers", "cases") for c in getattr(node, f, [])]
    return [x for x in own + clauses if isinstance(x, list) and x]


class _Facts(ast.NodeVisitor):
    def __init__(self):
        self.out = empty()
        self.scope: list[tuple[int, int]] = []
        self.called: set[int] = set()

    # definitions: class bodies and every statement with a body of its own, but no function bodies; aliases only below if and try
    def define(self, body: list, owner: str = "", in_class: bool = False, aliases: bool = True) -> None:
        for node in body:
            if isinstance(node, (*FUNCTION, ast.ClassDef)):
                kind = "Class" if isinstance(node, ast.ClassDef) else "Method" if in_class else "Function"
                name = f"{owner}.{node.name}" if owner else node.name
                self.out["symbols"].append({"name": node.name, "kind": kind, "qualname": name, "first": first_line(node), "last": node.end_lineno})
                if kind == "Class":
                    for b in node.bases:
                        if r := reference(b):
                            self.out["bases"].append({"class_qualname": name, "line": node.lineno, "name": r[0], "receiver": r[1]})
                    self.define(node.body, name, True)
            elif inner := blocks(node):
                for part in inner:
                    self.define(part, owner, in_class, aliases and isinstance(node, (ast.If, ast.Try)))
            elif isinstance(node, ast.Assign) and aliases and not owner and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
                if (r := reference(node.value)) and isinstance(node.value, (ast.Name, ast.Attribute, ast.Subscript)):
                    self.out["aliases"].append({"alias": node.targets[0].id, "name": r[0], "receiver": r[1]})

    def _import(self, node, spec: str | None, level: int, local: str, member: str | None) -> None:
        first, last = self.scope[-1] if self.scope else (None, None)
        self.out["imports"].append({"spec": spec or "", "level": level, "line": node.lineno, "local": local, "member": member, "first": first, "last": last})

    def visit_Import(self, node):
        for a in node.names:
            self._import(node, a.name, 0, a.asname or a.name, None)

    def visit_ImportFrom(self, node):
        for a in node.names:
            self._import(node, node.module, node.level, a.asname or a.name, a.name)
            if not self.scope:
                self.out["reexports"].append({"spec": node.module or "", "level": node.level, "imported": a.name, "exported": a.asname or a.name})

    def _function(self, node):
        body = node.body if isinstance(node.body, list) else [node.body]
        first, last = (body[0].lineno, node.end_lineno) if isinstance(node.body, list) else (node.lineno, node.end_lineno)
        imported = {a.asname or a.name.split(".")[0] for n in ast.walk(node) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}
        self.out["locals"] += [{"name": n, "first": first, "last": last} for n in sorted(bound_names(node) - imported)]
        self.scope.append((first, last))
        self.generic_visit(node)
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = visit_Lambda = _function

    def _comprehension(self, node):
        names = {n.id for g in node.generators for n in ast.walk(g.target) if isinstance(n, ast.Name)}
        self.out["locals"] += [{"name": n, "first": node.lineno, "last": node.end_lineno} for n in sorted(names)]
        self.generic_visit(node)

    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = _comprehension

    def visit_ClassDef(self, node):
        for n in (*node.decorator_list, *node.keywords, *node.body):
            self.visit(n)

    def visit_Call(self, node):
        if isinstance(node.func, (ast.Name, ast.Attribute)):
            name, receiver = reference(node.func)
            self.out["calls"].append({"name": name, "receiver": receiver, "line": node.lineno})
            self.called.add(id(node.func))
        self.generic_visit(node)

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Load) and id(node) not in self.called and node.id != "super":
            self.out["values"].append({"name": node.id, "receiver": None, "line": node.lineno})

    def visit_Attribute(self, node):
        if isinstance(node.ctx, ast.Load) and id(node) not in self.called:
            name, receiver = reference(node)
            self.out["values"].append({"name": name, "receiver": receiver, "line": node.lineno})
        if dotted(node.value) is None:
            self.visit(node.value)
        elif isinstance(node.value, ast.Call):
            self.generic_visit(node.value)


def extract(source: str) -> dict:
    """Facts of a source; one that does not parse has an error and nothing else."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return empty() | {"error": f"syntax error: {e}"}
    f = _Facts()
    f.define(tree.body)
    f.visit(tree)
    return f.out


def declaration(source: str, first: int, last: int, most: int = 1024) -> str | None:
    """EXT-15: the exact text of a definition up to its body, if it is no longer than most bytes."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    lines = source.splitlines(keepends=True)
    for node in ast.walk(tree):
        if isinstance(node, (*FUNCTION, ast.ClassDef)) and first_line(node) == first and node.end_lineno == last:
            body = node.body[0]
            head = lines[first - 1 : first_line(body) - 1]
            if first_line(body) == body.lineno and body.lineno <= node.lineno or not head:
                head = [*lines[first - 1 : body.lineno - 1], lines[body.lineno - 1].encode()[: body.col_offset].decode()]
            text = "".join(head).rstrip()
            return text if len(text.encode()) <= most else None
    return None
