"""JavaScript and TypeScript sources to symbols and unresolved references (EXT-9 to EXT-13).

A lexer and one pass over its tokens, for a declared subset: function, class, method and arrow declarations,
`import`, `export`, `require`, dynamic `import()`, calls, `new`, JSX tags, `extends`. Not read: computed members,
decorators' arguments as symbols, namespaces, and overload-only declarations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from graphloom.operators.extract_python import empty

EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
_LEX = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<template>`(?:[^`\\]|\\.)*`)|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<sign>=>|\?\.|\.\.\.|[{}()\[\];,<>:=.?!&|+\-*/%^~@#])",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_KEYWORDS = {
    "if", "for", "while", "switch", "catch", "return", "typeof", "new", "function", "class", "super", "await", "yield", "delete", "void", "in", "of", "instanceof", "do", "else", "case",
    "throw", "import", "export", "const", "let", "var", "default", "extends", "implements", "async", "static", "get", "set", "from", "as", "type", "interface", "enum", "this",
}
#: Words that are names where no declaration stands.
_SOFT = {"get", "set", "from", "as", "type", "of", "static", "async", "interface", "enum"}


@dataclass
class Token:
    kind: str
    text: str
    line: int


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    at, line = 0, 1
    while at < len(source):
        m = None
        if source[at] == "/" and source[at : at + 2] not in ("//", "/*") and (not out or out[-1].text in "=(,:[!&|?{};" or out[-1].text in ("return", "typeof", "case", "=>")):
            m = _REGEX.match(source, at)
        kind = "text" if m else ""
        m = m or _LEX.match(source, at)
        if not m:
            at += 1
            continue
        kind = kind or m.lastgroup
        if kind != "skip":
            out.append(Token(kind, m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return out


class _Scan:
    def __init__(self, source: str):
        self.t, self.out = tokens(source), empty()
        self.close = self._pairs()
        self.declared: set[int] = set()
        self.opened: dict[int, int] | None = None

    def _pairs(self) -> dict[int, int]:
        close, stack = {}, []
        for i, t in enumerate(self.t):
            if t.kind == "sign" and t.text in "([{":
                stack.append(i)
            elif t.kind == "sign" and t.text in ")]}" and stack:
                close[stack.pop()] = i
        return close

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < len(self.t) else ""

    def find(self, i: int, sign: str, stop: str = ";") -> int:
        """The next sign at this depth, or -1."""
        while i < len(self.t):
            if self.t[i].text == sign:
                return i
            if self.t[i].text in stop:
                return -1
            i = self.close.get(i, i) + 1
        return -1

    def symbol(self, name: str, kind: str, owner: str, first: int, last: int) -> str:
        q = f"{owner}.{name}" if owner else name
        self.out["symbols"].append({"name": name, "kind": kind, "qualname": q, "first": first, "last": last})
        return q

    # -- declarations
    def body(self, a: int, z: int, owner: str = "") -> None:
        """Statements of a module or of an immediately called function."""
        i = a
        while i < z:
            t = self.text(i)
            first = self.t[i].line
            if t == "export":
                if self.text(i + 1) == "{":
                    self.declared |= set(range(i, self.close.get(i + 1, i) + 1))
                i = self.export(i)
                continue
            if t == "import" and self.text(i + 1) not in ("(", "."):
                at, i = i, self.imported(i)
                self.declared |= set(range(at, i))
                continue
            if t in ("function", "class", "async"):
                j = self.declaration(i, owner, first)
                if j:
                    i = j
                    continue
            if t in ("const", "let", "var"):
                i = self.variables(i, z, owner, first)
                continue
            if t == "module" and self.text(i + 1) == "." and self.text(i + 2) == "exports" and self.text(i + 3) == "=":
                self.out["default_export"] = self.named(i + 4) or self.out["default_export"]
            if t == "(" and i in self.close and self.text(i + 1) in ("function", "async", "(") and self.text(self.close[i] + 1) == "(":
                b = self.find(i + 1, "{", ")")
                if b > 0:
                    self.body(b + 1, self.close.get(b, z), owner)
            i = self.close.get(i, i) + 1 if t in "([{" and self.kind(i) == "sign" else i + 1

    def named(self, i: int) -> str | None:
        """The name that an expression stands for: itself, or the argument of a wrapper such as memo(Foo)."""
        if self.kind(i) != "name":
            return None
        if self.text(i + 1) == "(" and self.kind(i + 2) == "name" and self.text(i + 3) in (")", ","):
            return self.text(i + 2)
        return self.text(i) if self.text(i) not in _KEYWORDS else None

    def declaration(self, i: int, owner: str, first: int) -> int | None:
        if self.text(i) == "async":
            i += 1
        if self.text(i) == "function":
            n = i + 2 if self.text(i + 1) == "*" else i + 1
            p = self.find(n, "(", ";{")
            b = self.find(self.close.get(p, p) + 1, "{") if p > 0 else -1
            if self.kind(n) != "name" or b < 0 or b not in self.close:
                return None
            self.declared.add(n)
            self.symbol(self.text(n), "Function", owner, first, self.t[self.close[b]].line)
            self.locals(p, b)
            return self.close[b] + 1
        if self.text(i) == "class":
            return self.class_(i, owner, first, self.text(i + 1) if self.kind(i + 1) == "name" and self.text(i + 1) not in ("extends", "implements") else None)
        return None

    def class_(self, i: int, owner: str, first: int, name: str | None) -> int | None:
        b = self.find(i + 1, "{")
        if b < 0 or b not in self.close:
            return None
        z = self.close[b]
        q = self.symbol(name, "Class", owner, first, self.t[z].line) if name else owner
        for k in range(i, b):
            if self.text(k) == "extends" and self.kind(k + 1) == "name":
                chain, _ = self.chain(k + 1)
                self.out["bases"].append({"class_qualname": q, "line": first, "name": chain[-1], "receiver": ".".join(chain[:-1]) or None})
                break
        k = b + 1
        while k < z:
            m = k
            while self.text(m) in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "*", "#") and self.text(m + 1) not in ("(", "="):
                m += 1
            if self.kind(m) == "name":
                p = m + 1
                if self.text(p) == "<":
                    p = self.find(p, "(", "{;")
                if self.text(p) == "(" and p in self.close:
                    e = self.find(self.close[p] + 1, "{", ";}")
                    if e > 0 and e in self.close:
                        self.declared.add(m)
                        self.symbol(self.text(m), "Method", q, self.t[k].line, self.t[self.close[e]].line)
                        self.locals(p, e)
                        k = self.close[e] + 1
                        continue
                e = self.find(m + 1, "=", ";{}(")
                if e > 0 and (last := self.function_value(e + 1)):
                    self.declared.add(m)
                    self.symbol(self.text(m), "Method", q, self.t[k].line, self.t[last].line)
                    k = last + 1
                    continue
            k = self.close.get(k, k) + 1
        return z + 1

    def function_value(self, i: int) -> int | None:
        """The last token of a function or arrow at i, or None."""
        if self.text(i) == "async":
            i += 1
        if self.text(i) == "function":
            p = self.find(i, "(", ";{")
            b = self.find(self.close.get(p, p) + 1, "{") if p > 0 else -1
            if b > 0 and b in self.close:
                self.locals(p, b)
                return self.close[b]
            return None
        p = i
        if self.text(i) == "(" and i in self.close:
            a = self.find(self.close[i] + 1, "=>", ";,)}{")
        elif self.kind(i) == "name" and self.text(i + 1) == "=>":
            a = i + 1
        else:
            return None
        if a < 0:
            return None
        if self.text(a + 1) == "{" and a + 1 in self.close:
            self.locals(p, a + 1)
            return self.close[a + 1]
        k = a + 1
        while k < len(self.t) and self.text(k) not in (";", ",", ")", "}", "]") and (self.t[k].line == self.t[max(a + 1, k - 1)].line or self.text(k) in (".", "?.")):
            k = self.close.get(k, k) + 1
        return min(k - 1, len(self.t) - 1)

    def defaults(self, n: int) -> set[int]:
        """Places of the default values in a pattern that opens at n."""
        out: set[int] = set()
        for k in range(n, self.close.get(n, n)):
            j = k + 1
            while self.text(k) == "=" and self.text(j) not in (",", "}", "]", ""):
                out |= set(range(j, self.close.get(j, j) + 1))
                j = self.close.get(j, j) + 1
        return out

    def pattern(self, n: int) -> set[str]:
        """Names that a pattern which opens at n binds."""
        other = self.defaults(n)
        return {self.text(k) for k in range(n + 1, self.close.get(n, n)) if self.kind(k) == "name" and k not in other and self.text(k + 1) != ":"}

    def variables(self, i: int, z: int, owner: str, first: int) -> int:
        n = i + 1
        if self.text(n) == "{" and n in self.close:
            e = self.close[n] + 1
            self.declared |= set(range(n, e)) - self.defaults(n)
            if self.text(e) == "=" and self.text(e + 1) == "require" and self.kind(e + 3) == "text":
                for member, local in self.braces(n):
                    self.bind(self.text(e + 3), local, member, first)
            return e
        if self.kind(n) != "name":
            return n
        e = self.find(n + 1, "=", ";,(){}")
        if e > 0:
            if last := self.function_value(e + 1):
                self.declared.add(n)
                self.symbol(self.text(n), "Function", owner, first, self.t[last].line)
                return last + 1
            if self.text(e + 1) == "class":
                self.class_(e + 1, owner, first, self.text(n))
            elif self.text(e + 1) == "require" and self.kind(e + 3) == "text":
                self.bind(self.text(e + 3), self.text(n), None, first)
            else:
                k = next((k for k in range(e + 1, min(e + 8, z)) if self.text(k) == "import" and self.text(k + 1) == "(" and self.kind(k + 2) == "text"), None)
                if k:
                    self.bind(self.text(k + 2), self.text(n), "default", first)
            return e + 1
        return n + 1

    def locals(self, p: int, b: int) -> None:
        """Parameters and variables of a function whose list opens at p and body at b."""
        z = self.close.get(b, b)
        first, last = self.t[b].line, self.t[z].line
        names = {self.text(k) for k in range(p, b) if self.kind(k) == "name" and self.text(k - 1) in ("(", ",", "{", "...") and self.text(k) not in _KEYWORDS} if self.text(p) == "(" else {self.text(p)}
        told = [k + 1 for k in range(b, z) if self.text(k) in ("const", "let", "var")]
        names |= {self.text(k) for k in told if self.kind(k) == "name"} | {x for k in told if self.text(k) in ("{", "[") for x in self.pattern(k)}
        self.out["locals"] += [{"name": n, "first": first, "last": last} for n in sorted(names)]

    # -- modules
    def bind(self, spec: str, local: str, member: str | None, line: int) -> None:
        self.out["imports"].append({"spec": spec[1:-1], "level": 0, "line": line, "local": local, "member": member, "first": None, "last": None})

    def braces(self, i: int) -> list[tuple[str, str]]:
        """(imported, local) of `{ a, b as c, d: e }`."""
        out, k = [], i + 1
        while k < self.close[i]:
            if self.text(k) == "type" and self.kind(k + 1) == "name" and self.text(k + 1) != "as":
                k += 1
            if self.kind(k) == "name":
                again = self.text(k + 1) in ("as", ":") and self.kind(k + 2) == "name"
                out.append((self.text(k), self.text(k + 2) if again else self.text(k)))
                k += 2 if again else 0
            k += 1
        return out

    def imports_file(self, k: int, line: int) -> None:
        """An import that binds no name: for its effect, or of what is exported again."""
        self.out["imports"].append({"spec": self.text(k)[1:-1], "level": 0, "line": line, "local": "", "member": None, "first": None, "last": None})

    def imported(self, i: int) -> int:
        line, k, names = self.t[i].line, i + 1, []
        if self.kind(k) == "text":
            self.imports_file(k, line)
            return k + 1
        while k < len(self.t) and self.text(k) not in ("from", ";"):
            if self.text(k) == "{" and k in self.close:
                names += [(m, n) for m, n in self.braces(k)]
                k = self.close[k]
            elif self.text(k) == "*" and self.text(k + 1) == "as":
                names.append((None, self.text(k + 2)))
                k += 2
            elif self.kind(k) == "name" and not (self.text(k) == "type" and self.text(k + 1) != "from"):
                names.append(("default", self.text(k)))
            k += 1
        if self.text(k) == "from" and self.kind(k + 1) == "text":
            for member, local in names:
                self.bind(self.text(k + 1), local, member, line)
            return k + 2
        return k + 1

    def export(self, i: int) -> int:
        k, first = i + 1, self.t[i].line
        if self.text(k) == "default":
            k += 1
            if self.text(k) in ("function", "class", "async"):
                n = next((j for j in range(k, k + 4) if self.kind(j) == "name" and self.text(j) not in ("function", "class", "async", "extends")), None)
                if n and self.text(n - 1) != "extends":
                    self.out["default_export"] = self.text(n)
                return self.declaration(k, "", first) or k + 1
            self.out["default_export"] = self.named(k) or self.out["default_export"]
            return k + 1
        if self.text(k) == "{" and k in self.close:
            e = self.close[k] + 1
            if self.text(e) == "from" and self.kind(e + 1) == "text":
                self.imports_file(e + 1, first)
                self.out["reexports"] += [{"spec": self.text(e + 1)[1:-1], "level": 0, "imported": m, "exported": n} for m, n in self.braces(k)]
                return e + 2
            known = {x["local"]: x for x in self.out["imports"]}
            for m, n in self.braces(k):
                if n == "default":
                    self.out["default_export"] = m
                if m in known:
                    self.out["reexports"].append({"spec": known[m]["spec"], "level": 0, "imported": known[m]["member"] or "*", "exported": n})
            return e
        if self.text(k) == "*":
            f = k + 3 if self.text(k + 1) == "as" else k + 1
            if self.text(f) == "from" and self.kind(f + 1) == "text":
                self.imports_file(f + 1, first)
                self.out["reexports"].append({"spec": self.text(f + 1)[1:-1], "level": 0, "imported": "*", "exported": self.text(k + 2) if f > k + 1 else "*"})
                return f + 2
        return self.declaration(k, "", first) or (self.variables(k, len(self.t), "", first) if self.text(k) in ("const", "let", "var") else k)

    # -- references
    def chain(self, i: int) -> tuple[list[str], int]:
        """a.b.c from its first name on, and the place behind."""
        out, k = [self.text(i)], i + 1
        while self.text(k) in (".", "?.") and self.kind(k + 1) == "name":
            out.append(self.text(k + 1))
            k += 2
        return out, k

    def tells_value(self, colon: int) -> bool:
        """Whether a value stands behind the colon, as in a choice or a member of an object, and not a type."""
        if self.text(colon - 1) == "?":
            return False
        opened, k = {z: a for a, z in self.close.items()} if self.opened is None else self.opened, colon - 1
        self.opened = opened
        while k >= 0:
            t = self.text(k)
            if t == "?" and self.text(k + 1) != ".":
                return True
            if t in (",", "{") and self.kind(k) == "sign":
                while k >= 0 and self.text(k) not in ("(", "{", "["):  # a member, if what is open around it is an object
                    k = opened.get(k, k) - 1
                return self.text(k) == "{"
            if t in (";", "(", "[", "}") and self.kind(k) == "sign" and k not in opened:
                return False
            k = opened.get(k, k) - 1
        return False

    def used(self, i: int, k: int) -> bool:
        """Whether the chain from i up to k stands where a value is used, by the signs around it."""
        before, after, then = self.text(i - 1), self.text(k), self.text(k + 1)
        if before == ":" and not self.tells_value(i - 1):
            return False
        if before not in ("(", ",", "=", ":", "[", "=>", "return", "{", "?", "|", "&", "!", "+", "..."):
            return False
        if after == "?":
            return then != ":"  # an optional parameter or member
        return after in (")", ",", "]", ";", "}", "|", "&", "+") or (after == ":" and before == "?") or (after == then == "=")

    def references(self) -> None:
        i = 0
        while i < len(self.t):
            t = self.t[i]
            if t.kind == "name" and self.text(i - 1) not in (".", "?.") and i not in self.declared and (t.text not in _KEYWORDS or t.text in ("this", "super") or (t.text in _SOFT and self.text(i + 1) in ("(", ".", "?."))):
                chain, k = self.chain(i)
                name, receiver = chain[-1], ".".join(chain[:-1]) or None
                if self.text(i - 1) == "<" and t.text[0].isupper() and self.text(i - 2) in ("(", "return", "=>", ">", "?", ":", "{", "&", "}", "=", "") :
                    self.out["calls"].append({"name": name, "receiver": receiver, "line": t.line})
                elif self.text(k) == "(" or self.text(i - 1) == "new":
                    if t.text not in ("this", "super") or receiver:
                        self.out["calls"].append({"name": name, "receiver": receiver, "line": t.line})
                elif t.text not in ("this", "super") and self.used(i, k):
                    self.out["values"].append({"name": name, "receiver": receiver, "line": t.line})
                i = k
                continue
            if t.text in (".", "?.") and self.kind(i + 1) == "name" and self.text(i + 2) == "(" and self.text(i - 1) in (")", "]"):
                self.out["calls"].append({"name": self.text(i + 1), "receiver": "?", "line": t.line})
            i += 1


def extract(source: str) -> dict:
    """Facts of a source; whatever the subset does not cover is passed over."""
    s = _Scan(source)
    s.body(0, len(s.t))
    s.references()
    return s.out
