"""Memoised parsing with derivatives.

A language is a hash-consed expression; the derivative of an expression by a token class is the
language of what may follow. Every node keeps its derivatives, so a state met before costs one
dictionary lookup per token. The first token whose derivative is empty is the failing token; a text
whose last derivative is not nullable was cut off before its end.
"""

from __future__ import annotations


class Node:
    """One hash-consed expression. ``next`` memoises its derivatives by token class."""

    __slots__ = ("kind", "a", "b", "ident", "next", "null")

    def __init__(self, kind, a, b, ident):
        self.kind, self.a, self.b, self.ident = kind, a, b, ident
        self.next: dict = {}
        self.null = None


class Language:
    """Expressions, named rules and the memo of derivatives.

    The rules must not be left-recursive. ``limit`` bounds the memo: beyond it the table is dropped
    between two texts and grows anew, which changes no result.
    """

    def __init__(self, build, limit: int = 200_000):
        self.build, self.limit = build, limit
        self.reset()

    def reset(self) -> None:
        self.table: dict = {}
        self.rules: dict = {}
        self.empty = self._node("empty", None, None)
        self.eps = self._node("eps", None, None)
        self.start = self.build(self)

    def _node(self, kind, a, b) -> Node:
        key = (kind, a.ident if isinstance(a, Node) else a, b.ident if isinstance(b, Node) else b)
        node = self.table.get(key)
        if node is None:
            node = self.table[key] = Node(kind, a, b, len(self.table))
        return node

    def tok(self, t) -> Node:
        return self._node("tok", t, None)

    def ref(self, name: str) -> Node:
        return self._node("ref", name, None)

    def element(self, content: Node, opens, closing) -> Node:
        """Any opening token, then ``content``, then the closing token that belongs to it."""
        self.opens, self.closing = opens, closing
        return self._node("element", content, None)

    def seq(self, *parts: Node) -> Node:
        out = self.eps
        for p in reversed(parts):
            out = self._pair(p, out)
        return out

    def _pair(self, a: Node, b: Node) -> Node:
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        if a.kind == "seq":
            return self._node("seq", a.a, self._pair(a.b, b))
        return self._node("seq", a, b)

    def alt(self, *parts: Node) -> Node:
        flat: dict = {}
        for p in parts:
            for q in p.a if p.kind == "alt" else (p,):
                if q is not self.empty:
                    flat[q.ident] = q
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat.values()))
        key = ("alt", tuple(sorted(flat)), None)
        node = self.table.get(key)
        if node is None:
            node = self.table[key] = Node("alt", tuple(flat[i] for i in sorted(flat)), None, len(self.table))
        return node

    def star(self, a: Node) -> Node:
        return self.eps if a in (self.eps, self.empty) else self._node("star", a, None)

    def opt(self, *parts: Node) -> Node:
        return self.alt(self.eps, self.seq(*parts))

    def nullable(self, n: Node) -> bool:
        if n.null is None:
            k = n.kind
            if k in ("eps", "star"):
                n.null = True
            elif k == "seq":
                n.null = self.nullable(n.a) and self.nullable(n.b)
            elif k == "alt":
                n.null = any(self.nullable(x) for x in n.a)
            elif k == "ref":
                n.null = self.nullable(self.rules[n.a])
            else:
                n.null = False
        return n.null

    def derive(self, n: Node, t) -> Node:
        out = n.next.get(t)
        if out is None:
            k = n.kind
            if k == "tok":
                out = self.eps if n.a == t else self.empty
            elif k == "seq":
                out = self._pair(self.derive(n.a, t), n.b)
                if self.nullable(n.a):
                    out = self.alt(out, self.derive(n.b, t))
            elif k == "alt":
                out = self.alt(*[self.derive(x, t) for x in n.a])
            elif k == "star":
                out = self._pair(self.derive(n.a, t), n)
            elif k == "ref":
                out = self.derive(self.rules[n.a], t)
            elif k == "element" and self.opens(t):
                out = self._pair(n.a, self.tok(self.closing(t)))
            else:
                out = self.empty
            n.next[t] = out
        return out

    def run(self, classes) -> int | None:
        """None if the token classes form a text of the language, else the index of the failing
        token; the number of tokens stands for a text that ends too early."""
        if len(self.table) > self.limit:
            self.reset()
        s, empty = self.start, self.empty
        for i, t in enumerate(classes):
            n = s.next.get(t)
            if n is None:
                n = self.derive(s, t)
            if n is empty:
                return i
            s = n
        return None if self.nullable(s) else len(classes)
