"""Parsing with derivatives over hash-consed grammars.

The derivative of a language by a token is what may follow that token.  A
grammar is a graph of nodes (token, sequence, alternatives, repetition, rule);
taking derivatives token by token leads from the start rule to a node that
stands for the rest of the text.  An empty derivative marks the first token at
which no continuation exists; a node that isn't nullable at the end means that
the text stops too early.

Every node exists once (hash-consing) and remembers its derivatives, and
sequences are nested to the right, so that the derivative of a head doesn't
depend on what is stacked behind it.  Texts of one language pass through the
same nodes again and again; most steps are one dictionary lookup, and the
grammar turns into a lazily built pushdown automaton shared by all texts that
a worker sees.  The number of nodes is bounded by `bound`: beyond it the memo
is dropped and built anew.

Nodes are worked off on an explicit stack, so no nesting is too deep, and the
steps a text may take are bounded by `work` and its length: one that needs more
raises ``TooMuchWork`` instead of holding up a worker.

Rules must not be left-recursive; repetition takes its place.
"""

from __future__ import annotations

from dataclasses import dataclass

EMPTY, EPS, TOK, SEQ, ALT, STAR, REF = range(7)


class TooMuchWork(Exception):
    """A text exceeds the work allowed for one text."""


class Node:
    __slots__ = ("kind", "a", "b", "steps", "null", "at")

    def __init__(self, kind: int, a, b, at: int) -> None:
        self.kind, self.a, self.b, self.at = kind, a, b, at
        self.steps: dict[str, Node] = {}
        self.null: bool | None = True if kind in (EPS, STAR) else False if kind in (EMPTY, TOK) else None


@dataclass(frozen=True)
class Verdict:
    """ok; else the number of the failing token, which is the number of tokens if the text stops too early."""

    ok: bool
    token: int = -1
    truncated: bool = False


class Grammar:
    """Builds nodes; rules are named and may refer to each other."""

    def __init__(self, bound: int = 1_500_000, work: int = 3_000_000, per_token: int = 500) -> None:
        self.bound, self.work, self.per_token, self.rules, self.start = bound, work, per_token, {}, None
        self._reset()

    def _reset(self) -> None:
        self.nodes: dict[tuple, Node] = {}
        self.empty, self.eps = self._node(EMPTY), self._node(EPS)

    def _node(self, kind: int, a=None, b=None) -> Node:
        key = (kind, a.at if isinstance(a, Node) else a, b.at if isinstance(b, Node) else b)
        if kind == ALT:
            key = (ALT, tuple(x.at for x in a), None)
        node = self.nodes.get(key)
        if node is None:
            node = self.nodes[key] = Node(kind, a, b, len(self.nodes))
        return node

    # -- building -------------------------------------------------------------------------

    def tok(self, *names: str) -> Node:
        return self.alt(*(self._node(TOK, n) for n in names))

    def ref(self, name: str) -> Node:
        return self._node(REF, name)

    def _lift(self, x: Node | str) -> Node:
        return self.tok(x) if isinstance(x, str) else x

    def cat(self, a: Node, b: Node) -> Node:
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        heads = []
        while a.kind == SEQ:
            heads.append(a.a)
            a = a.b
        out = self._node(SEQ, a, b)
        for h in reversed(heads):
            out = self._node(SEQ, h, out)
        return out

    def seq(self, *parts: Node | str) -> Node:
        out = self.eps
        for p in reversed(parts):
            out = self.cat(self._lift(p), out)
        return out

    def alt(self, *options: Node | str) -> Node:
        """Alternatives, without empty and repeated ones; those with one continuation share it."""
        flat: dict[int, Node] = {}
        todo = [self._lift(o) for o in reversed(options)]
        while todo:
            o = todo.pop()
            if o.kind == ALT:
                todo.extend(o.a)
            elif o is not self.empty:
                flat[o.at] = o
        by_rest: dict[int, list[Node]] = {}
        for o in flat.values():
            if o.kind == SEQ:
                by_rest.setdefault(o.b.at, []).append(o)
        for group in by_rest.values():
            if len(group) > 1:
                for o in group:
                    del flat[o.at]
                joined = self.cat(self.alt(*(o.a for o in group)), group[0].b)
                flat[joined.at] = joined
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat.values()))
        return self._node(ALT, tuple(flat[i] for i in sorted(flat)))

    def star(self, a: Node | str) -> Node:
        a = self._lift(a)
        return self.eps if a in (self.empty, self.eps) else self._node(STAR, a)

    def plus(self, a: Node | str) -> Node:
        return self.seq(a, self.star(a))

    def opt(self, *parts: Node | str) -> Node:
        return self.alt(self.seq(*parts), self.eps)

    def listed(self, a: Node | str, sep: str = ",") -> Node:
        """One or more, separated."""
        return self.seq(a, self.star(self.seq(sep, a)))

    # -- deriving -------------------------------------------------------------------------

    def nullable(self, n: Node) -> bool:
        stack, working = [n], set()
        while n.null is None:
            x = stack[-1]
            if x.kind == ALT:
                parts = x.a
            elif x.kind == SEQ:
                parts = (x.a, x.b) if x.a.null else (x.a,)
            else:
                parts = (self.rules[x.a],)
            working.add(x.at)
            # a part that is being worked out already adds nothing to itself
            open_ = next((y for y in parts if y.null is None and y.at not in working), None)
            if open_ is not None and not (x.kind == ALT and any(y.null for y in parts)):
                stack.append(open_)
            elif x.kind == SEQ and x.a.null and len(parts) == 1:
                continue
            else:
                x.null = bool(parts[-1].null) if x.kind == SEQ and len(parts) == 2 else False if x.kind == SEQ else any(y.null for y in parts)
                stack.pop()
        return n.null

    def derive(self, n: Node, token: str) -> Node:
        stack = [n]
        while stack:
            x = stack[-1]
            if token in x.steps:
                stack.pop()
                continue
            kind = x.kind
            if kind == SEQ:
                need = (x.a, x.b) if self.nullable(x.a) else (x.a,)
            else:
                need = x.a if kind == ALT else (self.rules[x.a],) if kind == REF else (x.a,) if kind == STAR else ()
            todo = [y for y in need if token not in y.steps]
            if todo:
                stack.extend(todo)
                continue
            done = [y.steps[token] for y in need]
            if kind == SEQ:
                out = self.cat(done[0], x.b)
                out = self.alt(out, done[1]) if len(done) > 1 else out
            elif kind == ALT:
                out = self.alt(*done)
            elif kind == STAR:
                out = self.cat(done[0], x)
            else:
                out = done[0] if kind == REF else self.eps if kind == TOK and x.a == token else self.empty
            x.steps[token] = out
            stack.pop()
            self.left -= 1
            if self.left < 0:
                raise TooMuchWork
        return n.steps[token]

    def parse(self, tokens: list[str]) -> Verdict:
        if len(self.nodes) > self.bound:
            self.rebuild()
        self.left = self.work + self.per_token * len(tokens)
        n, at = self.start, 0
        for at, token in enumerate(tokens, 1):
            n = n.steps.get(token) or self.derive(n, token)
            if n is self.empty:
                return Verdict(False, at - 1)
        return Verdict(True) if self.nullable(n) else Verdict(False, at, True)

    def parse_shared(self, parts: list, walk: int = 20_000_000) -> tuple[Verdict, int]:
        """Verdict on tokens and runs of tokens (`parts` and `size`, at any depth), and the number of the failing part.

        What follows a run depends on the node before it only, so a run is walked once per node.  At most `walk` parts are walked,
        and fewer steps are allowed than for tokens: only nests that runs open and don't close lead to ever new nodes.
        """
        if len(self.nodes) > self.bound:
            self.rebuild()
        self.left = self.work // 10 + self.per_token * len(parts)
        after: dict[tuple, Node] = {}
        n, at, top = self.start, 0, -1
        frames = [(None, iter(parts))]
        while frames:
            key, rest = frames[-1]
            part = next(rest, None)
            if part is None:
                after[key] = n
                frames.pop()
                continue
            top += len(frames) == 1
            walk -= 1
            if walk < 0:
                raise TooMuchWork
            if isinstance(part, str):
                n = n.steps.get(part) or self.derive(n, part)
                if n is self.empty:
                    return Verdict(False, at), top
                at += 1
            elif (n, part) in after:
                n = after[n, part]
                at += part.size
            else:
                frames.append(((n, part), iter(part.parts)))
        return (Verdict(True) if self.nullable(n) else Verdict(False, at, True)), len(parts)

    def rebuild(self) -> None:
        """Drop all memos: build the rules anew."""
        self.rules = {}
        self._reset()
        self.define()

    def define(self) -> None:
        """Fill rules and start; grammars override it."""
        raise NotImplementedError
