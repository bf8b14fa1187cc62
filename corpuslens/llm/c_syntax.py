"""Grammar and tokens of C and C++ translation units, after preprocessing."""

from __future__ import annotations

import re

from corpuslens.llm.derivatives import Grammar, TooMuchWork

#: Tokens that the macros of one text may give, and steps that it may take.
EXPANSION = 300_000
#: Steps for building the shared runs of one text, and those for each of its characters.
SHARING, SHARING_PER_CHARACTER = 10_000_000, 100

#: The keywords that the grammar tells apart, and the punctuators of both languages.
KEYWORDS = frozenset(
    "alignas alignof asm auto bool break case catch char class const const_cast constexpr continue decltype default delete do double "
    "dynamic_cast else enum explicit extern false final float for friend goto if inline int long mutable namespace new noexcept nullptr "
    "operator override private protected public register reinterpret_cast restrict return short signed sizeof static static_assert "
    "static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void "
    "volatile wchar_t while char16_t char32_t consteval constinit co_await co_return co_yield requires concept _Generic _Atomic __attribute__ __declspec".split()
)
#: Other spellings of keywords in C and in compilers' headers.
SPELLINGS = {
    "_Alignas": "alignas", "_Alignof": "alignof", "__alignof__": "alignof", "_Bool": "bool", "_Noreturn": "inline", "_Static_assert": "static_assert", "_Thread_local": "thread_local", "__thread": "thread_local",
    "__asm": "asm", "__asm__": "asm", "__attribute": "__attribute__", "__const": "const", "__const__": "const", "__inline": "inline", "__inline__": "inline",
    "__restrict": "restrict", "__restrict__": "restrict", "__signed__": "signed", "__typeof__": "decltype", "__volatile__": "volatile",
}
PUNCTUATORS = sorted("<<= >>= ... ->* <=> :: ++ -- -> .* << <= >= == != && || += -= *= /= %= &= |= ^= ## { } [ ] ( ) ; : ? . ~ ! + - * / % ^ & | = < > , #".split(), key=len, reverse=True)

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\f\v]+|\n|//[^\n]*|/\*[\s\S]*?\*/)
|(?P<raw>(?:u8|[uUL])?R"(?P<mark>[^()\\\s]{0,16})\([\s\S]*?\)(?P=mark)"(?:[A-Za-z_]\w*)?)
|(?P<str>(?:u8|[uUL])?"(?:\\[^\n]|[^"\\\n])*"(?:[A-Za-z_]\w*)?)
|(?P<chr>(?:u8|[uUL])?'(?:\\[^\n]|[^'\\\n])+')
|(?P<num>\.?[0-9](?:[eEpP][+-]|'?[0-9A-Za-z_.])*)
|(?P<id>[A-Za-z_$]\w*)
|(?P<op>"""
    + "|".join(map(re.escape, PUNCTUATORS))
    + r")",
    re.VERBOSE,
)
_NUMBER = re.compile(
    r"(?:0[xX][0-9a-fA-F']+(?:\.[0-9a-fA-F']*)?(?:[pP][+-]?[0-9]+)?|0[xX]\.[0-9a-fA-F']+[pP][+-]?[0-9]+|0[bB][01']+|(?:[0-9][0-9']*)?\.[0-9']+(?:[eE][+-]?[0-9]+)?|[0-9][0-9']*\.?(?:[eE][+-]?[0-9]+)?)"
    r"(?:[uUlLzZfF]{0,4}|_\w+|[a-z]{1,3})\Z"
)
_DIRECTIVE = re.compile(r"[ \t]*(?:/\*.*?\*/[ \t]*)*#[ \t]*([A-Za-z_]\w*)?(.*)", re.DOTALL)
_KNOWN = {"include", "include_next", "define", "undef", "if", "ifdef", "ifndef", "elif", "elifdef", "elifndef", "else", "endif", "pragma", "error", "warning", "line", "import", "ident", "embed"}
_COMMENT = re.compile(r'("(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')|//[^\n]*|/\*[\s\S]*?\*/')
_DEFINE = re.compile(r"\s*([A-Za-z_]\w*)(\(([^)]*)\))?\s*(.*)", re.DOTALL)


def _no_comments(s: str) -> str:
    return _COMMENT.sub(lambda m: m.group(1) or " ", s)


#: How tightly an operator of an #if expression binds.
_BINDS = {op: n for n, ops in enumerate([", ", "? :", "||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >>", "+ -", "* / %", "u! u~ u+ u-"]) for op in ops.split()} | {",": 0}


def _whole(n: int) -> int:
    """n as a signed number of 64 bits."""
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


def _calculate(op: str, a: int | None, b: int | None) -> int | None:
    """Value of two operands; None is one that can't be worked out."""
    if op == "&&" and a == 0 or op == "||" and a:
        return int(op == "||")
    if a is None or b is None or op in ("/", "%") and b == 0 or op in ("<<", ">>") and not 0 <= b < 64:
        return None
    if op in ("/", "%"):
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return _whole(q if op == "/" else a - q * b)
    return _whole({"||": lambda: bool(b), "&&": lambda: bool(b), "|": lambda: a | b, "^": lambda: a ^ b, "&": lambda: a & b, "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "<<": lambda: a << b, ">>": lambda: a >> b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, ",": lambda: b}[op]())


def _evaluate(items: list[int | str]) -> int | None:
    """Value of numbers and operators by two stacks; None if they are no expression."""
    values: list[int | None] = []
    ops: list[str] = []

    def apply() -> None:
        op = ops.pop()
        if op == "?":
            raise IndexError
        if op == ":":
            c, b, a = values.pop(), values.pop(), values.pop()
            values.append(None if a is None else b if a else c)
        elif op[0] == "u":
            a = values.pop()
            values.append(None if a is None else _whole({"u!": int(not a), "u~": ~a, "u+": a, "u-": -a}[op]))
        else:
            b, a = values.pop(), values.pop()
            values.append(_calculate(op, a, b))

    operand = True  # whether an operand must come next
    try:
        for x in items:
            if isinstance(x, int) or x == "(":
                if not operand:
                    return None
                operand = x == "("
                (ops if operand else values).append(x)
            elif operand:
                if "u" + x not in _BINDS:
                    return None
                ops.append("u" + x)
            elif x == ")":
                while ops[-1] != "(":
                    apply()
                ops.pop()
            else:
                right = x in ("?", ":")
                while ops and ops[-1] != "(" and (_BINDS[ops[-1]] > _BINDS[x] or not right and _BINDS[ops[-1]] == _BINDS[x] or x == ":" and ops[-1] == ":"):
                    apply()
                if x == ":":
                    if ops.pop() != "?":
                        return None
                ops.append(x)
                operand = True
        while ops:
            if ops[-1] == "(":
                return None
            apply()
    except (IndexError, KeyError):
        return None
    return values[0] if len(values) == 1 and not operand else None


class _Condition:
    """Value of an #if expression with unknown names 0; anything unreadable is false."""

    _TOKENS = re.compile(r"\s*(?:(0[xX][0-9a-fA-F]+|[0-9]+)[uUlL]*|(defined)\b|([A-Za-z_]\w*)|(\|\||&&|[=!<>]=|<<|>>|[-+*/%!~<>()&|^?:,]))")

    def value(self, text: str, defined: dict) -> bool:
        out, at, text = [], 0, _no_comments(text).strip()
        while at < len(text):
            m = self._TOKENS.match(text, at)
            if not m:
                return False
            at = m.end()
            if m[1]:
                if len(m[1]) > 30:
                    return False
                out.append(_whole(int(m[1], 0) if not re.fullmatch("0[0-9]+", m[1]) else int(m[1], 8) if re.fullmatch("[0-7]+", m[1]) else 0))
            elif m[2]:
                d = re.compile(r"\s*(?:\(\s*(\w+)\s*\)|(\w+))").match(text, at)
                if not d:
                    return False
                at = d.end()
                out.append(int((d[1] or d[2]) in defined))
            elif m[3]:
                call = re.compile(r"\s*\([^()]*\)").match(text, at) if m[3].startswith("__has") else None
                at = call.end() if call else at
                body = defined.get(m[3])
                out.append(int(body) if isinstance(body, str) and re.fullmatch(r"[0-9]{1,18}", body) else int(m[3] == "true"))
            else:
                out.append(m[4])
        return bool(_evaluate(out))


def tokens(code: str, shared: bool = False) -> tuple[list, list[int], bool]:
    """Token classes and lines of the preprocessed text, and whether it could be cut and preprocessed to its end.

    Raises TooMuchWork where macros exceed EXPANSION.  If `shared`, what a macro gives is one ``Run``, which is built once for
    all places, so the work doesn't depend on how many tokens there are.
    """
    code = re.sub(r"\\\r?\n", "", code.replace("\r\n", "\n").replace("﻿", ""))
    kinds: list[str] = []
    lines: list[int] = []
    macros: dict[str, tuple | str] = {}
    blocks: list[list[bool]] = []  # [active now, some branch taken, parent active, else seen]
    active, at, line, fresh = True, 0, 1, True
    n, budget = len(code), [SHARING + SHARING_PER_CHARACTER * len(code) if shared else EXPANSION]
    runs = _Runs(macros, budget) if shared else None

    def bad(where: int) -> tuple[list[str], list[int], bool]:
        kinds.append("BAD")
        lines.append(where)
        return kinds, lines, False

    while at < n:
        if fresh:
            fresh = False
            m = re.compile(r"[ \t\f\v\r]*#").match(code, at)
            if m:
                # a directive runs to the end of its line, or on behind a comment of several lines
                end = at
                while end < n and code[end] != "\n":
                    c = _COMMENT.match(code, end)
                    end = c.end() if c and c.end() > end else end + 1
                d = _DIRECTIVE.match(code[at:end])
                word, rest = d[1], _no_comments(d[2])
                here, line = line, line + code.count("\n", at, end)
                at = end
                if word in ("if", "ifdef", "ifndef"):
                    yes = active and (_Condition().value(rest, macros) if word == "if" else (rest.strip() in macros) == (word == "ifdef"))
                    if active and not rest.strip():
                        return bad(here)
                    blocks.append([yes, yes, active, False])
                    active = yes
                elif word in ("elif", "elifdef", "elifndef", "else"):
                    if not blocks or blocks[-1][3]:
                        return bad(here)
                    b = blocks[-1]
                    if word == "else":
                        yes, b[3] = True, True
                    elif word == "elif":
                        yes = _Condition().value(rest, macros)
                    else:
                        yes = (rest.strip() in macros) == (word == "elifdef")
                    b[0] = active = b[2] and not b[1] and yes
                    b[1] = b[1] or b[0]
                elif word == "endif":
                    if not blocks:
                        return bad(here)
                    active = blocks.pop()[2]
                elif active:
                    if word not in _KNOWN and (word or rest.strip()):
                        return bad(here)
                    if word == "define":
                        m = _DEFINE.match(rest)
                        if not m:
                            return bad(here)
                        if runs:
                            runs.forget()
                        macros[m[1]] = ([p.strip() for p in m[3].split(",")] if m[3].strip() else [], m[4].strip()) if m[2] else m[4].strip()
                    elif word == "undef":
                        if runs:
                            runs.forget()
                        macros.pop(rest.strip(), None)
                    elif word == "include" and not re.fullmatch(r"\s*(<[^>\n]+>|\"[^\"\n]+\"|[A-Za-z_]\w*.*)\s*", rest):
                        return bad(here)
                continue
        m = _TOKEN.match(code, at)
        if not m:
            if not active and code[at] != "/":
                at += 1
                continue
            return bad(line)
        text, at = m.group(), m.end()
        group = m.lastgroup if m.lastgroup != "mark" else "raw"
        if group == "space":
            if "\n" in text:
                line += text.count("\n")
                fresh = text == "\n"
            continue
        if not active:
            continue
        if group == "id" and text in macros and not isinstance(macros[text], str):
            args, end = _arguments(code, at)
            if args is not None:
                params, body = macros[text]
                line_here, line = line, line + code.count("\n", at, end)
                at = end
                ok = runs.call(body, dict(zip(params, args)), kinds) if runs else _expand(body, macros, dict(zip(params, args)), {text}, kinds, budget)
                lines.extend([line_here] * (len(kinds) - len(lines)))
                if not ok:
                    return bad(line)
                continue
        elif group == "id" and text in macros:
            ok = runs.name(text, kinds) if runs else _expand(macros[text], macros, {}, {text}, kinds, budget)
            lines.extend([line] * (len(kinds) - len(lines)))
            if not ok:
                return bad(line)
            continue
        kinds.append(_kind(group, text))
        lines.append(line)
        line += text.count("\n")
        if kinds[-1] == "BAD":
            return kinds, lines, False
    if blocks:
        return bad(line)
    kinds, lines = _without_attributes_shared(kinds, lines, budget) if shared else _without_attributes(kinds, lines)
    return kinds, lines, True


def _without_attributes(kinds: list[str], lines: list[int]) -> tuple[list[str], list[int]]:
    """Without compilers' attributes, which may stand almost anywhere; one whose brackets don't match stays, and fits no rule."""
    if "__attribute__" not in kinds and "__declspec" not in kinds:
        return kinds, lines
    keep, at = [], 0
    while at < len(kinds):
        end = at + 1
        if kinds[at] in ("__attribute__", "__declspec") and kinds[end : end + 1] == ["("]:
            depth = 1
            while depth and (end := end + 1) < len(kinds):
                depth += {"(": 1, ")": -1}.get(kinds[end], 0)
            if not depth:
                at = end + 1
                continue
        keep.append(at)
        at += 1
    return [kinds[i] for i in keep], [lines[i] for i in keep]


def _kind(group: str, text: str) -> str:
    if group == "id":
        text = SPELLINGS.get(text, text)
        return text if text in KEYWORDS else "ID"
    if group == "num":
        return "NUM" if _NUMBER.match(text) else "BAD"
    return {"raw": "STR", "str": "STR", "chr": "CHR"}.get(group, text)


def _arguments(code: str, at: int) -> tuple[list[str] | None, int]:
    """Arguments of a macro call that begins at `at`, None if there is none."""
    m = re.compile(r"\s*\(").match(code, at)
    if not m:
        return None, at
    depth, args, start, i = 1, [], m.end(), m.end()
    while i < len(code):
        c = _COMMENT.match(code, i)
        if c:
            i = c.end()
            continue
        if code[i] in "([{":
            depth += 1
        elif code[i] in ")]}":
            depth -= 1
            if not depth:
                args.append(code[start:i].strip())
                return args, i + 1
        elif code[i] == "," and depth == 1:
            args.append(code[start:i].strip())
            start = i + 1
        i += 1
    return None, at


def _expand(body: str, macros: dict, bound: dict[str, str], inside: set[str], kinds: list[str], budget: list[int]) -> bool:
    """Appends the token classes of a macro's body; budget[0] steps are left for the text."""
    at, paste = 0, 0
    if len(inside) > 500:
        raise TooMuchWork
    while at < len(body):
        budget[0] -= 1
        if budget[0] < 0:
            raise TooMuchWork
        m = _TOKEN.match(body, at)
        if not m:
            return False
        text, at = m.group(), m.end()
        group = m.lastgroup if m.lastgroup != "mark" else "raw"
        if group == "space":
            continue
        if text == "##":
            paste = len(kinds)
            continue
        if text == "#":
            m = _TOKEN.match(body, at)
            at = m.end() if m else at
            kinds.append("STR")
        elif group == "id" and text in bound:
            if not _expand(bound[text], macros, {}, inside, kinds, budget):
                return False
        elif group == "id" and text not in inside and isinstance(macros.get(text), str):
            if not _expand(macros[text], macros, {}, inside | {text}, kinds, budget):
                return False
        else:
            kinds.append(_kind(group, text))
        if paste and kinds[paste - 1 : paste + 1] in (["ID", "STR"], ["STR", "ID"]):  # a prefix or suffix of a literal
            kinds[paste - 1 : paste + 1] = ["STR"]
        paste = 0
    return True


_ATTRIBUTES = ("__attribute__", "__declspec")


def _kept(parts: list) -> list[int]:
    """Places of the parts outside attributes whose brackets open and close among these parts."""
    keep, at = [], 0
    while at < len(parts):
        end = at + 1
        if parts[at] in _ATTRIBUTES and parts[end : end + 1] == ["("]:
            depth = 1
            while depth and (end := end + 1) < len(parts):
                p = parts[end]
                if isinstance(p, Run) and depth + p.low <= 0:
                    break
                depth += p.depth if isinstance(p, Run) else {"(": 1, ")": -1}.get(p, 0)
            if not depth:
                at = end + 1
                continue
        keep.append(at)
        at += 1
    return keep


class Run:
    """Tokens that a macro gives: token classes and further runs, none of them empty; `whole` if they could be cut to the end."""

    __slots__ = ("parts", "whole", "size", "first", "last", "depth", "low", "attributes")

    def __init__(self, parts: list, whole: bool = True) -> None:
        parts = [p for p in parts if isinstance(p, str) or p.parts]
        if any(p in _ATTRIBUTES for p in parts):
            parts = [parts[i] for i in _kept(parts)]
        self.parts, self.whole = parts, whole
        self.size = self.depth = self.low = 0
        self.attributes = False  # whether one is left
        for p in parts:
            run = isinstance(p, Run)
            self.size += p.size if run else 1
            self.low = min(self.low, self.depth + (p.low if run else -(p == ")")))
            self.depth += p.depth if run else (p == "(") - (p == ")")
            self.attributes |= p.attributes if run else p in _ATTRIBUTES
        self.first = (parts[0].first if isinstance(parts[0], Run) else parts[0]) if parts else None
        self.last = (parts[-1].last if isinstance(parts[-1], Run) else parts[-1]) if parts else None

    def cut(self, end: int) -> Run:
        """Without the first token (0) or the last one (-1)."""
        spine, out = [self], []
        while isinstance(spine[-1].parts[end], Run):
            spine.append(spine[-1].parts[end])
        for r in reversed(spine):
            out = [Run(out + r.parts[1:] if end == 0 else r.parts[:-1] + out, r.whole)]
        return out[0]


class _Runs:
    """The runs of a text's macros, each built once per set of macros that may not be expanded in it."""

    def __init__(self, macros: dict, budget: list[int]) -> None:
        self.macros, self.budget = macros, budget
        self.items_of: dict[str, list[tuple[str, str]]] = {}
        self.forget()

    def forget(self) -> None:
        """A macro is about to change."""
        self.runs: dict[tuple, Run] = {}
        self.circles: dict[str, frozenset[str]] = {}

    def _spend(self, steps: int) -> None:
        self.budget[0] -= steps
        if self.budget[0] < 0:
            raise TooMuchWork

    def _items(self, body: str) -> list[tuple[str, str]]:
        """(what, text) of a body's tokens: name, kind, paste or stop."""
        if body not in self.items_of:
            at, out = 0, []
            while at < len(body):
                m = _TOKEN.match(body, at)
                if not m:
                    out.append(("stop", ""))
                    break
                text, at = m.group(), m.end()
                group = m.lastgroup if m.lastgroup != "mark" else "raw"
                if text == "#":
                    m = _TOKEN.match(body, at)
                    at = m.end() if m else at
                    out.append(("kind", "STR"))
                elif group != "space":
                    out.append(("paste", "") if text == "##" else ("name", text) if group == "id" else ("kind", _kind(group, text)))
            self._spend(len(body) // 4)
            self.items_of[body] = out
        self._spend(len(self.items_of[body]) + 1)
        return self.items_of[body]

    def _names(self, body: str) -> list[str]:
        return [x for what, x in self._items(body) if what == "name" and isinstance(self.macros.get(x), str)]

    def _circle(self, name: str) -> frozenset[str]:
        """Macros that lead to `name` and that it leads to (Tarjan): only they can be kept from being expanded in it."""
        order: dict[str, int] = {}
        low: dict[str, int] = {}
        path: list[str] = []
        todo = [] if name in self.circles else [(name, iter(self._names(self.macros[name])))]
        while todo:
            x, rest = todo[-1]
            if x not in order:
                order[x] = low[x] = len(order)
                path.append(x)
            for y in rest:
                if y in self.circles:
                    continue
                if y not in order:
                    todo.append((y, iter(self._names(self.macros[y]))))
                    break
                low[x] = min(low[x], order[y])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[x])
                if low[x] == order[x]:
                    at = path.index(x)
                    circle = frozenset(path[at:])
                    self.circles.update(dict.fromkeys(circle, circle))
                    del path[at:]
        return self.circles[name]

    def _key(self, name: str, inside: frozenset[str]) -> tuple:
        return name, inside & self._circle(name)

    def _run(self, wanted: list[tuple]) -> None:
        """Build the runs of these keys and of all that they need."""
        todo = list(wanted)
        while todo:
            key = todo[-1]
            if key in self.runs:
                todo.pop()
                continue
            body, inside = self.macros[key[0]], key[1] | {key[0]}
            need = [k for y in dict.fromkeys(self._names(body)) if y not in inside and (k := self._key(y, inside)) not in self.runs]
            if need:
                todo.extend(need)
            else:
                self.runs[key] = self._build(body, {}, inside)
                todo.pop()

    def _build(self, body: str, bound: dict[str, Run], inside: frozenset[str]) -> Run:
        parts: list = []
        paste = False
        for what, x in self._items(body):
            if what == "stop":
                return Run(parts, False)
            if what == "paste":
                paste = True
                continue
            piece: Run | str = x
            if what == "name":
                expanded = x not in inside and isinstance(self.macros.get(x), str)
                piece = bound[x] if x in bound else self.runs[self._key(x, inside)] if expanded else _kind("id", x)
            if paste and parts:  # a prefix or suffix of a literal
                run, last = isinstance(piece, Run), parts[-1]
                ends = (last.last if isinstance(last, Run) else last, piece.first if run else piece)
                if ends == ("ID", "STR"):
                    parts[-1:] = [last.cut(-1)] if isinstance(last, Run) and last.size > 1 else []
                elif ends == ("STR", "ID"):
                    piece = piece.cut(0) if run else Run([])
            paste = False
            if isinstance(piece, str) or piece.parts:
                parts.append(piece)
            if isinstance(piece, Run) and not piece.whole:
                return Run(parts, False)
        return Run(parts)

    def _of_text(self, body: str, bound: dict[str, Run]) -> Run:
        self._run([self._key(x, frozenset()) for x in dict.fromkeys(self._names(body)) if x not in bound])
        return self._build(body, bound, frozenset())

    def name(self, name: str, kinds: list) -> bool:
        """Append the run of a macro without arguments."""
        key = self._key(name, frozenset())
        self._run([key])
        kinds.append(self.runs[key])
        return self.runs[key].whole

    def call(self, body: str, bound: dict[str, str], kinds: list) -> bool:
        """Append the run of a macro with arguments."""
        key = (body, tuple(bound.items()))
        if key not in self.runs:
            self.runs[key] = self._of_text(body, {p: self._of_text(a, {}) for p, a in bound.items()})
        kinds.append(self.runs[key])
        return self.runs[key].whole


def _without_attributes_shared(parts: list, lines: list[int], budget: list[int]) -> tuple[list, list[int]]:
    """The same over runs; where an attribute begins in one and ends outside, all of them are written out."""
    keep = [i for i in _kept(parts) if isinstance(parts[i], str) or parts[i].parts]
    parts, lines = [parts[i] for i in keep], [lines[i] for i in keep]
    if not any(p.attributes if isinstance(p, Run) else p in _ATTRIBUTES for p in parts):
        return parts, lines
    out: list[str] = []
    out_lines: list[int] = []
    todo = list(zip(reversed(parts), reversed(lines)))
    while todo:
        budget[0] -= 1
        if budget[0] < 0:
            raise TooMuchWork
        p, line = todo.pop()
        if isinstance(p, Run):
            todo.extend((q, line) for q in reversed(p.parts))
        else:
            out.append(p)
            out_lines.append(line)
    return _without_attributes(out, out_lines)


class CGrammar(Grammar):
    """One grammar for both languages; names are not resolved, so what may be a type or a value may be either."""

    def __init__(self) -> None:
        super().__init__()
        self.define()

    def define(self) -> None:
        seq, alt, star, plus, opt, tok, ref, listed = self.seq, self.alt, self.star, self.plus, self.opt, self.tok, self.ref, self.listed
        r = self.rules
        attrs = star(alt(seq("[", "[", star(ref("balanced")), "]", "]"), seq("alignas", "(", ref("type_or_expr"), ")")))
        expr, assign, type_id, init_list, block, statement = ref("expr"), ref("assign"), ref("type_id"), ref("init_list"), ref("block"), ref("statement")
        punct = [p for p in PUNCTUATORS if p not in ("(", ")", "[", "]", "{", "}", "#", "##")]
        r["balanced"] = alt(tok("ID", "NUM", "STR", "CHR", *KEYWORDS, *punct), *(seq(a, star(ref("balanced")), b) for a, b in ("()", "[]", "{}")))
        ident = tok("ID", "final", "override")

        # names: a::b<c>::d
        targ = alt(type_id, ref("no_greater"), seq(type_id, "..."))
        r["targs"] = seq("<", opt(listed(targ)), ">")
        part = seq(ident, opt(ref("targs")))
        r["qualified"] = seq(opt("::"), part, star(seq("::", opt("template"), part)))
        overload = alt(
            tok(*(p for p in PUNCTUATORS if p not in ("#", "##", "(", ")", "[", "]", "{", "}", ";", ":", "::", "?", ".", "..."))), seq(">", ">"), seq("(", ")"), seq("[", "]"), seq(tok("new", "delete"), opt("[", "]")), seq("STR", "ID"), ref("type_spec_ptr")
        )
        operator_id = seq("operator", overload)
        unqualified = alt(part, seq("~", part), operator_id)
        r["declared"] = seq(opt("::"), star(seq(part, "::")), unqualified)
        r["id_expr"] = alt(ref("qualified"), seq(opt("::"), star(seq(part, "::")), alt(operator_id, seq("~", part))))

        # types
        builtin = tok("void", "bool", "char", "wchar_t", "char16_t", "char32_t", "short", "int", "long", "float", "double", "signed", "unsigned")
        cv = tok("const", "volatile", "restrict", "_Atomic")
        storage = tok("static", "extern", "inline", "constexpr", "consteval", "constinit", "mutable", "register", "thread_local", "virtual", "explicit", "friend", "typedef")
        flag = alt(cv, storage, seq("explicit", "(", expr, ")"))
        tagged = seq(tok("struct", "class", "union", "enum"), attrs, ref("qualified"))
        named = alt(seq(opt("typename"), ref("qualified")), tagged, seq("decltype", "(", ref("type_or_expr"), ")"), seq("_Atomic", "(", type_id, ")"), "auto")
        mixed = lambda f: alt(seq(star(f), builtin, star(alt(f, builtin))), seq(star(f), named, star(f)), seq(star(f), ref("definition"), star(f)))
        r["type_spec"] = mixed(cv)
        r["decl_spec"] = seq(attrs, mixed(flag))
        pointer = seq(alt(tok("*", "&", "&&"), seq(ref("qualified"), "::", "*")), star(alt(cv, "noexcept")))
        r["type_spec_ptr"] = seq(ref("type_spec"), star(pointer))
        r["pointers"] = star(pointer)
        array = seq("[", opt(alt(expr, seq(tok("static", "const"), opt(expr)))), "]")
        noexcept = seq("noexcept", opt("(", expr, ")"))
        after_params = star(alt(cv, tok("&", "&&", "override", "final"), noexcept, seq("throw", "(", opt(listed(type_id)), ")"), seq("[", "[", star(ref("balanced")), "]", "]")))
        trailing = opt("->", ref("type_spec_ptr"))
        r["params"] = seq("(", alt(self.eps, seq(listed(ref("param")), opt(opt(","), "...")), "..."), ")")
        r["param"] = seq(attrs, opt("this"), ref("decl_spec"), alt(ref("declarator"), ref("abstract")), opt("=", alt(assign, init_list)))
        function = seq(ref("params"), after_params, trailing)
        suffix = alt(function, array)
        r["declarator"] = seq(ref("pointers"), opt("..."), alt(seq(ref("declared"), attrs), seq("(", ref("declarator"), ")")), star(suffix))
        r["abstract"] = seq(ref("pointers"), opt("..."), alt(seq(opt("(", ref("abstract"), ")"), star(suffix))))
        r["type_id"] = seq(ref("type_spec"), ref("abstract"))
        r["type_or_expr"] = alt(type_id, expr)

        # expressions
        r["init_list"] = seq("{", opt(listed(ref("init_item")), opt(",")), "}")
        designator = plus(alt(seq(".", ident), seq("[", expr, "]")))
        r["init_item"] = alt(seq(alt(assign, init_list), opt("...")), seq(designator, alt(seq("=", alt(assign, init_list)), init_list)))
        args = seq("(", opt(listed(seq(alt(assign, init_list), opt("...")))), ")")
        capture = alt("=", "&", seq(tok("*"), "this"), "this", seq(opt("&"), opt("..."), ident, opt("..."), opt(alt(seq("=", assign), init_list, args))))
        lambda_ = seq("[", opt(listed(capture)), "]", opt("<", listed(ref("tparam")), ">"), opt(ref("params")), star(alt(tok("mutable", "constexpr", "consteval", "static"), noexcept)), trailing, block)
        new = seq(opt("::"), "new", opt(args), alt(seq("(", type_id, ")"), seq(ref("type_spec"), ref("pointers"), star(seq("[", opt(expr), "]")))), opt(alt(args, init_list)))
        cast = seq(tok("static_cast", "dynamic_cast", "reinterpret_cast", "const_cast"), "<", type_id, ">", "(", expr, ")")
        r["primary"] = alt(
            tok("NUM", "CHR", "true", "false", "nullptr", "this"),
            plus("STR"),
            ref("id_expr"),
            seq("(", expr, ")"),
            seq("(", block, ")"),
            lambda_,
            cast,
            seq("typeid", "(", ref("type_or_expr"), ")"),
            seq(plus(builtin), alt(args, init_list)),
            seq("typename", ref("qualified"), alt(args, init_list)),
            seq("decltype", "(", expr, ")", alt(args, init_list)),
            seq(ref("qualified"), init_list),
            seq("(", type_id, ")", init_list),
            seq("_Generic", "(", assign, plus(seq(",", alt(type_id, "default"), ":", assign)), ")"),
        )
        folded = alt(ref("binop"), ",")
        fold = alt(seq("(", "...", folded, assign, ")"), seq("(", ref("chain"), folded, "...", opt(folded, ref("chain")), ")"))
        member = seq(tok(".", "->"), opt("template"), alt(ref("id_expr"), seq("~", ident)))
        postfix = alt(args, seq("[", opt(listed(alt(assign, init_list))), "]"), member, tok("++", "--"))
        prefix = alt(tok("+", "-", "!", "~", "*", "&", "&&", "++", "--", "co_await"), seq("(", type_id, ")"))
        sizeof = alt(seq(tok("sizeof", "alignof"), "(", type_id, ")"), seq("sizeof", "...", "(", ident, ")"))
        delete = seq(opt("::"), "delete", opt("[", "]"))
        r["unary"] = seq(star(alt(prefix, "sizeof", delete)), alt(seq(alt(ref("primary"), fold), star(postfix)), sizeof, seq(new, star(postfix)), seq("noexcept", "(", expr, ")")))
        most = ["+", "-", "*", "/", "%", "^", "&", "|", "&&", "||", "==", "!=", "<=", ">=", "<=>", "<<", "<", ".*", "->*"]
        r["binop"] = alt(tok(*most, ">", "=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="), seq(">", ">"))
        r["no_greater"] = seq(ref("unary"), star(seq(tok(*most), ref("unary"))), opt("?", expr, ":", ref("no_greater")))
        r["chain"] = seq(ref("unary"), star(seq(ref("binop"), ref("unary"))))
        r["assign"] = alt(seq(ref("chain"), opt(alt(seq("?", opt(expr), ":", assign), seq(ref("binop"), alt(ref("throw"), init_list)), "..."))), ref("throw"), seq("co_yield", assign))
        r["throw"] = seq("throw", opt(assign))
        r["expr"] = listed(assign)

        # declarations
        initialiser = alt(seq("=", alt(assign, init_list)), init_list, seq("(", listed(alt(assign, init_list)), ")"))
        bits = seq(":", ref("chain"))
        one = seq(ref("declarator"), opt(alt(initialiser, bits)))
        unpack = seq(opt(tok("&", "&&")), "[", listed(ident), "]", initialiser)
        r["simple_decl"] = seq(ref("decl_spec"), alt(self.eps, listed(one), unpack), ";")
        r["condition"] = alt(expr, seq(attrs, ref("decl_spec"), ref("declarator"), alt(seq("=", alt(assign, init_list)), init_list)), seq(ref("decl_spec"), unpack))
        asm = seq("asm", star(tok("volatile", "inline", "goto")), "(", star(ref("balanced")), ")", ";")
        using = seq("using", alt(seq("namespace", ref("qualified")), listed(seq(opt("typename"), ref("declared"))), seq(ident, attrs, "=", type_id), seq("enum", ref("qualified"))), ";")
        assertion = seq("static_assert", "(", assign, opt(",", assign), ")", ";")
        alias = seq("namespace", ident, "=", ref("qualified"), ";")
        r["local_decl"] = alt(ref("simple_decl"), using, assertion, alias, asm)

        body = alt(block, seq(":", listed(seq(ref("qualified"), alt(args, init_list), opt("..."))), block), seq("try", opt(":", listed(seq(ref("qualified"), alt(args, init_list)))), block, plus(ref("handler"))))
        special = seq("=", tok("default", "delete", "NUM"), ";")
        named_function = seq(ref("pointers"), alt(ref("declared"), seq("(", ref("declarator"), ")")), function)
        old_style = seq(ref("pointers"), "ID", "(", listed("ID"), ")", plus(ref("simple_decl")), block)  # names first, their types before the body
        r["function"] = seq(ref("decl_spec"), alt(seq(named_function, alt(body, special)), old_style))
        # constructors, destructors and conversions have no type; outside a class their name is qualified
        scoped = seq(opt("::"), plus(seq(part, "::")), alt(part, seq("~", part), seq("operator", ref("type_spec_ptr"))))
        r["constructor"] = seq(attrs, star(flag), scoped, ref("params"), after_params, alt(body, special))
        tparam = alt(seq(tok("typename", "class"), opt("..."), opt(ident), opt("=", type_id)), seq(ref("template_head"), tok("class", "typename"), opt("..."), opt(ident), opt("=", ref("qualified"))), ref("param"))
        r["tparam"] = tparam
        r["template_head"] = seq("template", "<", opt(listed(tparam)), ">")
        requires = opt("requires", ref("chain"))
        r["template"] = seq(plus(seq(ref("template_head"), requires)), alt(ref("top"), seq("concept", ident, "=", expr, ";")))
        r["instance"] = seq(opt("extern"), "template", ref("simple_decl"))

        # classes and enumerations
        base = seq(star(tok("virtual", "public", "protected", "private")), ref("qualified"), opt("..."))
        enumerator = seq(ident, attrs, opt("=", assign))
        r["definition"] = alt(
            seq(tok("struct", "class", "union"), attrs, opt(ref("qualified"), opt("final")), opt(":", listed(base)), "{", star(ref("member")), "}"),
            seq("enum", opt(tok("class", "struct")), attrs, opt(ref("qualified")), opt(":", ref("type_spec")), "{", opt(listed(enumerator), opt(",")), "}"),
        )
        inside = seq(attrs, star(flag), alt(ident, seq("~", ident), seq("operator", ref("type_spec_ptr"))), ref("params"), after_params, alt(body, special, ";"))
        pure = seq(ref("decl_spec"), listed(seq(one)), ";")
        r["member"] = alt(
            seq(tok("public", "private", "protected"), ":"),
            pure,
            ref("simple_decl"),
            seq(ref("decl_spec"), opt(ident), bits, opt(initialiser), ";"),
            seq("friend", ref("qualified"), ";"),
            ref("function"),
            inside,
            seq(plus(seq(ref("template_head"), requires)), ref("member")),
            using,
            assertion,
            ";",
        )

        # statements
        r["block"] = seq("{", star(ref("item")), "}")
        label = seq(attrs, alt(seq("case", ref("case_value"), opt("...", ref("case_value")), ":"), seq("default", ":"), seq("ID", ":")))
        r["case_value"] = alt(seq(ref("chain"), opt("?", expr, ":", assign)))
        r["item"] = alt(statement, ref("local_decl"), label, ref("local_class"))
        r["local_class"] = seq(ref("template_head"), ref("simple_decl"))
        r["handler"] = seq("catch", "(", alt("...", ref("param")), ")", block)
        head = seq("(", opt(alt(seq(opt(expr), ";"), ref("simple_decl"), using)), ref("condition"), ")")
        for_init = alt(ref("simple_decl"), seq(opt(expr), ";"), using)
        range_ = seq(opt(for_init), ref("decl_spec"), alt(ref("declarator"), seq(opt(tok("&", "&&")), "[", listed(ident), "]")), ":", alt(expr, init_list))
        r["statement"] = seq(
            attrs,
            star(label),
            alt(
                block,
                seq(opt(expr), ";"),
                seq("if", opt("constexpr"), head, statement, opt("else", statement)),
                seq("switch", head, statement),
                seq("while", "(", ref("condition"), ")", statement),
                seq("do", statement, "while", "(", expr, ")", ";"),
                seq("for", "(", alt(seq(for_init, opt(ref("condition")), ";", opt(expr)), range_), ")", statement),
                seq(tok("break", "continue"), ";"),
                seq(tok("return", "co_return"), opt(alt(expr, init_list)), ";"),
                seq("goto", alt("ID", seq("*", expr)), ";"),
                seq("try", block, plus(ref("handler"))),
            ),
        )

        # translation unit
        r["top"] = alt(
            ref("function"),
            ref("constructor"),
            ref("local_decl"),
            ref("template"),
            ref("instance"),
            seq(opt("inline"), "namespace", attrs, opt(listed(seq(opt("inline"), "ID"), "::")), "{", star(ref("top")), "}"),
            seq("extern", "STR", alt(seq("{", star(ref("top")), "}"), ref("top"))),
            seq(attrs, ";"),
        )
        self.start = star(ref("top"))
