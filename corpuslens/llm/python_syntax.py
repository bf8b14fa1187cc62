"""Grammar and tokens of Python 3 modules."""

from __future__ import annotations

import io
import keyword
import re
import tokenize
import unicodedata
from token import COMMENT, DEDENT, ENDMARKER, FSTRING_END, FSTRING_MIDDLE, FSTRING_START, INDENT, NAME, NEWLINE, NL, NUMBER, OP, STRING

from corpuslens.llm.derivatives import Grammar

_KINDS = {NAME: "NAME", NUMBER: "NUMBER", STRING: "STRING", NEWLINE: "NEWLINE", INDENT: "INDENT", DEDENT: "DEDENT", FSTRING_START: "FSTART", FSTRING_MIDDLE: "FMIDDLE", FSTRING_END: "FEND"}
_SKIP = {COMMENT, NL, ENDMARKER}
_WORDS = {*keyword.kwlist, "match", "case", "type"}


_STRING = re.compile(r"([A-Za-z]*)(\"\"\"|\'\'\'|\"|\')(.*)\2\Z", re.DOTALL)
#: Escapes of text and of bytes that have a form to keep to.
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})?|u([0-9a-fA-F]{4})?|U([0-9a-fA-F]{8})?|N(?:\{([^{}]+)\})?|[\s\S])")


def _sound(body: str, octets: bool) -> bool:
    """Whether the escapes of a literal that isn't raw are complete and stand for a character."""
    for m in _ESCAPE.finditer(body):
        kind = m.group()[1]
        if kind == "x" and m[1] is None:
            return False
        if octets or kind not in "uUN":
            continue
        value = {"u": m[2], "U": m[3], "N": m[4]}[kind]
        if value is None or kind == "U" and int(value, 16) > 0x10FFFF:
            return False
        if kind == "N":
            try:
                unicodedata.lookup(value)
            except KeyError:
                return False
    return True


def _string(text: str) -> str:
    """STRING, BYTES, or BAD for a literal that can't be read."""
    m = _STRING.match(text)
    prefix, body = m[1].lower(), m[3]
    octets = "b" in prefix
    if octets and not body.isascii() or "r" not in prefix and not _sound(body, octets):
        return "BAD"
    return "BYTES" if octets else "STRING"


def tokens(code: str) -> tuple[list[str], list[int], bool]:
    """Token classes, their lines, and whether the text could be cut into tokens to its end."""
    kinds: list[str] = []
    lines: list[int] = []
    raw: list[bool] = []  # of the formatted strings that are open
    try:
        for kind, text, start, _, _ in tokenize.generate_tokens(io.StringIO(code).readline):
            if kind in _SKIP:
                continue
            if kind == FSTRING_START:
                raw.append("r" in text.lower().rstrip("\"'"))
            elif kind == FSTRING_END:
                raw.pop()
            if kind == NAME and not text.isidentifier():
                kinds.append("BAD")
            elif kind == STRING:
                kinds.append(_string(text))
            elif kind == FSTRING_MIDDLE and not raw[-1] and not _sound(text, False):
                kinds.append("BAD")
            elif kind == NAME and text in ("s", "r", "a") and kinds[-1:] == ["!"]:
                kinds.append("CONVERSION")
            else:
                kinds.append(text if kind == OP or kind == NAME and text in _WORDS else _KINDS.get(kind, "BAD"))
            lines.append(start[0])
    except (tokenize.TokenError, SyntaxError, ValueError) as e:
        where = e.args[1] if len(e.args) > 1 and isinstance(e.args[1], tuple) else (None, None)
        line = where[1] if isinstance(e, SyntaxError) and len(where) > 1 else where[0]
        kinds.append("BAD")
        lines.append(line if isinstance(line, int) else (lines[-1] if lines else 1))
        return kinds, lines, False
    return kinds, lines, True


def is_open(code: str, kinds: list[str]) -> bool:
    """Whether the tokens before the one that can't be cut leave a bracket open, or the text ends inside a triple-quoted string."""
    depth = 0
    for k in kinds:
        depth += 1 if k in ("(", "[", "{") else -1 if k in (")", "]", "}") else 0
    if depth > 0:
        return True
    try:
        list(tokenize.generate_tokens(io.StringIO(code).readline))
    except tokenize.TokenError as e:
        return "EOF" in str(e.args[0]) or "unterminated triple" in str(e.args[0])
    except (SyntaxError, ValueError):
        pass
    return False


class PythonGrammar(Grammar):
    def __init__(self) -> None:
        super().__init__()
        self.define()

    def define(self) -> None:
        seq, alt, star, plus, opt, tok, ref, listed = self.seq, self.alt, self.star, self.plus, self.opt, self.tok, self.ref, self.listed
        r = self.rules
        name = tok("NAME", "match", "case", "type")
        expr, named, star_named, target, arith = ref("expr"), ref("named"), ref("star_named"), ref("target"), ref("arith")
        trail = opt(",")

        # expressions
        r["strings"] = alt(plus(alt("STRING", ref("fstring"))), plus("BYTES"))
        r["fstring"] = seq("FSTART", star(alt("FMIDDLE", ref("freplace"))), "FEND")
        r["freplace"] = seq("{", alt(ref("star_exprs"), ref("yield")), opt("="), opt("!", "CONVERSION"), opt(":", star(alt("FMIDDLE", ref("freplace")))), "}")
        comp = plus(seq(opt("async"), "for", ref("targets"), "in", ref("disj"), star(seq("if", ref("disj")))))
        r["comp"] = comp
        items = seq(listed(star_named), trail)
        several = seq(star_named, ",", opt(items))
        r["group"] = seq("(", alt(self.eps, named, several, seq(named, ref("comp")), ref("yield")), ")")
        r["list"] = seq("[", alt(self.eps, items, seq(named, ref("comp"))), "]")
        pair = seq(expr, ":", expr)
        entry = alt(pair, seq("**", arith))
        r["braces"] = seq("{", alt(self.eps, seq(listed(entry), trail), seq(pair, ref("comp")), items, seq(named, ref("comp"))), "}")
        r["atom"] = alt(name, tok("NUMBER", "True", "False", "None", "..."), ref("strings"), ref("group"), ref("list"), ref("braces"))
        slice_ = alt(seq(opt(expr), ":", opt(expr), opt(":", opt(expr))), named, seq("*", expr))
        r["subscript"] = seq("[", listed(slice_), trail, "]")
        positional = listed(alt(named, seq("*", expr)))
        word = seq(name, "=", expr)
        worded = alt(seq(listed(alt(word, seq("*", expr))), opt(",", listed(alt(word, seq("**", expr))))), listed(alt(word, seq("**", expr))))
        r["args"] = seq(alt(seq(positional, opt(",", worded)), worded), trail)
        r["call"] = seq("(", alt(self.eps, ref("args"), seq(named, ref("comp"))), ")")
        trailer = alt(seq(".", name), ref("call"), ref("subscript"))
        r["primary"] = seq(opt("await"), ref("atom"), star(trailer))
        r["factor"] = seq(star(tok("+", "-", "~")), ref("primary"))
        r["arith"] = listed_ops(self, ref("factor"), tok("|", "^", "&", "<<", ">>", "+", "-", "*", "/", "//", "%", "@", "**"))
        compare = alt(tok("==", "!=", "<", "<=", ">", ">=", "in"), seq("not", "in"), seq("is", opt("not")))
        r["comparison"] = listed_ops(self, arith, compare)
        r["disj"] = listed_ops(self, seq(star("not"), ref("comparison")), tok("and", "or"))
        r["lambda"] = seq("lambda", opt(ref("lparams")), ":", expr)
        r["expr"] = alt(seq(ref("disj"), opt("if", ref("disj"), "else", expr)), ref("lambda"))
        r["named"] = alt(expr, seq(name, ":=", expr))
        r["star_named"] = alt(named, seq("*", arith))
        r["star_expr"] = alt(expr, seq("*", arith))
        r["star_exprs"] = seq(listed(ref("star_expr")), trail)
        r["yield"] = seq("yield", alt(seq("from", expr), opt(ref("star_exprs"))))

        # targets
        last = alt(seq(".", name), ref("subscript"))
        atom_target = alt(seq("(", opt(ref("targets")), ")"), seq("[", opt(ref("targets")), "]"))
        r["single"] = alt(name, seq(ref("atom"), star(trailer), last))
        r["target"] = alt(seq(opt("*"), ref("single")), atom_target)
        r["targets"] = seq(listed(target), trail)

        # parameters: those without a default first, `*` only before a name, `**` last
        default = opt("=", expr)

        def parameters(plain, starred):
            filled = seq(plain, "=", expr)
            more, more_filled = star(seq(",", plain)), star(seq(",", filled))
            first = alt(seq(plain, more, more_filled, opt(",", "/", more_filled)), seq(plain, more, ",", "/", more, more_filled), seq(filled, more_filled, opt(",", "/", more_filled)))
            rest = seq("**", plain)
            only = seq(plain, default)
            last = alt(seq("*", starred, star(seq(",", only)), opt(",", rest)), seq("*", plus(seq(",", only)), opt(",", rest)), rest)
            return seq(alt(seq(first, opt(",", last)), last), trail)

        r["params"] = parameters(seq(name, opt(":", expr)), seq(name, opt(":", ref("star_expr"))))
        r["lparams"] = parameters(name, name)
        tparam = alt(seq(name, opt(":", expr), default), seq("*", name, default), seq("**", name, default))
        tparams = opt("[", listed(tparam), trail, "]")

        r["deleted"] = seq(listed(alt(ref("single"), seq("(", opt(ref("deleted")), ")"), seq("[", opt(ref("deleted")), "]"))), trail)

        # simple statements
        value = alt(ref("star_exprs"), ref("yield"))
        aug = tok("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**=")
        dotted = listed(name, ".")
        as_name = opt("as", name)
        imported = seq(name, as_name)
        origin = alt(seq(star(tok(".", "...")), dotted), plus(tok(".", "...")))
        r["simple"] = alt(
            value,
            seq(plus(seq(ref("targets"), "=")), value),
            seq(alt(ref("single"), seq("(", ref("single"), ")")), ":", expr, opt("=", value)),
            seq(alt(ref("single"), seq("(", ref("single"), ")")), aug, value),
            seq("return", opt(ref("star_exprs"))),
            seq("raise", opt(expr, opt("from", expr))),
            seq("import", listed(seq(dotted, as_name))),
            seq("from", origin, "import", alt("*", listed(imported), seq("(", listed(imported), trail, ")"))),
            seq("del", ref("deleted")),
            seq("assert", expr, opt(",", expr)),
            seq(tok("global", "nonlocal"), listed(name)),
            seq("type", name, tparams, "=", expr),
            tok("pass", "break", "continue"),
        )
        r["simples"] = seq(listed(ref("simple"), ";"), opt(";"), "NEWLINE")
        r["block"] = alt(ref("simples"), seq("NEWLINE", "INDENT", plus(ref("statement")), "DEDENT"))

        # compound statements
        body = seq(":", ref("block"))
        otherwise = opt("else", body)
        item = seq(expr, opt("as", target))
        decorators = star(seq("@", named, "NEWLINE"))
        handlers = alt(plus(seq("except", opt(expr, as_name), body)), plus(seq("except", "*", expr, as_name, body)))
        finally_ = seq("finally", body)
        r["compound"] = alt(
            seq("if", named, body, star(seq("elif", named, body)), otherwise),
            seq("while", named, body, otherwise),
            seq(opt("async"), "for", ref("targets"), "in", ref("star_exprs"), body, otherwise),
            seq(opt("async"), "with", alt(listed(item), seq("(", listed(item), trail, ")")), body),
            seq("try", body, alt(seq(handlers, otherwise, opt(finally_)), finally_)),
            seq(decorators, opt("async"), "def", name, tparams, "(", opt(ref("params")), ")", opt("->", expr), body),
            seq(decorators, "class", name, tparams, opt("(", opt(ref("args")), ")"), body),
            seq("match", ref("star_exprs"), ":", "NEWLINE", "INDENT", plus(seq("case", ref("patterns"), opt("if", named), body)), "DEDENT"),
        )
        number = seq(opt("-"), "NUMBER", opt(tok("+", "-"), "NUMBER"))
        pattern = ref("pattern")
        inner = alt(pattern, seq("*", name))
        inners = seq(listed(inner), trail)
        key = alt(number, ref("strings"), tok("True", "False", "None"), listed(name, "."))
        r["closed"] = alt(
            number,
            ref("strings"),
            tok("True", "False", "None"),
            seq(listed(name, "."), opt("(", opt(alt(seq(listed(pattern), opt(",", listed(seq(name, "=", pattern)))), listed(seq(name, "=", pattern))), trail), ")")),
            seq("(", opt(inners), ")"),
            seq("[", opt(inners), "]"),
            seq("{", opt(alt(seq(listed(seq(key, ":", pattern)), opt(",", "**", name)), seq("**", name)), trail), "}"),
        )
        r["pattern"] = seq(listed(ref("closed"), "|"), as_name)
        r["patterns"] = inners
        r["statement"] = alt(ref("simples"), ref("compound"))
        self.start = star(alt(ref("statement"), "NEWLINE"))


def listed_ops(g: Grammar, operand, operator):
    """Operands with an operator between each two."""
    return g.seq(operand, g.star(g.seq(operator, operand)))
