"""Front-end for PHP: a lexer and a precedence-climbing parser. Syntax that it doesn't know ends in a ParseError."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from .trees import Node, ParseError

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*?(?=\?>|\n|$)|\#(?!\[)[^\n]*?(?=\?>|\n|$)|/\*.*?\*/)
|(?P<close>\?>\n?)
|(?P<heredoc><<<[ \t]*(?P<hq>["']?)(?P<hname>[A-Za-z_]\w*)(?P=hq)\r?\n)
|(?P<cast>\(\s*(?:int|integer|float|double|real|string|binary|bool|boolean|array|object|unset)\s*\))
|(?P<number>0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)|\d[\d_]*\.(?!\.)|\d[\d_]*)
|(?P<variable>\$[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)
|(?P<name>\\?[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:\\[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)*(?:\\(?=\s*\{))?)
|(?P<single>[bB]?'(?:[^'\\]|\\.)*')
|(?P<double>[bB]?"(?:[^"\\]|\\.)*")
|(?P<shell>`(?:[^`\\]|\\.)*`)
|(?P<op><=>|\*\*=|\.\.\.|<<=|>>=|===|!==|\?\?=|\?->|\+\+|--|->|=>|::|==|!=|<>|<=|>=|&&|\|\||\?\?|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|\#\[|[-+*/%=<>!.,;:?()\[\]{}&|^~@$])""",
    re.X | re.S,
)


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


def tokenize(source: str, line: int = 1, inside: bool = False) -> list[Token]:
    """The tokens with their lines; text outside of tags is html, and a closing tag ends a statement."""
    out, at = [], 0

    def add(kind: str, text: str) -> None:
        nonlocal line
        stop = line + text.count("\n")
        if kind != "space":
            out.append(Token(kind, text, line, line + text.rstrip("\n").count("\n") if kind == "close" else stop))
        line = stop

    while at < len(source):
        if not inside:
            m = re.compile(r"<\?(?:php(?=\s|$)|=)").search(source, at)
            html = source[at : m.start() if m else len(source)]
            if html:
                add("html", html)
            if not m:
                break
            if m.group() == "<?=":
                out.append(Token("name", "echo", line, line))
            at, inside = m.end(), True
            continue
        m = _TOKEN.match(source, at)
        if not m:
            raise ParseError(f"Parse error: unexpected {source[at]!r} on line {line}")
        kind = m.lastgroup if m.lastgroup in ("space", "close", "cast", "number", "variable", "name", "single", "double", "shell", "op") else "heredoc"
        text = m.group()
        if kind == "heredoc":
            body = re.compile(rf"(.*?)(?:^|(?<=\n))([ \t]*){m['hname']}\b", re.S).match(source, m.end())
            if not body:
                raise ParseError(f"Parse error: heredoc without an end on line {line}")
            indent = body[2]
            content = body[1].removesuffix("\n")
            if indent:
                content = re.sub(rf"(?m)^{indent}", "", content)
            out.append(Token("nowdoc" if m["hq"] == "'" else "heredoc", content, line, line + source[at : body.end()].count("\n")))
            line += source[at : body.end()].count("\n")
            at = body.end()
            continue
        add(kind, text)
        at = m.end()
        if kind == "close":
            out[-1].kind, out[-1].text = "op", ";"
            inside = False
    out.append(Token("eof", "", line, line))
    return out


# The language's binary operators by binding power, with their node kinds.
_BINARY = {
    "or": (1, "LogicalOr"), "xor": (2, "LogicalXor"), "and": (3, "LogicalAnd"), "??": (7, "Coalesce"), "||": (8, "BooleanOr"), "&&": (9, "BooleanAnd"), "|": (10, "BitwiseOr"), "^": (11, "BitwiseXor"), "&": (12, "BitwiseAnd"),
    "==": (13, "Equal"), "!=": (13, "NotEqual"), "<>": (13, "NotEqual"), "===": (13, "Identical"), "!==": (13, "NotIdentical"), "<=>": (13, "Spaceship"), "<": (14, "Smaller"), "<=": (14, "SmallerOrEqual"), ">": (14, "Greater"), ">=": (14, "GreaterOrEqual"),
    ".": (15, "Concat"), "<<": (16, "ShiftLeft"), ">>": (16, "ShiftRight"), "+": (17, "Plus"), "-": (17, "Minus"), "*": (18, "Mul"), "/": (18, "Div"), "%": (18, "Mod"), "instanceof": (20, "Instanceof"), "**": (21, "Pow"),
}
_ASSIGN = {"+=": "Plus", "-=": "Minus", "*=": "Mul", "/=": "Div", ".=": "Concat", "%=": "Mod", "&=": "BitwiseAnd", "|=": "BitwiseOr", "^=": "BitwiseXor", "<<=": "ShiftLeft", ">>=": "ShiftRight", "**=": "Pow", "??=": "Coalesce"}
_MODIFIERS = ("public", "protected", "private", "static", "abstract", "final", "readonly", "var")
_BUILTIN = {"int", "float", "string", "bool", "array", "callable", "iterable", "object", "mixed", "void", "null", "never", "false", "true"}
_MAGIC = {"__line__", "__file__", "__dir__", "__function__", "__class__", "__trait__", "__method__", "__namespace__"}
_INCLUDES = {"include", "include_once", "require", "require_once"}


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    # --- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, k: int = 1) -> Token:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def fail(self) -> ParseError:
        t = self.now
        return ParseError(f"Parse error: unexpected {'end of file' if t.kind == 'eof' else repr(t.text)} on line {t.start}")

    def next(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def is_(self, *texts: str) -> bool:
        t = self.now
        return t.kind in ("op", "name") and t.text.lower() in texts

    def take(self, *texts: str) -> bool:
        if self.is_(*texts):
            self.at += 1
            return True
        return False

    def need(self, *texts: str) -> Token:
        if not self.is_(*texts):
            raise self.fail()
        return self.next()

    def node(self, kind: str, start: Token | Node, *parts: tuple[str, Any], flag: str | None = None, part: str | None = None) -> Node:
        return Node(kind, list(parts), start.start, self.tokens[self.at - 1].end, flag, part)

    def many(self, one, stop: str, sep: str = ",") -> list:
        found = []
        while not self.is_(stop):
            found.append(one())
            if not self.take(sep):
                break
        self.need(stop)
        return found

    # --- names and types

    def identifier(self) -> Node:
        t = self.next()
        if t.kind != "name" or "\\" in t.text:
            self.at -= 1
            raise self.fail()
        return Node("Identifier", [("name", t.text)], t.start, t.end, "identifiers", "name")

    def name(self) -> Node:
        t = self.next()
        if t.kind != "name":
            self.at -= 1
            raise self.fail()
        kind = "Name_FullyQualified" if t.text[0] == "\\" else "Name_Relative" if t.text.lower().startswith("namespace\\") else "Name"
        return Node(kind, [("name", t.text.strip("\\"))], t.start, t.end, "names", "name")

    def type_(self) -> Node:
        t = self.now
        if self.take("?"):
            return self.node("NullableType", t, ("type", self.type_()))
        first = self.one_type()
        for op, kind in (("|", "UnionType"), ("&", "IntersectionType")):
            if self.is_(op) and not (op == "&" and (self.ahead().kind == "variable" or self.ahead().text in ("...", "&"))):
                types = [first]
                while self.is_(op):
                    self.next()
                    types.append(self.one_type())
                first = self.node(kind, t, ("types", types))
        return first

    def one_type(self) -> Node:
        if self.take("("):
            found = self.type_()
            self.need(")")
            return found
        return self.identifier() if self.now.text.lower() in _BUILTIN else self.name()

    def maybe_type(self) -> Node | None:
        return self.type_() if self.now.kind == "name" or self.is_("?", "(") else None

    def return_type(self) -> Node | None:
        return self.type_() if self.take(":") else None

    def attributes(self) -> list[Node]:
        groups = []
        while self.is_("#["):
            t = self.next()
            found = self.many(lambda: self.node("Attribute", self.now, ("name", self.name()), ("args", self.arguments() if self.is_("(") else [])), "]")
            groups.append(self.node("AttributeGroup", t, ("attrs", found)))
        return groups

    def modifiers(self) -> list[str]:
        found = []
        while self.is_(*_MODIFIERS) and not (self.ahead().text in ("::", "(") and self.is_("static")):
            found.append(self.next().text.lower())
            if self.is_("(") and self.ahead().text.lower() == "set":
                self.next(), self.next(), self.need(")")
        return sorted(found)

    # --- statements

    def statements(self, *stops: str) -> list[Node]:
        found = []
        while not self.is_(*stops):
            if self.now.kind == "eof":
                if stops:
                    raise self.fail()
                break
            s = self.statement()
            if isinstance(s, list):
                found += s
            elif s is not None:
                found.append(s)
        return found

    def block(self, *stops: str) -> list[Node]:
        """A body in braces, a single statement, or after a colon up to one of stops."""
        if self.take("{"):
            found = self.statements("}")
            self.need("}")
            return found
        if stops and self.take(":"):
            return self.statements(*stops)
        s = self.statement()
        return s if isinstance(s, list) else [s] if s is not None else []

    def end(self) -> None:
        if self.now.kind != "eof":
            self.need(";")

    def braced(self) -> list[Node]:
        self.need("{")
        found = self.statements("}")
        self.need("}")
        return found

    def paren(self) -> Node:
        self.need("(")
        found = self.expression()
        self.need(")")
        return found

    def statement(self) -> Node | list[Node] | None:
        t = self.now
        if t.kind == "html":
            self.next()
            return self.node("InlineHTML", t, ("value", t.text))
        if self.take(";"):
            return None
        if self.is_("{"):
            return self.braced()
        word = t.text.lower() if t.kind == "name" else ""
        after = self.ahead()
        if word and after.text == ":" and self.ahead(2).text != ":" and word not in ("default", "else", "case"):
            self.at += 2
            return self.node("Label", t, ("name", Node("Identifier", [("name", t.text)], t.start, t.end, "identifiers", "name")))
        method = getattr(self, f"s_{word}", None) if word and after.text not in ("::", "(") or word in ("if", "while", "for", "foreach", "switch", "declare", "unset", "return", "echo") else None
        if word in ("static", "function", "fn", "namespace", "enum", "readonly", "abstract", "final", "match", "const", "goto"):
            method = self.special(word)
        if t.text == "#[":
            at = self.at
            groups = self.attributes()
            if self.is_("function", "class", "abstract", "final", "readonly", "interface", "trait", "enum") and not (self.is_("function") and self.ahead().text in ("(", "&") and self.ahead(2).kind != "name"):
                s = self.statement()
                s.parts.insert(0, ("attrGroups", groups))
                s.start = groups[0].start
                return s
            self.at = at
        if method:
            self.next()
            return method(t)
        value = self.expression()
        self.end()
        return self.node("Expression", value, ("expr", value))

    def special(self, word: str):
        after = self.ahead()
        if word == "static":
            return self.s_static if after.kind == "variable" else None
        if word == "function":
            return self.s_function if after.kind == "name" or after.text == "&" and self.ahead(2).kind == "name" else None
        if word in ("readonly", "abstract", "final"):
            return self.s_modified if after.kind == "name" else None
        if word == "enum":
            return self.s_enum if after.kind == "name" and after.text.lower() not in ("extends", "implements") else None
        if word == "namespace":
            return self.s_namespace if after.kind == "name" or after.text == "{" else None
        return {"const": self.s_const, "goto": self.s_goto}.get(word)

    def s_if(self, t: Token) -> Node:
        cond = self.paren()
        colon = self.is_(":")
        body = self.block("elseif", "else", "endif")
        elseifs, otherwise = [], None
        while self.is_("elseif") or self.is_("else") and self.ahead().text.lower() == "if" and not colon:
            e = self.next()
            if e.text.lower() == "else":
                break_ = self.now
                inner = self.statement()
                return self.node("If", t, ("cond", cond), ("stmts", body), ("elseifs", elseifs), ("else", Node("Else", [("stmts", [inner])], e.start, inner.end if isinstance(inner, Node) else break_.end)))
            c = self.paren()
            elseifs.append(self.node("ElseIf", e, ("cond", c), ("stmts", self.block("elseif", "else", "endif"))))
        if self.is_("else"):
            e = self.next()
            otherwise = self.node("Else", e, ("stmts", self.block("endif")))
            otherwise.end = self.tokens[self.at - 1].end
        if colon:
            self.need("endif")
            self.end()
        return self.node("If", t, ("cond", cond), ("stmts", body), ("elseifs", elseifs), ("else", otherwise))

    def closed(self, stop: str) -> list[Node]:
        colon = self.is_(":")
        body = self.block(stop)
        if colon:
            self.need(stop)
            self.end()
        return body

    def s_while(self, t: Token) -> Node:
        cond = self.paren()
        return self.node("While", t, ("cond", cond), ("stmts", self.closed("endwhile")))

    def s_do(self, t: Token) -> Node:
        body = self.block()
        self.need("while")
        cond = self.paren()
        self.end()
        return self.node("Do", t, ("stmts", body), ("cond", cond))

    def s_for(self, t: Token) -> Node:
        self.need("(")
        parts = [self.many(self.expression, stop) for stop in (";", ";", ")")]
        return self.node("For", t, *zip(("init", "cond", "loop"), parts, strict=True), ("stmts", self.closed("endfor")))

    def s_foreach(self, t: Token) -> Node:
        self.need("(")
        over = self.expression()
        self.need("as")
        key, ref = None, self.take("&")
        value = self.expression()
        if self.take("=>"):
            key, ref = value, self.take("&")
            value = self.expression()
        self.need(")")
        return self.node("Foreach", t, ("expr", over), ("keyVar", key), ("byRef", ref), ("valueVar", value), ("stmts", self.closed("endforeach")))

    def s_switch(self, t: Token) -> Node:
        cond = self.paren()
        stop = "endswitch" if self.take(":") else self.need("{") and "}"
        cases = []
        self.take(";")
        while not self.is_(stop):
            c = self.need("case", "default")
            value = self.expression() if c.text.lower() == "case" else None
            self.need(":", ";")
            cases.append(self.node("Case", c, ("cond", value), ("stmts", self.statements("case", "default", stop))))
        self.next()
        if stop == "endswitch":
            self.end()
        return self.node("Switch", t, ("cond", cond), ("cases", cases))

    def s_try(self, t: Token) -> Node:
        body, catches, last = self.braced(), [], None
        while self.is_("catch"):
            c = self.next()
            self.need("(")
            types = [self.name()]
            while self.take("|"):
                types.append(self.name())
            var = self.variable() if self.now.kind == "variable" else None
            self.need(")")
            catches.append(self.node("Catch", c, ("types", types), ("var", var), ("stmts", self.braced())))
        if self.is_("finally"):
            f = self.next()
            last = self.node("Finally", f, ("stmts", self.braced()))
        return self.node("TryCatch", t, ("stmts", body), ("catches", catches), ("finally", last))

    def simple(self, kind: str, part: str, t: Token) -> Node:
        value = None if self.is_(";") or self.now.kind == "eof" else self.expression()
        self.end()
        return self.node(kind, t, (part, value))

    def s_return(self, t: Token) -> Node:
        return self.simple("Return", "expr", t)

    def s_break(self, t: Token) -> Node:
        return self.simple("Break", "num", t)

    def s_continue(self, t: Token) -> Node:
        return self.simple("Continue", "num", t)

    def s_echo(self, t: Token) -> Node:
        return self.node("Echo", t, ("exprs", self.many(self.expression, ";")))

    def s_global(self, t: Token) -> Node:
        return self.node("Global", t, ("vars", self.many(self.expression, ";")))

    def s_static(self, t: Token) -> Node:
        def one() -> Node:
            v = self.variable()
            return self.node("StaticVar", v, ("var", v), ("default", self.expression() if self.take("=") else None))

        return self.node("Static", t, ("vars", self.many(one, ";")))

    def s_unset(self, t: Token) -> Node:
        self.need("(")
        found = self.many(self.expression, ")")
        self.end()
        return self.node("Unset", t, ("vars", found))

    def s_goto(self, t: Token) -> Node:
        name = self.identifier()
        self.end()
        return self.node("Goto", t, ("name", name))

    def s_declare(self, t: Token) -> Node:
        def one() -> Node:
            key = self.identifier()
            self.need("=")
            return self.node("DeclareDeclare", key, ("key", key), ("value", self.expression()))

        self.need("(")
        found = self.many(one, ")")
        body = None if self.take(";") else self.closed("enddeclare")
        return self.node("Declare", t, ("declares", found), ("stmts", body))

    def s_namespace(self, t: Token) -> Node:
        name = None if self.is_("{") else self.name()
        if self.is_("{"):
            return self.node("Namespace", t, ("name", name), ("stmts", self.braced()))
        self.end()
        body = []
        while self.now.kind != "eof" and not (self.is_("namespace") and self.ahead().kind == "name" or self.is_("namespace") and self.ahead().text == "{"):
            s = self.statement()
            body += s if isinstance(s, list) else [s] if s is not None else []
        return self.node("Namespace", t, ("name", name), ("stmts", body))

    def s_use(self, t: Token) -> Node:
        kind = self.next().text.lower() if self.is_("function", "const") else ""

        def one() -> Node:
            own = self.next().text.lower() if self.is_("function", "const") and self.ahead().kind == "name" else ""
            n = self.name()
            return self.node("UseUse", n, ("type", own), ("name", n), ("alias", self.identifier() if self.take("as") else None))

        if self.now.kind == "name" and self.ahead().text == "{":
            prefix = self.name()
            self.need("{")
            return self.group_use(t, kind, prefix, one)
        found = self.many(one, ";")
        return self.node("Use", t, ("type", kind), ("uses", found))

    def group_use(self, t: Token, kind: str, prefix: Node, one) -> Node:
        found = self.many(one, "}")
        self.end()
        return self.node("GroupUse", t, ("type", kind), ("prefix", prefix), ("uses", found))

    def constants(self) -> list[Node]:
        def one() -> Node:
            name = self.identifier()
            self.need("=")
            return self.node("Const", name, ("name", name), ("value", self.expression()))

        return self.many(one, ";")

    def s_const(self, t: Token) -> Node:
        return self.node("Const_", t, ("consts", self.constants()))

    def parameters(self) -> list[Node]:
        def one() -> Node:
            t = self.now
            groups, flags, kind = self.attributes(), self.modifiers(), self.maybe_type()
            ref, rest = self.take("&"), self.take("...")
            var = self.variable()
            default = self.expression() if self.take("=") else None
            return self.node("Param", t, ("attrGroups", groups), ("flags", " ".join(flags)), ("type", kind), ("byRef", ref), ("variadic", rest), ("var", var), ("default", default))

        self.need("(")
        return self.many(one, ")")

    def s_function(self, t: Token) -> Node:
        ref, name = self.take("&"), self.identifier()
        params, kind = self.parameters(), self.return_type()
        return self.node("Function", t, ("byRef", ref), ("name", name), ("params", params), ("returnType", kind), ("stmts", self.braced()))

    def s_modified(self, t: Token) -> Node:
        self.at -= 1
        flags = self.modifiers()
        self.need("class")
        found = self.s_class(t)
        found.parts.insert(0, ("flags", " ".join(flags)))
        return found

    def names(self) -> list[Node]:
        found = [self.name()]
        while self.take(","):
            found.append(self.name())
        return found

    def s_class(self, t: Token) -> Node:
        name = self.identifier()
        parent = self.name() if self.take("extends") else None
        interfaces = self.names() if self.take("implements") else []
        return self.node("Class", t, ("name", name), ("extends", parent), ("implements", interfaces), ("stmts", self.members()))

    def s_interface(self, t: Token) -> Node:
        name = self.identifier()
        parents = self.names() if self.take("extends") else []
        return self.node("Interface", t, ("name", name), ("extends", parents), ("stmts", self.members()))

    def s_trait(self, t: Token) -> Node:
        return self.node("Trait", t, ("name", self.identifier()), ("stmts", self.members()))

    def s_enum(self, t: Token) -> Node:
        name, kind = self.identifier(), self.return_type()
        interfaces = self.names() if self.take("implements") else []
        return self.node("Enum", t, ("name", name), ("scalarType", kind), ("implements", interfaces), ("stmts", self.members()))

    def members(self) -> list[Node]:
        self.need("{")
        found = []
        while not self.take("}"):
            found.append(self.member())
        return found

    def member(self) -> Node:
        t = self.now
        if self.take("use"):
            traits = self.names()
            if self.take("{"):
                adaptations = []
                while not self.take("}"):
                    adaptations.append(self.adaptation())
            else:
                adaptations = []
                self.end()
            return self.node("TraitUse", t, ("traits", traits), ("adaptations", adaptations))
        groups = self.attributes()
        if self.take("case"):
            name = self.identifier()
            value = self.expression() if self.take("=") else None
            self.end()
            return self.node("EnumCase", t, ("attrGroups", groups), ("name", name), ("expr", value))
        flags = " ".join(self.modifiers())
        if self.take("const"):
            kind = self.type_() if self.ahead().text != "=" else None
            return self.node("ClassConst", t, ("attrGroups", groups), ("flags", flags), ("type", kind), ("consts", self.constants()))
        if self.take("function"):
            ref, name = self.take("&"), self.identifier()
            params, kind = self.parameters(), self.return_type()
            body = None if self.take(";") else self.braced()
            return self.node("ClassMethod", t, ("attrGroups", groups), ("flags", flags), ("byRef", ref), ("name", name), ("params", params), ("returnType", kind), ("stmts", body))
        kind = self.maybe_type()

        def one() -> Node:
            v = self.next()
            if v.kind != "variable":
                self.at -= 1
                raise self.fail()
            name = Node("VarLikeIdentifier", [("name", v.text[1:])], v.start, v.end, "identifiers", "name")
            return self.node("PropertyProperty", v, ("name", name), ("default", self.expression() if self.take("=") else None))

        return self.node("Property", t, ("attrGroups", groups), ("flags", flags), ("type", kind), ("props", self.many(one, ";")))

    def adaptation(self) -> Node:
        first = self.name()
        trait, method = (first, self.identifier()) if self.take("::") else (None, Node("Identifier", first.parts, first.start, first.end, "identifiers", "name"))
        if self.take("insteadof"):
            others = self.names()
            self.end()
            return self.node("TraitUseAdaptation_Precedence", first, ("trait", trait), ("method", method), ("insteadof", others))
        self.need("as")
        flags = " ".join(self.modifiers())
        alias = None if self.is_(";") else self.identifier()
        self.end()
        return self.node("TraitUseAdaptation_Alias", first, ("trait", trait), ("method", method), ("newModifier", flags), ("newName", alias))

    # --- expressions

    def expression(self, least: int = 0) -> Node:
        left = self.unary()
        while True:
            t = self.now
            op = t.text.lower() if t.kind in ("op", "name") else ""
            if op == "?" and least <= 6:
                self.next()
                if self.take(":"):
                    middle = None
                else:
                    middle = self.expression(5)
                    self.need(":")
                left = self.node("Ternary", left, ("cond", left), ("if", middle), ("else", self.expression(7)))
                continue
            if op == "=" or op in _ASSIGN:  # binds to the variable on its left, whatever stands before that
                self.next()
                if op == "=" and self.is_("&"):
                    self.next()
                    left = self.node("AssignRef", left, ("var", left), ("expr", self.expression(5)))
                else:
                    value = self.expression(4)
                    left = self.node("Assign" if op == "=" else f"AssignOp_{_ASSIGN[op]}", left, ("var", left), ("expr", value))
                continue
            if op not in _BINARY or _BINARY[op][0] < least:
                return left
            power, kind = _BINARY[op]
            self.next()
            if op == "instanceof":
                right = self.name() if self.now.kind == "name" else self.unary()
                left = self.node("Instanceof", left, ("expr", left), ("class", right))
                continue
            right = self.expression(power if op in ("??", "**") else power + 1)
            left = self.node(f"BinaryOp_{kind}", left, ("left", left), ("right", right))

    def unary(self) -> Node:
        t = self.now
        if t.kind == "cast":
            self.next()
            kind = re.sub(r"\W", "", t.text).lower()
            kind = {"integer": "int", "double": "float", "real": "float", "boolean": "bool", "binary": "string"}.get(kind, kind)
            return self.node(f"Cast_{kind}", t, ("expr", self.expression(19)))
        for text, kind, power in (("!", "BooleanNot", 19), ("-", "UnaryMinus", 19), ("+", "UnaryPlus", 19), ("~", "BitwiseNot", 19), ("@", "ErrorSuppress", 19), ("++", "PreInc", 22), ("--", "PreDec", 22), ("&", None, 0)):
            if t.kind == "op" and t.text == text and kind:
                self.next()
                value = self.expression(power)
                return self.node(kind, t, ("var" if power == 22 else "expr", value))
        if t.kind == "name" and self.ahead().text != "::":
            word = t.text.lower()
            if word in ("clone", "print", "throw") or word in _INCLUDES:
                self.next()
                value = self.expression(22 if word == "clone" else 4)
                kind = {"clone": "Clone", "print": "Print", "throw": "Throw"}.get(word, "Include")
                return self.node(kind, t, ("expr", value), *([("type", word)] if kind == "Include" else []))
            if word == "yield":
                self.next()
                if self.take("from"):
                    return self.node("YieldFrom", t, ("expr", self.expression(4)))
                if self.is_(";", ")", ",", "]"):
                    return self.node("Yield", t, ("key", None), ("value", None))
                key, value = None, self.expression(4)
                if self.take("=>"):
                    key, value = value, self.expression(4)
                return self.node("Yield", t, ("key", key), ("value", value))
        return self.postfix(self.primary())

    def arguments(self) -> list[Node]:
        def one() -> Node:
            t = self.now
            if self.is_("...") and self.ahead().text == ")":
                self.next()
                return self.node("VariadicPlaceholder", t)
            name = None
            if t.kind == "name" and self.ahead().text == ":" and self.ahead(2).text != ":":
                name = self.identifier()
                self.need(":")
            unpack = self.take("...")
            return self.node("Arg", t, ("name", name), ("value", self.expression()), ("unpack", unpack))

        self.need("(")
        return self.many(one, ")")

    def postfix(self, left: Node) -> Node:
        while True:
            t = self.now
            if t.kind != "op":
                return left
            if t.text == "[" or t.text == "{" and False:
                self.next()
                dim = None if self.is_("]") else self.expression()
                self.need("]")
                left = self.node("ArrayDimFetch", left, ("var", left), ("dim", dim))
            elif t.text in ("->", "?->"):
                self.next()
                nullsafe = "Nullsafe" if t.text == "?->" else ""
                name = self.member_name()
                if self.is_("("):
                    left = self.node(f"{nullsafe}MethodCall", left, ("var", left), ("name", name), ("args", self.arguments()))
                else:
                    left = self.node(f"{nullsafe}PropertyFetch", left, ("var", left), ("name", name))
            elif t.text == "::":
                self.next()
                if self.now.kind == "variable":
                    v = self.next()
                    if self.is_("("):
                        var = Node("Variable", [("name", v.text[1:])], v.start, v.end, "variables", "name")
                        left = self.node("StaticCall", left, ("class", left), ("name", var), ("args", self.arguments()))
                    else:
                        name = Node("VarLikeIdentifier", [("name", v.text[1:])], v.start, v.end, "identifiers", "name")
                        left = self.node("StaticPropertyFetch", left, ("class", left), ("name", name))
                    continue
                name = self.member_name()
                if self.is_("("):
                    left = self.node("StaticCall", left, ("class", left), ("name", name), ("args", self.arguments()))
                else:
                    left = self.node("ClassConstFetch", left, ("class", left), ("name", name))
            elif t.text == "(":
                left = self.node("FuncCall", left, ("name", left), ("args", self.arguments()))
            elif t.text in ("++", "--"):
                self.next()
                left = self.node("PostInc" if t.text == "++" else "PostDec", left, ("var", left))
            else:
                return left

    def member_name(self) -> Node:
        if self.take("{"):
            found = self.expression()
            self.need("}")
            return found
        return self.variable() if self.now.kind == "variable" or self.is_("$") else self.identifier()

    def variable(self) -> Node:
        t = self.next()
        if t.kind == "variable":
            return Node("Variable", [("name", t.text[1:])], t.start, t.end, "variables", "name")
        if t.text == "$":
            if self.take("{"):
                name = self.expression()
                self.need("}")
            else:
                name = self.variable()
            return self.node("Variable", t, ("name", name), flag="variables", part="name")
        self.at -= 1
        raise self.fail()

    def items(self, stop: str) -> list[Node | None]:
        def one() -> Node | None:
            t = self.now
            if self.is_(","):
                return None
            unpack, ref = self.take("..."), self.take("&")
            key, value = None, self.expression()
            if self.take("=>"):
                key, ref = value, self.take("&")
                value = self.expression()
            return self.node("ArrayItem", t, ("key", key), ("value", value), ("byRef", ref), ("unpack", unpack))

        return self.many(one, stop)

    def primary(self) -> Node:
        t = self.now
        if t.kind == "variable" or t.text == "$" and t.kind == "op":
            return self.variable()
        if t.kind == "number":
            self.next()
            digits = t.text.replace("_", "").lower()
            if re.fullmatch(r"0x[0-9a-f]+|0b[01]+|0o?[0-7]+|\d+", digits) and not (digits[0] == "0" and re.search("[89]", digits) and "x" not in digits):
                base = 16 if digits[:2] == "0x" else 2 if digits[:2] == "0b" else 8 if len(digits) > 1 and digits[0] == "0" else 10
                n = int(digits[2:] if digits[:2] in ("0x", "0b", "0o") else digits, base)
                if n < 1 << 63:
                    return self.node("Int", t, ("value", n), flag="literals", part="value")
                return self.node("Float", t, ("value", float(n)), flag="literals", part="value")
            return self.node("Float", t, ("value", float(digits)), flag="literals", part="value")
        if t.kind in ("single", "nowdoc"):
            self.next()
            text = t.text if t.kind == "nowdoc" else re.sub(r"\\([\\'])", r"\1", t.text[t.text.index("'") + 1 : -1])
            return self.node("String", t, ("value", text), flag="literals", part="value")
        if t.kind in ("double", "heredoc", "shell"):
            self.next()
            return self.interpolated(t)
        if self.take("("):
            found = self.expression()
            self.need(")")
            return found
        if self.take("["):
            return self.node("Array", t, ("items", self.items("]")))
        if self.take("&"):
            return self.primary()
        if t.text == "#[":
            groups = self.attributes()
            found = self.primary()
            found.parts.insert(0, ("attrGroups", groups))
            return found
        if t.kind != "name":
            raise self.fail()
        word, after = t.text.lower(), self.ahead().text
        if word == "new":
            return self.new()
        if word in ("array", "list") and after == "(":
            self.at += 2
            return self.node("Array" if word == "array" else "List", t, ("items", self.items(")")))
        if word in ("isset", "empty") and after == "(":
            self.next()
            if word == "isset":
                self.next()
                return self.node("Isset", t, ("vars", self.many(self.expression, ")")))
            return self.node("Empty", t, ("expr", self.paren()))
        if word in ("exit", "die"):
            self.next()
            value = None
            if self.take("("):
                value = None if self.is_(")") else self.expression()
                self.need(")")
            return self.node("Exit", t, ("expr", value))
        if word == "match" and after == "(":
            return self.match()
        if word in ("function", "fn") or word == "static" and after.lower() in ("function", "fn"):
            return self.closure()
        if word in _MAGIC:
            self.next()
            return self.node(f"MagicConst_{word.strip('_')}", t)
        name = self.name()
        if self.is_("(", "::"):
            return name
        return self.node("ConstFetch", t, ("name", name))

    def new(self) -> Node:
        t = self.next()
        groups = self.attributes()
        self.take("readonly")
        if self.is_("class") and self.ahead().kind in ("op", "name"):
            c = self.next()
            args = self.arguments() if self.is_("(") else []
            parent = self.name() if self.take("extends") else None
            interfaces = self.names() if self.take("implements") else []
            own = self.node("Class", c, ("attrGroups", groups), ("name", None), ("extends", parent), ("implements", interfaces), ("stmts", self.members()))
            return self.node("New", t, ("class", own), ("args", args))
        if self.now.kind == "name":
            of = self.name()
        elif self.take("("):
            of = self.expression()
            self.need(")")
        else:
            of = self.variable()
        while self.is_("->", "::", "[") and not isinstance(of, Token):
            op = self.next().text
            if op == "[":
                dim = self.expression()
                self.need("]")
                of = self.node("ArrayDimFetch", of, ("var", of), ("dim", dim))
            elif op == "->":
                of = self.node("PropertyFetch", of, ("var", of), ("name", self.member_name()))
            else:
                v = self.next()
                of = self.node("StaticPropertyFetch", of, ("class", of), ("name", Node("VarLikeIdentifier", [("name", v.text.lstrip("$"))], v.start, v.end, "identifiers", "name")))
        return self.node("New", t, ("class", of), ("args", self.arguments() if self.is_("(") else []))

    def match(self) -> Node:
        t = self.next()
        cond = self.paren()

        def arm() -> Node:
            a = self.now
            if self.is_("default") and self.ahead().text in ("=>", ","):
                self.next()
                self.take(",")
                conds = None
            else:
                conds = []
                while not self.is_("=>"):
                    conds.append(self.expression())
                    self.take(",")
            self.need("=>")
            return self.node("MatchArm", a, ("conds", conds), ("body", self.expression()))

        self.need("{")
        return self.node("Match", t, ("cond", cond), ("arms", self.many(arm, "}")))

    def closure(self) -> Node:
        t = self.now
        static = self.take("static")
        word = self.next().text.lower()
        ref = self.take("&")
        params = self.parameters()
        if word == "fn":
            kind = self.return_type()
            self.need("=>")
            return self.node("ArrowFunction", t, ("static", static), ("byRef", ref), ("params", params), ("returnType", kind), ("expr", self.expression(4)))
        uses = []
        if self.take("use"):

            def one() -> Node:
                u = self.now
                by = self.take("&")
                return self.node("ClosureUse", u, ("var", self.variable()), ("byRef", by))

            self.need("(")
            uses = self.many(one, ")")
        kind = self.return_type()
        return self.node("Closure", t, ("static", static), ("byRef", ref), ("params", params), ("uses", uses), ("returnType", kind), ("stmts", self.braced()))

    def interpolated(self, t: Token) -> Node:
        text = t.text if t.kind == "heredoc" else t.text[t.text.index('"' if t.kind == "double" else "`") + 1 : -1]
        parts, at, plain, line = [], 0, "", t.start + (t.kind == "heredoc")

        def flush() -> None:
            nonlocal plain
            if plain:
                parts.append(Node("InterpolatedStringPart", [("value", _unescaped(plain))], t.start, t.end))
                plain = ""

        while at < len(text):
            rest = text[at:]
            if rest[0] == "\\" and len(rest) > 1:
                plain += rest[:2]
                at += 2
                continue
            if m := re.match(r"\{(?=\$)|\$\{", rest):
                stop = _closing(text, at + m.end())
                inner = text[at + m.end() : stop]
                flush()
                if m.group() == "${" and (simple := re.fullmatch(r"[A-Za-z_]\w*", inner)):
                    parts.append(Node("Variable", [("name", simple.group())], t.start, t.end, "variables", "name"))
                elif m.group() == "${" and (dim := re.fullmatch(r"([A-Za-z_]\w*)\[(.*)\]", inner, re.S)):
                    parts.append(_sub(f"${dim[1]}[{dim[2]}]", line))
                else:
                    own = _sub(inner, line)
                    parts.append(own if m.group() == "{" else Node("Variable", [("name", own)], t.start, t.end, "variables", "name"))
                at = stop + 1
                continue
            if m := re.match(r"\$[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(\[(?:-?\d+|[A-Za-z_]\w*|\$[A-Za-z_]\w*)\]|\??->[A-Za-z_]\w*)?", rest):
                flush()
                code = re.sub(r"\[([A-Za-z_]\w*)\]$", r"['\1']", m.group())
                parts.append(_sub(code, line))
                at += m.end()
                continue
            plain += rest[0]
            at += 1
        if not parts and t.kind != "shell":
            return self.node("String", t, ("value", _unescaped(plain)), flag="literals", part="value")
        flush()
        return self.node("ShellExec" if t.kind == "shell" else "InterpolatedString", t, ("parts", parts))


def _closing(text: str, at: int) -> int:
    depth = 0
    while at < len(text):
        if m := re.compile(r"'(?:[^'\\]|\\.)*'", re.S).match(text, at):
            at = m.end()
            continue
        if text[at] == "{":
            depth += 1
        elif text[at] == "}":
            if not depth:
                return at
            depth -= 1
        at += 1
    raise ParseError("Parse error: brace in a string without an end")


def _sub(code: str, line: int) -> Node:
    parser = Parser(tokenize(code, line, True))
    found = parser.expression()
    if parser.now.kind != "eof":
        raise parser.fail()
    return found


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "v": "\v", "e": "\x1b", "f": "\f", "\\": "\\", "$": "$", '"': '"', "`": "`"}


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] == "u":
            return chr(int(x[2:-1], 16))
        if x[0] == "x":
            return chr(int(x[1:], 16))
        return _ESCAPES[x] if x in _ESCAPES else chr(int(x, 8) & 255)

    return re.sub(r"\\(u\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{1,2}|[0-7]{1,3}|[ntrvef\\$\"`])", one, text)


def parse(source: str) -> list[Node]:
    """The file's statements."""
    parser = Parser(tokenize(source))
    try:
        found = parser.statements()
    except RecursionError:
        raise ParseError("Parse error: nested too deeply") from None
    if parser.now.kind != "eof":
        raise parser.fail()
    return found
