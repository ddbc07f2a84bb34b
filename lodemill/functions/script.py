"""Functions of JavaScript and TypeScript sources and their metrics, by a scanner of our own.

It reads statements, functions, classes and object literals, and in expressions only what the
metrics need: nested functions, conditional and logical operators. Types are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"(?P<space>[^\S\n]+|\\\n)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?\*/|<!--[^\n]*)"
    r"|(?P<string>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")|(?P<number>\.?\d(?:[eE][+-]|[\w.])*)|(?P<name>#?[^\W\d][\w$]*|\$[\w$]*)"
    r"|(?P<mark>=>|\?\.(?!\d)|\?\?=|&&=|\|\|=|\?\?|&&|\|\||\.\.\.|===|!==|==|!=|<=|>=|\+\+|--|\*\*|[-+*/%&|^]=|.)",
    re.DOTALL,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
#: After these words an operand comes.
_BEFORE_OPERAND = frozenset("return typeof case in of delete void throw new else do instanceof await yield default extends".split())
_CONTINUES = frozenset(". ?. ( [ `( + - * / % & | ^ < > = , ? : && || ?? => == === != !== <= >= ** += -= *= /= %= &= |= ^= ??= &&= ||=".split())
_CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}$", "`(": "`)"}
_MODIFIERS = frozenset("static async get set public private protected readonly abstract override declare accessor *".split())


@dataclass
class Token:
    kind: str
    text: str
    at: int
    end: int
    line: int
    fresh: bool  # on another line than the token before


@dataclass
class Node:
    kind: str
    kids: list[Node] = field(default_factory=list)
    condition: list[Node] = field(default_factory=list)
    otherwise: list[Node] | None = None
    name: str = ""
    line: int = 0
    end_line: int = 0
    params: int = 0
    start: int = -1  # the token that begins a function


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    at, line, fresh, depths = 0, 1, False, []  # depths: of braces, for each template that is open

    def add(kind: str, text: str, end: int) -> None:
        nonlocal at, line, fresh
        out.append(Token(kind, text, at, end, line, fresh))
        line += source.count("\n", at, end)
        at, fresh = end, False

    def literal() -> None:
        """A template's characters up to its end or its next expression."""
        nonlocal at, line
        begun = at
        while at < len(source) and source[at] != "`" and not source.startswith("${", at):
            at += 2 if source[at] == "\\" else 1
        line += source.count("\n", begun, at)
        if at >= len(source):
            raise SyntaxError("a template has no end")
        if source[at] == "`":
            add("mark", "`)", at + 1)
        else:
            depths.append(0)
            add("mark", "${", at + 2)

    while at < len(source):
        last = out[-1] if out else None
        operand = last is None or (last.kind == "mark" and last.text not in (")", "]", "}", "`)", "++", "--")) or last.text in _BEFORE_OPERAND
        if source[at] == "/" and source[at + 1 : at + 2] not in ("/", "*") and operand and (m := _REGEX.match(source, at)):
            add("string", m.group(), m.end())
            continue
        if source[at] == "`":
            add("mark", "`(", at + 1)
            literal()
            continue
        m = _TOKEN.match(source, at)
        kind, text = m.lastgroup, m.group()
        if kind in ("space", "line", "comment"):
            fresh = fresh or "\n" in text
            line += text.count("\n")
            at = m.end()
        elif depths and text == "}" and not depths[-1]:
            depths.pop()
            add("mark", "}$", at + 1)
            literal()
        else:
            if depths and text in "{}":
                depths[-1] += 1 if text == "{" else -1
            add(kind, text, m.end())
    out.append(Token("end", "", at, at, line, True))
    return out


class Parser:
    def __init__(self, source: str):
        self.source, self.all, self.k = source, tokens(source), 0
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for k, t in enumerate(self.all):
            if t.kind != "mark":
                continue
            if t.text in _CLOSE:
                stack.append(k)
            elif t.text in _CLOSE.values():
                if not stack or _CLOSE[self.all[stack[-1]].text] != t.text:
                    raise SyntaxError(f"{t.text} on line {t.line} closes nothing")
                self.close[stack.pop()] = k
        if stack:
            raise SyntaxError(f"{self.all[stack[-1]].text} on line {self.all[stack[-1]].line} is not closed")

    def see(self, *texts: str, ahead: int = 0) -> bool:
        t = self.all[min(self.k + ahead, len(self.all) - 1)]
        return t.kind in ("mark", "name") and t.text in texts

    def now(self) -> Token:
        return self.all[self.k]

    def take(self) -> Token:
        self.k = min(self.k + 1, len(self.all) - 1)
        return self.all[self.k - 1]

    def skip(self) -> None:
        """Pass over a bracket and all that it holds, or one token."""
        self.k = self.close.get(self.k, self.k)
        self.take()

    def program(self) -> list[Node]:
        out = []
        while self.now().kind != "end":
            out += self.statement()
        return out

    def _block(self) -> list[Node]:
        end, out = self.close[self.k], []
        self.take()
        while self.k < end:
            out += self.statement()
        self.take()
        return out

    def _head(self) -> list[Node]:
        """What stands in the parentheses after a keyword."""
        if not self.see("("):
            return []
        end = self.close[self.k]
        self.take()
        out = []
        while self.k < end:
            out += self.expression(())
            if self.k < end:
                self.take()
        self.take()
        return out

    def statement(self) -> list[Node]:
        t = self.now()
        word, after = t.text if t.kind == "name" else "", self.all[min(self.k + 1, len(self.all) - 1)]
        if self.see("{"):
            return self._block()
        if self.see(";"):
            self.take()
            return []
        if word == "if":
            self.take()
            condition, kids = self._head(), self.statement()
            otherwise = None
            if self.see("else"):
                self.take()
                otherwise = self.statement()
            return [Node("if", kids, condition, otherwise)]
        if word in ("for", "while"):
            self.take()
            if self.see("await"):
                self.take()
            return [Node("loop", self._head() + self.statement())]
        if word == "do":
            self.take()
            kids = self.statement()
            if self.see("while"):
                self.take()
                kids += self._head()
            return [Node("loop", kids)]
        if word == "switch":
            self.take()
            return [Node("switch", self._head() + self._cases())]
        if word == "try":
            self.take()
            out = self._block()
            if self.see("catch"):
                self.take()
                out.append(Node("catch", self._head() + self._block()))
            if self.see("finally"):
                self.take()
                out += self._block()
            return out
        if word == "export":
            self.take()
            if self.see("default"):
                self.take()
                return self.expression((";",), ends=True) if self.see("{") else self.statement()
            return self._line() if self.see("{", "*", "=") else self.statement()
        if word == "import" and after.text not in ("(", "."):
            return self._line()
        if word in ("interface", "enum", "namespace", "module") and after.kind in ("name", "string") and not after.fresh:
            while not self.see("{") and self.now().kind != "end":
                self.take()
            if word in ("namespace", "module"):
                return self._block()
            self.skip()
            return []
        if word == "type" and after.kind == "name" and not after.fresh:
            self.take()
            self.take()
            if self.see("<"):
                self._angles()
            if self.see("="):
                self.take()
            self._type((";",), line=True)
            return []
        if word in ("declare", "abstract") and after.kind == "name" and not after.fresh:
            self.take()
            return self.statement()
        if word == "const" and after.text == "enum":
            self.take()
            return self.statement()
        if word in ("var", "let", "const") and (after.kind == "name" or after.text in ("{", "[")):
            return self._declared()
        if self.see("@"):
            return self._decorator() + self.statement()
        if t.kind == "name" and after.text == ":" and word not in ("case", "default"):
            self.take()
            self.take()
            return self.statement()
        out = self.expression((";",), ends=True)
        if self.see(";"):
            self.take()
        elif self.now() is t:
            self.take()  # what nothing else has taken
        return out

    def _line(self) -> list[Node]:
        """Pass over an import or export list."""
        self.take()
        while not self.see(";") and self.now().kind != "end" and not (self.now().fresh and self.all[self.k - 1].text not in (",", "from")):
            self.skip()
        return []

    def _cases(self) -> list[Node]:
        end, out = self.close[self.k], []
        self.take()
        while self.k < end:
            if self.see("case", "default"):
                head = self.expression((":",)) if self.take().text == "case" else []
                if self.see(":"):
                    self.take()
                out.append(Node("case", head))
            else:
                out += self.statement()
        self.take()
        return out

    def _declared(self) -> list[Node]:
        self.take()
        out = []
        while True:
            begun = self.now().at
            if self.see("{", "["):
                out += self.expression(("=", ":", ";", ",", "of", "in"))
            elif self.now().kind == "name":
                self.take()
            name = self.source[begun : self.all[self.k - 1].end]
            if self.see("!"):
                self.take()
            if self.see(":"):
                self.take()
                self._type(("=", ",", ";"), line=True)
            if self.see("="):
                self.take()
                out += self.expression((",", ";"), ends=True, name=name)
            if not self.see(","):
                break
            self.take()
        if self.see(";"):
            self.take()
        return out

    def _decorator(self) -> list[Node]:
        self.take()
        if not self.see("("):
            self.take()
        while self.see("."):
            self.take()
            self.take()
        return self._head() if self.see("(") else []

    def _angles(self) -> None:
        depth = 0
        while self.now().kind != "end":
            depth += self.see("<") - self.see(">")
            self.skip()
            if depth <= 0:
                return

    def _type(self, stops: tuple[str, ...], line: bool = False) -> None:
        """Pass over a type; a brace or a new line after a whole type ends it."""
        whole = False
        while self.now().kind != "end":
            t = self.now()
            if t.text in (")", "]", "}", "}$") or whole and (self.see(*stops) or self.see("{") or line and t.fresh and not self.see("|", "&", "?", ":", ".", "=>", "extends")):
                return
            if self.see("<"):
                self._angles()
                whole = True
                continue
            whole = t.kind in ("name", "string", "number") and t.text not in ("keyof", "typeof", "extends", "infer", "readonly", "is", "asserts", "unique", "new") or t.text in ("(", "[", "{", "`(", ">")
            self.skip()

    def expression(self, stops: tuple[str, ...], ends: bool = False, name: str = "") -> list[Node]:
        """Nodes up to a stop, which is left; with ``ends`` a line end may end it. A function that is all there is has the name."""
        out, first, left = [], self.k, self.now().at
        while self.now().kind != "end":
            t, last = self.now(), self.all[self.k - 1]
            if t.kind == "mark" and (t.text in stops or t.text in (")", "]", "}", "}$", "`)")):
                break
            if t.kind == "name" and t.text in stops and self.k > first:
                break
            if ends and self.k > first and t.fresh and self._whole(last) and not (t.text in _CONTINUES or t.text in ("in", "instanceof", "as", "satisfies")):
                break
            if t.kind == "name" and (made := self._function(stops)):
                self._named(made[0], name if self.k_of(made) == first else "", self.k)
                out += made
            elif self.see("class"):
                out += self._class()
            elif self.see("("):
                if self._is_arrow(":" in stops):
                    made = self._arrow(self.k)
                    self._named(made, name if made.start == first else "", self.k)
                    out.append(made)
                else:
                    out += self._head()
            elif self.see("["):
                end = self.close[self.k]
                self.take()
                while self.k < end:
                    out += self.expression((",",))
                    if self.k < end:
                        self.take()
                self.take()
            elif self.see("{"):
                out += self._object()
            elif self.see("`("):
                end = self.close[self.k]
                self.take()
                while self.k < end:
                    self.take()
                    out += self.expression(())
                    self.take()
                self.take()
            elif self.see("?"):
                self.take()
                out.append(Node("ternary", self.expression((":",))))
                if self.see(":"):
                    self.take()
                left, first, name = self.now().at, self.k, ""
            elif self.see("&&", "||", "??"):
                self.take()
                out.append(Node("logical"))
                left, first, name = self.now().at, self.k, ""
            elif self.see("="):
                name = self.source[left : last.end]
                self.take()
                left, first = self.now().at, self.k
            elif self.see(",") or t.text in _BEFORE_OPERAND and t.kind == "name":
                self.take()
                left, first, name = self.now().at, self.k, ""
            else:
                self.take()
        return out

    @staticmethod
    def k_of(made: list[Node]) -> int:
        return made[0].start

    def _named(self, made: Node, name: str, after: int) -> None:
        """A function takes the name of what it is the whole value of."""
        t = self.all[after]
        if not made.name:
            made.name = name if name and not (t.kind == "mark" and t.text in (".", "?.", "(", "[", "`(")) else "(anonymous)"

    @staticmethod
    def _whole(t: Token) -> bool:
        return t.kind in ("string", "number") or t.text in (")", "]", "}", "`)", "++", "--") or t.kind == "name" and t.text not in _BEFORE_OPERAND or t.text == "return"

    def _is_arrow(self, in_ternary: bool) -> bool:
        after = self.close[self.k] + 1
        if self.all[after].text == "=>":
            return True
        if self.all[after].text != ":" or in_ternary:
            return False
        here = self.k
        self.k = after + 1
        self._type(("=>", ",", ";", "="))
        arrow = self.see("=>")
        self.k = here
        return arrow

    def _function(self, stops: tuple[str, ...]) -> list[Node] | None:
        """The function that begins with the word here, if one does."""
        start, ahead = self.k, 1 if self.see("async") and not self.all[self.k + 1].fresh else 0
        if ahead and (self.see("function", ahead=1) or self.see("(", ahead=1) or self.all[self.k + 1].kind == "name" and self.see("=>", ahead=2)):
            if self.see("(", ahead=1):
                self.k += 1
                arrow = self._is_arrow(":" in stops)
                self.k = start
                if not arrow:
                    return None
        else:
            ahead = 0
        if self.see("function", ahead=ahead):
            self.k += ahead + 1
            if self.see("*"):
                self.take()
            name = self.take().text if self.now().kind == "name" else ""
            return self._callable(start, name)
        if self.see("(", ahead=ahead) or self.all[self.k + ahead].kind == "name" and self.see("=>", ahead=ahead + 1):
            if ahead or not self.see("("):
                self.k += ahead
                return [self._arrow(start)]
        return None

    def _callable(self, start: int, name: str) -> list[Node]:
        """Parameters and body; without a body it is a signature and no function."""
        if self.see("<"):
            self._angles()
        params, head = self._params()
        if self.see(":"):
            self.take()
            self._type((";", ","), line=True)
        if not self.see("{"):
            return []
        made = Node("function", name=name, line=self.all[start].line, params=params, condition=head)
        made.start = start
        made.kids = self._block()
        made.end_line = self.all[self.k - 1].line
        return [made]

    def _params(self) -> tuple[int, list[Node]]:
        end, n, out = self.close[self.k], 0, []
        self.take()
        while self.k < end:
            n += 1
            while self.k < end and not self.see(","):
                if self.see(":"):
                    self.take()
                    self._type((",", "="))
                elif self.see("="):
                    self.take()
                    out += self.expression((",",))
                elif self.see("{", "["):
                    out += self.expression((",", ":", "="))
                elif self.see("@"):
                    out += self._decorator()
                else:
                    self.take()
            if self.k < end:
                self.take()
        self.take()
        return n, out

    def _arrow(self, start: int) -> Node:
        if self.see("("):
            params, head = self._params()
            if self.see(":"):
                self.take()
                self._type(("=>",))
        else:
            self.take()
            params, head = 1, []
        self.take()  # the arrow
        made = Node("function", line=self.all[start].line, params=params, condition=head)
        made.start = start
        made.kids = self._block() if self.see("{") else self.expression((",", ";", ":"), ends=True)
        made.end_line = self.all[self.k - 1].line
        return made

    def _key(self) -> str:
        begun = self.now().at
        self.skip()
        return self.source[begun : self.all[self.k - 1].end]

    def _object(self) -> list[Node]:
        end, out = self.close[self.k], []
        self.take()
        while self.k < end:
            if self.see("..."):
                self.take()
                out += self.expression((",",))
            elif not self.see(","):
                start = self.k
                while self.now().text in _MODIFIERS and self.all[self.k + 1].text not in ("(", ":", ",", "}", "=", "<"):
                    self.take()
                key = self._key()
                if self.see("(", "<"):
                    out += self._callable(start, key)
                elif self.see(":", "="):
                    self.take()
                    out += self.expression((",",), name=key)
            if self.see(","):
                self.take()
        self.take()
        return out

    def _class(self) -> list[Node]:
        out: list[Node] = []
        while not self.see("{") and self.now().kind != "end":
            if self.see("<"):
                self._angles()
            else:
                self.skip()
        if self.now().kind == "end":
            return out
        end = self.close[self.k]
        self.take()
        while self.k < end:
            if self.see(";"):
                self.take()
                continue
            if self.see("@"):
                out += self._decorator()
                continue
            start = self.k
            while self.now().text in _MODIFIERS and self.all[self.k + 1].text not in ("(", ":", ";", "}", "=", "<", "?", "!"):
                self.take()
                if self.see("{"):  # a static block
                    break
            if self.see("{"):
                out += self._block()
                continue
            key = self._key()
            if self.see("?", "!"):
                self.take()
            if self.see("(", "<"):
                out += self._callable(start, key)
                continue
            if self.see(":"):
                self.take()
                self._type((";", "="), line=True)
            if self.see("="):
                self.take()
                out += self.expression((";",), ends=True)
        self.take()
        return out


def _paths(nodes: list[Node]) -> int:
    n, todo = 0, list(nodes)
    while todo:
        node = todo.pop()
        if node.kind != "function":
            n += 1  # each kind is a decision
            n -= node.kind == "switch"
            todo += node.kids + node.condition + (node.otherwise or [])
    return n


def _burden(nodes: list[Node]) -> tuple[int, int]:
    """Score, and the deepest nesting: a branch costs one and its depth, an else one; conditions of ifs are not looked at."""
    total = deepest = 0
    todo = [(n, 0) for n in nodes]
    while todo:
        node, depth = todo.pop()
        if node.kind == "function":
            continue
        if node.kind in ("if", "loop", "catch", "switch"):
            total += 1 + depth
            deepest = max(deepest, depth + 1)
            todo += [(c, depth + 1) for c in node.kids]
            if node.otherwise is not None:
                chained = len(node.otherwise) == 1 and node.otherwise[0].kind == "if"
                total += not chained
                todo += [(c, depth) for c in node.otherwise]
            continue
        total += {"ternary": 1 + depth, "logical": 1}.get(node.kind, 0)
        todo += [(c, depth) for c in node.kids]
    return total, deepest


def measured(source: str) -> Iterator[tuple]:
    """Each function in source order: name, first and last line, lines, source lines, parameters, cyclomatic and cognitive score, nesting."""
    lines, found = source.splitlines(), []
    todo = Parser(source).program()
    while todo:
        node = todo.pop()
        if node.kind == "function":
            found.append(node)
        todo += node.condition + node.kids + (node.otherwise or [])
    for f in sorted(found, key=lambda f: f.start):
        text = [x.strip() for x in lines[f.line - 1 : f.end_line]]
        sloc = sum(bool(x) and not x.startswith("//") and not (x.startswith("/*") and x.endswith("*/")) for x in text)
        yield f.name or "(anonymous)", f.line, f.end_line, len(text), sloc, f.params, 1 + _paths(f.kids), *_burden(f.kids)
