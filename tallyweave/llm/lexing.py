"""Lexers of five brace languages as maps from entry state to exit state.

A part of a file is summarised without knowing what came before it: for every
lexer state it may begin in the summary holds the state it ends in, its unmatched
closing and opening brackets and whether a lexical error occurred. Summaries
combine associatively, so parts of a file may be reduced in any grouping, and the
reduced summary says the same as lexing the whole file.

A state is a pair of a mode and a number:
    code     1 if the last token ended an operand (a slash then divides), else 0
    comment  how many comments are open (they nest in Rust)
    tick     inside a backtick string
    text     inside a string of several lines: its number of hashes, or -1 if plain
    double, single   inside a quoted string that a backslash carries over the line end
Brackets are part of the state as well, since what ``}`` means in a template
depends on them: ``$`` stands for ``${``. What a part does at a closing brace that
it did not open is left open: the summary forks there (:class:`Node`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache

CODE, COMMENT, TICK, TEXT, DOUBLE, SINGLE = "code", "comment", "tick", "text", "double", "single"
#: Modes in which a line may begin, by language.
STATES = {
    "javascript": (CODE, COMMENT, TICK, DOUBLE, SINGLE),
    "typescript": (CODE, COMMENT, TICK, DOUBLE, SINGLE),
    "go": (CODE, COMMENT, TICK),
    "rust": (CODE, COMMENT, TEXT),
    "java": (CODE, COMMENT, TEXT),
}
PAIRS = {")": "(", "]": "[", "}": "{"}
State = tuple[str, int]
START: State = (CODE, 0)

_ID = r"[^\W\d]\w*"
_OPS = {
    "javascript": r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%=<>!~&|^?:;,.@]",
    "go": r"&\^=|<<=|>>=|\.\.\.|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%=<>!&|^:;,.~]",
    "rust": r"<<=|>>=|\.\.\.|\.\.=|->|=>|::|\.\.|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[-+*/%=<>!&|^?:;,.@#$~]",
    "java": r">>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%=<>!~&|^?:;,.@]",
}
_OPS["typescript"] = _OPS["javascript"]
_NUMBER = {
    "javascript": r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+)n?|(?:(?:0|[1-9][\d_]*)(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?",
    "go": r"0[xX][\da-fA-F_.pP+]+i?|0[bB][01_]+|0[oO]?[0-7_]*(?![\d.])|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?",
    "rust": r"(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?",
    "java": r"0[xX][\da-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?",
}
_NUMBER["typescript"] = _NUMBER["javascript"]
_DQ = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'
_STRING = {
    "javascript": rf"{_DQ}|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'",
    "go": r"\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\(?:[^xuU0-7\n]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}))'",
    "rust": r"b?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u\{[\da-fA-F_]+\}|[^xu\n]))'",
    "java": r"\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\[^u\n])'",
}
_STRING["typescript"] = _STRING["javascript"]
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_REST = {
    DOUBLE: re.compile(r'(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*(?P<end>"|\Z)'),
    SINGLE: re.compile(r"(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*(?P<end>'|\Z)"),
    TEXT: re.compile(r'(?:[^"\\]|\\[\s\S])*(?P<end>"|\\?\Z)'),
}
_HASHED = re.compile(r'"(#*)')


@lru_cache
def _master(lang: str) -> re.Pattern:
    ident = rf"#?[A-Za-z_$\u0080-\U0010ffff][\w$]*" if lang in ("javascript", "typescript") else (rf"(?:r#)?{_ID}" if lang == "rust" else (r"[A-Za-z_$\u0080-\U0010ffff][\w$]*" if lang == "java" else _ID))
    raw = r"|(?P<raw>b?r#*\")" if lang == "rust" else (r"|(?P<raw>\"\"\"[ \t\f]*\r?\n)" if lang == "java" else "")
    life = r"|(?P<life>'[A-Za-z_]\w*(?!'))" if lang == "rust" else ""
    tick = r"|(?P<tick>`)" if lang in ("javascript", "typescript", "go") else ""
    return re.compile(
        rf"(?P<space>[ \t\f\v\r ﻿]+)|(?P<eol>\n+)|(?P<line>//[^\n]*)|(?P<block>/\*){raw}{tick}"
        rf"|(?P<nums>(?:-?(?:0x[\da-fA-F]+|[1-9]\d*|0)\s*,\s*){{2,}})"
        rf"|(?P<str>{_STRING[lang]}){life}|(?P<num>{_NUMBER[lang]})(?!\w)|(?P<id>{ident})|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<op>{_OPS[lang]})"
    )


_HARD_END = re.compile(r"\*/")
_NEST = re.compile(r"/\*|\*/")
_TICK_END = re.compile(r"`|\$\{|\\[\s\S]")


@dataclass
class Lexed:
    """Tokens (kind, text, newline before) and how the part ended."""

    tokens: list[tuple[str, str, bool]]
    state: str
    error: str | None
    argument: int = 0
    newline: bool = True
    closers: str = ""
    openers: str = ""
    fork: int | None = None


class _Scanner:
    """Lexes from ``pos`` on. With ``outer``, the brackets open before, a closing
    brace is matched against them; without, the scanner stops at the first brace of
    JavaScript or TypeScript that it did not see opened (``fork`` is the place behind it)."""

    def __init__(self, lang: str, text: str, pos: int = 0, outer: list[str] | None = None, newline: bool = True) -> None:
        self.lang, self.text, self.pos, self.size = lang, text, pos, len(text)
        self.js = lang in ("javascript", "typescript")
        self.tokens: list[tuple[str, str, bool]] = []
        self.newline, self.error, self.argument = newline, None, 0
        self.opens: list[str] = []
        self.closers: list[str] = []
        self.outer, self.fork, self.operand = outer, None, False

    def add(self, kind: str, text: str) -> None:
        self.tokens.append((kind, text, self.newline))
        self.newline = False

    def after_operand(self) -> bool:
        return _ends_operand(self.tokens[-1]) if self.tokens else self.operand

    def comment(self, depth: int) -> str:
        pos = self.pos
        pattern = _NEST if self.lang == "rust" else _HARD_END
        while depth:
            m = pattern.search(self.text, pos)
            if not m:
                self.pos, self.argument = self.size, depth
                return COMMENT
            depth += 1 if m.group() == "/*" else -1
            pos = m.end()
        if "\n" in self.text[self.pos : pos]:
            self.newline = True
        self.pos = pos
        return CODE

    def tick(self) -> str:
        if self.lang == "go":
            end = self.text.find("`", self.pos)
            if end < 0:
                self.pos = self.size
                return TICK
            self.pos = end + 1
            self.add("str", "`")
            return CODE
        while True:
            m = _TICK_END.search(self.text, self.pos)
            if not m:
                self.pos = self.size
                return TICK
            self.pos = m.end()
            if m.group() == "`":
                self.add("str", "`")
                return CODE
            if m.group() == "${":
                self.add("open", "${")
                self.opens.append("$")
                return CODE

    def raw(self, hashes: int) -> str:
        """The rest of a raw string of Rust or a text block of Java."""
        close = '"""' if self.lang == "java" else '"' + "#" * hashes
        end = self.text.find(close, self.pos)
        while self.lang == "java" and end > 0 and _escaped(self.text, end, self.pos):
            end = self.text.find(close, end + 1)
        if end < 0:
            self.pos, self.argument = self.size, hashes
            return TEXT
        self.pos = end + len(close)
        self.add("str", close)
        return CODE

    def quoted(self, mode: str) -> str:
        """The rest of a quoted string; an unescaped line end is an error but in Rust."""
        m = _REST[mode].match(self.text, self.pos)
        if m is None:
            self.error = "unterminated string"
            return CODE
        self.pos = m.end()
        if m.group("end") in ("", "\\"):
            self.argument = -1 if mode == TEXT else 0
            return mode
        self.add("str", '"')
        return CODE

    def closing(self, c: str) -> str | None:
        """Match a closing bracket; the bracket it closes, null where it stays open here."""
        if self.opens:
            return self.opens.pop()
        if self.outer:
            return self.outer.pop()
        if self.outer is None and self.js and c == "}":
            self.fork = self.pos
            return None
        self.closers.append(c)
        return None

    def run(self, state: State) -> Lexed:
        mode, argument = state
        if mode == COMMENT:
            mode = self.comment(argument or 1)
        elif mode == TICK:
            mode = self.tick()
        elif mode == TEXT:
            mode = self.quoted(TEXT) if argument < 0 else self.raw(argument)
        elif mode in (DOUBLE, SINGLE):
            mode = self.quoted(mode)
        else:
            self.operand = bool(argument)
        js = self.js
        match, tokens = _master(self.lang).match, self.tokens
        while mode == CODE and self.pos < self.size and self.error is None:
            m = match(self.text, self.pos)
            if m is None:
                self.broken()
                if self.error:
                    break
                mode = self.quoted(self.argument_mode)
                continue
            kind, self.pos = m.lastgroup, m.end()
            if kind == "space" or kind == "line":
                continue
            if kind == "eol":
                self.newline = True
            elif kind == "block":
                mode = self.comment(1)
            elif kind == "tick":
                if js and tokens and _ends_operand(tokens[-1]) and not self.newline:
                    tokens.pop() if tokens[-1][0] == "id" else None  # a tagged template
                mode = self.tick()
            elif kind == "raw":
                mode = self.raw(m.group().count("#"))
            elif kind == "op":
                text = m.group()
                if js and text in ("/", "/=") and not self.after_operand():
                    r = _REGEX.match(self.text, m.start())
                    if not r:
                        self.error = "unterminated regular expression"
                        break
                    self.pos = r.end()
                    self.add("str", "/")
                else:
                    self.add("op", text)
            elif kind == "open":
                self.opens.append(m.group())
                self.add(kind, m.group())
            elif kind == "close":
                text = m.group()
                top = self.closing(text)
                if self.fork is not None:
                    break
                if top == "$" and text == "}":
                    self.add("close", "$}")
                    mode = self.tick()
                    continue
                if top is not None and top != PAIRS[text]:
                    self.error = f"mismatched {text}"
                    break
                self.add("close", text)
            else:
                text = m.group()
                if kind == "nums" and "\n" in text:
                    self.add(kind, "0,")
                    self.newline = text.rstrip(" \t\r").endswith("\n")
                else:
                    self.add(kind, text)
        if mode == CODE:
            self.argument = int(js and self.after_operand())
        return Lexed(tokens, mode, self.error, self.argument, self.newline, "".join(self.closers), "".join(self.opens), self.fork)

    def broken(self) -> None:
        """What no token matches: a string that goes on in the next part, or an error."""
        text, pos = self.text, self.pos
        quote = pos + 1 if self.lang == "rust" and text.startswith('b"', pos) else pos
        mode = {'"': TEXT if self.lang == "rust" else DOUBLE, "'": SINGLE}.get(text[quote])
        if mode in STATES[self.lang]:
            m = _REST[mode].match(text, quote + 1)
            if m is not None and m.end() == self.size and m.group("end") in ("", "\\"):
                self.pos, self.argument_mode = quote + 1, mode
                return
        self.error = f"illegal character {text[pos]!r}"


def _escaped(text: str, at: int, start: int) -> bool:
    n = 0
    while at - n > start and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def _ends_operand(token: tuple[str, str, bool]) -> bool:
    kind, text, _ = token
    if kind == "id":
        return text not in _BEFORE_REGEX
    return kind in ("num", "str") or (kind == "close" and text != "$}") or text in ("++", "--")


_BEFORE_REGEX = {"return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "yield", "await"}


def lex(lang: str, text: str, state: State = START, outer: list[str] | None = None, newline: bool = True) -> Lexed:
    """Tokens of a part of a file that begins in ``state`` with the brackets ``outer`` open.

    ``outer`` is changed: what the part closes is taken off, what it leaves open put on.
    """
    outer = [] if outer is None else outer
    out = _Scanner(lang, text, 0, outer, newline).run(state)
    outer.extend(out.openers)
    return out


@dataclass(frozen=True)
class Node:
    """What a part does from some place on: it closes ``closers``, then either ends in
    ``state`` with ``openers`` open, or meets a brace it did not see opened and goes on
    at the node ``code`` when that closes a brace, at ``tick`` when it closes ``${``."""

    closers: str
    state: State
    openers: str
    error: str | None
    code: int = -1
    tick: int = -1


@dataclass(frozen=True)
class Summary:
    """Entry state -> node. Entry states not listed are comments or raw strings too deep
    to end in the part; of a comment ``nesting`` more are open behind it."""

    entries: tuple[tuple[State, int], ...]
    nodes: tuple[Node, ...]
    nesting: int = 0

    def of(self, state: State) -> Node:
        for s, n in self.entries:
            if s == state:
                return self.nodes[n]
        mode, argument = state
        return Node("", (mode, argument + self.nesting if mode == COMMENT else argument), "", None)

    def dump(self) -> list:
        return [[[*s, n] for s, n in self.entries], [[n.closers, *n.state, n.openers, n.error, n.code, n.tick] for n in self.nodes], self.nesting]

    @staticmethod
    def load(rows: list) -> Summary:
        entries, nodes, nesting = rows
        return Summary(tuple(((m, a), n) for m, a, n in entries), tuple(Node(c, (m, a), o, e, x, y) for c, m, a, o, e, x, y in nodes), nesting)


def entry_states(lang: str, text: str) -> tuple[list[State], int]:
    """The states that a part can tell apart, and how many comments it opens for good."""
    out: list[State] = [(CODE, 0)]
    nesting = 0
    if lang in ("javascript", "typescript"):
        out += [(CODE, 1), (COMMENT, 1), (TICK, 0), (DOUBLE, 0), (SINGLE, 0)]
    elif lang == "go":
        out += [(COMMENT, 1), (TICK, 0)]
    elif lang == "java":
        out += [(COMMENT, 1), (TEXT, 0)]
    else:
        least = 0
        for m in _NEST.finditer(text):
            nesting += 1 if m.group() == "/*" else -1
            least = min(least, nesting)
        out += [(COMMENT, d) for d in range(1, -least + 1)]
        out += [(TEXT, h) for h in range(-1, max((len(m.group(1)) for m in _HASHED.finditer(text)), default=-1) + 1)]
    return out, nesting


def summarise(lang: str, text: str, first: bool = False, runs: dict[State, Lexed] | None = None) -> Summary:
    """The map of a part; of the first part of a file, which begins in plain code, that entry only.

    ``runs`` takes what was lexed from each entry state.
    """
    states, nesting = ([START], 0) if first else entry_states(lang, text)
    nodes: list[Node | None] = []
    known: dict[tuple[int, State], int] = {}
    waiting: list[tuple[int, State]] = []

    def node(pos: int, state: State) -> int:
        if (pos, state) not in known:
            known[pos, state] = len(nodes)
            nodes.append(None)
            waiting.append((pos, state))
        return known[pos, state]

    entries = tuple((s, node(0, s)) for s in states)
    while waiting:
        pos, state = waiting.pop()
        x = _Scanner(lang, text, pos).run(state)
        if runs is not None and not pos:
            runs[state] = x
        code = tick = -1
        if x.fork is not None:
            code, tick = node(x.fork, (CODE, 1)), node(x.fork, (TICK, 0))
        nodes[known[pos, state]] = Node(x.closers, (x.state, x.argument), x.openers, x.error, code, tick)
    return Summary(entries, tuple(nodes), nesting)


def combine(a: Summary, b: Summary) -> Summary:
    """The summary of a part followed by another; associative."""
    shift = len(a.nodes)
    moved = tuple(n if n.code < 0 else replace(n, code=n.code + shift, tick=n.tick + shift) for n in b.nodes)

    def through(n: Node) -> Node:
        if n.error or n.code >= 0:
            return n
        closers, stack, at = [n.closers], list(n.openers), b.of(n.state)
        while True:
            for c in at.closers:
                if not stack:
                    closers.append(c)
                elif stack.pop() != PAIRS[c]:
                    return Node("".join(closers), at.state, "", f"mismatched {c}")
            if at.code < 0:
                return Node("".join(closers), at.state, "".join(stack) + at.openers, at.error)
            if not stack:
                return Node("".join(closers), at.state, "", None, at.code + shift, at.tick + shift)
            top = stack.pop()
            if top not in "{$":
                return Node("".join(closers), at.state, "", "mismatched }")
            at = b.nodes[at.code if top == "{" else at.tick]

    # What a does not tell apart it hands on, so b's own entries stay entries.
    listed = {s for s, _ in a.entries}
    nodes = [through(n) for n in a.nodes] + list(moved)
    entries = list(a.entries)
    for (mode, argument), n in b.entries:
        before = (mode, argument - a.nesting if mode == COMMENT else argument)
        if mode in (COMMENT, TEXT) and before not in listed and (mode != COMMENT or before[1] > 0):
            entries.append((before, n + shift))
    return _trim(Summary(tuple(entries), tuple(nodes), a.nesting + b.nesting))


def _trim(s: Summary) -> Summary:
    """The summary with only the nodes that an entry leads to."""
    number: dict[int, int] = {}
    order: list[int] = []
    todo = [n for _, n in reversed(s.entries)]
    while todo:
        n = todo.pop()
        if n not in number:
            number[n] = len(order)
            order.append(n)
            if s.nodes[n].code >= 0:
                todo += [s.nodes[n].tick, s.nodes[n].code]
    nodes = tuple(x if x.code < 0 else replace(x, code=number[x.code], tick=number[x.tick]) for x in (s.nodes[n] for n in order))
    return Summary(tuple((e, number[n]) for e, n in s.entries), nodes, s.nesting)


def finish(summary: Summary, state: State = START, stack: str = "") -> tuple[State, str, str, str | None]:
    """(exit state, unmatched closers, open brackets, error) of a part that begins so."""
    closers, opens, at = [], list(stack), summary.of(state)
    while True:
        for c in at.closers:
            if not opens:
                closers.append(c)
            elif opens.pop() != PAIRS[c]:
                return at.state, "".join(closers), "".join(opens), f"mismatched {c}"
        if at.code < 0:
            return at.state, "".join(closers), "".join(opens) + at.openers, at.error
        top = opens.pop() if opens else ""
        if not top:
            closers.append("}")
        elif top not in "{$":
            return at.state, "".join(closers), "".join(opens), "mismatched }"
        at = summary.nodes[at.tick if top == "$" else at.code]
