"""Definitions of source languages by line patterns and bracket depth.

A file is walked level by level: at one depth of braces a line may begin a
container (class, implementation, namespace ...), whose members are looked for one
level deeper, or a definition that is taken whole. The names of members are
qualified by their containers. Comments, attributes and annotations right above a
definition belong to it.
"""

from __future__ import annotations

import re
import xml.parsers.expat
from dataclasses import dataclass

#: (start, end, symbol, node_type), one-based and inclusive.
Span = tuple[int, int, str | None, str | None]
MOST_DEPTH, XML_LINES = 8, 40

_MOD = (
    r"(?:(?:public|private|protected|internal|fileprivate|static|final|abstract|sealed|open|override|async|virtual|inline|data|value|partial|readonly|native|synchronized|default|strictfp|"
    r"extern|unsafe|new|suspend|operator|infix|tailrec|external|annotation|inner|companion|mutating|nonmutating|convenience|required|case|implicit|lazy|export|declare|constexpr|explicit|friend|indirect|actual|expect|class(?=\s+func))\s+)*"
)
_VIS = r"(?:pub(?:\([^)]*\))?\s+)?"


def _p(*rows: tuple[str, str]) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(pattern), node) for pattern, node in rows]


@dataclass(frozen=True)
class Policy:
    """What may begin at a level: containers anywhere, ``top`` outside and ``members`` inside of them."""

    containers: list[tuple[re.Pattern, str]]
    top: list[tuple[re.Pattern, str]]
    members: list[tuple[re.Pattern, str]]


_JS_TOP = (
    (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "function_declaration"),
    (r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)?|\w+)\s*(?::[^=]+)?=>", "lexical_declaration"),
    (r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?function\b", "lexical_declaration"),
)
_JS_CLASS = (r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+(\w+)", "class_declaration")
_JS_MEMBER = (
    (r"^\s*(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;]*$", "method_definition"),
    (r"^\s*(?:(?:static|public|private|protected|readonly)\s+)*(#?[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>", "method_definition"),
)
_TS_TOP = ((r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:const\s+)?(?:interface|type|enum)\s+(\w+)", "type_declaration"),)
_FUN = r"^\s*" + _MOD

NESTED: dict[str, Policy] = {
    "javascript": Policy(_p(_JS_CLASS), _p(*_JS_TOP), _p(*_JS_MEMBER)),
    "typescript": Policy(_p(_JS_CLASS, (r"^\s*(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+([\w.]+)\s*\{", "internal_module")), _p(*_JS_TOP, *_TS_TOP), _p(*_JS_MEMBER, *_JS_TOP, *_TS_TOP)),
    "rust": Policy(
        _p((r"^\s*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:[^{]*?\bfor\s+)?&?(?:'\w+\s+)?(?:dyn\s+)?(?:\w+::)*(\w+)", "impl_item"), (rf"^\s*{_VIS}(?:unsafe\s+)?trait\s+(\w+)", "trait_item"), (rf"^\s*{_VIS}mod\s+(\w+)\s*\{{", "mod_item")),
        rust := _p((rf"^\s*{_VIS}(?:(?:async|unsafe|const|default|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)", "function_item"), (rf"^\s*{_VIS}struct\s+(\w+)", "struct_item"), (rf"^\s*{_VIS}enum\s+(\w+)", "enum_item"), (rf"^\s*{_VIS}union\s+(\w+)", "union_item"), (r"^\s*macro_rules!\s*(\w+)", "macro_definition")),
        rust,
    ),
    "java": Policy(
        _p((_FUN + r"(?:class|interface|enum|record|@interface)\s+(\w+)", "class_declaration")), [],
        _p((_FUN + r"(?:<[^>]+>\s+)?(?:[\w.<>\[\],?@ ]+\s+)?(\w+)\s*\([^;=]*$", "method_declaration")),
    ),
    "csharp": Policy(
        _p((_FUN + r"(?:class|interface|struct|record(?:\s+struct|\s+class)?|enum)\s+(\w+)", "class_declaration"), (r"^\s*namespace\s+([\w.]+)\s*\{?\s*$", "namespace_declaration")), [],
        _p((_FUN + r"(?:[\w.<>\[\],?() ]+\s+)?(\w+)\s*(?:<[^>]+>)?\([^;=]*$", "method_declaration"), (_FUN + r"[\w.<>\[\],? ]+\s+(\w+)\s*(?:\{|=>)", "property_declaration")),
    ),
    "kotlin": Policy(
        _p((_FUN + r"(?:enum\s+|annotation\s+)?(?:class|interface|object)\s+(\w+)", "class_declaration")),
        kotlin := _p((_FUN + r"fun\s+(?:<[^>]+>\s*)?(?:[\w<>.?]+\.)?(\w+)", "function_declaration")), kotlin,
    ),
    "scala": Policy(_p((_FUN + r"(?:case\s+)?(?:class|object|trait|enum)\s+(\w+)", "class_definition")), scala := _p((_FUN + r"def\s+(\S+?)\s*(?:[\[(:={]|$)", "function_definition")), scala),
    "swift": Policy(_p((_FUN + r"(?:class|struct|enum|protocol|extension|actor)\s+([\w.]+)", "class_declaration")), swift := _p((_FUN + r"func\s+(\w+)", "function_declaration"), (_FUN + r"(init)[?!]?\s*[(<]", "init_declaration")), swift),
    "php": Policy(
        _p((_FUN + r"(?:class|interface|trait|enum)\s+(\w+)", "class_declaration"), (r"^\s*namespace\s+([\w\\]+)\s*\{", "namespace_definition")),
        php := _p((_FUN + r"function\s+&?(\w+)", "function_definition")), php,
    ),
    "cpp": Policy(
        _p((r"^\s*(?:inline\s+)?namespace\s+([\w:]+)\s*\{?\s*$", "namespace_definition"), (r"^\s*(?:class|struct)\s+(?:\w+\s+)?(\w+)\s*(?:final\s*)?(?::[^;]*)?\{?\s*$", "class_specifier")),
        cpp := _p((r"^\s*enum\s+(?:class\s+|struct\s+)?(\w+)", "enum_specifier"), (r"^\s*(?!(?:return|if|for|while|switch|else|case|using|typedef)\b)(?:[\w:<>,*&~\s]+?[\s*&])?((?:\w+::)*~?\w+|(?:\w+::)*operator\S+)\s*\([^;]*$", "function_definition")), cpp,
    ),
    "c": Policy(
        [], _p((r"^(?:typedef\s+)?(?:struct|enum|union)\s+(\w+)\s*\{?\s*$", "type_definition"), (r"^typedef\s+(?:struct|enum|union)\s*()\{?", "type_definition"), (r"^(?!(?:return|if|for|while|switch|else|typedef)\b)[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;]*$", "function_definition")), [],
    ),
}
NESTED["tsx"] = NESTED["typescript"]

_ABOVE = re.compile(r"^\s*(?://|/\*|\*|\*/|#\[|#!\[|@\w|\[\w[^\]]*\]\s*$|template\s*<|///)")
_STRIP = re.compile(r"//.*|/\*.*?\*/|\"(?:[^\"\\]|\\.)*\"|'(?:\\.[^']*|[^'\\])'|`[^`]*`")
_STRIP_JS = re.compile(r"//.*|/\*.*?\*/|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`")


def bare_lines(lines: list[str], lang: str) -> list[str]:
    """The lines without comments and strings, as far as brackets are concerned."""
    strip = _STRIP_JS if lang in ("javascript", "typescript", "tsx", "php", "kotlin") else _STRIP
    out, inside = [], None
    for line in lines:
        if inside:
            at = line.find(inside)
            if at < 0:
                out.append("")
                continue
            line, inside = line[at + len(inside) :], None
        x = strip.sub(" ", line)
        for opening, closing in (("/*", "*/"), ("`", "`")):
            at = x.find(opening)
            if at >= 0 and (opening == "/*" or lang in ("javascript", "typescript", "tsx", "go")):
                x, inside = x[:at], closing
                break
        if lang == "php":
            x = re.sub(r"(?<!\S)#(?!\[).*", "", x)
        out.append(x)
    return out


class _Walker:
    def __init__(self, lang: str, lines: list[str]) -> None:
        self.lang, self.lines, self.policy = lang, lines, NESTED[lang]
        self.bare = bare_lines(lines, lang)
        self.depth = [0]
        for x in self.bare:
            self.depth.append(max(0, self.depth[-1] + x.count("{") - x.count("}")))

    def end(self, start: int) -> int:
        """Where a definition ends: its braces balance again, or a semicolon comes before any."""
        level, opened = self.depth[start - 1], False
        for i in range(start, len(self.lines) + 1):
            opened = opened or "{" in self.bare[i - 1]
            if opened and self.depth[i] <= level:
                return i
            if not opened and self.bare[i - 1].rstrip().endswith(";"):
                return i
            if not opened and self.lang in ("kotlin", "scala", "swift") and i > start and not self.bare[i - 1].strip():
                return i - 1
        return len(self.lines)

    def above(self, start: int, floor: int) -> int:
        while start - 1 > floor and _ABOVE.match(self.lines[start - 2]):
            start -= 1
        return start

    def level(self, lo: int, hi: int, depth: int, prefix: str, inside: bool, nested: int) -> list[Span]:
        out: list[Span] = []
        i, floor = lo, lo - 1
        while i <= hi:
            found = self.match(i, inside) if self.depth[i - 1] == depth else None
            if found is None:
                i += 1
                continue
            name, node, container = found
            end = min(hi, self.end(i))
            start = self.above(i, floor)
            if not name:
                tail = re.search(r"\}\s*(\w+)\s*;", self.lines[end - 1])
                name = tail.group(1) if tail else None
            symbol = prefix + name if name else None
            members = self.level(i + 1, end - 1, depth + 1, f"{symbol}.", True, nested + 1) if container and nested < MOST_DEPTH else []
            if members:
                if members[0][0] > start:
                    out.append((start, members[0][0] - 1, symbol, node))
                out += members
            else:
                out.append((start, end, symbol, node))
            i, floor = end + 1, end
        return out

    def match(self, i: int, inside: bool) -> tuple[str, str, bool] | None:
        line = self.lines[i - 1]
        if not self.bare[i - 1].strip():
            return None
        for rows, container in ((self.policy.containers, True), (self.policy.members if inside else self.policy.top, False)):
            for pattern, node in rows:
                m = pattern.match(line)
                if m:
                    return m.group(1).replace("::", "."), node, container
        return None


def nested_spans(lang: str, lines: list[str]) -> list[Span]:
    return _Walker(lang, lines).level(1, len(lines), 0, "", False, 0)


_GO_FUNC = re.compile(r"^func\s+(?:\(\s*(?:\w+\s+)?\*?(\w+)[^)]*\)\s*)?(\w+)")
_GO_TYPE, _GO_SPEC = re.compile(r"^type\s+(\w+)"), re.compile(r"^\s+(\w+)\s*(?:\[[^\]]*\]\s*)?[\w\[\]*.=(<{]")


def go_spans(lines: list[str]) -> list[Span]:
    """Functions, methods by their receiver, types alone and in groups, each with its comment."""
    bare = bare_lines(lines, "go")
    depth = [0]
    for x in bare:
        depth.append(max(0, depth[-1] + x.count("{") - x.count("}")))
    out: list[Span] = []
    i, floor, group = 1, 0, False

    def above(start: int) -> int:
        while start - 1 > floor and lines[start - 2].lstrip().startswith(("//", "/*", "*")):
            start -= 1
        return start

    def end(start: int) -> int:
        level = depth[start - 1]
        for j in range(start, len(lines) + 1):
            if depth[j] <= level and ("{" in "".join(bare[start - 1 : j]) or j == start and "{" not in bare[j - 1]):
                return j
        return len(lines)

    while i <= len(lines):
        line = lines[i - 1]
        func, kind = _GO_FUNC.match(line), _GO_TYPE.match(line)
        spec = _GO_SPEC.match(line) if group and depth[i - 1] == 0 else None
        if re.match(r"^type\s*\(", line):
            group, floor = True, i
        elif group and line.startswith(")"):
            group = False
        elif func:
            symbol = ".".join(g for g in func.groups() if g)
            stop = end(i)
            out.append((above(i), stop, symbol, "method_declaration" if func.group(1) else "function_declaration"))
            i = floor = stop
        elif kind or spec:
            stop = end(i)
            out.append((above(i), stop, (kind or spec).group(1), "type_declaration"))
            i = floor = stop
        i += 1
    return out


_RUBY = [(re.compile(r"^(\s*)(?:class|module)\s+([\w:]+)"), "class", True), (re.compile(r"^(\s*)def\s+([\w.?!=]+)"), "method", False)]
_ELIXIR = [(re.compile(r"^(\s*)def(?:module|protocol|impl)\s+([\w.]+)"), "defmodule", True), (re.compile(r"^(\s*)def(?:p|macro|macrop|guard|guardp|delegate)?\s+([\w?!]+)"), "def", False)]


def ended_spans(lang: str, lines: list[str]) -> list[Span]:
    """Ruby and Elixir: a definition ends at the ``end`` of its indentation; names are qualified by modules."""
    rows = _RUBY if lang == "ruby" else _ELIXIR

    def stop(i: int, indent: str) -> int:
        if re.search(r",\s*do:|^\s*def\s+\S+(?:\([^)]*\))?\s*=\s", lines[i - 1]) or re.search(r"\bend\s*$", lines[i - 1]):
            return i
        for j in range(i + 1, len(lines) + 1):
            if re.match(rf"^{indent}end\b", lines[j - 1]):
                return j
            if lines[j - 1].strip() and not lines[j - 1].startswith(indent):
                return j - 1
        return len(lines)

    def level(lo: int, hi: int, prefix: str, nested: int) -> list[Span]:
        out: list[Span] = []
        i, floor = lo, lo - 1
        while i <= hi:
            found = next(((m, node, c) for p, node, c in rows if (m := p.match(lines[i - 1]))), None)
            if found is None:
                i += 1
                continue
            m, node, container = found
            end = min(hi, stop(i, m.group(1)))
            start = i
            while start - 1 > floor and lines[start - 2].lstrip().startswith(("#", "@doc", "@spec", "@impl")):
                start -= 1
            symbol = prefix + m.group(2).replace("::", ".")
            members = level(i + 1, end - 1, f"{symbol}.", nested + 1) if container and nested < MOST_DEPTH else []
            if members:
                if members[0][0] > start:
                    out.append((start, members[0][0] - 1, symbol, node))
                out += members
            else:
                out.append((start, end, symbol, node))
            i, floor = end + 1, end
        return out

    return level(1, len(lines), "", 0)


_OBJC_CLASS, _OBJC_METHOD = re.compile(r"^@(interface|implementation|protocol)\s+(\w+)"), re.compile(r"^[-+]\s*\([^)]*\)\s*(\w+)")


def objc_spans(lines: list[str]) -> list[Span]:
    """Classes up to ``@end``; the methods of an implementation by themselves."""
    out: list[Span] = []
    owner, head, i = "", 0, 1
    walker = bare_lines(lines, "objc")
    while i <= len(lines):
        m, method = _OBJC_CLASS.match(lines[i - 1]), _OBJC_METHOD.match(lines[i - 1])
        if m:
            owner, head = m.group(2), i
        elif method and owner and not walker[i - 1].rstrip().endswith(";"):
            if head:
                out.append((head, i - 1, owner, "class"))
                head = 0
            depth, j = 0, i
            while j <= len(lines):
                depth += walker[j - 1].count("{") - walker[j - 1].count("}")
                if depth <= 0 and "{" in "".join(walker[i - 1 : j]):
                    break
                j += 1
            out.append((i, min(j, len(lines)), f"{owner}.{method.group(1)}", "method_definition"))
            i = j
        elif lines[i - 1].startswith("@end"):
            if head:
                out.append((head, i, owner, "class"))
            owner, head = "", 0
        i += 1
    return out


_HCL = re.compile(r'^(\w+)((?:\s+"[^"]+")*)\s*\{')


def hcl_spans(lines: list[str]) -> list[Span]:
    """Blocks by the address that refers to them."""
    bare = bare_lines(lines, "hcl")
    out: list[Span] = []
    depth, i = 0, 1
    start: tuple[int, str, str] | None = None
    for i, (line, x) in enumerate(zip(lines, bare, strict=True), 1):
        m = _HCL.match(line) if depth == 0 else None
        if m:
            kind, labels = m.group(1), re.findall(r'"([^"]+)"', m.group(2))
            head = {"resource": [], "variable": ["var"], "locals": ["locals"]}.get(kind, [kind])
            start = (i, ".".join([*head, *labels]), kind)
        depth = max(0, depth + x.count("{") - x.count("}"))
        if start and depth == 0:
            out.append((start[0], i, start[1], "block"))
            start = None
    return out


_PAIR = re.compile(r'^\s*"((?:[^"\\]|\\.)*)"\s*:')


def json_spans(lines: list[str]) -> list[Span]:
    """Pairs of the outermost object, each to the line before the next."""
    starts, depth = [], 0
    for i, line in enumerate(lines, 1):
        m = _PAIR.match(line) if depth == 1 else None
        if m:
            starts.append((i, m.group(1)))
        x = re.sub(r'"(?:[^"\\]|\\.)*"', "", line)
        depth += x.count("{") + x.count("[") - x.count("}") - x.count("]")
    last = len(lines)
    while last and not lines[last - 1].strip(" \t}],"):
        last -= 1
    return [(i, max(i, starts[n + 1][0] - 1 if n + 1 < len(starts) else last), name, "pair") for n, (i, name) in enumerate(starts)]


def xml_spans(text: str, lines: list[str], most: int = XML_LINES) -> list[Span]:
    """Elements, small siblings together in runs of up to ``most`` lines, by the path of elements they lie in."""
    root: list = ["", 1, 1, []]
    stack = [root]
    parser = xml.parsers.expat.ParserCreate()

    def opened(name: str, _: dict) -> None:
        node = [name, parser.CurrentLineNumber, 0, []]
        stack[-1][3].append(node)
        stack.append(node)

    def closed(_: str) -> None:
        stack.pop()[2] = parser.CurrentLineNumber

    parser.StartElementHandler, parser.EndElementHandler = opened, closed
    try:
        parser.Parse(text.encode("utf-8", "replace"), True)
    except xml.parsers.expat.ExpatError:
        return []
    out: list[Span] = []
    todo = [(root, "")]
    while todo:
        node, path = todo.pop()
        run: list = []

        def flush(run: list, path: str) -> None:
            if run:
                names = {x[0] for x in run}
                out.append((run[0][1], run[-1][2], f"{path}/{run[0][0]}".lstrip("/") if len(names) == 1 else path or None, "element"))

        for child in node[3]:
            if child[2] - child[1] + 1 > most and child[3] and any(g[1] > child[1] for g in child[3]):
                flush(run, path)
                run = []
                first = min(g[1] for g in child[3])
                if first > child[1]:
                    out.append((child[1], first - 1, f"{path}/{child[0]}".lstrip("/"), "element"))
                todo.append((child, f"{path}/{child[0]}".lstrip("/")))
            else:
                if run and (child[2] - run[0][1] + 1 > most or child[1] <= run[-1][2] and child[2] - run[0][1] + 1 > most):
                    flush(run, path)
                    run = []
                run.append(child)
        flush(run, path)
    return sorted(out, key=lambda s: (s[0], s[1]))
