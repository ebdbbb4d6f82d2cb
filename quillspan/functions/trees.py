"""Per-file helpers of the chunker: JSON nodes with positions, scopes, span selection and the span fold.

Plain Python over one file's nodes; Spark deals the files out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

from quillspan.functions.text import CLOSING

#: Node types by role and language.
_FUNCTIONS = ["function_declaration", "function_expression", "generator_function_declaration", "generator_function", "arrow_function"]
_TYPED = ["function_signature", "method_signature", "abstract_method_signature", "abstract_class_declaration", "public_field_definition", "interface_declaration", "type_alias_declaration", "enum_declaration", "using_declaration", "module", "internal_module", "ambient_declaration", "import_alias"]
_CLASSES = ["method_definition", "class_declaration", "class", "field_definition", "class_static_block"]
_OTHER = ["lexical_declaration", "variable_declaration", "export_statement", "import_statement"]
_SCOPES = ["function_declaration", "generator_function_declaration", "method_definition", "class_declaration", "class", "lexical_declaration", "variable_declaration"]
_TYPED_SCOPES = ["abstract_class_declaration", "interface_declaration", "enum_declaration", "module", "internal_module"]
_JSX_SCOPES = ["jsx_element", "jsx_self_closing_element"]
WANTED = {"javascript": _FUNCTIONS + _CLASSES + _OTHER, "typescript": _FUNCTIONS + _CLASSES + _OTHER + _TYPED, "tsx": _FUNCTIONS + _CLASSES + _OTHER + _TYPED, "json": ["pair"], "text": ["line"]}
SCOPE = {"javascript": _SCOPES, "typescript": _SCOPES + _TYPED_SCOPES, "tsx": _SCOPES + _TYPED_SCOPES + _JSX_SCOPES, "json": ["pair"], "text": []}
IMPORT = {"javascript": ["import_statement", "export_statement"], "typescript": ["import_statement", "export_statement", "import_alias"], "tsx": ["import_statement", "export_statement", "import_alias"], "json": [], "text": []}
IDENTIFIERS = ("identifier", "property_identifier", "type_identifier")

_JSON = re.compile(r'[ \t\r\n]+|(?P<string>"(?:[^"\\\x00-\x1f]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>true|false|null)|(?P<mark>[{}\[\],:])')


def rules() -> list[tuple[str, str, bool, bool, bool]]:
    """(language, type, wanted, scope, import) of every node type with a role."""
    return [(lang, t, t in WANTED[lang], t in SCOPE[lang], t in IMPORT[lang]) for lang in WANTED for t in sorted({*WANTED[lang], *SCOPE[lang], *IMPORT[lang]})]


def utf16_counter(content: str) -> Callable[[int, int], int]:
    """Token counts of a text's intervals, ceil(UTF-16 units / 4), each in constant time after one pass over the text."""
    if len(content.encode("utf-16-le", "surrogatepass")) == 2 * len(content):
        return lambda a, b: -(-max(0, b - a) // 4)
    units = [0, *accumulate(2 if c > "\uffff" else 1 for c in content)]
    return lambda a, b: -(-max(0, units[b] - units[a]) // 4)


def counted_slices(files: list[tuple[str, str, list[list]]], counter: Callable[[list[str]], list[int]], most: int = 1000) -> dict[str, int]:
    """Token counts, by a counter of lists of texts, of what the nodes of files(content, language, nodes) may be asked for: the distinct texts of wanted nodes and leaves, each once, in lists of up to `most`."""
    texts = sorted({content[n[4] : n[5]] for content, language, nodes in files for n in nodes if not n[8] or n[3] in WANTED.get(language, [])})
    out: dict[str, int] = {}
    for i in range(0, len(texts), most):
        some = texts[i : i + most]
        counts = counter(some)
        if len(counts) != len(some):
            raise ValueError(f"the counter gave {len(counts)} counts for {len(some)} texts")
        out.update(zip(some, map(int, counts), strict=True))
    return out


class Tree:
    """Nodes as [id, parent, field, type, start, end, start_row, end_row, child_count], parents before children."""

    def __init__(self):
        self.nodes: list[list] = []

    def add(self, parent: int | None, field: str | None, kind: str, start: int, end: int, rows: Callable[[int], int]) -> int:
        self.nodes.append([len(self.nodes), parent, field, kind, start, end, rows(start), rows(end), 0])
        if parent is not None:
            self.nodes[parent][8] += 1
        return len(self.nodes) - 1

    def close(self, node: int, end: int, rows: Callable[[int], int]) -> None:
        self.nodes[node][5], self.nodes[node][7] = end, rows(end)


def row_of(content: str) -> Callable[[int], int]:
    from bisect import bisect_left

    breaks = [m.start() for m in re.finditer("\n", content)]
    return lambda at: bisect_left(breaks, at)


def json_nodes(content: str) -> list[list]:
    """Nodes of a JSON text: document, object, array, pair (key, value), string with its quotes and content, and leaves. No nodes if it is no JSON."""
    rows, tree, at = row_of(content), Tree(), 0
    stack = [tree.add(None, None, "document", 0, len(content), rows)]
    wants = "value"  # value, key, colon, after, first (value or end), key1 (key or end)

    def string(parent: int, field: str | None, a: int, b: int) -> None:
        node = tree.add(parent, field, "string", a, b, rows)
        tree.add(node, None, '"', a, a + 1, rows)
        if b - a > 2:
            tree.add(node, None, "string_content", a + 1, b - 1, rows)
        tree.add(node, None, '"', b - 1, b, rows)

    def ended() -> str:
        """After a value: a pair ends with its value."""
        if tree.nodes[stack[-1]][3] == "pair":
            tree.close(stack.pop(), tree.nodes[-1][5] if not closed else closed[0], rows)
        return "after"

    closed: list[int] = []
    while at < len(content):
        m = _JSON.match(content, at)
        if not m:
            return []
        a, at, closed = at, m.end(), [m.end()]
        kind, text = m.lastgroup, m[0]
        if kind is None:
            continue
        top, field = tree.nodes[stack[-1]][3], "value" if tree.nodes[stack[-1]][3] == "pair" else None
        if wants in ("value", "first") and (kind != "mark" or text in "{["):
            if kind == "string":
                string(stack[-1], field, a, at)
                wants = ended()
            elif kind == "mark":
                stack.append(tree.add(stack[-1], field, "object" if text == "{" else "array", a, at, rows))
                tree.add(stack[-1], None, text, a, at, rows)
                wants = "key1" if text == "{" else "first"
            else:
                tree.add(stack[-1], field, "number" if kind == "number" else text, a, at, rows)
                wants = ended()
        elif wants in ("key", "key1") and kind == "string":
            stack.append(tree.add(stack[-1], None, "pair", a, at, rows))
            string(stack[-1], "key", a, at)
            wants = "colon"
        elif wants == "colon" and text == ":":
            tree.add(stack[-1], None, ":", a, at, rows)
            wants = "value"
        elif wants == "after" and text == "," and top in ("object", "array"):
            tree.add(stack[-1], None, ",", a, at, rows)
            wants = "key" if top == "object" else "value"
        elif text == "}" and top == "object" and wants in ("after", "key1") or text == "]" and top == "array" and wants in ("after", "first"):
            tree.add(stack[-1], None, text, a, at, rows)
            tree.close(stack.pop(), at, rows)
            wants = ended()
        else:
            return []
    return tree.nodes if len(stack) == 1 and wants == "after" else []


def line_nodes(content: str) -> list[list]:
    """A root with a leaf per line: `line`, or `blank` where it has nothing but white space."""
    tree, at = Tree(), 0
    tree.add(None, None, "document", 0, len(content), lambda p: 0)
    for row, line in enumerate(content.split("\n")):
        tree.add(0, None, "line" if re.search(r"[^\s]", line, re.A) else "blank", at, at + len(line), lambda p, row=row: row)
        at += len(line) + 1
    tree.nodes[0][7] = content.count("\n")
    return tree.nodes


def unquoted(text: str) -> str:
    return re.sub(r'^"(.*)"$', r"\1", text, flags=re.S)


def scope_name(node: list, children: dict[int, list[list]], content: str) -> str:
    """The name of a scope node."""
    own = children.get(node[0], [])
    text = lambda n: content[n[4] : n[5]]
    field = lambda nodes, name: next((n for n in nodes if n[2] == name), None)
    kind = node[3]
    if kind == "pair":
        key = field(own, "key")
        return "<pair>" if key is None else unquoted(text(key))
    if kind == "jsx_element":
        tag = field(own, "open_tag")
        name = field(children.get(tag[0], []), "name") if tag else None
        return text(name) if name else "<jsx>"
    if name := field(own, "name"):
        return text(name)
    if kind == "jsx_self_closing_element":
        return "<jsx>"
    if kind in ("lexical_declaration", "variable_declaration"):
        first = next((n for n in own if n[3] == "variable_declarator"), None)
        if first and (name := field(children.get(first[0], []), "name")):
            return text(name)
    first = next((n for n in own if n[3] in IDENTIFIERS), None)
    return text(first) if first else "<anonymous>"


def ordered(nodes: list[list]) -> tuple[list[list], dict[int, list[list]]]:
    """Parents before children, siblings by position; and the children of each node."""
    children: dict[int | None, list[list]] = {}
    for n in sorted(nodes, key=lambda n: (n[4], n[5], n[0])):
        children.setdefault(n[1], []).append(n)
    out, stack = [], list(reversed(children.get(None, [])))
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(reversed(children.get(n[0], [])))
    return out, children


def scopes_of(nodes: list[list], language: str, content: str) -> dict[int, list[str]]:
    """Names of the scopes around each node, from the outermost in, its own included."""
    rows, children = ordered(nodes)
    scope, imports = set(SCOPE.get(language, [])), set(IMPORT.get(language, []))
    out: dict[int, list[str]] = {}
    for n in rows:
        above = out.get(n[1], [])
        out[n[0]] = [*above, scope_name(n, children, content)] if n[3] in scope and n[3] not in imports else above
    return out


def spans_of(nodes: list[list], language: str, content: str, most: int, count: Callable[[int, int], int] | None = None) -> list[tuple]:
    """(start, end, start_row, end_row, tokens, scope, kind): wanted nodes small enough or without children, and the other leaves as gaps."""
    wanted, imports = set(WANTED.get(language, [])), set(IMPORT.get(language, []))
    rows, _ = ordered(nodes)
    count = count or utf16_counter(content)
    scopes, out, done = scopes_of(nodes, language, content), [], set()
    for n in rows:
        if n[1] in done:
            done.add(n[0])
            continue
        if n[3] not in wanted and n[8]:
            continue
        tokens = count(n[4], n[5])
        kind = "wanted" if n[3] in wanted and (tokens <= most or not n[8]) else "gap" if not n[8] else None
        if kind:
            done.add(n[0])
            out.append((n[4], n[5], n[6], n[7], tokens, [scopes[n[0]]] if kind == "wanted" and n[3] not in imports else [], kind))
    return out


def _join(a: tuple, b: tuple) -> tuple:
    scope = list(a[5])
    scope += [s for s in b[5] if s not in scope]
    return (min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), a[4] + b[4], scope, "wanted")


def fold(spans: list[tuple], language: str, content: str, target: int) -> list[tuple]:
    """Spans merged from left to right up to the target.

    A gap that only closes joins what is before it, with the gaps held back so
    far; other gaps go before the next wanted span, or after the last one.
    """
    closing = re.compile("|".join(CLOSING[language])) if language in CLOSING else None
    out: list[tuple] = []
    now = held = None
    for s in sorted(spans, key=lambda s: (s[0], s[1])):
        if s[6] == "gap":
            held = _join(held, s) if held else s
            if now and closing and closing.search(content[s[0] : s[1]]):
                now, held = _join(now, held), None
            continue
        if held:
            s, held = _join(held, s), None
        if now and now[4] + s[4] <= target:
            now = _join(now, s)
        else:
            out += [now] if now else []
            now = s
    if now:
        out.append(_join(now, held) if held else now)
    return out


def header(file_path: str, scope: list[list[str]]) -> str:
    items = [x for x in (" -> ".join(s) for s in scope) if x]
    return f"# filePath: {file_path}\n" + ("# scope:\n" + "".join(f"#   - {x}\n" for x in items) if items else "") + "---\n"


def chunks_of(file_path: str, content: str, language: str, nodes: list[list], target: int, most: int, count: Callable[[int, int], int] | None = None) -> Iterator[tuple]:
    """(id, file_path, start_line, end_line, content) of a file's chunks."""
    merged = fold(spans_of(nodes, language, content, most, count), language, content, target)
    for k, s in enumerate(merged):
        yield (f"{file_path}__{k}", file_path, s[2], s[3], header(file_path, s[5]) + content[s[0] : s[1]])
