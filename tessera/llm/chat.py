"""Chat formatting by a small template compiler.

A template is text with {{ expression }}, {% for name in expression %} ... {% endfor %},
{% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %} and {% generation %} ... {% endgeneration %}.
Expressions are names, one attribute after a dot, string and integer literals, == and !=, + on strings,
and / or / not, parentheses, and filters after a bar: escape, upper, lower, trim. Nothing else parses, so a template
can reach no Python object but the values it is given. The parser yields a syntax tree; constants are folded
(concatenated literals, filters of literals, branches whose test is known, neighbouring text); the tree becomes nested
Python closures. Closures are generators of (piece, under the loss mask), so a conversation of any length is rendered
turn by turn, from an iterator of its rows.

Control strings that stand in a text are escaped by the filter escape: each of ESC and the control strings'
first character, "<" and "[", becomes ESC plus a letter, so that no control string can begin inside a text, and
unescape gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESC = "\x1b"
CODES = {ESC: "e", "<": "l", "[": "b"}
BACK = {code: char for char, code in CODES.items()}
#: Turn markers: the start of a turn, between role and text, its end.
START, MIDDLE, END = "<s>[INST] ", " [/INST] ", " </s>"
#: Around what a model is to learn to generate. They are counted as formatted characters.
OPEN, CLOSE = "<gen>", "</gen>"
DEFAULT_TEMPLATE = (
    "{% for turn in messages %}" + START + "{{ turn.role | escape }}" + MIDDLE
    + "{% if turn.role == 'assistant' %}" + OPEN + "{% generation %}{{ turn.text | escape }}{% endgeneration %}" + CLOSE
    + "{% else %}{{ turn.text | escape }}{% endif %}" + END + "{% endfor %}"
)

_ESCAPED = re.compile("[" + "".join(map(re.escape, CODES)) + "]")
_CODED = re.compile(f"{ESC}([{''.join(BACK)}])")


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESC + CODES[m[0]], text)


def unescape(text: str) -> str:
    return _CODED.sub(lambda m: BACK[m[1]], text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "upper": str.upper, "lower": str.lower, "trim": str.strip}


class TemplateError(ValueError):
    """A template that the language doesn't allow."""


# ---- parser: nodes are tuples, ("text", s), ("out", expr), ("for", name, expr, body), ("if", [(test, body)...]), ("gen", body)

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|[.|+()]))")


def _tokens(source: str) -> list[tuple[str, str]]:
    found, at, source = [], 0, source.strip()
    while at < len(source):
        if not (m := _TOKEN.match(source, at)):
            raise TemplateError(f"unexpected {source[at:]!r}")
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return found


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> bool:
        if self.peek()[1] in values and self.peek()[0] in ("op", "name"):
            self.at += 1
            return True
        return False

    def whole(self):
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        tree = self.joined()
        for sign in ("==", "!="):
            if self.take(sign):
                return (sign, tree, self.joined())
        return tree

    def joined(self):
        tree = self.filtered()
        while self.take("+"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.atom()
        while self.take("|"):
            name = self.peek()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def atom(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(value))
        if kind == "name":
            tree = ("name", value)
            if self.take("."):
                field = self.peek()
                if field[0] != "name":
                    raise TemplateError("a name must follow the dot")
                self.at += 1
                tree = ("field", tree, field[1])
            return tree
        if (kind, value) == ("op", "("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis is open")
            return tree
        raise TemplateError(f"unexpected {value or 'end'!r}")


def parse(template: str) -> list:
    """The syntax tree of a template."""
    parts, at = [], 0
    for m in _TAG.finditer(template):
        parts += [("text", template[at : m.start()]), ("out", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    parts.append(("text", template[at:]))
    pos = 0

    def body(ends: tuple[str, ...]) -> tuple[list, str]:
        nonlocal pos
        nodes: list = []
        while pos < len(parts):
            kind, value = parts[pos]
            pos += 1
            word, _, rest = value.partition(" ") if kind == "tag" else ("", "", "")
            if kind == "text":
                if value:
                    nodes.append(("text", value))
            elif kind == "out":
                nodes.append(("out", _Expression(value).whole()))
            elif word in ends:
                return nodes, value
            elif word == "for":
                if not (m := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)):
                    raise TemplateError(f"bad loop {value!r}")
                nodes.append(("for", m[1], _Expression(m[2]).whole(), body(("endfor",))[0]))
            elif word == "if":
                cases, test = [], _Expression(rest).whole()
                while True:
                    inner, end = body(("elif", "else", "endif") if test is not None else ("endif",))
                    cases.append((("const", True) if test is None else test, inner))
                    if end == "endif":
                        break
                    test = None if end == "else" else _Expression(end.partition(" ")[2]).whole()
                nodes.append(("if", cases))
            elif word == "generation":
                nodes.append(("gen", body(("endgeneration",))[0]))
            else:
                raise TemplateError(f"unexpected tag {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return nodes, ""

    return body(())[0]


# ---- constant folding


def _fold_expr(tree):
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "field":
        return ("field", _fold_expr(tree[1]), tree[2])
    if kind == "filter":
        inner = _fold_expr(tree[2])
        return ("const", FILTERS[tree[1]](str(inner[1]))) if inner[0] == "const" else ("filter", tree[1], inner)
    parts = [_fold_expr(x) for x in tree[1:]]
    if all(x[0] == "const" for x in parts):
        return ("const", _operate(kind, *(x[1] for x in parts)))
    if kind == "+" and parts[1][0] == "const" and parts[0][0] == "+" and parts[0][2][0] == "const":
        return ("+", parts[0][1], ("const", _operate("+", parts[0][2][1], parts[1][1])))
    return (kind, *parts)


def _operate(kind: str, a, b=None):
    if kind == "+":
        return str(a) + str(b)
    return {"==": a == b, "!=": a != b, "and": a and b, "or": a or b, "not": not a}[kind]


def fold(nodes: list) -> list:
    """The same tree with what is known beforehand worked out."""
    out: list = []
    for node in nodes:
        new: list = [node]
        if node[0] == "out":
            tree = _fold_expr(node[1])
            new = [("text", str(tree[1]))] if tree[0] == "const" else [("out", tree)]
        elif node[0] == "for":
            new = [("for", node[1], _fold_expr(node[2]), fold(node[3]))]
        elif node[0] == "gen":
            new = [("gen", fold(node[1]))]
        elif node[0] == "if":
            cases = []
            for test, inner in node[1]:
                test = _fold_expr(test)
                if test[0] != "const" or test[1]:
                    cases.append((test, fold(inner)))
                if test[0] == "const" and test[1]:
                    break
            new = cases[0][1] if cases and cases[0][0][0] == "const" else [("if", cases)] if cases else []
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


# ---- closures

Scope = dict
Render = Callable[[Scope, bool], Iterator[tuple[str, bool]]]


def _value(tree) -> Callable[[Scope], object]:
    kind = tree[0]
    if kind == "const":
        return lambda scope, v=tree[1]: v
    if kind == "name":
        return lambda scope, n=tree[1]: scope[n]
    if kind == "field":
        return lambda scope, inner=_value(tree[1]), n=tree[2]: inner(scope)[n]
    if kind == "filter":
        return lambda scope, inner=_value(tree[2]), f=FILTERS[tree[1]]: f(str(inner(scope)))
    if kind == "not":
        return lambda scope, a=_value(tree[1]): not a(scope)
    a, b = _value(tree[1]), _value(tree[2])
    return {
        "+": lambda scope: str(a(scope)) + str(b(scope)), "==": lambda scope: a(scope) == b(scope), "!=": lambda scope: a(scope) != b(scope),
        "and": lambda scope: a(scope) and b(scope), "or": lambda scope: a(scope) or b(scope),
    }[kind]


def _closure(node) -> Render:
    if node[0] == "text":
        return lambda scope, mask, s=node[1]: iter(((s, mask),))
    if node[0] == "out":
        return lambda scope, mask, f=_value(node[1]): iter(((str(f(scope)), mask),))
    if node[0] == "gen":
        return lambda scope, mask, f=_sequence(node[1]): f(scope, True)
    if node[0] == "if":
        cases = [(_value(test), _sequence(inner)) for test, inner in node[1]]

        def choose(scope: Scope, mask: bool) -> Iterator[tuple[str, bool]]:
            for test, inner in cases:
                if test(scope):
                    return inner(scope, mask)
            return iter(())

        return choose
    name, items, inner = node[1], _value(node[2]), _sequence(node[3])

    def loop(scope: Scope, mask: bool) -> Iterator[tuple[str, bool]]:
        for item in items(scope):
            yield from inner({**scope, name: item}, mask)

    return loop


def _sequence(nodes: list) -> Render:
    parts = [_closure(x) for x in nodes]

    def run(scope: Scope, mask: bool) -> Iterator[tuple[str, bool]]:
        for part in parts:
            yield from part(scope, mask)

    return run


def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """A function from a conversation's rows to its pieces and whether they are under the loss mask."""
    run = _sequence(fold(parse(template)))
    return lambda messages: run({"messages": messages}, False)


# ---- reading back


class Reader:
    """Reads the default template's output back, piece by piece, holding one turn at most."""

    def __init__(self) -> None:
        self.held, self.held_loss, self.n_turns, self.chars, self.loss_chars = "", "", 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.parts: list[str] = []

    def feed(self, piece: str, mask: bool) -> None:
        self.chars += len(piece)
        self.parts.append(piece)
        if mask:
            plain = unescape(piece)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        if END in piece:
            self.held = "".join(self.parts)
            while (stop := self.held.find(END)) >= 0:
                self._turn(self.held[:stop])
                self.held = self.held[stop + len(END) :]
            self.parts = [self.held]

    def _turn(self, turn: str) -> None:
        role, _, text = turn.removeprefix(START).partition(MIDDLE)
        if text.startswith(OPEN):
            text = text[len(OPEN) : -len(CLOSE)]
        self.n_turns += 1
        self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))


def _digests(template: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        rows = ((c, {"role": r, "text": t}) for pdf in batches for c, r, t in zip(pdf["conv_id"], pdf["role"], pdf["text"], strict=True))
        out: list[tuple] = []
        row = next(rows, None)
        while row is not None:
            conv = row[0]

            def turns() -> Iterator[dict]:
                nonlocal row
                while row is not None and row[0] == conv:  # noqa: B023
                    yield row[1]
                    row = next(rows, None)

            reader = Reader()
            for piece, mask in render(turns()):
                reader.feed(piece, mask)
            out.append((conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        yield pd.DataFrame(out, columns=COLUMNS)

    return run


def _texts(template: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        for pdf in batches:
            texts, spans = [], []
            for turns in pdf["turns"]:
                pieces, at, masked = [], 0, []
                for piece, mask in render(turns):
                    if mask:
                        masked.append([at, at + len(piece)])
                    pieces.append(piece)
                    at += len(piece)
                texts.append("".join(pieces))
                spans.append(masked)
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "formatted": texts, "loss_spans": spans})

    return run


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _turns(conversations: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))


def format_conversations(conversations: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """conv_id, formatted text and loss_spans (start, end in code points) of each conversation.

    A null role or text is empty; turns stand in the order of turn (null first), then role, then text; repeated rows are
    repeated turns; a null conv_id is a conversation of its own; other columns are ignored. A conversation is one
    row of the result, so it must fit a row; conversation_digests has no such bound.
    """
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    grouped = _turns(conversations).groupBy("conv_id").agg(turns.alias("turns"))
    return grouped.mapInPandas(_texts(template), "conv_id long, formatted string, loss_spans array<array<int>>")


def conversation_digests(conversations: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """Digests of each conversation, formatted and read back from the formatted text, with the order and nulls of format_conversations.

    Rows are dealt by conv_id and sorted in their partition; a task streams through them, holding one turn at a
    time, so a conversation of any length needs no more memory (its SHA-256 is sequential by nature).
    The template must mark turns as the default one does.
    """
    rows = _turns(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select(F.col("conv_id").cast("string"), "role", "text")
    found = rows.mapInPandas(_digests(template), "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return found.withColumn("conv_id", F.col("conv_id").cast("long"))
