"""Recursive-descent parser of the analytic statements; anything else raises Unsupported."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class Unsupported(ValueError):
    """The text is not a statement that this engine runs."""


TOKEN = re.compile(
    r"\s*(?:(?P<comment>--[^\n]*|//[^\n]*)|(?P<string>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<number>\d+\.\d+|\d+)"
    r"|(?P<variable>\$[A-Za-z_]\w*)|(?P<word>[A-Za-z_]\w*)|(?P<op><>|!=|<=|>=|->|<-|\.\.|[=<>(){}\[\],;:.*+|?-]))"
)
SECONDS = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86400}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "DISTINCT", "UNIQUE", "CONCAT", "JOIN", "DEGREE"}


@dataclass(frozen=True)
class Name:
    """column or owner.column"""

    column: str
    owner: str | None = None


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Call:
    """An aggregate, or a path function when it has no argument."""

    function: str
    argument: object = None
    modifier: str | None = None


@dataclass(frozen=True)
class Item:
    what: object
    alias: str | None = None


@dataclass(frozen=True)
class Test:
    """operator over operands; AND, OR and NOT have tests as operands."""

    operator: str
    operands: tuple


@dataclass
class NodePattern:
    label: str
    alias: str
    properties: dict = field(default_factory=dict)


@dataclass
class EdgePattern:
    types: list[str]
    direction: str  # out, in, both
    least: int = 1
    most: int = 1
    alias: str | None = None


@dataclass
class Statement:
    kind: str
    args: dict


def lex(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise Unsupported(f"unreadable at {text[at : at + 20]!r}")
        at, kind = m.end(), m.lastgroup
        if kind == "string":
            out.append((kind, re.sub(r"\\(.)", r"\1", m[kind][1:-1])))
        elif kind == "number":
            out.append((kind, float(m[kind]) if "." in m[kind] else int(m[kind])))
        elif kind != "comment":
            out.append((kind, m[kind]))
    return out


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = lex(text), 0

    # -- small steps ---------------------------------------------------------------------------------

    def peek(self, ahead: int = 0) -> str:
        """The next token as upper-case text; strings never look like keywords."""
        if self.at + ahead >= len(self.tokens):
            return ""
        kind, value = self.tokens[self.at + ahead]
        return "<string>" if kind == "string" else str(value).upper()

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def accept(self, *words: str) -> bool:
        if all(self.peek(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise Unsupported(f"expected {' '.join(words)}, found {self.peek() or 'the end'}")

    def word(self) -> str:
        if self.kind() != "word":
            raise Unsupported(f"expected a name, found {self.peek() or 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def listed(self, one, end: str | None = None) -> list:
        out = []
        if end and self.accept(end):
            return out
        while True:
            out.append(one())
            if not self.accept(","):
                break
        if end:
            self.expect(end)
        return out

    def value(self):
        kind = self.kind()
        if kind in ("string", "number"):
            self.at += 1
            return self.tokens[self.at - 1][1]
        if kind == "variable":
            self.at += 1
            return Variable(self.tokens[self.at - 1][1][1:])
        if self.accept("-"):
            return -self.value()
        for text, constant in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.accept(text):
                return constant
        if self.accept("["):
            return self.listed(self.value, "]")
        return self.word()

    def number(self):
        v = self.value()
        if not isinstance(v, int | float | Variable) or isinstance(v, bool):
            raise Unsupported(f"expected a number, found {v!r}")
        return v

    def properties(self) -> dict:
        """{a: 1, b: "x"} or a = 1, ..."""
        self.expect("{")
        out = {}
        while not self.accept("}"):
            key = self.word()
            if not self.accept(":"):
                self.expect("=")
            out[key] = self.value()
            self.accept(",")
        return out

    def name(self) -> Name:
        if self.peek() in ("FROM", "WHERE", "GROUP", "ORDER", "LIMIT", "OFFSET") and self.peek(1) != ".":  # Order may be a label
            raise Unsupported(f"expected a column, found {self.peek()}")
        first = self.word()
        return Name(self.word(), first) if self.accept(".") else Name(first)

    # -- conditions -----------------------------------------------------------------------------------

    def condition(self) -> Test:
        out = [self.conjunction()]
        while self.accept("OR"):
            out.append(self.conjunction())
        return out[0] if len(out) == 1 else Test("OR", tuple(out))

    def conjunction(self) -> Test:
        out = [self.test()]
        while self.accept("AND"):
            out.append(self.test())
        return out[0] if len(out) == 1 else Test("AND", tuple(out))

    def test(self) -> Test:
        if self.accept("NOT"):
            return Test("NOT", (self.test(),))
        if self.accept("("):
            inside = self.condition()
            self.expect(")")
            return inside
        left = self.call() if self.peek() in AGGREGATES and self.peek(1) == "(" else self.name()
        for op in ("=", "!=", "<>", "<=", ">=", "<", ">", "CONTAINS"):
            if self.accept(op):
                return Test("!=" if op == "<>" else op, (left, self.value()))
        for first, second in (("STARTS", "WITH"), ("ENDS", "WITH"), ("SIMILAR", "TO")):
            if self.accept(first):
                self.accept(second)
                return Test(first, (left, self.value()))
        if self.accept("BETWEEN"):
            low = self.value()
            self.expect("AND")
            return Test("BETWEEN", (left, low, self.value()))
        if self.accept("IS"):
            negated = self.accept("NOT")
            self.expect("NULL")
            return Test("NOT" if negated else "IS NULL", (Test("IS NULL", (left,)),) if negated else (left,))
        negated = self.accept("NOT")
        self.expect("IN")
        self.expect("(") if self.peek() == "(" else self.expect("[")
        close = ")" if self.tokens[self.at - 1][1] == "(" else "]"
        return Test("NOT IN" if negated else "IN", (left, tuple(self.listed(self.value, close))))

    def where(self):
        return self.condition() if self.accept("WHERE") else None

    # -- items -----------------------------------------------------------------------------------------

    def call(self) -> Call:
        function = self.word().upper()
        self.expect("(")
        if self.accept("*"):
            argument, modifier = None, None
        elif self.accept(")"):
            return Call(function)
        else:
            modifier = next((m for m in ("DISTINCT", "NODE", "EDGE") if self.peek() == m and self.peek(1) != ")"), None)
            if modifier:
                self.at += 1
            argument = self.name()
        self.expect(")")
        return Call(function, argument, modifier)

    def item(self) -> Item:
        if self.accept("*"):
            return Item("*")
        if self.peek() in AGGREGATES and self.peek(1) == "(":
            what = self.call()
        elif self.peek() in ("PATH_LENGTH", "TOTAL_WEIGHT", "PATH_COST", "HOP_COUNT"):
            what = Call(self.word().upper())
        elif self.accept("DISTINCT"):
            what = Call("ROWS_DISTINCT", self.name())
        else:
            what = self.name()
        return Item(what, self.word() if self.accept("AS") else None)

    def order(self) -> list[tuple]:
        def one():
            what = self.call() if self.peek() in AGGREGATES and self.peek(1) == "(" else self.name()
            down = self.accept("DESC")
            if not down:
                self.accept("ASC")
            return what, down

        return self.listed(one) if self.accept("ORDER", "BY") else []

    def tail(self) -> dict:
        """ORDER BY, LIMIT, OFFSET in any order."""
        out = {"order": [], "limit": None, "offset": None}
        while True:
            if self.peek() == "ORDER":
                out["order"] = self.order()
            elif self.accept("LIMIT"):
                out["limit"] = self.number()
            elif self.accept("OFFSET"):
                out["offset"] = self.number()
            else:
                return out

    def returned(self):
        return self.listed(self.item) if self.accept("RETURN") else None

    def as_of(self):
        if self.accept("AT"):
            for what in ("TIMESTAMP", "COMMIT", "RUN"):
                if self.accept(what):
                    return (what, self.value())
            raise Unsupported("AT needs TIMESTAMP, COMMIT or RUN")
        if self.accept("FOR", "SYSTEM_TIME"):
            if self.accept("ALL"):
                return ("ALL",)
            if self.accept("FROM"):
                a = self.value()
                self.expect("TO")
                return ("FROM", a, self.value())
            if self.accept("BETWEEN"):
                a = self.value()
                self.expect("AND")
                return ("BETWEEN", a, self.value())
            self.expect("CONTAINED", "IN", "(")
            return ("CONTAINED", *self.listed(self.value, ")"))
        return None

    # -- statements ------------------------------------------------------------------------------------

    def script(self) -> list[Statement]:
        out = []
        while self.at < len(self.tokens):
            if self.accept(";"):
                continue
            out.append(self.statement())
            if self.at < len(self.tokens):
                self.expect(";")
        return out

    def statement(self) -> Statement:
        word = self.peek()
        method = getattr(self, f"_{word.lower()}", None) if re.fullmatch(r"[A-Z_]+", word) else None
        if method is None:
            raise Unsupported(f"unsupported statement: {word or 'nothing'}")
        self.at += 1
        return method()

    def _explain(self):
        return Statement("explain", {"of": self.statement()})

    def _select(self):
        if self.peek() in ("NODE", "EDGE") and self.peek(1) not in (",", "FROM", "AS"):
            edges = self.word().upper() == "EDGE"
            label = None if edges or self.peek() in ("WHERE", "LIMIT", "OFFSET", "") else self.word()
            return Statement("select", {"items": [Item("*")], "from": label, "edges": edges, "as_of": None, "where": self.where(), "group": [], "having": None, **self.tail()})
        items = self.listed(self.item)
        label = self.word() if self.accept("FROM") else None
        as_of = self.as_of()
        if self.accept("USE", "INDEX"):
            self.word()
        where = self.where()
        group = self.listed(self.name) if self.accept("GROUP", "BY") else []
        having = self.condition() if self.accept("HAVING") else None
        return Statement("select", {"items": items, "from": label, "edges": False, "as_of": as_of, "where": where, "group": group, "having": having, **self.tail()})

    def _match(self):
        if self.accept("NODE"):
            label = self.word()
            alias = self.word() if self.accept("AS") else label
            return Statement("match", {"nodes": [NodePattern(label, alias)], "edges": [], "where": self.where(), "items": self.returned(), **self.tail()})
        nodes, edges = self.path()
        return Statement("match", {"nodes": nodes, "edges": edges, "where": self.where(), "items": self.returned(), **self.tail()})

    def path(self):
        nodes, edges = [self.node()], []
        while self.peek() in ("-", "<-"):
            edges.append(self.edge())
            nodes.append(self.node())
        return nodes, edges

    def node(self) -> NodePattern:
        self.expect("(")
        first = self.word()
        label, alias = (self.word(), first) if self.accept(":") else (first, first)
        alias = self.word() if self.accept("AS") else alias
        properties = self.properties() if self.peek() == "{" else {}
        self.expect(")")
        return NodePattern(label, alias, properties)

    def edge(self) -> EdgePattern:
        into = self.accept("<-")
        if not into:
            self.expect("-")
        self.expect("[")
        self.accept(":")
        alias, types = None, [self.word()]
        if self.accept(":"):
            alias, types = types[0], [self.word()]
        while self.accept("|"):
            types.append(self.word())
        least = most = 1
        if self.accept("*"):
            least, most = 1, 5
            if self.kind() == "number":
                least = most = self.number()
                if self.accept(".."):
                    most = self.number()
        elif self.accept("+"):
            least, most = 1, 5
        elif self.accept("{"):
            least = 0 if self.peek() == "," else self.number()
            most = least
            if self.accept(","):
                most = self.number() if self.kind() == "number" else 5
            self.expect("}")
        self.expect("]")
        if into:
            self.expect("-")
            return EdgePattern(types, "in", least, most, alias)
        if self.accept("->"):
            return EdgePattern(types, "out", least, most, alias)
        self.expect("-")
        return EdgePattern(types, "both", least, most, alias)

    def _types(self) -> list[str]:
        if self.accept("("):
            return self.listed(self.word, ")")
        if self.accept("["):
            return [str(v) for v in self.listed(self.value, "]")]
        return [self.word()]

    def _traverse(self):
        self.expect("FROM")
        args = {"from": self.word(), "where": None, "types": None, "to": None, "depth": 1, "least": 1, "direction": "out", "items": None, "strategy": None}
        while True:
            if self.peek() == "WHERE":
                args["where"] = self.where()
            elif self.accept("VIA"):
                args["types"] = self._types()
            elif self.accept("TO"):
                args["to"] = self.word()
            elif self.accept("MAX", "DEPTH") or self.accept("MAX_DEPTH") or self.accept("DEPTH"):
                args["depth"] = self.number()
            elif self.accept("MIN", "DEPTH"):
                args["least"] = self.number()
            elif self.accept("STRATEGY"):
                args["strategy"] = self.word().upper()
                if args["strategy"] not in ("DFS", "BFS"):
                    raise Unsupported(f"no strategy {args['strategy']}")
            elif self.peek() in ("OUTGOING", "INCOMING", "BOTH"):
                args["direction"] = {"OUTGOING": "out", "INCOMING": "in", "BOTH": "both"}[self.word().upper()]
            elif self.peek() == "RETURN":
                args["items"] = self.returned()
            else:
                return Statement("traverse", {**args, **self.tail()})

    def _neighbors(self):
        out = self._traverse()
        return Statement("traverse", {**out.args, "direction": "both"})

    def _hop(self):
        self.expect("FROM")
        start = self.word()
        self.expect("TO")
        end = self.word()
        depth = self.number() if self.accept("DEPTH") else 1
        return Statement("traverse", {"from": start, "to": end, "where": None, "types": None, "depth": depth, "least": 1, "direction": "out", "items": None, "strategy": None, **self.tail()})

    def _shortest_path(self):
        self.expect("FROM")
        a = self.value()
        self.expect("TO")
        b = self.value()
        types = self._types() if self.accept("VIA", "EDGES") or self.accept("VIA") else None
        depth = self.number() if self.accept("MAX_DEPTH") or self.accept("MAX", "DEPTH") else 6
        return Statement("shortest_path", {"from": a, "to": b, "types": types, "depth": depth})

    def _pagerank(self):
        args = {"on": self.word() if self.accept("ON") else None, "iterations": 20, "damping": 0.85}
        while True:
            if self.accept("ITERATIONS"):
                args["iterations"] = self.number()
            elif self.accept("DAMPING_FACTOR") or self.accept("DAMPING"):
                args["damping"] = self.number()
            elif self.accept("RETURN"):
                self.listed(self.item)
            else:
                return Statement("pagerank", {**args, **self.tail()})

    def _community_detection(self):
        on = self.word() if self.accept("ON") else None
        if self.accept("USING", "ALGORITHM"):
            self.value()
        return Statement("communities", {"on": on, **self.tail()})

    def _components(self):
        return Statement("components", {"on": self.word() if self.accept("ON") else None, **self.tail()})

    def _degree(self):
        self.accept("CENTRALITY")
        return Statement("degree", {"on": self.word() if self.accept("ON") else None, **self.tail()})

    def _graph(self):
        self.expect("SUMMARY")
        label = self.word() if self.accept("ON") else None
        fields = {}
        if self.accept("RETURN"):
            self.expect("{")
            while not self.accept("}"):
                key = self.word()
                self.expect(":")
                fields[key] = self.call()
                self.accept(",")
        return Statement("summary", {"from": label, "fields": fields})

    def _aggregate(self):
        function = self.peek()
        if function in AGGREGATES and self.peek(1) == "(":
            call = self.call()
            label = self.word() if self.accept("FROM") else None
            where = self.where()
            group = self.name() if self.accept("GROUP", "BY") else None
            return Statement("aggregate", {"call": call, "from": label, "where": where, "group": group})
        label = self.word()
        self.expect("BY")
        group = self.name()
        return Statement("aggregate", {"call": Call("COUNT"), "from": label, "where": self.where(), "group": group})

    def _count(self):
        label = self.word()
        return Statement("aggregate", {"call": Call("COUNT"), "from": label, "where": self.where(), "group": None})

    def _find(self):
        if self.accept("BY", "UUID"):
            return Statement("point", {"id": self.value()})
        if self.accept("EDGES"):
            return Statement("edges", {"where": self.where(), **self.tail()})
        self.expect("NODES")
        return Statement("induced" if self.peek() == "WHERE" else "nodes", {"where": self.where(), **self.tail()})

    def _show(self):
        if self.accept("EDGES"):
            return Statement("edges", {"where": None, **self.tail()})
        self.accept("CURRENT")
        return Statement("show", {"what": self.word().upper()})

    def _describe(self):
        what = "EDGE" if self.accept("EDGE") else "NODE"
        self.accept("NODE")
        self.accept("TYPE")
        return Statement("describe", {"what": what, "of": self.word()})

    def _search(self):
        label = None
        if self.accept("NODE"):
            label = self.word()
        text = self.value()
        if self.accept("IN"):
            label = self.word()
        strategy = str(self.value()).lower() if self.accept("USING", "STRATEGY") else "hybrid"
        return Statement("search", {"text": text, "in": label, "strategy": strategy, "weights": {}, "where": self.where(), **self.tail()})

    def _typed_search(self, strategy):
        self.expect("SEARCH")
        text = self.value()
        self.expect("IN")
        label, weights = self.word(), {}
        if self.accept("WITH"):
            self.accept("WEIGHTS")

            def one():
                key = self.word()
                self.expect("=")
                return key, self.number()

            weights = dict(self.listed(one))
        return Statement("search", {"text": text, "in": label, "strategy": strategy, "weights": weights, "where": self.where(), **self.tail()})

    def _sparse(self):
        return self._typed_search("sparse")

    def _hybrid(self):
        return self._typed_search("hybrid")

    def _semantic(self):
        return self._typed_search("similarity")

    def _create(self):
        if self.accept("NODE"):
            return Statement("create_node", {"label": self.word(), "properties": self.properties() if self.peek() == "{" else {}})
        if self.accept("EDGE"):
            kind, args = self.word(), {"where": None}
            if not self.accept("FROM"):
                self.expect("SRC")
            args["source"] = self.value()
            if not self.accept("TO"):
                self.expect("DEST")
            args["target"] = self.value()
            return Statement("create_edge", {"type": kind, **args, "properties": self.properties() if self.peek() == "{" else {}})
        if self.accept("SUBGRAPH") or self.accept("VIEW"):
            name = self.word()
            self.expect("AS")
            return Statement("create_view", {"name": name, "of": self.statement()})
        if self.accept("MATERIALIZED"):
            return self._materialized()
        if self.accept("INDEX"):
            name = self.word()
            self.expect("ON")
            label = self.word()
            self.expect("(")
            columns = self.listed(self.word, ")")
            self.expect("TYPE")
            return Statement("create_index", {"name": name, "label": label, "columns": columns, "type": self.word().upper()})
        for what in ("NAMESPACE", "GRAPH", "COLLECTION"):
            if self.accept(what):
                return Statement("create_space", {"what": what, "name": self.word()})
        raise Unsupported(f"unsupported statement: CREATE {self.peek()}")

    def _materialized(self):
        self.accept("CONTEXT")
        self.expect("VIEW")
        name = self.word()
        self.expect("AS")
        args = {"name": name, "of": self.statement(), "event": None, "every": None}
        if self.accept("REFRESH"):
            if self.accept("ON"):
                args["event"] = self.word().lower()
            else:
                self.expect("EVERY")
                n, unit = self.number(), self.word().upper().rstrip("S")
                if unit not in SECONDS:
                    raise Unsupported(f"no unit of time {unit}")
                args["every"] = n * SECONDS[unit]
        return Statement("create_materialized", args)

    def _refresh(self):
        self.expect("MATERIALIZED")
        self.expect("VIEW")
        return Statement("refresh", {"name": self.word()})

    def _use(self):
        self.at += 1
        return Statement("use", {"name": self.word()})

    def _drop(self):
        what = self.word().upper()
        if what == "MATERIALIZED":
            self.expect("VIEW")
        return Statement("drop", {"what": what, "name": self.word()})

    def _insert(self):
        self.expect("INTO")
        label = self.word()
        self.expect("VALUES")
        return Statement("create_node", {"label": label, "properties": self.properties()})

    def _update(self):
        what = self.word().upper().rstrip("S")
        label = None if self.peek() in ("SET", "WHERE") else self.word()
        self.expect("SET")
        if self.peek() == "{":
            new = self.properties()
        else:

            def one():
                key = self.word()
                self.expect("=")
                return key, self.value()

            new = dict(self.listed(one))
        return Statement("update", {"what": what, "label": label, "set": new, "where": self.where()})

    def _delete(self):
        self.accept("ALL")
        what = self.word().upper().rstrip("S")
        label = None if self.peek() in ("WHERE", "") else self.word()
        return Statement("delete", {"what": what, "label": label, "where": self.where()})

    def _merge(self):
        if self.accept("RESULTS"):
            self.expect("(")
            return Statement("merge_results", {"names": self.listed(self.word, ")")})
        self.expect("NODE")
        label, keys = self.word(), self.properties()
        return Statement("merge_node", {"label": label, "keys": keys, "set": self.properties() if self.accept("SET") else {}})

    def _let(self):
        variable = self.value()
        self.expect("=")
        return Statement("let", {"name": variable.name, "value": self.value()})

    def _diff(self):
        self.expect("NODE")
        label = self.word()
        key = None
        if self.accept("ID", "="):
            key = self.value()
        self.expect("AT")
        a = self.value()
        self.expect("VS")
        return Statement("diff", {"label": label, "id": key, "from": a, "to": self.value()})

    def _load(self):
        kind, path, args = self.word().upper(), self.value(), {"into": None, "options": {}}
        while self.at < len(self.tokens) and self.peek() != ";":
            if self.accept("INTO"):
                args["into"] = self.word()
            elif self.accept("WITH", "OPTIONS"):
                args["options"].update(self.properties())
            else:
                self.accept("WITH")
                self.accept(",")
                key = self.word()
                self.accept("=")
                args["options"][key.lower()] = self.value()
        return Statement("load", {"format": kind, "path": path, **args})

    def _define(self):
        self.expect("FUNCTION")
        name = self.word()
        self.expect("(")
        names = self.listed(self.word, ")")
        self.expect("AS", "RETURN")
        return Statement("function", {"name": name, "parameters": names, "body": self.value()})

    def _for(self):
        self.expect("EACH")
        variable = self.value()
        self.expect("IN")
        over = self.value()
        self.expect("DO")
        body = []
        while not self.accept("END"):
            body.append(self.statement())
            self.accept(";")
        return Statement("each", {"name": variable.name, "over": over, "body": body})


def parse(text: str) -> list[Statement]:
    """The statements of a script."""
    return Parser(text).script()
