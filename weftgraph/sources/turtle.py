"""RDF in Turtle: prefixes, `a`, lists of predicates and objects, literals with language or type, blank nodes and their brackets.

A file is read as one row, as a prefix holds from where it stands to the end of its file. Collections in parentheses become
rdf:first and rdf:rest. What can't be read raises an error with its place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|<(?P<iri>[^<>"{}|^`\\\s]*)>|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})"""
    r"""|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|@(?P<at>[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)"""
    r"""|(?P<number>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+|\d+[eE][+-]?\d+|\d+))|_:(?P<blank>[\w](?:[\w.-]*[\w-])?)"""
    r"""|(?P<name>(?:[A-Za-z][\w-]*)?:(?:[\w%](?:[\w.%:-]*[\w%:-])?)?)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])""",
    re.S,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
Triple = tuple[str, str, str | None, str | None]


def _unescaped(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else ESCAPES.get(m[1], m[1]), text, flags=re.S)


class File:
    """The triples of one file: subject, predicate, object or literal."""

    def __init__(self, text: str, name: str = ""):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"{name}: can't read {text[at : at + 20]!r} at {at}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[m.lastgroup], at))
            at = m.end()
        self.at, self.prefixes, self.base, self.blanks, self.name, self.out = 0, {}, "", 0, name, []

    def peek(self) -> tuple[str, str, int]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "", -1)

    def take(self, *marks: str) -> tuple[str, str, int]:
        token = self.peek()
        if marks and token[1] not in marks:
            raise ValueError(f"{self.name}: {token[1]!r} at {token[2]} instead of {' or '.join(marks)}")
        self.at += 1
        return token

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:b{self.blanks}"

    def iri(self) -> str:
        kind, value, at = self.take()
        if kind == "iri":
            return value if re.match(r"[A-Za-z][\w+.-]*:", value) else self.base + value
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"{self.name}: no prefix {prefix!r} at {at}")
            return self.prefixes[prefix] + local
        raise ValueError(f"{self.name}: {value!r} at {at} isn't a name")

    def node(self) -> tuple[str | None, str | None]:
        """(resource, literal)."""
        kind, value, _ = self.peek()
        if kind == "blank":
            self.take()
            return f"_:{value}", None
        if value == "[" and kind == "mark":
            self.take()
            own = self.fresh()
            if self.peek()[1] != "]":
                self.predicates(own)
            self.take("]")
            return own, None
        if value == "(" and kind == "mark":
            self.take()
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.take(")")
            heads = [self.fresh() for _ in items]
            for head, item, rest in zip(heads, items, [*heads[1:], f"{RDF}nil"], strict=True):
                self.out += [(head, f"{RDF}first", *item), (head, f"{RDF}rest", rest, None)]
            return (heads[0] if heads else f"{RDF}nil"), None
        if kind in ("text", "long"):
            self.take()
            value = _unescaped(value[3:-3] if kind == "long" else value[1:-1])
            if self.peek()[0] == "type":
                self.take()
                self.iri()
            elif self.peek()[0] == "at":
                self.take()
            return None, value
        if kind == "number" or (kind == "word" and value in ("true", "false")):
            return None, self.take()[1]
        return self.iri(), None

    def predicates(self, subject: str) -> None:
        while True:
            if self.peek()[:2] == ("word", "a"):
                self.take()
                predicate = f"{RDF}type"
            else:
                predicate = self.iri()
            while True:
                self.out.append((subject, predicate, *self.node()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]", "") and self.peek()[0] in ("mark", "end"):
                return

    def triples(self) -> Iterator[Triple]:
        while self.peek()[0] != "end":
            kind, value, _ = self.peek()
            if (kind == "at" and value in ("prefix", "base")) or (kind == "word" and value.lower() in ("prefix", "base")):
                self.take()
                if value.lower() == "prefix":
                    prefix = self.take()[1].rstrip(":")
                    self.prefixes[prefix] = self.iri()
                else:
                    self.base = self.iri()
                if kind == "at":
                    self.take(".")
                continue
            subject, literal = self.node()
            if literal is not None:
                raise ValueError(f"{self.name}: a literal as subject")
            if self.peek()[1] != ".":
                self.predicates(subject)
            self.take(".")
            yield from self.out
            self.out = []


def turtle(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object, literal) of Turtle files; blank nodes have their file's number before their own."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))

    def run(batches):
        for batch in batches:
            for text, name in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist(), strict=True):
                rows = list(File(text or "", name).triples())
                own = lambda x, name=name: f"_:{name.rsplit('/', 1)[-1]}/{x[2:]}" if x and x.startswith("_:") else x
                columns = [[own(r[0]) for r in rows], [r[1] for r in rows], [own(r[2]) for r in rows], [r[3] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["subject", "predicate", "object", "literal"])

    return files.mapInArrow(run, "subject string, predicate string, object string, literal string")
