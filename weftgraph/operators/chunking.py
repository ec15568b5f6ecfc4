"""Chunk folds on one text: each gives (text, start, end)."""

from __future__ import annotations

import math
import re

SENTENCE = re.compile(r"[^.!?]*[.!?]+(?=\s|$)|[^.!?]+$", re.S)


def fixed(text: str, size: int, overlap: int = 0):
    at, step = 0, max(1, size - overlap)
    while at < len(text):
        yield text[at : at + size], at, min(at + size, len(text))
        if at + size >= len(text):
            return
        at += step


def _sentences(text: str):
    for m in SENTENCE.finditer(text):
        s = m[0].strip()
        if s:
            at = m.start() + m[0].index(s)
            yield s, at, at + len(s)


def _folded(parts, size: int, carry: int):
    held: list[tuple[str, int, int]] = []
    fresh = False
    for p in parts:
        if held and sum(len(s) + 1 for s, *_ in held) + len(p[0]) > size:
            if fresh:
                yield " ".join(s for s, *_ in held), held[0][1], held[-1][2]
            held, fresh = (held[-carry:] if carry else []), False
        held.append(p)
        fresh = True
    if held and fresh:
        yield " ".join(s for s, *_ in held), held[0][1], held[-1][2]


def semantic(text: str, size: int, overlap: int = 0):
    """Sentences up to size; each chunk begins with the last ceil(overlap / 50) of the one before."""
    return _folded(_sentences(text), size, math.ceil(overlap / 50))


def paragraphs(text: str):
    at = 0
    for part in re.split(r"(\n\s*\n)", text):
        s = part.strip()
        if s:
            start = at + part.index(s)
            yield s, start, start + len(s)
        at += len(part)


def recursive(text: str, size: int, overlap: int = 0):
    """Paragraphs; those that are too long by sentences; sentences that are too long in windows."""
    for p, at, end in paragraphs(text):
        if len(p) <= size:
            yield p, at, end
            continue
        for s, a, b in _folded(_sentences(p), size, 0):
            if len(s) <= size:
                yield s, at + a, at + b
            else:
                yield from ((t, at + a + x, at + a + y) for t, x, y in fixed(s, size, overlap))


def adaptive(text: str, size: int, overlap: int = 0):
    """Long words or sentences shrink the size by a sixth, short ones widen it by a fifth."""
    words = text.split()
    found = [s for s, *_ in _sentences(text)]
    ratio = sum(len(w) > 7 for w in words) / len(words) if words else 0
    mean = sum(map(len, found)) / len(found) if found else 0
    if ratio > 0.5 or mean > 150:
        size = int(size / 1.2)
    elif ratio < 0.2 and mean < 50:
        size = int(size * 1.2)
    return semantic(text, size, overlap)


def dialogue(text: str, size: int, overlap: int = 0):
    """Lines of the form Speaker: text begin turns, which stay whole up to size."""
    turns, at = [], 0
    for line in text.splitlines(keepends=True):
        if re.match(r"\s*[A-Z][\w .'-]{0,40}:\s", line) or not turns:
            turns.append([line.rstrip("\n"), at, at + len(line.rstrip("\n"))])
        else:
            turns[-1][0] += "\n" + line.rstrip("\n")
            turns[-1][2] = at + len(line.rstrip("\n"))
        at += len(line)
    return _folded(((t, a, b) for t, a, b in turns if t.strip()), size, 0)


def hierarchical(text: str, size: int, overlap: int = 0):
    """Sections begin at Markdown headings; those that are too long are cut like recursive ones."""
    starts = [0] + [m.start() for m in re.finditer(r"(?m)^#{1,6} ", text) if m.start()] + [len(text)]
    for a, b in zip(starts, starts[1:], strict=False):
        part = text[a:b]
        if len(part.strip()) <= size:
            if part.strip():
                lead = len(part) - len(part.lstrip())
                yield part.strip(), a + lead, a + lead + len(part.strip())
        else:
            yield from ((t, a + x, a + y) for t, x, y in recursive(part, size, overlap))


def token_based(text: str, size: int, overlap: int = 0):
    """Four characters for a token."""
    return fixed(text, size * 4, overlap * 4)


STRATEGIES = {"fixed": fixed, "semantic": semantic, "recursive": recursive, "adaptive": adaptive, "dialogue_aware": dialogue, "hierarchical": hierarchical, "section_based": hierarchical, "token_based": token_based}
