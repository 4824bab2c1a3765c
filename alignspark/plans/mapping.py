"""Matching frame columns to table columns by name."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from difflib import SequenceMatcher


@dataclass
class Mapping:
    source: str
    target: str
    confidence: float
    reasons: list[str] = field(default_factory=list)


def normal_case(name: str, dialect: str) -> str:
    """Unquoted identifiers: upper case for Oracle, lower case elsewhere; quoted ones as written."""
    if len(name) > 1 and name[0] == name[-1] == '"':
        return name[1:-1]
    return name.upper() if dialect == "oracle" else name.lower()


def words(name: str) -> set[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return {w for w in re.split(r"[\W_]+", spaced.lower()) if w}


def similarity(a: str, b: str) -> float:
    """1 if equal, 0.95 but for case; else sequence ratio, shared words, and small bonuses for equal ends."""
    if a == b:
        return 1.0
    x, y = a.lower(), b.lower()
    if x == y:
        return 0.95
    ratio = SequenceMatcher(None, x, y).ratio()
    p, q = words(a), words(b)
    shared = len(p & q) / len(p | q) if p | q else 0.0
    head = 0.2 if x[:3] == y[:3] else 0.0
    tail = 0.2 if x[-3:] == y[-3:] else 0.0
    return 0.6 * ratio + 0.3 * shared + 0.05 * head + 0.05 * tail


def match_columns(source: list[str], target: list[str], threshold: float = 0.8) -> tuple[list[Mapping], list[str], list[str]]:
    """Greedy one-to-one matching, best pairs first: (mappings, unmatched source, unmatched target)."""
    pairs = sorted(((similarity(s, t), i, j) for i, s in enumerate(source) for j, t in enumerate(target)), key=lambda p: (-p[0], p[1], p[2]))
    left, right, found = set(range(len(source))), set(range(len(target))), []
    for score, i, j in pairs:
        if score < threshold:
            break
        if i in left and j in right:
            left.discard(i)
            right.discard(j)
            why = "same name" if score == 1 else "same but for case" if score == 0.95 else "similar name"
            found.append(Mapping(source[i], target[j], round(score, 4), [why]))
    return found, [source[i] for i in sorted(left)], [target[j] for j in sorted(right)]


def rename_suggestions(source: list[str], target: list[str], least: float = 0.5) -> list[Mapping]:
    """For unmatched columns, the most similar table column."""
    _, extra, missing = match_columns(source, target)
    out = []
    for s in extra:
        best = max(missing, key=lambda t: similarity(s, t), default=None)
        if best is not None and similarity(s, best) >= least:
            out.append(Mapping(s, best, round(similarity(s, best), 4), ["suggestion"]))
    return out


def report(mappings: list[Mapping], extra: list[str], missing: list[str]) -> str:
    bands = (("certain", 0.95, 1.01), ("likely", 0.8, 0.95), ("weak", 0.0, 0.8))
    lines = [f"{name}: " + (", ".join(f"{m.source} -> {m.target}" for m in mappings if lo <= m.confidence < hi) or "none") for name, lo, hi in bands]
    return "\n".join([*lines, f"not in table: {', '.join(extra) or 'none'}", f"not in frame: {', '.join(missing) or 'none'}"])
