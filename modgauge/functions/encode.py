"""Byte-stable text: JSON with escaped HTML signs and bare integral floats, plus small number and list formats."""

from __future__ import annotations

import json
import math

ESCAPED = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029"}


def number(x: float) -> str:
    """Shortest digits; integral values have no point, and exponents appear below 1e-6 and from 1e21 on."""
    if not math.isfinite(x):
        raise ValueError(f"{x} has no JSON form")
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    digits, _, power = repr(x).partition("e")
    if 1e-6 <= abs(x) < 1e21:
        return format(x, "f").rstrip("0").rstrip(".") if power or abs(x) >= 1e16 else digits.removesuffix(".0")
    if not power:
        digits, _, power = format(x, "e").partition("e")
    return f"{digits.removesuffix('.0')}e{'-' if power[0] == '-' else '+'}{power.lstrip('+-').lstrip('0').zfill(2)}"


def text(s: str) -> str:
    return "".join(ESCAPED.get(c, c) for c in json.dumps(s, ensure_ascii=False))


def dumps(value, indent: int = 2, level: int = 0) -> str:
    """JSON with keys as they come; None values are written as null, so leave out what is to be omitted."""
    pad, end = "\n" + " " * indent * (level + 1), "\n" + " " * indent * level
    match value:
        case None | bool():
            return json.dumps(value)
        case str():
            return text(value)
        case int():
            return str(value)
        case float():
            return number(value)
        case dict() if value:
            return "{" + ",".join(f"{pad}{text(str(k))}: {dumps(v, indent, level + 1)}" for k, v in value.items()) + end + "}"
        case list() | tuple() if value:
            return "[" + ",".join(pad + dumps(v, indent, level + 1) for v in value) + end + "]"
    return "{}" if isinstance(value, dict) else "[]"


def count(n: int, noun: str) -> str:
    return f"{n} {noun}" if n == 1 else f"{n} {noun}s"


def ticked(items) -> str:
    return ", ".join(f"`{x}`" for x in items)


def columns(rows: list[list[str]], gap: int = 2) -> str:
    """Left-aligned columns; the last one isn't padded."""
    widths = [max(map(len, c)) + gap for c in zip(*rows, strict=True)]
    return "".join("".join(x.ljust(w) for x, w in zip(r[:-1], widths, strict=False)) + r[-1] + "\n" for r in rows)
