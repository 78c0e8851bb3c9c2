"""Parsing of the JSON payloads that several operators judge rows by."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null)|($))')
_LITERALS = {"true": True, "false": False, "null": None}


def _reject(name: str):
    raise ValueError(f"{name} is not JSON")


def read_nested(text: str, number: Callable[[str], object] = str) -> object:
    """The value of a JSON text at any depth: a scan with its own stack, for what the recursive parser can't take."""
    top: list = []
    stack: list = [top]
    keys: list[str | None] = [None]
    at, want = 0, "value"

    def put(value: object) -> None:
        if isinstance(stack[-1], dict):
            stack[-1][keys[-1]] = value
        else:
            stack[-1].append(value)

    while True:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        sign, string, figure, literal, _ = m.groups()
        may_be_value = want in ("value", "value or ]")
        if may_be_value and sign in ("{", "["):
            box: object = {} if sign == "{" else []
            put(box)
            stack.append(box)
            keys.append(None)
            want = "key or }" if sign == "{" else "value or ]"
        elif may_be_value and (string is not None or figure or literal):
            put(json.loads(string) if string is not None else number(figure) if figure else _LITERALS[literal])
            want = "end"
        elif want in ("key", "key or }") and string is not None:
            keys[-1] = json.loads(string)
            want = ":"
        elif want == ":" and sign == ":":
            want = "value"
        elif len(stack) > 1 and (sign == "]" and want in ("value or ]", "end") and isinstance(stack[-1], list) or sign == "}" and want in ("key or }", "end") and isinstance(stack[-1], dict)):
            stack.pop()
            keys.pop()
            want = "end"
        elif len(stack) > 1 and want == "end" and sign == ",":
            want = "key" if isinstance(stack[-1], dict) else "value"
        elif want == "end" and len(stack) == 1 and m.lastindex == 5:
            return top[0]
        else:
            raise ValueError(f"no JSON at {at}")


class Reader:
    """Strict JSON (no NaN or Infinity) at any depth; numbers are made by `number` from the text they were written as."""

    def __init__(self, number: Callable[[str], object] = str):
        self.number = number
        self.decoder = json.JSONDecoder(parse_constant=_reject, parse_int=number, parse_float=number)

    def __call__(self, text: str) -> object:
        try:
            return self.decoder.decode(text)
        except RecursionError:
            return read_nested(text, self.number)


loads = Reader()


def parse_payload(text: str | None) -> tuple[bool, str | None, object]:
    """(parses, the JSON text, its value) of a payload; a payload that is a JSON string is parsed once more."""
    if text is None:
        return False, None, None
    try:
        value = loads(text)
        if text.lstrip()[:1] == '"':  # numbers are also kept as str, so the type alone does not tell
            text = value
            value = loads(text)
        return True, text, value
    except ValueError:
        return False, None, None
