"""Strict JSON reading that also takes nesting of any depth."""

from __future__ import annotations

import json
import re

_NUMBER = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
_SPACE = re.compile(r"[ \t\n\r]*")


def _no_constant(name: str):
    raise ValueError(name)


def parse(text: str):
    """The value of a JSON text; ValueError if it isn't valid JSON (NaN and Infinity are not)."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(s: str):
    """As :func:`parse` with a stack of its own instead of recursion."""
    pos = _SPACE.match(s, 0).end()
    stack: list = []  # (container, key)
    while True:
        c = s[pos : pos + 1]
        if c in ("{", "["):
            value = {} if c == "{" else []
            pos = _SPACE.match(s, pos + 1).end()
            if s[pos : pos + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    key, pos = _key(s, pos)
                    stack.append((value, key))
                else:
                    stack.append((value, None))
                continue
            pos += 1
        elif c == '"':
            value, pos = json.decoder.scanstring(s, pos + 1, True)
        else:
            for word, value in (("true", True), ("false", False), ("null", None)):
                if s.startswith(word, pos):
                    pos += len(word)
                    break
            else:
                m = _NUMBER.match(s, pos)
                if not m:
                    raise ValueError(f"no value at {pos}")
                value, pos = (float if m[2] or m[3] else int)(m[0]), m.end()
        while True:  # value is complete: put it into its container
            pos = _SPACE.match(s, pos).end()
            if not stack:
                if pos != len(s):
                    raise ValueError(f"more text at {pos}")
                return value
            box, key = stack.pop()
            if key is None:
                box.append(value)
            else:
                box[key] = value
            c = s[pos : pos + 1]
            if c == ",":
                pos = _SPACE.match(s, pos + 1).end()
                if key is not None:
                    key, pos = _key(s, pos)
                stack.append((box, key))
                break
            if c != ("]" if key is None else "}"):
                raise ValueError(f"no end at {pos}")
            pos, value = pos + 1, box


def _key(s: str, pos: int) -> tuple[str, int]:
    if s[pos : pos + 1] != '"':
        raise ValueError(f"no key at {pos}")
    key, pos = json.decoder.scanstring(s, pos + 1, True)
    pos = _SPACE.match(s, pos).end()
    if s[pos : pos + 1] != ":":
        raise ValueError(f"no colon at {pos}")
    return key, _SPACE.match(s, pos + 1).end()
