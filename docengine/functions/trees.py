"""Content trees of any depth: nothing here recurses, so that a page's nesting has no limit.

A function over trees is written as a generator that yields the same function's generator for a part of the tree and is sent its
result; `unwound` runs it on a stack of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Generator
from json.decoder import scanstring
from typing import Any

_SPACE = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"(?P<number>-?(?:0|[1-9]\d*)(?P<float>(?:\.\d+)?(?:[eE][-+]?\d+)?))|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}


def unwound(run: Generator[Generator, Any, Any]) -> Any:
    """The result of a generator that yields generators in place of calls."""
    stack, value = [run], None
    while stack:
        try:
            part = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(part)
            value = None
    return value


def loads(text: str) -> Any:
    """JSON of any depth; ValueError for what isn't JSON."""
    try:
        return json.loads(text)
    except RecursionError:
        return unwound(_document(text))


def _document(text: str) -> Generator:
    value, end = yield _value(text, _SPACE.match(text).end())
    if _SPACE.match(text, end).end() != len(text):
        raise ValueError(f"more after the end, at {end}")
    return value


def _value(text: str, at: int) -> Generator:
    """(value, where it ends) of the value that begins at a place."""
    skip = lambda i: _SPACE.match(text, i).end()
    first = text[at : at + 1]
    if first == '"':
        return scanstring(text, at + 1, True)
    if first not in ("[", "{"):
        if not (m := _PLAIN.match(text, at)):
            raise ValueError(f"no value at {at}")
        number = m["number"]
        return (_WORDS[m[0]] if number is None else float(number) if m["float"] else int(number)), m.end()
    out: Any = [] if first == "[" else {}
    last = "]" if first == "[" else "}"
    at = skip(at + 1)
    if text[at : at + 1] == last:
        return out, at + 1
    while True:
        if first == "{":
            if text[at : at + 1] != '"':
                raise ValueError(f"no name at {at}")
            name, at = scanstring(text, at + 1, True)
            at = skip(at)
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at = skip(at + 1)
            out[name], at = yield _value(text, at)
        else:
            item, at = yield _value(text, at)
            out.append(item)
        at = skip(at)
        mark = text[at : at + 1]
        if mark == last:
            return out, at + 1
        if mark != ",":
            raise ValueError(f"no comma at {at}")
        at = skip(at + 1)


def dumps(value: Any, sort_keys: bool = False) -> str:
    """JSON of a tree of any depth, as json.dumps writes it."""
    try:
        return json.dumps(value, sort_keys=sort_keys)
    except RecursionError:
        pass
    out: list[str] = []
    stack: list[Any] = [(value,)]  # a value to write is in a tuple; a string is written as it is
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
            continue
        node = part[0]
        if isinstance(node, dict) and node:
            items = sorted(node.items()) if sort_keys else list(node.items())
            todo: list[Any] = ["{"]
            for k, (name, x) in enumerate(items):
                todo += [", " * (k > 0) + json.dumps(name) + ": ", (x,)]
            stack.extend(reversed([*todo, "}"]))
        elif isinstance(node, list) and node:
            todo = ["["]
            for k, x in enumerate(node):
                todo += [", " * (k > 0), (x,)]
            stack.extend(reversed([*todo, "]"]))
        else:
            out.append(json.dumps(node))
    return "".join(out)
