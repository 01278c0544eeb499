"""Pages of one document or of a list of results, under a byte budget. On the driver: the input is one answer."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import Any


def _size(value: Any) -> int:
    return len(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode())


def pack(items: Sequence[Any], budget: int) -> list[list[Any]]:
    """Items in order, as many on a page as the budget has room for; an item over it has a page of its own."""
    pages: list[list[Any]] = []
    used = 0
    for x in items:
        n = _size(x) + 1
        if not pages or used + n > budget:
            pages.append([])
            used = 2
        pages[-1].append(x)
        used += n
    return pages or [[]]


def with_totals(items: Sequence[Any], budget: int, envelope: dict[str, Any], rounds: int = 12) -> list[dict[str, Any]]:
    """Envelopes of pages; the page numbers they name take room too, so the number of pages is a fixed point."""
    total = 1
    for _ in range(rounds):
        room = budget - _size({**envelope, "page": total, "totalPages": total, "items": []})
        pages = pack(items, max(room, 1))
        if len(pages) == total:
            break
        total = len(pages)
    return [{**envelope, "page": k, "totalPages": len(pages), "items": p} for k, p in enumerate(pages, 1)]


def split_text(text: str, budget: int) -> list[str]:
    """Text in pieces of at most `budget` bytes: between paragraphs, else lines, else characters."""
    if len(text.encode()) <= budget:
        return [text]
    for cut in ("\n\n", "\n"):
        parts = text.split(cut)
        if len(parts) > 1:
            out: list[str] = []
            for p in parts:
                if out and len((out[-1] + cut + p).encode()) <= budget:
                    out[-1] += cut + p
                else:
                    out.append(p)
            return [piece for p in out for piece in (split_text(p, budget) if len(p.encode()) > budget else [p])]
    out, piece, used = [], [], 0
    for c in text:
        if used + len(c.encode()) > budget and piece:
            out.append("".join(piece))
            piece, used = [], 0
        piece.append(c)
        used += len(c.encode())
    return [*out, "".join(piece)]


def paginate_document(sections: Sequence[dict[str, Any]], budget: int) -> list[list[dict[str, Any]]]:
    """Sections (heading, content) on pages; one over the budget is split and its parts numbered."""
    flat = []
    for s in sections:
        pieces = split_text(s.get("content") or "", max(budget - _size({**s, "content": ""}) - 8, 1))
        flat += [{**s, "content": p, **({"part": k} if len(pieces) > 1 else {})} for k, p in enumerate(pieces, 1)]
    return pack(flat, budget)


def excerpts(text: str, query: str, most: int = 3, context: int = 120) -> list[str]:
    """Windows around the matches of a query, merged where they meet, `most` at most."""
    spans: list[list[int]] = []
    for m in re.finditer(re.escape(query), text, re.IGNORECASE) if query else ():
        a, b = max(0, m.start() - context), min(len(text), m.end() + context)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        elif len(spans) == most:
            break
        else:
            spans.append([a, b])
    return [("..." if a else "") + text[a:b].strip() + ("..." if b < len(text) else "") for a, b in spans]
