"""Answers of models and services as data: JSON inside text, ranked lists in changing envelopes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

#: Names under which services return lists, places and scores.
LISTS = ("results", "rerank_results", "rankings", "ranking", "data", "documents", "items")
PLACES = ("index", "document_index", "documentIndex", "document_idx", "ranked_index")
SCORES = ("relevance_score", "relevanceScore", "score", "relevance", "rank_score", "rankScore")


def json_in(text: str, opening: str = "{"):
    """The JSON object (or with ``[`` array) in a model's answer, which fences and words may surround; None without one."""
    body = re.sub(r"```(?:json)?", " ", text or "")
    start, end = body.find(opening), body.rfind("}" if opening == "{" else "]")
    if start < 0 or end < start:
        return None
    try:
        return json.loads(body[start : end + 1])
    except ValueError:
        return None


def query_list(text: str) -> list[str]:
    """Queries in an answer: a bare array, or an object's ``queries``."""
    found = json_in(text)
    items = found.get("queries") if isinstance(found, dict) else None
    items = items if isinstance(items, list) else json_in(text, "[")
    return [q.strip() for q in items or [] if isinstance(q, str) and q.strip()]


def _lists(payload, depth: int = 0) -> Iterator[list]:
    if depth > 6:
        return
    if isinstance(payload, str):
        try:
            payload = json.loads(payload)
        except ValueError:
            return
    if isinstance(payload, list):
        if any(isinstance(x, dict) for x in payload):
            yield payload
        else:
            for x in payload:
                yield from _lists(x, depth + 1)
    elif isinstance(payload, dict):
        for key in sorted(payload, key=lambda k: LISTS.index(k) if k in LISTS else len(LISTS)):
            yield from _lists(payload[key], depth + 1)


def ranking(payload) -> list[tuple[int, float]]:
    """``(place, score)`` from the first list in a payload that holds scores; items without one are left out."""
    for items in _lists(payload):
        found = []
        for at, item in enumerate(items):
            if not isinstance(item, dict):
                continue
            place = next((item[k] for k in PLACES if k in item), at)
            score = next((item[k] for k in SCORES if item.get(k) is not None), None)
            try:
                found.append((int(place), float(score)))
            except (TypeError, ValueError):
                continue
        if found:
            return found
    return []


def markdown_table(rows: list[dict], columns: list[str] | None = None, width: int = 300) -> str:
    """Rows as a Markdown table: cells cut, numbers with a decimal comma."""
    columns = columns or (list(rows[0]) if rows else [])

    def cell(value) -> str:
        if isinstance(value, float):
            value = f"{value:,.2f}".translate(str.maketrans(",.", ".,"))
        text = "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")
        return text if len(text) <= width else text[: width - 3] + "..."

    lines = [columns, ["---"] * len(columns), *[[cell(r.get(c)) for c in columns] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)
