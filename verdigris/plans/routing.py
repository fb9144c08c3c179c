"""Which way a question goes, and how its search is set up. Deterministic; a model's answer may be passed in instead."""

from __future__ import annotations

import re
import unicodedata

DEFAULTS = {"top_retrieval": 60, "top_final": 20, "context_chars": 20_000, "max_variants": 4, "profiles": 2, "searches": 8, "budget_s": 45, "alpha": 0.7, "beta": 0.3}
#: Bounds of the settings.
BOUNDS = {"top_retrieval": (10, 200), "top_final": (5, 80), "context_chars": (4_000, 120_000), "max_variants": (1, 20), "profiles": (1, 3), "searches": (1, 60), "budget_s": (10, 180)}
#: Stems of words that mark a question as complex.
COMPLEX = ("compar", "diferenc", "entre", "histor", "vigent", "revog", "aplica", "altera")
#: Words that carry no content.
STOP = {"a", "as", "o", "os", "de", "da", "do", "das", "dos", "e", "em", "que", "qual", "quais", "para", "por", "com", "um", "uma", "no", "na", "the", "of", "and"}


def plain(text: str) -> str:
    split = unicodedata.normalize("NFKD", text or "")
    return " ".join("".join(c for c in split if not unicodedata.combining(c)).lower().split())


#: The commands that a question may begin with.
COMMANDS = ("cnpj", "anm", "rag")


def route_command(text: str) -> tuple[str | None, str]:
    """``@cnpj``, ``@anm`` or ``@rag`` at the head of a question, and the rest."""
    found = re.match(rf"\s*@({"|".join(COMMANDS)})\b\s*(.*)", text or "", re.IGNORECASE | re.DOTALL)
    return (found[1].lower(), found[2].strip()) if found else (None, (text or "").strip())


def choose_route(text: str) -> str:
    """The store that a question without a command is for, by its words."""
    command, rest = route_command(text)
    if command:
        return command
    t = plain(rest)
    registry = bool(re.search(r"\bcnpj\b|\bsocios?\b|\bempresas?\b|\bfilia(l|is)\b|[0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?[0-9]{2}", t))
    acts = bool(re.search(r"\b(lei|decreto|portaria|resolucao|norma|normativo|artigo)s?\b", t))
    if registry and acts:
        return "cnpj_rag"
    if registry:
        return "cnpj"
    return "anm" if re.search(r"\b(dataset|tabelas?|dados abertos|recursos? csv|cfem)\b", t) else "rag"


def decompose(question: str) -> list[str]:
    """The parts of a question joined by `` e ``; otherwise the question."""
    parts = [p.strip() for p in re.split(r"\s+e\s+", (question or "").lower()) if p.strip()]
    return parts if len(parts) > 1 else [question.strip()] if question and question.strip() else []


def variants(question: str) -> list[str]:
    """The question, its first three content words, and the question with two leading words of inquiry."""
    words = [w for w in plain(question).split() if w not in STOP]
    made = [question.strip(), " ".join(words[:3]), f"{question.strip()} conceito", f"{question.strip()} requisitos"]
    return list(dict.fromkeys(v for v in made if v.strip()))


def clamp(value, low: int, high: int) -> int:
    try:
        return max(low, min(high, int(value)))
    except (TypeError, ValueError):
        return low


def tune(question: str, settings: dict, temporal: bool = False, sanctions: bool = False, counting: bool = False) -> dict:
    """Settings within bounds, raised for complex, sanction, temporal and counting questions and lowered for short ones."""
    s = DEFAULTS | settings
    s |= {k: clamp(s[k], *b) for k, b in BOUNDS.items()}

    def raise_to(retrieval, final, context, max_variants, budget, beta=0.0):
        for key, value in (("top_retrieval", retrieval), ("top_final", final), ("context_chars", context), ("max_variants", max_variants), ("budget_s", budget)):
            s[key] = max(s[key], value)
        s["beta"], s["alpha"] = min(0.8, s["beta"] + beta), max(0.2, s["alpha"] - beta)

    words = plain(question).split()
    if len(words) >= 16 or any(stem in plain(question) for stem in COMPLEX):
        raise_to(80, 24, 26_000, 5, 50)
    if sanctions:
        raise_to(90, 26, 32_000, 6, 55, 0.08)
    if temporal:
        raise_to(90, 26, 32_000, 6, 55, 0.10)
    if counting:
        raise_to(85, 24, 26_000, 5, 45, 0.15)
    if len(words) <= 5 and not temporal:
        for key, value in (("top_retrieval", 65), ("top_final", 18), ("context_chars", 18_000), ("max_variants", 3), ("budget_s", 30)):
            s[key] = min(s[key], value)
    if s["max_variants"] * s["profiles"] > 10:
        s["profiles"] = 1
    s["searches"] = min(s["searches"], min(max(4, s["max_variants"] * s["profiles"]), 12))
    s["top_final"] = min(s["top_final"], s["top_retrieval"])
    total = s["alpha"] + s["beta"]
    s["alpha"], s["beta"] = s["alpha"] / total, s["beta"] / total
    return s
