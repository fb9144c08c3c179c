"""What a question asks for, by its words: class, intents, profile, terms; texts that are put together from answers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from verdigris.plans.routing import plain

#: Words of questions about documents, of questions that ask for figures of them, and about ties.
DOCUMENT_WORDS = ("documento", "norma", "portaria", "resolucao", "parecer", "ata", "texto")
FIGURE_WORDS = ("quantos", "total", "listar", "tabela", "valor", "municipio", "uf")
TIE_WORDS = ("relacao", "relação", "vinculo", "vínculo", "socio", "sócio", "grupo economico")
#: Phrases that show an intent.
INTENTS = {
    "term_frequency": ("quantas vezes", "frequência", "ocorrências"),
    "term_documents": ("em quais documentos", "quais documentos", "onde aparece"),
    "rag_query": ("o que é", "defina", "explique", "qual o"),
}
#: Words that are expanded, and what is appended for them.
EXPANSIONS = {
    "parcialidade": "parcialidade favorecimento conflito de interesse tratamento desigual",
    "divergencia": "divergencia contradicao discordancia diferenca entendimento distinto",
    "risco": "risco impacto perigo ameaca dano potencial",
    "irregularidade": "irregularidade falha inconsistencia problema desconformidade",
}
#: Words left out of a term that is asked for without quotation marks, and the operators of queries.
TERM_STOP = ("quantas", "vezes", "aparece", "termo", "documentos", "em", "que")
OPERATORS = ("and", "or", "not", "near")
#: A question with the words of norms in general counts as open up to so many tokens.
OPEN_TOKENS = 14


def simple(text: str) -> str:
    """Lower case and single spaces; accents stay."""
    return " ".join((text or "").lower().split())


def classify(question: str) -> str:
    """``hybrid_sql_rag``, ``rag_only``, ``graph_only`` or ``sql_only`` (the default)."""
    text = simple(question)
    says = lambda words: any(w in text for w in words)
    if says(DOCUMENT_WORDS):
        return "hybrid_sql_rag" if says(FIGURE_WORDS) else "rag_only"
    return "graph_only" if says(TIE_WORDS) else "sql_only"


def intents(question: str) -> list[str]:
    """All intents whose phrases occur; ``rag_query`` if none does."""
    text = (question or "").lower()
    return [name for name, phrases in INTENTS.items() if any(p in text for p in phrases)] or ["rag_query"]


@dataclass(frozen=True)
class Profile:
    """A kind of legal question: groups of trigger words, of which two must be met, and searches that are added then."""

    name: str
    groups: tuple[tuple[str, ...], ...]
    searches: tuple[str, ...] = ()

    def fits(self, question: str) -> bool:
        text = plain(question)
        return sum(any(w in text for w in group) for group in self.groups) >= 2


def profile_of(question: str, profiles: list[Profile]) -> Profile | None:
    return next((p for p in profiles if p.fits(question)), None)


@dataclass(frozen=True)
class DomainIntent:
    enabled: bool
    has_terms: bool
    is_open: bool


def domain_intent(question: str, terms: tuple[str, ...], broad: tuple[str, ...]) -> DomainIntent:
    """Whether a question is about the domain: it has its terms, or it is a short one about norms in general."""
    text = plain(question)
    has = any(t in text for t in terms)
    open_ = any(t in text for t in broad) and len(re.findall(r"\w+", text)) <= OPEN_TOKENS
    return DomainIntent(has or open_, has, open_)


def expand(question: str, expansions: dict[str, str] = EXPANSIONS) -> str:
    """The question with the expansions of the words that occur in it appended."""
    text = (question or "").lower()
    return " ".join([question or "", *[more for word, more in expansions.items() if word in text]])


def is_quoted(term: str) -> bool:
    term = (term or "").strip()
    return len(term) > 1 and term[0] == term[-1] == '"'


def unquoted(term: str) -> str:
    """A term without the quotation marks around it."""
    term = (term or "").strip()
    return term[1:-1].strip() if is_quoted(term) else term


def asked_term(question: str) -> str:
    """What a question about a term asks for: the first quoted phrase, else its words but for the usual ones."""
    quoted = [p for p in (question or "").split('"')[1::2] if p]
    if quoted and question.count('"') > 1:
        return quoted[0].lower()
    return " ".join(w for w in re.findall(r"\w+", (question or "").lower()) if w not in TERM_STOP)


def query_terms(query: str) -> list[str]:
    """The phrases and then the words of a boolean query, each once, without operators and numbers."""
    parts = (query or "").split('"')
    even = len(parts) % 2 == 1
    phrases = parts[1::2] if even else parts[1:-1:2]
    rest = " ".join(parts[::2] if even else [*parts[:-1:2], parts[-1]])
    words = [w for w in re.findall(r"\w+", rest.lower()) if w not in OPERATORS and not w.isdigit()]
    return list(dict.fromkeys(t for t in [*(p.strip().lower() for p in phrases), *words] if t))


def active_terms(queries: list[str]) -> list[str]:
    """The terms of several filters, each once whatever its case."""
    return unique_fold([t for q in queries for t in query_terms(q)])


def unique_fold(values: list[str]) -> list[str]:
    """The first of the values that differ by case alone, in order."""
    seen: dict[str, str] = {}
    for value in values:
        seen.setdefault(value.casefold(), value)
    return list(seen.values())


def excludes_only(query: str) -> bool:
    """Whether a query names nothing to find, only what to leave out."""
    from verdigris.plans.boolean_query import parse_document_query

    parsed = parse_document_query(query)
    return bool(parsed.exclude) and not parsed.terms


def fill(template: str, values: dict[str, object]) -> str:
    """``{name}`` replaced by values; names that have none stay as they are."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], template)


def split_answer(text: str, mark: str = "# Evidencia") -> tuple[str, str]:
    """An answer and its evidence, which begins at the mark."""
    head, _, tail = (text or "").partition(mark)
    return head.replace("# Resposta", "", 1).strip().removesuffix("---").strip(), tail.strip()


#: Labels of a registry answer whose values are searched for, headings and blanks that are not.
LABELS = ("cnpj", "razao social", "nome fantasia", "cnae principal")
HEADINGS = ("cnpj", "razao social", "nome fantasia", "situacao", "cnae", "uf", "municipio")
BLANKS = ("", "nao informado", "none", "null")


def registry_terms(answer: str, most: int = 12) -> list[str]:
    """Names and numbers of a registry answer in Markdown: the values of its labels, then the cells of its tables."""
    labelled, cells = [], []
    for line in (answer or "").splitlines():
        label, colon, value = line.replace("*", "").strip(" -").partition(":")
        if colon and plain(label) in LABELS:
            labelled.append(value)
        elif "|" in line and not re.search(r"\|\s*-{3,}", line):
            cells += [c for c in line.strip().strip("|").split("|") if len(c.strip()) >= 4 and not re.match(r"\s*\d{2}\s*-", c)]
    clean = [" ".join(t.replace("*", "").replace("`", "").split()).strip(" :-|") for t in [*labelled, *cells]]
    found: dict[str, str] = {}
    for term in clean:
        if plain(term) not in (*BLANKS, *HEADINGS):
            found.setdefault(plain(term), term)
    return list(found.values())[:most]


def documents_after_registry(question: str, answer: str, most: int = 8_000) -> str:
    """The question for the documents, with what the registry said and the terms to look for."""
    terms = "; ".join(registry_terms(answer)) or question.strip()
    return f"{question.strip()}\n\nTermos para a busca: {terms}\n\nDados do cadastro:\n{(answer or '').strip()[:most]}"


def registry_after_documents(question: str, answer: str, most: int = 8_000) -> str:
    """The question for the registry, with the names that the documents' answer holds."""
    terms = "; ".join(registry_terms(answer, 16)) or question.strip()
    return f"{question.strip()}\n\nTermos para a consulta: {terms}\n\nAchados nos documentos:\n{(answer or '').strip()[:most]}"


def joined_answers(parts: dict[str, str]) -> str:
    """Several answers as one: their texts under their titles, then their evidence under the same."""
    split = {title: split_answer(text) for title, text in parts.items()}
    answers = "\n\n".join(f"## {title}\n\n{answer}" for title, (answer, _) in split.items())
    evidence = "\n\n".join(f"## {title}\n\n{found or 'Sem evidencia detalhada.'}" for title, (_, found) in split.items())
    return f"# Resposta\n\n{answers}\n\n---\n\n# Evidencia\n\n{evidence}"
