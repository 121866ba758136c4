"""Request texts for an outside model, one per kind of question, as SQL expressions."""

from __future__ import annotations

from . import fixed
from .sql import case, lit, struct

TASK = {
    "general": "Describe the document below.",
    "invoice": "Read all financial details from the invoice or receipt below.",
    "contract": "Read the legal details from the contract below.",
    "form": "List every field of the form below with its value.",
    "report": "Describe the report below.",
    "entities": "List the entities named in the text below.",
}


def _question(task: str, keys: str, text: str) -> str:
    head = lit(f"{task}\nAnswer with one JSON object that has the keys {keys}.\n\n")
    return f"concat({head}, {text})"


def _cut(text: str, chars: int) -> str:
    return f"substring({text}, 1, {chars})"


def prompt(kind: str, text: str, summary_chars: int = 300, entity_chars: int = fixed.ENTITY_CHARS) -> str:
    """Full request: the whole text, but for entities its first `entity_chars`; unknown kinds ask in general."""
    branches = []
    for name in ["invoice", "contract", "form", "report"]:
        branches.append((f"{kind} = '{name}'", _question(TASK[name], fixed.REQUEST_KEYS[name], text)))
    short = _cut(text, entity_chars)
    branches.append((f"{kind} = 'entities'", _question(TASK["entities"], fixed.REQUEST_KEYS["entities"], short)))
    summary = f"concat({lit(f'Summarize this text in at most {summary_chars} characters:\n\n')}, {text})"
    branches.append((f"{kind} = 'summary'", summary))
    return case(branches, _question(TASK["general"], fixed.REQUEST_KEYS["general"], text))


def brief_prompt(kind: str, text: str, chars: dict[str, int] | None = None) -> str:
    """Short request over the beginning of the text, `chars` of it by kind; unknown kinds ask in general."""
    chars = fixed.BRIEF_CHARS | (chars or {})
    ask = lambda n: _question(TASK[n], fixed.BRIEF_KEYS[n], _cut(text, chars[n]))
    return case([(f"{kind} = '{n}'", ask(n)) for n in ["invoice", "contract", "form"]], ask("general"))


def validation_prompt(information: str, rules: str) -> str:
    head = lit(
        "Check the information against the rules.\n"
        "Answer with one JSON object that has the keys is_valid, confidence, issues, suggestions.\n\nInformation: "
    )
    return f"concat({head}, {information}, '\\n\\nRules: ', {rules})"


def request(kind: str, prompt_text: str, model: str, system: str | None = None, summary_chars: int = 300) -> str:
    """Row of a batch-inference table: model, messages and sampling parameters."""
    message = lambda role, text: struct(role=lit(role), content=text)
    messages = [message("user", prompt_text)]
    if system is not None:
        messages.insert(0, message("system", lit(system)))
    heat = [(f"{kind} = '{n}'", f"{t}D") for n, t in fixed.REQUEST_TEMPERATURE.items()]
    return struct(
        model=lit(model),
        messages=f"array({', '.join(messages)})",
        temperature=case(heat, f"{fixed.REQUEST_TEMPERATURE['general']}D"),
        max_tokens=f"IF({kind} = 'summary', {summary_chars}, {fixed.MAX_TOKENS})",
        top_p=f"{fixed.TOP_P}D",
        stream="false",
    )
