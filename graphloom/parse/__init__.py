"""From source text to entities and references, by language."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from functools import lru_cache

from graphloom.parse import code, markup
from graphloom.parse.model import Source, finish


def _rust(src: Source) -> None:
    code.rust(src)
    code.rust_attach(src)


#: The extractor of each language; `register` puts another in its place.
EXTRACTORS: dict[str, Callable[[Source], None]] = {
    "java": code.java, "kotlin": code.kotlin, "typescript": code.ecma, "javascript": code.ecma, "rust": _rust, "python": code.python, "html": markup.html, "css": markup.css, "scss": lambda s: markup.css(s, True),
}


#: Extractors that replace those above: a callable, or the text of a module with a function `extract(src)`.
CUSTOM: dict[str, Callable[[Source], None] | str] = {}


def register(language: str, extractor: Callable[[Source], None] | str | None) -> None:
    """Uses `extractor` for a language from now on; null goes back to the engine's own. Stages planned later take it to the workers."""
    if extractor is None:
        CUSTOM.pop(language, None)
    else:
        CUSTOM[language] = extractor


def from_folder(folder: str) -> dict[str, str]:
    """The extractors of a folder: `<language>.py`, each with a function `extract(src)`. What can't be read is left to the engine's own."""
    found = {}
    for language in EXTRACTORS:
        path = os.path.join(folder, f"{language}.py")
        if os.path.exists(path):
            try:
                with open(path, encoding="utf-8") as f:
                    found[language] = f.read()
            except (OSError, UnicodeDecodeError) as e:
                logging.getLogger(__name__).warning("%s is not used: %s", path, e)
    return found


@lru_cache(maxsize=64)
def _compiled(text: str) -> Callable[[Source], None] | None:
    try:
        names: dict = {}
        exec(compile(text, "<extractor>", "exec"), names)  # the operator's own code, given by configuration
        return names["extract"]
    except Exception as e:
        logging.getLogger(__name__).warning("an extractor is not used: %s", e)
        return None


def extract(language: str, text: str, path: str, repo: str, custom: dict | None = None) -> list[dict]:
    """The file's entities with their intents. Never raises for what the text holds; an unknown language gives nothing.

    `custom` (by default what is registered) replaces extractors; one that can't be compiled or raises gives way to the engine's own.
    """
    own = EXTRACTORS.get(language)
    given = (CUSTOM if custom is None else custom).get(language)
    given = _compiled(given) if isinstance(given, str) else given
    if (own is None and given is None) or not text or not text.strip():
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff")
    for run in (given, own):
        if run is None:
            continue
        src = Source(language, text)
        try:
            run(src)
        except Exception as e:
            if run is own:
                raise
            logging.getLogger(__name__).warning("the extractor of %s failed on %s: %s", language, path, e)
            continue
        return finish(src, path, repo)
    return []
