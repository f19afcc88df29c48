"""Registry of recognizers: predefined ones by language, additions, removal, selection and the checks of an engine."""

from __future__ import annotations

from dataclasses import replace

from .catalog import CATALOG, Recognizer


class Registry:
    """Recognizers of some languages, held on the driver: what is not selected is never scanned."""

    def __init__(self, languages: tuple[str, ...] = ("en",), recognizers: tuple[Recognizer, ...] = ()):
        self.languages, self._all = tuple(languages), list(recognizers)

    @classmethod
    def predefined(cls, languages: tuple[str, ...] = ("en",), enabled: set[str] | None = None, context: dict[str, tuple[str, ...]] | None = None) -> Registry:
        """The recognizers that are on by default (and the entities in ``enabled``), one for each language asked for that they know;
        ``context`` gives entities other context words."""
        made = []
        for r in CATALOG:
            if not (r.default or r.entity in (enabled or ())):
                continue
            if r.entity in (context or {}):
                r = replace(r, context=tuple(context[r.entity]))
            made += [replace(r, languages=(x,)) for x in languages if not r.languages or x in r.languages]
        return cls(languages, tuple(made))

    def add(self, recognizer: Recognizer) -> Registry:
        self._all.append(recognizer)
        return self

    def remove(self, name: str, language: str | None = None) -> Registry:
        self._all = [r for r in self._all if r.name != name or (language is not None and r.languages and language not in r.languages)]
        return self

    def supported_entities(self, languages: tuple[str, ...] | None = None) -> list[str]:
        return sorted({r.entity for r in self._all if not r.languages or set(r.languages) & set(languages or self.languages)})

    def recognizers(self, language: str, entities: list[str] | None = None, all_fields: bool = False, ad_hoc: tuple[Recognizer, ...] = ()) -> list[Recognizer]:
        """Those of a language, for all fields or for some entities. Neither, no recognizer at all, or an entity that none finds is an error."""
        pool = [r for r in (*self._all, *ad_hoc) if not r.languages or language in r.languages]
        if not entities and not all_fields:
            raise ValueError("name entities or ask for all fields")
        if not pool:
            raise ValueError(f"no recognizer for language {language!r}")
        if all_fields:
            return pool
        if lost := set(entities) - {r.entity for r in pool}:
            raise ValueError(f"no recognizer for {sorted(lost)} in language {language!r}")
        return [r for r in pool if r.entity in entities]


def check_languages(registry: Registry, engine: tuple[str, ...], asked: str | None = None) -> None:
    """An engine and its registry know the same languages, and the one that is asked for is among them."""
    if set(registry.languages) != set(engine):
        raise ValueError(f"registry knows {sorted(registry.languages)}, engine {sorted(engine)}")
    if asked is not None and asked not in engine:
        raise ValueError(f"language {asked!r} is not supported")
