"""Domains: what a kind of text brings along. Own domains plug in by register()."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import SECTION_TYPES
from . import features, parse


def sections_of(name: str, configured: str = "") -> tuple[str, ...]:
    """Section types of a domain; a comma-separated setting goes before its own."""
    given = tuple(x.strip() for x in configured.split(",") if x.strip())
    return given or SECTION_TYPES.get(name, ("section",))


@dataclass(frozen=True)
class Domain:
    """Hooks of a domain. ``parse_works``: files (path, value, set) to works. ``parse_blocks``: works to parsed blocks.
    ``scopes``: works and blocks to further texts (work_id, scope, text), or None. The extractors give features of
    atoms, blocks and works. ``seed``: how seed texts are laid out, a folder for each work (directory-work: they are read
    by import_corpus) or text files."""

    name: str
    section_types: tuple[str, ...]
    parse_works: Callable[[DataFrame], DataFrame]
    parse_blocks: Callable[[DataFrame], DataFrame]
    scopes: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    atom_features: Callable[[DataFrame], DataFrame] = features.atom_features
    block_features: Callable[[DataFrame, list[str]], DataFrame] = features.block_features
    work_features: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = features.work_features
    seed: str = "flat-text"


_OWN: dict[str, Domain] = {}


def register(domain: Domain) -> None:
    _OWN[domain.name] = domain


def get(name: str = "lyrics", configured: str = "") -> Domain:
    """The domain of that name: a registered one, else lyrics, else one of plain sections."""
    if name in _OWN:
        return _OWN[name]
    lyrics = name == "lyrics"
    return Domain(
        name,
        sections_of(name, configured),
        lambda files: parse.parse_works(files, name),
        lambda works: parse.parse_blocks(works, domain=name),
        parse.extra_scopes if lyrics else None,
        seed="directory-work" if lyrics else "flat-text",
    )
