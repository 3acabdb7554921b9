"""Rule packs: the vocabulary is data, the engine is the same for all of them."""

from __future__ import annotations


def rule_pack(name: str):
    from factsieve.packs import english, korean

    packs = {"employment_ko": korean.PACK, "signals_en": english.PACK}
    if name not in packs:
        raise ValueError(f"unknown rule pack {name!r}; known: {sorted(packs)}")
    return packs[name]
