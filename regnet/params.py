"""Parameters of the network plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    use_tss: bool = True
    window: tuple[int, int] = (5000, 500)
    tandem: int = 25
    min_ic: float | None = 6.0
    p_value: float = 1e-4
    intergenic: bool = False


#: Presets by genome size.
_SMALL = Params(window=(1000, 100), tandem=25)
_LARGE = Params(window=(50000, 2000), tandem=100)
SPECIES = {
    "yeast": _SMALL, "saccharomyces cerevisiae": _SMALL,
    "fly": _LARGE, "drosophila melanogaster": _LARGE,
    "mouse": _LARGE, "mus musculus": _LARGE,
    "human": _LARGE, "homo sapiens": _LARGE,
}


def preset(species: str | None) -> Params:
    if species is None:
        return Params()
    if species.lower() not in SPECIES:
        raise ValueError(f"no preset for {species}; there are {', '.join(sorted(SPECIES))}")
    return SPECIES[species.lower()]
