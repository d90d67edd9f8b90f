"""Units, elements and basis conventions."""

HARTREE_EV = 27.211386  # electron volts
DEBYE = 2.541746  # of one atomic unit of dipole moment
BOHR_PER_ANGSTROM = 1.8897259886

SYMBOLS = {1: "H", 3: "Li", 6: "C", 7: "N", 8: "O", 9: "F"}

#: Functions of a shell.
SHELL_SIZE = {"s": 1, "p": 3, "d": 5}

#: Shells of an atom by atomic number, in the two basis sets.
DEF2SVP = {1: "ssp", 3: "ssspp", 6: "sssppd", 7: "sssppd", 8: "sssppd", 9: "sssppd"}
GDP_6311 = {1: "sssp", 3: "sssssppppd", 6: "sssssppppd", 7: "sssssppppd", 8: "sssssppppd", 9: "sssssppppd"}

#: For each convention its shells and, for each kind of shell, which old function becomes the m-th new one.
CONVENTIONS = {
    "pyscf_def2svp": (DEF2SVP, {"s": (0,), "p": (1, 2, 0), "d": (0, 1, 2, 3, 4)}),
    "gau_def2svp_2_pyscf": (DEF2SVP, {"s": (0,), "p": (0, 1, 2), "d": (4, 2, 0, 1, 3)}),
    "pyscf_6311_plus_gdp": (GDP_6311, {"s": (0,), "p": (1, 2, 0), "d": (0, 1, 2, 3, 4)}),
    "back2pyscf": (DEF2SVP, {"s": (0,), "p": (2, 0, 1), "d": (0, 1, 2, 3, 4)}),
    "back_2_thu_pyscf": (GDP_6311, {"s": (0,), "p": (2, 0, 1), "d": (0, 1, 2, 3, 4)}),
}

#: The convention that brings predictions in a basis set to the common one.
BASIS_CONVENTION = {"def2svp": "back2pyscf", "6311gdp": "back_2_thu_pyscf"}

#: Index lists of an element's atomic orbitals in def2-SVP blocks.
ELEMENT_BLOCKS = {
    "H": (0, 1, 2, 3, 4),
    "Li": (0, 1, 2, 3, 4, 5, 6, 7, 8),
    "C": (0, 1, 2, 3, 4, 5, 6, 7, 8, 13, 11, 9, 10, 12),
    "N": (0, 1, 2, 3, 4, 5, 6, 7, 8, 13, 11, 9, 10, 12),
    "O": (0, 1, 2, 3, 4, 5, 6, 7, 8, 13, 11, 9, 10, 12),
    "F": (0, 1, 2, 3, 4, 5, 6, 7, 8, 13, 11, 9, 10, 12),
}


def convention_rows(name: str) -> list[tuple[str, int, int, str, int, int, int]]:
    """``(name, z, shell, kind, m, src, sign)`` of a convention; an unknown name raises."""
    if name not in CONVENTIONS:
        raise ValueError(f"unknown convention {name!r}; known: {', '.join(sorted(CONVENTIONS))}")
    shells, order = CONVENTIONS[name]
    return [(name, z, k, kind, m, src, 1) for z, kinds in sorted(shells.items()) for k, kind in enumerate(kinds) for m, src in enumerate(order[kind])]


def resolve_basis(basis: str) -> str:
    """Name of the convention for a basis set; an unknown one raises."""
    if basis not in BASIS_CONVENTION:
        raise ValueError(f"unknown basis {basis!r}; known: {', '.join(sorted(BASIS_CONVENTION))}")
    return BASIS_CONVENTION[basis]
