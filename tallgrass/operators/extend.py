"""Operators of one's own in the formula language."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from ..functions import formula
from ..functions.formula import Kind, Spec
from .compiler import KERNELS
from .fold import Kernel
from .rowwise import ROWWISE
from .window import WINDOW


def register(name: str, build: Callable | None = None, operands: int = 1, windows: int = 0, kind: Kind | None = None, rule: Callable | None = None, kernel: Callable[..., Kernel] | None = None) -> None:
    """Make name(operands.., window) an operator, by a column or by a kernel. build takes the operands' columns and, with a
    window, the instrument's ordered window and the number of rows. kernel takes the number of rows, if there is a window,
    and gives what walks along each series with a state. Its type is kind, or that of its operands, or what rule makes
    of theirs."""
    if not name.isidentifier() or name in formula.SPECS or name.lower() in formula._BY_ALIAS:
        raise ValueError(f"`{name}` cannot name a new operator")
    if windows not in (0, 1) or operands < 1:
        raise ValueError("an operator has one operand at least, and one window at most")
    if (build is None) == (kernel is None):
        raise ValueError("an operator is built by a column or by a kernel")
    if kernel is not None and not isinstance(kernel(*[2] * windows), Kernel):
        raise TypeError("a kernel has start and step")
    groups = {(1, 0): "unary", (2, 0): "binary", (1, 1): "unary_ts", (2, 1): "binary_ts"}
    formula.SPECS[name] = Spec(name, operands, windows, rule or (lambda *kinds: kind or kinds[0]), groups.get((operands, windows), "conditional"))
    formula._BY_ALIAS[name.lower()] = name
    (KERNELS if kernel else WINDOW if windows else ROWWISE)[name] = kernel or build


def remove(name: str) -> None:
    formula.SPECS.pop(name, None)
    formula._BY_ALIAS.pop(name.lower(), None)
    for table in (ROWWISE, WINDOW, KERNELS):
        table.pop(name, None)


@contextmanager
def registered(name: str, build: Callable | None = None, **how) -> Iterator[None]:
    """An operator for the plans that are made within."""
    register(name, build, **how)
    try:
        yield
    finally:
        remove(name)
