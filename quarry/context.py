"""Who asks: the principal of a request, bound by the surface and never taken from arguments."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass


@dataclass(frozen=True)
class Principal:
    """An id, the namespace it may read and write, and its capabilities."""

    id: str
    namespace: str
    capabilities: tuple[str, ...] = ()


_BOUND: ContextVar[Principal | None] = ContextVar("principal", default=None)

#: Finds the principal of a credential, or None.
Resolver = Callable[[str], Principal | None]


@contextmanager
def bound(principal: Principal) -> Iterator[Principal]:
    """Binds a principal for a block of work; a principal without a namespace is refused."""
    if not principal.namespace:
        raise ValueError("a principal needs a namespace")
    token = _BOUND.set(principal)
    try:
        yield principal
    finally:
        _BOUND.reset(token)


def current() -> Principal:
    """The bound principal; there is no default."""
    found = _BOUND.get()
    if found is None:
        raise PermissionError("no principal is bound")
    return found


def resolved(credential: str, resolver: Resolver) -> Principal:
    found = resolver(credential)
    if found is None:
        raise PermissionError("unknown credential")
    return found
