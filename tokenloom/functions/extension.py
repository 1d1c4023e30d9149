"""Components that a configuration names by where they are defined, `package.module:factory`, beside the built-in kinds.

The factory gets the component's configuration and returns what the built-in ones return: a model with `vocab` and
`tokens(word)`, a normalizer or pre-tokenizer of Text, a processor with `added` and `process`, a decoder of token lists.
The module must be importable where the kernels run, on the executors too.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable


def extension(kind: str | None) -> Callable | None:
    """The factory that a component's type names, or None for the name of a built-in kind."""
    module, found, name = (kind or "").partition(":")
    if not found:
        return None
    factory = getattr(importlib.import_module(module), name, None)
    if not callable(factory):
        raise ValueError(f"{kind!r} names no factory")
    return factory
