"""Keep the failure of one item to itself."""

from __future__ import annotations

from collections.abc import Callable, Sequence


def isolated(solve: Callable[[list[int]], Sequence], n: int) -> tuple[list, list[str | None]]:
    """Results of ``solve`` for items 0 to n - 1, and a message for each item that fails.

    ``solve`` takes places and gives one result for each, in order. Should it fail, the places are halved until
    those at fault stand alone, so one bad item repeats some log2(n) halves and all others keep their results.
    """
    found: list = [None] * n
    errors: list[str | None] = [None] * n
    held = [list(range(n))] if n else []
    while held:
        places = held.pop()
        try:
            got = solve(places)
        except Exception as error:
            if len(places) == 1:
                errors[places[0]] = f"{type(error).__name__}: {error}"[:500]
            else:
                held += [places[: len(places) // 2], places[len(places) // 2 :]]
            continue
        for place, result in zip(places, got, strict=True):
            found[place] = result
    return found, errors
