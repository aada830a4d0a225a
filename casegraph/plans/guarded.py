"""Running rules so that one that fails at run time does not end the run.

All rules of a job are run together.  If the job fails, its rules are halved: a half that runs keeps its
stored findings, a half that fails is halved again, so one faulty rule is found in as many failing
jobs as its number has bits.  A failure that also happens without any rule is not a rule's fault and
ends the run as before.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from typing import TypeVar

from pyspark.errors import PySparkException
from py4j.protocol import Py4JError

log = logging.getLogger(__name__)

Item = TypeVar("Item")
Result = TypeVar("Result")


def first_line(error: BaseException) -> str:
    return next((x.strip() for x in str(error).splitlines() if x.strip()), type(error).__name__)


def surviving(
    items: Sequence[Item], attempt: Callable[[list[Item]], Result], probe: Callable[[], None]
) -> tuple[list[Result], list[tuple[Item, str]]]:
    """Results of the items that run, in as few attempts as halving allows, and the others with their errors.

    ``attempt`` runs some items and stores their result; ``probe`` raises if nothing can run at all.
    """
    probed = False

    def run(some: list[Item], known: BaseException | None) -> tuple[list[Result], list[tuple[Item, str]]]:
        nonlocal probed
        # A single item is blamed for its own error only: that of a larger job may have passed.
        if known is None or len(some) == 1:
            try:
                return [attempt(some)], []
            except (PySparkException, Py4JError, ArithmeticError, ValueError) as error:
                if not probed:
                    probe()
                    probed = True
                known = error
        if len(some) == 1:
            log.warning("%s left out: %s", some[0], first_line(known))
            return [], [(some[0], first_line(known))]
        half = len(some) // 2
        results, faults = run(some[:half], None)
        # If the first half runs, the fault is in the second, which need not be run whole.
        more, others = run(some[half:], None if faults else known)
        return results + more, faults + others

    return run(list(items), None) if items else ([], [])
