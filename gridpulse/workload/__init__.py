"""Every operator bound to the test tables, with the equivalent SQL where SQL can say it."""

from gridpulse.workload.registry import QUERIES, SQL


def load() -> tuple[dict, dict]:
    from gridpulse.workload import (  # noqa: F401
        cleaning,
        documents,
        gold,
        joins,
        payloads,
        series,
        sources,
        stats,
    )

    return QUERIES, SQL


__all__ = ["load", "QUERIES", "SQL"]
