"""All queries of the library by name, and SQL for them."""

from __future__ import annotations

from lapwing.plans import audits, catalogues, feeds, identities, leaderboards, matches, payloads, performances, queues, records, relations, runs


def together(parts: list[dict]) -> dict:
    """One dict of several; a name that two of them have is an error."""
    out: dict = {}
    for part in parts:
        if twice := sorted(out.keys() & part.keys()):
            raise ValueError(f"names given twice: {', '.join(twice)}")
        out |= part
    return out


MODULES = (audits, catalogues, feeds, identities, leaderboards, matches, payloads, performances, queues, records, relations, runs)
QUERIES = together([m.QUERIES for m in MODULES])
ORACLE_SQL = together([m.ORACLE_SQL for m in MODULES])
