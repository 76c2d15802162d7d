"""All registered checks, in the order of the operator list."""

from __future__ import annotations

from quarryline.plans import (  # noqa: F401
    checks_answers,
    checks_intake,
    checks_parse,
    checks_retrieval,
    checks_store,
)
