"""Check documents that come with the package."""

from __future__ import annotations

from importlib import resources

from plumbline.plans.document import Check, parse

NAMES = ("appointment-completed-no-invoice", "appointment-unknown-status", "invoice-line-duplicate", "invoice-negative-total", "patient-active-missing-nhi", "patient-no-recent-appointment")


def load(name: str) -> Check:
    return parse(resources.files(__name__).joinpath(f"{name}.yaml").read_text(encoding="utf-8"))
