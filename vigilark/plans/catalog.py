"""Imports every operator module, so that all queries are registered."""

from ..operators import advisories, artifacts, classify, context, evaluate, explain, guidance, inputs, issues, jobs, manifests, metrics, proposals, pyast, report, rules, taint  # noqa: F401
