"""Find leaked credentials in large code and text corpora on Spark, and triage them."""

from keysieve.plans.scans import (
    scan_files,
    scan_history,
    scan_patches,
    scan_path,
    scan_pull_requests,
    scan_snapshot,
    scan_snapshot_delta,
    scan_staged,
    scan_user,
    scan_wiki,
)
from keysieve.session import build_session
from keysieve.sources.rules import DEFAULT_RULES, Rule
from keysieve.workspace import Workspace

__all__ = [
    "DEFAULT_RULES", "Rule", "Workspace", "build_session", "scan_files", "scan_history", "scan_patches",
    "scan_path", "scan_pull_requests", "scan_snapshot", "scan_snapshot_delta", "scan_staged", "scan_user",
    "scan_wiki",
]
