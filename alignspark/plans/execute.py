"""Carrying out planned schema changes on a stored table, with checks before and a report after."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field
from typing import TYPE_CHECKING

from .analyze import Change, batches, check_plan, summarise_plan
from .ddl import capabilities, change_sql
from .model import Issue, Policies

if TYPE_CHECKING:
    from ..sources.store import TableStore


@dataclass
class ExecutionReport:
    table: str
    dry_run: bool
    done: list[Change] = field(default_factory=list)
    refused: list[Issue] = field(default_factory=list)
    failed: list[tuple[Change, str]] = field(default_factory=list)
    sql: list[str] = field(default_factory=list)
    version: int | None = None
    seconds: float = 0.0

    @property
    def status(self) -> str:
        if self.refused or (self.failed and not self.done):
            return "FAILURE"
        if self.failed:
            return "PARTIAL"
        return "DRY_RUN" if self.dry_run else "SUCCESS"


def precheck(store: TableStore, table: str, changes: list[Change], policies: Policies) -> list[Issue]:
    """Unsafe, unsupported and pointless changes: columns that exist already, or do not exist."""
    from .model import IssueCode, Severity

    issues = check_plan(changes, policies)
    if not store.exists(table):
        return [*issues, Issue(IssueCode.DDL_EXECUTION_FAILED, Severity.ERROR, f"table {table} does not exist")]
    known = {c.lower() for c in store.columns(table)}
    for c in changes:
        there = (c.column or "").lower() in known
        if c.kind == "ADD_COLUMN" and there:
            issues.append(Issue(IssueCode.DDL_EXECUTION_FAILED, Severity.ERROR, "the column exists", c.column))
        if c.kind in ("DROP_COLUMN", "WIDEN_COLUMN", "ALTER_TYPE") and not there:
            issues.append(Issue(IssueCode.DDL_EXECUTION_FAILED, Severity.ERROR, "no such column", c.column))
    return issues


def statements(store: TableStore, table: str, changes: list[Change], dialect: str) -> list[str]:
    """The changes as SQL for a database, leaving out what it does not support."""
    can, spec = capabilities(dialect), store.spec(table)
    return [change_sql(c, spec, dialect) for c in changes if can.get(c.kind, False)]


def execute(store: TableStore, table: str, changes: list[Change], policies: Policies | None = None, dialect: str = "postgresql", log: str | None = None) -> ExecutionReport:
    """Apply the changes, a batch as one new version; a failed batch leaves the table as it was and ends the run."""
    policies = policies or Policies()
    began = time.perf_counter()
    report = ExecutionReport(table, policies.ddl.dry_run or not policies.ddl.enabled)
    report.refused = precheck(store, table, changes, policies)
    if not report.refused:
        report.sql = statements(store, table, [c for c in changes if c.kind != "DROP_INDEX"], dialect)
        for batch in [] if report.dry_run else batches(changes, policies):
            try:
                report.version = store.evolve(table, batch)
                report.done += batch
            except Exception as e:
                report.failed += [(c, str(e)[:300]) for c in batch]
                break
    report.seconds = round(time.perf_counter() - began, 3)
    if log:
        with open(log, "a", encoding="utf-8") as f:
            f.write(json.dumps({"table": table, "status": report.status, "plan": summarise_plan(changes), "changes": [asdict(c) for c in changes]}) + "\n")
    return report
