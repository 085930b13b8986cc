"""Recipes: reviewed lists of transforms, folded over an immutable source.

Proposing plans a step and its diff but runs nothing. Approving appends the
step and stores the frames it was given. Undo is a shorter fold; there are no snapshots.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.operators.diff import diff_examples, diff_summary
from tablewash.operators.transforms import Step, apply_op, frames_of, plan_step
from tablewash.plans.artifacts import ArtifactStore
from tablewash.plans.lineage import cut_lineage

STATUSES = ("pending", "approved", "rejected", "failed")

_PROPOSAL_SCHEMA = (
    "position int, id string, op string, params string, status string, summary string, rationale string,"
    " error string, human_note string, created_at timestamp, decided_at timestamp"
)
_LOG_SCHEMA = (
    "position int, id string, proposal_id string, op string, params string, summary string, applied_at timestamp"
)


def _now() -> datetime:
    return datetime.now(timezone.utc)


def params_json(params: dict[str, Any]) -> str:
    return json.dumps({k: "table" if isinstance(v, DataFrame) else v for k, v in params.items()}, ensure_ascii=False)


@dataclass
class Proposal:
    id: str
    op: str
    params: dict[str, Any]
    rationale: str | None
    step: Step
    created_at: datetime
    status: str = "pending"
    decided_at: datetime | None = None
    error: str | None = None
    note: str | None = None

    @property
    def summary(self) -> str:
        return self.step.summary

    def diff(self) -> DataFrame:
        return diff_summary(self.step)

    def examples(self) -> DataFrame:
        return diff_examples(self.step)


@dataclass(frozen=True)
class Applied:
    id: str
    proposal_id: str
    op: str
    params: dict[str, Any]
    summary: str
    applied_at: datetime


class Recipe:
    """The applied steps and the proposals about them, for one source frame."""

    def __init__(self, source: DataFrame, artifacts: str | None = None):
        self.source = source
        # Where the tables lie that steps were given, in the session's shared folder unless named.
        self._artifacts = artifacts
        self.steps: list[Applied] = []
        self.proposals: list[Proposal] = []
        # The table before each step and after the last: plans, not copies.
        self._versions = [source]

    @property
    def artifacts(self) -> ArtifactStore:
        return ArtifactStore(self.source.sparkSession, self._artifacts)

    @property
    def current(self) -> DataFrame:
        return self._versions[-1]

    def propose(self, op: str, params: dict[str, Any] | str | None = None, rationale: str | None = None) -> Proposal:
        """Stage a change. Bad input raises here and stages nothing."""
        if isinstance(params, str):
            params = json.loads(params)
        params = dict(params or {})
        step = plan_step(self.current, op, params)
        proposal = Proposal(f"prop_{len(self.proposals) + 1:03d}", op, params, rationale, step, _now())
        self.proposals.append(proposal)
        return proposal

    def _pending(self, proposal_id: str) -> Proposal:
        for p in self.proposals:
            if p.id == proposal_id:
                if p.status != "pending":
                    raise ValueError(f"Proposal {proposal_id} was already {p.status}.")
                return p
        raise ValueError(f'No proposal with id "{proposal_id}".')

    def approve(self, proposal_id: str) -> Proposal:
        """Apply to the table as it is now, which may differ from when staged."""
        p = self._pending(proposal_id)
        p.decided_at = _now()
        try:
            params = frames_of(self.current, p.op, p.params)
            if any(isinstance(v, DataFrame) for v in params.values()):
                p.params = self.artifacts.own(params)
            step = plan_step(self.current, p.op, p.params)
            # The lineage of ids made by a sort depends on the task layout.
            after = cut_lineage(step.result) if p.op == "sort_rows" else step.result
        except Exception as failure:
            p.status, p.error = "failed", str(failure)
            return p
        p.status, p.step = "approved", step
        self.steps.append(Applied(f"step_{len(self.steps) + 1:03d}", p.id, p.op, p.params, step.summary, p.decided_at))
        self._versions.append(after)
        return p

    def reject(self, proposal_id: str, note: str | None = None) -> Proposal:
        p = self._pending(proposal_id)
        p.status, p.note, p.decided_at = "rejected", note, _now()
        return p

    def apply(self, op: str, params: dict[str, Any] | str | None = None, rationale: str | None = None) -> Proposal:
        """Propose and approve in one go; what fails raises."""
        p = self.approve(self.propose(op, params, rationale).id)
        if p.status == "failed":
            raise ValueError(p.error)
        return p

    def undo(self) -> Applied:
        """Take back the last step. Decisions on proposals stay as they were."""
        if not self.steps:
            raise ValueError("No applied step is left to take back.")
        self._versions.pop()
        return self.steps.pop()

    def reset(self) -> None:
        self.steps.clear()
        self._versions = [self.source]

    def materialize(self) -> DataFrame:
        """Checkpoint the current table, for recipes grown long."""
        self._versions[-1] = cut_lineage(self.current)
        return self.current

    def list_proposals(self, status: str = "all", with_diff: bool = False) -> DataFrame:
        if status != "all" and status not in STATUSES:
            raise ValueError(f'Unknown status "{status}". Use all, {", ".join(STATUSES)}.')
        chosen = [p for p in self.proposals if status in ("all", p.status)]
        rows = [
            (
                i, p.id, p.op, params_json(p.params), p.status, p.summary, p.rationale, p.error, p.note,
                p.created_at, p.decided_at,
            )
            for i, p in enumerate(chosen)
        ]
        listed = self.source.sparkSession.createDataFrame(rows, _PROPOSAL_SCHEMA)
        if not with_diff or not chosen:
            return listed
        diffs = [p.diff().select(F.lit(p.id).alias("id"), F.struct("*").alias("diff")) for p in chosen]
        return listed.join(F.broadcast(reduce(DataFrame.unionByName, diffs)), "id")

    def change_log(self) -> DataFrame:
        rows = [
            (i, s.id, s.proposal_id, s.op, params_json(s.params), s.summary, s.applied_at)
            for i, s in enumerate(self.steps)
        ]
        return self.source.sparkSession.createDataFrame(rows, _LOG_SCHEMA)

    def specs(self) -> list[dict[str, Any]]:
        return [{"op": s.op, "params": s.params} for s in self.steps]

    def to_json(self) -> str:
        """The applied steps, to replay on another load."""
        specs = [{"op": s.op, "params": json.loads(params_json(s.params))} for s in self.steps]
        return json.dumps(specs, ensure_ascii=False)


def replay(source: DataFrame, specs: list[dict[str, Any]] | str) -> DataFrame:
    """Fold a list of steps over a frame into one plan."""
    if isinstance(specs, str):
        specs = json.loads(specs)

    def fold(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
        after = apply_op(df, spec["op"], spec.get("params"))
        return cut_lineage(after) if spec["op"] == "sort_rows" else after

    return reduce(fold, specs, source)
