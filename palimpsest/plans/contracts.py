"""Strict JSON contracts (2.13): worklists, plans, receipts, manifests.

``from_json`` drops what it does not know and makes nulls of what has the wrong type.
A contract must refuse both, at any depth: texts are checked against the contract's
shape first, and the fault names the place. Faults are rows.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_IDENTITY = {"role": "string", "supplied_path": "string", "digest": {"algorithm": "string", "value": "string"}, "bytes": "bigint"}
_REVISION = {"revision_id": "bigint", "kind": "string", "author?": "string", "block_id?": "string", "excerpt?": "string"}
_OUTPUT = {"identity": _IDENTITY, "collision_policy": "string", "disposition": "string"}
_SELECTION = {"authors?": ["string"], "ids?": ["bigint"]}

#: The fields of each contract. A question mark marks one that may be absent or null, a list holds its
#: element's shape, "schema" is the name that the document must give.
CONTRACTS: dict[str, dict[str, Any]] = {
    "worklist": {
        "schema": "string", "author": "string", "input?": {"sha256": "string", "bytes": "bigint"},
        "changes": [{"id": "string", "old": "string", "new": "string", "expected_matches?": "bigint", "match_mode?": "string", "scope?": {"block_id?": "string", "from_block_id?": "string", "to_block_id?": "string"}}],
    },
    "resolution_plan": {"schema": "string", "accept?": _SELECTION, "reject?": _SELECTION, "rest?": "string"},
    "apply_receipt": {
        "schema": "string", "status": "string", "deliverable": "boolean", "emit_partial_requested?": "boolean", "input?": _IDENTITY, "worklist?": _IDENTITY, "output?": _OUTPUT,
        "summary": {"total": "bigint", "applied": "bigint", "refused": "bigint"}, "items?": [{"id": "string", "outcome": "string", "code?": "string", "matches?": "bigint"}],
    },
    "verify": {
        "schema": "string", "policy": "string", "status": "string", "before?": _IDENTITY, "after?": _IDENTITY,
        "summary": {"new_revisions": "bigint", "preexisting_revisions": "bigint", "modified_or_resolved_preexisting": "bigint", "direct_changes": "bigint", "untouched_violations": "bigint", "validator_ok": "boolean"},
        "direct_changes?": [{"story?": "string", "kind": "string", "block_id?": "string"}], "untouched?": {"verified_blocks": "bigint", "violations": [{"story?": "string", "kind": "string", "detail?": "string"}]},
        "validator?": {"ok": "boolean", "issues": [{"code": "string", "message?": "string", "context?": "string"}]},
    },
    "inspect": {"schema": "string", "input": _IDENTITY, "block_count": "bigint", "pending_revision_count": "bigint", "projection": "string"},
    "read": {"schema": "string", "input?": _IDENTITY, "blocks": [{"block_id": "string", "role?": "string", "text": "string", "guard?": "string"}]},
    "validate": {"schema": "string", "status": "string", "input?": _IDENTITY, "block_count?": "bigint", "pending_revision_count?": "bigint", "issues": [{"code": "string", "message?": "string", "context?": "string"}]},
    "compare_receipt": {"schema": "string", "base": _IDENTITY, "target": _IDENTITY, "author?": "string", "output?": _OUTPUT, "revisions": [_REVISION]},
    "resolve_receipt": {"schema": "string", "input": _IDENTITY, "dry_run": "boolean", "accepted": [_REVISION], "rejected": [_REVISION], "remaining": [_REVISION], "output?": _OUTPUT},
    "task_manifest": {
        "schema": "string", "task_id": "string", "status": "string", "producer": {"name": "string", "version": "string", "build": "string"}, "inputs": [{"path": "string", "sha256?": "string", "bytes?": "bigint"}],
        "targets": [{"path": "string", "output?": {"sha256": "string", "bytes": "bigint"}, "effects": [{"effect_id": "string", "status": "string", "revision_ids?": ["bigint"]}]}],
    },
}


def type_of(shape: Any) -> str:
    """A shape as a Spark type."""
    if isinstance(shape, str):
        return shape
    if isinstance(shape, list):
        return f"array<{type_of(shape[0])}>"
    return "struct<" + ",".join(f"{k.rstrip('?')}:{type_of(v)}" for k, v in shape.items()) + ">"


def schema_of(contract: str) -> str:
    return ", ".join(f"{k.rstrip('?')} {type_of(v)}" for k, v in CONTRACTS[contract].items())


def _once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("repeated key")
    return found


def fault_in(value: Any, shape: Any, at: str = "") -> str | None:
    """The first fault of a decoded value: wrong_type, unknown_field or missing_field, with its place."""
    if isinstance(shape, str):
        kinds = {"string": str, "bigint": int, "boolean": bool}[shape]
        good = isinstance(value, kinds) and (shape != "bigint" or not isinstance(value, bool) and abs(value) < 1 << 63)
        return None if good else f"wrong_type:{at}"
    if isinstance(shape, list):
        if not isinstance(value, list):
            return f"wrong_type:{at}"
        return next((f for n, x in enumerate(value) if (f := fault_in(x, shape[0], f"{at}[{n}]"))), None)
    if not isinstance(value, dict):
        return f"wrong_type:{at}"
    known = {k.rstrip("?"): (k.endswith("?"), v) for k, v in shape.items()}
    dot = f"{at}." if at else ""
    for k in value:
        if k not in known:
            return f"unknown_field:{dot}{k}"
    for k, (optional, inner) in known.items():
        if value.get(k) is None:
            if not optional:
                return f"missing_field:{dot}{k}"
        elif f := fault_in(value[k], inner, f"{dot}{k}"):
            return f
    return None


def fault_of(text: str | None, contract: str) -> str | None:
    """malformed, or what :func:`fault_in` finds."""
    try:
        value = json.loads(text or "", object_pairs_hook=_once)
    except (ValueError, RecursionError):
        return "malformed"
    return fault_in(value, CONTRACTS[contract])


def decoded(df: DataFrame, column: str, contract: str) -> DataFrame:
    """``df`` with ``value`` (the decoded object) and ``fault``; a faulty text has no value."""

    @F.pandas_udf("string")
    def check(texts: pd.Series) -> pd.Series:
        return pd.Series([fault_of(t, contract) for t in texts], dtype=object)

    value = F.from_json(column, schema_of(contract), {"mode": "PERMISSIVE"})
    checked = df.withColumn("fault", check(F.col(column)))
    return checked.withColumn("value", F.when(F.col("fault").isNull(), value))


def manifest_fault(text: str) -> str | None:
    """V9: what a manifest's parts must agree on: paths and effect ids of their own, targets, and a status that is true."""
    if fault := fault_of(text, "task_manifest"):
        return fault
    value = json.loads(text)
    targets = value["targets"]
    paths = [x["path"] for x in value["inputs"] + targets]
    effects = [e for t in targets for e in t["effects"]]
    if not targets:
        return "no_targets"
    if len(set(paths)) < len(paths):
        return "duplicate_path"
    if len({e["effect_id"] for e in effects}) < len(effects):
        return "duplicate_effect"
    complete = all(e["status"] == "satisfied" for e in effects) and all(t.get("output") for t in targets)
    if value["status"] not in ("complete", "partial"):
        return "wrong_type:status"
    return None if complete == (value["status"] == "complete") else "false_complete" if not complete else "false_partial"


def encoded(value: Column) -> Column:
    """The object as JSON without white space, absent fields left out."""
    return F.to_json(value, {"ignoreNullFields": "true"})


def canonical(value: Any) -> str:
    """JSON with sorted keys and no white space, as digests are taken of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
