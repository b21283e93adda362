"""Queries of general problems."""

from __future__ import annotations

from quire.operators import incremental

_STATE = """
  SELECT {key}, {state} FROM (
    SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {seen} DESC NULLS LAST, {ties}) AS rn
    FROM {source} WHERE {key} IS NOT NULL) WHERE rn = 1"""


def _p7_part(kind: str, listing: str, manifest: str, key: str, state: list[str]) -> str:
    ties = ", ".join(f"{c} DESC NULLS LAST" for c in state)
    now = _STATE.format(key=key, state=", ".join(state), seen="seen_at", ties=ties, source=listing)
    good = f"(SELECT m.* FROM {manifest} m WHERE m.run_id IN (SELECT run_id FROM index_runs WHERE status = 'success'))"
    then = _STATE.format(key=key, state=", ".join(state), seen="run_id", ties=ties, source=good)
    same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in state)
    return f"SELECT '{kind}' AS owner_kind, a.{key} AS owner_key FROM ({now}) a WHERE NOT EXISTS (SELECT 1 FROM ({then}) b WHERE a.{key} = b.{key} AND {same})"


QUERIES = {"p7_found": incremental.to_process}
SQL = {"p7_found": _p7_part("file", "file_listing", "manifest_files", "attachmentKey", ["mtime", "size"]) + " UNION ALL " + _p7_part("note", "notes", "manifest_notes", "noteKey", ["version"])}
