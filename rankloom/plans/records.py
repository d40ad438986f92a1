"""What a run leaves behind or starts from, on the driver: baselines, gate reports, configurations, prompts, patches."""

from __future__ import annotations

import datetime
import json
import os
import subprocess
from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import caches, evaluation
from ..sources.readers import merged, read_json, write_index

# The fields of a patch that are kept, and how a check's status is shown.
PATCH_FIELDS = ("page", "line", "line_end", "old_text", "new_text", "target_rule_or_schedule", "item", "kind", "target_chunk_ids", "match_strategy", "source_text")
STATUS_SIGNS = {"pass": "✅", "improved": "✅ ⬆", "fail": "❌", "missing": "❌ missing", "new": "🆕"}


class Refused(ValueError):
    """A baseline is not written."""


def git_state(folder: str = ".") -> tuple[str, bool | None]:
    """(commit, dirty): $GIT_SHA if set (dirty unknown), else git's own word, else ("unknown", None)."""
    if sha := os.environ.get("GIT_SHA"):
        return sha, None
    ask = lambda *args: subprocess.run(["git", *args], cwd=folder, capture_output=True, text=True, check=True, timeout=5).stdout.strip()
    try:
        return ask("rev-parse", "HEAD"), bool(ask("status", "--porcelain"))
    except (OSError, subprocess.SubprocessError):
        return "unknown", None


def load_config(path: str, overrides: list[str] = (), section: str | None = None) -> dict:
    """A JSON configuration with override files merged over it in order; of these only `section`, if it is named."""
    parts = [read_json(path)]
    if parts[0] is None:
        raise FileNotFoundError(path)
    for o in overrides:
        found = read_json(o)
        if found is None:
            raise FileNotFoundError(o)
        parts.append(found.get(section, {}) if section else found)
    return merged(*parts)


def load_prompts(files: dict[str, str]) -> dict[str, Template | dict]:
    """Prompts by name: templates, and schemas (.json) as objects. A missing or broken file raises."""
    out: dict[str, Template | dict] = {}
    for name, path in files.items():
        with open(path, encoding="utf-8") as f:
            out[name] = json.loads(f.read()) if path.endswith(".json") else Template(f.read())
    return out


def check_sources(sources: list[str], excluded: list[str]) -> None:
    """Raises where a file that is excluded is a source."""
    if both := sorted(set(sources) & set(excluded)):
        raise ValueError(f"configured as excluded but listed as a source: {', '.join(both)}")


def patch_rows(patches: DataFrame) -> DataFrame:
    """The fields of patches that are written; those a table lacks are null."""
    return patches.select(*(F.col(c) if c in patches.columns else F.lit(None).cast("string").alias(c) for c in PATCH_FIELDS))


def build_index(chunks: DataFrame, embed, path: str, if_stale: bool = True, partition: str | None = "doc_type") -> bool:
    """Embed the chunks and write the vector table; with if_stale only if it is not current. Says whether it was written.

    embed: a function from chunks to (chunk_id, vector). The payload is the whole chunk with its date as a number.
    """
    spark = chunks.sparkSession
    if if_stale:
        try:
            if caches.index_is_current(spark.read.parquet(path), chunks).first()[0]:
                return False
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    from ..functions.dates import date_number

    payload = chunks.withColumn("text_hash", F.xxhash64("text"))
    if "in_force_date" in chunks.columns:
        payload = payload.withColumn("in_force_int", date_number(F.col("in_force_date")))
    write_index(embed(chunks).join(payload, "chunk_id"), path, partition if partition in chunks.columns else None)
    return True


def gate_comment(checks: DataFrame, limits: DataFrame, errors: int = 0, max_errors: int = 0, has_baseline: bool = True) -> str:
    """A gate report in Markdown: a title that says whether it passed, and a row a metric."""
    rows = checks.join(limits.select("metric", "max_drop", "tolerance"), "metric").orderBy("metric").collect()
    passed = errors <= max_errors and not any(r.failed for r in rows)
    title = "⚠️ Eval gate: no baseline yet (not enforced)" if not has_baseline else "✅ Eval gate passed" if passed else "❌ Eval gate failed"
    number = lambda v: "–" if v is None else f"{v:.3f}"
    change = lambda d: "–" if d is None else "0.000" if abs(d) < 5e-4 else f"{d:+.3f}"
    lines = [f"## {title}", "", "| Metric | Baseline | This run | Δ | Allowed drop (+noise) | |", "|---|---|---|---|---|---|"]
    lines += [f"| **{r.metric}** | {number(r.baseline)} | {number(r.current)} | {change(r.delta)} | {r.max_drop:g} (+{r.tolerance:g}) | {STATUS_SIGNS[r.status]} |" for r in rows]
    return "\n".join([*lines, f"| items with errors | – | {errors} | – | max {max_errors} | {'✅' if errors <= max_errors else '❌'} |"]) + "\n"


def write_baseline(results: DataFrame, paths: dict[str, str], limits: DataFrame, target: str, reason: str, author: str, errors: int = 0, allow_errors: bool = False, allow_regression: bool = False, dry_run: bool = False) -> str:
    """The gate report of a run; the run becomes the baseline (a JSON file) unless dry_run.

    results: one row with the run's JSON. Refused without a reason, with errored items, or below the current baseline,
    unless these are allowed.
    """
    if not reason.strip():
        raise Refused("a reason must be given")
    if errors and not allow_errors:
        raise Refused(f"{errors} items errored in this run")
    now = evaluation.snapshot(results, paths)
    old = read_json(target)
    spark = results.sparkSession
    before = spark.createDataFrame([(m, float(v)) for m, v in (old or {}).get("metrics", {}).items() if v is not None], "metric string, value double")
    checks = evaluation.gates(before, now, limits)
    comment = gate_comment(checks, limits, errors, has_baseline=old is not None)
    if old is not None and not allow_regression and not checks.where("failed").isEmpty():
        raise Refused("this run fails the gates against the current baseline")
    if not dry_run:
        record = {"schema_version": 1, "status": "recorded", "updated_at": datetime.datetime.now(datetime.UTC).isoformat(), "updated_by": author, "reason": reason.strip(), "commit": git_state()[0]}
        os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
        with open(target, "w", encoding="utf-8") as f:
            json.dump(record | {"metrics": {r.metric: r.value for r in now.collect()}}, f, indent=2, ensure_ascii=False)
            f.write("\n")
    return comment
