"""Policies: presets, files that override them, validation and identity."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import glob_to_regex
from ..operators.roles import KINDS, POLICY_ROLES, Policy, RolePolicy

# The limits of the two sets of presets.
_STRICT = {
    "bytes": 32768, "lines": (499, 400, 350), "functions": (10, 5, 80, 30, 4), "clones": (5, 50), "blocks": (10, 100), "test_clones": (8, 80), "fixture_clones": (20, 200), "coverage": (True, 95.0), "mutation": (True, 85.0),
}
_BALANCED = {
    "bytes": 65536, "lines": (600, 500, 500), "functions": (15, 6, 120, 50, 6), "clones": (8, 80), "blocks": (15, 150), "test_clones": (12, 120), "fixture_clones": (30, 300), "coverage": (False, 80.0), "mutation": (False, 75.0),
}
PRESETS = ("strict-agent", "balanced", "legacy-migration", "custom")
ENGINES = ("file_budgets", "suppressions", "complexity", "invariants", "clones", "coverage", "mutation_report", "generated_freshness", "legacy_ratchet", "format_check", "lint", "tests", "typecheck")
_NEVER = ("vendor", "config", "documentation", "unknown")


def preset(name: str = "strict-agent") -> dict:
    """A preset as nested tables, as a file would write them; custom has no limits of its own."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}")
    base = {"gate": {"preset": name, "strict": name != "legacy-migration", "enforce_classified_sources": False}, "clones": {"enabled": True, "min_lines": 5, "min_tokens": 50}, "suppressions": True, "invariants": True}
    if name == "custom":
        return base | {"budgets": {"files": {"max_lines": {}}, "functions": {}}, "coverage": {"enabled": False}, "mutation": {"enabled": False}, "roles": {r: {} for r in POLICY_ROLES}, "legacy": {"ratchet": False}}
    v = _STRICT if name == "strict-agent" else _BALANCED
    rust, script, rest = v["lines"]
    names = ("max_cyclomatic", "max_parameters", "max_lines", "max_statements", "max_nesting_depth")
    on, line = v["coverage"]
    clone = lambda k: {"clone_min_lines": v[k][0], "clone_min_tokens": v[k][1]}
    return base | {
        "budgets": {"files": {"max_bytes": v["bytes"], "max_lines": {"rs": rust, **dict.fromkeys(("ts", "tsx", "js", "jsx"), script), "default": rest}}, "functions": dict(zip(names, v["functions"]))},
        "clones": {"enabled": True, "min_lines": v["clones"][0], "min_tokens": v["clones"][1]},
        "coverage": {"enabled": on, "min_line_percent": line, "min_function_percent": line, "min_branch_percent": line - 5},
        "mutation": {"enabled": v["mutation"][0], "min_score": v["mutation"][1]},
        "roles": {
            "source": {"severity": "error", "clone_block_min_lines": v["blocks"][0], "clone_block_min_tokens": v["blocks"][1], **clone("clones"), "mutation_target": True},
            "test": {"severity": "error", "file_size_severity": "warning", "function_size_severity": "warning", "clone_severity": "warning", **clone("test_clones"), "mutation_target": False},
            "generated": {"severity": "ignore", "clone_enabled": False, "mutation_target": False},
            "fixture": {"severity": "warning", **clone("fixture_clones"), "mutation_target": False},
            "migration": {"severity": "error", "clone_enabled": False, "mutation_target": False},
        },
        "legacy": {"ratchet": True, "reference_branch": "origin/main"} if name == "legacy-migration" else {"ratchet": False},
    }


def merged(base: dict, own: dict) -> dict:
    """The base with the keys that are given; tables merge, but an empty table clears, and lists replace."""
    out = dict(base)
    for k, v in own.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and v and isinstance(out.get(k), dict) else v
    return out


def _known(table: dict, shape: dict, where: str = "") -> None:
    for k, v in table.items():
        if k not in shape:
            raise ValueError(f"unknown field {where}{k}")
        if isinstance(shape[k], dict) and shape[k]:
            if not isinstance(v, dict):
                raise ValueError(f"{where}{k} must be a table")
            _known(v, shape[k], f"{where}{k}.")


_SHAPE = {
    "gate": {"preset": 0, "strict": 0, "enforce_classified_sources": 0, "name": 0}, "clones": {"enabled": 0, "min_lines": 0, "min_tokens": 0, "excludes": 0}, "suppressions": 0, "invariants": 0, "forbidden_tokens": 0, "rules": 0, "classification": 0,
    "budgets": {"files": {"max_bytes": 0, "max_lines": {}, "exclusions": 0}, "functions": dict.fromkeys(("max_cyclomatic", "max_parameters", "max_lines", "max_statements", "max_nesting_depth"), 0)},
    "coverage": dict.fromkeys(("enabled", "report", "min_line_percent", "min_function_percent", "min_branch_percent", "critical_paths"), 0), "mutation": dict.fromkeys(("enabled", "min_score", "reports"), 0),
    "roles": {r: dict.fromkeys(asdict(RolePolicy()), 0) for r in POLICY_ROLES}, "legacy": {"ratchet": 0, "reference_branch": 0}, "generated": {"enabled": 0, "freshness_command": 0, "timeout_secs": 0}, "commands": 0,
}


def validated(policy: dict) -> dict:
    """The policy, or an error that names the field which isn't valid."""
    _known(policy, _SHAPE)

    def positive(value, where: str) -> None:
        if value is not None and (not isinstance(value, int) or isinstance(value, bool) or value < 1):
            raise ValueError(f"{where} must be a positive whole number")

    files, functions = policy["budgets"]["files"], policy["budgets"]["functions"]
    positive(files.get("max_bytes"), "budgets.files.max_bytes")
    for ext, n in files.get("max_lines", {}).items():
        if ext.lower() == "go":
            raise ValueError(f"budgets.files.max_lines.{ext} is obsolete")
        positive(n, f"budgets.files.max_lines.{ext}")
    for k, n in functions.items():
        positive(n, f"budgets.functions.{k}")
    for k in ("min_lines", "min_tokens"):
        positive(policy["clones"].get(k), f"clones.{k}")
    for table, k in (("coverage", "min_line_percent"), ("coverage", "min_function_percent"), ("coverage", "min_branch_percent"), ("mutation", "min_score")):
        value = policy[table].get(k)
        if value is not None and not (isinstance(value, (int, float)) and 0 <= value <= 100):
            raise ValueError(f"{table}.{k} must be a percentage between 0 and 100")
    globs = [*files.get("exclusions", []), *policy["clones"].get("excludes", []), *(r["glob"] for r in policy.get("classification", []))]
    for g in globs:
        if not g.strip():
            raise ValueError("empty glob")
        glob_to_regex(g)
    seen = [r["glob"] for r in policy.get("classification", [])]
    if len(set(seen)) < len(seen):
        raise ValueError("two classification rules with one glob")
    for role, table in policy["roles"].items():
        for k, v in table.items():
            if k.endswith("severity") and v not in (None, "error", "warning", "ignore"):
                raise ValueError(f"roles.{role}.{k} must be error, warning or ignore")
            if k.startswith(("max_", "clone_min", "clone_block")):
                positive(v, f"roles.{role}.{k}")
        if role != "source" and table.get("mutation_target"):
            raise ValueError(f"roles.{role}.mutation_target: only source is mutated")
    if policy["legacy"].get("ratchet") and not (policy["legacy"].get("reference_branch") or "").strip():
        raise ValueError("legacy.reference_branch is required by the ratchet")
    for name, command in policy.get("commands", {}).items():
        if name.endswith("_files") and command.count("{files}") != 1:
            raise ValueError(f"commands.{name} must have {{files}} once")
    return policy


def load(text: str | None) -> dict:
    """A policy file over the preset that it names, strict without one."""
    own = tomllib.loads(text) if text else {}
    return validated(merged(preset(own.get("gate", {}).get("preset", "strict-agent")), own))


def locate(start: str, name: str) -> str | None:
    """The nearest file of that name from a folder upwards, up to the repository's root."""
    folder = Path(start).resolve()
    for place in (folder, *folder.parents):
        if (place / name).is_file():
            return str(place / name)
        if (place / ".git").exists():
            return None
    return None


def identity(policy: dict) -> str:
    """SHA-256 of the policy as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(policy, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def as_policy(policy: dict) -> Policy:
    """What the operators on roles need of a policy."""
    files, functions, clones = policy["budgets"]["files"], policy["budgets"]["functions"], policy["clones"]
    return Policy(
        strict=policy["gate"]["strict"], enforce_roles=policy["gate"].get("enforce_classified_sources", False), max_bytes=files.get("max_bytes"), max_lines=dict(files.get("max_lines", {})), max_cyclomatic=functions.get("max_cyclomatic"),
        max_parameters=functions.get("max_parameters"), max_function_lines=functions.get("max_lines"), max_statements=functions.get("max_statements"), max_nesting_depth=functions.get("max_nesting_depth"), clones=clones["enabled"],
        clone_min_lines=clones["min_lines"], clone_min_tokens=clones["min_tokens"], suppressions=policy["suppressions"], invariants=policy["invariants"], roles={r: RolePolicy(**t) for r, t in policy["roles"].items()},
    )


def engine_plan(spark: SparkSession, policy: dict, chosen: list[str] = (), commands: tuple[str, ...] = ()) -> DataFrame:
    """(id, enabled, selected, state, reason): one row for each of the thirteen engines of a run."""
    picked = lambda kind: not chosen or kind in chosen
    if bad := [c for c in chosen if c not in KINDS]:
        raise ValueError(f"unknown checks: {bad}")
    on = {
        "file_budgets": (True, "policy"), "suppressions": (policy["suppressions"], "policy"), "complexity": (True, "policy"), "invariants": (policy["invariants"], "policy"), "clones": (policy["clones"]["enabled"], "policy"),
        "coverage": (policy["coverage"]["enabled"], "policy"), "mutation_report": (policy["mutation"]["enabled"], "policy"), "generated_freshness": (policy.get("generated", {}).get("enabled", False), "policy"), "legacy_ratchet": (policy["legacy"]["ratchet"], "policy"),
        "format_check": ("format_check" in commands, "format"), "lint": ("lint" in commands, "lint"), "tests": ("test" in commands, "tests"), "typecheck": ("typecheck" in commands, "typecheck"),
    }
    rows = [(e, bool(on[e][0]), bool(on[e][0]) and picked(on[e][1]), "skipped" if on[e][0] else "disabled", None) for e in ENGINES]
    return spark.createDataFrame(rows, "id string, enabled boolean, selected boolean, state string, reason string")


def resolved(policy: dict, detected: dict[str, str], reports: dict[str, str] = {}) -> dict:  # noqa: B006
    """The policy with commands that it leaves open as they were detected, and engines switched on by reports that a run names."""
    out = merged(policy, {})
    out["commands"] = {**detected, **policy.get("commands", {})}
    for table, path in reports.items():
        out[table] = merged(out[table], {"enabled": True, **({"report": path} if table == "coverage" else {"reports": [path]})})
    return out


def detect(names: list[str], scripts: dict[str, str] = {}) -> tuple[str, dict[str, str]]:  # noqa: B006
    """Kind of project (rust, javascript, ambiguous, unknown) by the files at its root, and the commands that follow; nothing is run."""
    rust, js = "Cargo.toml" in names, "package.json" in names
    kind = "ambiguous" if rust and js else "rust" if rust else "javascript" if js else "unknown"
    if kind == "rust":
        return kind, {"format_check": "cargo fmt --check", "lint": "cargo clippy --all-targets -- -D warnings", "test": "cargo test"}
    if kind == "javascript":
        manager = next((m for lock, m in (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lock", "bun"), ("bun.lockb", "bun")) if lock in names), "npm")
        return kind, {to: f"{manager} run {s}" for to, s in (("format_check", "format:check"), ("lint", "lint"), ("test", "test"), ("typecheck", "typecheck")) if s in scripts}
    return kind, {}


def cargo_roots(manifest: str, files: list[str]) -> dict[str, int]:
    """Root files of a Rust package by the bits of what reaches them (1 production, 2 test): declared targets, and those that are found by their place unless that is switched off."""
    m = tomllib.loads(manifest)
    package, out = m.get("package", {}), {}

    def add(path: str, mask: int) -> None:
        if path in files:
            out[path] = out.get(path, 0) | mask

    for kind, default, mask in (("lib", "src/lib.rs", 1), ("bin", None, 1), ("example", None, 1), ("test", None, 2), ("bench", None, 2)):
        declared = m.get(kind, [])
        for t in [declared] if isinstance(declared, dict) else declared:
            if path := t.get("path", default):
                add(path, mask)
    if "path" not in m.get("lib", {}):
        add("src/lib.rs", 1)
    for folder, key, mask in (("src/bin", "autobins", 1), ("examples", "autoexamples", 1), ("tests", "autotests", 2), ("benches", "autobenches", 2)):
        if package.get(key, True):
            for f in files:
                rest = f.removeprefix(folder + "/") if f.startswith(folder + "/") else ""
                if rest.endswith(".rs") and ("/" not in rest or rest.count("/") == 1 and rest.endswith("/main.rs")):
                    add(f, mask)
    add("src/main.rs", 1)
    build = package.get("build", "build.rs")
    if isinstance(build, str):
        add(build, 1)
    return out
