"""Definitions: saved, versioned predicate specs, their store, quarantine and proposals."""

from __future__ import annotations

import difflib
import json
import os
import re
import time
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from termwright.model import LiftError, Model

#: Names, signals and bases.
NAME = re.compile(r"^[a-z][a-z0-9_]{1,63}$")
SIGNALS = ("rule", "percentile", "rank", "delta", "composite")
BASES = ("same_season", "prior_season")


@dataclass(frozen=True)
class Definition:
    name: str
    entity: str
    signal: str
    params: dict
    aliases: tuple[str, ...] = ()
    basis: str | None = None
    description: str = ""
    version: int = 1

    @staticmethod
    def of(raw: dict) -> Definition:
        extra = set(raw) - {"name", "entity", "signal", "params", "aliases", "basis", "description", "version"}
        if extra:
            raise ValueError(f"unknown fields: {', '.join(sorted(extra))}")
        d = Definition(**{**raw, "aliases": tuple(raw.get("aliases", ()))})
        if not NAME.match(d.name):
            raise ValueError(f"bad name {d.name!r}")
        if d.signal not in SIGNALS or d.basis not in (None, *BASES):
            raise ValueError(f"{d.name}: unknown signal or basis")
        return d


@dataclass
class Store:
    """Definitions of one model: in memory, or a folder of JSON files that is read again when it changes."""

    model: Model
    folder: Path | None = None
    known: dict[str, Definition] = field(default_factory=dict)
    broken: dict[str, str] = field(default_factory=dict)
    held: dict[str, Definition] = field(default_factory=dict)
    seen: float = 0.0

    def load(self) -> Store:
        """Read, register and validate to a fixed point; what does not hold is quarantined, never raised."""
        if self.folder:
            self.broken, self.known, self.held = {}, {}, {}
            for path in sorted(self.folder.glob("*.json")):
                try:
                    d = Definition.of(json.loads(path.read_text()))
                    if d.name != path.stem:
                        raise ValueError(f"the file is named {path.stem}")
                    self.known[d.name] = d
                except (ValueError, TypeError) as e:
                    self.broken[path.stem] = str(e)
            self.seen = self._stamp()
        return self.settle()

    def settle(self) -> Store:
        """Validate what is known, and once more what was held back: it may hold by now."""
        for name in self.held:
            self.broken.pop(name, None)
        self.known, self.held = {**self.held, **self.known}, {}
        changed = True
        while changed:
            changed = False
            for d in list(self.known.values()):
                problems = self.problems(d)
                if problems:
                    self.broken[d.name] = "; ".join(problems)
                    self.held[d.name] = self.known.pop(d.name)
                    changed = True
        return self

    def _stamp(self) -> float:
        return max([self.folder.stat().st_mtime, *(p.stat().st_mtime for p in self.folder.glob("*.json"))]) if self.folder and self.folder.exists() else 0.0

    def refresh(self) -> None:
        if self.folder and self._stamp() != self.seen:
            self.load()

    def problems(self, d: Definition) -> list[str]:
        from termwright.operators.signals import requires, validate

        try:
            return validate(self.model, self, d) or [f"unknown attribute {r}" for r in requires(self.model, self, d) if self.model.attribute(d.entity, r) is None]
        except (KeyError, LiftError, RecursionError) as e:
            return [str(e)]

    def get(self, name: str) -> Definition | None:
        if name in self.known:
            return self.known[name]
        return next((d for d in self.known.values() if name in d.aliases), None)

    def add(self, *definitions: dict) -> Store:
        for raw in definitions:
            d = Definition.of(raw)
            self.known[d.name] = d
        return self.settle()

    def save(self, raw: dict, overwrite: bool = False, copied_from: str | None = None) -> Definition:
        """Check and write a definition; an overwritten version goes to history."""
        if copied_from:
            source = self.get(copied_from)
            if source is None:
                raise ValueError(f"no definition {copied_from!r}")
            raw = {**{k: v for k, v in asdict(source).items() if k not in ("name", "version", "aliases")}, **raw}
        d, old = Definition.of(raw), self.known.get(raw["name"])
        taken = {n for k in self.known.values() if k.name != d.name for n in (k.name, *k.aliases)}
        if clash := taken & {d.name, *d.aliases}:
            raise ValueError(f"already in use: {', '.join(sorted(clash))}")
        if old and not overwrite:
            raise ValueError(f"{d.name} exists")
        d = replace(d, version=old.version + 1 if old else 1)
        if problems := self.problems(d):
            raise ValueError("; ".join(problems))
        self.known[d.name] = d
        if self.folder:
            self.folder.mkdir(parents=True, exist_ok=True)
            if old:
                self._archive(old)
            temporary = self.folder / f".{d.name}.tmp"
            temporary.write_text(json.dumps(asdict(d), indent=1, ensure_ascii=False))
            os.replace(temporary, self.folder / f"{d.name}.json")
        self.load()
        return d

    def _archive(self, d: Definition) -> None:
        past = self.folder / ".history"
        past.mkdir(exist_ok=True)
        (past / f"{d.name}.v{d.version}.{int(time.time() * 1000)}.json").write_text(json.dumps(asdict(d)))

    def delete(self, name: str) -> None:
        """By name or alias; what rests on it is quarantined."""
        d = self.get(name) or self.held.get(name)
        if d is None:
            raise ValueError(f"no definition {name!r}")
        self.known.pop(d.name, None), self.held.pop(d.name, None), self.broken.pop(d.name, None)
        if self.folder and (self.folder / f"{d.name}.json").exists():
            self._archive(d)
            (self.folder / f"{d.name}.json").unlink()
        self.load()

    def export(self) -> list[dict]:
        return [asdict(d) for d in sorted(self.known.values(), key=lambda d: d.name)]

    def take(self, rows: list[dict], overwrite: bool = False) -> dict[str, list]:
        """Import, dependencies first; reports what was added, skipped and failed."""
        report: dict[str, list] = {"added": [], "skipped": [], "failed": []}
        waiting = list(rows)
        while waiting:
            later, moved = [], False
            for raw in waiting:
                if raw["name"] in self.known and not overwrite:
                    report["skipped"].append(raw["name"])
                    moved = True
                    continue
                try:
                    self.save({k: v for k, v in raw.items() if k != "version"}, overwrite)
                    report["added"].append(raw["name"])
                    moved = True
                except ValueError as e:
                    later.append({**raw, "_why": str(e)} if "_why" not in raw else raw)
            waiting = [{k: v for k, v in r.items() if k != "_why"} for r in later] if moved else []
            if not moved:
                report["failed"] = [r["name"] for r in later]
        return report

    def used(self, name: str) -> list[Definition]:
        """A definition and all it rests on, dependencies first."""
        out: list[Definition] = []

        def walk(n: str) -> None:
            d = self.get(n)
            if d is None or d in out:
                return
            for t in d.params.get("terms", []) if d.signal == "composite" else []:
                walk(t)
            out.append(d)

        walk(name)
        return out

    def explain(self, name: str) -> dict:
        d = self.get(name)
        if d is None:
            return {"name": name, "missing": True}
        parts = [self.explain(t) for t in d.params.get("terms", [])] if d.signal == "composite" else []
        return {"name": d.name, "entity": d.entity, "basis": d.basis, "signal": d.signal, "params": d.params, "version": d.version, "parts": parts}

    def propose(self, term: str, entity: str | None = None) -> dict:
        """For a word without a definition: near names, related attributes, and percentile candidates."""
        words = [w for w in re.split(r"[^a-z0-9]+", term.lower()) if w]
        names = {n: d.name for d in self.known.values() for n in (d.name, *d.aliases)}
        near = sorted({names[n] for n in difflib.get_close_matches("_".join(words), list(names), n=5, cutoff=0.8)})
        related, candidates = [], []
        for e in self.model.entities.values():
            if entity and e.name != entity:
                continue
            for a in e.attributes.values():
                text = f"{a.name} {a.family} {a.description}".lower()
                if any(w in text for w in words):
                    related.append(f"{e.name}.{a.name}")
                    if a.type in ("int", "float") and e.name in self.model.based and len(candidates) < 3:
                        candidates.append({"name": "_".join(words) or "term", "entity": e.name, "signal": "percentile", "params": {"attr": a.name, "cohort": [e.season], "pctile": 90}})
        return {"term": term, "near": near, "related": related[:15], "candidates": candidates, "not_computable": not near and not related}
