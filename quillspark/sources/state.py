"""State kept beside the tables: manifests, monitored sets, connector settings, generated documents, data-source descriptors.

These are small JSON files, one per project, written to a temporary name and renamed; unreadable ones are passed over.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.gateway import Descriptor
from quillspark.operators.store import MANIFEST


def file_key(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def _write(path: Path, value: dict) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_suffix(".tmp")
    tmp.write_text(json.dumps(value, ensure_ascii=False, sort_keys=True))
    os.replace(tmp, path)


def _read(path: Path) -> dict | None:
    try:
        v = json.loads(path.read_text())
        return v if isinstance(v, dict) else None
    except (OSError, ValueError):
        return None


def normalized_folder(folder: str) -> str:
    return folder.strip().replace("\\", "/").rstrip("/").lower()


class Manifests:
    """What was indexed of a folder for a project: path to (modified, length)."""

    def __init__(self, root: str):
        self.root = Path(root) / "manifests"

    def _path(self, folder: str, project: str) -> Path:
        return self.root / f"{file_key(normalized_folder(folder), project)}.json"

    def save(self, folder: str, project: str, files: dict[str, tuple[int, int]]) -> None:
        _write(self._path(folder, project), {"folder": normalized_folder(folder), "project": project, "files": {k: list(v) for k, v in files.items()}})

    def load(self, folder: str, project: str) -> dict[str, tuple[int, int]]:
        v = _read(self._path(folder, project))
        return {k: tuple(x) for k, x in (v or {}).get("files", {}).items()}

    def listed(self) -> list[dict]:
        """All readable manifests by project, then folder."""
        found = [v for p in sorted(self.root.glob("*.json")) if (v := _read(p)) and "project" in v and "folder" in v]
        return sorted(found, key=lambda v: (v["project"], v["folder"]))

    def delete(self, project: str) -> int:
        gone = [p for p in self.root.glob("*.json") if (_read(p) or {}).get("project") == project]
        for p in gone:
            p.unlink()
        return len(gone)

    def table(self, spark: SparkSession) -> DataFrame:
        """As rows: (project, folder, source_path, mtime, length)."""
        files = str(self.root / "*.json")
        if not list(self.root.glob("*.json")):
            return spark.createDataFrame([], MANIFEST)
        raw = spark.read.schema("project string, folder string, files map<string,array<bigint>>").option("multiLine", "true").option("mode", "PERMISSIVE").json(files)
        d = raw.filter("project IS NOT NULL").select("project", "folder", F.explode("files").alias("source_path", "v"))
        return d.select("project", "folder", "source_path", F.timestamp_micros(F.col("v")[0]).alias("mtime"), F.col("v")[1].alias("length")).orderBy("project", "folder", "source_path")


class Settings:
    """One JSON file per project: a monitored set (key to stamp or version) or a connector's settings."""

    def __init__(self, root: str, kind: str):
        self.root = Path(root) / kind

    def save(self, project: str, value: dict) -> None:
        _write(self.root / f"{file_key(project)}.json", {"project": project, "value": value})

    def load(self, project: str) -> dict:
        return (_read(self.root / f"{file_key(project)}.json") or {}).get("value", {})

    def remember(self, project: str, changed: dict) -> None:
        """Merges changed entries into the stored ones."""
        self.save(project, self.load(project) | changed)

    def listed(self) -> list[str]:
        return sorted(v["project"] for p in self.root.glob("*.json") if (v := _read(p)) and "project" in v)

    def delete(self, project: str) -> bool:
        p = self.root / f"{file_key(project)}.json"
        had = p.exists()
        p.unlink(missing_ok=True)
        return had


def slug(text: str, most: int = 80) -> str:
    return re.sub(r"[\W_]+", "-", text.lower()).lstrip("-")[:most].strip("-")


def save_document(root: str, title: str, markdown: str, project: str, author: str, at: datetime | None = None) -> tuple[str, bool]:
    """Writes a generated document with its title and where it came from; (path, whether it replaced one). A body that repeats the title as its heading loses it."""
    name = slug(title)
    if not name:
        raise ValueError("a title needs a letter or a digit")
    path = Path(root) / slug(project) / f"{name}.md"
    first, _, rest = markdown.strip().partition("\n")
    same = first.startswith("# ") and first[2:].strip().lower() == title.strip().lower()
    body = rest.lstrip() if same else markdown.strip()
    had = path.exists()
    path.parent.mkdir(parents=True, exist_ok=True)
    stamp = (at or datetime.now(timezone.utc)).strftime("%Y-%m-%d")
    path.write_text(f"# {title.strip()}\n\n> Generated document, saved by {author} on {stamp}. Verify against its sources.\n\n{body}\n")
    return str(path), had


def descriptors(folders: list[tuple[str, str]], pattern: str = "*.dbsource") -> list[tuple[str, str, Descriptor]]:
    """(project, path, descriptor) of the data-source descriptors below folders of (project, folder); the first of a path wins, by project and name."""
    found: dict[str, tuple[str, str, Descriptor]] = {}
    for project, folder in folders:
        for p in sorted(Path(folder).rglob(pattern)):
            if str(p) not in found:
                try:
                    found[str(p)] = (project, str(p), Descriptor.parse(p.read_text(), p.stem))
                except (OSError, ValueError):
                    continue
    return sorted(found.values(), key=lambda x: (x[0].lower(), x[2].name.lower()))


def resolve(found: list[tuple[str, str, Descriptor]], name: str) -> Descriptor | None:
    """By handle (project/name), else by name in any case."""
    low = name.lower()
    return next((d for p, _, d in found if f"{p}/{d.name}".lower() == low), None) or next((d for _, _, d in found if d.name.lower() == low), None)


def project_scope(requested: str | None, default: str | None = None) -> str | None:
    """The project to read: what is asked for, else the default; blank, ``*`` and ``all`` mean every one."""
    for p in (requested, default):
        if p and p.strip():
            return None if p.strip() == "*" or p.strip().lower() == "all" else p.strip()
    return None
