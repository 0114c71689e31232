"""Versioned tables: immutable Parquet files and a log of numbered manifests.

A commit creates the next manifest exclusively; whoever comes second re-checks its reads and
writes against the manifests in between and either goes on upon them or fails.  Readers
pin a manifest, so files it names stay readable until ``vacuum``.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from dataclasses import asdict, dataclass, field


class StoreError(RuntimeError):
    pass


class ConflictError(StoreError):
    """Another commit changed what this transaction read or wrote."""


@dataclass
class TableSpec:
    name: str
    columns: list[tuple[str, str]]
    key: list[str]
    indexes: list[list[str]] = field(default_factory=list)  # the first is the key
    ids: list[int] = field(default_factory=list)

    def checked(self) -> "TableSpec":
        names = [c for c, _ in self.columns]
        if not self.name or self.name.startswith("@"):
            raise StoreError("a table needs a name that doesn't start with @")
        if not names or len(set(names)) != len(names) or "" in names:
            raise StoreError("column names must be unique and not empty")
        if any(t not in ("string", "bigint") for _, t in self.columns):
            raise StoreError("columns are strings or integers")
        if not self.key or len(set(self.key)) != len(self.key) or any(k not in names for k in self.key):
            raise StoreError("a primary key of known columns is needed")
        for index in self.indexes:
            if not index or len(set(index)) != len(index) or any(c not in names for c in index):
                raise StoreError("an index needs known columns, each once")
        kinds = dict(self.columns)
        self.columns = [(k, kinds[k]) for k in self.key] + [(c, t) for c, t in self.columns if c not in self.key]
        self.indexes = [self.key, *(i for i in self.indexes if i != self.key)]
        return self


@dataclass
class Manifest:
    version: int
    next_id: int
    tables: dict[str, dict]  # name -> {spec, files, rows}
    wrote: list[dict] = field(default_factory=list)  # {table, keys, all}


class Store:
    """The log of one root folder."""

    #: Called with the stage's name around a publish; tests make it fail.
    hook = staticmethod(lambda stage: None)

    def __init__(self, root: str, read_only: bool = False):
        self.root, self.read_only = root, read_only
        if not read_only:
            os.makedirs(f"{root}/log", exist_ok=True)
            os.makedirs(f"{root}/data", exist_ok=True)
            if self.latest() is None:
                self.publish(Manifest(0, 3, {}))
        elif self.latest() is None:
            raise StoreError(f"no store at {root}")

    def versions(self) -> list[int]:
        folder = f"{self.root}/log"
        return sorted(int(f[:-5]) for f in os.listdir(folder) if f.endswith(".json")) if os.path.isdir(folder) else []

    def latest(self) -> int | None:
        return (self.versions() or [None])[-1]

    def load(self, version: int) -> Manifest:
        with open(f"{self.root}/log/{version:012d}.json") as f:
            return Manifest(**json.load(f))

    def publish(self, manifest: Manifest) -> bool:
        """Create the manifest's file; False if its number is taken."""
        if self.read_only:
            raise StoreError("the store is read-only")
        self.hook("before")
        draft = f"{self.root}/log/{uuid.uuid4().hex}.draft"
        with open(draft, "w") as f:
            json.dump(asdict(manifest), f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, f"{self.root}/log/{manifest.version:012d}.json")  # atomic, and fails if it exists
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        self.hook("after")
        return True

    def new_file(self) -> str:
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def backup(self, target: str) -> None:
        """A consistent copy of the newest version at a new path."""
        if os.path.exists(target):
            raise StoreError(f"{target} exists")
        now = self.load(self.latest())
        os.makedirs(f"{target}/log")
        os.makedirs(f"{target}/data")
        for table in now.tables.values():
            table["files"] = [shutil.copytree(f, f"{target}/data/{os.path.basename(f)}") for f in table["files"]]
        Store(target).publish(Manifest(now.version + 1, now.next_id, now.tables))

    def vacuum(self, keep: int = 1, age: float = 7 * 86_400) -> int:
        """Delete data that none of the newest ``keep`` versions names, and older manifests; returns how many folders went.

        Whatever is younger than ``age`` seconds stays: an open transaction has written files that no manifest
        names yet, and still reads the files and manifests of the version at which it began.
        """
        if keep < 1:
            raise StoreError("at least one version stays")
        limit = time.time() - age
        young = lambda path: os.path.getmtime(path) > limit
        versions = self.versions()
        # a version was current until its successor came, so it is as young as that one
        kept = {v for k, v in enumerate(versions) if k >= len(versions) - keep or young(f"{self.root}/log/{versions[k + 1]:012d}.json")}
        held = {os.path.basename(f) for v in kept for t in self.load(v).tables.values() for f in t["files"]}
        gone = [d for d in os.listdir(f"{self.root}/data") if d not in held and not young(f"{self.root}/data/{d}")]
        for d in gone:
            shutil.rmtree(f"{self.root}/data/{d}")
        for v in versions:
            if v not in kept:
                os.unlink(f"{self.root}/log/{v:012d}.json")
        return len(gone)

    def stats(self) -> dict:
        now = self.load(self.latest())
        size = sum(os.path.getsize(os.path.join(d, f)) for t in now.tables.values() for path in t["files"] for d, _, fs in os.walk(path) for f in fs)
        return {"version": now.version, "tables": len(now.tables), "rows": sum(t["rows"] for t in now.tables.values()), "bytes": size}
