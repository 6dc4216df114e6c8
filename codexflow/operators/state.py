"""Corrections, collections and saved groups, and their export.

State is small and edited by hand, so it is a JSON file that is replaced as a whole.  What an
analysis needs of it becomes a table (``frame``)."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FORMAT = 1


class StateError(ValueError):
    pass


@dataclass
class State:
    """Everything that users add to a library; keys of entities are (book, coref)."""

    meta: dict[str, dict] = field(default_factory=dict)  # of books: title, author, year, series
    tags: dict[str, list[str]] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)
    links: dict[str, list[str]] = field(default_factory=dict)  # linked unit: its entities
    rejected: list[list[str]] = field(default_factory=list)
    collections: dict[str, dict] = field(default_factory=dict)  # id: name, parent, books
    groups: dict[str, dict] = field(default_factory=dict)
    plurals: dict[str, list[str]] = field(default_factory=dict)
    pins: dict[str, str] = field(default_factory=dict)

    # ---- links

    def unit_of(self, key: str) -> str | None:
        return next((u for u, keys in self.links.items() if key in keys), None)

    def link(self, keys: list[str]) -> str:
        """Make the entities one unit; units that any of them belongs to are merged."""
        if len(set(keys)) < 2:
            raise StateError("two entities are needed for a link")
        merged = list(dict.fromkeys(k for key in keys for k in (self.links.pop(self.unit_of(key)) if self.unit_of(key) else [key])))
        name = f"p:{1 + max((int(u[2:]) for u in self.links), default=0)}"
        self.links[name] = merged
        return name

    def unlink(self, key: str) -> None:
        unit = self.unit_of(key)
        if unit:
            self.links[unit].remove(key)
            if len(self.links[unit]) < 2:
                del self.links[unit]

    def reject(self, a: str, b: str) -> None:
        pair = sorted((a, b))
        if pair not in self.rejected:
            self.rejected.append(pair)

    # ---- collections, a tree

    def collection(self, name: str, parent: str | None = None, books: tuple[str, ...] = ()) -> str:
        if parent is not None and parent not in self.collections:
            raise StateError(f"no collection {parent}")
        cid = f"c{1 + max((int(c[1:]) for c in self.collections), default=0)}"
        self.collections[cid] = {"name": name, "parent": parent, "books": list(books)}
        return cid

    def descendants(self, cid: str) -> list[str]:
        out = [cid]
        for at in out:
            out += [c for c, x in self.collections.items() if x["parent"] == at and c not in out]
        return out

    def move(self, cid: str, parent: str | None) -> None:
        if parent in self.descendants(cid):
            raise StateError("a collection cannot lie in itself")
        self.collections[cid]["parent"] = parent

    def books_in(self, cid: str, deep: bool = True) -> list[str]:
        return list(dict.fromkeys(b for c in (self.descendants(cid) if deep else [cid]) for b in self.collections[c]["books"]))

    def remove_collection(self, cid: str) -> None:
        for c in self.descendants(cid):
            del self.collections[c]

    # ---- export

    def of_books(self, books: set[str]) -> State:
        """The part that concerns some books."""
        book_of = lambda key: key.split(":", 1)[1].rpartition(":")[0]  # noqa: E731  e:<book>:<coref>
        kept = lambda keys: [k for k in keys if book_of(k) in books]
        part = lambda d: {k: v for k, v in d.items() if not k.startswith("e:") or book_of(k) in books}
        return State(
            meta={b: m for b, m in self.meta.items() if b in books}, tags=part(self.tags), names=part(self.names), notes=part(self.notes),
            links={u: kept(k) for u, k in self.links.items() if len(kept(k)) > 1}, rejected=[p for p in self.rejected if len(kept(p)) == 2],
            collections={c: x | {"books": [b for b in x["books"] if b in books]} for c, x in self.collections.items()},
            groups=self.groups, plurals={k: kept(v) for k, v in part(self.plurals).items()}, pins={b: p for b, p in self.pins.items() if b in books},
        )

    def frame(self, spark: SparkSession, kind: str) -> DataFrame:
        """links, tags, collections or plurals as rows (owner, member)."""
        pairs = {
            "links": [(u, k) for u, keys in self.links.items() for k in keys],
            "tags": [(k, t) for k, tags in self.tags.items() for t in tags],
            "collections": [(c, b) for c in self.collections for b in self.books_in(c)],
            "plurals": [(k, m) for k, members in self.plurals.items() for m in members],
        }
        if kind not in pairs:
            raise StateError(f"no such state {kind!r}")
        return spark.createDataFrame(pairs[kind], "owner string, member string")


def save(state: State, path: str | Path) -> None:
    """Replace the file in one step, so that a reader sees the old state or the new."""
    path = Path(path)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as out:
        json.dump({"format": FORMAT} | state.__dict__, out, ensure_ascii=False, indent=1)
        out.flush()
        os.fsync(out.fileno())
    os.replace(out.name, path)


def load(path: str | Path) -> State:
    path = Path(path)
    if not path.exists():
        return State()
    try:
        data = json.loads(path.read_text(encoding="utf-8"))
    except ValueError as e:
        raise StateError(f"{path} is damaged: {e}") from e
    if data.pop("format", None) != FORMAT:
        raise StateError(f"{path} has another format")
    return State(**{k: v for k, v in data.items() if k in State.__dataclass_fields__})


KINDS = (".tokens", ".entities", ".quotes", ".supersense", ".book", ".txt")


def export(state: State, books: dict[str, str], to: str | Path) -> None:
    """A zip of the books' files (book: folder), the state that concerns them, and a manifest."""
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
        files = []
        for book, folder in sorted(books.items()):
            for kind in KINDS:
                path = Path(folder) / f"{book}{kind}"
                if path.exists():
                    files.append(f"books/{Path(folder).name}/{path.name}")
                    out.write(path, files[-1])
        out.writestr("state.json", json.dumps({"format": FORMAT} | state.of_books(set(books)).__dict__, ensure_ascii=False))
        out.writestr("manifest.json", json.dumps({"format": FORMAT, "books": sorted(books), "files": files}))


def unpack(source: str | Path, to: str | Path) -> State:
    """Unpack an export after checking that it is complete and holds nothing else."""
    to = Path(to)
    with zipfile.ZipFile(source) as z:
        names = set(z.namelist())
        if not {"manifest.json", "state.json"} <= names:
            raise StateError("not an export")
        manifest = json.loads(z.read("manifest.json"))
        if manifest.get("format") != FORMAT or set(manifest["files"]) | {"manifest.json", "state.json"} != names:
            raise StateError("the export is incomplete or of another format")
        for name in manifest["files"]:
            parts = name.split("/")
            if len(parts) != 3 or parts[0] != "books" or ".." in parts or Path(name).suffix not in KINDS:
                raise StateError(f"unexpected file {name}")
        to.mkdir(parents=True, exist_ok=True)
        for name in manifest["files"]:
            target = to / name
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(z.read(name))
        (to / "state.json").write_bytes(z.read("state.json"))
    return load(to / "state.json")
