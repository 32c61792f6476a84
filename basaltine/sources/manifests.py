"""Dependency manifests and lock files, read after their own specifications.

Requirement lines follow the grammar of dependency specifiers: a name, extras in brackets, version clauses, and behind
a semicolon an environment marker. A dependency counts if it is pinned: one clause, == or ===, without a wildcard. Lock
files name exact versions: a list of installed packages by folder, or a tree of dependencies. In a package file the
lowest version of a range stands for it.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

Ref = tuple[str, str]

REQUIREMENT = re.compile(
    r"""\s* (?P<name> [A-Za-z0-9] (?: [A-Za-z0-9._-]* [A-Za-z0-9] )? ) \s*
        (?: \[ [^\]]* \] )? \s* \(? \s*
        (?P<clauses> [^;@()]* ) \)? \s* (?: ; .* )? $""",
    re.VERBOSE,
)
EXACT = re.compile(r"={2,3}\s*(?P<version>[A-Za-z0-9.!+_-]+)")
RANGE_START = re.compile(r"\d[^\s|,]*")


def pinned(requirement: str) -> Ref | None:
    """The name and version of a requirement that allows one version only."""
    if (whole := REQUIREMENT.match(requirement)) is None:
        return None
    clauses = [c.strip() for c in whole["clauses"].split(",") if c.strip()]
    if len(clauses) != 1 or (exact := EXACT.fullmatch(clauses[0])) is None:
        return None
    return whole["name"], exact["version"]


def requirement_lines(text: str) -> Iterator[str]:
    """The logical lines of a requirements file: joined at a backslash, without comments, options and their values."""
    for line in text.replace("\\\r\n", " ").replace("\\\n", " ").splitlines():
        line = re.split(r"(?:^|\s)#", line, maxsplit=1)[0]
        line = re.split(r"\s--\w", line, maxsplit=1)[0].strip()
        if line and line[0] != "-":
            yield line


def from_requirements(text: str) -> Iterator[Ref]:
    yield from filter(None, map(pinned, requirement_lines(text)))


def from_project(text: str) -> Iterator[Ref]:
    project = tomllib.loads(text).get("project") or {}
    optional = project.get("optional-dependencies") or {}
    for group in [project.get("dependencies") or [], *optional.values()]:
        yield from filter(None, map(pinned, group))


def from_pip_lock(text: str) -> Iterator[Ref]:
    sections = json.loads(text)
    for section in ("default", "develop"):
        for name, entry in (sections.get(section) or {}).items():
            if isinstance(entry, dict) and (ref := pinned(f"{name}{entry.get('version') or ''}")):
                yield ref


def from_package(text: str) -> Iterator[Ref]:
    package = json.loads(text)
    for section in ("dependencies", "devDependencies"):
        for name, wanted in (package.get(section) or {}).items():
            bare = wanted.strip().lstrip("^~<>= ") if isinstance(wanted, str) else ""
            if start := RANGE_START.match(bare):
                yield name, start[0]


def from_package_lock(text: str) -> Iterator[Ref]:
    lock = json.loads(text)
    if isinstance(installed := lock.get("packages"), dict):
        for folder, entry in installed.items():
            name = folder.split("node_modules/")[-1]
            if name and isinstance(entry, dict) and entry.get("version"):
                yield entry.get("name") or name, entry["version"]
        return
    waiting = [lock]
    while waiting:
        for name, entry in (waiting.pop().get("dependencies") or {}).items():
            if isinstance(entry, dict):
                waiting.append(entry)
                if entry.get("version"):
                    yield name, entry["version"]


#: By the file's name in lower case: the ecosystem and the reader.
READERS: dict[str, tuple[str, Callable[[str], Iterator[Ref]]]] = {
    "requirements.txt": ("PyPI", from_requirements),
    "requirements-dev.txt": ("PyPI", from_requirements),
    "pyproject.toml": ("PyPI", from_project),
    "pipfile.lock": ("PyPI", from_pip_lock),
    "package.json": ("npm", from_package),
    "package-lock.json": ("npm", from_package_lock),
}


def references(name: str, text: str) -> list[tuple[str, str, str]]:
    """(package, version, ecosystem) of a manifest; none if its name is unknown or it can't be read."""
    if (known := READERS.get(name.lower())) is None:
        return []
    ecosystem, read = known
    try:
        return [(package, version, ecosystem) for package, version in read(text)]
    except (ValueError, AttributeError, TypeError):
        return []
