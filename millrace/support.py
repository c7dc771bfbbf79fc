"""Versions that are supported: windows of versions for each package, and what to do about one outside."""

from __future__ import annotations

from importlib import metadata

from millrace.functions.text import satisfies


class Unsupported(RuntimeError):
    """A package is missing or outside its window."""


def installed(package: str) -> str | None:
    """The version of a package; null if it isn't there."""
    try:
        return metadata.version(package)
    except metadata.PackageNotFoundError:
        return None


def outside(windows: dict[str, str], versions: dict[str, str | None] | None = None) -> dict[str, str]:
    """For every package outside its window, such as ">=4.0,<5", what is wrong and what to install."""
    found = {p: installed(p) for p in windows} if versions is None else versions
    hint = {p: f'install "{p}{w}"' for p, w in windows.items()}
    missing = {p: f"{p} is missing: {hint[p]}" for p in windows if found.get(p) is None}
    return missing | {p: f"{p} {found[p]} is outside {w}: {hint[p]}" for p, w in windows.items() if p not in missing and not satisfies(found[p], w)}


def require(windows: dict[str, str], versions: dict[str, str | None] | None = None) -> None:
    """An error that names every package outside its window."""
    if bad := outside(windows, versions):
        raise Unsupported("; ".join(bad[p] for p in sorted(bad)))
