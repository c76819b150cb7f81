"""Which service and account an export belongs to, where archives are, and which inputs are the same."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zipfile
from pathlib import Path

from ..errors import ScopeError, SourceError
from .parsers import sniff
from .readers import digest_file, skipped

#: Fixed value: how deep folders are searched.
MAX_DEPTH = 8
#: The service of each kind of export.
SERVICES = {"assistant": "assistant", "mapping": "mapping-assistant", "messenger": "messenger", "activity": "social", "assigned": "microblog", "markdown": "markdown", "cards": "story-cards", "character": "characters", "session": "sessions", "index": "sessions"}


#: Kinds that know no account: the folder that is given names it.
NAMED_BY_FOLDER = ("markdown", "character", "cards", "session", "index", "mapping", "assigned")


def check_part(part: str) -> str:
    if not part or part in (".", "..") or "/" in part or "\\" in part or os.path.isabs(part):
        raise ScopeError(f"not a service or account: {part!r}")
    return part


def scoped_path(root: str, service: str, account: str) -> str:
    """The folder of an archive's tables."""
    return f"{root.rstrip('/')}/service={check_part(service)}/account={check_part(account)}"


#: The kind that a folder is taken for, if it holds files of several.
PRECEDENCE = ("assistant", "mapping", "activity", "assigned", "messenger", "session", "index", "markdown", "character", "cards")
#: Kinds that a home scan takes: exports, not the notes and settings that lie about.
EXPORTS = ("assistant", "mapping", "activity", "assigned", "messenger", "session", "index")


def discover(path: str, skips: tuple[str, ...] = ()) -> tuple[str, list[Path]]:
    """The kind of a file or folder, and its files of that kind with those that belong to them. Unknown shapes are an error."""
    root = Path(path)
    if not root.exists():
        raise SourceError(f"{path}: no such file or folder")
    if root.is_file():
        kind = kind_of(root)
        if kind is None or kind not in SERVICES:
            raise SourceError(f"{path}: not an export")
        if root.name == "result.json" and kind == "messenger":
            top = json.loads(root.read_text())
            if not isinstance(top, dict) or not {"messages", "chats", "left_chats"} & top.keys():
                raise SourceError(f"{path}: neither a chat nor an account's chats")
        return kind, [root]
    files = [(kind_of(p), p) for p in walk(root, skips)]
    kind = next((k for k in PRECEDENCE if any(k == own for own, _ in files)), None)
    if kind is None:
        raise SourceError(f"{path}: no known export")
    return kind, [p for own, p in files if own == kind or kind == "assistant" and own in ("auth", "billing")]


def discover_home(home: str, depth: int = MAX_DEPTH, skips: tuple[str, ...] = ()) -> list[str]:
    """Exports below a folder, sorted, each once: files of known shape; hidden folders are passed over."""
    found: set[str] = set()

    def scan(folder: Path, left: int) -> None:
        for p in sorted(folder.iterdir()):
            if p.is_symlink() or p.name.startswith(".") or skipped(str(p), skips):
                continue
            if p.is_dir():
                if left > 0:
                    scan(p, left - 1)
            elif p.suffix in (".json", ".js", ".jsonl", ".zip", ".sqlite", ".db") and (p.suffix != ".jsonl" or p.name == "chat_history.jsonl") and kind_of(p) in EXPORTS:
                found.add(str(p))

    scan(Path(home), depth)
    return sorted(found)


def by_scope(paths: list[str]) -> dict[tuple[str, str], list[str]]:
    """(service, account) -> its paths, sorted: one ingest for each."""
    out: dict[tuple[str, str], list[str]] = {}
    for p in sorted(paths):
        out.setdefault(infer_scope(p), []).append(p)
    return dict(sorted(out.items()))


def payload(path: str) -> tuple[str, str] | None:
    """(kind, digest) of what an export holds, the same for a zip and for its unpacked files; None if it is no export."""
    digests: list[tuple[str, str]] = []
    if zipfile.is_zipfile(path):
        kind = zip_kind(Path(path))
        with zipfile.ZipFile(path) as z:
            for info in z.infolist():
                if not info.is_dir() and not info.flag_bits & 1:
                    with z.open(info) as f:
                        if sniff(info.filename, f.read(65536)) == kind:
                            with z.open(info) as whole:
                                digests.append((info.filename.rsplit("/", 1)[-1], _digest(whole)))
    else:
        kind, files = discover(path)
        for p in files:
            with p.open("rb") as f:
                if kind_of(p) == kind:
                    digests.append((p.name, _digest(f)))
    return None if kind is None else (kind, hashlib.sha256("".join(d for _, d in sorted(digests)).encode()).hexdigest())


def _digest(f) -> str:
    h = hashlib.sha256()
    while block := f.read(1 << 20):
        h.update(block)
    return h.hexdigest()


def without_unpacked(paths: list[str]) -> list[str]:
    """Without a zip or folder that holds what an earlier one does, if one of the two is a zip: unpacked copies all stay."""
    if not any(zipfile.is_zipfile(p) for p in paths if os.path.isfile(p)):
        return paths
    seen: dict[tuple[str, str], bool] = {}
    out = []
    for p in paths:
        own, packed = payload(p), os.path.isfile(p) and zipfile.is_zipfile(p)
        if own is None or own not in seen or not (packed or seen[own]):
            out.append(p)
            if own is not None:
                seen[own] = seen.get(own, False) or packed
    return out


def walk(root: Path, more_skips: tuple[str, ...] = (), depth: int = MAX_DEPTH) -> list[Path]:
    """Files that a reader takes, sorted; links are not followed."""
    if root.is_file():
        return [root]
    out: list[Path] = []
    if depth >= 0 and root.is_dir() and not root.is_symlink():
        for p in sorted(root.iterdir()):
            if p.is_symlink() or skipped(str(p), more_skips):
                continue
            if p.is_dir():
                if p.name not in ("assets", "prod-mc-asset-server"):
                    out += walk(p, more_skips, depth - 1)
            elif kind_of(p):
                out.append(p)
    return out


def kind_of(path: Path) -> str | None:
    with path.open("rb") as f:
        head = f.read(65536)
    return zip_kind(path) if head[:4] == b"PK\x03\x04" else sniff(str(path), head)


def zip_kind(path: Path) -> str | None:
    """From the entries' names and beginnings; nothing is unpacked."""
    try:
        with zipfile.ZipFile(path) as z:
            for info in sorted(z.infolist(), key=lambda i: i.filename):
                if not info.is_dir() and not info.flag_bits & 1:
                    with z.open(info) as f:
                        kind = sniff(info.filename, f.read(65536))
                    if kind not in (None, "markdown"):
                        return kind
    except zipfile.BadZipFile as e:
        raise SourceError(f"{path}: {e}") from None
    return None


def _account(path: Path, kind: str) -> str:
    if kind == "assistant":
        for p in path.parent.glob("*auth*.json"):
            user = (json.loads(p.read_text()).get("user") or {}).get("xUsername")
            if user:
                return user
    if kind == "messenger":
        user = (json.loads(path.read_text()).get("personal_information") or {}).get("username")
        if user:
            return user.lstrip("@")
    if (m := re.search(r"(?:facebook|instagram)-([^-/]+)-", str(path))) is not None:
        if "@" in m[1]:
            raise ScopeError("an e-mail address isn't an account name")
        return m[1]
    return path.parent.name or os.environ.get("USER", "unknown")


def infer_scope(root: str) -> tuple[str, str]:
    """(service, account) of all exports below a path; it is an error if they differ in either."""
    found = {(SERVICES[k], _account(p, k)) for p in walk(Path(root)) if (k := kind_of(p)) in SERVICES}
    if len({SERVICES[k] for k in NAMED_BY_FOLDER} & {s for s, _ in found}) == 1 and len({s for s, _ in found}) == 1:
        found = {(s, Path(root).name if Path(root).is_dir() else a) for s, a in found}
    services = {s for s, _ in found}
    if len(services) != 1:
        raise ScopeError(f"{root}: " + ("no known export" if not services else "exports of several services: " + ", ".join(sorted(services))))
    accounts = sorted({a for _, a in found})
    if len(accounts) > 1:
        raise ScopeError(f"{root}: exports of several accounts: " + ", ".join(accounts))
    return services.pop(), accounts[0]


def without_copies(paths: list[str]) -> list[str]:
    """The first of files with the same size and content; only files of one size are hashed."""
    by_size: dict[int, list[str]] = {}
    for p in paths:
        by_size.setdefault(os.path.getsize(p), []).append(p)
    first: set[str] = set()
    out = []
    for p in paths:
        same = by_size[os.path.getsize(p)]
        if len(same) == 1 or (d := digest_file(p)) not in first:
            out.append(p)
            if len(same) > 1:
                first.add(d)
    return out
