"""What a dump's folder is: its root, its extensions, and what stays in doubt."""

from __future__ import annotations

import os
import re
from collections import Counter
from dataclasses import dataclass, field

from stratalens.functions import kinds

HEAD_BYTES, MOST_FOLDERS, LEAST_KINDS = 256 << 10, 64, 2
_MANIFESTS = ("Configuration.xml", "ConfigDumpInfo.xml")
_NOISE = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", re.S)
_OPEN_NOISE = re.compile(r"<!--|<!\[CDATA\[|<\?")
_NAME = re.compile(r"[^\W\d]\w{0,127}")
_UNSEEN = re.compile("[ᅟᅠㅤﾠ]")

EXTENSION, NO_EXTENSION, ABSENT, UNDECIDED = "extension", "not_extension", "absent", "undecided"


def valid_extension_name(name: str) -> bool:
    """Letters, digits (not first) and underscores, at most 128, nothing unseen."""
    return _NAME.fullmatch(name) is not None and not _UNSEEN.search(name)


def classify(head: str, complete: bool) -> tuple[str, str]:
    """(verdict, name or reason of doubt) of the beginning of a Configuration.xml."""
    plain = _NOISE.sub(" ", head)
    if _OPEN_NOISE.search(plain):
        return UNDECIDED, "malformed" if complete else "truncated"
    if "<!" in plain:
        return UNDECIDED, "unscannable"
    found = re.search(r"<Properties>(.*?)</Properties>", plain, re.S)
    if not found:
        return (NO_EXTENSION, "") if complete else (UNDECIDED, "truncated")
    if "<ObjectBelonging>Adopted</ObjectBelonging>" not in found[1]:
        return NO_EXTENSION, ""
    name = re.search(r"<Name>(.*?)</Name>", found[1], re.S)
    return (EXTENSION, name[1]) if name and valid_extension_name(name[1]) else (UNDECIDED, "name_rejected")


def verdict(folder: str) -> tuple[str, str]:
    """The same of a folder; only its head is read."""
    path = os.path.join(folder, "Configuration.xml")
    if not os.path.lexists(path) or "Configuration.xml" not in os.listdir(folder):
        return ABSENT, ""
    if os.path.islink(path) or not os.path.isfile(path):
        return UNDECIDED, "not_regular"
    try:
        with open(path, "rb") as file:
            head = file.read(HEAD_BYTES + 1)
    except OSError:
        return UNDECIDED, "unreadable"
    return classify(head[:HEAD_BYTES].decode("utf-8", "replace"), len(head) <= HEAD_BYTES)


@dataclass
class Layout:
    """The dump's own extension name, extensions in its folders, and doubts (folder, reason)."""

    own: str | None = None
    children: dict[str, str] = field(default_factory=dict)
    doubts: list[tuple[str, str]] = field(default_factory=list)

    def summary(self) -> dict:
        """Counts of what was found, by reason of doubt."""
        return {"self_named": self.own is not None, "extensions": len(self.children), "folders": sorted(self.children)} | dict(Counter(reason for _, reason in self.doubts))


def detect(folder: str) -> Layout:
    """The layout of a dump. The folders of a whole configuration aren't looked into if it is an extension itself."""
    out = Layout()
    if not os.path.isdir(folder):
        return out
    kind, name = verdict(folder)
    if kind == EXTENSION:
        out.own = name
    elif kind == UNDECIDED:
        out.doubts.append(("", name))
    looked = 0
    for child in sorted(os.listdir(folder)):
        if not os.path.isdir(os.path.join(folder, child)) or out.own and (child in kinds.FOLDERS or child == "Ext"):
            continue
        if looked == MOST_FOLDERS:
            out.doubts.append(("", "scan_truncated"))
            break
        looked += 1
        kind, name = verdict(os.path.join(folder, child))
        if kind == EXTENSION:
            out.children[child] = name
        elif kind == UNDECIDED:
            out.doubts.append((child, name))
    return out


def _is_root(folder: str) -> bool:
    names = os.listdir(folder)
    return any(m in names and not os.path.isdir(os.path.join(folder, m)) for m in _MANIFESTS) or sum(n in kinds.FOLDERS and os.path.isdir(os.path.join(folder, n)) for n in names) >= LEAST_KINDS


def inspect_root(folder: str) -> dict:
    """Whether a folder is a dump's root and, if not, which of its first 64 folders are."""
    out = {"is_root": False, "is_symlink": os.path.islink(folder), "nested_roots": [], "truncated": False}
    if not os.path.isdir(folder):
        return out
    if _is_root(folder):
        return out | {"is_root": True}
    folders = sorted(n for n in os.listdir(folder) if os.path.isdir(os.path.join(folder, n)))
    for name in folders[:MOST_FOLDERS]:
        try:
            if _is_root(os.path.join(folder, name)):
                out["nested_roots"].append(name)
        except OSError:
            continue
    return out | {"truncated": len(folders) > MOST_FOLDERS}
