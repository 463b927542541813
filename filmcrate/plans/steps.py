"""The steps a run is made of. Each can be taken, written to the log, read from it, and taken back."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass

from ..sources import files
from ..sources.files import Refused

#: What taking a step back came to.
RESTORED, NOTHING, BY_HAND = "restored", "nothing", "by hand"


@dataclass(frozen=True)
class Step:
    """Fields are what the log keeps. ``take`` gives the step as it is to be logged, or None if there was nothing to do."""

    kind = ""

    def take(self) -> Step | None:
        raise NotImplementedError

    def back(self) -> str:
        """Takes the step back; raises an OSError, or ``Refused`` with a reason, where that is not possible."""
        raise NotImplementedError

    @property
    def subject(self) -> str:
        """The path that messages about the step name."""
        return getattr(self, "src", "") or getattr(self, "path", "")

    def logged(self) -> dict:
        return {"op": self.kind, **{k: v for k, v in asdict(self).items() if v not in ("", None)}}


@dataclass(frozen=True)
class Move(Step):
    src: str
    dst: str
    manual_date: str = ""
    kind = "move"

    def take(self) -> Step:
        files.relocate(self.src, self.dst)
        return self

    def back(self) -> str:
        if not os.path.lexists(self.dst):
            raise Refused("missing", self.src)
        if self.src.lower() != self.dst.lower() and os.path.lexists(self.src):
            raise Refused("original_taken", self.src)
        os.makedirs(os.path.dirname(self.src), exist_ok=True)
        files.relocate(self.dst, self.src)
        return RESTORED


@dataclass(frozen=True)
class Written(Step):
    """A step that leaves a new file, known again by its size and time."""

    src: str
    dst: str
    size: int | None = None
    mtime_ns: int | None = None
    manual_date: str = ""

    def marked(self) -> Step:
        now = os.stat(self.dst)
        return type(self)(self.src, self.dst, now.st_size, now.st_mtime_ns, self.manual_date)

    def back(self) -> str:
        if not os.path.lexists(self.dst):
            return NOTHING
        if self.marked() != self:
            raise Refused("copy_changed", self.dst)
        files.remove(self.dst)
        return RESTORED


@dataclass(frozen=True)
class Copy(Written):
    kind = "copy"

    def take(self) -> Step:
        files.duplicate(self.src, self.dst)
        return self.marked()


@dataclass(frozen=True)
class Convert(Written):
    """``dst`` is made by the caller, as a part file."""

    kind = "convert"

    def take(self) -> Step:
        if os.path.lexists(self.dst):
            raise Refused("target_exists", self.dst)
        os.replace(f"{self.dst}.part", self.dst)
        return self.marked()


@dataclass(frozen=True)
class Trash(Step):
    src: str
    kind = "trash"

    def take(self) -> Step:
        try:
            from send2trash import send2trash
        except ImportError as exc:
            raise OSError("no recycle bin here") from exc
        send2trash(self.src)
        return self

    def back(self) -> str:
        return BY_HAND


@dataclass(frozen=True)
class MakeFolder(Step):
    path: str
    kind = "mkdir"

    def take(self) -> Step:
        os.mkdir(self.path)
        return self

    def back(self) -> str:
        files.remove_if_junk(self.path)
        return NOTHING


@dataclass(frozen=True)
class RemoveFolder(Step):
    path: str
    kind = "rmdir"

    def take(self) -> Step | None:
        return self if files.remove_if_junk(self.path) else None

    def back(self) -> str:
        os.makedirs(self.path, exist_ok=True)
        return NOTHING


KINDS = {c.kind: c for c in (Move, Copy, Convert, Trash, MakeFolder, RemoveFolder)}


def read(logged: dict) -> Step | None:
    """The step a log line tells of; None for a kind or fields that are not known."""
    kind = KINDS.get(logged.get("op", ""))
    if kind is None:
        return None
    try:
        return kind(**{k: v for k, v in logged.items() if k in kind.__dataclass_fields__})
    except TypeError:
        return None
