"""Publishing of staged folders that a crash of the driver can't tear.

An output is written whole into a staging folder beside its target.  A note beside the target, written in
one step, then says what is to happen.  From there everything can be done again: whoever finds the note
rolls forward to the new data, and what is done already is passed over.

Outputs that belong together share a group.  Their notes come first and count only once the
group's own note is there, so either all of them are published or none; without it, recovery removes what was
staged.  Two drivers that publish to one target at the same time aren't supported.

    staged   note   old data moved away   staged data in place   old data removed   note removed
       |------|--------------|----------------------|--------------------|---------------|
       old data stays        new data comes with the next recovery at the latest
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from tidemill.errors import PublishError
from tidemill.sources.base import SINKS, STAGED_KINDS, Folder


def _note(target: Folder) -> Folder:
    """Where a target's note lies."""
    return target.beside(f".{target.path.getName()}.commit")


def _save(file: Folder, value: dict) -> None:
    """The document is there whole or not at all."""
    draft = file.sibling()
    stream = draft.fs.create(draft.path, True)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    draft.rename(file)


def _load(file: Folder) -> dict:
    stream = file.fs.open(file.path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


class Publication:
    """Some staged outputs that are published together."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.outputs: list[tuple[Folder, Folder, str]] = []

    def add(self, staging: Folder, target: Folder, mode: str) -> None:
        """``staging`` holds all data that is to replace ``target`` or, in mode append, to join it."""
        self.outputs.append((staging, target, mode))

    def abandon(self) -> None:
        """Remove what was staged; targets stay as they were."""
        for staging, _, _ in self.outputs:
            staging.delete()

    def commit(self) -> None:
        """Publish all outputs; a failure before the last note leaves every target as it was."""
        if not self.outputs:
            return
        group = self.outputs[0][1].beside(f".{uuid.uuid4().hex}.group") if len(self.outputs) > 1 else None
        noted = []
        try:
            for staging, target, mode in self.outputs:
                recover(self.spark, target.path.toString())
                note = {"staging": staging.path.toString(), "old": target.sibling().path.toString(), "mode": mode, "group": group and group.path.toString()}
                noted.append(target)
                _save(_note(target), note)
            if group is not None:
                _save(group, {"targets": [t.path.toString() for _, t, _ in self.outputs]})
        except Exception:
            for target in noted:
                _note(target).delete()
            self.abandon()
            raise
        for _, target, _ in self.outputs:
            _roll_forward(self.spark, target)
        # all targets are new now; a note whose group is gone asks for nothing more
        if group is not None:
            group.delete()
        for _, target, _ in self.outputs:
            _note(target).delete()


def _roll_forward(spark: SparkSession, target: Folder) -> None:
    """What the target's note says, from wherever it was left; the note stays."""
    note = _load(_note(target))
    staging, old = Folder(spark, note["staging"]), Folder(spark, note["old"])
    if staging.exists():
        if note["mode"] == "append" and target.exists():
            staging.move_files(target)  # those that have moved are no longer there
            staging.delete()
            return
        if target.exists():
            if old.exists():
                raise PublishError(f"{target.path} was written while it was being published")
            target.rename(old)
        staging.rename(target)
    old.delete()


def recover(spark: SparkSession, path: str) -> bool:
    """Finish or undo what a crashed driver left at ``path``; whether there was anything.

    All targets of its group come along.
    """
    target = Folder(spark, path)
    note = _note(target)
    if not note.exists():
        return False
    found = _load(note)
    if not found["group"]:
        _roll_forward(spark, target)
        note.delete()
        return True
    group = Folder(spark, found["group"])
    if not group.exists():  # never committed, or all done
        Folder(spark, found["staging"]).delete()
        note.delete()
        return True
    targets = [Folder(spark, t) for t in _load(group)["targets"]]
    left = [t for t in targets if _note(t).exists()]
    for t in left:
        _roll_forward(spark, t)
    group.delete()
    for t in left:
        _note(t).delete()
    return True


def recover_all(spark: SparkSession, sinks: list[dict]) -> list[str]:
    """:func:`recover` for all sinks that stage their data; gives the paths where there was something."""
    paths = [s["path"] for s in sinks if SINKS.key(s.get("type", "")) in STAGED_KINDS and s.get("path")]
    return [p for p in dict.fromkeys(paths) if recover(spark, p)]
