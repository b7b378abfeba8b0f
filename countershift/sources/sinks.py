"""Sets of small output files that appear together or not at all."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from countershift.errors import DecompositionError
from countershift.sources.files import files_of, joined


def _plain(name: str) -> str:
    if not name or os.path.basename(name) != name or name in (".", ".."):
        raise DecompositionError(f"{name!r} is not a plain file name")
    return name


def shared_folder(spark: SparkSession, name: str) -> tuple[str, Callable[[], None]]:
    """A new folder that all executors see, below ``spark.checkpoint.dir``, and a function that removes it. A local master does without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise DecompositionError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{root or 'file://' + tempfile.gettempdir()}/countershift/{name}-{uuid.uuid4().hex[:12]}"

    def remove() -> None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    return path, remove


def write_together(folder: str, managed: Iterable[str], writer: Callable[[str], None], required: Iterable[str]) -> list[str]:
    """Let ``writer`` fill a staging folder, check ``required``, move old managed files aside, move the new ones in.

    Managed files that the writer leaves out disappear; other files stay. On any
    failure the old files come back.
    """
    managed, required = [_plain(n) for n in managed], [_plain(n) for n in required]
    files = files_of(folder)
    if files.exists(folder) and not files.is_folder(folder):
        raise DecompositionError(f"{folder} is not a folder")
    files.make_folder(folder)
    mark = uuid.uuid4().hex[:12]
    stage, aside = (joined(folder, f".{k}-{mark}") for k in ("stage", "aside"))
    moved: list[str] = []
    added: list[str] = []
    local = tempfile.mkdtemp(prefix="countershift-out-")
    try:
        writer(local)
        made = sorted(os.listdir(local))
        lacking = set(required) - set(made)
        if lacking or set(made) - set(managed):
            raise DecompositionError(f"missing or unknown output files: {sorted(lacking | (set(made) - set(managed)))}")
        for place in (stage, aside):
            files.make_folder(place)
        for name in made:
            files.put(os.path.join(local, name), joined(stage, name))
        for name in managed:
            target = joined(folder, name)
            if files.is_folder(target):
                raise DecompositionError(f"{target} is a folder")
            if files.exists(target):
                files.move(target, joined(aside, name))
                moved.append(name)
        for name in made:
            files.move(joined(stage, name), joined(folder, name))
            added.append(name)
        return made
    except BaseException:
        for name in added:
            files.delete(joined(folder, name))
        for name in moved:
            files.move(joined(aside, name), joined(folder, name))
        raise
    finally:
        shutil.rmtree(local, ignore_errors=True)
        files.delete(stage)
        files.delete(aside)
