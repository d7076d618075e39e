"""Which of several artifacts a run reads, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .publishing import fs, store_of


def written_at(path: str) -> float | None:
    """When the newest data file of an artifact (a file or a folder) was written, in seconds; None where there is none.

    A folder that a job has not committed, without ``_SUCCESS``, is none.
    """
    store, root = store_of(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return info.mtime_ns / 1e9
    if info.type == fs.FileType.NotFound:
        return None
    files = store.get_file_info(fs.FileSelector(root, recursive=True))
    if not any(f.base_name == "_SUCCESS" for f in files):
        return None
    return max((f.mtime_ns / 1e9 for f in files if f.is_file and not f.base_name.startswith(("_", "."))), default=None)


def chosen(candidates: list[tuple[str, str]], off: set[str] = frozenset(), only: str | None = None, fresh: bool = True) -> tuple[str | None, list[tuple]]:
    """The name of the artifact to read, and (name, path, there, reason) of every candidate.

    ``candidates`` (name, path) go from the most refined to the rawest.  The first that is there is read, unless it is turned ``off`` or,
    with ``fresh``, a rawer one was written after it, as it then lacks what that has.  ``only`` asks for one whatever its age.
    """
    times = {name: written_at(path) for name, path in candidates}
    best, rows = None, []
    for k, (name, path) in enumerate(candidates):
        newer = [n for n, _ in candidates[k + 1 :] if times[n] is not None and n not in off and times[name] is not None and times[n] > times[name]]
        if times[name] is None:
            reason = "missing"
        elif name in off:
            reason = "off"
        elif only is not None and name != only:
            reason = "not asked for"
        elif best is not None:
            reason = f"{best} comes first"
        elif only is None and fresh and newer:
            reason = f"older than {newer[0]}"
        else:
            best, reason = name, "chosen"
        rows.append((name, path, times[name] is not None, reason))
    return best, rows


def explained(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``chosen``'s rows as a frame."""
    return spark.createDataFrame(rows, "name string, path string, there boolean, reason string")
