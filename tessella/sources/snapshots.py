"""A data source for providers' records: from the live side, or from a snapshot where that fails.

As a table, filters on ``provider`` are pushed down: only the providers asked for become partitions.  As a stream, every
provider's recorded versions come in order; the offset counts them, so a query that starts again reads only newer ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition


class Provider:
    """What a provider has to offer: live records and a recorded snapshot."""

    def live(self) -> Iterable[dict]:
        raise NotImplementedError

    def snapshot(self) -> Iterable[dict]:
        raise NotImplementedError

    def versions(self) -> int:
        """How many snapshots are recorded."""
        return 1

    def version(self, k: int) -> Iterable[dict]:
        """The snapshot recorded as number ``k``."""
        return self.snapshot()

    def records(self, mode: str = "snapshot") -> list[dict]:
        """``live`` falls back to the snapshot on any error of reading; only objects count."""
        if mode == "live":
            try:
                return [r for r in self.live() if isinstance(r, dict)]
            except (OSError, ValueError):
                pass
        return [r for r in self.snapshot() if isinstance(r, dict)]


class FileProvider(Provider):
    """Snapshots as files of JSON lines in a folder, in the order of their names; it has no live side."""

    def __init__(self, folder: str):
        self.folder = folder

    def _files(self):
        store, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        # by the folder they are in, then by name: a writer's files of one version share a folder
        return store, sorted(f.path for f in found if f.is_file and f.base_name.endswith(".json"))

    def live(self):
        raise OSError("no live side")

    def versions(self) -> int:
        return len(self._files()[1])

    def version(self, k: int):
        store, files = self._files()
        with store.open_input_stream(files[k]) as lines:
            for line in lines.read().decode("utf-8").splitlines():
                if line.strip():
                    yield json.loads(line)

    def snapshot(self):
        for k in range(self.versions()):
            yield from self.version(k)


class ProviderSource(DataSource):
    """``spark.read.format("provider").option("ids", "a,b")``: one partition a provider.

    ``register(spark, providers)`` makes the providers known; rows are (provider, _ord, record as JSON).
    """

    providers: dict[str, Provider] = {}

    @classmethod
    def name(cls) -> str:
        return "provider"

    def schema(self) -> str:
        return "provider string, _ord int, record string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ProviderStream(resolve_ids(self.options.get("ids", ""), self.providers), self.providers)

    def reader(self, schema) -> DataSourceReader:
        return _ProviderReader(resolve_ids(self.options.get("ids", ""), self.providers), self.options.get("mode", "snapshot"), self.providers)


class _ProviderReader(DataSourceReader):
    def __init__(self, ids: list[str], mode: str, providers: dict[str, Provider]):
        self.ids, self.mode, self.providers = ids, mode, providers

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("provider",):
                wanted = set(f.value if isinstance(f, In) else [f.value])
                self.ids = [i for i in self.ids if i in wanted]
            else:
                yield f

    def partitions(self):
        return [InputPartition(i) for i in self.ids] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is not None:
            for k, record in enumerate(self.providers[partition.value].records(self.mode)):
                yield partition.value, k, json.dumps(record, sort_keys=True, ensure_ascii=False)


class _ProviderStream(DataSourceStreamReader):
    """Offsets are numbers of recorded versions by provider."""

    def __init__(self, ids: list[str], providers: dict[str, Provider]):
        self.ids, self.providers = ids, providers

    def initialOffset(self) -> dict:
        return {i: 0 for i in self.ids}

    def latestOffset(self) -> dict:
        return {i: self.providers[i].versions() for i in self.ids}

    def partitions(self, start: dict, end: dict):
        return [InputPartition((i, k)) for i in self.ids for k in range(start.get(i, 0), end.get(i, 0))]

    def read(self, partition):
        i, version = partition.value
        for k, record in enumerate(self.providers[i].version(version)):
            if isinstance(record, dict):
                yield i, k, json.dumps(record, sort_keys=True, ensure_ascii=False)

    def commit(self, end: dict) -> None:
        pass


def load_config(text: str) -> list[dict]:
    """Providers of a JSON list of objects with ``id``, ``folder`` and perhaps ``enabled``, by id.

    An unknown key, a missing or repeated id, and a value of another kind are errors.
    """
    kinds = {"id": str, "folder": str, "enabled": bool}
    found = json.loads(text)
    if not isinstance(found, list):
        raise ValueError("a list of providers is needed")
    for p in found:
        if not isinstance(p, dict) or "id" not in p or "folder" not in p:
            raise ValueError(f"a provider needs id and folder: {p!r}")
        for k, v in p.items():
            if k not in kinds:
                raise ValueError(f"{p['id']}: unknown key {k}")
            if not isinstance(v, kinds[k]):
                raise ValueError(f"{p['id']}: {k} must be a {kinds[k].__name__}")
    ids = [p["id"] for p in found]
    if again := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"repeated ids: {', '.join(again)}")
    return sorted(({"enabled": True} | p for p in found), key=lambda p: p["id"])


def configured(config: list[dict], wanted: str = "") -> dict[str, Provider]:
    """The providers of ``config`` asked for, or all enabled ones; an unknown or disabled id is an error."""
    enabled = {p["id"]: FileProvider(p["folder"]) for p in config if p["enabled"]}
    if off := [i.strip() for i in wanted.split(",") if i.strip() in {p["id"] for p in config} - set(enabled)]:
        raise ValueError(f"disabled providers: {', '.join(off)}")
    return {i: enabled[i] for i in resolve_ids(wanted, enabled)}


def resolve_ids(wanted: str, known: dict[str, Provider]) -> list[str]:
    """Ids in the order asked for, without repeats; an unknown one is an error; none means all, sorted."""
    ids = list(dict.fromkeys(i.strip() for i in wanted.split(",") if i.strip())) or sorted(known)
    if unknown := [i for i in ids if i not in known]:
        raise ValueError(f"unknown providers: {', '.join(unknown)}")
    return ids


def register(spark, providers: dict[str, Provider]) -> None:
    """Makes ``provider`` readable in this session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(type("RegisteredProviders", (ProviderSource,), {"providers": dict(providers)}))
