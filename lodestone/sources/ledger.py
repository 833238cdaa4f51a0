"""A journal of calls to a model: what was answered once is not asked again, by a later run, a repeated task or an equal prompt.

A call is known by the hash of its kind and prompt. Distinct calls that the journal lacks are dealt to groups by that hash;
a task that works on a group first reads what this run has already written for it and adds a file for every ``CALLS_A_FILE``
replies, written aside and renamed. So a task that is lost or repeated asks again at most what its last file would have held.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS_A_FILE = 16
SCHEMA = "call string, kind string, reply string"


def call_id(kind: str = "kind", prompt: str = "prompt"):
    """The hash of kind and prompt; the length of the kind keeps two pairs that read alike apart."""
    return F.sha2(F.concat(F.length(F.col(kind)).cast("string"), F.lit(":"), F.col(kind), F.col(prompt)), 256)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _written(files, folder: str) -> set[str]:
    """The calls in the whole files of one folder."""
    from pyarrow import fs

    out: set[str] = set()
    for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.base_name.endswith(".json"):
            with files.open_input_stream(info.path) as stream:
                out |= {json.loads(line)["call"] for line in stream.read().decode().splitlines()}
    return out


def _add(files, folder: str, rows: list[dict]) -> list[dict]:
    """A file that is there whole or not at all, and what is left to write, nothing; while it is written its name begins with a dot, which readers pass over."""
    if rows:
        name = uuid.uuid4().hex
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/.{name}") as stream:
            stream.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        files.move(f"{folder}/.{name}", f"{folder}/{name}.json")
    return []


class Ledger:
    """The journal at ``path``, a folder that driver and executors share; ``groups`` is how many tasks ask at once."""

    def __init__(self, spark: SparkSession, path: str, groups: int = 256):
        self.spark, self.path, self.groups = spark, path.rstrip("/"), groups

    def replies(self) -> DataFrame:
        """``call, kind, reply``: one reply a call, the smallest if tasks that ran twice have left several."""
        from pyarrow import fs

        files, root = _store(self.path)
        if files.get_file_info(root).type != fs.FileType.Directory:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(self.path)
        return rows.groupBy("call").agg(F.min_by(F.struct("kind", "reply"), "reply").alias("r")).select("call", "r.*")

    def ask(self, prompts: DataFrame, model: Callable[[str, str], str], retries: int = 3) -> DataFrame:
        """``prompts(kind, prompt, ...)`` with ``reply``; ``model(kind, prompt)`` is called once for each distinct pair that the journal lacks.

        A call that fails is tried ``retries`` times in all, then its task fails after what it has is written. A null kind or
        prompt is not asked and has a null reply. Columns ``call`` and ``reply`` of the prompts are replaced.
        """
        path, run = self.path, uuid.uuid4().hex[:12]

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            files, root = _store(path)
            group, known, new = None, set(), []
            try:
                for batch in batches:
                    for row in batch.itertuples(index=False):
                        if row.group != group:
                            new = _add(files, f"{root}/{run}/{group}", new)
                            group, known = row.group, _written(files, f"{root}/{run}/{row.group}")
                        if row.call not in known:
                            new.append({"call": row.call, "kind": row.kind, "reply": _tried(model, row.kind, row.prompt, retries)})
                        if len(new) >= CALLS_A_FILE:
                            new = _add(files, f"{root}/{run}/{group}", new)
                    yield pd.DataFrame({"seen": [len(batch)]})
            finally:
                _add(files, f"{root}/{run}/{group}", new)

        named = prompts.drop("call", "reply").withColumn("call", call_id())
        wanted = named.filter("call IS NOT NULL").groupBy("call").agg(F.first("kind").alias("kind"), F.first("prompt").alias("prompt"))
        missing = wanted.join(self.replies().select("call"), "call", "left_anti").withColumn("group", F.pmod(F.xxhash64("call"), F.lit(self.groups)))
        dealt = missing.repartition(self.groups, "group").sortWithinPartitions("group", "call")
        dealt.mapInPandas(work, "seen long").agg(F.sum("seen")).collect()  # one number
        return named.join(self.replies().select("call", "reply"), "call", "left").drop("call")


def _tried(model: Callable[[str, str], str], kind: str, prompt: str, retries: int) -> str:
    for _ in range(retries - 1):
        try:
            return model(kind, prompt)
        except Exception:  # noqa: BLE001, S112  whatever a service's client raises
            continue
    return model(kind, prompt)
