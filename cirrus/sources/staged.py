"""Files that a job publishes as a whole: tasks write them into a hidden folder beside the target, and only the commit gives them their names.

A task that is killed, or that runs twice, leaves parts there that no message names; they go with the folder, when the job commits or aborts.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage


@dataclass
class Parts(WriterCommitMessage):
    """What a task has written: for each part its place and the name that it is to have."""

    names: list[tuple[str, str]] = field(default_factory=list)


class Stage:
    """A target folder and the job's hidden folder in it."""

    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def put(self, parts: Parts, name: str, data: bytes) -> None:
        """Writes a part under a name of its own; it is to be published under name."""
        system, top = self.system()
        system.create_dir(f"{top}/.{self.job}", recursive=True)
        at = f"{top}/.{self.job}/{uuid.uuid4().hex}"
        with system.open_output_stream(at) as out:
            out.write(data)
        parts.names.append((at, name))

    def publish(self, messages: list[WriterCommitMessage | None]) -> None:
        """Gives all parts their names. Two parts of one name are an error, and nothing is published."""
        named = [p for m in messages if m is not None for p in m.names]
        twice = [n for n, times in Counter(n for _, n in named).items() if times > 1]
        if twice:
            self.drop()
            raise ValueError(f"rows of one file came from several tasks: {sorted(twice)[:3]}")
        system, top = self.system()
        system.create_dir(top, recursive=True)
        for at, name in named:
            system.move(at, f"{top}/{name}")
        self.drop()

    def drop(self) -> None:
        system, top = self.system()
        if system.get_file_info(f"{top}/.{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/.{self.job}")
