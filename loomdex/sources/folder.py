"""Small files and folder management through Hadoop's file systems, so that they lie where Spark's tables lie."""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Folder:
    """A folder on any file system that Spark can write to; paths within it are relative."""

    def __init__(self, spark: SparkSession, base: str):
        self.base = base.rstrip("/")
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._java(self.base).getFileSystem(self._conf)
        self._local = self._fs.getUri().getScheme() == "file"

    def path(self, *parts: str) -> str:
        return "/".join((self.base, *parts))

    def _java(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._java(self.path(*parts)))

    def names(self, *parts: str) -> list[str]:
        """What lies directly in a folder; nothing if it isn't there."""
        at = self._java(self.path(*parts))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._java(self.path(*parts)), True)

    def read(self, *parts: str) -> str | None:
        """A small file's text; null if it can't be read."""
        try:
            stream = self._fs.open(self._java(self.path(*parts)))
            try:
                return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        except Exception:  # noqa: BLE001 - whatever the file system raises
            return None

    def _put(self, path, text: str) -> None:
        out = self._fs.create(path, False)
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()

    def write(self, text: str, *parts: str) -> None:
        """Write aside, then rename over what is there."""
        target = self.path(*parts)
        aside = self._java(f"{target}.{uuid.uuid4().hex}.tmp")
        self._put(aside, text)
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        over = self._gateway.new_array(options, 1)
        over[0] = options.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(aside, self._java(target), over)

    def create(self, text: str, *parts: str) -> bool:
        """Whether the file is new; one that is there stays as it is."""
        path = self._java(self.path(*parts))
        self._fs.mkdirs(path.getParent())
        if self._local:  # Hadoop's local file system looks before it creates, which isn't one step
            try:
                fd = os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600)
            except FileExistsError:
                return False
            with os.fdopen(fd, "w", encoding="utf-8") as f:
                f.write(text)
            return True
        if self._fs.exists(path):
            return False
        try:
            self._put(path, text)
        except Exception:  # noqa: BLE001
            if self._fs.exists(path):
                return False
            raise
        return True


def lock_file(folder: Folder, name: str, busy: type[Exception]):
    """One holder; a lock is taken over only from a dead process of the same host."""

    @contextmanager
    def held():
        own = {"pid": os.getpid(), "token": uuid.uuid4().hex, "host": socket.gethostname(), "at": time.time()}
        for attempt in range(2):
            if folder.create(json.dumps(own), name):
                break
            try:
                other = json.loads(folder.read(name) or "")
                dead = other["host"] == own["host"] and not os.path.exists(f"/proc/{int(other['pid'])}")
            except (ValueError, KeyError, TypeError):
                dead = False
            if attempt or not dead:
                raise busy(folder.path(name))
            folder.delete(name)
        try:
            yield
        finally:
            try:
                if json.loads(folder.read(name) or "").get("token") == own["token"]:
                    folder.delete(name)
            except ValueError:
                pass

    return held()
