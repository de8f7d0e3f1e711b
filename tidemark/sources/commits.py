"""Committed changes of a stored table: numbered small files, each of which one job alone can create.

A job writes its data files first, under a name of its own; they count once a commit names them. The file of a commit is
written aside and then given its number by one atomic step that fails if the number is taken, so of two jobs that race for a
number one wins, and the other reads what it committed and tries the next. A job that dies before that has changed nothing.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Commits:
    """The commits of the table at ``root``, in its folder ``_commits``, on any file system that Spark's session reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = self._path(f"{self.root}/_commits")
        self.fs = self.folder.getFileSystem(self.conf)

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        found = [re.fullmatch(r"(\d{12})\.json", s.getPath().getName()) for s in self.fs.listStatus(self.folder)]
        return sorted(int(m[1]) for m in found if m)

    def read(self, after: int = 0) -> list[dict]:
        """The commits above a number, in order; each with its ``number``."""
        out = []
        for n in self.numbers():
            if n > after:
                stream = self.fs.open(self._path(f"{self.folder}/{n:012d}.json"))
                try:
                    out.append(json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"number": n})
                finally:
                    stream.close()
        return out

    def add(self, make: Callable[[list[dict]], dict | None]) -> dict | None:
        """Commit what ``make`` returns for the commits so far; nothing if it returns None. Where another job took the number
        meanwhile, ``make`` is asked again with that job's commit too."""
        while True:
            before = self.read()
            change = make(before)
            if change is None:
                return None
            number = before[-1]["number"] + 1 if before else 1
            if self._claim(number, json.dumps(change)):
                return change | {"number": number}

    def _claim(self, number: int, text: str) -> bool:
        """Create the commit's file whole, or not at all if it is there."""
        aside, final = self._path(f"{self.folder}/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/{number:012d}.json")
        out = self.fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                # a rename would replace the other's file here; a second link to a name that is taken fails
                try:
                    os.link(aside.toUri().getPath(), final.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(aside, final, options)
            except Py4JJavaError:
                if self.fs.exists(final):
                    return False
                raise
            return True
        finally:
            self.fs.delete(aside, False)

    def listed(self, path: str) -> list[str]:
        """Names in a folder of the table; none if it isn't there."""
        folder = self._path(path)
        return [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []

    def drop(self, path: str) -> None:
        """Remove a folder of the table, if it is there."""
        if not path.startswith(f"{self.root}/"):
            raise ValueError(f"{path} isn't of {self.root}")
        self.fs.delete(self._path(path), True)
