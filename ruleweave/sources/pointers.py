"""Numbered pointer files, each made once: what several writers of one folder agree on."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since this one read the current state."""


def _local(path: str) -> str | None:
    parts = urlsplit(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def resolved(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without takes that of the session's default file system."""
    store, place = _store(spark, path)
    return store.makeQualified(place).toString()


def create_once(spark: SparkSession, path: str, body: str) -> bool:
    """Make a file that nobody has made yet; False if it is there.

    A local or mounted path gets a hard link to a complete file, other stores their own creation
    without overwriting, which is exclusive in HDFS and in object stores with conditional writes.
    """
    path = resolved(spark, path)
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = f"{os.path.dirname(local)}/.draft-{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as file:
            file.write(body)
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    from py4j.protocol import Py4JJavaError

    store, place = _store(spark, path)
    try:
        stream = store.create(place, False)
    except Py4JJavaError:
        if store.exists(place):
            return False
        raise
    stream.write(bytearray(body.encode()))
    stream.close()
    return True


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of a folder's pointers, rising."""
    store, place = _store(spark, folder)
    if not store.exists(place):
        return []
    names = [entry.getPath().getName() for entry in store.listStatus(place)]
    return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())


def _read(spark: SparkSession, path: str) -> str:
    store, place = _store(spark, path)
    if not store.getFileStatus(place).getLen():
        return ""
    return "\n".join(row[0] for row in spark.read.text(path).collect())


def current(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """The highest pointer and what it says; one that a writer left unfinished counts as not there."""
    for number in reversed(numbers(spark, folder)):
        body = _read(spark, f"{folder}/{number:012d}.json")
        if body:
            return number, json.loads(body)
    return None


def commit(spark: SparkSession, folder: str, entry: Mapping, after: int | None = None) -> int:
    """Make the next pointer and return its number.

    With ``after``, the number that the writer started from, only the very next one will do: if it is
    taken, nothing is written and ``Conflict`` is raised. Without it the writer takes the first free one.
    """
    body = json.dumps(dict(entry), ensure_ascii=False)
    if after is not None:
        taken = numbers(spark, folder)
        last = taken[-1] if taken else 0
        open_ended = last > after and all(not _read(spark, f"{folder}/{n:012d}.json") for n in taken if n > after)
        number = last + 1 if open_ended else after + 1
        if (last > after and not open_ended) or not create_once(spark, f"{folder}/{number:012d}.json", body):
            raise Conflict(f"{folder} has moved on from {after}")
        return number
    while True:
        taken = numbers(spark, folder)
        number = taken[-1] + 1 if taken else 1
        if create_once(spark, f"{folder}/{number:012d}.json", body):
            return number
