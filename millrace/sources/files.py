"""Small files and folders of the file system that a session shares, by Hadoop's interface; any scheme that Spark can read."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("no Spark session")
    return found


def at(path: str):
    """The file system of a path, and the path in it."""
    spark = session()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def folders(pattern: str) -> list[str]:
    """Folders whose names match, such as "/runs/step_*"."""
    fs, p = at(pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [] if s.isDirectory())


def exists(path: str) -> bool:
    fs, p = at(path)
    return fs.exists(p)


def read_text(path: str) -> str:
    """A small file as a whole."""
    row = session().read.text(path, wholetext=True).first()
    return row[0] if row else ""


def replace_text(path: str, text: str) -> None:
    """Write a small file under another name and put it in the place of the old one in one step: readers see either."""
    fs, p = at(path)
    jvm, gateway = session().sparkContext._jvm, session().sparkContext._gateway
    part = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    over = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(fs.makeQualified(part), fs.makeQualified(p), over)


def copy_whole(source: str, target: str, tries: int = 2) -> None:
    """Copy a file or folder under another name, compare its length, and rename it; a copy that is not as long is made once more, then it is an error. The source stays."""
    (there, s), (here, t) = at(source), at(target)
    jvm, conf = session().sparkContext._jvm, session().sparkContext._jsc.hadoopConfiguration()
    for _ in range(tries):
        part = jvm.org.apache.hadoop.fs.Path(f"{target}.part-{uuid.uuid4().hex}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(there, s, here, part, False, conf)
        if there.getContentSummary(s).getLength() == here.getContentSummary(part).getLength() and here.rename(part, t):
            return
        here.delete(part, True)
    raise OSError(f"{source} could not be copied whole")
