"""Does a path exist? Three-valued: true, false, or null where the trace can't tell."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, functions as F


def normal(path: str | None) -> str | None:
    return None if path is None else posixpath.normpath(path)


def normal_path(path: Column | str) -> Column:
    """normal() as a Column: empty parts and . go, .. takes the part before it away, and stays only at the front of a relative path."""
    path = F.col(path) if isinstance(path, str) else path
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    up = lambda held, x: F.when((x != "..") | (~rooted & ((F.size(held) == 0) | (F.try_element_at(held, F.lit(-1)) == ".."))), F.concat(held, F.array(x))).otherwise(F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0))))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")
    root = F.when(path.startswith("//") & ~path.startswith("///"), "//").when(rooted, "/").otherwise("")
    whole = F.concat(root, joined)
    return F.when(whole == "", ".").otherwise(whole)


def same_path(a: Column, b: Column) -> Column:
    """Of normalised paths: equal, or one ends in / and the other."""
    slash = F.lit("/")
    return (a == b) | a.endswith(F.concat(slash, b)) | b.endswith(F.concat(slash, a))


def in_workspace(path: Column, stored: Column, written: Column, opaque: Column) -> Column:
    """In a container whose work folder starts empty. stored and written are arrays of known paths; path is normalised and relative to the work folder where it can be."""
    known = path.isin(".", "file_storage") | F.array_contains(stored, path) | F.array_contains(written, path)
    return (
        F.when(known, True)
        .when(opaque | path.startswith("~"), None)
        .when(path == "/tmp", True)
        .when(path.startswith("/tmp/"), False)
        .when(path.startswith("/"), None)
        .otherwise(False)
    )


def relative_to_workspace(path: Column, root: str = "/workspace") -> Column:
    return F.when(path == root, ".").when(path.startswith(f"{root}/"), F.substring(path, len(root) + 2, 1 << 20)).otherwise(path)


def under_mounts(path: Column, binds: list[str]) -> Column:
    """Below a mounted folder nothing is known; a mounted folder and its parents exist; else it does not."""
    listed = F.array(*[F.lit(b.rstrip("/")) for b in binds])
    below = F.exists(listed, lambda b: path.startswith(F.concat(b, F.lit("/"))))
    above = F.exists(listed, lambda b: (b == path) | b.startswith(F.concat(path, F.when(path == "/", "").otherwise("/"))))
    return F.when(below, None).when(above, True).otherwise(False)


def in_lake(path: Column, root: str, real: Column, listing: Column, hidden: Column) -> Column:
    """Under `root`: the real files, null where a part is hidden; elsewhere the listing, if there is one."""
    return F.when(path.startswith(f"{root}/"), F.when(hidden, None).otherwise(F.array_contains(real, path))).when(listing.isNotNull(), F.array_contains(listing, path))
