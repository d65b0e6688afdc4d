"""Column functions on paths and repository urls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: paths that hold tests, samples, docs and generated files.
FALSE_POSITIVE_PATH = (
    r"(con)?test|example|sample|demo^(cra)?^(graph)?|package-lock|"
    r"makefile|gruntfile|node_modules|site-packages|\.md$|css$|\.rst$")


def is_false_positive_path(file_name: Column) -> Column:
    return F.lower(file_name).rlike(FALSE_POSITIVE_PATH)


def glob_pattern(glob: str) -> str:
    """A shell glob as a Java pattern; ``*`` also crosses ``/``."""
    out, i = [], 0
    while i < len(glob):
        char = glob[i]
        i += 1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[":
            start = i + 1 if glob[i:i + 1] == "!" else i
            end = glob.find("]", start + 1)
            if end < 0:
                out.append(r"\[")
                continue
            body = glob[start:end].replace("\\", "\\\\")
            for special in "[]^&~":
                body = body.replace(special, "\\" + special)
            out.append(f"[{'^' if start > i else ''}{body}]")
            i = end + 1
        else:
            out.append(char if char.isalnum() or char in "_/ " else "\\" + char if char.isascii() else char)
    return "".join(out)


def keep_path(path: Column, max_depth: int = -1, ignore_list: Sequence[str] = ()) -> Column:
    """Whether a relative path survives pruning.

    A glob that matches a folder takes the whole subtree with it: a glob must match
    the path up to some ``/`` or up to its end. ``max_depth`` counts folders.
    """
    keep = F.lit(True)
    if max_depth >= 0:
        keep = keep & (F.size(F.split(path, "/")) - 1 <= max_depth)
    if ignore_list:
        globs = "|".join(glob_pattern(glob) for glob in ignore_list)
        keep = keep & ~path.rlike(rf"(?s)\A(?:{globs})(?:/.*)?\z")
    return keep


def normalise_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"/\z", ""), r"\.git\z", "")


def normalise_url_text(url: str) -> str:
    return url.removesuffix("/").removesuffix(".git")


def wiki_url(url: Column) -> Column:
    return F.when(url.endswith(".wiki.git"), url).otherwise(F.concat(url, F.lit(".wiki.git")))


def is_remote(url: Column) -> Column:
    return url.rlike(r"^https?://")


def owner(url: Column) -> Column:
    """The last part of a url but one; null for a url of one part."""
    return F.try_element_at(F.split(url, "/"), F.lit(-2))


def repo_name(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def permalink(repo_url: Column, commit_id: Column, file_name: Column, line_number: Column) -> Column:
    return F.concat(repo_url, F.lit("/blob/"), commit_id, F.lit("/"), file_name,
                    F.lit("#L"), line_number.cast("string"))
