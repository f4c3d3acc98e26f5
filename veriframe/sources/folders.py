"""Files below a path, local or in any store that Arrow knows, for sources that run in Python workers."""

from __future__ import annotations

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[fs.FileInfo]:
    """The files below a path by name, hidden ones and markers left out; none if the path isn't there."""
    system, root = located(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


def read_bytes(path: str) -> bytes:
    system, at = located(path)
    with system.open_input_stream(at) as stream:
        return stream.read()


def write_once(path: str, data: bytes) -> bool:
    """Write a file whole, by a rename; false, and nothing is written, if it is there already."""
    system, at = located(path)
    if system.get_file_info(at).type != fs.FileType.NotFound:
        return False
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(f"{at}.tmp") as stream:
        stream.write(data)
    system.move(f"{at}.tmp", at)
    return True
