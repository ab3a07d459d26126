"""Binary files of the shared folder, opened inside tasks through the file system their URI names."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str, mode: str):
    """An open file; a folder that is missing is made where the file system has folders."""
    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if mode == "wb":
        system.create_dir(place.rpartition("/")[0], recursive=True)
        return system.open_output_stream(place, compression=None)
    return system.open_input_file(place)
