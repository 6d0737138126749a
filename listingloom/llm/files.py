"""Files in folders that all executors reach, local or remote, by pyarrow's file systems."""

import json

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file and the path on it; a plain path is a local one."""
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def created(uri: str) -> tuple[fs.FileSystem, str]:
    """As opened(), of a folder that is made if it is not there."""
    system, path = opened(uri)
    system.create_dir(path, recursive=True)
    return system, path


def write_json(uri: str, value: object) -> None:
    """Written beside its place and moved there, so that it is whole or absent."""
    system, path = opened(uri)
    with system.open_output_stream(f"{path}.new") as out:
        out.write(json.dumps(value).encode())
    system.move(f"{path}.new", path)


def read_json(uri: str) -> object:
    system, path = opened(uri)
    with system.open_input_stream(path) as file:
        return json.loads(file.read())


def drop(uri: str) -> None:
    system, path = opened(uri)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(path)
