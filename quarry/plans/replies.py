"""A log of a model's replies, kept by prompt: what was answered once is not asked again, by a rerun or in place of a lost executor."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

Model = Callable[[list[str]], list[str]]


def logged(model: Model, folder: str, name: str) -> Model:
    """The model, with every reply written to a file of the folder before the next prompt is asked.

    A reply's key is the digest of name and prompt: name tells models, modes and purposes apart, and a prompt holds its case's question,
    so a case that changes is asked anew. Files are written aside and then moved, so none is half there. The folder is a path or a URI
    of a store that tasks reach (file, hdfs, s3, gs).
    """

    def run(prompts: list[str]) -> list[str]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        out = []
        for prompt in prompts:
            digest = hashlib.sha256(f"{name}\0{prompt or ''}".encode()).hexdigest()
            at = f"{root}/{digest[:2]}/{digest}"
            if store.get_file_info(at).type == fs.FileType.NotFound:
                reply = model([prompt])[0]
                store.create_dir(f"{root}/{digest[:2]}", recursive=True)
                aside = f"{root}/{digest[:2]}/{uuid.uuid4().hex}.new"
                with store.open_output_stream(aside) as f:
                    f.write((reply or "").encode())
                store.move(aside, at)
            with store.open_input_stream(at) as f:
                out.append(f.read().decode())
        return out

    return run
