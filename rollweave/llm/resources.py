"""Where the public vocabulary files lie. The folder is a parameter; the files are inputs that every machine has, never copies of ours."""

from __future__ import annotations

import os

#: Folder of the vocabularies, and the environment variable that names another one.
FOLDER, VARIABLE = "/opt/tokenizers", "ROLLWEAVE_TOKENIZERS"


def path(name: str, folder: str | None = None) -> str:
    """The file ``name``: in ``folder``, else in the one that the environment names, else in ``FOLDER``; a full path stays as it is."""
    return os.path.join(folder or os.environ.get(VARIABLE, FOLDER), name)
